"""Synthetic warehouses and data quality as lazy Spark DataFrame operators."""

from wareloom.config import GenConfig
from wareloom.plans.dataset import GENERATORS, dirty, generate, run

__all__ = ["GENERATORS", "GenConfig", "dirty", "generate", "run"]
