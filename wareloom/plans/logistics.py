"""Freight: routes, shipments, deliveries and fleet usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions import pools
from wareloom.functions.draws import Draws, distinct_pair, div, key_draw, money, padded_id, pick, threshold
from wareloom.operators.ranking import expand_with_running_id
from wareloom.plans.common import city, date_key, dim_date, int_col, positions, seeded, state

# Fixed values.
ROUTE_TYPES = ["Ground", "Air", "Ocean", "Rail"]
VEHICLE_TYPES = ["Truck", "Van", "Cargo Plane", "Container Ship", "Train"]
FUELS = ["Diesel", "Gasoline", "Electric", "Hybrid"]
VEHICLE_STATUS = {"Active": 85, "Maintenance": 10, "Retired": 5}
WAREHOUSE_TYPES = ["Distribution", "Fulfillment", "Cross-Dock", "Cold Storage"]
DELIVERY_STATUS = {"Delivered": 75, "In Transit": 10, "Out for Delivery": 5, "Delayed": 7, "Failed": 3}
DAILY_USE = 0.7


def _distance(u: Draws) -> Column:
    return u.randint("distance_miles", 50, 3000)


def _transit_days(u: Draws) -> Column:
    return u.randint("transit_days", 1, 7)


def dim_route(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_route", "routes", "route_key")
    places = pools.CITIES[: pools.ROUTE_CITY_COUNT]
    n = len(places)
    df = df.withColumns({"_o": u.index("origin_city", n), "_d": u.index("destination_city", n - 1)})
    origin, destination = distinct_pair(F.col("_o"), F.col("_d"), n)
    return df.select(
        "route_key",
        padded_id("RT", F.col("route_key"), 5).alias("route_id"),
        pick(places, origin).alias("origin_city"),
        pick(places, destination).alias("destination_city"),
        int_col(_distance(u)).alias("distance_miles"),
        int_col(_transit_days(u)).alias("transit_days"),
        u.choice("route_type", ROUTE_TYPES).alias("route_type"),
    )


def dim_vehicle(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_vehicle", "vehicles", "vehicle_key")
    return df.select(
        "vehicle_key",
        padded_id("VH", F.col("vehicle_key"), 5).alias("vehicle_id"),
        u.choice("vehicle_type", VEHICLE_TYPES).alias("vehicle_type"),
        int_col(u.randint("capacity_lbs", 1000, 100000)).alias("capacity_lbs"),
        u.choice("fuel_type", FUELS).alias("fuel_type"),
        int_col(u.randint("year", 2015, 2024)).alias("year"),
        _vehicle_status(cfg, "vehicle_key").alias("status"),
    )


def _status_draw(cfg: GenConfig, vehicle_key: str) -> Column:
    return key_draw(cfg.seed, "logistics.dim_vehicle.status", vehicle_key) % F.lit(100)


def _vehicle_status(cfg: GenConfig, vehicle_key: str) -> Column:
    h = _status_draw(cfg, vehicle_key)
    active, maintenance = VEHICLE_STATUS["Active"], VEHICLE_STATUS["Maintenance"]
    return (
        F.when(h < active, F.lit("Active"))
        .when(h < active + maintenance, F.lit("Maintenance"))
        .otherwise(F.lit("Retired"))
    )


def dim_warehouse(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_warehouse", "warehouses", "warehouse_key")
    return df.select(
        "warehouse_key",
        padded_id("WH", F.col("warehouse_key"), 4).alias("warehouse_id"),
        F.concat(city(u, "name_city"), F.lit(" DC")).alias("warehouse_name"),
        city(u).alias("city"),
        state(u).alias("state"),
        int_col(u.randint("sqft", 50000, 500000)).alias("sqft"),
        u.choice("warehouse_type", WAREHOUSE_TYPES).alias("warehouse_type"),
    )


def _route_key(u: Draws, cfg: GenConfig) -> Column:
    return u.skewed_key("route_key", cfg.n("routes"))


def fact_shipments(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_shipments", "shipments", "shipment_id")
    r = Draws(cfg.seed, "logistics.dim_route", "_r")
    df = df.select(
        "shipment_id",
        date_key(u, cfg).alias("date_key"),
        _route_key(u, cfg).alias("route_key"),
        u.randint("vehicle_key", 1, cfg.n("vehicles")).alias("vehicle_key"),
        u.randint("origin_warehouse_key", 1, cfg.n("warehouses")).alias("origin_warehouse_key"),
        u.randint("dest_warehouse_key", 1, cfg.n("warehouses")).alias("dest_warehouse_key"),
        u.randint("weight_lbs", 100, 10000).alias("_weight"),
        u.randint("cost_per_lb", 5000, 20000).alias("_rate"),
    )
    df = r.attach(df, "route_key")
    return df.select(
        "shipment_id", "date_key", "route_key", "vehicle_key", "origin_warehouse_key", "dest_warehouse_key",
        int_col(F.col("_weight")).alias("weight_lbs"),
        int_col(_distance(r)).alias("distance_miles"),
        money(div(F.col("_weight") * F.col("_rate") + F.lit(50), 100)).alias("shipping_cost"),
    )


def fact_deliveries(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """One row per shipment; route and transit time follow from the shipment key.

    ``on_time`` compares the drawn transit time before it is raised to one day.
    """
    df, u = seeded(spark, cfg, "fact_deliveries", "shipments", "shipment_id")
    s = Draws(cfg.seed, "logistics.fact_shipments", "_h")
    r = Draws(cfg.seed, "logistics.dim_route", "_r")
    df = s.attach(df, "shipment_id").withColumn("_route", _route_key(s, cfg))
    df = r.attach(df, "_route").withColumns({
        "_expected": _transit_days(r),
        "delivery_status": u.weighted("delivery_status", DELIVERY_STATUS),
        "_delta": u.randint("delay", -1, 3),
    })
    delivered = F.col("delivery_status") == "Delivered"
    actual = F.col("_expected") + F.col("_delta")
    return df.select(
        F.col("shipment_id").alias("delivery_id"),
        "shipment_id",
        int_col(F.col("_expected")).alias("expected_transit_days"),
        int_col(F.when(delivered, F.greatest(F.lit(1), actual))).alias("actual_transit_days"),
        "delivery_status",
        F.when(delivered, F.col("_delta") <= 0).alias("on_time"),
        int_col(
            F.when(F.col("delivery_status").isin("Delivered", "Failed"), u.randint("delivery_attempts", 1, 3))
            .otherwise(F.lit(0))
        ).alias("delivery_attempts"),
    )


def _in_use(cfg: GenConfig, position: str) -> Column:
    """1 if the vehicle of a (day, vehicle) position is active and drove that day."""
    vehicle = f"{position} % {cfg.n('vehicles')} + 1"
    used = key_draw(cfg.seed, "logistics.fact_fleet_usage.used", position) < F.lit(threshold(DAILY_USE))
    return F.when(used & (_status_draw(cfg, vehicle) < VEHICLE_STATUS["Active"]), F.lit(1)).otherwise(F.lit(0))


def fact_fleet_usage(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """Days × active vehicles as one range of positions, with dense running ids."""
    n = cfg.n("vehicles")
    rows = expand_with_running_id(
        spark, cfg.n_days * n, lambda p: _in_use(cfg, p),
        source=positions(spark, cfg, "vehicles", cfg.n_days * n, "position") if cfg.keys else None)
    u = Draws(cfg.seed, "logistics.fact_fleet_usage")
    return u.attach(rows, "position").select(
        F.col("running_id").alias("usage_id"),
        (div(F.col("position"), n) + F.lit(1)).alias("date_key"),
        (F.col("position") % F.lit(n) + F.lit(1)).alias("vehicle_key"),
        int_col(u.randint("miles_driven", 50, 500)).alias("miles_driven"),
        money(u.randint("fuel_gallons", 2000, 10000)).alias("fuel_gallons"),
        (u.randint("hours_operated", 40, 120) / F.lit(10.0)).cast("decimal(5,1)").alias("hours_operated"),
        u.chance("maintenance_flag", 0.05).alias("maintenance_flag"),
    )


TABLES = {
    "dim_date": dim_date,
    "dim_route": dim_route,
    "dim_vehicle": dim_vehicle,
    "dim_warehouse": dim_warehouse,
    "fact_shipments": fact_shipments,
    "fact_deliveries": fact_deliveries,
    "fact_fleet_usage": fact_fleet_usage,
}
