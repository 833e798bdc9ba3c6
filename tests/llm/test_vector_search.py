import math
import random

from pyspark.sql import functions as F

from wareloom.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, i string, v string, cell int"


def brute(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v):
            if i not in ok or v < ok[i]:
                ok[i] = v
    out = []
    for q in ok:
        if q % 10 == 0:
            near = []
            for c, v in ok.items():
                if c != q and len(v) == len(ok[q]):
                    total = 0.0
                    for x, y in zip(ok[q], v):
                        total += (x - y) * (x - y)
                    near.append((math.sqrt(total), c))
            out += [(q, r, c, d) for r, (d, c) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def search(spark, rows, k=10):
    return sorted(tuple(r) for r in vector_search.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, k).collect())


def test_against_brute_force_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)], "i", "v", 1) for i in range(300)]
    rows += [(1000 + i, [rng.gauss(0, 1) * 10.0 ** rng.randrange(-6, 6) for _ in range(16)], "i", "v", 1) for i in range(200)]
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    assert search(spark, rows) == brute(rows, 10)
    assert search(spark, rows, 1) == brute(rows, 1)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "i", "v", 1), (0, [1.0, 0.0], "i", "v", 1), (0, [0.5, 0.0], None, None, None), (10, None, "i", "v", 1), (20, [0.0, 0.0], "i", "v", 1),
            (30, [nan, 1.0], "i", "v", 1), (40, [inf, 1.0], "i", "v", 1), (50, [None, 1.0], "i", "v", 1), (60, [], "i", "v", 1), (None, [1.0, 1.0], "i", "v", 1),
            (70, [1.0, 2.0, 3.0], "i", "v", 1), (-10, [2.0, 2.0], "i", "v", 1), (1, [1e-30, 1e30], "i", "v", 1), (2, [2.0, 2.0], "i", "v", 1)]
    import numpy as np

    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    assert search(spark, rows) == brute(rows, 10)
    assert search(spark, []) == []


def test_huge_and_tiny_components(spark):
    """Squares beyond the range of doubles: compared with distances of the same vectors scaled by a power of two."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**540 for _ in range(3)]) for i in range(40)] + [(100 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(20)]
    schema = "vec_id long, embedding array<double>"
    got = sorted(tuple(r) for r in vector_search.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0, 10).collect())
    want = brute([(i, [x * 2.0**-540 for x in v]) for i, v in rows], 10)
    assert [r[:3] for r in got if r[0] < 100] == [r[:3] for r in want if r[0] < 100]
    assert all(math.isclose(g[3], w[3] * 2.0**540, rel_tol=1e-12) for g, w in zip(got, want) if g[0] < 100)
    assert len([r for r in got if r[0] >= 100]) == 20 and all(math.isfinite(r[3]) for r in got)


def test_one_id_in_most_rows(spark):
    rows = [(10, [float(1 + i % 7), 2.0], "i", "v", 1) for i in range(3000)] + [(i, [float(i), 1.0], "i", "v", 1) for i in range(30) if i != 10]
    assert search(spark, rows) == brute(rows, 10)
