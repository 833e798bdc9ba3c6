import tracemalloc

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from wareloom.llm import linear, mixing, ngrams, quality, queries, toxicity
from wareloom.llm.common import written
from wareloom.llm.words import BATCH_BYTES

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string, y int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def pandas_labels(tables):
    return tables[1].toPandas().set_index("doc_id")


def odd(spark):
    docs = [(None, "no id here", "x", 1), (1, None, None, None), (2, "", "x", 1), (2, "", "x", 1), (3, "word " * 60_000, "x", 1), (4, "ok text", "x", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, fold int")


def test_quality_held_out(spark, tables):
    got = quality.score(*tables).toPandas().set_index("doc_id").join(pandas_labels(tables), how="inner")
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).all()
    assert got.score.between(0, 1).all()


def test_quality_learns_nothing_from_the_held_out_fold(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - quality, quality) AS quality")
    a = quality.score(docs, labels).toPandas().set_index("doc_id").score
    b = quality.score(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(a, b[a.index])


def test_quality_edges(spark, tables):
    docs = odd(spark)
    for labels in ([], [(4, None, None, "t", 1)], [(4, 1, 0, "t", 1), (4, 1, 0, "t", 1)]):
        frame = spark.createDataFrame(labels, LABELS)
        assert {r.score for r in quality.score(docs, frame).collect()} == {0.5}
        assert quality.keep_good(docs, frame).columns == docs.columns
    assert quality.score(docs, tables[1]).count() == 6
    assert quality.score(docs.limit(0), tables[1]).collect() == []


def test_indicators_do_not_depend_on_the_batch():
    texts = ["The trash %%% the trash", "", "a a a b b", "x" * (BATCH_BYTES + 5), "The trash %%% the trash"]
    found = ngrams.sets(pd.Series(texts))
    assert [set(a) for a in found] == [set(ngrams.sets(pd.Series([t]))[0]) for t in texts]
    assert len(found[1]) == 0 and all(len(set(a)) == len(a) for a in found)


def test_densities_and_margins_agree():
    texts = pd.Series(["one two three two", "", None, "idiots idiot idiotic", "y " * 5000])
    w = np.random.default_rng(1).normal(size=(2, linear.SIZE)).astype(np.float32)
    rows = linear.densities(texts)
    m, n = linear.margins(texts, w)
    assert n.tolist() == [4, 0, 0, 3, 5000]
    for i, (f, v) in enumerate(rows):
        assert np.allclose(m[i], [w[0][f] @ v, w[1][f] @ v], atol=1e-3)


@pytest.mark.parametrize("size,least", [("sf0.01", 0.5), ("sf0.1", 0.85)])
def test_toxicity_held_out(spark, size, least):
    """Recall of held-out toxic rows, and clean rows left alone; a model that never says toxic fails."""
    own = tuple(spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(*own).toPandas().set_index("doc_id")
    seen = got[["held_out"]].join(got.p_toxic).join(pandas_labels(own), how="inner")
    held = seen[seen.held_out]
    assert (held[held.toxic == 1].p_toxic >= 0.5).mean() >= least and (held[held.toxic == 0].p_toxic < 0.5).mean() > 0.99


def test_chain_feeds_earlier_probabilities():
    """The second category is the first one's outcome: without it there is nothing to learn from."""
    rng = np.random.default_rng(2)
    rows = [(np.array([int(a)], np.int32), np.ones(1, np.float32)) for a in rng.integers(0, 2, 400)]
    first = np.array([f[0] for f, _ in rows])
    models = toxicity.fit_chain(rows, np.stack([first, first], axis=1), np.arange(400) % 5)
    assert models[1].more.shape == (1,) and models[1].more[0] > 0


def test_toxicity_edges(spark, tables):
    docs = odd(spark)
    got = toxicity.score(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 6 and {r.toxic for r in got} == {0}
    assert len(toxicity.score(docs, tables[1]).collect()) == 6
    assert toxicity.score(docs.limit(0), tables[1]).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixture_meets_its_targets(spark, size, caplog):
    """With op3's weights at every size: met, or the shares reached are told and no domain is farther off than before."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels, queries.MIXTURE).toPandas()
    p, total = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), got.n_tokens.sum()
    before, reached = got.n_tokens @ p / total, (got.rate * got.n_tokens) @ p
    wanted = np.array([queries.MIXTURE[d] for d in mixing.DOMAINS])
    shares = reached / reached.sum()
    assert np.allclose(shares, got[[f"reached_{d}" for d in mixing.DOMAINS]].iloc[0])
    assert (got.rate >= 0).all() and np.allclose(p.sum(axis=1), 1) and (abs(got.copies - got.rate) < 1).all()
    assert abs(got.copies.sum() - got.rate.sum()) < 0.1 * len(got)
    if size == "sf0.001":  # 87 labels, eleven of them toxic: posteriors may be too flat
        assert (abs(shares - wanted) <= abs(before - wanted) + 0.005).all()
        assert ("mixture off its target" in caplog.text) == bool((abs(shares - wanted) > mixing.MISSED).any())
    else:
        assert (abs(shares - wanted) < 0.001).all() and abs(reached.sum() / total - 1) < 0.001 and "off its target" not in caplog.text


def test_rates_without_cap_reach_a_rare_domain(spark):
    """A domain of a thousandth of the tokens is raised a hundredfold."""
    rows = [(100, [0.999, 0.001])] * 990 + [(10, [0.05, 0.95])] * 10
    mass = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    found = mixing.fit_rates(mass, [0.9, 0.1])
    rates = np.array([r.r for r in mass.selectExpr(f"{found.rate} AS r").collect()])
    p, n = np.array([x for _, x in rows]), np.array([x for x, _ in rows])
    assert np.allclose((rates * n) @ p / n.sum(), [0.9, 0.1], atol=1e-3) and rates.max() > 50 and not found.missed


def test_rates_solve_the_bounded_problem(spark):
    """Against a plain projected-gradient solution on the driver."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 200)
    n = rng.integers(0, 500, 200)
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p)]
    mass = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    rate = mixing.fit_rates(mass, [0.7, 0.2, 0.1], budget=1.2, low=0.5, high=1.5).rate
    got = np.array([r.r for r in mass.selectExpr(f"{rate} AS r").collect()])
    now = (n[:, None] * p).sum(axis=0)
    goal = np.array([0.7, 0.2, 0.1]) * 1.2 * n.sum()
    r = np.ones(200)
    for _ in range(5000):
        r = np.clip(r - p @ (((r * n) @ p - goal) / now), 0.5, 1.5)
    loss = lambda x: ((((x * n) @ p - goal) ** 2) / now).sum()
    assert loss(got) <= loss(r) * 1.02 + 1e-3 and got.min() >= 0.5 and got.max() <= 1.5


def test_mixture_edges(spark, tables):
    docs = odd(spark)
    weights = {"good": 1.0, "poor": 1.0, "toxic": 1.0}
    none = spark.createDataFrame([], LABELS)
    got = mixing.mix(docs, none, weights).collect()
    assert len(got) == 6 and all(abs(r.p_good - 1 / 3) < 1e-9 for r in got)
    clash = docs.selectExpr("doc_id", "text", "score AS p", "fold AS n", "fold AS row")
    out = mixing.mixed(clash, tables[1], weights, low=1.0, high=2.0)
    assert out.columns == clash.columns and out.count() >= 6
    assert mixing.mix(docs.limit(0), tables[1], weights).collect() == []


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_pipeline_mixture_meets_its_weights(spark, size, caplog):
    """With the production weights and budget, on what the quality stage keeps, learned from all labelled documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    kept = written(quality.keep_good(docs, labels), "kept")
    models = mixing.fit_posteriors(docs, mixing.label_domains(labels), 3)
    mass = mixing.posteriors(kept, models, 3).toPandas()
    out = mixing.mixed(kept, labels, corpus_pipeline.MIXTURE, corpus_pipeline.BUDGET, taught=docs)
    taken = out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    p, copies = np.array(mass.p.tolist()), mass.doc_id.map(taken).fillna(0).to_numpy()
    tokens = (copies * mass.n_tokens.to_numpy()) @ p
    assert "off its target" not in caplog.text
    # Whole copies instead of rates: within what chance leaves.
    for domain, share in zip(mixing.DOMAINS, tokens / tokens.sum()):
        assert abs(share - corpus_pipeline.MIXTURE[domain]) < 0.02
    assert abs(tokens.sum() / mass.n_tokens.sum() / corpus_pipeline.BUDGET - 1) < 0.05


def test_a_missed_mixture_is_reported(spark, caplog):
    mass = spark.createDataFrame([(100, [0.5, 0.5]), (100, [0.9, 0.1])], "n_tokens long, p array<double>")
    mixing.fit_rates(mass, [0.98, 0.02], 1.05, 1.0, 2.0)
    assert "mixture off its target" in caplog.text


def test_training_bounds_are_the_first_ones():
    assert (quality.MAX_TRAIN, toxicity.MAX_TRAIN, mixing.MAX_TRAIN) == (12_000, 8_000, 6_000)


def test_fit_holds_no_second_copy_of_the_rows():
    """Peak of a fit beside its rows: less than half of what they take."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(linear.SIZE, 4000, False)).astype(np.int32), rng.random(4000, np.float32)) for _ in range(1500)]
    sets = [f for f, _ in rows]
    y = np.arange(1500) % 2
    size = sum(f.nbytes + v.nbytes for f, v in rows)
    for fit, most in ((lambda: linear._fit(rows, np.zeros((1500, 0)), y), size / 2),
                      (lambda: quality.dual_coordinate_descent(sets, y, quality.log_ratio(sets, y)), size / 2)):
        tracemalloc.start()
        fit()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_flat_rows_keep_their_features():
    frames = [pd.DataFrame({"doc_id": [3, 1], "y": [0, 1], "f": [np.arange(2, dtype=np.int32).tobytes(), b""]}),
              pd.DataFrame({"doc_id": [2], "y": [1], "f": [np.arange(5, dtype=np.int32).tobytes()]})]
    held, rows = ngrams.flat(iter(frames), {"f": np.int32}, ["doc_id", "y"])
    assert held.doc_id.tolist() == [1, 2, 3] and [r[0].tolist() for r in rows] == [[], [0, 1, 2, 3, 4], [0, 1]]
