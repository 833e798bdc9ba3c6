"""The registered queries of the subpackage against SQL, and the pipeline stage by stage."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import check
from wareloom.llm import exact_copies, mixing, near_copies, pieces, quality, queries, sql
from wareloom.llm.queries import vocabulary


@pytest.mark.parametrize("name", sorted(sql.all_sql()))
def test_query_equals_sql(spark, duck, folder, name):
    assert check(spark, duck, folder, name, queries.all_queries()[name], sql.all_sql()[name]) == ""


def test_all_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.all_queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.all_queries()) | {"pipeline"} <= names


def test_sharding_is_native(spark, folder):
    df = queries.op1_feistel_shards(spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_pipeline_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, docs, out))
        docs = out
    assert list(stages) == ["quality", "exact_copies", "near_copies", "mixture", "encoding"]
    rows = {name: (sorted(map(tuple, a.collect()), key=str), sorted(map(tuple, b.collect()), key=str)) for name, a, b in seen[:4]}
    assert all(b.columns == columns for _, _, b in seen[:4])
    before, after = rows["quality"]
    good = {r.doc_id for r in quality.score(seen[0][1], labels).where("score >= 0.3").collect()}
    assert after == [r for r in before if r[0] in good]
    before, after = rows["exact_copies"]
    last = {}
    for r in before:
        last[r[1]] = max(last.get(r[1], r), r, key=lambda x: x[0])
    assert after == sorted(last.values(), key=str)
    before, after = rows["near_copies"]
    kept = {r.doc_id for r in near_copies.dedup(seen[2][1]).where("kept").collect()}
    assert after == [r for r in before if r[0] in kept] and len(after) < len(before)
    before, after = rows["mixture"]
    assert set(after) <= set(before)
    rates = mixing.fit_rates(
        mixing.posteriors(seen[3][1], mixing.fit_posteriors(spark.read.parquet(f"{folder}/documents.parquet"), mixing.label_domains(labels), 3), 3),
        [corpus_pipeline.MIXTURE[d] for d in mixing.DOMAINS], corpus_pipeline.BUDGET).rate
    models = mixing.fit_posteriors(spark.read.parquet(f"{folder}/documents.parquet"), mixing.label_domains(labels), 3)
    rate = {r.doc_id: r.r for r in mixing.posteriors(seen[3][1], models, 3).selectExpr("doc_id", f"{rates} AS r").collect()}
    taken = {i: 0 for i in rate}
    for r in after:
        taken[r[0]] += 1
    assert all(abs(taken[i] - rate[i]) < 1 for i in rate)
    machine = pieces.compiled(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    text = {r[0]: r[1] for r in after}
    final = seen[4][2].collect()
    assert after and sorted(r.doc_id for r in final) == sorted(r[0] for r in after)
    assert len(final) == len(after)
    assert all(machine.decode(r.token_ids) == text[r.doc_id] and r.n_tokens == len(r.token_ids) for r in final)


def test_pipeline_takes_odd_rows(spark, folder):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "some words here", None, "s", 1),
            (3, "long " * 50_000, "en", None, 1), (4, "some words here", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, folder)
        assert some.columns == ["doc_id", "n_tokens", "token_ids"]
        some.collect()


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len({texts[i] for i in ids}) == len(set(ids))
    assert exact_copies and mixing
