import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import op8_quality as op
from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    fm = op.FactorisationMachine(rng.normal(size=50).astype(np.float32),
                                 rng.normal(size=(50, op.RANK)).astype(np.float32))
    index = [rng.integers(0, 50, n) for n in (1, 4, 9)]
    value = [rng.normal(size=len(i)).astype(np.float32) for i in index]
    first = np.cumsum([0, 1, 4])
    got = fm.logits(np.concatenate(index), np.concatenate(value), first)
    for k, (i, x) in enumerate(zip(index, value)):
        want = float(fm.linear[i] @ x)
        for a in range(len(i)):
            for b in range(a + 1, len(i)):
                want += float(fm.factors[i[a]] @ fm.factors[i[b]]) * x[a] * x[b]
        assert abs(got[k] - want) < 1e-3


def test_held_out_accuracy(spark):
    got = queries.op8_factorisation_machine(spark, SF).join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = [r for r in got if r["quality"] == 1]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert np.mean([r["score"] for r in good]) > np.mean([r["score"] for r in bad]) + 0.5
    pairs = [(g["score"] > b["score"]) for g in good for b in bad]
    assert np.mean(pairs) > 0.97


def test_scores_do_not_use_lang_source_or_id(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = op.fit(small, labels)
    a = {r["doc_id"]: r["score"] for r in op.score(small, model).collect()}
    other = small.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")) \
        .withColumn("doc_id", F.col("doc_id") + 1000)
    assert {r["doc_id"] - 1000: r["score"] for r in op.score(other, model).collect()} == a
    again = op.fit(small.repartition(5), labels)
    assert np.array_equal(model.factors, again.factors)


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (9, None), (11, 0), (None, 1), (12, 0), (12, 1)],
                                   "doc_id long, quality int")
    model = op.fit(edge, labels)
    got = op.score(edge, model)
    assert got.columns == [c for c in edge.columns if c != "score"] + ["score"]
    scores = [r["score"] for r in got.collect()]
    assert len(scores) == edge.count() and all(0 <= s <= 1 for s in scores)
    assert op.score(empty, model).count() == 0
    # no labels, or labels of one kind
    assert op.fit(edge, labels.limit(0)) is None
    assert op.fit(edge, labels.filter("quality = 1 and doc_id = 7")) is None
    assert {r["score"] for r in op.score(edge, None).collect()} == {1.0}
