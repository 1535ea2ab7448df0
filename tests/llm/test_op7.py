import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op7_rollup as op
from tidemark.llm import queries

COLUMNS = "source string, lang string, tokens long, old long"


def _changes(spark, kind, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return op.change(df, kind, F.col("source"), F.col("lang"), F.lit("t@1"), F.col("tokens"), F.col("old"))


def _totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_signed_batches(spark, tmp_path):
    r = op.TokenRollup(spark, str(tmp_path / "r"))
    assert _totals(r) == []
    load = _changes(spark, "insert", [("a", "en", 5, 0), ("a", "en", 7, 0), (None, None, None, 0), ("b", "de", 1, 0)])
    assert r.commit("load", load) and not r.commit("load", load)
    assert _totals(r) == sorted([("a", "en", "t@1", 2, 12), (None, None, "t@1", 1, 0),
                                 ("b", "de", "t@1", 1, 1)], key=str)
    r.commit("fix", _changes(spark, "revise", [("a", "en", 9, 7)]))
    r.commit("drop", _changes(spark, "delete", [("b", "de", 1, 0)]))
    assert _totals(r) == sorted([("a", "en", "t@1", 2, 14), (None, None, "t@1", 1, 0)], key=str)
    assert r.commit("nothing", load.limit(0)) and not r.commit("nothing", load)
    packed = r.compacted(str(tmp_path / "s"), "base")
    assert _totals(packed) == _totals(r)
    assert not packed.commit("load", load) and packed.commit("more", load)


def test_broken_batch_is_invisible(spark, tmp_path):
    r = op.TokenRollup(spark, str(tmp_path / "r"))
    rows = _changes(spark, "insert", [("a", "en", 5, 0)])
    # the data was written, the ledger row was not
    op.summed(op.signed(rows)).write.parquet(f"{r.path}/data/one")
    assert _totals(r) == []
    assert r.commit("one", rows) and _totals(r) == [("a", "en", "t@1", 1, 5)]
    with pytest.raises(ValueError):
        r.commit("../x", rows)


def test_moved_key(spark, tmp_path):
    r = op.TokenRollup(spark, str(tmp_path / "r"))
    r.commit("load", _changes(spark, "insert", [("a", "en", 5, 0)]))
    df = spark.createDataFrame([("a", "fr", 6, 5)], COLUMNS)
    r.commit("move", op.change(df, "revise", F.col("source"), F.col("lang"), F.lit("t@1"),
                               F.col("tokens"), F.col("old"), old_lang=F.lit("en")))
    assert _totals(r) == [("a", "fr", "t@1", 1, 6)]


def test_edges(spark, tmp_path, edge, empty):
    for name, docs in (("edge", edge), ("empty", empty)):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(
            str(tmp_path / name / "documents.parquet"))
        got = queries.op7_rollup_totals(spark, str(tmp_path / name)).collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        sql = queries.ORACLE_SQL["op7_rollup_totals"]
        if name == "empty":
            assert got == [] and con.execute(sql).fetchall() == []
