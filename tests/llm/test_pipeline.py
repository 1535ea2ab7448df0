import re

import corpus_pipeline
from tidemark.llm import op4_jaccard_join, queries

SF = "/root/testdata/sf0.001"


def _rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_take_effect(spark, small):
    before = small
    kept = [_rows(small)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == small.columns, name
        kept.append(_rows(after))
        assert set(kept[-1]) <= set(kept[-2]) and kept[-1], name
        before = after
    documents, good, single, clean, private = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(documents) - set(good)
    assert all(labels.get(d, 0) == 0 for d in gone)
    linked = op4_jaccard_join.join(small.filter(small.doc_id.isin(list(good)))).collect()
    assert set(single) == {r["component_id"] for r in linked if r["n_shingles"]}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in single.items() if any(i in t for i in items)}
    assert set(single) - set(clean) == leaked
    assert set(private) == set(clean)
    personal = re.compile(r"\S+@\S+|\d{16}|\d+\.\d+\.\d+\.\d+|[0-9a-f]{40}")
    for d, t in clean.items():
        assert not [f for f in personal.findall(t) if f in private[d]]
    packed = corpus_pipeline.packing(spark, before, SF).collect()
    assert {r["doc_id"] for r in packed} == set(private)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {"doc_id", "piece", "sequence_id", "offset"} <= set(got[0].asDict())


def test_edges(spark, edge, empty):
    for docs in (edge, empty):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if stage is not corpus_pipeline.packing:
                assert now.columns == docs.columns
        assert (now.count() > 0) == (docs is edge)


def _bag(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_each_stage_on_edge_rows(spark, edge):
    """Nulls, repeated rows, clashing columns and long texts, each stage by itself."""
    rows = _bag(edge)
    good = corpus_pipeline.quality(spark, edge, SF)
    assert good.columns == edge.columns and set(_bag(good)) <= set(rows)
    clean = _bag(corpus_pipeline.decontamination(spark, edge, SF))
    assert clean == rows
    single = corpus_pipeline.near_duplicates(spark, edge, SF)
    assert single.columns == edge.columns and set(_bag(single)) <= set(rows)
    texts = [r["text"] for r in single.collect()]
    assert texts.count(None) == 2 and "" in texts and " \n\t " in texts
    assert len([t for t in texts if t and t.startswith(edge.filter("doc_id = 2").first()["text"][:40])]) == 1
    private = corpus_pipeline.personal_data(spark, edge, SF)
    rest = [c for c in edge.columns if c != "text"]
    assert private.columns == edge.columns and _bag(private.select(*rest)) == _bag(edge.select(*rest))
    assert private.filter("text is null").count() == edge.filter("text is null").count()
    packed = corpus_pipeline.packing(spark, edge, SF).collect()
    first = [r for r in packed if r["piece"] == 0]
    assert len(first) == edge.count()
    assert all(r["length"] == 1 for r in first if r["doc_id"] in (3, 4, 5))


def test_registered(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= names
    assert sorted(n.split("_")[0] for n in names if re.match(r"op\d+_", n)) == sorted(f"op{k}" for k in range(1, 14))
