"""Preambles by position, damaged rows, committed exports, dictionaries, nested results."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.dictionaries import MOST, dictionary, inverted, lookup
from tidemark.operators.nested import attach, fold, nest, unnest
from tidemark.sources import exports as ex

SCHEMA = "`Country Name` string, Users long, Revenue double"
HEAD = ["preamble", "", "Chad,1,2.5", "Country Name,Users,Revenue"]


def _file(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_preamble_and_damaged_rows(spark, tmp_path):
    _file(tmp_path / "in", "a.csv", [*HEAD, 'Peru,3,1.5', 'Chad,x,2.5', "", 'Mali,4', '"Côte, d\'Ivoire",5,0.5',
                                    'Togo,1,2,3', '"broken', 'field",6,1.0', 'Fiji,,'])
    _file(tmp_path / "in", "b.csv", [*HEAD, 'Cuba,9,9.0'])
    _file(tmp_path / "in", "empty.csv", HEAD)
    got = ex.read_export(spark, str(tmp_path / "in"), SCHEMA, skip=3)
    assert got.columns == ["country_name", "users", "revenue", *ex.MARKS]
    assert set(_rows(ex.sound_rows(got))) == {("Cuba", 9, 9.0), ("Côte, d'Ivoire", 5, 0.5),
                                              ("Fiji", None, None), ("Peru", 3, 1.5)}
    bad = {(r["line"], r["raw"]) for r in ex.quarantine(got).collect()}
    assert bad == {(6, "Chad,x,2.5"), (8, "Mali,4"), (10, "Togo,1,2,3"), (11, '"broken'), (12, 'field",6,1.0')}
    assert {os.path.basename(r["file"]) for r in ex.quarantine(got).collect()} == {"a.csv"}


def test_small_blocks(spark, tmp_path):
    """Lines of a file that is read in many blocks: one preamble, nothing twice."""
    lines = [*HEAD, *[f"Land{i},{i},{i}.5" for i in range(4000)]]
    _file(tmp_path / "in", "a.csv", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = ex.read_export(spark, str(tmp_path / "in"), SCHEMA, skip=3)
        assert got.rdd.getNumPartitions() > 4
        assert _rows(ex.sound_rows(got)) == sorted(((f"Land{i}", i, i + 0.5) for i in range(4000)), key=str)
        assert ex.quarantine(got).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_other_header_is_an_error(spark, tmp_path):
    _file(tmp_path / "in", "a.csv", ["Users,Country Name,Revenue", "1,Peru,2.0"])
    with pytest.raises(Exception, match="its header is"):
        ex.read_export(spark, str(tmp_path / "in"), SCHEMA).count()
    assert ex.sound_rows(ex.read_export(spark, str(tmp_path / "in"), "u long, c string, r double",
                                        check_header=False)).collect() == [(1, "Peru", 2.0)]


def test_write_with_preamble(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ('q"uote', None, 1.5), ("line, comma", 3, None)], SCHEMA)
    path = str(tmp_path / "out")
    ex.write_with_preamble(ex.csv_lines(df.repartition(2)), df.columns, path, HEAD[:3])
    assert _rows(ex.sound_rows(ex.read_export(spark, path, SCHEMA, 3))) == _rows(df)
    ex.write_with_preamble(ex.csv_lines(df.limit(0)), df.columns, str(tmp_path / "none"))
    assert ex.read_export(spark, str(tmp_path / "none"), SCHEMA).count() == 0


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_commit(spark, tmp_path, kind):
    folder = str(tmp_path / "e")
    with pytest.raises(FileNotFoundError):
        ex.read_committed(spark, folder)
    one = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "c string, n long")
    two = one.union(spark.createDataFrame([("b", None)], one.schema))
    assert ex.commit(one, folder, kind) == 1
    assert _rows(ex.read_committed(spark, folder)) == _rows(one)
    assert ex.commit(two, folder, kind) == 2
    # data without a manifest, and a manifest that was not committed, are invisible
    one.write.parquet(f"{folder}/data/broken")
    os.makedirs(f"{folder}/manifests/v=00000003/_temporary/0")
    with open(f"{folder}/manifests/v=00000003/_temporary/0/part-0.json", "w") as f:
        f.write('{"version": 3, "data": "nowhere"}')
    assert _rows(ex.read_committed(spark, folder)) == _rows(two)
    assert _rows(ex.read_committed(spark, folder, 1)) == _rows(one)
    with pytest.raises(Exception, match="(?i)exists"):
        ex.commit(one, folder, kind, version=2)
    assert _rows(ex.read_committed(spark, folder)) == _rows(two)
    assert ex.commit(one.limit(0), folder, "parquet", version=9) == 9
    assert ex.read_committed(spark, folder).collect() == []
    assert {r["version"]: r["n_rows"] for r in ex.manifests(spark, folder).collect()} == {1: 3, 2: 4, 9: 0}


def test_changed_data_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "e")
    df = spark.createDataFrame([("a", 1), ("a", 1)], "c string, n long")
    ex.commit(df, folder)
    data = ex.manifests(spark, folder).first()["data"]
    df.limit(1).write.mode("append").parquet(data)
    with pytest.raises(ValueError, match="not what its manifest says"):
        ex.read_committed(spark, folder)
    assert ex.read_committed(spark, folder, verify=False).count() == 3


def test_second_writer_of_a_version_loses(spark, tmp_path):
    folder = str(tmp_path / "e")
    df = spark.createDataFrame([("a", 1)], "c string, n long")
    ex.commit(df, folder)
    first = ex.manifests(spark, folder).first().asDict()
    # the same version's manifest of a writer that passed the check at the same time
    late = dict(first, data=first["data"] + "-late")
    spark.createDataFrame([late], ex.MANIFEST).write.mode("append").json(f"{folder}/manifests/v=00000001")
    assert ex.manifests(spark, folder).count() == 2
    assert ex.read_committed(spark, folder).count() == 1  # the smaller path counts


def test_dictionary(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "name string, id long")
    df = spark.createDataFrame([("a",), ("(start)",), ("zzz",), (None,), ("b",)], "c string")
    numbers = dictionary(d, "name", "id")
    got = df.select("c", lookup(numbers, F.col("c"), "(start)").alias("n"),
                    lookup(numbers, F.col("c")).alias("strict"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", "1", "1"), ("(start)", "(start)", None), ("zzz", None, None), (None, None, None), ("b", "2", "2")}
    back = spark.range(3).select(F.try_element_at(inverted(numbers), F.col("id")).alias("n"))
    assert [r["n"] for r in back.collect()] == [None, "a", "b"]
    assert df.select(lookup(dictionary(d.limit(0), "name", "id"), F.col("c")).alias("x")).filter("x is null").count() == 5
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary_bound(spark):
    big = spark.range(MOST + 1).select(F.col("id").cast("string").alias("k"), "id")
    with pytest.raises(Exception, match="at most"):
        spark.range(1).select(lookup(dictionary(big, "k", "id"), F.lit("1"))).collect()


def test_nested(spark):
    df = spark.createDataFrame([("a", 2, 0.5), ("a", 1, None), ("b", 1, 3.0), (None, 7, 1.0)], "g string, i int, v double")
    n = nest(df, ["g"], "rows", ["i"])
    assert n.schema["rows"].dataType.simpleString() == "array<struct<i:int,v:double>>"
    assert _rows(unnest(n, "rows")) == _rows(df)
    assert {r["g"]: r["s"] for r in n.select("g", fold("rows", "v").alias("s")).collect()} == {
        "a": 0.5, "b": 3.0, None: 1.0}
    both = attach(n, nest(df.filter("i = 1").select("g", "v"), ["g"], "firsts"), ["g"])
    assert both.columns == ["g", "rows", "firsts"] and both.filter("g = 'b'").first()["firsts"] == [(3.0,)]
    assert unnest(nest(df.limit(0), ["g"], "rows"), "rows").count() == 0


# --- names ---------------------------------------------------------------------------

def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _plain_pairs(names, targets):
    allowed = lambda n: 0 if len(n) <= 3 else 1 if len(n) <= 7 else 2
    return sorted((_edits(n.lower(), t.lower()), n, t) for n in names for t in targets
                  if _edits(n.lower(), t.lower()) <= allowed(n))


def _greedy(pairs):
    names, targets, out = set(), set(), set()
    for d, n, t in pairs:
        if n not in names and t not in targets:
            names.add(n)
            targets.add(t)
            out.add((n, t, d))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_names_and_assignment(spark, seed):
    """Few letters, so that many pairs are close: all of them, and greedily one to one."""
    import random

    from tidemark.operators import names as nm
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abB") for _ in range(rng.randint(1, 12)))
    names, targets = {word() for _ in range(70)}, {word() for _ in range(70)}
    n = spark.createDataFrame([(x,) for x in names], "name string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    pairs = nm.similar_names(n, t)
    plain = _plain_pairs(names, targets)
    assert {(r["distance"], r["name"], r["target"]) for r in pairs.collect()} == set(plain)
    assert {(r["name"], r["target"], r["distance"]) for r in nm.one_to_one(pairs).collect()} == _greedy(plain)


def test_reconcile(spark):
    from tidemark.operators.names import reconcile
    names = ["Chad", "CÔTE D'IVOIRE", "Cote d'Ivoire", "Germny", "Germanyy", "Untied States", "Mali", "Malí", "Xx",
             None, "Chad", ""]
    targets = ["Chad", "Côte d'Ivoire", "Germany", "United States", "Mali", "Peru", None, "Xy"]
    got = {r["name"]: (r["target"], r["how"], r["distance"]) for r in reconcile(
        spark.createDataFrame([(x, 1) for x in names], "country string, target int"),
        spark.createDataFrame([(x, "c") for x in targets], "geo string, name string"), "country", "geo").collect()}
    assert got == {
        "Chad": ("Chad", "exact", 0), "Mali": ("Mali", "exact", 0), "Malí": (None, None, None),
        "CÔTE D'IVOIRE": (None, None, None), "Cote d'Ivoire": ("Côte d'Ivoire", "collation", 0),
        "Germanyy": ("Germany", "edits", 1), "Germny": (None, None, None),
        "Untied States": ("United States", "edits", 2), "Xx": (None, None, None), "": (None, None, None)}
    empty = spark.createDataFrame([], "country string")
    assert reconcile(empty, empty, "country", "country").collect() == []
