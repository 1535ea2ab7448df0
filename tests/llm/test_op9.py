import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import op9_language as op
from tidemark.llm import queries
from tidemark.llm.common import fold

SF = "/root/testdata/sf0.01"


def _phrases(text, training):
    """Greedy cross-parsing by search."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in training:
            n += 1
        count, at = count + 1, at + n
    return count


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc", min_size=1, max_size=40))
def test_phrases_against_search(text, training):
    model = op.CrossParser.fit({"x": [training], "y": ["cab"]}, 1000, 10)
    text = op.normalised(text)
    got, letters = model.phrases([text], model.symbols())
    assert letters[0] == sum(c.isalpha() for c in text)
    assert got[0, 0] == _phrases(text, op.normalised(training))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_cross_parsing(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_wrong_labels_are_left_out(spark, small):
    """A fifth of the labels is wrong: the texts still decide."""
    from pyspark.sql import functions as F
    noisy = small.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "de").otherwise(F.col("lang")))
    model = op.fit(noisy.filter(fold("doc_id", 4) != 2))
    rows = op.identify(small, model).join(small.select("doc_id", "lang", "n_chars"), "doc_id") \
        .filter("n_chars > 100").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_edges(spark, edge, empty):
    model = op.fit(edge)
    got = op.identify(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r["lang_pred"])
    assert by[3] == by[4] == by[5] == by[12] == "und" and by[1] in ("en", "de")
    assert by[10] in ("en", "de")       # letters of no language
    none = op.fit(empty)
    assert {r["lang_pred"] for r in op.identify(edge, none).collect()} == {"und"}
    assert op.identify(empty, model).count() == 0


def test_lanes_and_blocks_do_not_matter_much(monkeypatch):
    text = "der die das und ein haus " * 400
    model = op.CrossParser.fit({"de": ["der die das und ein haus im wald"], "en": ["the house of the wood"]}, 1000, 30)
    assert model.predict([text], model.symbols())[0] == ["de"]
    monkeypatch.setattr(op, "LANE", 16)
    monkeypatch.setattr(op, "BLOCK", 100)
    assert model.predict([text, "", "the"], model.symbols())[0] == ["de", "und", "en"]


def test_scripts_side_by_side():
    """Rarer scripts keep their letters beside frequent ones, and a script of many
    letters is not a language for everything unknown."""
    import random
    rng = random.Random(2)
    latin, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщыэюя"
    han = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))

    def speaker(letters, seed):
        own = random.Random(seed)
        words = ["".join(own.choice(letters) for _ in range(own.randint(2, 6))) for _ in range(120)]
        return lambda n: " ".join(rng.choice(words) for _ in range(n))

    says = {f"{name}{k}": speaker(letters, f"{name}{k}") for name, letters in
            (("latin", latin), ("greek", greek), ("cyrillic", cyrillic), ("han", han)) for k in (1, 2)}
    # the Latin languages have fifty times as much text
    texts = {name: [say(3000 if name.startswith("latin") else 400)] for name, say in says.items()}
    model = op.CrossParser.fit(texts, 24_000, 60)
    for name, say in says.items():
        said, score = model.predict([say(40) for _ in range(20)], model.symbols())
        assert said == [name] * 20
    assert model.predict(["ქართული ენა"], model.symbols())[1][0] <= 1     # letters of none


def test_wide_tables(monkeypatch):
    """Tables of 8 bytes give the same phrases."""
    texts = {"x": ["abcab cab"], "y": ["bbb cc"]}
    narrow = op.CrossParser.fit(texts, 1000, 10)
    monkeypatch.setattr(op, "COUNT", 4)
    wide = op.CrossParser.fit(texts, 1000, 10)
    assert wide.tables.dtype == np.int64 and wide.shift == op.WIDE and narrow.tables.dtype == np.int32
    found = ["abc cab bb", "zzz", "ccc b"]
    assert (narrow.phrases(found, narrow.symbols())[0] == wide.phrases(found, wide.symbols())[0]).all()


def test_training_does_not_hang_on_beginnings(spark):
    """All documents begin with one long English head; the languages differ after it."""
    head = "this is the common head of every page and it goes on and on " * 20
    rows = [(i, head + ("der wald und das haus stehen im regen " if i % 2 else "le bois et la maison sont sous la pluie ") * 60,
             "de" if i % 2 else "fr") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op.fit(docs)
    assert model.predict(["der wald im regen", "la maison et le bois"], model.symbols())[0] == ["de", "fr"]
