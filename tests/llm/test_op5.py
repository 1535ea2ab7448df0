import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import op5_surrogates as op

SCHEMA = "doc_id long, text string"


def _texts(spark, *texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r["text"] for r in op.replace(df, key).orderBy("doc_id").collect()]


def test_layouts_and_types(spark):
    a, b, c, d, e = _texts(
        spark, "Call +1 (017) 555-7713 or 017-555-7713, card 4539 1488 0343 6467.",
        "mail Ann.Lee@mail5.example.com and ann.lee@mail5.example.com; host 10.0.0.7, 8.8.4.4",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and ssn 123-45-6789',
        "IBAN DE89 3704 0044 0532 0130 00 paid",
        "plain text, 12 apples, version 3.14, 2024-01-02")
    assert re.fullmatch(r"Call \+\d \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, "
                        r"card 4\d{3} \d{4} \d{4} \d{4}\.", a)
    assert "7713" not in a and "6467" not in a
    card = re.sub(" ", "", re.search(r"card ([\d ]+)\.", a)[1])
    assert sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10))
               for k, x in enumerate(reversed(card))) % 10 == 0
    mails = re.findall(r"\S+@\S+", b)
    assert [m.rstrip(";").lower() for m in mails][0] == mails[1].rstrip(";").lower()
    assert mails[1].endswith(".com;") and "example" not in b and "ann" not in b.lower()
    assert re.search(r"host 10\.\d+\.\d+\.\d+, \d+\.\d+\.\d+\.\d+$", b) and "8.8.4.4" not in b
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and ssn \d{3}-\d{2}-\d{4}', c) and "04dbeb" not in c
    iban = re.search("DE[0-9 ]+", d)[0].strip().replace(" ", "")
    assert len(iban) == 22 and "3704" not in d
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert e == "plain text, 12 apples, version 3.14, 2024-01-02"


def test_names_keep_gender_script_and_coreference(spark):
    a, b, c = _texts(spark, "Mrs. Ada Hill met Mr. Ada Hill.", "Then Ms. Hill and Mr. HILL left.",
                     "Госпожа Анна Петрова пришла")
    first = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)\.", a)
    second = re.fullmatch(r"Then Ms\. (\w+) and Mr\. (\w+) left\.", b)
    assert first[2] == first[4] == second[1] and second[2] == second[1].upper()
    assert first[1] in op.GIVEN["Latin", "f"].split() and first[3] in op.GIVEN["Latin", "m"].split()
    assert "Hill" not in a + b
    assert re.fullmatch(r"Госпожа [А-Яа-я]+ [А-Яа-я]+ пришла", c) and "Петрова" not in c
    assert c.split()[1] in op.GIVEN["Cyrillic", "f"].split()


def test_consistent_and_distinct_over_the_corpus(spark):
    ips = [f"{a}.{b}.3.4" for a in range(20, 30) for b in range(40)]
    texts = [f"from {ip} to {ips[0]}" for ip in ips]
    got = _texts(spark, *texts)
    pairs = [re.findall(r"\d+\.\d+\.\d+\.\d+", t) for t in got]
    assert len({p[1] for p in pairs}) == 1 and pairs[0][0] == pairs[0][1]
    assert len({p[0] for p in pairs}) == len(ips)
    assert not {p[0] for p in pairs} & set(ips)
    assert _texts(spark, *texts) == got != _texts(spark, *texts, key="other")


def test_collisions_are_drawn_again(spark):
    """More given names than there are to draw from: all stay distinct."""
    names = ["N" + "".join(chr(97 + int(d)) for d in str(k)) + "x" for k in range(60)]
    got = _texts(spark, *(f"Mr. {n} Same" for n in names))
    given = [t.split()[1] for t in got]
    assert len(set(given)) == len(names) and len({t.split()[2] for t in got}) == 1


def test_edges(edge, empty):
    before = {(r["doc_id"], r["text"]) for r in edge.collect()}
    after = op.replace(edge, "k", count="hits")
    assert after.columns == edge.columns + ["hits"] and after.count() == edge.count()
    assert {(r["doc_id"], r["text"]) for r in after.filter("hits = 0").collect()} <= before
    assert op.replace(empty, "k").count() == 0
    assert op.replace(edge.filter("text is null"), "k").count() == 2


def test_long_runs_do_not_blow_up(spark):
    (a,) = _texts(spark, "a" * 200_000 + " 1 " + "1.2." * 20_000 + " me@x.org")
    assert "me@x.org" not in a


def test_clean_documents_stay(spark, small):
    personal = r"\S+@\S+|\d{16}|\d+\.\d+\.\d+\.\d+|555-|[0-9a-f]{40}"
    got = op.replace(small, "k").select("doc_id", F.col("text").alias("new"), "n_chars")
    rows = small.select("doc_id", "text").join(got, "doc_id").collect()
    for r in rows:
        found = re.findall(personal, r["text"])
        assert (r["text"] == r["new"]) == (not found)
        assert not [f for f in found if f != "555-" and f in r["new"]]
        assert len(r["text"].split(" ")) == len(r["new"].split(" "))


@pytest.mark.parametrize("text", ["", None])
def test_nothing_to_do(spark, text):
    assert _texts(spark, text) == [text]


def test_secrets_in_any_case_and_length(spark):
    low = "9233a8ec04dbebab91ab85687d33eeaaf9ac699e"
    long = "eyJh.Zz9-_" * 30
    a, b, c, d, e, f, g = _texts(
        spark, f'token = "{low}" 1', f'TOKEN = "{low.upper()}" and {low.upper()} 1', f'Secret: "{long}" 1',
        '{"password": "Correct-Horse1", \'api_key\' : \'it"s-me-77\', "password":"x"} 1', "ab" * 150 + " 1",
        "key sk-" + "aB3" * 100 + " and SK-" + "AB3" * 100, "AB" * 10 + " 12 token = 'the'")
    new = re.fullmatch('token = "([0-9a-f]{40})" 1', a)[1]
    assert new != low and b == f'TOKEN = "{new.upper()}" and {new.upper()} 1'
    assert re.fullmatch(r'Secret: "[a-z0-9A-Z._-]{300}" 1', c) and "eyJh" not in c
    got = re.fullmatch(r'{"password": "([^"]+)", \'api_key\' : \'([^\']+)\', "password":"([^"]+)"} 1', d)
    assert "orrect" not in d and "s-me-77" not in d and got[3] != "x"
    assert re.fullmatch("[A-Z][a-z]{6}-[A-Z][a-z]{4}[0-9]", got[1])
    assert re.fullmatch("[0-9a-f]{300} 1", e) and "abab" not in e
    x, y = re.fullmatch("key (\\S+) and (\\S+)", f).groups()
    assert len(x) == 303 and x.upper() == y and "aB3aB3" not in f
    assert g == "AB" * 10 + " 12 token = 'the'"


def test_texts_without_digits(spark):
    quoted, *keys = _texts(spark, "set password = 'correct-horse' now", "use sk-" + "aBcD" * 6, "ghp_" + "xYz" * 12,
                           "AKIA" + "QWERTYUI" * 2, "sum " + "abcdefab" * 4, 'the "Token": "some-thing"')
    assert re.fullmatch("set password = '[a-z]{7}-[a-z]{5}' now", quoted) and "correct" not in quoted
    assert not [t for t, old in zip(keys, ("aBcD", "xYz", "QWERTY", "abcdefab", "some-thing")) if old in t]


def test_private_addresses_leave_a_full_block(spark):
    """Else a block with more addresses than there are to draw never ends."""
    entities = spark.createDataFrame([("ip", f"192.168.7.{k}") for k in range(20)], "kind string, canon string")
    for attempt, stays in ((0, True), (op.BLOCK_DRAWS, False)):
        drawn = op._seeded(entities, "k", attempt).select(op._surrogate(attempt).alias("s")).collect()
        assert all(r["s"].startswith("192.168.") == stays for r in drawn)
