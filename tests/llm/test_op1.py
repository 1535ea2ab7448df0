import hashlib

from pyspark.sql import functions as F

from tidemark.llm import op1_order_minhash as op


def _brute(rows):
    """(n_chars, sha256 of the edited text) by the contract."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def _likeness(a, b):
    x, y = ([s[k:k + 8] for k in range(0, len(s), 8)] for s in (a, b))
    if not x or not y:
        return float(x == y)
    return sum(p == q for p, q in zip(x, y)) / len(x)


def test_edits_and_likeness(spark, edge, small):
    for docs in (edge, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = op.compare_with_edits(docs).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == _brute(rows)
        texts = {}
        for r in got:
            assert abs(r["near_edited"] - _likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-9
            assert 0 <= r["near_next"] <= 1
            texts.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        same = {}
        for i, t in rows:
            if i is not None and len(texts[i]) == 1:
                same.setdefault(t or "", set()).update(texts[i])
        assert all(len(v) == 1 for v in same.values())
    long_enough = [r for r in got if r["n_chars"] > 1000]
    assert sum(r["near_edited"] > r["near_next"] for r in long_enough) > 0.8 * len(long_enough)


def test_next_fingerprint(spark, small):
    got = sorted(op.compare_with_edits(small).collect(), key=lambda r: r["doc_id"])
    for a, b in zip(got, got[1:] + got[:1]):
        assert abs(a["near_next"] - _likeness(a["fingerprint"], b["fingerprint"])) < 1e-9


def test_empty_and_single(spark, empty):
    assert op.compare_with_edits(empty).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    (r,) = op.compare_with_edits(one).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == 11


def _print(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {r["k"]: r["f"] for r in op.fingerprints(df, ["k"], "text", "f").collect()}
    return [found.get(k) for k in range(len(texts))]


def test_order_and_repeats_count(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    moved = " ".join(words[200:] + words[:200])
    a, b, c, none = _print(spark, text, moved, text, " ")
    assert a == c and none is None
    # moved halves keep the k-mers (a MinHash of them stays) but not their order
    share = sum(x == y for x, y in zip(a, b)) / len(a)
    assert 0.1 < share < 0.9
    once, twice = _print(spark, "a b c d", "a b c d a b c d")
    assert once != twice


def test_successors(spark):
    keys = [5, -3, 9, 1 << 50, 0]
    got = {r["k"]: r["s"] for r in op.successors(
        spark.createDataFrame([(k,) for k in keys], "k long"), "k", "s").collect()}
    order = sorted(keys)
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_no_python_in_plan(spark, small):
    plan = op.fingerprints(small.withColumn("k", F.col("doc_id")), ["k"], "text", "f") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _plain_order_minhash(text, slots=400, k=3):
    """The l = 2 smallest occurrence-numbered k-mers of one order, in text order."""
    from collections import Counter
    words, seen, kmers = text.split(), Counter(), []
    for i in range(max(len(words) - k + 1, 1)):
        kmer = tuple(words[i:i + k])
        seen[kmer] += 1
        kmers.append(repr((kmer, seen[kmer])).encode())
    out = []
    for s in range(slots):
        ranked = sorted(range(len(kmers)), key=lambda i: hashlib.blake2b(
            kmers[i], digest_size=8, salt=s.to_bytes(4, "big")).digest())
        out.append(tuple(kmers[i] for i in sorted(ranked[:2])))
    return out


def test_as_sensitive_as_plain_order_minhash(spark):
    """Substituted, deleted and moved text: the likeness of the pairs of two orders
    is that of the two smallest k-mers of one order, in the mean over texts."""
    import random
    rng = random.Random(6)
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(10)]

    def changed(words, share):
        return [f"x{rng.random()}" if rng.random() < share else w for w in words]

    kinds = {"same": lambda w: w, "substituted 2%": lambda w: changed(w, 0.02),
             "substituted 8%": lambda w: changed(w, 0.08), "halves swapped": lambda w: w[75:] + w[:75],
             "quarters reversed": lambda w: w[110:] + w[75:110] + w[35:75] + w[:35],
             "tail deleted": lambda w: w[:110], "repeated": lambda w: w + w}
    ours, plain = {}, {}
    for name, change in kinds.items():
        texts = [" ".join(w) for w in base] + [" ".join(change(w)) for w in base]
        got = _print(spark, *texts)
        near = [sum(x == y for x, y in zip(got[i], got[i + 10])) / op.SLOTS for i in range(10)]
        ours[name] = sum(near) / 10
        both = [(_plain_order_minhash(texts[i]), _plain_order_minhash(texts[i + 10])) for i in range(3)]
        plain[name] = sum(sum(x == y for x, y in zip(a, b)) / len(a) for a, b in both) / 3
    assert ours["same"] == plain["same"] == 1
    for name in kinds:
        assert abs(ours[name] - plain[name]) < 0.12, (name, ours, plain)
    # the same k-mers in another order: MinHash would say 1
    assert ours["halves swapped"] < 0.75 and ours["quarters reversed"] < ours["halves swapped"]
