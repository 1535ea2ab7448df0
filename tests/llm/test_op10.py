import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import op10_repeats as op


def brute(rows):
    """The contract, window by window."""
    least = {}
    keyed = [(op.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in keyed:
        for k in range(len(b) - op.WINDOW + 1):
            w = b[k:k + op.WINDOW]
            least[w] = min(least.get(w, i), i)
    out = []
    for (i, b), (doc_id, _) in zip(keyed, rows):
        gone = bytearray(len(b))
        for k in range(len(b) - op.WINDOW + 1):
            if least[b[k:k + op.WINDOW]] < i:
                gone[k:k + op.WINDOW] = b"\x01" * op.WINDOW
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in op.cut(docs).collect()), key=str)
    assert got == brute(rows)
    return got


def test_edges(edge, empty):
    assert sum(r[2] for r in _check(edge)) > 0
    assert op.cut(empty).count() == 0


def test_tables(small):
    _check(small)


def _corpus(seed):
    """Passages of all lengths around the window, in changing surroundings."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (30, 49, 50, 51, 60, 90, 200, 400)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choice("xyz \n") for _ in range(rng.randint(0, 60))))
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts.append(p[cut:] if rng.random() < .5 else p[:len(p) - cut])
        rows.append((rng.randint(0, 40), "".join(parts) + "ab" * rng.choice((0, 40))))
    return rows


def test_many_buckets_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(op, "FLUSH_BYTES", 2_000)
    monkeypatch.setattr(op, "BLOCK_BYTES", 700)
    for seed in range(2):
        docs = spark.createDataFrame(_corpus(seed), "doc_id long, text string").repartition(3)
        _check(docs)


def test_shuffled_result(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_BYTES", -1)
    _check(spark.createDataFrame(_corpus(9), "doc_id long, text string").repartition(3))


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "p" * 20 + "q" * 60), (2, "é" + "q" * 60 + "z")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in op.cut(docs, kept_text=True).collect()}
    assert got == {1: "p" * 20 + "q" * 60, 2: "éz"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=150), min_size=1, max_size=6))
def test_parse_covers_every_window_once(texts):
    raw = [t.encode() for t in texts]
    own, start, count, trigger, key, run, at, data = op.parse(raw)
    seen = sorted((int(o), int(s) + j) for o, s, c, r in zip(own, start, count, run) for j in range(c * r))
    assert seen == [(k, j) for k, b in enumerate(raw) for j in range(len(b) - op.WINDOW + 1)]
    for o, s, c, r, a in zip(own, start, count, run, at):
        n = c + op.WINDOW - 1
        for place in range(int(s), int(s) + int(c) * int(r), int(c)):
            assert data[a:a + n].tobytes() == raw[o][place:place + n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab", min_size=50, max_size=70)), min_size=1, max_size=8))
def test_suffix_array_against_dictionary(rows):
    data = np.frombuffer(b"".join(t.encode() for _, t in rows), np.uint8)
    at, order, base = [], [], 0
    for i, t in rows:
        at += [base + k for k in range(len(t) - 49)]
        order += [i] * (len(t) - 49)
        base += len(t)
    at, order = np.array(at), np.array(order)
    least = {}
    for a, o in zip(at, order):
        w = data[a:a + 50].tobytes()
        least[w] = min(least.get(w, o), o)
    assert op.repeated(data, at, order).tolist() == [least[data[a:a + 50].tobytes()] < o for a, o in zip(at, order)]


def _run_texts(seed):
    """Runs of one byte and of short periods, in and between other text."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("pqrs") for _ in range(n))
    periods = ["=", "ab", "-=-", word(13), word(39), word(40), word(55)]
    rows = []
    for k in range(40):
        p = rng.choice(periods)
        rows.append((rng.randint(0, 30), word(rng.randint(0, 70)) + p * rng.randint(1, 300 // len(p) + 3)
                     + word(rng.randint(0, 70)) + rng.choice(["", "=" * rng.randint(40, 200)])))
    return rows


def test_runs_and_periods(spark):
    for seed in range(3):
        _check(spark.createDataFrame(_run_texts(seed), "doc_id long, text string").repartition(3))


def test_runs_are_one_phrase():
    """A run of 3 MB is a few phrases, not one for each byte."""
    own, start, count, trigger, key, run, at, data = op.parse([b"head " * 30 + b"=" * 3_000_000 + b" tail" * 30])
    assert len(own) < 200 and run.max() > 900_000
    blob = op._flush(np.array([7, 8]), np.array([1, 2]), [b"=" * 3_000_000, b"x" * 60], 4, 2, {})
    assert sum(len(b.as_py()) for b in blob["blob"]) < 10_000


def test_long_run_is_cut(spark):
    long = "=" * 3_000_000
    docs = spark.createDataFrame([(1, "a" + long), (2, long + "b"), (3, "=" * 49), (4, "c" + "=" * 50)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in op.cut(docs).collect()}
    assert got == {1: (3_000_001, 0, 0), 2: (3_000_001, 3_000_000, 1), 3: (49, 0, 0), 4: (51, 50, 1)}


def test_hot_triggers_are_dealt_by_window(spark, monkeypatch):
    """One gram in changing surroundings, in a third of all documents."""
    monkeypatch.setattr(op, "BUCKET_BYTES", 1_500)
    monkeypatch.setattr(op, "SAMPLE", 1)
    monkeypatch.setattr(op, "FLUSH_BYTES", 3_000)
    rng = random.Random(4)
    gram = "".join(rng.choice("mnop") for _ in range(op.GRAM))
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = _corpus(3) + _run_texts(8)
    tails = [word(60) for _ in range(4)]
    for k in range(80):
        rows.append((rng.randint(0, 50), word(rng.randint(0, 60)) + gram + rng.choice(tails)[:rng.randint(20, 60)] + gram))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    hot = op.hot_triggers(keyed)
    assert hot and max(hot.values()) > 1
    _check(docs)
