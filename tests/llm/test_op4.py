import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import op4_jaccard_join as op

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Component of each row (by position) from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for other, n in Counter(o for g in s for o in lists[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                parent[find(k)] = find(other)
        for g in s:
            lists[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i)
                   for k, (i, _) in enumerate(rows)), key=str)


def _check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in op.join(docs).collect()), key=str)
    assert got == brute(rows)


def test_against_all_pairs(edge, small):
    _check(edge)
    _check(small)


def _family(n, words, changes, seed=0):
    """Near copies of a text, each with other words changed."""
    import random
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        mine = list(base)
        for c in range(changes):
            mine[rng.randrange(words)] = f"x{k}.{c}"
        out.append(" ".join(mine))
    return out


def test_chains_stars_and_shared_passages(spark, monkeypatch):
    """Families at the edge of the threshold, passages that many share, and few
    frequent shingles, so that both steps and the order of lists matter."""
    monkeypatch.setattr(op, "FREQUENT", 3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = _family(60, 100, 1) + _family(40, 60, 2, 1) + _family(25, 80, 3, 2)
    texts += [f"{passage} " + " ".join(f"u{k}.{i}" for i in range(60)) for k in range(40)]
    texts += [f"{passage} tail{k}" for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    _check(docs)


def test_splitting_lists_does_not_lose_links(spark, monkeypatch):
    monkeypatch.setattr(op, "FREQUENT", 2)
    monkeypatch.setattr(op, "SPLIT", 5)
    docs = spark.createDataFrame(list(enumerate(_family(60, 100, 2))), "doc_id long, text string")
    _check(docs.repartition(3))


def test_one_of_each(edge, small):
    for docs in (edge, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept = op.one_of_each(docs)
        assert kept.columns == docs.columns
        left = [(r["doc_id"], r["text"]) for r in kept.collect()]
        want = brute(rows)
        wordless = sum(n == 0 for _, n, _ in want)
        groups = {c for _, n, c in want if n}
        assert len(left) == len(groups) + wordless
        assert sorted(map(str, left)) == sorted(map(str, brute_rows(left)))


def brute_rows(rows):
    """Rows of which no two link."""
    seen = {c for _, n, c in brute(rows) if n}
    assert len(seen) == sum(n > 0 for _, n, _ in brute(rows))
    return rows


def test_empty(empty):
    assert op.join(empty).count() == 0 and op.one_of_each(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 100, 101])
def test_short_lists(n):
    least = -(-80 * n // 100)
    assert op.short(n) == n - least + 1


def test_components_without_an_id_of_their_own(spark):
    """Unrelated texts with a null id or under one id all stay."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcd")
    rows = [(None, a), (None, b), (None, b.upper()), (5, c), (5, d), (7, d), (8, c)]
    kept = op.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = [(r["doc_id"], r["text"].lower()) for r in kept]
    assert sorted(left, key=str) == sorted([(None, a), (None, b), (5, c), (5, d)], key=str)


def _numpy_components(texts):
    """Components of rows by all pairs, with a matrix product."""
    import numpy as np
    sets = [shingle_set(t) for t in texts]
    number = {}
    for s in sets:
        for g in s:
            number.setdefault(g, len(number))
    a = np.zeros((len(sets), len(number)), np.float32)
    for k, s in enumerate(sets):
        a[k, [number[g] for g in s]] = 1
    both = np.rint(a @ a.T).astype(np.int64)
    n = a.sum(1).astype(np.int64)
    linked = 100 * both >= 80 * (n[:, None] + n[None] - both)
    least = np.arange(len(sets))
    while True:
        new = np.where(linked, least[None, :], len(sets)).min(1)
        if (new == least).all():
            return least.tolist(), float(np.median((both / (n[:, None] + n[None] - both))[~np.eye(len(n), dtype=bool)]))
        least = new


@pytest.mark.parametrize("changes,low,high", [(5, 0.48, 0.6), (2, 0.74, 0.84)])
def test_large_families(spark, changes, low, high):
    """2,000 near copies whose similarities lie around a half, or around the
    threshold: every component is found."""
    texts = _family(2000, 160, changes, seed=changes)
    want, median = _numpy_components(texts)
    assert low < median < high
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in op.join(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_occurrences_against_counting():
    """Whoever occurs often enough is found with the right count, wherever the
    cut between merged and probed lists falls."""
    import numpy as np
    rng = np.random.default_rng(7)
    for trial in range(40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(rng.integers(1, 30))]
        n = np.array([len(s) for s in sets])
        root = rng.integers(0, 6, len(sets))
        at = np.concatenate([[0], np.cumsum(n)])
        index = op.Index(n, root, np.concatenate(sets).astype(np.int64), at)
        assert (index.n == np.sort(n)).all()
        query = np.unique(rng.integers(0, 70, 30)).astype(np.int64)
        for least in (1, 2, 5, 12):
            lists = index.lists(query)
            low, high = sorted(rng.integers(0, len(sets) + 1, 2).tolist())
            found, count = index.occurrences(lists, least, low, high, 3)
            got = {int(f): int(c) for f, c in zip(found, count) if c >= least}
            want = {}
            for place, k in enumerate(index.order):
                c = len(np.intersect1d(sets[k], query))
                if c >= least and low <= place < high and root[k] != 3:
                    want[place] = c
            assert got == want


def test_word_hashes():
    """Words are told apart and found alike in any surroundings and pieces."""
    import random
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ab", "c", "Über", "x" * rng.randint(1, 9), "q1"])
                      for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += [None, "", " \t\n", "a", "a b", "\x0bA\x0c b", "x" * (op.PIECE + 5) + " y z w v u t", "foo bar baz " * 200_000]
    classes, words = {}, {}
    for t, (cls, grams) in zip(texts, op.shingled(texts)):
        found = tuple(WORD.findall((t or "").translate(LOW)))
        assert len(grams) == len(shingle_set(t)) and (grams[1:] > grams[:-1]).all()
        assert classes.setdefault(found, cls) == cls
        (alone, same), = op.shingled([t])
        assert alone == cls and (same == grams).all()
        hashes, begins = op.word_hashes([t])
        assert len(hashes) == len(found) == begins[-1]
        for w, h in zip(found, hashes.tolist()):
            assert words.setdefault(w, h) == h
    assert len(set(classes.values())) == len(classes) and len(set(words.values())) == len(words)
