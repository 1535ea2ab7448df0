import random
import re

from tidemark.llm import op6_decontamination as op

ITEM = "item_id long, text string"


def _words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def _run(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    return {r["doc_id"]: r for r in op.report(docs, bench).collect()}


def test_substitutions_and_parts(spark):
    item = _words(40, 1)
    noise = _words(200, 2)

    def inside(part):
        return " ".join(noise[:90] + part + noise[90:])
    swapped = [w if k % 9 else f"other{k}" for k, w in enumerate(item)]
    shifted = item[:20] + ["inserted"] + item[20:]
    got = _run(spark, [inside(item), inside(swapped), inside(shifted), inside(item[:16]),
                       inside(item[:8]), " ".join(noise), inside(list(reversed(item))),
                       " ".join(item).upper() + "!", None, "", "one"],
               [" ".join(item), " ".join(_words(30, 3)), "too short", None])
    hit = [k for k in sorted(got) if got[k]["contaminated"]]
    assert hit == [0, 1, 2, 3, 7]
    assert [tuple(x) for x in got[0]["ranges"]] == [(90, 40, 0)] and got[0]["matches"] == 40
    assert got[1]["matches"] == sum(k % 9 != 0 for k in range(40))
    assert {tuple(x) for x in got[2]["ranges"]} == {(90, 20, 0), (111, 20, 0)}


def test_short_item_needs_most_of_it(spark):
    item = _words(13, 5)
    got = _run(spark, [" ".join(item), " ".join(item[:11] + ["x", "y"]), " ".join(item[:6])],
               [" ".join(item)])
    assert [got[k]["contaminated"] for k in range(3)] == [True, True, False]


def test_shuffle_join_gives_the_same(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    a = sorted(map(tuple, op.overlaps(small, bench).collect()))
    assert a == sorted(map(tuple, op.overlaps(small, bench, broadcast_bytes=-1).collect())) and a


def test_exact_passages_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r["text"] for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in r["text"] for i in items)}
    got = {r["doc_id"] for r in op.report(docs, bench).filter("contaminated").collect()}
    assert got == want
    kept = op.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == want


def test_against_brute_force(spark):
    """Every stretch around every seed hit, token by token."""
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(9, 30))] for _ in range(6)]
    texts = []
    for k in range(30):
        part = list(rng.choice(items))
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        texts.append([rng.choice(vocabulary) for _ in range(20)] + part[rng.randrange(4):]
                     + [rng.choice(vocabulary) for _ in range(10)])

    def grow(same):
        score = best = length = equal = hits = 0
        for n, s in enumerate(same, 1):
            score += 1 if s else -op.PENALTY
            hits += s
            if score > best:
                best, length, equal = score, n, hits
        return length, equal
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            for at in range(len(t) - op.SPAN + 1):
                for p in range(len(item) - op.SPAN + 1):
                    if any(all(t[at + k] == item[p + k] for k, m in enumerate(mask) if m == "1")
                           for mask in op.MASKS):
                        first = at - p
                        lo, hi = max(0, -first), min(len(item), len(t) - first)
                        same = [t[first + q] == item[q] for q in range(lo, hi)]
                        r, re_ = grow(same[p - lo:])
                        left, le = grow(same[:p - lo][::-1])
                        if re_ + le >= min(13, -(-len(item) * 4 // 5)):
                            want.add((d, i, at - left, left + r, re_ + le))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], ITEM)
    got = {(r["doc_id"], r["item_id"], r["start"], r["length"], r["matches"])
           for r in op.overlaps(docs, bench).collect()}
    assert got == want and want


def test_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, edge.filter("doc_id = 9 or doc_id = 2").collect()[0]["text"])], ITEM)
    got = {r["doc_id"]: r["contaminated"] for r in op.report(edge, bench).collect()}
    assert got[1] and got[2] and not got[3] and not got[None]
    kept = op.clean(edge, bench)
    assert kept.columns == edge.columns and not {1, 2} & {r["doc_id"] for r in kept.collect()}
    assert None in {r["doc_id"] for r in kept.collect()}
    none = spark.createDataFrame([], ITEM)
    assert op.clean(edge, none).count() == edge.count()
    assert op.report(empty, bench).count() == 0 and op.clean(empty, bench).count() == 0


def test_masks():
    assert all(len(m) == op.SPAN and m[0] == m[-1] == "1" for m in op.MASKS)
    assert len({m.count("1") for m in op.MASKS}) == 1
    assert re.fullmatch("[01]+", "".join(op.MASKS))


def test_short_items_with_substitutions_at_all_places(spark):
    """Each choice of as many substitutions as 0.8 allows, and one more."""
    from itertools import combinations
    items = [_words(n, 100 + n) for n in (1, 4, 9, 10, 15, 20, 24)]
    texts, want = [], []
    for k, item in enumerate(items):
        allowed = len(item) // 5
        rng = random.Random(k)
        every = list(combinations(range(len(item)), allowed))
        for places in every if len(every) < 500 else rng.sample(every, 500):
            part = [f"x{p}" if p in places else w for p, w in enumerate(item)]
            texts.append(["pre"] * rng.randint(0, 30) + part + ["post"] * rng.randint(0, 3))
            want.append({k})
        less = [f"x{p}" if p % 3 == 0 else w for p, w in enumerate(item)]
        texts.append(less)
        want.append(set())
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").cache()
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], ITEM)
    got = [set() for _ in texts]
    for r in op.report(docs, bench, min_item_tokens=1).collect():
        got[r["doc_id"]] = {x["item_id"] for x in r["ranges"]}
    assert got == want
    a = sorted(map(tuple, op.windows(docs, bench, 1).collect()))
    assert a == sorted(map(tuple, op.windows(docs, bench, 1, broadcast_bytes=-1).collect())) and a


def test_items_of_few_tokens(spark):
    """They count where they are the whole text, and nowhere else."""
    items = ["Yes", "of the", "the end of day", "one two three four five six seven eight"]
    texts = ["yes!", "Yes, of course", "the end of the day", "Of the.", "the end of day", "the end of night",
             "say one two three four five six seven eight now", "of", "x one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    for options in ({}, {"broadcast_bytes": -1}):
        got = {r["doc_id"]: [x["item_id"] for x in r["ranges"]] for r in op.report(docs, bench, **options).collect()}
        assert got == {0: [0], 1: [], 2: [], 3: [1], 4: [2], 5: [], 6: [3], 7: [], 8: [3]}


def test_recall_by_length_and_substitutions(spark):
    """Items of 25 to 100 tokens with 5 to 20 % of the tokens substituted anywhere."""
    rng = random.Random(11)
    items, texts, group = [], [], []
    for n in (25, 30, 31, 40, 60, 100):
        for share in (0.05, 0.1, 0.2):
            for k in range(60):
                item = _words(n, len(items) + 5000)
                gone = set(rng.sample(range(n), int(n * share)))
                part = [f"x{p}" if p in gone else w for p, w in enumerate(item)]
                items.append(" ".join(item))
                texts.append(" ".join(["pre"] * rng.randint(0, 20) + part + ["post"] * rng.randint(0, 20)))
                group.append((n, share))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    found = {r["doc_id"] for r in op.report(docs, bench).filter("contaminated").collect()}
    for g in set(group):
        mine = [k in found for k, x in enumerate(group) if x == g]
        assert sum(mine) >= 0.95 * len(mine), (g, sum(mine), len(mine))
    clean = spark.createDataFrame([(k, " ".join(_words(80, 90_000 + k))) for k in range(100)], "doc_id long, text string")
    assert op.report(clean, bench).filter("contaminated").count() == 0
