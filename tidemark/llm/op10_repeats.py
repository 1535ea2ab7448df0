"""Removal of repeated passages by prefix-free parsing.

Texts are UTF-8 bytes.  A byte goes if it lies in a string of ``WINDOW`` bytes
that also starts in a document with a smaller doc_id; strings are judged on the
input.

*Parse.*  A rolling hash over ``GRAM`` bytes picks triggers: each window's trigger
is the gram with the smallest hash in it.  The windows that share a trigger
form a phrase, so equal windows lie in phrases with equal triggers, whatever
stands around them, and no window is cut by a phrase end (phrases overlap by
``WINDOW - 1`` bytes).  Of phrases that are equal as a whole only those of the
smallest document enter the dictionary; in highly repetitive text that is most
of them, and the rest of the work never sees them.

*Dictionary.*  Phrases are dealt into buckets by their trigger.  A bucket builds
the suffix array of its phrases: windows are sorted by their first 8 bytes, then
tied ones by 5 more at a time, until ``WINDOW`` bytes are compared; ties that lie
in one document only are left early.  The parse adds what the dictionary does not
know: the order of the documents, hence the smallest document of each tie.

*Result.*  Removed stretches go back to their documents, are united, and cut out.

Buckets have about ``BUCKET_BYTES`` bytes of phrases, so their number grows with
the corpus and no task does.  A trigger that alone would fill a bucket
(``hot_triggers``) is dealt by the hash of each window, so that equal windows still
meet.  A run of one byte, or of a short period, in a document is one phrase with a length
(``runs``).  A phrase that stands in a third of all documents is sent once for each
``FLUSH_BYTES`` bytes of text at most.  The text itself
is never shuffled while the stretches are small enough to broadcast
(``BROADCAST_BYTES``, checked), else it is joined with them by doc_id.

Null texts have no bytes; texts under ``WINDOW`` bytes stay whole.  Documents with
equal ids are not smaller than one another; a null id is larger than all
others.  Repeated rows are cut alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, written

WINDOW = 50
GRAM = 12
SPREAD = WINDOW - GRAM + 1          # grams in a window
BLOCK_BYTES = 2_000_000
FLUSH_BYTES = 16_000_000
BUCKET_BYTES = 6_000_000
BROADCAST_BYTES = 32_000_000
SAMPLE = 16                         # one row of so many tells hot triggers
NAMED = 1000
LAST = np.iinfo(np.int64).max       # stands for a null id

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 8 * WINDOW)
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate((one, np.full(size - 1, b, np.uint64))))
                      for b in (_BASE, _BASE_INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def phrases(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the texts ``data[first:last]``, which lie one after the other:
    text, start in data, windows, place of the trigger in the phrase, hash."""
    n = len(data)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data * power[:n], out=total[1:])
    gram = _mixed((total[GRAM:] - total[:-GRAM]) * inverse[:n - GRAM + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPREAD:
        least = np.minimum(least[:len(least) - (SPREAD - width)], least[SPREAD - width:])
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)     # of each window
    owner = np.full(len(trigger), -1, np.int32)
    for k in np.flatnonzero(last - first >= WINDOW):
        owner[first[k]:last[k] - WINDOW + 1] = k
    begin = np.flatnonzero(np.concatenate((
        [True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.concatenate((begin, [len(trigger)])))
    whole = owner[begin] >= 0
    begin, count = begin[whole], count[whole]
    length = count + WINDOW - 1
    key = _mixed((total[begin + length] - total[begin]) * inverse[begin]) + length.astype(np.uint64)
    return owner[begin], begin, count, trigger[begin] - begin, key


def runs(data: np.ndarray, own: np.ndarray, begin: np.ndarray, count: np.ndarray,
         trigger: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal phrases of a text one after the other, as in a run of one byte or of a
    short period: the first ones, and how many follow each other from there.  Their
    places are ``count`` bytes apart, less than a window, so what such a row loses at
    the first place and at all others is one stretch."""
    same = ((own[1:] == own[:-1]) & (count[1:] == count[:-1]) & (key[1:] == key[:-1])
            & (trigger[1:] == trigger[:-1]) & (begin[1:] == begin[:-1] + count[:-1]))
    maybe = np.flatnonzero(same)
    for some in np.array_split(maybe, len(maybe) // 50_000 + 1):    # equal hashes: compare the bytes
        length = count[some] + WINDOW - 1
        equal = _gather(data, begin[some], length) == _gather(data, begin[some + 1], length)
        same[some] = np.logical_and.reduceat(equal, np.cumsum(length) - length) if len(some) else True
    lead = np.flatnonzero(np.concatenate(([True], ~same))) if len(own) else np.arange(0)
    return lead, np.diff(np.append(lead, len(own)))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Texts in pieces of bounded size that overlap by a window less one byte:
    number, start, bytes."""
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), BLOCK_BYTES):
            yield k, at, text[at:at + BLOCK_BYTES + WINDOW - 1]


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Phrases of all ``texts``, equal neighbours once: text, start, windows,
    trigger, hash, how many follow each other, where the phrase's bytes begin, and the
    bytes (as one array)."""
    found: list[tuple[np.ndarray, ...]] = []
    blocks: list[np.ndarray] = []
    before = 0
    todo: list[tuple[int, int, bytes]] = []

    def block() -> None:
        nonlocal before
        sizes = np.array([len(t) for _, _, t in todo])
        data = np.frombuffer(b"".join(t for _, _, t in todo), np.uint8)
        if len(data) >= WINDOW:
            last = np.cumsum(sizes)
            first = last - sizes
            own, begin, count, trigger, key = phrases(data, first, last)
            lead, run = runs(data, own, begin, count, trigger, key)
            own, begin, count, trigger, key = (x[lead] for x in (own, begin, count, trigger, key))
            number = np.array([k for k, _, _ in todo], np.int64)
            start = np.array([at for _, at, _ in todo], np.int64)
            found.append((number[own], begin - first[own] + start[own], count, trigger, key,
                          run, begin + before))
            blocks.append(data)
            before += len(data)
        todo.clear()

    size = 0
    for piece in pieces(texts):
        if size + len(piece[2]) > BLOCK_BYTES + WINDOW and todo:
            block()
            size = 0
        todo.append(piece)
        size += len(piece[2])
    if todo:
        block()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none, none, np.zeros(0, np.uint8)
    return (*(np.concatenate(x) for x in zip(*found)), np.concatenate(blocks))


def _gather(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the stretches, one after the other."""
    last = np.cumsum(length)
    return data[np.repeat(at - (last - length), length) + np.arange(last[-1] if len(last) else 0)]


def later_copies(order: np.ndarray, key: np.ndarray, at: np.ndarray, length: np.ndarray,
                 data: np.ndarray) -> np.ndarray:
    """Which phrases equal one of a smaller document (``order``: its rank)."""
    by = np.lexsort((order, key))
    same = np.concatenate(([False], key[by][1:] == key[by][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    out = np.zeros(len(by), bool)
    later = np.flatnonzero(order[by] > order[by[head]])
    raw = data.tobytes()
    for i in later:         # equal hashes: compare the bytes
        a, b = by[i], by[head[i]]
        out[a] = (length[a] == length[b]
                  and raw[at[a]:at[a] + length[a]] == raw[at[b]:at[b] + length[b]])
    return out


def repeated(data: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the windows that start at ``at`` in ``data`` equal a window of a
    smaller ``order``: the suffix array, sorted to the depth of a window."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(len(data), np.uint64)          # the 8 bytes from each place on
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k:k + len(data)]
    out = np.zeros(len(at), bool)
    left = np.arange(len(at))
    group = np.zeros(len(at), np.uint64)
    depth = 0
    while len(left):
        if depth == 0:
            width, key = 8, word[at]
        else:
            width = min(5, WINDOW - depth)
            key = word[at[left] + depth] >> np.uint64(8 * (8 - width))
            if len(left) < 1 << 24:
                key |= group << np.uint64(40)
        if depth and len(left) >= 1 << 24:         # the tie's number needs a key of its own
            by = np.lexsort((key, group))
            fresh = (key[by][1:] != key[by][:-1]) | (group[by][1:] != group[by][:-1])
        else:
            by = np.argsort(key)
            fresh = key[by][1:] != key[by][:-1]
        left = left[by]
        depth += width
        head = np.flatnonzero(np.concatenate(([True], fresh)))
        size = np.diff(np.concatenate((head, [len(left)])))
        mine = order[left]
        least = np.minimum.reduceat(mine, head)
        several = np.maximum.reduceat(mine, head) > least
        keep = np.repeat(several, size)
        if depth >= WINDOW:
            out[left[keep]] = (mine > np.repeat(least, size))[keep]
            break
        left = left[keep]
        group = np.repeat(np.arange(int(several.sum()), dtype=np.uint64), size[several])
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 3)


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


_PHRASES = (np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint32, np.uint8)
_STRETCHES = (np.int64, np.int64, np.uint32, np.uint32, np.uint32)


def _rows(found: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()),
                                       pa.array(list(found.values()), pa.binary())],
                                      names=["part", "blob"])


def _stretches(ids: np.ndarray, keys: np.ndarray, own: np.ndarray, start: np.ndarray,
               length: np.ndarray, parts: int, shift: int) -> dict[int, bytes]:
    """Removed stretches, packed by the part of their document."""
    out = {}
    # by id and text: copies of a text with a repeat are dealt out too
    part = (_mixed(ids.astype(np.uint64) * _BASE + keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part[own], kind="stable")
    own, start, length = own[order], start[order], length[order]
    where = part[own]
    for p in np.unique(where):
        lo, hi = np.searchsorted(where, (p, p + 1))
        there, number = np.unique(own[lo:hi], return_inverse=True)
        out[int(p) + shift] = _packed(ids[there], keys[there], number.astype(np.uint32),
                                      start[lo:hi].astype(np.uint32),
                                      length[lo:hi].astype(np.uint32))
    return out


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the triggers that begin there."""
    gram = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        gram = gram * _BASE + data[at + k]
    return gram


def _as_windows(data: np.ndarray, at: np.ndarray, pieces: np.ndarray,
                *phrase: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases (own, start, count, trigger, run) of hot triggers, window by
    window, and the hash piece of each: equal windows are in equal pieces."""
    own, start, count, trigger, run = phrase
    of = np.repeat(np.arange(len(at)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = at[of] + inside
    name = np.zeros(len(of), np.uint64)
    for k in range(WINDOW):
        name = name * _BASE + data[at + k]
    piece = (_mixed(name) % pieces[of].astype(np.uint64)).astype(np.int64)
    # a run of phrases is one of its windows too: each lasts from the first place to the last
    return at, piece, own[of], start[of] + inside, np.ones_like(of), trigger[of] - inside, run[of], count[of]


def _own_phrases(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``parse`` and which of the phrases equal one of a smaller document."""
    parsed = parse(texts)
    own, _, count, _, key, _, at, data = parsed
    return (*parsed, later_copies(ids[own], key, at, count + WINDOW - 1, data))


def _flush(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], buckets: int,
           parts: int, hot: dict[int, int]) -> pa.RecordBatch:
    own, start, count, trigger, key, run, at, data, copies = _own_phrases(ids, texts)
    length = count + WINDOW - 1
    found = _stretches(ids, keys, own[copies], start[copies],
                       (length + (run - 1) * count)[copies], parts, buckets)
    rest = ~copies
    own, start, count, trigger, at, run = (x[rest] for x in (own, start, count, trigger, at, run))
    step = count                                    # places of a run are so far apart
    gram = _grams(data, at + trigger)               # the trigger's bytes decide the bucket
    bucket = _mixed(gram.copy())
    if hot:
        names = np.array(sorted(hot), np.uint64)
        place = np.minimum(np.searchsorted(names, gram), len(names) - 1)
        often = np.flatnonzero(names[place] == gram)
        split = np.array([hot[int(g)] for g in names])[place[often]]
        more = _as_windows(data, at[often], split, own[often], start[often], count[often],
                           trigger[often], run[often])
        each = np.repeat(bucket[often], count[often])
        keep = np.ones(len(at), bool)
        keep[often] = False
        bucket = np.concatenate((bucket[keep], _mixed(each + (more[1].astype(np.uint64) + np.uint64(1)) * _BASE)))
        at, own, start, count, trigger, run, step = (
            np.concatenate((x[keep], y)) for x, y in zip(
                (at, own, start, count, trigger, run, step), (more[0], *more[2:])))
    length = count + WINDOW - 1
    bucket = (bucket % np.uint64(buckets)).astype(np.int64)
    # what a run adds to the length of a stretch
    longer = (run - 1) * step
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        take = by[edges[b]:edges[b + 1]]
        there, number = np.unique(own[take], return_inverse=True)
        found[int(b)] = _packed(ids[there], keys[there], number.astype(np.uint32),
                                start[take].astype(np.uint32), count[take].astype(np.uint8),
                                trigger[take].astype(np.uint8), longer[take].astype(np.uint32),
                                _gather(data, at[take], length[take]))
    return _rows(found)


def _bucket(blobs: list[bytes], parts: int) -> dict[int, bytes]:
    """The stretches that a bucket's phrases lose, by part of their document."""
    found, docs = [], 0
    for blob in blobs:
        ids, keys, own, start, count, trigger, longer, data = _unpacked(blob, *_PHRASES)
        found.append((ids, keys, own.astype(np.int64) + docs, start.astype(np.int64),
                      count.astype(np.int64), trigger.astype(np.int64), longer.astype(np.int64), data))
        docs += len(ids)
    ids, keys, own, start, count, trigger, longer, data = (np.concatenate(x) for x in zip(*found))
    del found
    length = count + WINDOW - 1
    at = np.cumsum(length) - length
    # phrases whose trigger stands in one document only lose nothing
    gram = _grams(data, at + trigger)
    by = np.argsort(gram)
    head = np.flatnonzero(np.concatenate(([True], gram[by][1:] != gram[by][:-1])))
    size = np.diff(np.concatenate((head, [len(by)])))
    order = ids[own]
    several = np.minimum.reduceat(order[by], head) < np.maximum.reduceat(order[by], head)
    keep = np.sort(by[np.repeat(several, size)])
    own, start, count, at, length, longer = (x[keep] for x in (own, start, count, at, length, longer))
    if not len(own):
        return {}
    data = _gather(data, at, length)
    at = np.cumsum(length) - length
    phrase = np.repeat(np.arange(len(own), dtype=np.int32), count)
    inside = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    gone = repeated(data, at[phrase] + inside, ids[own][phrase])
    # runs of removed windows of one phrase
    there = np.flatnonzero(gone)
    if not len(there):
        return {}
    fresh = np.concatenate(([True], (np.diff(there) != 1) | (np.diff(phrase[there]) != 0)))
    first = there[np.flatnonzero(fresh)]
    run = np.diff(np.concatenate((np.flatnonzero(fresh), [len(there)])))
    p = phrase[first]
    return _stretches(ids, keys, own[p], start[p] + inside[first], run + WINDOW - 1 + longer[p], parts, 0)


def _united(blobs: list[bytes]) -> pa.Table:
    """Stretches of each document, united: pairs of start and end."""
    found, docs = [], 0
    for blob in blobs:
        ids, keys, own, start, length = _unpacked(blob, *_STRETCHES)
        found.append((ids, keys, own.astype(np.int64) + docs, start.astype(np.int64),
                      length.astype(np.int64)))
        docs += len(ids)
    ids, keys, own, start, length = (np.concatenate(x) for x in zip(*found))
    _, same = np.unique(np.stack((ids, keys)), axis=1, return_inverse=True)
    doc = same.ravel()[own]
    by = np.lexsort((start, doc))
    doc, own, start, stop = doc[by], own[by], start[by], (start + length)[by]
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc * far) - doc * far     # within the document
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(fresh)
    end = reach[np.concatenate((first[1:], [len(doc)])) - 1]
    spans = np.stack((start[first], end), axis=1)
    edge = np.flatnonzero(np.concatenate(([True], np.diff(doc[first]) != 0)))
    blocks = np.split(spans, edge[1:])
    lead = own[first][edge]
    return pa.table({
        "_id": pa.array(ids[lead], pa.int64(), mask=ids[lead] == LAST),
        "_key": pa.array(keys[lead], pa.int64()),
        "spans": pa.array([b.astype(np.int64).tobytes() for b in blocks], pa.binary())})


def _flushes(batches: Iterator[pa.RecordBatch],
             flush_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """ids, keys and bytes of rows (doc_id, key, text) with so much text at a time."""
    ids: list[int] = []
    keys: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(),
                                batch["text"].to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < WINDOW:
                continue
            ids.append(LAST if i is None else i)
            keys.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= flush_bytes:
                yield np.array(ids), np.array(keys), texts
                ids, keys, texts, size = [], [], [], 0
    if texts:
        yield np.array(ids), np.array(keys), texts


def hot_triggers(keyed: DataFrame) -> dict[int, int]:
    """Triggers that alone would fill a bucket, and in how many pieces their
    windows are dealt.  Estimated on one row of ``SAMPLE`` by its text's hash: it only says what
    is dealt by window rather than by phrase, the result is the same either way.
    A task names its ``NAMED`` largest triggers; those kept are fewer than the buckets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, int] = {}
        for ids, _, texts in _flushes(batches, FLUSH_BYTES):
            own, _, windows, trigger, _, _, at, data, copies = _own_phrases(ids, texts)
            rest = np.flatnonzero(~copies)
            grams, number = np.unique(_grams(data, at[rest] + trigger[rest]), return_inverse=True)
            total = np.bincount(number, windows[rest] + WINDOW - 1, len(grams))
            for i in np.argsort(-total)[:NAMED].tolist():
                sizes[int(grams[i])] = sizes.get(int(grams[i]), 0) + int(total[i])
        largest = sorted(sizes.items(), key=lambda kv: -kv[1])[:NAMED]
        yield pa.RecordBatch.from_arrays(
            [pa.array([str(g) for g, _ in largest], pa.string()), pa.array([n for _, n in largest], pa.int64())],
            names=["gram", "size"])

    sampled = keyed.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(SAMPLE)) == 0)
    size = F.sum("size") * SAMPLE
    rows = (sampled.mapInArrow(count, "gram string, size long").groupBy("gram").agg(size.alias("size"))
            .filter(F.col("size") > BUCKET_BYTES).collect())
    # a window by itself has up to WINDOW bytes for each one of the phrase
    return {int(r["gram"]): int(-(-r["size"] * WINDOW // BUCKET_BYTES)) for r in rows}


def spans(docs: DataFrame) -> DataFrame:
    """_id, _key, spans: the removed stretches (pairs of 64-bit byte offsets) of
    the rows of ``docs`` (doc_id, text) that lose some."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64("text").alias("key"), "text")
    total = keyed.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    overlap = (WINDOW - 1 + SPREAD / 2) / (SPREAD / 2)
    buckets = max(1, round(total * overlap / BUCKET_BYTES))
    parts = max(1, buckets // 8)

    hot = hot_triggers(keyed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _flushes(batches, FLUSH_BYTES):
            yield _flush(ids, keys, texts, buckets, parts, hot)

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        part = key[0].as_py()
        if part >= buckets:                         # found in the scan
            return pa.table({"part": pa.array([part - buckets] * len(blobs), pa.int64()),
                             "blob": pa.array(blobs, pa.binary())})
        return pa.Table.from_batches([_rows(_bucket(blobs, parts))])

    def unite(table: pa.Table) -> pa.Table:
        return _united(table["blob"].to_pylist())

    return (keyed.mapInArrow(scan, "part long, blob binary")
            .groupBy("part").applyInArrow(sort, "part long, blob binary")
            .groupBy("part").applyInArrow(unite, "_id long, _key long, spans binary"))


def cut(docs: DataFrame, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``
    and, with ``kept_text``, what is left of the text (as bytes)."""
    lost = written(spans(docs), "spans")
    size = lost.agg(F.sum(F.octet_length("spans") + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        lost = F.broadcast(lost)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).join(
        lost, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
        & (F.col("key") == F.col("_key")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                stretch = np.frombuffer(found or b"", np.int64).reshape(-1, 2).tolist()
                parts, at = [], 0
                for a, b in stretch:
                    parts.append(raw[at:a])
                    at = b
                rest = b"".join((*parts, raw[at:])) if parts else raw
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                runs.append(len(stretch))
                digests.append(hashlib.sha256(rest).hexdigest())
                if kept_text:
                    kept.append(rest)
            columns = {"doc_id": batch["doc_id"], "n_bytes": pa.array(sizes, pa.int64()),
                       "n_removed": pa.array(removed, pa.int64()),
                       "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digests)}
            if kept_text:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.select("doc_id", "text", "spans").mapInArrow(
        scan, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept binary" if kept_text else ""))
