"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and a closing id.  One longer than a sequence is
cut into full sequences and a rest; nothing else is cut.  Pieces are packed by
best-two-fit: a sequence is filled greedily with the largest piece that fits;
when nothing fits any more and a gap is left, its smallest piece is taken out
if two unpacked pieces fill the expanded gap more tightly.

The pieces are split by hash into groups of about ``group_rows`` pieces, and a
group is packed in one task.  A group can leave one badly filled sequence, so
about ``tokens / length + groups`` sequences remain, whatever the corpus, and no
task grows with it.

Null texts count as empty (one piece with the closing id).  Repeated rows are
documents of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cached, written

GROUP_ROWS = 20_000
STOPS = (".", ",")
_TOKENIZERS: dict[str, "SpacedTokenizer"] = {}
cached(_TOKENIZERS.clear)


class SpacedTokenizer:
    """Token ids of whole texts for a tokenizer that drops white space.

    Such a tokenizer never joins what a space separates, so the ids of a text
    are the ids of its parts between spaces.  Each distinct part is encoded
    once and kept in a bounded table.  It also lowers case and parts words from
    punctuation; so Latin-1 texts (whose case has no exceptions) are lowered
    first, and a stop or comma after a word is encoded by itself.
    """

    def __init__(self, path: str, keep_chars: int = 14_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.keep_chars = keep_chars
        self.kept: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        kept = self.kept
        text = text.replace("\n", " ")
        if "<|" not in text:            # a special token is told by its case
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        parts = text.split(" ")
        new = [p for p in dict.fromkeys(parts) if p not in kept]
        if new:
            if self.chars > self.keep_chars:
                kept.clear()
                self.chars = 0
                new = list(dict.fromkeys(parts))
            ended = [p for p in new if p[-1:] in STOPS and p[-2:-1].isalnum()]
            words = dict.fromkeys(p[:-1] for p in ended)
            words.update(dict.fromkeys(set(new).difference(ended)))
            words.update(dict.fromkeys(STOPS))
            words = [w for w in words if w not in kept]
            for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
                kept[w] = np.asarray(e.ids, dtype="<u4").tobytes()
            for p in ended:
                kept[p] = kept[p[:-1]] + kept[p[-1]]
            self.chars += sum(map(len, new))
        return b"".join(map(kept.__getitem__, parts))


def tokenizer(path: str) -> SpacedTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = SpacedTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and,
    with ``with_ids``, the ids as little-endian 32-bit integers."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = "doc_id {}, piece int, start long, length long, ids_crc32 long".format(
        docs.schema["doc_id"].dataType.simpleString())
    schema += ", ids binary" if with_ids else ""
    width = 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = (encode(text) if text else b"") + end
                    rows += [(i, k, x // 4, ids[x:x + width])
                             for k, x in enumerate(range(0, len(ids), width))]
                i, k, start, ids = map(list, zip(*rows))
                columns = {"doc_id": part.column(0).take(pa.array(i, pa.int64())),
                           "piece": pa.array(k, pa.int32()),
                           "start": pa.array(start, pa.int64()),
                           "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                           "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the pieces of each sequence.  Pieces of one length are taken
    in the order given."""
    of: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        of.setdefault(int(lengths[i]), []).append(i)
    count = np.zeros(capacity + 1, dtype=np.int64)
    for size, found in of.items():
        count[size] = len(found)
    there = sorted(of)
    axis = np.arange(capacity + 1)

    def take(size: int) -> int:
        count[size] -= 1
        if not count[size]:
            there.remove(size)
        return of[size].pop()

    bins: list[list[int]] = []
    while there:
        sizes, gap, items = [], capacity, []
        while there and there[0] <= gap:
            size = there[bisect_right(there, gap) - 1]
            items.append(take(size))
            sizes.append(size)
            gap -= size
        if gap and there and len(sizes) > 1:
            least = sizes[-1]
            room = gap + least
            # pairs of unpacked pieces: a, and the largest b with a + b <= room
            a = np.flatnonzero(count[:room])
            if len(a):
                below = np.maximum.accumulate(np.where(count[:room + 1] > 0, axis[:room + 1], 0))
                b = below[room - a]
                alone = (b == a) & (count[a] < 2)
                b = np.where(alone, below[np.maximum(a - 1, 0)], b)
                both = np.where(b > 0, a + b, 0)
                best = int(both.argmax())
                if both[best] > least:
                    back = items.pop()
                    pair = int(a[best]), int(b[best])
                    items += [take(pair[0]), take(pair[1])]
                    if not count[least]:
                        insort(there, least)
                    count[least] += 1
                    of[least].append(back)
        bins.append(items)
    return bins


def pack(cut: DataFrame, length: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to the pieces of ``pieces``."""
    cut = written(cut, "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    schema = cut.schema
    names = cut.columns

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        lengths = table["length"].to_numpy()
        sequence = np.zeros(len(lengths), dtype=np.int64)
        offset = np.zeros(len(lengths), dtype=np.int64)
        for k, items in enumerate(best_two_fit(lengths, length)):
            sequence[items] = (key[0].as_py() << 32) + k
            offset[items] = np.concatenate(([0], np.cumsum(lengths[items])[:-1]))
        return (table.select(names).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups))
    return (cut.withColumn("group", group).groupBy("group")
            .applyInArrow(one, out + ", sequence_id long, offset long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences (``pieces(..., with_ids=True)``): sequence_id and
    the pieces in order, at most one sequence's length together."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts")))
