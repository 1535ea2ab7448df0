"""Quality classifier: a factorisation machine.

Features of a text are its hashed words and word shapes (an L2-normalised
log count each), statistics of its structure, and the declared number of
characters.  The score adds a linear term and all pairwise interactions through
factors of rank ``RANK``.  With the sum-of-squares identity the interactions
cost linear time::

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The model is fitted in one task on at most ``sample_rows`` labelled documents
(the first by a hash of doc_id), a documented bound; scoring reads whole texts
and runs where the rows are.  The model has ``BUCKETS + len(STATISTICS)`` rows
of ``RANK + 1`` floats, whatever the corpus.

Null texts count as empty; an empty text is scored by its statistics.  A null
``n_chars`` is replaced by the length of the text.  Null labels do not train.
Without labels of both kinds every text gets score 1 (nothing is rejected).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cached, give_back

BUCKETS = 1 << 15
RANK = 8
KEEP_WORDS = 400_000
STATISTICS = ("one", "declared", "length", "upper", "digits", "spaces", "symbols", "other",
              "word_length", "distinct", "commonest", "lines", "repeated_lines", "odd_words")
_WORDS: dict[str, tuple[int, int, bool]] = {}      # up to 100 MB of a worker
cached(_WORDS.clear)


def _word(word: str) -> tuple[int, int, bool]:
    """Bucket of the word, bucket of its shape, whether its shape is odd."""
    found = _WORDS.get(word)
    if found is None:
        shape, last = [], ""
        for c in word[:64]:
            kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
            if kind != last:
                shape.append(kind)
                last = kind
        core = "".join(c for c in word.lower() if c.isalnum())
        mark = "".join(shape)
        plain = mark.rstrip(".,;:?!") in ("a", "Aa", "A", "0", "Aa-Aa", "a-a")
        found = (zlib.crc32(b"w" + core.encode("utf-8", "replace")) % BUCKETS,
                 zlib.crc32(b"s" + mark.encode("utf-8", "replace")) % BUCKETS, not plain)
        if len(_WORDS) >= KEEP_WORDS:
            _WORDS.clear()
        if len(word) <= 64:
            _WORDS[word] = found
    return found


def features(text: str | None, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes and values of one text."""
    text = text or ""
    words = Counter(text.split())
    total = sum(words.values())
    index = np.empty(2 * len(words), dtype=np.int32)
    count = np.empty(2 * len(words), dtype=np.float32)
    odd = 0
    for k, (word, n) in enumerate(words.items()):
        a, b, strange = _word(word)
        index[2 * k], index[2 * k + 1] = a, b
        count[2 * k:2 * k + 2] = n
        odd += n * strange
    value = np.log1p(count)
    if len(value):
        value /= np.sqrt((value * value).sum())
    by = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(by.sum()))
    lines = [x for x in text.split("\n") if x]
    letters = by[65:91].sum() + by[97:123].sum()
    spaces = by[32] + by[9:14].sum()
    digits = by[48:58].sum()
    stats = np.array([
        1.0,
        np.log1p(len(text) if declared is None or declared < 0 else declared) / 12,
        np.log1p(len(text)) / 12,
        by[65:91].sum() / max(1, letters),
        digits / size,
        spaces / size,
        (by[:128].sum() - letters - digits - spaces) / size,
        by[128:].sum() / size,
        min(2.0, len(text) / max(1, total) / 10),
        len(words) / max(1, total),
        max(words.values(), default=0) / max(1, total),
        min(2.0, 50 * len(lines) / size),
        1 - len(set(lines)) / max(1, len(lines)),
        odd / max(1, total)], dtype=np.float32)
    return (np.concatenate((index, np.arange(BUCKETS, BUCKETS + len(stats), dtype=np.int32))),
            np.concatenate((value, stats)))


@dataclass
class FactorisationMachine:
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``first``: where each text's features begin."""
        return self.parts(index, value, first)[0]

    def parts(self, index, value, first):
        vx = self.factors[index] * value[:, None]
        summed = np.add.reduceat(vx, first, axis=0)
        squared = np.add.reduceat((vx * vx).sum(axis=1), first)
        flat = np.add.reduceat(self.linear[index] * value, first)
        return flat + 0.5 * ((summed * summed).sum(axis=1) - squared), summed

    @classmethod
    def train(cls, index: list, value: list, label: np.ndarray, epochs: int = 12,
              rate: float = 0.1, decay: float = 1e-4, batch: int = 64,
              seed: int = 7) -> "FactorisationMachine":
        """Logistic loss, AdaGrad over mini-batches in a seeded order."""
        rng = np.random.default_rng(seed)
        size = BUCKETS + len(STATISTICS)
        fm = cls(np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32))
        seen_w = np.full(size, 1e-2, np.float32)
        seen_v = np.full((size, RANK), 1e-2, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), batch):
                rows = order[at:at + batch]
                lengths = np.array([len(index[r]) for r in rows])
                first = np.cumsum(lengths) - lengths
                idx = np.concatenate([index[r] for r in rows])
                val = np.concatenate([value[r] for r in rows])
                logit, summed = fm.parts(idx, val, first)
                error = (1 / (1 + np.exp(-logit)) - label[rows]) / len(rows)
                each = np.repeat(error, lengths) * val
                grad_v = each[:, None] * (np.repeat(summed, lengths, axis=0)
                                          - fm.factors[idx] * val[:, None])
                there, back = np.unique(idx, return_inverse=True)
                gw = np.bincount(back, weights=each, minlength=len(there)) + decay * fm.linear[there]
                gv = np.stack([np.bincount(back, weights=grad_v[:, f], minlength=len(there))
                               for f in range(RANK)], axis=1) + decay * fm.factors[there]
                seen_w[there] += gw * gw
                seen_v[there] += gv * gv
                fm.linear[there] -= rate * gw / np.sqrt(seen_w[there])
                fm.factors[there] -= rate * gv / np.sqrt(seen_v[there])
        return fm


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> FactorisationMachine | None:
    """Fit on ``labels`` (doc_id, quality) of at most ``sample_rows`` documents;
    a document with labels of both kinds does not train."""
    chosen = (labels.filter("quality is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"),
                                     F.max("quality").alias("other"))
              .filter("quality = other").select("doc_id", "quality")
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows))
    # at most sample_rows ids
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, n) for t, n in zip(batch["text"].to_pylist(),
                                                    batch["n_chars"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.tobytes() for i, _ in found], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                 pc.cast(batch["quality"], pa.int32())], names=["index", "value", "quality"])
        give_back()

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("index", "ascending"), ("value", "ascending"),
                               ("quality", "ascending")])
        label = (table["quality"].to_numpy() > 0).astype(np.float32)
        if label.min() == label.max():
            return pa.table({"linear": pa.array([], pa.binary()),
                             "factors": pa.array([], pa.binary())})
        fm = FactorisationMachine.train(
            [np.frombuffer(x, np.int32) for x in table["index"].to_pylist()],
            [np.frombuffer(x, np.float32) for x in table["value"].to_pylist()], label)
        return pa.table({"linear": pa.array([fm.linear.tobytes()], pa.binary()),
                         "factors": pa.array([fm.factors.tobytes()], pa.binary())})

    found = (rows.mapInArrow(prepare, "index binary, value binary, quality int")
             .groupBy(F.lit(0).alias("one")).applyInArrow(train, "linear binary, factors binary").collect())
    if not found:
        return None
    return FactorisationMachine(
        np.frombuffer(found[0]["linear"], np.float32),
        np.frombuffer(found[0]["factors"], np.float32).reshape(-1, RANK))


def score(docs: DataFrame, model: FactorisationMachine | None, out: str = "score") -> DataFrame:
    """``docs`` (text, n_chars and any other columns) with the column ``out``."""
    schema = T.StructType([f for f in docs.schema if f.name != out]
                          + [T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema][:-1]

    def rate(texts: list, declared: list) -> np.ndarray:
        if model is None:
            return np.ones(len(texts))
        found = [features(t, n) for t, n in zip(texts, declared)]
        lengths = np.array([len(i) for i, _ in found])
        logit = model.logits(np.concatenate([i for i, _ in found]),
                             np.concatenate([v for _, v in found]),
                             np.cumsum(lengths) - lengths)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = rate(part["text"].to_pylist(), part["n_chars"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in names] + [pa.array(scores, pa.float64())],
                    names=names + [out])
        give_back()

    return docs.select(*names).mapInArrow(predict, schema)
