"""Language identification by cross-parsing entropy.

Each language has a bounded text (``train_letters`` letters of labelled
documents) and its suffix automaton.  A document is parsed greedily into the
longest phrases that occur in that text; the fewer phrases a language needs,
the closer the document is to it.  Phrase counts are normalised by the length
of the document and of the language's text (bits: phrases x log2(length)).

Labels can be wrong, so the labelled documents are first parsed against the
automata of the other half; those that another language parses with fewer bits
are left out of the final text.

Texts are parsed as lower-case letters with runs of anything else as one
space.  Each language has symbols of its own: its ``letters`` most frequent letters, and
for its other letters one for each of ``BUCKETS`` groups of Unicode blocks that its text
has.  So a language of many letters, or a rare script beside a frequent one, keeps its
letters apart, and letters of another script are unknown to it.  Whole texts are parsed: a long one in lanes of ``LANE`` symbols, which
costs every language at most one phrase a lane.  Thousands of lanes move through
the automata together, one symbol at a time, as NumPy gathers.

Memory: the automata take about ``train_letters * 1.5 * (letters + 2) * 4``
bytes for each language (some 9 MB), fixed by the parameters and the number of languages; beyond
2**29 entries they have 8 bytes each.  Spark sends the model to an executor once, as a
broadcast, as it does with every function of over 1 MB.

Ties go to the language first by name.  Documents of a language that come first by
the hash of their id train, equal ids by their text.  Texts of any length are
parsed whole.  Other columns are not read, whatever their names.

Null texts and texts without letters get ``und`` and score 0.  Rows with a
null language do not train.  Without training rows all texts get ``und``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANE = 1024
BLOCK = 2_000_000
COUNT = 29             # a table entry is a state and, from this bit on, the phrases that end
WIDE = 60              # the same for tables that need 8 bytes
SPACE, OTHER = 0, 1    # OTHER: letters that the language's text lacks
BUCKETS = 64           # groups of Unicode blocks
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Which code points are letters; built once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def normalised(text: str) -> str:
    """Lower-case letters, anything else as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def _bucket(point: np.ndarray) -> np.ndarray:
    """The group of a code point's block of 128."""
    return (point >> 7) * 2654435761 % 4294967296 * BUCKETS >> 32


def automaton(symbols: list[int], width: int, shift: int = COUNT) -> np.ndarray:
    """Suffix automaton as a table [state, symbol] -> next state.  Where the
    state has no such edge, its phrase ends and the entry is the state after
    that symbol from the start; a symbol that the text lacks is a phrase too."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(nxt), width), -1, dtype=np.int64)
    for s, edges in enumerate(nxt):
        for c, to in edges.items():
            table[s, c] = to
    unknown = table[0] < 0
    restart = np.where(unknown, 2 << shift, table[0] | (1 << shift))
    table[0] = np.where(unknown, 1 << shift, table[0])
    return np.where(table < 0, restart, table)


@dataclass
class CrossParser:
    languages: list[str]
    letters: str                # class of letters[i] is i + 1 + BUCKETS; 1 to BUCKETS are the groups
    own: np.ndarray             # [language, class] -> the language's symbol
    tables: np.ndarray          # all automata, flat; entries point to rows
    starts: np.ndarray
    bits: np.ndarray            # log2 of each language's length
    shift: int

    @classmethod
    def fit(cls, texts: dict[str, list[str]], train_letters: int, letters: int) -> "CrossParser":
        names = sorted(texts)
        joined = [" ".join(texts[name])[:train_letters] for name in names]
        frequent = []
        for text in joined:
            seen = Counter(c for c in text if c != " ")
            frequent.append({c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:letters]})
        alphabet = "".join(sorted(set().union(*frequent)))
        classes = np.array([0, *range(1, BUCKETS + 1), *(1 + _bucket(np.array([ord(c) for c in alphabet], np.int64)))])
        own = np.full((len(names), 1 + BUCKETS + len(alphabet)), OTHER, np.uint8 if letters + BUCKETS < 254 else np.int32)
        own[:, SPACE] = SPACE
        widths = []
        for k, (text, mine) in enumerate(zip(joined, frequent)):
            rest = {ord(c) for c in text if c != " " and c not in mine}
            groups = sorted(set((1 + _bucket(np.array(sorted(rest), np.int64))).tolist()))
            group = {g: 2 + i for i, g in enumerate(groups)}
            own[k, 1:] = [group.get(int(g), OTHER) for g in classes[1:]]
            for i, c in enumerate(sorted(mine)):
                own[k, 1 + BUCKETS + alphabet.index(c)] = 2 + len(groups) + i
            widths.append(2 + len(groups) + len(mine))
        # a suffix automaton has under two states for a letter
        entries = sum(2 * (len(t) + 1) * w for t, w in zip(joined, widths))
        shift = COUNT if entries < 1 << COUNT else WIDE
        model = cls(names, alphabet, own, np.zeros(0, np.int32), np.zeros(0, np.int64),
                    np.array([math.log2(len(t) + 2) for t in joined]), shift)
        code = model.symbols()
        tables, starts, at = [], [], 0
        for k, (text, width) in enumerate(zip(joined, widths)):
            symbols = own[k][code[np.array([ord(c) for c in text], np.int64)]] if text else []
            table = automaton([int(x) for x in symbols], width, shift)
            to = table & ((1 << shift) - 1)
            tables.append(((table - to) | (to * width + at)).ravel())
            starts.append(at)
            at += table.size
        kind = np.int32 if shift == COUNT else np.int64
        model.tables = (np.concatenate(tables) if tables else np.zeros(0)).astype(kind)
        model.starts = np.array(starts, kind)
        return model

    def symbols(self) -> np.ndarray:
        """The class of each code point."""
        letter = _is_letter()
        code = np.where(letter, 1 + _bucket(np.arange(len(letter))), SPACE).astype(np.uint16)
        for i, c in enumerate(self.letters):
            code[ord(c)] = i + 1 + BUCKETS
        return code

    def phrases(self, texts: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language; letters of each text."""
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"),
                               dtype="<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        doc = np.repeat(np.arange(len(texts)), lengths)
        sym = code[points]
        letter = sym != SPACE
        n_letters = np.bincount(doc[letter], minlength=len(texts))
        keep = letter.copy()
        keep[1:] |= letter[:-1]                     # the first space after a letter
        keep &= letter | (np.arange(len(sym)) + 1 < np.cumsum(lengths)[doc])  # not at the end
        sym, doc = sym[keep], doc[keep]
        size = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(size) - size
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = first[owner] + part * LANE
        length = np.minimum(LANE, size[owner] - part * LANE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        langs = len(self.languages)
        state = np.repeat(self.starts[:, None], len(owner), axis=1)
        count = np.zeros((langs, len(owner)), dtype=np.int32)
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for t, n in enumerate(live):
            s = state[:, :n]
            s += self.own[:, sym[start[:n] + t]]
            got = self.tables.take(s)
            count[:, :n] += got >> self.shift
            np.bitwise_and(got, (1 << self.shift) - 1, out=s)
        count += state != self.starts[:, None]      # the phrases that are open
        out = np.zeros((len(texts), langs))
        for k in range(langs):
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(texts))
        return out, n_letters

    def predict(self, texts: list[str], code: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, in blocks of bounded size."""
        names: list[str] = []
        scores: list[float] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
                size += len(texts[to])
                to += 1
            found, letters = self.phrases([t.lower() for t in texts[at:to]], code)
            cost = found * self.bits
            best = cost.argmin(axis=1)
            share = 1 / np.maximum(cost, 1e-9)
            share = share[np.arange(to - at), best] / share.sum(axis=1)
            names += [self.languages[b] if n else "und" for b, n in zip(best, letters)]
            scores += np.where(letters > 0, share, 0.0).tolist()
            at = to
        return names, np.asarray(scores)


def fit(labelled: DataFrame, train_letters: int = 24_000, train_docs: int = 96,
        letters: int = 60) -> CrossParser:
    """Fit on at most ``train_docs`` documents of each language, in the order
    of a hash of doc_id, that give ``train_letters`` letters together at most
    (``4 * train_letters / train_docs`` characters of each, from a place that the
    hash chooses, so that a common beginning does not stand for the text).  This
    bounds the fitted model; prediction reads whole texts."""
    share = 4 * train_letters // train_docs
    by = Window.partitionBy("lang").orderBy("pick", "sample")
    rows = (labelled.filter("lang is not null and text is not null")
            .withColumn("pick", F.xxhash64(F.col("doc_id").cast("string")))
            .withColumn("place", F.pmod(F.xxhash64("pick"), F.greatest(
                F.char_length("text") - share, F.lit(0)) + 1).cast("int") + 1)
            .select("lang", F.substring(F.col("text"), F.col("place"), F.lit(share)).alias("sample"), "pick")
            .withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= train_docs)
            .orderBy("lang", "rank").collect())     # at most train_docs short rows a language
    texts: dict[str, list[str]] = {}
    for r in rows:
        if found := normalised(r["sample"]):
            texts.setdefault(r["lang"], []).append(found)
    kept: dict[str, list[str]] = {}
    for half in (0, 1):
        other = {k: v[1 - half::2] for k, v in texts.items() if v[1 - half::2]}
        if len(other) < 2:
            continue
        judge = CrossParser.fit(other, train_letters, letters)
        code = judge.symbols()
        for name, found in texts.items():
            said, _ = judge.predict(found[half::2], code)
            kept.setdefault(name, []).extend(
                t for t, s in zip(found[half::2], said) if s == name)
    return CrossParser.fit({k: kept.get(k) or v for k, v in texts.items()}, train_letters, letters)


def identify(docs: DataFrame, model: CrossParser) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = model.symbols()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if model.languages:
                names, scores = model.predict(texts, code)
            else:
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double")
