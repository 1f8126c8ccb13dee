"""Language-model scoring with a log-frequency Bloom filter.

Word pairs and words are counted over all training texts, and their counts quantised on a logarithmic scale: count c has
level 1 + floor(log(c) / log(BASE)).  The filter holds (n-gram, 1), ... (n-gram, level); a level is read back by probing
1, 2, ... until one is missing, so that an n-gram's level is never read too low, and too high with a chance that falls
with each level.  The filter is laid out in segments by the n-gram's hash; each segment is built in a task of its own,
from counts that were summed before the shuffle, with BITS_EACH bits for each entry, however many there are: its error
rate does not depend on the size of the corpus, and its size grows with it.

As long as the filter and the exact counts of words are small enough they are sent to all executors, as a file that the
workers of one map and share.  Beyond that the probes are sent to the segments instead: the distinct n-grams of a stretch
of texts go to the tasks that hold their segments, and the levels come back to the stretch, in the order in which the
n-grams were sent.  Both ways give the same scores.

The model is a bigram model with a Dirichlet prior:  P(w | v) = (q(v w) + MU * P(w)) / (S(v) + MU)  with
P(w) = (q(w) + 1) / (Q + V + 1), every q a quantised count read from the filter.  S(v) is the sum of q(v w) over all w that
follow v, and Q that of q(w) over all V distinct tokens; both are added up while the filter is built and kept exactly, S(v)
beside the exact count of v.  So the probabilities of all known w and of one unknown add up to one for every v, as far as
levels are read rightly; a level that is read too high adds to them, and is held to those of v and w.

The base score uses exact counts.  Words are known by their 64-bit hashes.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import ASCII_LOWER, Scratch, annotate, col, fresh, ship, slices

BASE = 1.5
MU = 24.0
PROBES = 5
BITS_EACH = 7.3  # bits for each entry: PROBES / ln 2; an entry that is not there is then read with a chance of 0.031
#: Bytes of a filter that is sent to the executors at most.
MAX_FILTER_BYTES = 192 << 20
#: Words whose exact counts are sent to the executors (16 to 24 bytes each) at most.
MAX_SENT_WORDS = 12_000_000
#: Bytes of text for each segment, about, as long as there are fewer than MAX_SEGMENTS.
SEGMENT_BYTES = 4 << 20
MAX_SEGMENTS = 1 << 16
#: Tokens counted together before they are passed on (a third of them where probes are routed): so many, and so many for
#: each segment if that is more, so that what is passed on for a segment is worth a row.  Even MAX_SEGMENTS make them no
#: more than a twentieth more, so that a worker's memory does not grow with the texts.
TOKENS_AT_ONCE = 1_500_000
TOKENS_A_SEGMENT = 24
#: Bytes of counts that a segment's task takes before it adds them up.
SUM_BYTES = 24 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_END, _START = np.uint64(0x1D), np.uint64(0x51)
#: The middle of the whole counts that have a level.
LEVELS = np.array([0.0] + [(math.ceil(BASE ** (j - 1)) + math.ceil(BASE**j) - 1) / 2 for j in range(1, 100)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def single(words: np.ndarray) -> np.ndarray:
    return mix(words + _GOLD)


def pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(mix(before) * _GOLD + words)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then an end, for each text), and where each text starts."""
    from xxhash import xxh64_intdigest

    out: list[int] = []
    starts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        starts[i] = len(out)
        if t:
            out += map(xxh64_intdigest, t.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split())
        out.append(int(_END))
    return np.array(out, np.uint64), starts


def before(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each, a start for the first of a text."""
    out = np.concatenate((words[:1], words[:-1]))
    out[starts] = _START
    return out


def _probe(keys: np.ndarray, level: int, k: int) -> np.ndarray:
    """The k-th hash of (n-gram, level)."""
    with np.errstate(over="ignore"):
        x = mix(keys + _GOLD * np.uint64(level + 1))
    return (x & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((x >> np.uint64(32)) | np.uint64(1))


def read_levels(bits: np.ndarray, size: np.ndarray, offset: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each n-gram, 0 if absent; its segment has `size` bits from byte `offset` of `bits` on."""
    out = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    for j in range(1, len(LEVELS)):
        for k in range(PROBES):
            at = _probe(keys[alive], j, k) % size[alive]
            hit = bits[offset[alive] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            alive = alive[hit.astype(bool)]
        if not len(alive):
            break
        out[alive] = j
    return out


def place(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each n-gram; a word's goes by mix(word), a pair's by its own hash."""
    return (hashes >> np.uint64(64 - segments.bit_length() + 1)).astype(np.int64) if segments > 1 else np.zeros(len(hashes), np.int64)


# Counting and building ----------------------------------------------------------------------------------------------

_COUNTED = T.StructType([T.StructField("segment", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("words", "grams", "contexts", "counts"))])
#: A row for each segment; and rows with contexts and sums alone: what tasks have found of S (times two, which is whole).
_BUILT = T.StructType([T.StructField("segment", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("bits", "words", "counts")), *(T.StructField(n, T.LongType()) for n in ("entries", "tokens", "mass")), *(T.StructField(n, T.BinaryType()) for n in ("contexts", "sums"))])
#: S of a segment's words, in their order, and of the start of texts if it belongs there.
_SUMMED = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("sums", T.BinaryType()), T.StructField("start", T.LongType())])
_TWICE = (2 * LEVELS).astype(np.int64)


def _by_segment(words: np.ndarray, grams: np.ndarray, segments: int) -> tuple[np.ndarray, Iterator[tuple[int, slice, slice]]]:
    """The order of sorted distinct words by their segments, and each segment's slices of words in that order and of
    sorted distinct pairs."""
    of = place(mix(words), segments)
    order = np.argsort(of, kind="stable")
    a = np.searchsorted(of[order], np.arange(segments + 1))
    b = np.searchsorted(place(grams, segments), np.arange(segments + 1))
    full = np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1]))
    return order, ((s, slice(a[s], a[s + 1]), slice(b[s], b[s + 1])) for s in full.tolist())


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one byte each, as most take no more, or in two, four or eight."""
    most = int(counts.max(initial=0))
    return counts.astype(next(t for t in ("u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max)).tobytes()


def _widened(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{data.size // n}" if n else "u1").astype(np.int64)


def _counted(texts: DataFrame, segments: int) -> DataFrame:
    """Counts by segment: words' and pairs' hashes (their places in `counts` follow one another), summed per stretch."""
    arrow = to_arrow_schema(_COUNTED)
    most = max(TOKENS_AT_ONCE, TOKENS_A_SEGMENT * segments)

    def passed_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, n_words = np.unique(np.concatenate([h[0] for h in held]), return_counts=True)
        grams, first, n_grams = np.unique(np.concatenate([h[1] for h in held]), return_index=True, return_counts=True)
        contexts = np.concatenate([h[2] for h in held])[first]
        with np.errstate(over="ignore"):
            order, parts = _by_segment(words, grams, segments)
        words, n_words = words[order], n_words[order]
        rows = [(s, words[a].tobytes(), grams[b].tobytes(), contexts[b].tobytes(), _narrow(np.concatenate((n_words[a], n_grams[b])))) for s, a, b in parts]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                words, starts = tokens(batch.column(0).slice(a, b - a).to_pylist())
                prior = before(words, starts)
                with np.errstate(over="ignore"):
                    held.append((words, pair(prior, words), prior))
                n += len(words)
                if n >= most:
                    yield passed_on(held)
                    held, n = [], 0
        if n:
            yield passed_on(held)

    return texts.mapInArrow(run, _COUNTED)


class _Sums:
    """Counts by key (and a value that goes with the key), added up whenever SUM_BYTES have come in."""

    def __init__(self, valued: bool = False):
        self.keys, self.n, self.values, self.size, self.valued = [], [], [], 0, valued

    def add(self, keys: np.ndarray, n: np.ndarray, values: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        self.n.append(n)
        if self.valued:
            self.values.append(values)
        self.size += (24 if self.valued else 16) * len(keys)
        if self.size > SUM_BYTES + 32 * len(self.keys[0]):
            self.done()

    def done(self) -> tuple[np.ndarray, ...]:
        every = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        if self.valued:
            distinct, first, at = np.unique(every, return_index=True, return_inverse=True)
            self.values = [np.concatenate(self.values)[first] if self.values else np.zeros(0, np.uint64)]
        else:
            distinct, at = np.unique(every, return_inverse=True)
        # Whole doubles up to 2**53 are added exactly.
        n = np.bincount(at, weights=np.concatenate(self.n) if self.n else None, minlength=len(distinct)).astype(np.int64)
        self.keys, self.n, self.size = [distinct], [n], 0
        return (distinct, n, *self.values)


def _built(counted: DataFrame, segments: int) -> DataFrame:
    """The segments' bits, and their words with exact counts; a task holds one segment at a time.  And, from each task, S
    of the contexts that it has met, a row for each of their segments."""
    arrow = to_arrow_schema(_BUILT)

    def made(segment: int, words: _Sums, grams: _Sums, found: _Sums) -> pa.RecordBatch:
        (words, n_words), (grams, n_grams, contexts) = words.done(), grams.done()
        with np.errstate(over="ignore"):
            # A word's own entry may belong to another segment than its pairs' and is put where the word is.
            own, both = levels(n_words), levels(n_grams)
            found.add(contexts, _TWICE[both])
            keys, level = np.concatenate((single(words), grams)), np.concatenate((own, both))
            entries = int(level.sum())
            size = max(64, math.ceil(entries * BITS_EACH / 64) * 64)
            bits = np.zeros(size, bool)
            for j in range(1, int(level.max()) + 1):
                at = keys[level >= j]
                for k in range(PROBES):
                    bits[_probe(at, j, k) % np.uint64(size)] = True
        row = [[segment], [np.packbits(bits, bitorder="little").tobytes()], [words.astype("<u8").tobytes()], [n_words.astype("<i8").tobytes()], [entries], [int(n_words.sum())], [int(_TWICE[own].sum())], [None], [None]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    def sums(found: _Sums) -> pa.RecordBatch:
        contexts, n = found.done()
        with np.errstate(over="ignore"):
            order, parts = _by_segment(contexts, np.zeros(0, np.uint64), segments)
        contexts, n = contexts[order], n[order]
        rows = [(s, contexts[a].tobytes(), n[a].astype("<i8").tobytes()) for s, a, _ in parts]
        none = [None] * len(rows)
        columns = [[r[0] for r in rows], *[none] * 6, [r[1] for r in rows], [r[2] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, grams, found = None, _Sums(), _Sums(True), _Sums()
        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.column(0)[i].as_py()
                if segment != now:
                    if now is not None:
                        yield made(now, words, grams, found)
                        if found.size + 16 * len(found.keys[0]) > 2 * SUM_BYTES:
                            yield sums(found)
                            found = _Sums()
                    now, words, grams = segment, _Sums(), _Sums(True)
                w, g, c = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u8") for k in (1, 2, 3))
                n = _widened(batch.column(4)[i].as_buffer(), len(w) + len(g))
                words.add(w.copy(), n[: len(w)].copy())
                grams.add(g.copy(), n[len(w) :].copy(), c.copy())
        if now is not None:
            yield made(now, words, grams, found)
            yield sums(found)

    return counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, _BUILT)


def _summed(built: DataFrame) -> DataFrame:
    """S of every segment's words, from what the tasks have found; a task holds one segment at a time."""
    arrow = to_arrow_schema(_SUMMED)

    def made(segment: int, words: np.ndarray, found: _Sums) -> pa.RecordBatch:
        contexts, n = found.done()
        at = np.searchsorted(contexts, words)
        at[at == len(contexts)] = 0
        known = contexts[at] == words if len(contexts) else np.zeros(len(words), bool)
        start = int(n[contexts == _START].sum())
        row = [[segment], [np.where(known, n[at] if len(n) else 0, 0).astype("<i8").tobytes()], [start]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, found = None, np.zeros(0, np.uint64), _Sums()
        for batch in batches:
            for i in range(batch.num_rows):
                segment, w = batch.column(0)[i].as_py(), batch.column(1)[i]
                if segment != now:
                    if now is not None:
                        yield made(now, words, found)
                    now, words, found = segment, np.zeros(0, np.uint64), _Sums()
                if w.is_valid:
                    words = np.frombuffer(w.as_buffer(), "<u8").copy()
                else:
                    found.add(*(np.frombuffer(batch.column(k)[i].as_buffer(), t).copy() for k, t in ((2, "<u8"), (3, "<i8"))))
        if now is not None:
            yield made(now, words, found)

    return built.select("segment", "words", "contexts", "sums").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, _SUMMED)


@dataclass
class Totals:
    """What a score needs beside the counts."""

    texts: int
    tokens: int
    distinct: int
    mass: float  # Q
    start: float  # S of the start of a text

    def score(self, starts: np.ndarray, prior: np.ndarray, word: np.ndarray, context: np.ndarray, both: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """log10 probability of each text, from the quantised counts of its words, of those before them and of the pairs,
        and S of those before (times two)."""
        first = prior == _START
        context = np.where(first, LEVELS[levels(np.array([max(1, self.texts)]))[0]], context)
        total = np.where(first, self.start, sums / 2)
        plain = (word + 1) / (self.mass + self.distinct + 1)
        both = np.where(total > 0, np.minimum(both, np.minimum(context, word)), 0.0)  # a pair is no more frequent than its words
        p = (both + MU * plain) / (total + MU)
        return np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)

    def base(self, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known tokens, base score) of each text."""
        whole = self.tokens + self.distinct + 1
        return np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(np.log10((counts + 1) / whole), starts)


@dataclass
class Filter:
    """The filter and the exact counts; the arrays of the last four are parts of the mapped file."""

    segments: int
    sizes: np.ndarray  # bits of each segment
    offsets: np.ndarray  # bytes before each segment
    bits: np.ndarray  # bytes
    words: np.ndarray  # sorted hashes
    counts: np.ndarray  # and their counts
    sums: np.ndarray  # and S, times two

    def levels(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return read_levels(self.bits, self.sizes[segment], self.offsets[segment], keys)

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and S (times two) of words, 0 of unknown ones."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return tuple(np.where(known, x[at].astype(np.int64), 0) for x in (self.counts, self.sums))


@dataclass
class Sent:
    """Where a filter's file is, and what the file does not tell."""

    file: str
    segments: int
    sizes: np.ndarray
    offsets: np.ndarray
    distinct: int
    size: int  # bytes of the bits, with a rest
    count: str  # type of counts and S

    def mapped(self, path: str, mode: str = "r") -> Filter:
        """The filter as the file at `path`; what is mapped of it is shared by all processes of a machine."""
        n, at = self.distinct, 0
        parts = []
        for kind, k in (("<u8", n), (self.count, n), (self.count, n), ("u1", self.size)):
            parts.append(np.asarray(np.memmap(path, kind, mode, at, (k,))) if k else np.zeros(0, kind))
            at += k * np.dtype(kind).itemsize
        words, counts, sums, bits = parts
        return Filter(self.segments, self.sizes, self.offsets, bits, words, counts, sums)

    def here(self) -> Filter:
        """In a task."""
        return self.mapped(SparkFiles.get(self.file))


@dataclass
class Model:
    totals: Totals
    segments: int
    filter: Filter | None  # where it may be sent
    sent: Sent | None  # and its file
    table: DataFrame  # the segments (_BUILT)
    sums: DataFrame  # S of their words (_SUMMED)
    filter_bytes: int
    entries: int


def train(spark: SparkSession, scratch: Scratch, docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all of docs' texts; null ones are empty.  What the driver holds is bounded by MAX_FILTER_BYTES and
    MAX_SENT_WORDS; a larger model stays in its table."""
    ship(spark)
    texts = docs.select(F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    segments = min(MAX_SEGMENTS, 1 << max(0, math.ceil(math.log2(max(1, size / SEGMENT_BYTES)))))
    built = scratch.keep(_built(_counted(texts, segments), segments), "built", "uncompressed", wide=True)
    sums = scratch.keep(_summed(built), "sums", "uncompressed", wide=True)
    built = built.where("bits IS NOT NULL")
    none = F.lit(0).cast("long")
    size, distinct, total, entries, mass = built.agg(*[F.coalesce(F.sum(c), none) for c in (F.octet_length("bits"), F.octet_length("words") / 8, F.col("tokens"), F.col("entries"), F.col("mass"))]).first()
    start = sums.agg(F.coalesce(F.sum("start"), none)).first()[0]
    distinct = int(distinct)
    totals = Totals(rows, total, distinct, mass / 2, start / 2)
    if size > MAX_FILTER_BYTES or distinct > MAX_SENT_WORDS:
        return Model(totals, segments, None, None, built, sums, size, entries)
    # Everything is put where it belongs in the file as it arrives; the driver holds a few arrays over the words besides.
    path = os.path.join(folder := tempfile.mkdtemp(), f"filter-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    count = "<u4" if total < 1 << 30 else "<i8"  # S is no more than one and a quarter times the tokens
    sizes, offsets, at, w, placed = np.full(segments, 64, np.uint64), np.full(segments, size, np.int64), 0, 0, {}
    sent = Sent(os.path.basename(path), segments, sizes, offsets, distinct, size + 8, count)
    with open(path, "wb") as f:
        f.truncate((8 + 2 * np.dtype(count).itemsize) * distinct + sent.size)
    made = sent.mapped(path, "r+")
    for r in built.select("segment", "bits", "counts", "words").toLocalIterator():
        bits, n = np.frombuffer(r["bits"], np.uint8), np.frombuffer(r["counts"], "<i8")
        sizes[r["segment"]], offsets[r["segment"]] = 8 * len(bits), at
        made.bits[at : at + len(bits)] = bits
        at += len(bits)
        made.words[w : w + len(n)] = np.frombuffer(r["words"], "<u8")
        made.counts[w : w + len(n)] = n
        placed[r["segment"]] = w
        w += len(n)
    for r in sums.select("segment", "sums").toLocalIterator():
        n = np.frombuffer(r["sums"], "<i8")
        if len(n):
            made.sums[placed[r["segment"]] : placed[r["segment"]] + len(n)] = n
    order = np.argsort(made.words)
    for x in (made.words, made.counts, made.sums):
        x[:] = x[order]
    del made
    spark.sparkContext.addFile(path)
    return Model(totals, segments, sent.mapped(path), sent, built, sums, size, entries)


# Scoring ------------------------------------------------------------------------------------------------------------

FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _needed(words: np.ndarray, starts: np.ndarray):
    """The tokens before, the distinct words (of both) with their places, the distinct pairs with theirs."""
    with np.errstate(over="ignore"):
        prior = before(words, starts)
        singles, at = np.unique(np.concatenate((words, prior)), return_inverse=True)
        pairs, back = np.unique(pair(prior, words), return_inverse=True)
    return prior, singles, at[: len(words)], at[len(words) :], pairs, back


def score(spark: SparkSession, docs: DataFrame, model: Model, scratch: Scratch, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (`keep`, all by default) and a struct FIELDS; and that column's name.

    n_tokens counts the end; n_known those tokens that the training texts have; base_score is exact; score is the
    model's log10 probability of the text and its end.  Null and empty texts are an end alone.  Texts of any length are
    scored whole.  Repeated rows stay; an empty table gives no rows; after training on nothing all tokens are unknown.
    """
    ship(spark)
    name, keep = fresh(docs, "lm"), list(docs.columns if keep is None else keep)
    if model.filter is None:
        return _score_routed(docs, model, scratch, text_col, name, keep), name
    sent = spark.sparkContext.broadcast((model.totals, model.sent))

    def make():
        totals, file = sent.value
        lm = file.here()

        def kernel(texts):
            words, starts = tokens(texts)
            prior, singles, word, context, pairs, back = _needed(words, starts)
            with np.errstate(over="ignore"):
                counts = LEVELS[lm.levels(single(singles), place(mix(singles), lm.segments))]
                both = LEVELS[lm.levels(pairs, place(pairs, lm.segments))][back]
            exact, sums = lm.exact(singles)
            sure, base = totals.base(exact[word], starts)
            return {"n_tokens": np.diff(np.append(starts, len(words))), "n_known": sure, "base_score": base, "score": totals.score(starts, prior, counts[word], counts[context], both, sums[context])}

        return kernel

    return annotate(docs, text_col, make, FIELDS, name, keep), name


def _score_routed(docs: DataFrame, model: Model, scratch: Scratch, text_col: str, name: str, keep: list[str]) -> DataFrame:
    """The same, with the probes sent to the segments.

    A stretch is a run of texts of one partition.  Stretches are written with their distinct words and each token's place
    among them; their distinct n-grams, one row for each segment, meet the segments' rows, and the answers the stretches'
    rows, in partitions sorted so that either comes first, and tasks hold one of them at a time.  An answer has levels and
    counts alone, in the order of the n-grams that were sent, which the stretch's row gives again.
    """
    segments, totals = model.segments, model.totals
    most = max(TOKENS_AT_ONCE // 3, TOKENS_A_SEGMENT * segments)
    row = T.StructType([docs.schema[c] for c in keep])
    kept = T.StructType([T.StructField("stretch", T.LongType()), T.StructField("rows", T.ArrayType(row)), *(T.StructField(n, T.BinaryType()) for n in ("starts", "distinct", "tokens"))])
    kept_arrow, cells = to_arrow_schema(kept), to_arrow_schema(row)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def made() -> pa.RecordBatch:
            rows = pa.concat_arrays([h[0] for h in held])
            offset = np.cumsum([0, *(len(h[1]) for h in held)])
            starts = np.concatenate([h[2] + o for h, o in zip(held, offset, strict=False)])
            words, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            columns = [pa.array([stretch]), pa.ListArray.from_arrays([0, len(rows)], rows).cast(kept_arrow.field(1).type), *(pa.array([x]) for x in (starts.astype("<i8").tobytes(), words.astype("<u8").tobytes(), at.astype("<u4").tobytes()))]
            return pa.RecordBatch.from_arrays(columns, schema=kept_arrow)

        for batch in batches:
            for a, b in slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                words, starts = tokens(part.column(len(keep)).to_pylist())
                held.append((pa.StructArray.from_arrays([part.column(i).cast(f.type) for i, f in enumerate(cells)], fields=list(cells)), words, starts))
                n += len(words)
                if n >= most:
                    yield made()
                    stretch, held, n = stretch + 1, [], 0
        if held:
            yield made()

    source = docs.select(*map(col, keep), F.coalesce(col(text_col).cast("string"), F.lit("")).alias(fresh(docs, "__text")))
    stretches = scratch.keep(source.mapInArrow(cut, kept), f"stretches-{uuid.uuid4().hex}", wide=True)

    asked = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("stretch", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("grams", T.BinaryType())])
    asked_arrow = to_arrow_schema(asked)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                starts, words, at = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, "<i8"), (2, "<u8"), (3, "<u4")))
                with np.errstate(over="ignore"):
                    every = words[at]
                    pairs = np.unique(pair(before(every, starts), every))
                    order, parts = _by_segment(words, pairs, segments)
                words, stretch = words[order], batch.column(0)[i].as_py()
                rows = [(s, stretch, words[a].tobytes(), pairs[b].tobytes()) for s, a, b in parts]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), asked_arrow, strict=True)], schema=asked_arrow)

    probes = stretches.select("stretch", "starts", "distinct", "tokens").mapInArrow(ask, asked)
    none = F.lit(None)
    blank = lambda *names: {n: none.cast("binary") for n in names}
    built = model.table.select("segment", "words", "bits", "counts").withColumns({"stretch": none.cast("long"), **blank("grams", "sums")})
    summed = model.sums.select("segment", "sums").withColumns({"stretch": none.cast("long"), **blank("words", "grams", "bits", "counts")})
    met = built.unionByName(summed).unionByName(probes.withColumns(blank("bits", "counts", "sums")))
    answer = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("stretch", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("counts", "levels", "sums"))])
    answer_arrow = to_arrow_schema(answer)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(8, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        now, (bits, known, counts, twice) = None, nothing
        held, n = [], 0  # (stretch, words, grams) that ask one segment, answered together

        def answered(segment: int) -> pa.RecordBatch:
            words, grams = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            n, own, level = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words) + len(grams), np.uint8)
            if segment == now:  # else no n-gram of the training texts is there
                with np.errstate(over="ignore"):
                    keys = np.concatenate((single(words), grams))
                level = read_levels(bits, np.full(len(keys), 8 * len(bits), np.uint64), np.zeros(len(keys), np.int64), keys).astype(np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    n, own = (np.where(known[at] == words, x[at], 0) for x in (counts, twice))
            rows, w, g = [], 0, len(words)
            for stretch, a, b in held:
                rows.append((segment, stretch, _narrow(n[w : w + len(a)]), level[w : w + len(a)].tobytes() + level[g : g + len(b)].tobytes(), _narrow(own[w : w + len(a)])))
                w, g = w + len(a), g + len(b)
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), answer_arrow, strict=True)], schema=answer_arrow)

        asks = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda k, t, i=i, batch=batch: np.frombuffer(batch.column(k)[i].as_buffer(), t).copy()
                segment, stretch = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if held and (segment != asks or n >= most):
                    yield answered(asks)
                    held, n = [], 0
                if stretch is None:  # a segment's two rows come in any order, both before those that ask
                    if segment != now:
                        now, (bits, known, counts, twice) = segment, nothing
                    if batch.column(6)[i].is_valid:
                        twice = get(6, "<i8")
                    else:
                        bits, known, counts = get(4, np.uint8), get(2, "<u8"), get(5, "<i8")
                    continue
                asks = segment
                held.append((stretch, get(2, "<u8"), get(3, "<u8")))
                n += len(held[-1][1]) + len(held[-1][2])
        if held:
            yield answered(asks)

    answers = met.select("segment", "stretch", "words", "grams", "bits", "counts", "sums").repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("stretch")).mapInArrow(probe, answer)

    out = T.StructType([*row.fields, T.StructField(name, FIELDS)])
    out_arrow, fields = to_arrow_schema(out), to_arrow_schema(FIELDS)
    told = answers.withColumns({"rows": none.cast(kept["rows"].dataType), **blank("starts", "distinct", "tokens")})
    whole = stretches.withColumns({"segment": none.cast("int"), **blank("counts", "levels", "sums")}).unionByName(told)

    class Held:
        """A stretch, and the answers to it as they come in."""

        def __init__(self, rows: pa.Array, starts: np.ndarray, words: np.ndarray, at: np.ndarray):
            self.rows, self.starts, self.at = rows, starts, at
            with np.errstate(over="ignore"):
                every = words[at]
                self.prior = before(every, starts)
                pairs, self.back = np.unique(pair(self.prior, every), return_inverse=True)
                self.order, parts = _by_segment(words, pairs, segments)
            self.open = {s: (a, b) for s, a, b in parts}
            self.counts, self.sums = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            self.level, self.both = np.zeros(len(words), np.uint8), np.zeros(len(pairs), np.uint8)

        def take(self, segment: int, counts: pa.Buffer, levels: pa.Buffer, sums: pa.Buffer) -> None:
            a, b = self.open.pop(segment)
            of, level = self.order[a], np.frombuffer(levels, np.uint8)
            self.counts[of], self.sums[of] = _widened(counts, len(of)), _widened(sums, len(of))
            self.level[of], self.both[b] = level[: len(of)], level[len(of) :]

        def scored(self) -> Iterator[pa.RecordBatch]:
            assert not self.open
            starts, at, quantised = self.starts, self.at, LEVELS[self.level]
            context = np.concatenate((at[:1], at[:-1]))  # what it says of a text's first token is not used
            sure, base = totals.base(self.counts[at], starts)
            result = {"n_tokens": np.diff(np.append(starts, len(at))), "n_known": sure, "base_score": base, "score": totals.score(starts, self.prior, quantised[at], quantised[context], LEVELS[self.both][self.back], self.sums[context])}
            structs = pa.StructArray.from_arrays([pa.array(result[f.name], type=f.type) for f in fields], fields=list(fields))
            for i in range(0, len(self.rows), 5000):
                part = self.rows.slice(i, 5000)
                yield pa.RecordBatch.from_arrays([*part.flatten(), structs.slice(i, 5000)], schema=out_arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                data = [batch.column(k)[i].as_buffer() for k in range(3, 9)]
                if data[2] is not None:
                    if held is not None:
                        yield from held.scored()
                    rows = batch.column(2)[i].values
                    held = Held(rows, *(np.frombuffer(x, t).copy() for x, t in zip(data[:3], ("<i8", "<u8", "<u4"), strict=True)))
                else:
                    held.take(batch.column(0)[i].as_py(), *data[3:])
        if held is not None:
            yield from held.scored()

    whole = whole.select("segment", "stretch", "rows", "starts", "distinct", "tokens", "counts", "levels", "sums")
    return whole.repartition("stretch").sortWithinPartitions("stretch", F.col("tokens").isNull()).mapInArrow(finish, out)


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; false for a null id."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
