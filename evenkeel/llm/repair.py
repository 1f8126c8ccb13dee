"""Token ids in files, compressed by Re-Pair grammars.

Documents are put in ascending order of their ids and cut into shards of whole documents.  In each shard the most
frequent pairs of neighbouring symbols are replaced by new ones (nonterminals), again and again, in rounds of many pairs
at a time; no pair crosses the border of two documents.  A shard file holds the rules, the lengths that they expand to,
where each document starts in the compressed sequence, and that sequence, so that any document can be decoded alone.

Shard file, all integers little-endian:
    8 bytes   magic `EVKRPR01`
    6 x u32   first nonterminal V, number of rules R, documents D, symbols S, rounds K, bytes of a symbol (2 or 4)
    K x u32   rules made by each round
    R x 2 symbols   left and right of each rule
    R x u32   ids that each rule expands to
    D x u32   ids of each document
    D x u32   first symbol of each document
    S symbols
Shards are stored as binary values of a Parquet table, which any of Spark's file systems can hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import Scratch, col, ship, slices
from evenkeel.llm.tokenise import encoder

MAGIC = b"EVKRPR01"
AT_ONCE = (8192, 8_000_000)  # texts and bytes that are encoded together
SHARD_IDS = 1 << 19  # a shard ends with the document that reaches this
SLOT_BITS = 18
#: Symbols that two bytes can tell apart.  Wider ones would double the sequence and the rules, which no rule earns.
SYMBOLS = 1 << 16
#: A round replaces the pairs that are seen at least this share as often as its most frequent one, or a quarter as
#: often as the round before asked for if that is less.
NEXT_BEST = 0.125


def _slots(keys: np.ndarray) -> np.ndarray:
    """A hash of SLOT_BITS bits of each pair."""
    if keys.dtype == np.uint32:
        return keys * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)


def _settled(where: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places (ascending, with their pairs' ranks) are replaced, so that no two overlap.

    Of two pairs that overlap the better ranked goes first; a pair that overlaps itself takes every other place.
    """
    near = np.diff(where) == 1
    better, same = near & (rank[:-1] < rank[1:]), near & (rank[:-1] == rank[1:])
    keep = np.ones(len(where), bool)
    keep[1:] &= ~better
    keep[:-1] &= ~(near & (rank[1:] < rank[:-1]))
    if same.any():
        run = np.flatnonzero(np.concatenate(([True], ~same)))
        place = np.arange(len(where)) - np.repeat(run, np.diff(np.concatenate((run, [len(where)]))))
        keep &= place % 2 == 0
    return keep


def _enough_alone(found: np.ndarray, places: np.ndarray, edge: np.ndarray, counts: np.ndarray, best: np.ndarray, half, pays: int) -> np.ndarray:
    """Which of the pairs pay where no other is replaced: all but those that overlap themselves too much."""
    low = type(half)((1 << int(half)) - 1)
    pairs = found[edge[best]]
    keep = np.ones(len(best), bool)
    for k in np.flatnonzero((pairs >> half == pairs & low) & (counts[best] < 2 * pays)).tolist():  # with more, every other one is enough
        at = places[edge[best[k]] : edge[best[k]] + counts[best[k]]]
        ends = np.flatnonzero(np.concatenate((np.diff(at) != 1, [True])))
        runs = np.diff(np.concatenate(([-1], ends)))
        keep[k] = ((runs + 1) // 2).sum() >= pays
    return keep


def compress(docs: list[np.ndarray], terminals: int) -> bytes:
    """The shard file of documents given as arrays of ids below `terminals`.

    Rounds go on until no pair pays for its rule: one whose replacements, each of which saves a symbol, save more bytes
    than the rule takes.  (They end sooner only where two bytes hold no more symbols, see SYMBOLS.)
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    narrow = terminals < SYMBOLS
    room = SYMBOLS - terminals if narrow else 1 << 30
    width = 2 if narrow else 4
    pays = (2 * width + 4) // width + 1  # replacements; a rule takes its two symbols and the length it expands to
    whole, half = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    if any(len(d) and int(d.max()) >= terminals for d in docs):
        raise ValueError(f"an id is {max(int(d.max()) for d in docs if len(d))}, but rules start at {terminals}")
    seq = np.concatenate(docs).astype(whole) if docs else np.zeros(0, whole)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    left, right, rounds = [], [], []
    expands = np.ones(0, np.int64)
    at, newest, least = terminals, 0, 1 << 62
    while len(seq) > 1 and room:
        across = begin[1:] - 1  # pairs of a document's last symbol and the next one's first
        if newest:  # only pairs with the symbols of the last round have come up
            new = seq >= whole(newest)
            some = new[:-1] | new[1:]
            some[across] = False
            some = np.flatnonzero(some)
            keys = seq[some] << half | seq[some + 1]
        else:
            # Pairs are counted by a hash first; only those in places that hold enough are sorted.
            every = seq[:-1] << half | seq[1:]
            slot = _slots(every).astype(np.intp)
            held = np.bincount(slot, minlength=1 << SLOT_BITS)
            np.subtract.at(held, slot[across], 1)
            least = max(pays, min(int(held.max() * NEXT_BEST), least // 4))
            some = np.take(held >= least, slot)
            some[across] = False
            some = np.flatnonzero(some)
            keys = every[some]
        if narrow:
            ordered = np.sort(keys.astype(np.uint64) << np.uint64(32) | some.astype(np.uint64))
            found, places = ordered >> np.uint64(32), (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
        else:
            order = np.argsort(keys, kind="stable")
            found, places = keys[order], some[order]
        edge = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate((edge, [len(found)])))
        chosen = np.zeros(0, np.int64)
        best = np.flatnonzero(counts >= least)
        if len(best):
            best = best[_enough_alone(found, places, edge, counts, best, half, pays)]
        if len(best):
            best = best[np.argsort(-counts[best], kind="stable")[:room]]  # in the order of their ranks
            n = counts[best]
            pick = np.arange(n.sum()) + np.repeat(edge[best] - np.cumsum(n) + n, n)
            where, rank = places[pick], np.repeat(np.arange(len(best), dtype=np.int32), n)
            if 16 * len(where) < len(seq):
                order = np.argsort(where)
                where, rank = where[order], rank[order]
            else:
                ranks = np.full(len(seq), -1, np.int32)  # by place, which puts them in order
                ranks[where] = rank
                where = np.flatnonzero(ranks >= 0)
                rank = ranks[where]
            keep = _settled(where, rank)
            where, rank = where[keep], rank[keep]
            enough = np.bincount(rank, minlength=len(best)) >= pays
            chosen = np.sort(best[enough])  # in the order of their symbols; the best one is among them
            good = enough[rank]
            where, rule = where[good], np.searchsorted(chosen, best)[rank[good]]
        if not len(chosen):
            if newest:
                newest = 0  # all pairs once more
                continue
            if least > pays:  # places that several pairs share seemed to hold a frequent one
                continue
            break
        newest = at if least == pays else 0
        pairs = found[edge[chosen]].astype(whole)
        seq[where] = (at + rule).astype(whole)
        kept = np.ones(len(seq), bool)
        kept[where + 1] = False
        seq = seq[kept]
        begin = begin - np.searchsorted(where, begin)
        a, b = (pairs >> half).astype(np.int64), (pairs & whole((1 << int(half)) - 1)).astype(np.int64)
        sized = np.concatenate((expands, [1]))  # the last stands for an id itself
        expands = np.concatenate((expands, sum(sized[np.where(x < terminals, len(expands), x - terminals)] for x in (a, b))))
        left.append(a)
        right.append(b)
        rounds.append(len(pairs))
        at += len(pairs)
        room -= len(pairs)
    kind = f"<u{width}"
    rules = np.stack((np.concatenate(left), np.concatenate(right)), axis=1) if left else np.zeros((0, 2), np.int64)
    first = np.zeros(len(docs), np.int64)
    first[sizes > 0] = begin
    return b"".join((
        MAGIC, struct.pack("<6I", terminals, len(rules), len(docs), len(seq), len(rounds), width), np.array(rounds, "<u4").tobytes(),
        rules.astype(kind).tobytes(), expands.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), first.astype("<u4").tobytes(), seq.astype(kind).tobytes(),
    ))


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes | pa.Buffer):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard file")
        self.terminals, rules, docs, symbols, rounds, width = struct.unpack_from("<6I", data, 8)
        at, kind = 32, f"<u{width}"
        self._expanded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def take(n: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.rounds = take(rounds, "<u4")
        self.rules = take(2 * rules, kind).reshape(-1, 2)
        self.expands = take(rules, "<u4")
        self.sizes = take(docs, "<u4")
        self.begin = take(docs, "<u4").astype(np.int64)
        self.symbols = take(symbols, kind)
        if at != len(data):
            raise ValueError("the shard file is cut short or has more at its end")

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What every symbol stands for, one after the other (ids first, then rules, made round by round), where each
        starts and how long it is."""
        if self._expanded is None:
            size = np.concatenate((np.ones(self.terminals, np.int32), self.expands.astype(np.int32)))
            start = np.cumsum(size, dtype=np.int64) - size
            table = np.arange(int(size.sum()), dtype=np.uint32)
            done = self.terminals
            for n in self.rounds.tolist():
                new = self.rules[done - self.terminals : done - self.terminals + n].ravel()  # left and right of each rule
                made = self._gathered(new, table, start, size)
                table[start[done] : start[done] + len(made)] = made
                done += n
            self._expanded = table, start, size
        return self._expanded

    def _gathered(self, seq: np.ndarray, table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = np.take(size, seq)
        upto = np.cumsum(n, dtype=np.int64)
        at = np.repeat(np.take(start, seq) - upto + n, n)
        at += np.arange(len(at))
        return np.take(table, at)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        return self._gathered(seq, *self._table())

    def ids(self) -> np.ndarray:
        """All documents' ids, one after the other."""
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        """The ids of document k alone."""
        if not self.sizes[k]:
            return np.zeros(0, np.uint32)
        after = self.begin[k + 1 :][self.sizes[k + 1 :] > 0]
        return self._expand(self.symbols[self.begin[k] : after[0] if len(after) else len(self.symbols)])


def vocabulary(tokenizer: str, end_id: int) -> int:
    """The number of ids that a tokenizer's file and the end id take."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return max(end_id, *ids) + 1


def write(spark: SparkSession, docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 2, terminals: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids, in ascending id order, to shard files; returns the table that holds them.

    Columns: part and shard (in this order, shards follow one another), before (ids in the part's shards before it),
    keys (the documents' ids), n (ids in the shard), data (the file).  A null or empty text is its end id alone; null ids come first; rows of equal id are in
    the order of a hash of their texts.  An empty table has no shards.  Rules' symbols start at `terminals`, by default
    the size of the vocabulary; an id at or above it is an error.
    """
    ship(spark)
    terminals = vocabulary(tokenizer, end_id) if terminals is None else terminals
    key = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("before", T.LongType()), T.StructField("keys", T.ArrayType(key)), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        keys: list = []
        held: list[np.ndarray] = []
        n = before = 0

        def row() -> pa.RecordBatch:
            made = [[part], [shard], [before], [keys], [n], [compress(held, terminals)]]
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for a, b in slices(batch.column(1), *AT_ONCE):
                rows = batch.slice(a, b - a)
                flat, offsets = enc.encode_flat(rows.column(1), end_id)
                for k, x, y in zip(rows.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    keys.append(k)
                    held.append(flat[x:y])
                    n += y - x
                    if n >= SHARD_IDS:
                        yield row()
                        before += n
                        shard, keys, held, n = shard + 1, [], [], 0
        if held:
            yield row()

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    ordered = docs.select(col(id_col).alias("key"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")
    return scratch.keep(ordered.mapInArrow(run, schema), "shards")


def read(spark: SparkSession, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before), n_tokens, ids (binary, little-endian unsigned 32-bit), from files.

    The driver collects one count for each part.
    """
    totals, before = [], 0
    for r in shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        totals.append((r["part"], before))
        before += r["n"]
    heads = spark.createDataFrame(totals, "part long, head long")
    placed = shards.join(F.broadcast(heads), "part").select((F.col("head") + F.col("before")).alias("base"), "keys", "data")  # one row for each part
    key = shards.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, key), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, keys, shard = batch.column(0)[i].as_py(), batch.column(1)[i].values, Shard(batch.column(2)[i].as_buffer())
                raw, sizes = shard.ids().astype("<u4", copy=False), shard.sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                for a in range(0, len(sizes), 1000):
                    b = min(len(sizes), a + 1000)
                    low, high = int(ends[a] - sizes[a]), int(ends[b - 1])
                    offsets = np.concatenate(([0], ends[a:b] - low)) * 4
                    if offsets[-1] < 1 << 31:
                        ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[low:high])])
                    else:
                        ids = pa.array([raw[low + x // 4 : low + y // 4].tobytes() for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.binary())
                    made = [keys.slice(a, b - a), pa.array(base + ends[a:b] - sizes[a:b]), pa.array(sizes[a:b]), ids]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return placed.mapInArrow(run, schema)
