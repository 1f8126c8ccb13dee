"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is cut into segments and mapped to the vector of its segments' bit counts.  The Manhattan distance of two
such vectors is never more than the Hamming distance of the fingerprints, so a grid range join over the vectors finds
every pair; each is then verified on the bits.

`link_close` is exact for at most two differing bits: two vectors at Manhattan distance 2 or less lie in, or next to, a
common grid cell, and each fingerprint enters its own cell and those next to it.  Cells with many fingerprints are
refined, without a cap, by the fingerprints that lie halfway (`hubs`), so that no cell yields all its pairs.

`similar_groups` is for the similarity (Jaccard, 0.8 by default) of the sets of word shingles.  Pairs at that threshold
differ in an eighth of a fingerprint's bits, where the popcount bound selects nothing and every rule over bits loses
links.  The fingerprints' links of two bits therefore come first, and the links that they cannot see are found by
minima of hashes (MinHash) in bands, as many as let a pair at the threshold meet with the stated probability.  Every
link is verified by the exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import ASCII_LOWER, Scratch, annotate, col, fresh, join_hot, ship
from evenkeel.llm.components import components
from evenkeel.operators.windows import few

#: Bit j of byte value v, for counting bits by byte.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_PLACE = (np.arange(8) * 256)[None, :]
_NIBBLES = 0x1111111111111111
_STEP = 200_000  # shingles counted at a time

#: A table of at most so many rows (of 8 bytes) is sent to all workers; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have bit 0, 1, ... 63 set."""
    held = np.bincount((hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    return (held.reshape(8, 256) @ _BITS).ravel()


def shingle_hashes(words: list[bytes], size: int):
    """Arrays of the XXH64 (seed 42) of space-joined shingles, repeats included, a bounded number at a time."""
    from xxhash import xxh64_intdigest

    norm = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(norm)]))
    k = max(1, len(words) - size + 1)
    for i in range(0, k, _STEP):
        low = starts[i : min(k, i + _STEP)].tolist()
        high = ends[min(len(words), size) - 1 + i :][: len(low)].tolist()
        yield np.array([xxh64_intdigest(norm[a:b], 42) for a, b in zip(low, high, strict=True)], np.uint64)


def fingerprint(text: str | None, size: int = 5) -> int:
    """Signed 64-bit SimHash; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    total, n = np.zeros(64), 0
    for h in shingle_hashes(words, size):
        total += _bit_counts(h)
        n += len(h)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


PRINT = T.StructType([T.StructField("fingerprint", T.LongType())])


def fingerprints(spark: SparkSession, docs: DataFrame, size: int = 5, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (`keep`, all by default) and a struct with the signed 64-bit fingerprint; and that column's name.

    Texts that are null, empty or of white space have fingerprint 0; one shorter than a shingle is one shingle.
    """
    ship(spark)

    def make():
        return lambda texts: {"fingerprint": [fingerprint(t, size) for t in texts]}

    name = fresh(docs, "simhash")
    return annotate(docs, text_col, make, PRINT, name, keep), name


def _cell(x):
    """Bit counts of the sixteen 4-bit segments, each in its own 4 bits."""
    parts = [F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_NIBBLES)) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def link_close(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that chains of pairs with 2 or fewer differing bits connect.

    distinct: one column `f` of distinct signed 64-bit fingerprints.  Each cell of two is one candidate pair; in a
    larger cell each fingerprint is linked to the least one that shares a halfway point with it (both at distance 1 or
    less from that point, hence 2 or less from one another).  Rows grow in proportion to the input.
    """
    near = distinct.withColumn("c", _cell(F.col("f")))
    up = "transform(filter(sequence(0, 15), i -> (shiftright(c, 4 * i) & 7) < 4), i -> struct(c + shiftleft(1L, 4 * i) AS cell, i AS seg, 0L AS was))"
    down = "transform(filter(sequence(0, 15), i -> (shiftright(c, 4 * i) & 7) > 0), i -> struct(c - shiftleft(1L, 4 * i) AS cell, i AS seg, 1L AS was))"
    members = near.select("f", F.explode(F.expr(f"concat(array(struct(c AS cell, -1 AS seg, 0L AS was)), {up}, {down})")).alias("m")).select("f", "m.cell", "m.seg", "m.was")
    cells = scratch.keep(members.groupBy("cell").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).where("n > 1"), "cells")
    pairs = cells.where("n = 2 AND bit_count(a ^ b) <= 2").select("a", "b")
    busy = cells.where("n > 2").select("cell")
    if busy.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        busy = F.broadcast(busy)
    bits = "transform(filter(sequence(4 * seg, 4 * seg + 3), k -> (shiftrightunsigned(f, k) & 1) = was), k -> f ^ shiftleft(1L, k))"
    hubs = scratch.keep(members.join(busy, "cell").select("f", F.explode(F.expr(f"if(seg < 0, array(f), {bits})")).alias("hub")), "hubs")
    least = hubs.groupBy("hub").agg(F.count("*").alias("n"), F.min("f").alias("a")).where("n > 1").select("hub", "a")
    starred = hubs.join(least, "hub").where("f != a AND bit_count(a ^ f) <= 2").select("a", F.col("f").alias("b"))
    return pairs.unionByName(starred).distinct()


def close_groups(spark: SparkSession, docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (signed 64-bit) and component_id: the smallest id reachable over links of 2 or fewer bits.

    Exact copies share a fingerprint and are handled once.  Texts without words have fingerprint 0 and are linked like
    any other.  Rows with a null id keep their place and take their component's id, null if none there has one;
    repeated rows stay.  An empty table gives no rows.  Other columns are not read.
    """
    scratch = Scratch(spark, "simhash")
    made, name = fingerprints(spark, docs, size, text_col, [id_col])
    prints = scratch.keep(made.select(col(id_col).alias("id"), F.col(f"{name}.fingerprint").alias("f")), "prints")
    firsts = prints.groupBy("f").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    edges = link_close(scratch, prints.select("f").distinct())
    return _labelled(scratch, prints, firsts, edges).select(F.col("id").alias(id_col), F.col("f").alias("fingerprint"), F.col("component").alias("component_id"))


def _labelled(scratch: Scratch, prints: DataFrame, firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """prints and the smallest id of each print's component.  firsts: f, first (id) and n (rows)."""
    linked = scratch.keep(components(scratch, edges).join(firsts, F.col("node") == F.col("f")).select("f", "root", "first"), "linked")
    labels = linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("m"))
    labels = join_hot(linked.select("f", "root"), labels, "root", "m", linked.count()).select("f", "component")
    every = firsts.join(labels, "f", "left").select("f", "n", F.coalesce("component", "first").alias("component"))
    return join_hot(prints, every, "f", "n", prints.count()).drop("n")


# Similarity of shingle sets ---------------------------------------------------------------------------------------

ROWS = 6  # minima that a band holds
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_needed(similarity: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**ROWS))


@lru_cache
def _factors(bands: int) -> np.ndarray:
    """Odd factors of the hash functions, fixed by a seed."""
    return np.random.default_rng(20).integers(0, 1 << 63, (bands * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_cells(grams: np.ndarray, bands: int) -> np.ndarray:
    """The cell of each band: a hash of the band's number and its minima over the shingles."""
    least = np.full(bands * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), 2048):
            x = grams[None, i : i + 2048] * _factors(bands)
            x ^= x >> np.uint64(32)
            least = np.minimum(least, x.min(axis=1))
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for row in least.reshape(bands, ROWS).T:
            out = mix(out * _GOLD + row)
    return out.view(np.int64)


def distinct_shingles(text: str | None, size: int, cache: dict[bytes, int]) -> np.ndarray | None:
    """Hashes of the distinct shingles, ascending; None for a text without words."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return None
    if len(cache) > 400_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxh64_intdigest(w, 7)
    h = np.array([cache[w] for w in words], np.uint64)
    k = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        grams = np.zeros(k, np.uint64)
        for j in range(min(size, len(words))):
            grams = mix(grams * _GOLD + h[j : j + k])
    return np.unique(grams)


def set_print(grams: np.ndarray) -> int:
    """Signed 64-bit SimHash over distinct shingles."""
    total = sum(_bit_counts(g) for g in np.array_split(grams, 1 + len(grams) // _STEP))
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view("<i8")[0])


_MADE = T.StructType([T.StructField("f", T.LongType()), T.StructField("print", T.LongType()), T.StructField("size", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType(), False))])
_SET = T.StructType([T.StructField("grams", T.ArrayType(T.LongType(), False))])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

HUBS = 4  # orders by which the text is picked that a cell's others are compared with first
PAIRS_A_TASK = 10_000
BLOCK = 512  # members of a full cell that are compared with another such block, or with one another, at a time
BLOCK_SHINGLES = 1 << 20  # shingles of a block, about; bounds a task where texts are long


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(f, grams) for the texts that are wanted.  docs: (row, text), wanted: (f, row)."""

    def make():
        cache: dict[bytes, int] = {}
        return lambda found: {"grams": [distinct_shingles(t, size, cache).view(np.int64) for t in found]}

    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = annotate(docs.join(wanted, "row"), "text", make, _SET, "set", ["f"])
    return sets.select("f", F.col("set.grams").alias("grams"))


def verified(scratch: Scratch, pairs: DataFrame, firsts: DataFrame, texts: DataFrame, size: int, similarity: float, label: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingle hashes have a Jaccard similarity of `similarity` or more.

    firsts: (f, row), texts: (row, text).  The sets are made anew for the texts that some pair names.
    """
    pairs = scratch.keep(pairs, f"{label}-candidates")
    named = scratch.keep(pairs.select(F.col("a").alias("f")).union(pairs.select("b")).distinct().join(firsts.select("f", "row"), "f"), f"{label}-named")
    sets = scratch.keep(shingle_sets(texts, named, size), f"{label}-sets")
    # A text of very many pairs is copied, so that no task gets more than PAIRS_A_TASK of them.
    total, dealt, copies = pairs.count(), pairs, {}
    for key in ("a", "b"):
        each = pairs.groupBy(key).agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / PAIRS_A_TASK))
        dealt = join_hot(dealt, each, key, "n", total).withColumn(f"{key}_copy", F.expr("pmod(xxhash64(a, b), copies)")).drop("n", "copies")
        some = sets.select(F.col("f").alias(key), F.col("grams").alias(f"{key}_grams")).join(each, key)
        copies[key] = some.withColumn(f"{key}_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).drop("n", "copies")
    both = dealt.join(copies["a"], ["a", "a_copy"]).join(copies["b"], ["b", "b_copy"]).select("a", "b", F.col("a_grams").alias("x"), F.col("b_grams").alias("y"))
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return scratch.keep(common.where(F.col("common") / (F.col("n") - F.col("common")) >= similarity).select("a", "b"), label)


def forest(f: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between the sides (or among all where there is one) that join what the similar pairs join, without cycles.

    Members of one root count as joined already.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    cross, out = (side != side[0]).any(), []
    for i in range(len(sets)):
        if cross and side[i] != side[0]:
            continue
        low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        common = np.bincount(owner[at], minlength=len(sets))
        good = common / (sizes + sizes[i] - common) >= similarity
        good &= root != root[i]
        good &= (side != side[0]) if cross else np.arange(len(sets)) > i
        for j in np.flatnonzero(good).tolist():
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(min(f[i], f[j])), int(max(f[i], f[j]))))
    return out


def dense_links(scratch: Scratch, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: similar pairs that share a cell, as many as join all that such pairs join.

    members: (cell, f, size, root), members of one root being joined already.  Cells of one root are passed over.  A cell
    is dealt at random into blocks of about BLOCK members and BLOCK_SHINGLES shingles, and each two blocks (and each block by itself) are compared
    apart on the sets themselves, so that nothing is capped, no task holds a whole cell, and only links come out.
    """
    mixed = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("cell", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    mixed = few(mixed, "mixed-cells")
    dealt = members.join(mixed, "cell").withColumn("side", F.expr("pmod(xxhash64(f, 'side'), blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).join(sets, "f")
    place = ["cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")]
    dealt = dealt.select(*place, "f", "root", "side", "grams").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    arrow = to_arrow_schema(_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            f, root, side = (np.array([h[k] for h in held]) for k in range(3))
            found = forest(f, root, side, [h[3] for h in held], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], schema=arrow)

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rest = [batch.column(k).to_pylist() for k in range(3, 6)]
            for r, key in enumerate(keys):
                if key != now and held:
                    yield from links()
                    held = []
                now = key
                held.append((*(x[r] for x in rest), batch.column(6)[r].values.to_numpy(zero_copy_only=False)))
        if held:
            yield from links()

    return scratch.keep(dealt.mapInArrow(run, _PAIR).distinct(), "dense")


def similar_groups(spark: SparkSession, docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """id_col, fingerprint (64-bit SimHash of the set; null without words) and component_id: groups linked by pairs of
    `similarity` or more.

    similarity is the Jaccard similarity of the sets of `size`-word shingles (64-bit hashes), computed for each link, so
    that no pair below it is one.  Candidates are texts whose fingerprints are linked by two bits or fewer, and texts
    that share the cell of a band of minima; a pair at the threshold shares one with probability `recall`, closer pairs
    more surely.  In a cell each text is compared with one of them (another in each band); then, in cells that still hold
    several components, all that are not joined yet are compared (`dense_links`), so that no link in a cell is left out.

    key_col names a column of values that no two rows share and that are the same whenever docs is read; without it the
    rows are written with one.  Texts without words are linked to nothing and are their own component.  Rows with a null
    id stay and take their component's id; repeated rows stay.  An empty table gives no rows.  Very long texts are taken
    whole.  Other columns are not read.
    """
    ship(spark)
    from xxhash import xxh64_intdigest

    scratch, bands = Scratch(spark, "simhash-sets"), bands_needed(similarity, recall)

    def make():
        cache: dict[bytes, int] = {}

        def kernel(texts):
            grams = [distinct_shingles(t, size, cache) for t in texts]
            return {
                "f": [None if g is None else np.uint64(xxh64_intdigest(g.tobytes(), 3)).view(np.int64) for g in grams],
                "print": [None if g is None else set_print(g) for g in grams],
                "size": [None if g is None else len(g) for g in grams],
                "cells": [None if g is None else band_cells(g, bands) for g in grams],
            }

        return kernel

    if key_col is None:
        key_col = fresh(docs, "__row")
        docs = scratch.keep(docs.select(*{id_col: col(id_col), text_col: col(text_col)}.values(), F.monotonically_increasing_id().alias(key_col)), "rows")
    name = fresh(docs, "simhash")
    made = annotate(docs, text_col, make, _MADE, name, list(dict.fromkeys([id_col, key_col])))
    prints = scratch.keep(made.select(col(id_col).alias("id"), col(key_col).alias("row"), f"{name}.*"), "prints")
    worded = prints.where("f IS NOT NULL")
    firsts = worded.groupBy("f").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min_by(F.struct("row", "print", "size", "cells"), "row").alias("r"))
    firsts = scratch.keep(firsts.select("f", "first", "n", "r.*"), "firsts")
    texts = docs.select(col(key_col).alias("row"), col(text_col).alias("text"))

    # Links of fingerprints; one text stands for those of one fingerprint.
    alike = scratch.keep(firsts.groupBy("print").agg(F.min("f").alias("hub")), "alike")
    close = link_close(scratch, alike.select(F.col("print").alias("f")))
    hub = lambda c: alike.select(F.col("print").alias(c), F.col("hub").alias(f"{c}_hub"))
    pairs = close.join(hub("a"), "a").join(hub("b"), "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    pairs = pairs.unionByName(firsts.select("f", "print").join(alike, "print").select(F.col("hub").alias("a"), F.col("f").alias("b")))

    # Cells of the bands.
    members = firsts.select("f", "size", F.explode("cells").alias("cell"))
    hub = F.min_by("f", F.xxhash64("f", F.pmod("cell", F.lit(HUBS))))
    cells = scratch.keep(members.groupBy("cell").agg(F.count("*").alias("m"), hub.alias("hub")).where("m > 1"), "band-cells")
    shared = scratch.keep(join_hot(members, cells, "cell", "m", firsts.count() * bands), "shared")
    pairs = pairs.unionByName(shared.select(F.col("hub").alias("a"), F.col("f").alias("b")))
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = verified(scratch, pairs, firsts, texts, size, similarity, "edges")

    # Cells that are not of one component yet.
    roots = components(scratch, edges, "first").withColumnRenamed("node", "f")
    rooted = shared.where("m > 2").select("cell", "f", "size").join(roots, "f", "left").select("cell", "f", "size", F.coalesce("root", "f").alias("root"))
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("cell")
    left = scratch.keep(rooted.join(few(mixed, "mixed-cells"), "cell"), "left")
    wanted = scratch.keep(left.select("f").distinct().join(firsts.select("f", "row"), "f"), "left-named")
    edges = edges.unionByName(dense_links(scratch, left, scratch.keep(shingle_sets(texts, wanted, size), "left-sets"), similarity))

    done = _labelled(scratch, worded.select("id", "f", "print"), firsts.select("f", "first", "n"), edges)
    # What is returned reads prints, firsts and the labels only.
    scratch.drop("alike", "cells", "hubs", "band-cells", "shared", "edges", "edges-candidates", "edges-named", "edges-sets", "left", "left-named", "left-sets", "dense")
    alone = prints.where("f IS NULL").select("id", "f", "print", F.col("id").alias("component"))
    return done.select("id", "f", "print", "component").unionByName(alone).select(F.col("id").alias(id_col), F.col("print").alias("fingerprint"), F.col("component").alias("component_id"))
