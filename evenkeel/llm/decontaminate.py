"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark's normalised words.

Normalised text is its lower-cased (A-Z) words, joined and bounded by single spaces, as bytes; a window's pattern
starts and ends with a space, so that matches are whole words.  Each text is scanned once; the end of a match gives
the word it ends at, and words map back to offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import Scratch, annotate, col, fresh, ship

#: Letters and digits in lower case, and every byte of a non-ASCII character; all else separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")])
_PART = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(_RUN))])

#: Bytes of benchmark text in one automaton.  Each takes some 270 bytes of a worker's memory (46,121 bytes of text made
#: 316,039 nodes, 12.6 MB), so that an automaton stays at about 1.1 GB.  More text is dealt into several automata, for
#: each of which the documents are passed over once.
AUTOMATON_BYTES = 4_000_000
_AUTOMATA: dict[int, object] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(items: list[tuple[str, str | None]], size: int) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Pattern -> (its number of words, the ids of the items that have it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i : i + size]
            found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].add(item)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


def _automaton(token: int, items: list[tuple[str, str | None]], size: int):
    if token not in _AUTOMATA:
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, value in windows(items, size).items():
            a.add_word(pattern, value)
        if len(a):
            a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[token] = a
    return _AUTOMATA[token]


def runs(automaton, text: str | None) -> tuple[int, list[str], list[tuple[int, int, int, int]]]:
    """(words, sorted ids of the items found, maximal runs of hit words: first and last word, start and end in the text)."""
    w = words(text)
    if not w or not len(automaton):
        return len(w), [], []
    norm = b" " + b" ".join(w) + b" "
    found = list(automaton.iter(norm.decode("latin-1")))
    if not found:
        return len(w), [], []
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    last = np.searchsorted(gaps, np.array([e for e, _ in found]))  # the word before this gap is the match's last
    first = last - np.array([v[0] for _, v in found])
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    hit = np.cumsum(edge[:-1]) > 0
    change = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    places = [m.span() for m in _WORD.finditer(text)]
    return len(w), sorted({i for _, v in found for i in v[1]}), [(a, b - 1, places[a][0], places[b - 1][1]) for a, b in change.reshape(-1, 2).tolist()]


def scan(automaton, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """(words, hit words, sorted ids of the items found, spans of hit words in the original text)."""
    n, items, found = runs(automaton, text)
    return n, sum(b - a + 1 for a, b, _, _ in found), items, [(x, y) for _, _, x, y in found]


def dealt(items: list[tuple[str, str]], most: int, window: int) -> list[list[tuple[str, str]]]:
    """Items in groups of about `most` bytes of text; a larger one is cut into stretches that share window - 1 words, so
    that each of its windows is in one of them."""
    out, held = [[]], 0
    for item, text in items:
        pieces = [text]
        if len(text.encode("utf-8", "surrogatepass")) > most:
            w = [x.decode("utf-8", "surrogatepass") for x in words(text)]
            step = max(1, len(w) * most // (2 * len(text.encode("utf-8", "surrogatepass"))))
            pieces = [" ".join(w[i : i + step + window - 1]) for i in range(0, max(1, len(w) - window + 1), step)]
        for t in pieces:
            size = len(t.encode("utf-8", "surrogatepass"))
            if out[-1] and held + size > most:
                out.append([])
                held = 0
            out[-1].append((item, t))
            held += size
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (`keep`, all by default) and a struct of FIELDS; returns the DataFrame and that column's name.

    n_hit: words inside any occurrence of a window; spans: maximal runs of them, offsets in code points, end exclusive.
    Texts that are null, empty or without words have no words, no hits and no items.  Items without words match
    nothing; a null item_id is written as `null`; repeated items and windows that several items share count for each.
    An empty benchmark finds nothing.  Repeated documents are rows of their own.
    """
    ship(spark)
    pick = benchmark.select(col(item_col).cast("string").alias("i"), col(item_text).cast("string").alias("t"))
    held = pick.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    name, drawers = fresh(docs, "decontamination"), max(1, -(-2 * held // AUTOMATON_BYTES))
    if held <= AUTOMATON_BYTES:
        make = _kernel(spark, _items(pick), window, lambda a, t: dict(zip(FIELDS.names, _row(scan(a, t)), strict=True)), FIELDS)
        return annotate(docs, text_col, make, FIELDS, name, keep), name
    # The driver holds a drawer of the benchmark at a time.
    drawer = F.pmod(F.xxhash64("i", "t"), F.lit(drawers))
    parts = (p for k in range(drawers) for p in dealt(_items(pick.where(drawer == k)), AUTOMATON_BYTES, window) if p)
    return _in_parts(spark, docs, parts, window, text_col, name, list(docs.columns if keep is None else keep)), name


def _items(pick: DataFrame) -> list[tuple[str, str]]:
    return sorted(("null" if r["i"] is None else r["i"], r["t"] or "") for r in pick.collect())


def _row(found: tuple[int, int, list[str], list[tuple[int, int]]]) -> tuple:
    return (*found[:3], [{"start": a, "end": b} for a, b in found[3]])


def _kernel(spark: SparkSession, items: list[tuple[str, str]], window: int, one, fields: T.StructType):
    sent, token = spark.sparkContext.broadcast(items), hash((tuple(items), window))

    def make():
        automaton = _automaton(token, sent.value, window)

        def kernel(texts):
            found = [one(automaton, t) for t in texts]
            return {n: [f[n] for f in found] for n in fields.names}

        return kernel

    return make


def _in_parts(spark: SparkSession, docs: DataFrame, parts: Iterable[list[tuple[str, str]]], window: int, text_col: str, name: str, keep: list[str]) -> DataFrame:
    """The same with one automaton after the other: what each finds is written, and put together for each document."""
    scratch, key, n_words = Scratch(spark, "decontamination"), fresh(docs, "__key"), fresh(docs, "__n_words")
    docs = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "docs")

    def one(automaton, text):
        n, items, found = runs(automaton, text)
        return {"n_words": n, "item_ids": items, "runs": [dict(zip(_RUN.names, r, strict=True)) for r in found]}

    found = []
    for k, items in enumerate(parts):
        every = annotate(docs, text_col, _kernel(spark, items, window, one, _PART), _PART, "p", [key])
        kept = every.select(key, "p.*") if k == 0 else every.where("size(p.runs) > 0").select(key, "p.*")
        found.append(scratch.keep(kept, f"part-{k}"))
    hits = found[0].where("size(runs) > 0")
    for f in found[1:]:
        hits = hits.unionByName(f)
    hits = hits.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.when(r["last"] > last["last"], r).otherwise(last)
        joined = F.struct(last["first"].alias("first"), longer["last"].alias("last"), last["start"].alias("start"), longer["end"].alias("end"))
        return F.when((F.size(acc) > 0) & (r["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    runs_type = f"array<{_RUN.simpleString()}>"
    hits = hits.withColumn("runs", F.aggregate("runs", F.array().cast(runs_type), step))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    hits = hits.select(key, n_hit.alias("n_hit"), "item_ids", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))
    found_in = fresh(docs, "__hits")
    hits = hits.select(key, F.struct("n_hit", "item_ids", "spans").alias(found_in))
    out = docs.join(found[0].select(key, F.col("n_words").alias(n_words)), key).join(hits, key, "left")
    none = {"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast(FIELDS["item_ids"].dataType), "spans": F.array().cast(FIELDS["spans"].dataType)}
    made = F.struct(F.col(n_words).alias("n_words"), *[F.coalesce(F.col(found_in)[c], v).alias(c) for c, v in none.items()])
    return out.select(*map(col, keep), made.alias(name))
