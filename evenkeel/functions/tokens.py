"""Edit distance between token sequences, and the choice among candidates of a calibrated edit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode's white space: what (?U) makes of \s.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def spaced(text: Column) -> Column:
    """The words with one blank between them; what is so already is passed over."""
    return F.regexp_replace(trimmed(text), r"(?U) \s+|[^\S ]\s*", " ")


def words(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


#: Tokenizers by name; others are added as functions from a text column to an array column.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words": words, "letters": lambda text: F.split(text, "")}


def tokenized(text: Column, name: str = "words") -> Column:
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer {name}; there are {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name](text)


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable tokens, or of two arrays of their numbers.

    What both start and end with in common is left out.  A rest without any token in common is replaced token by token.
    Else it is followed along diagonals, as far as each number of edits reaches, which takes steps in proportion to the
    square of the distance, and the tokens it passes; from a distance on where the whole table is cheaper, bits stand for
    the table's columns.
    """
    if not isinstance(a, np.ndarray) or not isinstance(b, np.ndarray):
        codes: dict = {}
        a, b = (np.fromiter((codes.setdefault(t, len(codes)) for t in s), np.int64, len(s)) for s in (a, b))
    start, short = _run(a, b, 0, 0), min(len(a), len(b))
    end = min(_run(a[::-1], b[::-1], 0, 0), short - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(a) or not len(b) or set(a.tolist()).isdisjoint(b.tolist()):
        return max(len(a), len(b))
    # A step along a diagonal costs as much as some hundred words of 64 bits; it may take a quarter of what these would.
    most = int((len(a) * len(b) / 64 / 400) ** 0.5) + 4
    if abs(len(a) - len(b)) <= most:
        if (found := _by_diagonals(a, b, most)) is not None:
            return found
    return _by_bits(a, b)


def _by_diagonals(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """The distance if it is at most `most`.  Of each diagonal, numbered by the place in y less that in x, the furthest
    place in x that so many edits reach is kept (Ukkonen 1985)."""
    n, m = len(x), len(y)
    goal, none = m - n, -(1 << 40)
    if abs(goal) > most:
        return None
    reach = {0: _run(x, y, 0, 0)}
    if reach[0] >= n and goal == 0:
        return 0
    for d in range(1, most + 1):
        now = {}
        for k in range(max(-d, -n), min(d, m) + 1):
            i = max(reach.get(k, none) + 1, reach.get(k + 1, none) + 1, reach.get(k - 1, none))
            i = min(i, n, m - k)
            if i < max(0, -k):
                continue
            now[k] = _run(x, y, i, k)
        reach = now
        if reach.get(goal, none) >= n:
            return d
    return None


def _run(x: np.ndarray, y: np.ndarray, i: int, k: int) -> int:
    """The place in x up to which x and y agree from i and i + k on."""
    step, end = 16, min(len(x), len(y) - k)
    while i < end:
        differ = np.flatnonzero(x[i : min(end, i + step)] != y[i + k : min(end, i + step) + k])
        if len(differ):
            return i + int(differ[0])
        i = min(end, i + step)
        step *= 4
    return i


def _by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """A column of the table is two long integers (where it rises, where it falls), and the next follows from it by a few
    operations on them (Myers 1999, Hyyro 2003)."""
    a, b = a.tolist(), b.tolist()
    where: dict = {}
    for i, t in enumerate(a):
        where.setdefault(t, []).append(i)
    places = {}
    for t, here in where.items():
        if len(here) < 64:
            bits = 0
            for i in here:
                bits |= 1 << i
        else:
            marks = np.zeros(len(a), np.uint8)
            marks[here] = 1
            bits = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
        places[t] = bits
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, out = whole, 0, len(a)
    for t in b:
        same = places.get(t, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same
        right = fall | whole & ~(diagonal | rise)
        left = rise & diagonal
        if right & last:
            out += 1
        elif left & last:
            out -= 1
        right = (right << 1 | 1) & whole
        free = same | fall
        rise = left << 1 & whole | whole & ~(free | right)
        fall = right & free
    return out


#: Tokens that are turned into numbers at once.
TOKENS_AT_ONCE = 1 << 20


@F.arrow_udf(T.IntegerType())
def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Tokens become numbers where they stand, some rows at a time, so that no Python object is made for any of them."""
    out: list[int | None] = []
    length = lambda s: pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
    sizes = np.cumsum(length(a).astype(np.int64) + length(b))
    at = 0
    while at < len(a):
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + TOKENS_AT_ONCE, "right")))
        x, y = a.slice(at, end - at), b.slice(at, end - at)
        first, second = x.flatten(), y.flatten()
        codes = _codes(first, second)
        missing = pc.or_(x.is_null(), y.is_null()).to_pylist()
        i, j = 0, len(first)
        for n, m, none in zip(length(x).tolist(), length(y).tolist(), missing, strict=True):
            out.append(None if none else edit_distance(codes[i : i + n], codes[j : j + m]))
            i, j = i + n, j + m
        at = end
    return pa.array(out, pa.int32())


def _codes(*tokens: pa.Array) -> np.ndarray:
    """A number for each token, the same for equal ones; a null is a token of its own."""
    found = pa.chunked_array(tokens).combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of tokens, of any length; null where either is.

    In batches in Python: the built-in function counts characters, and takes the square of a long text's length.
    """
    return _distances(a, b)


def change_pct(a: Column, b: Column) -> Column:
    """Distance in percent of the original's tokens; for an empty original 0 if both are empty, else 100."""
    empty = F.when(F.size(b) == 0, 0.0).otherwise(100.0)
    return F.when(F.size(a) == 0, empty).otherwise(distance(a, b) * 100.0 / F.when(F.size(a) == 0, 1).otherwise(F.size(a)))


def target_edits(pct: Column, tokens: Column, at_least_one: bool = True) -> Column:
    """pct of the tokens, rounded half to even."""
    n = F.bround(pct * tokens / 100.0).cast("int")
    return F.greatest(F.lit(1), n) if at_least_one else n


def select_candidate(attempts: DataFrame, keys: list[str], target: str, actual: str, order: str, tolerance: float = 0.5) -> DataFrame:
    """The attempt to keep for each key.

    The first within the tolerance; else the closest that does not overshoot; else the closest.  Ties go to the first.
    Adds `accepted` and `overshoot_only` (every attempt is above target + tolerance).
    """
    off = F.abs(F.col(actual) - F.col(target))
    kind = F.when(off <= tolerance, 0).when(F.col(actual) <= F.col(target), 1).otherwise(2)
    rank = F.struct(kind.alias("kind"), F.when(kind == 0, 0.0).otherwise(off).alias("off"), F.col(order).alias("ord"))
    rest = [c for c in attempts.columns if c not in keys]
    picked = attempts.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r"), F.min(kind).alias("kind"), F.bool_and(F.col(actual) > F.col(target) + tolerance).alias("overshoot_only"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest), (F.col("kind") == 0).alias("accepted"), "overshoot_only")


def with_fallback(cases: DataFrame, picked: DataFrame, keys: list[str], original: str, paraphrase: str, target: str) -> DataFrame:
    """Cases without any usable attempt take the original text, with no change and the target as deviation."""
    out = cases.join(picked.select(*keys, paraphrase, "actual_pct"), keys, "left")
    none = F.col(paraphrase).isNull()
    return out.withColumns({paraphrase: F.coalesce(paraphrase, original), "actual_pct": F.coalesce("actual_pct", F.lit(0.0)), "deviation": F.when(none, F.col(target)).otherwise(F.abs(F.col("actual_pct") - F.col(target))), "fell_back": none})


def retry_hint(actual: Column, target: Column, tolerance: float = 0.5) -> Column:
    """Which way the next attempt should go."""
    gap = F.format_string("%.1f", F.abs(actual - target))
    return F.when(F.abs(actual - target) <= tolerance, "accept").when(actual > target, F.concat(F.lit("change fewer words: over by "), gap)).otherwise(F.concat(F.lit("change more words: under by "), gap))


def calibration_ok(actual: Column, target: Column, tolerance: float = 0.5) -> Column:
    return (F.abs(actual - target) <= tolerance) | (actual <= target)
