"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over the trigrams that every match must contain.  The
index has the posting lists of the trigrams that the queries name: (trigram, text), where a text stands for all its
copies.  Intersecting the lists of a query gives a rule's candidate texts, and the expression itself verifies them.
A rule whose expression implies no trigram scans every text.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.special import let
from evenkeel.llm.common import Scratch, col, fresh, left_join_hot

#: Candidates of at most so many texts (16 bytes each) are sent to all workers; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Strings that one part of an expression may stand for before it counts as anything.
MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # read alike by Java, RE2 and Python
    least: int = 0  # characters that group `group` must have
    group: int = 0


#: The three base kinds, whose matches are leftmost and do not overlap; those that are too short are dropped.  Where
#: the expression itself can ask for the length without moving a match, it does.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: A private key from its header over the body to the END line (single hyphens as in "Proc-Type"); without an END line,
#: over header fields and the base64 characters that follow across line ends (real ones or written \n), at least 16; else
#: the header alone.
_PEM = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,40}-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?:\s*[A-Za-z-]{2,30}:[^\n]{0,200}\n){0,4}[\s\\nr]*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\r\n\\]*)?"
)

#: More kinds: formats that the issuers document.
MORE = (
    Rule("private_key", _PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# Boolean trigram queries: True, a trigram, ("and", ...) or ("or", ...) --------------------------------------------


def _join(how: str, parts: list):
    flat = []
    for p in parts:
        if p is True:
            if how == "or":
                return True
            continue
        for q in p[1:] if isinstance(p, tuple) and p[0] == how else [p]:
            if q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else (how, *flat)


def _of_strings(strings: set[str]):
    """What a text must hold that has one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return True
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg) -> set[str] | None:
    """The strings that a single item stands for, lower-cased; None for too many."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is C.LITERAL and a < 128:
                out.add(chr(a).lower())
            elif o is C.RANGE and a[1] < 128 and a[1] - a[0] < 8:
                out.update(chr(c).lower() for c in range(a[0], a[1] + 1))
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings the items stand for, or None; what a match must hold)."""
    needs, now, exact = [], {""}, True

    def cut() -> None:
        nonlocal now, exact
        needs.append(_of_strings(now))
        now, exact = {""}, False

    for op, arg in items:
        strings, need = _strings(op, arg), True
        if op is C.SUBPATTERN:
            strings, need = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            need = _join("or", [p[1] for p in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one, need = _walk(inner)
            need = need if low else True
            if one is not None and high in (0, 1):
                strings = one | {""} if low == 0 else one
            elif one is not None and low == high and len(one) == 1:
                strings = {s * low for s in one}
        elif op is C.AT:
            strings = {""}
        if strings is None:
            cut()
            needs.append(need)
        elif len(now) * len(strings) > MOST_STRINGS:
            cut()
            now = strings
        else:
            now = {a + b for a in now for b in strings}
    if exact:
        return now, _of_strings(now)
    cut()
    return None, _join("and", needs)


def trigram_query(pattern: str):
    """What the lower-cased (A-Z) text of every match holds; True if the expression tells nothing."""
    return _walk(parser.parse(pattern))[1]


def thinned(query):
    """A query that every text of the given one answers, with fewer trigrams: the index costs a look for each.

    Of trigrams that follow one another in a string those stay that cover it (but for one last letter); of alternatives one that asks for all that
    another asks for, and more, is left out.
    """
    if query is True or isinstance(query, str):
        return query
    if query[0] == "or":
        asks = [frozenset(q[1:]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in query[1:]]
        return _join("or", [thinned(q) for q, a in zip(query[1:], asks, strict=True) if not any(b < a for b in asks)])
    kept, run = [], []
    for p in [*map(thinned, query[1:]), None]:
        if run and not (isinstance(p, str) and p[:2] == run[-1][1:]):
            kept += [run[i] for i in range(len(run)) if i % 3 == 0 or i == len(run) - 1 and i % 3 == 2]
            run = []
        if isinstance(p, str):
            run.append(p)
        elif p is not None:
            kept.append(p)
    return _join("and", kept)


def trigrams(query) -> list[str]:
    """The trigrams of a query, in order of their names."""
    if query is True:
        return []
    if isinstance(query, str):
        return [query]
    return sorted({t for q in query[1:] for t in trigrams(q)})


def _holds(query, place: dict[str, int]) -> Column:
    """The query over posting bits p0, p1, ... (62 trigrams each)."""
    if isinstance(query, str):
        k = place[query]
        return F.col(f"p{k // 62}").bitwiseAND(F.lit(1 << k % 62)) != 0
    out = _holds(query[1], place)
    for q in query[2:]:
        out = out & _holds(q, place) if query[0] == "and" else out | _holds(q, place)
    return out


# Index, candidates, verification ----------------------------------------------------------------------------------


def folded(text: Column) -> Column:
    """Lower case; may hold more ASCII letters than lower-casing A-Z gives (for the Kelvin sign), never fewer."""
    return F.lower(text)


def postings(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """The index: (trigram: its place in names, text: XXH64 of the text), without repeats in a partition's copies."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(names)])
    held = let(folded(text), lambda x: F.transform(F.filter(table, lambda n: F.contains(x, n["t"])), lambda n: n["i"]))
    return docs.select(F.xxhash64(text).alias("text"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame | None:
    """(text, rules: bit i set if rule i may match, n: its postings); None if no rule has mandatory trigrams."""
    queries = {i: q for i, r in enumerate(rules) if (q := thinned(trigram_query(r.pattern))) is not True}
    names = sorted({t for q in queries.values() for t in trigrams(q)})
    if not names:
        return None
    place = {t: i for i, t in enumerate(names)}
    words = range(-(-len(names) // 62))
    bit = lambda w: F.when(F.floor(F.col("trigram") / 62) == w, F.expr("shiftleft(1L, cast(trigram % 62 AS int))")).otherwise(F.lit(0).cast("long"))
    lists = postings(docs, text_col, names).groupBy("text").agg(F.count("*").alias("n"), *[F.bit_or(bit(w)).alias(f"p{w}") for w in words])
    found = sum((F.when(_holds(q, place), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, q in queries.items()), F.lit(0).cast("long"))
    return lists.select("text", found.alias("rules"), "n").where("rules != 0")


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """All verified matches as array<struct<start, rank, end>>, in order.

    The pieces between matches and the matches themselves give the offsets; their lengths are summed in blocks, and the
    blocks' sums one after the other, so that a text with very many matches takes time in proportion.
    """
    span = "struct<start:bigint,rank:int,end:bigint>"
    pattern, block = F.lit(rule.pattern), 64
    zero = F.lit(0).cast("long")

    def spans(x: Column) -> Column:
        pair = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.length(h).cast("long").alias("h")))
        total = lambda a: F.aggregate(a, zero, lambda s, p: s + p["g"] + p["h"])

        def blocked(y: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(y["n"]) / block).cast("int")), lambda b: total(F.slice(y["n"], b * block + 1, F.lit(block))))
            start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("before"))
            before = F.aggregate(sums, start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")), lambda s: s["before"])
            return F.struct(y["n"].alias("n"), y["held"].alias("held"), before.alias("before"))

        def placed(z: Column) -> Column:
            first = lambda i: (F.floor(i / block) * block).cast("int")
            before = lambda i: F.get(z["before"], F.floor(i / block).cast("int")) + total(F.slice(z["n"], first(i) + 1, i - first(i)))
            every = F.transform(z["n"], lambda p, i: F.struct((before(i) + p["g"]).alias("start"), F.lit(rank).alias("rank"), p["h"].alias("end")))
            kept = F.filter(every, lambda s, i: F.get(z["held"], i) >= rule.least)
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), (s["start"] + s["end"]).alias("end")))

        return let(let(F.struct(pair.alias("n"), x["held"].alias("held")), blocked), placed)

    held = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    whole = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), held.alias("held"))
    return F.when(text.rlike(rule.pattern), let(whole, spans)).otherwise(F.array()).cast(f"array<{span}>")


def scan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (`keep`, all by default) and array<struct<start, rank, end>>; and that column's name.

    start and end (exclusive) are code points; rank is the rule's place in rules; spans are in order of start, then
    rank.  Spans of different rules may overlap.  Null and empty texts have none.  Repeated rows stay; an empty table
    gives no rows.  Every text is searched whole.
    """
    keep = list(docs.columns if keep is None else keep)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    found = candidates(docs, rules, text_col)
    name, mask, key = (fresh(docs, n) for n in ("secrets", "__rules", "__key"))
    if found is None:
        joined = docs.withColumn(mask, F.lit(0).cast("long"))
    else:
        found = Scratch(spark, "secrets").keep(found, "candidates").select(F.col("text").alias(key), F.col("rules").alias(mask), "n")
        keyed, held = docs.withColumn(key, F.xxhash64(text)), found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        joined = keyed.join(F.broadcast(found.drop("n")), key, "left") if held[0] <= BROADCAST_ROWS else left_join_hot(keyed, found, key, mask, "n", held[1])
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = matches(text, rule, i)
        if trigram_query(rule.pattern) is not True:
            spans = F.when(F.coalesce(col(mask), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(none)
        parts.append(spans)
    return joined.select(*map(col, keep), F.array_sort(F.concat(*parts)).alias(name)), name


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by the mark; null stays null."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        lead = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(lead, F.lit(mark))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
