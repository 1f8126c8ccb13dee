"""Text perturbation and inspection as column expressions.

Patterns carry (?U) where they rely on word borders, so that borders are Unicode-aware on every Java version.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions import lexicons, tokens
from evenkeel.functions.special import let


def _bounded(term: str, both: bool = False) -> str:
    return r"\b" + re.escape(term) + ("" if term.endswith(".") and not both else r"\b")


def folded(terms: Iterable[str], end: Callable[[str], str] = lambda term: "") -> str:
    """One pattern for all terms, the longest at a place first, with what they start with in common written once.

    A text is then matched against the letters that can follow, and not against one term after the other.  `end` gives
    what must come after a term.
    """
    tree: dict = {}
    for t in terms:
        at = tree
        for c in t:
            at = at.setdefault(c, {})
        at[""] = end(t)

    def written(at: dict) -> str:
        parts, single = [], []
        for c, below in sorted((k, v) for k, v in at.items() if k):
            rest = written(below)
            (single if not rest else parts).append(re.escape(c) + rest)
        if len(single) > 1 and all(len(x) == 1 for x in single):
            single = ["[" + "".join(single) + "]"]
        parts += single
        if "" in at:
            parts.append(at[""])
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return written(tree) if tree else r"(?!)"


def alternation(terms: Sequence[str], both: bool = False) -> str:
    """One pattern for whole terms, longest first; a term that ends in a period needs no border there (unless `both`)."""
    return r"(?U)\b" + folded(terms, lambda t: "" if t.endswith(".") and not both else r"\b")


def swap(text: Column, lexicon: Mapping[str, str], both: bool = False) -> Column:
    """Replaces every whole term by its counterpart, in one pass.

    One pass equals one replacement per term, longest first, as long as no counterpart is a term itself.  The text is
    cut at the terms, and the pieces are put together with the terms' counterparts.
    """
    pattern = alternation(list(lexicon), both)
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def join(p: Column) -> Column:
        new = F.concat(F.transform(p["hits"], lambda h: F.element_at(table, h)), F.array(F.lit("")))
        return F.array_join(F.zip_with(p["gaps"], new, lambda g, h: F.concat(g, h)), "")

    return F.when(text.rlike(pattern), let(parts, join)).otherwise(text)


def swap_in_order(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Replaces whole terms one pair after the other, in the order given, so that a later pair meets what an earlier one
    has put there.  Both ends need a border, even after a period."""
    for term, other in pairs:
        text = F.regexp_replace(text, "(?U)" + _bounded(term, both=True), re.sub(r"([\\$])", r"\\\1", other))
    return text


def swap_gender(text: Column, female: Column) -> Column:
    return F.when(female, swap(text, lexicons.FEMALE_TO_MALE)).otherwise(swap(text, lexicons.MALE_TO_FEMALE))


def has_terms(text: Column, terms: Sequence[str]) -> Column:
    return text.rlike(alternation(terms))


def residue(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that are still found, in any case of letters."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?iU)" + p), F.lit(p)) for p in patterns]))


def inverse(lexicon: Mapping[str, str]) -> dict[str, str]:
    """Counterpart to term; the first term of a counterpart wins."""
    out: dict[str, str] = {}
    for k, v in lexicon.items():
        out.setdefault(v, k)
    return out


def prefixed(text: Column, sentence: str = lexicons.FIXED_SENTENCE) -> Column:
    return F.concat(F.lit(sentence + " "), text)


def repaired(text: Column) -> Column:
    """Mends one known slip of the keyboard."""
    return F.regexp_replace(text, r"(?U)\bSHe\b", "She")


def filled(text: Column, values: Mapping[str, str | Column]) -> Column:
    """Placeholders replaced in the order given."""
    for k, v in values.items():
        text = F.replace(text, F.lit(k), F.lit(v) if isinstance(v, str) else v)
    return text


def stripped(text: Column, name: str | Column) -> Column:
    """An example vignette without demographics, its patient renamed."""
    for k, v in lexicons.STRIPPED:
        text = F.replace(text, F.lit(k), F.lit(v) if v != "{name}" else F.lit(name) if isinstance(name, str) else name)
    return text


def prompt(template: str, **values: str | Column) -> Column:
    """A template with its {fields} filled; a null value gives a null prompt."""
    parts = re.split(r"\{(\w+)\}", template)
    filled = [(F.lit(p) if k % 2 == 0 else values[p] if isinstance(values[p], Column) else F.lit(values[p])) for k, p in enumerate(parts)]
    return F.concat(*filled)


def core_question(q: Column) -> Column:
    """Up to and with the first question mark; an error where there is none."""
    return F.when(F.contains(q, F.lit("?")), F.concat(F.substring_index(q, "?", 1), F.lit("?"))).otherwise(F.raise_error(F.lit("a question without a question mark")))


def unquoted(text: Column) -> Column:
    """Without one pair of double quotes, then without one pair of single ones, around it."""
    for q in ('"', "'"):
        paired = F.startswith(text, F.lit(q)) & F.endswith(text, F.lit(q)) & (F.length(text) >= 2)
        text = F.when(paired, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return text


def stripped_quotes(text: Column) -> Column:
    """Without any quotes at the ends: double ones first, then single ones."""
    return F.btrim(F.btrim(text, F.lit('"')), F.lit("'"))


def is_refusal(text: Column) -> Column:
    # Lower case may be longer than upper case, never shorter: twice the longest phrase is enough.
    start = F.substring(tokens.trimmed(text), 1, 2 * max(map(len, lexicons.REFUSALS)))
    norm = F.replace(F.lower(start), F.lit("’"), F.lit("'"))
    return let(norm, lambda n: F.exists(F.array(*[F.lit(p) for p in lexicons.REFUSALS]), lambda p: F.startswith(n, p)))


def mentions(text: Column, keywords: Sequence[str]) -> Column:
    """Any keyword anywhere in the lower-cased text."""
    return F.lower(text).rlike(folded(keywords))


def matched_keywords(text: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """`CLASS: keyword` for each keyword found, in the lists' order."""
    low = F.lower(text)
    found = [_found(low, name, ks) for name, ks in classes.items()]
    return F.concat(*found)


def _found(low: Column, name: str, keywords: Sequence[str]) -> Column:
    return F.transform(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k)), lambda k: F.concat(F.lit(f"{name}: "), k))


def patient_gender(text: Column) -> Column:
    """female, male or unclear: by nouns if they name one gender only, else by a clear majority of two pronouns or more."""
    names = lambda ws: text.rlike(r"(?iU)\b(?:" + "|".join(ws) + r")\b")
    count = lambda ws: F.regexp_count(F.lower(text), F.lit(r"(?U)\b(?:" + "|".join(ws) + r")\b"))
    woman, man = names(("woman", "girl", "female")), names(("man", "boy", "male"))
    she, he = count(("she", "her")), count(("he", "his", "him"))
    return (
        F.when(woman & ~man, "female").when(man & ~woman, "male")
        .when((she > he) & (she >= 2), "female").when((he > she) & (he >= 2), "male").otherwise("unclear")
    )


def sentences(text: Column) -> Column:
    """Sentences of five words or more that are no list items and do not end in a comma or semicolon."""
    trimmed = F.transform(F.split(text, r"\.(?:\s+|$)"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    words = lambda s: F.size(F.split(s, r"\s+"))
    return F.filter(trimmed, lambda s: (s != "") & (words(s) >= 5) & ~s.rlike(r"^\s*[-•\d]+[\.)]\s*") & ~s.rlike("[,;]$"))


def pick(array: Column, *seed: Column) -> Column:
    """One element, fixed by md5 of the seeds as text; null if there is none."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in seed])), 1, 8), 16, 10).cast("long")
    return F.when(F.size(array) > 0, F.element_at(array, (draw % F.size(array) + 1).cast("int")))


def replace_sentence(text: Column, old: Column, new: Column) -> Column:
    """The first place of a sentence with its end mark, else of the bare sentence, replaced; null if nothing changes."""
    marks = (".", "?", "!")
    ended = lambda s: s.rlike("[.?!]$")

    def first(a: Column, b: Column) -> Column:
        at = F.position(a, text)
        swapped = F.concat(F.substring(text, F.lit(1), at - 1), b, F.substring(text, at + F.length(a), F.length(text)))
        return F.when((at > 0) & (a != b), swapped)

    tries = []
    for m in marks:
        a = F.when(F.endswith(old, F.lit(m)), old).otherwise(F.concat(old, F.lit(m)))
        tries += [first(a, F.when(ended(new), new).otherwise(F.concat(new, F.lit(n)))) for n in marks]
    return F.coalesce(*tries, first(old, new))


# Ages ------------------------------------------------------------------------------------------------------------

# How an age is written, most specific first: pattern, group of the number, group that is replaced.
AGES = (
    ("decade", r"\b((?:late|early|mid)\s+\d0s)\b", 1, 1),
    ("years_old", r"\b(\d{1,3})\s*-?\s*years?\s*-?\s*old\b", 1, 0),
    ("letter_in_brackets", r"\b(\d{1,3})\([MFmf]\)", 1, 0),
    ("letter_before", r"\b[MFmf](\d{1,3})\b", 1, 0),
    ("letter_after", r"\b(\d{1,3})\s?[MFmf]\b", 1, 0),
    ("age_is", r"[Aa]ge\s*[=:]\s*(\d{1,3})", 1, 1),
    ("word_before", r"(?:[Ff]emale|[Mm]ale)\s*,\s*(\d{1,3})\b", 1, 1),
    ("word_after", r"\b(\d{1,3})\s+(?:[Mm]ale|[Ff]emale)\b", 1, 1),
    ("this_year", r"\b(\d{1,3})\s+this\s+year\b", 1, 1),
    ("i_am", r"(?:I'?m|I am)\s+(?:a\s+)?(\d{1,3})\b", 1, 1),
)
MIN_AGE, MAX_AGE = 1, 110
#: Digits of all other scripts than ours; a pattern with (?U) takes them as digits too.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")


def _number(digits: Column) -> Column:
    """A number in the digits of any script; null if there is none."""
    return F.translate(digits, DIGITS, "".join(str(unicodedata.digit(c)) for c in DIGITS)).try_cast("int")


def extract_age(text: Column) -> Column:
    """struct<age, matched, start (from 0, in code points), kind>: the first pattern whose first match is a plausible age;
    else null."""
    found = []
    for kind, pattern, number, taken in AGES:
        p = "(?U)" + pattern
        whole, part = F.regexp_extract(text, p, 0), F.regexp_extract(text, p, taken)
        if kind == "decade":
            add = F.when(F.contains(part, F.lit("early")), 2).when(F.contains(part, F.lit("late")), 7).otherwise(5)
            age = _number(F.regexp_extract(part, r"(?U)(\d)0s", 1)) * 10 + add
        else:
            age = _number(F.regexp_extract(text, p, number))
        start = F.length(F.element_at(F.split(text, p, 2), 1))  # regexp_instr counts a letter beyond 0xFFFF twice
        if taken:  # the number's last place in the match
            start = start + F.when(F.lit(kind == "decade"), 0).otherwise(F.length(whole) - F.length(F.regexp_extract(whole, r"(?U)\d{1,3}(?!.*\d)[\s\S]*$", 0)))
        found.append(F.when((whole != "") & age.between(MIN_AGE, MAX_AGE), F.struct(age.alias("age"), part.alias("matched"), start.cast("int").alias("start"), F.lit(kind).alias("kind"))))
    return F.coalesce(*found)


def replace_age(text: Column, found: Column, new: Column) -> Column:
    """The matched age replaced in its own form, then the old number wherever else it stands (but not as 27 in 27.0)."""

    def body(a: Column) -> Column:
        age = new.cast("string")
        bare = F.regexp_replace(a["matched"], r"(?U)\d+", age)
        put = F.when(a["kind"] == "decade", age).otherwise(bare)
        once = F.concat(F.substring(text, F.lit(1), a["start"]), put, F.substring(text, a["start"] + F.length(a["matched"]) + 1, F.length(text)))
        return F.regexp_replace(once, F.concat(F.lit(r"(?U)\b"), a["age"].cast("string"), F.lit(r"\b(?!\.\d)")), age)

    return F.when(found.isNotNull(), let(found, body))


def bracket_age(age: Column, key: Column) -> Column:
    """60 to 80 for those under 50, else 18 to 35; fixed by md5 of the key."""
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.when(age < 50, 60 + draw % 21).when(age >= 50, 18 + draw % 18).cast("int")


def age_plus_one(age: Column, key: Column) -> Column:
    return age + 1


def model_short_name(name: Column) -> Column:
    """The last part of a model's path in lower case, with underscores for hyphens."""
    return F.replace(F.lower(F.element_at(F.split(name, "/"), -1)), F.lit("-"), F.lit("_"))
