"""Queries over the calibrated search and the services that it calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import parse, sampling, service, text, tokens
from evenkeel.plans import search
from evenkeel.plans.catalogue import _HASHED, R, query, rounded, table

# The calibrated search -------------------------------------------------------------------------------------------

RETRIES, RESET = 5, 4


def _hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def _stand_in(asked: DataFrame) -> DataFrame:
    """A rewriter without a model, which marks the first words of the text; how many follows from the conversation.

    Some cases do not listen and always overshoot, some are refused now and then, some always."""
    h, n, edits, before = F.col("h"), F.col("n"), F.col("edits"), F.col("before")
    last, size = F.element_at("messages", -1)["content"], F.size("messages")
    marks = F.regexp_count(F.get("messages", size - 2)["content"], F.lit(r"(?U)~(?<=(?:^|\s)~)"))
    asked = asked.withColumns({"h": _hash(F.col("doc_id")), "before": F.when(size > 1, marks)})
    first = F.when(h % 3 == 0, edits * 2).when(h % 3 == 1, F.floor(edits / 2)).otherwise(edits + 3)
    plain = (size == 1) & F.startswith(last, F.lit("Replace about"))
    k = (
        F.when(plain, edits - h % 2).when(h % 7 == 3, edits * 3 + 1).when((size == 1) & F.contains(last, F.lit("An earlier attempt")), edits)
        .when((size == 1) | F.contains(last, F.lit("That was a refusal")), first)
        .when(F.contains(last, F.lit("fewer")), before - F.greatest(F.lit(1), F.floor(before / 4))).otherwise(before + F.greatest(F.lit(1), F.floor(before / 3)))
    )
    asked = asked.withColumn("k", F.least(n, F.greatest(F.lit(0), k)).cast("int"))
    asked = asked.withColumn("refused", (h % 17 == 0) | ((h + size) % 5 == 0))
    asked = asked.withColumn("whole", F.when(~F.col("refused"), tokens.spaced(F.col("text"))))
    asked = asked.withColumn("begin", F.call_function("substring_index", "whole", F.lit(" "), "k"))
    marked = F.concat(F.when(F.col("k") > 0, "~").otherwise(""), F.replace("begin", F.lit(" "), F.lit(" ~")), F.substring("whole", F.length("begin") + 1, F.length("whole")))
    quoted = F.concat(F.when(h % 4 == 1, ' "').otherwise(""), marked, F.when(h % 4 == 1, '"\n').otherwise(""))
    return asked.withColumn("reply", F.when(F.col("refused"), "I can’t help with that.").otherwise(quoted)).drop("h", "before", "k", "refused", "whole", "begin")


_KEEP = "CASE WHEN off IS NOT NULL AND {ok} AND ({b}.off IS NULL OR off < {b}.off) THEN {{'off': off, 'att': att, 'pct': pct, 'k': k}} ELSE {b} END AS {b}"
_NONE = "CAST(NULL AS STRUCT(\"off\" DOUBLE, \"att\" INT, pct DOUBLE, k BIGINT))"
_SEARCH_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, 1.0::DOUBLE + doc_id % 12 AS target, {_HASHED.format(x="CAST(doc_id AS VARCHAR)")} AS h
  FROM (SELECT doc_id, text, CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') END AS w FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, greatest(1, CAST(round_even(target * n / 100, 0) AS BIGINT)) AS edits FROM d),
r(doc_id, phase, att, size, mode, before, k, pct, best, under, overshot, attempts, accepted) AS (
  SELECT doc_id, 0, -1, CAST(1 AS BIGINT), 'start', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), {_NONE}, {_NONE}, true, 0, false FROM c
  UNION ALL
  SELECT doc_id, phase, att, CASE WHEN phase = 2 OR (att + 1) % {RESET} = 0 THEN 1 ELSE size + 2 END,
    CASE WHEN (att + 1) % {RESET} = 0 THEN CASE WHEN best.off IS NULL THEN 'start' ELSE 'hint' END WHEN pct IS NULL THEN 'start' WHEN pct > target + 0.5 THEN 'fewer' ELSE 'more' END, k, k, pct, best, under, overshot, attempts + CAST(pct IS NOT NULL AS INT), coalesce(off <= 0.5, false)
  FROM (SELECT * EXCLUDE (best, under, overshot), {_KEEP.format(b="best", ok="true")}, {_KEEP.format(b="under", ok="pct <= target")}, overshot AND coalesce(pct > target + 0.5, true) AS overshot
    FROM (SELECT *, abs(pct - target) AS off
      FROM (SELECT *, CASE WHEN h % 17 = 0 OR (h + size) % 5 = 0 THEN NULL WHEN n = 0 THEN 0 ELSE k * 100.0::DOUBLE / n END AS pct
        FROM (SELECT * EXCLUDE (k), least(n, greatest(0, CASE WHEN phase = 2 THEN edits - h % 2 WHEN h % 7 = 3 THEN edits * 3 + 1 WHEN mode = 'hint' THEN edits WHEN mode = 'start' THEN CASE h % 3 WHEN 0 THEN edits * 2 WHEN 1 THEN edits // 2 ELSE edits + 3 END
            WHEN mode = 'fewer' THEN k - greatest(1, k // 4) ELSE k + greatest(1, k // 3) END)) AS k
          FROM (SELECT r.* EXCLUDE (phase, att, pct, size), c.n, c.target, c.h, c.edits, CASE WHEN att = {RETRIES} THEN 2 ELSE greatest(phase, 1) END AS phase, att + 1 AS att, CASE WHEN att >= {RETRIES} THEN 1 ELSE size END AS size
            FROM r JOIN c USING (doc_id) WHERE NOT accepted AND (att < {RETRIES} OR att < {2 * RETRIES + 1} AND overshot AND best.off IS NOT NULL OR phase = 2 AND att < {2 * RETRIES + 1}))))))),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY att DESC) AS rn FROM r),
o AS (SELECT c.*, l.accepted, l.phase, l.att, l.attempts, CASE WHEN accepted THEN {{'off': abs(pct - target), 'att': l.att, 'pct': pct, 'k': k}} WHEN under.off IS NOT NULL THEN under ELSE best END AS kept FROM l JOIN c USING (doc_id) WHERE rn = 1)
SELECT doc_id, {R('coalesce(kept.pct, 0)')} AS actual_pct, {R('coalesce(kept.off, target)')} AS deviation, CAST(CASE WHEN accepted THEN att ELSE {RETRIES} END AS INT) AS retries_used, CAST(CASE WHEN accepted THEN phase ELSE 0 END AS INT) AS phase, CAST(attempts AS INT) AS attempts,
  md5(CASE WHEN kept.off IS NULL THEN text ELSE array_to_string([CASE WHEN i <= kept.k THEN '~' || w[i] ELSE w[i] END FOR i IN range(1, n + 1)], ' ') END) AS digest FROM o
UNION ALL SELECT doc_id, NULL, NULL, 0, 0, 0, NULL FROM documents WHERE text IS NULL"""


@query("CAL-1 CAL-2 CAL-5 TWN-6 TOK-4 TXT-20", _SEARCH_SQL)
def calibrated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases over every document, with a stand-in for the rewriter."""
    cases = table(spark, sf_dir, "documents").select("doc_id", "text", (1.0 + F.col("doc_id") % 12).alias("target"))
    found = search.calibrate(spark, cases, _stand_in, ["doc_id"], max_retries=RETRIES, reset_every=RESET)
    return rounded(found.select("doc_id", "actual_pct", "deviation", "retries_used", "phase", "attempts", F.md5("paraphrase").alias("digest")))


# Services --------------------------------------------------------------------------------------------------------


def _slow_service() -> service.Call:
    """A stand-in for a service: by the prompt's hash it answers, fails for good, fails at first, or hangs."""
    import asyncio
    import hashlib

    met: set[str] = set()

    async def call(prompt: str | None) -> str | None:
        h = int(hashlib.md5((prompt or "").encode()).hexdigest()[:8], 16) % 50
        await asyncio.sleep(h / 10_000)
        if h == 0:
            raise ValueError("no such prompt")
        if h < 10 and prompt not in met:
            met.add(prompt)
            raise ConnectionError("again")
        if h == 10:
            await asyncio.sleep(3600)
        return f"{h}:{(prompt or '').upper()}"

    return call


@query(
    "CAL-5 EVL-2 UDF-6 SCR-12",
    f"""SELECT doc_id, h NOT IN (0, 10) AS ok, md5(CASE WHEN h NOT IN (0, 10) THEN h || ':' || upper(prompt) END) AS digest, CASE h WHEN 0 THEN 'ValueError: no such prompt' WHEN 10 THEN 'TimeoutError: more than 5 s' END AS error,
  CAST(CASE WHEN h = 0 THEN 1 WHEN h <= 10 THEN 2 ELSE 1 END AS INT) AS calls
FROM (SELECT doc_id, prompt, {_HASHED.format(x="prompt")} % 50 AS h FROM (SELECT doc_id, 'Judge ' || doc_id || ' ' || lang || ' ' || md5(text) AS prompt FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL))""",
)
def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each document, hundreds in flight at once, with retries, limits and errors that stay with their rows."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    asked = docs.select("doc_id", F.concat_ws(" ", F.lit("Judge"), F.col("doc_id").cast("string"), "lang", F.md5("text")).alias("prompt"))
    told = service.fan_out(asked, "prompt", lambda: _slow_service(), in_flight=200, seconds=5.0, retries=1, pause=0.01)
    return told.select("doc_id", "answer.ok", F.md5("answer.value").alias("digest"), "answer.error", "answer.calls")


# Samples ---------------------------------------------------------------------------------------------------------


def _sampler() -> sampling.Model:
    """A stand-in for a model that samples: all follows from the seed, and some log-odds are no numbers."""

    def model(prompts, seeds):
        odd = {0: float("nan"), 1: float("inf"), 2: float("-inf"), 3: None}
        return [("Yes." if s % 5 < 3 else "Surely no", odd.get(s % 53, s % 6000 / 1000 - 3)) for s in seeds]

    return model


_DRAWN = f"SELECT doc_id, text IS NOT NULL AS asked, i, {_HASHED.format(x="doc_id || ':' || i")} AS s FROM (SELECT doc_id, text, unnest(range(10)) AS i FROM documents)"


@query(
    "SCR-11 EVL-1 SCR-3 SCR-6",
    f"""SELECT doc_id, CAST(count(*) FILTER (asked) AS INT) AS samples, CAST(count(*) FILTER (asked AND s % 5 < 3) AS INT) AS yes, CASE WHEN bool_and(asked) THEN count(*) FILTER (s % 5 < 3) > 5 END AS majority,
  count(*) FILTER (asked AND s % 53 <> 3) AS known, {R("sum(CASE WHEN NOT asked THEN NULL ELSE CASE s % 53 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN -100 WHEN 3 THEN NULL ELSE s % 6000 / 1000.0::DOUBLE - 3 END END)")} AS total
FROM ({_DRAWN}) GROUP BY doc_id""",
)
def sampled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten samples for each document, in batches by a budget of tokens, parsed and put to the vote."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Answer yes or no. "), "text").alias("prompt"))
    drawn = sampling.sample(docs, ["doc_id"], "prompt", lambda: _sampler(), samples=10, budget=4096)
    each = F.transform("samples", lambda s: parse.binary_answer(F.lit(None).cast("string"), s["text"])["value"])
    votes = F.aggregate(each, F.lit(0), lambda a, v: a + v)
    known = F.filter(F.transform("samples", lambda s: s["logit"]), lambda x: x.isNotNull())
    made = drawn.select("doc_id", F.coalesce(F.size("samples"), F.lit(0)).alias("n"), votes.alias("yes"), known.alias("k"))
    asked = F.col("k").isNotNull()
    return rounded(made.select("doc_id", F.when(asked, F.col("n")).otherwise(0).alias("samples"), F.coalesce("yes", F.lit(0)).alias("yes"), (F.col("yes") > 5).alias("majority"), F.when(asked, F.size("k")).otherwise(0).cast("long").alias("known"), F.when(F.size("k") > 0, F.aggregate("k", F.lit(0.0), lambda a, x: a + x)).alias("total")))


@query("PRJ-5", "SELECT source, lang, replace(lower(string_split('hub/' || source || '/Model-' || upper(lang) || '-8B', '/')[-1]), '-', '_') AS short, count(*) AS n FROM documents GROUP BY 1, 2, 3")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short name of a model that goes into file names."""
    name = F.concat(F.lit("hub/"), "source", F.lit("/Model-"), F.upper("lang"), F.lit("-8B"))
    return table(spark, sf_dir, "documents").groupBy("source", "lang", text.model_short_name(name).alias("short")).agg(F.count("*").alias("n"))


@query("SCR-13", "SELECT doc_id, md5(CASE WHEN least(CASE WHEN strpos(text, '. ') > 0 THEN strpos(text, '. ') + 1 END, CASE WHEN strpos(text, chr(10)) > 0 THEN strpos(text, chr(10)) END) IS NULL THEN text ELSE substr(text, 1, least(CASE WHEN strpos(text, '. ') > 0 THEN strpos(text, '. ') + 1 END, CASE WHEN strpos(text, chr(10)) > 0 THEN strpos(text, chr(10)) END)) END) AS digest FROM documents")
def stopped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts up to and with the first of two stop strings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(parse.until(F.col("text"), ". ", "\n")).alias("digest"))
