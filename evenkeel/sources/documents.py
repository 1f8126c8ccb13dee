"""JSON documents in files of any size: arrays of records, objects keyed by id, and records with keys of their own making.

A file is cut at every `}` by Spark's text reader, which deals a large file's byte ranges to many tasks.  Whether a cut is
the end of a record follows from the quotes and brackets before it.  These are counted in every byte range for both cases,
that it starts inside a string or outside; which of the two holds, and how deep it starts, is then known from the ranges'
totals, one row each.  No task holds a file, and none more than a range or a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.scratch import Scratch


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def _depth(bare: Column, inside: Column, ends_inside: Column) -> Column:
    """Brackets opened less brackets closed by a piece without escapes, and by the `}` after it."""
    outside = F.regexp_replace(F.when(inside, F.regexp_replace(bare, '^[^"]*"?', "")).otherwise(bare), '"[^"]*(?:"|$)', "")
    return _count(outside, r"[{\[]") - _count(outside, r"\]") - F.when(ends_inside, 0).otherwise(1)


def _pieces(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Pieces between braces: file, block (byte range), n (order in it), value, and what the range holds up to each piece."""
    read = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    read = read.withColumn("n", F.monotonically_increasing_id()).withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))
    order = Window.partitionBy("file", "block").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("quotes", _count(F.col("bare"), '"')).withColumn("all_quotes", F.sum("quotes").over(upto))
    odd, ends = (F.col("all_quotes") - F.col("quotes")) % 2 == 1, F.col("all_quotes") % 2 == 1
    read = read.withColumns({"step_out": _depth(F.col("bare"), odd, ends), "step_in": _depth(F.col("bare"), ~odd, ~ends), "odd": ends})
    read = read.withColumns({f"depth_{k}": F.sum(f"step_{k}").over(upto) for k in ("out", "in")})
    return scratch.keep(read.select("file", "block", "size", "n", "value", "odd", "depth_out", "depth_in"), "pieces")


def _starts(pieces: DataFrame) -> DataFrame:
    """A row for each byte range: whether it starts inside a string, and how deep.

    Fails where a file's brackets or quotes do not come out even: it has been cut off, or is no JSON.
    """
    last = pieces.groupBy("file", "block").agg(F.max("size").alias("size"), F.max_by(F.struct("odd", "depth_out", "depth_in"), "n").alias("e"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    made = last.withColumn("inside", F.coalesce(F.sum(F.col("e.odd").cast("int")).over(before) % 2 == 1, F.lit(False)))
    made = made.withColumn("depth", F.when(F.col("inside"), F.col("e.depth_in")).otherwise(F.col("e.depth_out")))
    # The last piece of a file that does not end with a brace has been counted as if one followed.
    unclosed = F.sum("bytes").over(whole) > F.col("size")
    end = F.sum("depth").over(whole) + F.when(unclosed, 1).otherwise(0)
    sound = (end == 0) & (F.sum(F.col("e.odd").cast("int")).over(whole) % 2 == 0)
    checked = F.when(sound, F.coalesce(F.sum("depth").over(before), F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("brackets do not match in "), F.col("file"))).cast("long"))
    return made.select("file", "block", "inside", checked.alias("start"), unclosed.alias("unclosed"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each element of the arrays, or `"key": element` of the objects, in the files of a path or pattern;
    elements must be objects.  An empty array gives no rows, and neither does an empty file."""
    scratch = Scratch(spark, "documents")
    pieces = _pieces(spark, path, scratch)
    starts = scratch.keep(_starts(pieces), "starts")
    told = pieces.join(starts, ["file", "block"])
    inside = F.col("odd") != F.col("inside")
    depth = F.col("start") + F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))
    told = told.withColumn("ends", F.when(~inside & (depth == 1), F.col("n")))
    # The end of a piece's element: in its own range, or the first one of a later range.
    firsts = told.groupBy("file", "block").agg(F.min("ends").alias("first"))
    later = firsts.select("file", "block", F.last_value(F.when(F.col("first").isNotNull(), F.struct("block", "first")), True).over(Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    # Taken backwards: a frame up to the last row would be gone through anew for every row.
    here = F.min("ends").over(Window.partitionBy("file", "block").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    placed = told.withColumn("here", here).join(later, ["file", "block"])
    end = F.when(F.col("here").isNotNull(), F.struct("block", F.col("here").alias("first"))).otherwise(F.col("later"))
    grouped = placed.withColumn("end", end).where("end IS NOT NULL").groupBy("file", "end").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts"))
    text = F.concat(F.array_join("parts.value", "}"), F.lit("}"))
    return grouped.select(F.regexp_replace(text, r"^\s*[\[{,]\s*(?=[{\"])", "").alias("value"), "file", "end")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON arrays in files of any size."""
    return elements(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def entries(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The entries of JSON objects in files of any size: the keys, and the records' fields beside them."""
    found = elements(spark, path)
    name = F.regexp_extract("value", r'(?s)^"((?:[^"\\]|\\.)*)"\s*:', 1)
    plain = F.from_json(F.concat(F.lit('["'), name, F.lit('"]')), "array<string>")[0]
    body = F.regexp_replace("value", r'(?s)^"(?:[^"\\]|\\.)*"\s*:', "")
    return found.select(plain.alias(key), F.from_json(body, schema).alias("r")).select(key, "r.*")


#: Keys of one variant and task, as `original_VISIT` or `pct2.5_MANAGE`.
VARIANT_KEY = r"^(.+)_([A-Z]+)$"


def cases(spark: SparkSession, documents: DataFrame, id_key: str = "context_id", value: str = "value") -> DataFrame:
    """A row for each document, variant and task: p (of yes; null where it is not given) and votes.

    documents holds JSON texts whose keys name variants and tasks that are not known before; they are read as variants,
    and only what is asked for is taken out.  Keys of another form, and values that are no objects, are left out.
    """
    parsed = documents.select(F.try_parse_json(value).alias("v")).where("v IS NOT NULL")
    each = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant(F.col("value"))
    each = each.where(F.col("key").rlike(VARIANT_KEY) & F.startswith(kind, F.lit("OBJECT")))
    part = lambda k: F.regexp_extract("key", VARIANT_KEY, k)
    return each.select(
        F.try_variant_get("v", f"$.{id_key}", "string").alias("case_id"), part(1).alias("variant"), part(2).alias("task"),
        F.try_variant_get("value", "$.logit_probs", "double").alias("p"), F.try_variant_get("value", "$.binary_answers", "array<int>").alias("votes"),
    )
