"""Queries that carry the driver's tables through every source and sink: written to the shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import windows
from evenkeel.plans import stats
from evenkeel.plans.battery import answers
from evenkeel.plans.catalogue import CELLS, E_SQL, R, count4, query, rounded, table, triples
from evenkeel.scratch import Scratch
from evenkeel.sources import readers, writers
from evenkeel.streaming import ingest

_TURNS = "conv_id bigint, turn bigint, role string, text string"


def _root(spark: SparkSession) -> str:
    return Scratch(spark, "exchange").root


def _digest(df: DataFrame) -> DataFrame:
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5("text").alias("digest"))


_TURNS_SQL = "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations"


@query("SRC-1 SNK-4", _TURNS_SQL)
def csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _root(spark)
    writers.csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), f"{root}/turns")
    return _digest(readers.csv(spark, f"{root}/turns", _TURNS))


@query("SRC-2 SNK-4", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, CASE WHEN turn = 0 THEN 'nan' ELSE md5(text) END AS digest FROM conversations")
def csv_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as text; a spelling of NA stays the text `nan`."""
    root = _root(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") == 0, "N/A").otherwise(F.md5("text")).alias("digest"))
    writers.csv(turns, f"{root}/turns")
    read = readers.csv_strings(spark, f"{root}/turns", ["conv_id", "turn", "role", "digest"])
    return read.withColumn("digest", readers.na_as_text(F.col("digest")))


@query("SRC-3", "SELECT conv_id, turn, md5(text) AS digest, CASE turn % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS context FROM conversations WHERE turn % 3 < 2")
def csv_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a category each; a file that has none is left out."""
    root = _root(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    names = {}
    for k, context in enumerate(("first", "second", None)):
        writers.csv_file(rows.where(F.col("turn") % 3 == k), f"{root}/turns", f"part {k}.csv")
        if context:
            names[f"part {k}.csv"] = context
    return readers.csv_by_file(spark, f"{root}/turns", "conv_id bigint, turn bigint, text string", names).select("conv_id", "turn", F.md5("text").alias("digest"), "context")


@query("SRC-10", "SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem WHERE l_orderkey % 3 < 2 GROUP BY 1")
def csv_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the files that a pattern names."""
    root = _root(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    for k in range(3):
        writers.csv(rows.where(F.col("l_orderkey") % 3 == k), f"{root}/{'run' if k < 2 else 'other'}_{k}")
    read = readers.csv(spark, f"{root}/run_*", "l_orderkey bigint, l_returnflag string, l_quantity double")
    return read.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


_LOGITS_SQL = f"WITH {E_SQL} SELECT perturbation, task, count(*) AS n, {R('sum(logit_swapped)')} AS total FROM v GROUP BY 1, 2"


@query("SNK-3", _LOGITS_SQL)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _root(spark)
    writers.records(triples(spark, sf_dir).select(*CELLS, "logit_swapped"), f"{root}/records")
    read = readers.json_lines(spark, f"{root}/records", "perturbation string, task string, logit_swapped double")
    return rounded(read.groupBy(*CELLS).agg(F.count("*").alias("n"), F.sum("logit_swapped").alias("total")))


@query("SRC-5 RSH-4", "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS turns, md5(max(text) FILTER (turn = 0)) AS first FROM conversations GROUP BY 1")
def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object with the cases' ids as keys, written as text and read as rows."""
    root = _root(spark)
    cases = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.count("*").alias("turns"), F.md5(F.max(F.when(F.col("turn") == 0, F.col("text")))).alias("first"))
    writers.json_object(cases, "id", f"{root}/cases")
    return readers.json_map(spark, f"{root}/cases", "struct<turns:bigint,first:string>")


@query("SRC-6 SRC-8 SRC-9 SRC-12", "SELECT doc_id AS id, text IS NOT NULL AS has_text, (['A', 'B', 'C', 'D'])[doc_id % 4 + 1] AS letter FROM documents WHERE lang = 'en'")
def exported_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks, pickles and hub splits come as Parquet exports: renamed, decoded and filtered on load."""
    root = _root(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 4).cast("int").alias("label")).write.parquet(f"{root}/split")
    read = readers.samples(spark, f"{root}/split", F.col("lang") == "en", {"doc_id": "id"})
    return read.select("id", F.col("text").isNotNull().alias("has_text"), readers.label_letter(F.col("label")).alias("letter"))


@query("SNK-8", f"WITH {E_SQL}, c AS ({count4('p')}) SELECT 'rates' AS sheet, count(*) AS n, {R('sum((p01 + p10) / n)')} AS total FROM c UNION ALL SELECT 'summary', 2, {R('sum(n) + max(n)')} FROM c")
def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result tables of one analysis, a folder for each sheet."""
    root = _root(spark)
    c = stats.pair_counts(answers(triples(spark, sf_dir)), CELLS, "o", "p").withColumn("n", sum((F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1)), F.lit(0.0)))
    rates = c.select(*CELLS, ((F.col("n01") + F.col("n10")) / F.col("n")).alias("rate"))
    summary = writers.metric_value(c.agg(F.sum("n").alias("cases"), F.max("n").alias("largest")))
    writers.sheets(f"{root}/book", {"rates": rates, "summary": summary})
    writers.sheets(f"{root}/book-csv", {"summary": summary}, "csv")
    one = readers.parquet(spark, f"{root}/book/rates").agg(F.lit("rates").alias("sheet"), F.count("*").alias("n"), F.sum("rate").alias("total"))
    two = readers.csv(spark, f"{root}/book-csv/summary", "metric string, value double").agg(F.lit("summary").alias("sheet"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(one.unionByName(two))


@query("SNK-5 TWN-5 PLB-3", "SELECT doc_id, quality + 1 AS quality FROM labels")
def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version beside the old one; readers take the newest that is whole."""
    scratch, labels = Scratch(spark, "exchange"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    for k in range(3):
        writers.version(labels.withColumn("quality", F.col("quality") + k), scratch.root, k + 1)
    scratch.drop("v=3/_SUCCESS")  # as if its write had been cut off
    return readers.newest(spark, scratch.root)


@query("SNK-6 SNK-7 PLB-2", "SELECT doc_id, lang, source FROM documents")
def guarded_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwritten only as long as no guarded column holds a value; large columns are left out; values are checked."""
    root = _root(spark)
    docs = writers.without(table(spark, sf_dir, "documents").withColumn("LLAMA_answer", F.lit(None).cast("string")), ["text", "n_chars"])
    writers.guarded(docs, None, f"{root}/extended")
    writers.guarded(docs, spark.read.parquet(f"{root}/extended"), f"{root}/extended-2")
    return readers.checked(spark.read.parquet(f"{root}/extended-2"), "lang", ("en", "fr", "de", "es")).drop("LLAMA_answer")


@query("INC-2 INC-3 TWN-4", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after a run that was cut off: by key, never by count, and no random state to replay."""
    root, docs = _root(spark), table(spark, sf_dir, "documents").select("doc_id")
    docs.where("doc_id % 3 = 0").write.parquet(f"{root}/done")
    left = ingest.resume(spark, docs, f"{root}/done", ["doc_id"])
    return ingest.resume(spark, left, f"{root}/never-begun", ["doc_id"])


@query("WIN-1 INC-6", "SELECT event_type AS cell, count(*) AS n FROM events GROUP BY 1")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score records from a growing folder, each key once."""
    root = _root(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    rows.write.parquet(f"{root}/in")
    again = rows.where("event_id % 2 = 0")
    again.write.mode("append").parquet(f"{root}/in")
    ingest.score_stream(spark, f"{root}/in", "event_id bigint, ts timestamp, event_type string", f"{root}/out", f"{root}/checkpoint", ["event_id"], "ts", "10 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy(F.col("event_type").alias("cell")).agg(F.count("*").alias("n"))


@query("TWN-3 WIN-4 WIN-5", "SELECT shard, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most FROM (SELECT doc_id, CAST(least(floor(i / greatest(1, n // 8)), 7) AS BIGINT) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)) GROUP BY 1")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written as partitions of one table."""
    root = _root(spark)
    windows.contiguous_shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 8).write.partitionBy("shard").parquet(f"{root}/shards")
    read = spark.read.schema("doc_id bigint, shard bigint").parquet(f"{root}/shards")
    return read.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
