"""Queries over sources that are split, nested or written piece by piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import divergence as dv
from evenkeel.plans import battery as bt
from evenkeel.plans import stats
from evenkeel.plans.catalogue import _HASHED, CELLS, E_SQL, R, count4, mi_sql, query, rounded, table, triples
from evenkeel.scratch import Scratch
from evenkeel.sources import documents, workbook, writers
from evenkeel.sources.pieces import Pieces

# JSON of any size ------------------------------------------------------------------------------------------------


@query("SRC-4 SNK-3", "SELECT conv_id, turn, role, md5(text || '\"} {[' || chr(92)) AS digest, len(text) AS n FROM conversations")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of all turns in one file, read by byte ranges; texts hold quotes, brackets and backslashes."""
    root = Scratch(spark, "exchange").root
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", F.lit('"} {[\\')).alias("text"), F.length("text").cast("long").alias("n"))
    writers.json_array(turns, f"{root}/array")
    read = documents.records(spark, f"{root}/array/*.json", "conv_id long, turn long, role string, text string, n long")
    return read.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "n")


@query("SRC-5 RSH-4", "SELECT CAST(conv_id AS VARCHAR) || '\"' AS id, CAST(t.turn AS BIGINT) AS turn, md5(t.text) AS digest FROM (SELECT conv_id, unnest(list({'turn': turn, 'text': text})) AS t FROM conversations GROUP BY conv_id)")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object in one file, an entry for each conversation with all its turns, read by byte ranges."""
    root = Scratch(spark, "exchange").root
    whole = table(spark, sf_dir, "conversations").groupBy(F.concat(F.col("conv_id").cast("string"), F.lit('"')).alias("id")).agg(F.collect_list(F.struct("turn", "text")).alias("turns"))
    writers.json_object(whole, "id", f"{root}/object")
    read = documents.entries(spark, f"{root}/object/*.json", "turns array<struct<turn: long, text: string>>")
    return read.select("id", F.explode("turns").alias("t")).select("id", "t.turn", F.md5("t.text").alias("digest"))


# Experiments in nested documents ---------------------------------------------------------------------------------

_TASKS = ("MANAGE", "VISIT", "RESOURCE")
_CASES = f"""s AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'original' ELSE 'pct' || turn || '.5' END AS variant, unnest(['MANAGE', 'VISIT', 'RESOURCE']) AS task, text FROM conversations WHERE text IS NOT NULL),
h AS (SELECT *, {_HASHED.format(x="task || ':' || conv_id || ':' || turn")} AS h FROM s WHERE (conv_id + turn) % 5 <> 3 OR task <> 'VISIT'),
c AS (SELECT *, CASE WHEN turn = 0 THEN h % 101 / 100.0::DOUBLE END AS p, [h % 2, h // 2 % 2, h // 4 % 2] AS votes FROM h),
y AS (SELECT *, CAST(list_sum(votes) >= 2 AS INT) AS y FROM c)"""


def _experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of an experiment made of the conversations, written as one JSON array, and read as cases."""
    turn, conv = F.col("turn"), F.col("conv_id")
    tasks = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text", F.explode(F.array(*map(F.lit, _TASKS))).alias("task"))
    tasks = tasks.where(((conv + turn) % 5 != 3) | (F.col("task") != "VISIT"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "task", conv.cast("string"), turn.cast("string"))), 1, 8), 16, 10).cast("long")
    variant = F.when(turn == 0, "original").otherwise(F.concat(F.lit("pct"), turn.cast("string"), F.lit(".5")))
    votes = F.array(*[(F.shiftright(F.col("h"), k) % 2).cast("int") for k in range(3)])
    answer = F.struct(F.array(F.lit(0), F.lit(1), F.lit(2)).alias("seeds"), F.array("text").alias("model_responses"), votes.alias("binary_answers"), F.when(turn == 0, F.col("h") % 101 / 100.0).alias("logit_probs"))
    keyed = tasks.withColumn("h", h).select("conv_id", F.to_json(F.create_map(F.concat_ws("_", variant, "task"), answer)).alias("one"))
    # Keys are known from the rows alone: the objects of a case are put into one.
    parts = keyed.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.expr("substring(one, 2, length(one) - 2)"))), ",").alias("body"))
    texts = parts.select(F.concat(F.lit('{"context_id":"N'), F.col("conv_id").cast("string"), F.lit('",'), "body", F.lit("}")).alias("value"))
    root = Scratch(spark, "exchange").root
    writers.joined(texts, f"{root}/experiment", "[", ",", "]")
    return documents.cases(spark, documents.elements(spark, f"{root}/experiment/*.json").select("value"))


@query(
    "SRC-11 RSH-4 SCR-3",
    f"WITH {_CASES} SELECT 'N' || conv_id AS case_id, variant, task, {R('CASE WHEN p IS NOT NULL THEN ln(greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE))) END')} AS z, y FROM y",
)
def experiment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits and majority votes from nested documents whose keys name variant and task."""
    made = _experiment(spark, sf_dir)
    votes = F.aggregate("votes", F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return rounded(made.select("case_id", "variant", "task", dv.logit(F.col("p")).alias("z"), (votes >= 2).cast("int").alias("y")))


@query(
    "JOIN-6 TST-24 RSH-4",
    f"""WITH {_CASES}, j AS (SELECT CAST(turn AS DOUBLE) + 0.5 AS level, task, e.y AS e, o.y AS o FROM y e JOIN (SELECT conv_id, task, y FROM y WHERE turn = 0) o USING (conv_id, task) WHERE turn > 0),
k AS (SELECT level, task, CAST(count(*) AS DOUBLE) AS n, {', '.join(f"CAST(count(*) FILTER (o = {a} AND e = {b}) AS DOUBLE) AS p{a}{b}" for a in (0, 1) for b in (0, 1))} FROM j GROUP BY 1, 2)
SELECT level, task, n, {R('(p01 + p10) / n')} AS flip_rate, {R(mi_sql('p'))} AS mi FROM k""",
)
def dose_response_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dose and response from the same documents: levels are found in the keys, cases without either answer are left out."""
    made = _experiment(spark, sf_dir).select("case_id", "variant", "task", (F.aggregate("votes", F.lit(0), lambda s, v: s + v) >= 2).cast("int").alias("y"))
    level = F.regexp_extract("variant", r"^pct([0-9.]+)$", 1).try_cast("double")
    edited = made.select("case_id", "task", level.alias("level"), F.col("y").alias("e")).where("level IS NOT NULL")
    votes = edited.join(made.where("variant = 'original'").select("case_id", "task", F.col("y").alias("o")), ["case_id", "task"])
    return rounded(bt.dose_response(votes, "level", "task", "o", "e"))


# Work kept piece by piece ----------------------------------------------------------------------------------------

_PIECE = _HASHED.format(x="CAST(doc_id AS VARCHAR)") + " % 8"


@query("INC-1 INC-4 INC-5", f"SELECT doc_id, md5(text || ' done') AS digest, CAST(CASE WHEN {_PIECE} IN (1, 4, 5, 6, 7) THEN 2 ELSE 1 END AS INT) AS run FROM documents")
def pieced_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run cut off after half its pieces, of which one is then torn; the next does that one and the missing ones."""
    root, docs = Scratch(spark, "pieces").root, table(spark, sf_dir, "documents").select("doc_id", "text")
    held = Pieces(spark, root, ["doc_id"], pieces=8, at_once=2)
    work = lambda run: lambda df: df.select("doc_id", F.md5(F.concat("text", F.lit(" done"))).alias("digest"), F.lit(run).alias("run"))
    held.run(docs, work(1), waves=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    torn = jvm.org.apache.hadoop.fs.Path(f"{root}/data/*/__piece=1/*.parquet")
    fs = torn.getFileSystem(conf)
    for s in fs.globStatus(torn) or []:
        fs.delete(s.getPath(), False)
    held.run(docs, work(2))
    return held.result(work(2)(docs).schema)


# Workbooks -------------------------------------------------------------------------------------------------------


@query(
    "SRC-7 SNK-1 SNK-2",
    f"""WITH {E_SQL}, c AS ({count4('p')})
SELECT 'rates' AS sheet, perturbation || '/' || task AS name, CAST(n AS BIGINT) AS n, {R('(p01 + p10) / n')} AS value, (p01 + p10) / n > 0.1 AS flag, CAST(NULL AS VARCHAR) AS digest FROM c
UNION ALL SELECT 'sources', source, count(*), {R('avg(CAST(n_chars AS DOUBLE))')}, bool_or(lang = 'de'), md5(min(text) || chr(10) || '<&_x0041_>') FROM documents GROUP BY source""",
)
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result tables of two analyses in one workbook, typed cells and whole texts among them, and read back."""
    c = stats.pair_counts(bt.answers(triples(spark, sf_dir)), CELLS, "o", "p").withColumn("n", sum((F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1)), F.lit(0.0)))
    rate = (F.col("n01") + F.col("n10")) / F.col("n")
    rates = c.select(F.concat_ws("/", *CELLS).alias("name"), F.col("n").cast("long").alias("n"), rate.alias("value"), (rate > 0.1).alias("flag"))
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name"))
    sources = docs.agg(F.count("*").alias("n"), F.avg("n_chars").alias("value"), F.bool_or(F.col("lang") == "de").alias("flag"), F.concat(F.min("text"), F.lit("\n<&_x0041_>")).alias("first text"))
    path = Scratch(spark, "exchange").root + "/book.xlsx"
    workbook.write({"rates": rates, "sources": sources}, path)
    schema = "name string, n long, value double, flag boolean, `first text` string"
    read = [workbook.read(spark, path, s, schema).withColumn("sheet", F.lit(s)) for s in ("rates", "sources")]
    return rounded(read[0].unionByName(read[1]).select("sheet", "name", "n", "value", "flag", F.md5("first text").alias("digest")))


# Whole runs ------------------------------------------------------------------------------------------------------

_CELL_COUNT = "(SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem))"


@query(
    "ORC-1 PLB-1",
    f"SELECT 'flip_rate_by_cell' AS name, {_CELL_COUNT} AS n, true AS again UNION ALL SELECT 'majority_vote', (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)), true UNION ALL SELECT 'phi_by_cell', {_CELL_COUNT}, true",
)
def umbrella_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several analyses in one run, each into its folder; a second run finds all of them done but one that was taken away."""
    from evenkeel.__main__ import run_all

    scratch, names = Scratch(spark, "umbrella"), ["flip_rate_by_cell", "majority_vote", "phi_by_cell"]
    done = run_all(spark, sf_dir, scratch.root, names)
    scratch.drop("majority_vote")
    again = run_all(spark, sf_dir, scratch.root, names)
    good = done == names and again == ["majority_vote"]
    parts = [spark.read.parquet(f"{scratch.root}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.lit(good).alias("again")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
