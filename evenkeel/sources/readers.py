"""Scans with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import lexicons


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file, folder or glob with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text."""
    return csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def csv_by_file(spark: SparkSession, path: str, schema: str, categories: Mapping[str, str], name: str = "context") -> DataFrame:
    """Files of a folder with a category for each file name; other files are left out."""
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return csv(spark, path, schema).withColumn(name, F.try_element_at(table, F.url_decode(file))).where(F.col(name).isNotNull())


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records (or one record to a line)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, one to a line, as the record sink writes them; files are split among tasks."""
    return spark.read.schema(schema).json(path)


def json_map(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """A JSON object whose keys are ids: one row per entry, with the record's fields beside `key`."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "__record"))
    return entries.select(key, "__record.*")


def json_cases(spark: SparkSession, path: str, schema: str, id_col: str, answer: str) -> DataFrame:
    """Records with dynamic keys `<variant>_<TASK>`, as one row per case, variant and task.

    schema is that of the record's fixed fields; every other key must hold an `answer`.
    """
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("r"))
    fixed = F.from_json("r", schema)
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    items = text.select(fixed[id_col].alias(id_col), F.explode(F.from_json("r", "map<string,string>")).alias("k", "v")).where(~F.col("k").isin(*names))
    return items.select(id_col, F.regexp_extract("k", r"^(.*)_([^_]+)$", 1).alias("variant"), F.regexp_extract("k", r"^(.*)_([^_]+)$", 2).alias("task"), F.from_json("v", answer).alias("a")).select(id_col, "variant", "task", "a.*")


def parquet(spark: SparkSession, path: str, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """A Parquet table; it stands for workbooks, pickles and hub datasets, which are exported once."""
    return spark.read.parquet(path).withColumnsRenamed(dict(renamed or {}))


def samples(spark: SparkSession, path: str, where: Column, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of a table that a loader takes; the filter reaches the scan."""
    return spark.read.parquet(path).where(where).withColumnsRenamed(dict(renamed or {}))


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The newest version (v=1, v=2, ...) whose write has finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    numbers = sorted((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), reverse=True)
    for k in numbers:
        if fs.exists(path(f"{root}/v={k}/_SUCCESS")):
            return spark.read.parquet(f"{root}/v={k}")
    raise FileNotFoundError(f"no finished version in {root}")


def checked(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """df; the query fails at a value that is not allowed (null is)."""
    wrong = F.raise_error(F.concat(F.lit(f"{column} has a value that is not allowed: "), F.col(column).cast("string"))).cast("boolean")
    return df.where(F.when(F.col(column).isNull() | F.col(column).isin(*allowed), True).otherwise(wrong))


def label_letter(label: Column, letters: str = "ABCD") -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in letters]), label + 1)


def na_as_text(c: Column) -> Column:
    """NA spellings as the text `nan`, all else as it stands."""
    return F.when(F.btrim(c).isin(*lexicons.NA_SPELLINGS), F.lit("nan")).otherwise(c)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns as null."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns])


def logits_of_votes(scores: DataFrame, p: str, votes: str, threshold: int = 2) -> DataFrame:
    """z from a clamped probability, and y: whether at least `threshold` votes are 1."""
    from evenkeel.functions.divergence import logit

    count = F.aggregate(votes, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return scores.withColumns({"z": logit(F.col(p)), "y": (count >= threshold).cast("int")})
