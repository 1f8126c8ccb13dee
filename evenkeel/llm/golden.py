"""One record for each cluster of duplicate client rows: which value of each field survives.

Aggregates only: the first gives each cluster's latest change, which is joined back to tell stale rows; then every field
is taken by max_by over a struct that spells its rule out, in one pass; the balance, whose rule needs the segment that
was chosen, takes one more join and aggregate.

Two orders of rows: RECENT (latest updated_at, null last; higher trust; smaller id, null last) and TRUSTED (fresh before
stale; higher trust; then RECENT).

    segment   the first that is not null by RECENT
    email     by TRUSTED
    name      by most code points, then TRUSTED
    balance   rows with the chosen segment before all others, then RECENT
    address   city and nation_id of one row, even if null: most of the two not null, then TRUSTED

All aggregates keep partial results in the tasks before they are shuffled, and clusters with very many rows are joined
apart (common.join_hot), so that no task holds the rows of a cluster.

Nulls and odd rows: a string that is empty or all white space is null, others are left as they are; a balance that is NaN
or infinite is null; a source that is null or not in the list has the least trust; a row whose updated_at is null is
stale.  Rows with neither master nor id are one cluster, with a null cluster_id.  Repeated rows count as rows and change
nothing else; rows that tie in a rule (as where ids recur) are told apart by the value itself, the largest staying.
Columns beyond those named are not read.  An empty table gives no records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import Scratch, join_hot

#: Sources by falling trust.
TRUST = ("partner", "store", "web", "crm")
#: Days before the cluster's latest change after which a row is stale.
FRESH_DAYS = 30


def filled(c: Column) -> Column:
    """c, or null where it holds white space only."""
    return F.when(c.rlike(r"[^\x20\x09-\x0D]"), c)


def trust(source: Column, order: Sequence[str] = TRUST) -> Column:
    """The number of sources that are trusted less, 0 for unknown ones."""
    return F.coalesce(*[F.when(source == s, F.lit(len(order) - i)) for i, s in enumerate(order)], F.lit(0))


def _best(order: Sequence[Column], *fields: str, where: Column | None = None) -> Column:
    """The fields and the id of the first row in the order, of those where all fields are there (or `where` holds)."""
    there = F.col(fields[0]).isNotNull() if where is None else where
    return F.max_by(F.struct(*fields, "client_id"), F.when(there, F.struct(*[x.alias(f"k{i}") for i, x in enumerate([*order, *map(F.col, fields)])])))


def survivors(spark: SparkSession, clients: DataFrame, order: Sequence[str] = TRUST, fresh_days: int = FRESH_DAYS) -> DataFrame:
    """cluster_id, n_records, n_stale, the chosen fields (name, email, segment, city, nation_id, balance) and the ids that
    they come from (name_from, email_from, segment_from, balance_from, address_from; null where the value is)."""
    scratch = Scratch(spark, "golden")
    cluster = F.coalesce("master_id", "client_id")
    balance = F.when(~F.isnan("balance") & (F.abs("balance") < float("inf")), F.col("balance"))
    rows = clients.select(
        F.coalesce(cluster.cast("string"), F.lit("")).alias("key"), cluster.alias("cluster_id"), "client_id", "updated_at", trust(F.col("source"), order).alias("trust"),
        filled(F.col("name")).alias("name"), filled(F.col("email")).alias("email"), filled(F.col("segment")).alias("segment"), filled(F.col("city")).alias("city"), "nation_id", balance.alias("balance"),
    )
    latest = scratch.keep(rows.groupBy("key").agg(F.max("updated_at").alias("latest"), F.count("*").alias("n")), "latest")
    total = latest.agg(F.sum("n")).first()[0] or 0
    stale = F.coalesce(F.col("latest") - F.col("updated_at") > F.expr(f"INTERVAL '{fresh_days}' DAY"), F.lit(True))
    dated = join_hot(rows, latest, "key", "n", total).withColumn("stale", stale)

    recent = [F.col("updated_at"), F.col("trust"), F.bitwise_not("client_id")]
    trusted = [~F.col("stale"), F.col("trust"), *recent]
    there = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    first = dated.groupBy("key").agg(
        F.max("cluster_id").alias("cluster_id"), F.count("*").alias("n_records"), F.count_if("stale").alias("n_stale"),
        _best([F.length("name"), *trusted], "name").alias("name"), _best(trusted, "email").alias("email"), _best(recent, "segment").alias("segment"),
        _best([there, *trusted], "city", "nation_id", where=F.lit(True)).alias("address"),
    )
    first = scratch.keep(first, "records")

    segments = first.select("key", F.col("segment.segment").alias("chosen"), F.col("n_records").alias("n"))
    own = (F.col("segment") == F.col("chosen")) & F.col("segment").isNotNull()
    told = join_hot(rows.where(F.col("balance").isNotNull()), segments, "key", "n", total)
    second = told.groupBy("key").agg(_best([F.coalesce(own, F.lit(False)), *recent], "balance").alias("balance"))
    address = F.coalesce(F.col("address.city").isNotNull() | F.col("address.nation_id").isNotNull(), F.lit(False))
    return first.join(second, "key", "left").select(
        "cluster_id", "n_records", "n_stale", "name.name", "email.email", "segment.segment", "address.city", "address.nation_id", "balance.balance",
        F.col("name.client_id").alias("name_from"), F.col("email.client_id").alias("email_from"), F.col("segment.client_id").alias("segment_from"),
        F.col("balance.client_id").alias("balance_from"), F.when(address, F.col("address.client_id")).alias("address_from"),
    )


def cents(balance: Column) -> Column:
    """A balance in cents, halves rounded up; beyond a long, the nearest long."""
    return F.floor(F.lit(100) * balance + F.lit(0.5))
