"""Queries over the driver's tables, one or more for each operator family, with SQL that DuckDB can run beside them.

Doubles are rounded to six places on both sides.  Word borders are those of Unicode letters and digits on both sides;
DuckDB's own are ASCII, so that its SQL spells them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.functions import divergence as dv
from evenkeel.functions import lexicons, parse, text, tokens
from evenkeel.functions.special import NODES
from evenkeel.operators import alignment, windows
from evenkeel.plans import battery as bt
from evenkeel.plans import stats
from evenkeel.sources import writers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}

CELLS = ["perturbation", "task"]


def query(operators: str, sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        OPERATORS[f.__name__] = operators
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of an original, a targeted and a benign variant, by cell (perturbation, task), clustered."""
    z = (F.col("l_quantity") - 25.5) / 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cluster_id"), F.col("l_returnflag").alias("perturbation"), F.col("l_linestatus").alias("task"),
        z.alias("logit_original"), (z + (F.col("l_discount") - 0.05) * 40).alias("logit_swapped"), (z + (F.col("l_tax") - 0.04) * 20).alias("logit_baseline"),
    )


def chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with probabilities po, pp, pb."""
    return dv.probabilities(triples(spark, sf_dir), po="logit_original", pp="logit_swapped", pb="logit_baseline")


# SQL parts -------------------------------------------------------------------------------------------------------


def R(x: str) -> str:
    return f"ROUND({x}, 6) + 0.0::DOUBLE"


E_SQL = """e AS (SELECT l_orderkey AS cluster_id, l_returnflag AS perturbation, l_linestatus AS task, z AS logit_original,
  z + (l_discount - 0.05::DOUBLE) * 40 AS logit_swapped, z + (l_tax - 0.04::DOUBLE) * 20 AS logit_baseline
  FROM (SELECT *, (l_quantity - 25.5::DOUBLE) / 10 AS z FROM lineitem)),
v AS (SELECT *, CAST(logit_original > 0 AS INT) AS o, CAST(logit_swapped > 0 AS INT) AS p, CAST(logit_baseline > 0 AS INT) AS b,
  1 / (1 + exp(-logit_original)) AS po, 1 / (1 + exp(-logit_swapped)) AS pp, 1 / (1 + exp(-logit_baseline)) AS pb FROM e)"""


def _simpson(density: str, low: str, width: str) -> str:
    return f"(list_sum([(CASE WHEN i = 0 OR i = {NODES} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.format(x=f'({low} + {width} * i / {NODES}.0::DOUBLE)')} FOR i IN range(0, {NODES + 1})]) * {width} / {3 * NODES})"


def nsf(z: str) -> str:
    """P(Z > z) for z >= 0."""
    return f"({_simpson('exp(-{x} * {x} / 2)', f'({z})', '12.0::DOUBLE')} / sqrt(2 * pi()))"


def tsf(t: str, nu: str) -> str:
    """P(T > t) for any t."""
    cos = f"pow(cos({{x}}), {nu} - 1)"
    start, reach = f"atan(abs({t}) / sqrt({nu}))", f"(14 / sqrt({nu}))"
    up = f"({_simpson(cos, start, f'least(pi() / 2 - {start}, {reach})')} / (2 * {_simpson(cos, '0.0::DOUBLE', f'least(pi() / 2, {reach})')}))"
    return f"(CASE WHEN {t} >= 0 THEN {up} ELSE 1 - {up} END)"


def count4(arm: str, cells: str = "perturbation, task") -> str:
    n = ", ".join(f"CAST(count(*) FILTER (o = {i} AND {arm} = {j}) AS DOUBLE) AS {arm}{i}{j}" for i in (0, 1) for j in (0, 1))
    return f"SELECT {cells}, {n}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY {cells}"


def mi_sql(a: str) -> str:
    parts = [f"CASE WHEN {a}{i}{j} > 0 THEN {a}{i}{j} / n * log2({a}{i}{j} * n / (({a}{i}0 + {a}{i}1) * ({a}0{j} + {a}1{j}))) ELSE 0 END" for i in (0, 1) for j in (0, 1)]
    return "(" + " + ".join(parts) + ")"


def phi_sql(a: str) -> str:
    m = f"(({a}10 + {a}11) * ({a}00 + {a}01) * ({a}01 + {a}11) * ({a}00 + {a}10))"
    return f"(CASE WHEN {m} > 0 THEN ({a}11 * {a}00 - {a}10 * {a}01) / sqrt({m}) ELSE 0 END)"


def jsd_sql(p: str, q: str) -> str:
    parts = []
    for a, b in ((p, q), (f"(1 - {p})", f"(1 - {q})")):
        m = f"(({a} + {b}) / 2)"
        parts += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) / 2 ELSE 0 END" for x in (a, b)]
    return f"(CASE WHEN {p} = {q} THEN 0 ELSE {' + '.join(parts)} END)"


def kl_sql(p: str, q: str) -> str:
    return f"({p} * log2({p} / {q}) + (1 - {p}) * log2((1 - {p}) / (1 - {q})))"


def clip_sql(p: str) -> str:
    return f"greatest(least({p}, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)"


def floor_sql(p: str) -> str:
    return f"(greatest({p}, 1e-10::DOUBLE) / (greatest({p}, 1e-10::DOUBLE) + greatest(1 - {p}, 1e-10::DOUBLE)))"


def t_sql(d: str, cells: str = "perturbation, task") -> str:
    t = "(CASE WHEN n > 1 AND sd > 0 THEN mean * sqrt(n) / sd ELSE 0 END)"
    return f"""SELECT {cells}, n, {R('mean')} AS mean, {R('sd')} AS sd, {R('t')} AS t,
  {R('CASE WHEN n > 1 AND sd > 0 THEN 2 * least(up, 1 - up) ELSE 1 END')} AS p_two, {R('CASE WHEN n > 1 AND sd > 0 THEN up ELSE 1 END')} AS p_greater, {R('CASE WHEN n > 1 AND sd > 0 THEN 1 - up ELSE 1 END')} AS p_less
FROM (SELECT *, {tsf('t', 'greatest(n - 1, 1.0::DOUBLE)')} AS up FROM (SELECT *, {t} AS t FROM (SELECT {cells}, CAST(count(d) AS DOUBLE) AS n, avg(d) AS mean, coalesce(stddev_samp(d), 0) AS sd FROM (SELECT *, {d} AS d FROM v) GROUP BY {cells})))"""


# Missing answers -----------------------------------------------------------------------------------------------------


_MISSING = "CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN {c} END AS {c}"


@query(
    "FLT-11 MET-5 MET-6 SCR-3",
    f"""WITH {E_SQL}, m AS (SELECT perturbation, task, cluster_id, CASE WHEN cluster_id % 13 = 1 THEN NULL ELSE logit_original END AS logit_original, CASE WHEN cluster_id % 11 = 2 THEN 'NaN'::DOUBLE ELSE logit_swapped END AS logit_swapped,
  CASE WHEN cluster_id % 7 = 3 THEN NULL WHEN cluster_id % 7 = 4 THEN 'NaN'::DOUBLE ELSE logit_baseline END AS logit_baseline FROM e),
k AS (SELECT *, 1 / (1 + exp(-logit_original)) AS po, 1 / (1 + exp(-logit_swapped)) AS pp, 1 / (1 + exp(-logit_baseline)) AS pb
  FROM (SELECT perturbation, task, {', '.join(_MISSING.format(c=c) for c in ('logit_original', 'logit_swapped', 'logit_baseline'))} FROM m)
  WHERE logit_original IS NOT NULL AND logit_swapped IS NOT NULL AND logit_baseline IS NOT NULL)
SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, {R('avg(CAST((logit_original > 0) <> (logit_swapped > 0) AS INT))')} AS flip_rate, {R(f"avg({jsd_sql('po', 'pp')} - {jsd_sql('po', 'pb')})")} AS jsd,
  {R(f"avg({kl_sql(clip_sql('po'), clip_sql('pp'))} - {kl_sql(clip_sql('po'), clip_sql('pb'))})")} AS kl, {R(f"avg({kl_sql(floor_sql('po'), floor_sql('pp'))} - {kl_sql(floor_sql('po'), floor_sql('pb'))})")} AS kl_floored
FROM k GROUP BY perturbation, task""",
)
def missing_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of a cell leaves out the same cases: those with a null or NaN logit in any variant."""
    k, nan = F.col("cluster_id"), F.lit(float("nan"))
    gaps = triples(spark, sf_dir).withColumns({
        "logit_original": F.when(k % 13 != 1, F.col("logit_original")), "logit_swapped": F.when(k % 11 == 2, nan).otherwise(F.col("logit_swapped")),
        "logit_baseline": F.when(k % 7 == 4, nan).when(k % 7 != 3, F.col("logit_baseline")),
    })
    counts = stats.triple_counts(bt.answers(gaps), CELLS, "o", "p", "b")
    flips = counts.select(*CELLS, stats.flip_rate(stats.margins("p")).alias("flip_rate"))
    rows = dv.probabilities(gaps, po="logit_original", pp="logit_swapped", pb="logit_baseline")
    gap = lambda f: f(F.col("po"), F.col("pp")) - f(F.col("po"), F.col("pb"))
    each = {"jsd": dv.jsd_bits, "kl": dv.kl_bits_clipped, "kl_floored": dv.kl_bits_floored}
    means = rows.select(*CELLS, *[gap(f).alias(n) for n, f in each.items()]).groupBy(*CELLS).agg(*[F.count(n).cast("double").alias(f"n_{n}") for n in each], *[F.avg(n).alias(n) for n in each])
    same = (F.col("n_jsd") == F.col("n_kl")) & (F.col("n_jsd") == F.col("n_kl_floored"))
    return rounded(flips.join(means, CELLS).select(*CELLS, F.when(same, F.col("n_jsd")).alias("n"), "flip_rate", *each))


# Count metrics ---------------------------------------------------------------------------------------------------


@query(
    "MET-7 MET-8 AGG-9 TST-8 MUL-1 SCR-1",
    f"""WITH {E_SQL}, c AS (SELECT perturbation, task, count(*) AS n, avg(CAST(o <> p AS DOUBLE)) AS fp, avg(CAST(o <> b AS DOUBLE)) AS fb,
  CAST(count(*) FILTER (o <> p AND o = b) AS DOUBLE) AS g, CAST(count(*) FILTER (o <> b AND o = p) AS DOUBLE) AS h FROM v GROUP BY 1, 2)
SELECT perturbation, task, n, {R('fp')} AS flip_pert, {R('fb')} AS flip_base, {R('fp - fb')} AS diff, {R('s')} AS mcnemar, {R(f"CASE WHEN s > 0 THEN 2 * {nsf('sqrt(s)')} ELSE 1 END")} AS p, coalesce(CASE WHEN s > 0 THEN 2 * {nsf('sqrt(s)')} ELSE 1 END < 0.05::DOUBLE / 6, false) AS significant
FROM (SELECT *, CASE WHEN g + h > 0 THEN pow(abs(g - h) - 1, 2) / (g + h) ELSE 0 END AS s FROM c)""",
)
def flip_rate_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell: does the targeted edit flip more answers than the benign one?"""
    rows = bt.answers(triples(spark, sf_dir))
    g, h = F.col("o") != F.col("p"), F.col("o") != F.col("b")
    c = rows.groupBy(*CELLS).agg(F.count("*").alias("n"), F.avg(g.cast("double")).alias("flip_pert"), F.avg(h.cast("double")).alias("flip_base"), F.count_if(g & ~h).cast("double").alias("g"), F.count_if(h & ~g).cast("double").alias("h"))
    stat, p = stats.mcnemar(F.col("g"), F.col("h"))
    out = c.select(*CELLS, "n", "flip_pert", "flip_base", (F.col("flip_pert") - F.col("flip_base")).alias("diff"), stat.alias("mcnemar"), p.alias("p"))
    return rounded(out.withColumn("significant", stats.bonferroni(F.col("p"), 6)))


def _both_arms(spark: SparkSession, sf_dir: str, metric) -> DataFrame:
    c = stats.triple_counts(bt.answers(triples(spark, sf_dir)), CELLS, "o", "p", "b")
    return rounded(c.select(*CELLS, metric(stats.margins("p")).alias("pert"), metric(stats.margins("b")).alias("base")))


@query("MET-9 AGG-9 TWN-2", f"WITH {E_SQL}, a AS ({count4('p')}), b4 AS ({count4('b')}) SELECT a.perturbation, a.task, {R('m')} AS pert, {R('k')} AS base FROM (SELECT perturbation, task, {mi_sql('p')} AS m FROM a) a JOIN (SELECT perturbation, task, {mi_sql('b')} AS k FROM b4) b4 USING (perturbation, task)")
def mi_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_arms(spark, sf_dir, stats.mutual_information)


@query("MET-10", f"WITH {E_SQL}, a AS ({count4('p')}), b4 AS ({count4('b')}) SELECT a.perturbation, a.task, {R('m')} AS pert, {R('k')} AS base FROM (SELECT perturbation, task, {phi_sql('p')} AS m FROM a) a JOIN (SELECT perturbation, task, {phi_sql('b')} AS k FROM b4) b4 USING (perturbation, task)")
def phi_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_arms(spark, sf_dir, stats.phi)


@query(
    "MET-12 SET-1",
    f"""WITH {E_SQL}, c AS (SELECT perturbation, task, CAST(count(*) FILTER (o <> p AND o <> b) AS DOUBLE) AS "both", CAST(count(*) FILTER (o <> p AND o = b) AS DOUBLE) AS only_g, CAST(count(*) FILTER (o = p AND o <> b) AS DOUBLE) AS only_b FROM v GROUP BY 1, 2)
SELECT *, {R('coalesce("both" / nullif("both" + only_g + only_b, 0), 0)')} AS jaccard, {R('coalesce("both" / nullif("both" + only_g, 0), 0)')} AS p_b_given_g, {R('coalesce("both" / nullif("both" + only_b, 0), 0)')} AS p_g_given_b,
  {R('coalesce(only_g / nullif("both" + only_g, 0), 0)')} AS g_specific, {R('coalesce(only_b / nullif("both" + only_b, 0), 0)')} AS b_specific FROM c""",
)
def flip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.answers(triples(spark, sf_dir))
    return rounded(stats.overlap(rows, CELLS, F.col("o") != F.col("p"), F.col("o") != F.col("b")))


@query("MET-12 SET-1 SET-3", f"WITH {E_SQL} SELECT DISTINCT cluster_id FROM v WHERE o <> p INTERSECT SELECT DISTINCT cluster_id FROM v WHERE o <> b")
def flipped_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.answers(triples(spark, sf_dir))
    return rows.where("o != p").select("cluster_id").intersect(rows.where("o != b").select("cluster_id"))


@query("SET-1 JOIN-14", f"WITH {E_SQL} SELECT DISTINCT cluster_id FROM v WHERE o <> p EXCEPT SELECT DISTINCT cluster_id FROM v WHERE o <> b")
def flipped_only_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.answers(triples(spark, sf_dir))
    return rows.where("o != p").select("cluster_id").subtract(rows.where("o != b").select("cluster_id"))


# Row metrics -----------------------------------------------------------------------------------------------------


@query("MET-2 MET-3 MET-4 TST-1 TST-2 FUN-1", f"WITH {E_SQL} {t_sql(jsd_sql('po', 'pp') + ' - ' + jsd_sql('po', 'pb'))}")
def jsd_bits_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.paired_t(chances(spark, sf_dir), CELLS, dv.jsd_bits(F.col("po"), F.col("pp")) - dv.jsd_bits(F.col("po"), F.col("pb"))))


@query("MET-5 TST-2 SCR-3", f"WITH {E_SQL} {t_sql(kl_sql(clip_sql('po'), clip_sql('pp')) + ' - ' + kl_sql(clip_sql('po'), clip_sql('pb')))}")
def kl_clip_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.paired_t(chances(spark, sf_dir), CELLS, dv.kl_bits_clipped(F.col("po"), F.col("pp")) - dv.kl_bits_clipped(F.col("po"), F.col("pb"))))


@query("MET-6 TST-2", f"WITH {E_SQL} {t_sql(kl_sql(floor_sql('po'), floor_sql('pp')) + ' - ' + kl_sql(floor_sql('po'), floor_sql('pb')))}")
def kl_floor_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.paired_t(chances(spark, sf_dir), CELLS, dv.kl_bits_floored(F.col("po"), F.col("pp")) - dv.kl_bits_floored(F.col("po"), F.col("pb"))))


def _soft_sql(a: int) -> str:
    z = f"list_transform(embedding[{a}:{a + 3}], lambda x: CAST(x AS DOUBLE))"
    e = f"list_transform({z}, lambda x: exp(x - list_max({z})))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


@query(
    "SCR-2 MET-1 MET-14 AGG-15 MET-11 PRJ-4",
    f"""WITH s AS (SELECT vec_id, {_soft_sql(1)} AS p, {_soft_sql(5)} AS q, {_soft_sql(9)} AS r FROM embeddings),
j AS (SELECT vec_id, p, q, list_sum([CASE WHEN p[i] > 0 THEN p[i] * ln(p[i] / ((p[i] + q[i]) / 2)) / 2 ELSE 0 END + CASE WHEN q[i] > 0 THEN q[i] * ln(q[i] / ((p[i] + q[i]) / 2)) / 2 ELSE 0 END FOR i IN range(1, 5)]) AS g,
  list_sum([CASE WHEN p[i] > 0 THEN p[i] * ln(p[i] / ((p[i] + r[i]) / 2)) / 2 ELSE 0 END + CASE WHEN r[i] > 0 THEN r[i] * ln(r[i] / ((p[i] + r[i]) / 2)) / 2 ELSE 0 END FOR i IN range(1, 5)]) AS b FROM s)
SELECT vec_id, {R('g')} AS jsd_targeted, {R('b')} AS jsd_benign, {R('g - b')} AS jsd_difference, substr('ABCD', list_position(p, list_max(p)), 1) AS original_answer, substr('ABCD', list_position(q, list_max(q)), 1) AS swapped_answer, list_position(p, list_max(p)) = list_position(q, list_max(q)) AS answers_match FROM j""",
)
def jsd_nats_softmax4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double"))
    s = table(spark, sf_dir, "embeddings").select("vec_id", *[dv.softmax(cut(a)).alias(n) for a, n in ((1, "p"), (5, "q"), (9, "r"))])
    g, b = dv.jsd_nats(F.col("p"), F.col("q")), dv.jsd_nats(F.col("p"), F.col("r"))
    answer = lambda c: parse.argmax_first([(n, F.col(c)[i]) for i, n in enumerate("ABCD")])
    return rounded(s.select("vec_id", g.alias("jsd_targeted"), b.alias("jsd_benign"), (g - b).alias("jsd_difference"), answer("p").alias("original_answer"), answer("q").alias("swapped_answer"), (answer("p") == answer("q")).alias("answers_match")))


@query("AGG-5 AGG-6 FUN-4 SNK-8", f"WITH {E_SQL} SELECT metric, {R('value')} AS value FROM (SELECT unnest(['mean', 'median', 'p95', 'sd', 'max']) AS metric, unnest([avg(d), quantile_cont(d, 0.5), quantile_cont(d, 0.95), stddev_pop(d), max(d)]) AS value FROM (SELECT {jsd_sql('po', 'pp')} AS d FROM v))")
def aggregate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chances(spark, sf_dir).select(dv.jsd_bits(F.col("po"), F.col("pp")).alias("d"))
    one = windows.quantiles(d, "d", (0.5, 0.95), again=True, also=[F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.max("d").alias("max")])
    return rounded(writers.metric_value(one.select("mean", F.col("q0").alias("median"), F.col("q1").alias("p95"), "sd", "max")))


@query(
    "TST-4 TST-5 FUN-2",
    f"WITH {E_SQL} SELECT perturbation, task, count(*) AS n, {R('avg(d)')} AS mean, {R('stddev_samp(d) / sqrt(count(*))')} AS se, {R('avg(d) * sqrt(count(*)) / stddev_samp(d)')} AS t FROM (SELECT *, logit_swapped - logit_baseline AS d FROM v) GROUP BY 1, 2",
)
def paired_t_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.paired_t(triples(spark, sf_dir), CELLS, F.col("logit_swapped") - F.col("logit_baseline"))
    return rounded(m.select(*CELLS, F.col("n").cast("long").alias("n"), "mean", (F.col("sd") / F.sqrt("n")).alias("se"), "t"))


def _ci_sql(levels: tuple[float, ...]) -> str:
    """Quantiles by sixty bisections, as a recursive query over the few cells."""
    m = "m AS (SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM (SELECT *, logit_swapped - logit_baseline AS d FROM v) GROUP BY 1, 2)"
    q = f"q AS (SELECT perturbation, task, n - 1 AS nu, unnest({[0.5 - x / 2 for x in levels]}) AS p, unnest(range({len(levels)})) AS i, 0.0::DOUBLE AS low, 1000.0::DOUBLE AS high, 0 AS k FROM m UNION ALL SELECT perturbation, task, nu, p, i, CASE WHEN u > p THEN (low + high) / 2 ELSE low END, CASE WHEN u > p THEN high ELSE (low + high) / 2 END, k + 1 FROM (SELECT *, {tsf('((low + high) / 2)', 'nu')} AS u FROM q WHERE k < 60))"
    ends = ", ".join(f"{R(f'mean {s} max((low + high) / 2) FILTER (i = {i}) * any_value(sd) / sqrt(any_value(n))')} AS ci_{e}_{i}" for i in range(len(levels)) for s, e in (("-", "low"), ("+", "high")))
    t = "any_value(mean) * sqrt(any_value(n)) / any_value(sd)"
    up = tsf("t", "(n - 1)")
    return f"WITH RECURSIVE {E_SQL}, {m}, {q}, r AS (SELECT perturbation, task, any_value(m.n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, {t} AS t, {ends.replace('mean -', 'any_value(mean) -').replace('mean +', 'any_value(mean) +').replace('any_value(n)', 'any_value(m.n)')} FROM q JOIN m USING (perturbation, task) WHERE k = 60 GROUP BY 1, 2), s AS (SELECT *, {up} AS up FROM r) SELECT perturbation, task, n, {R('mean')} AS mean, {R('sd')} AS sd, {R('t')} AS t, {R('2 * least(up, 1 - up)')} AS p_two, {R('up')} AS p_greater, {R('1 - up')} AS p_less, ci_low_0, ci_high_0, ci_low_1, ci_high_1 FROM s".replace("sqrt(any_value(n)) / any_value(sd) AS t", "sqrt(any_value(m.n)) / any_value(sd) AS t")


@query("TST-3 TST-4 FUN-2", _ci_sql((0.95, 1 - 0.05 / 28)))
def paired_t_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 95 % intervals, and those corrected for 28 tests."""
    return rounded(stats.paired_t(triples(spark, sf_dir), CELLS, F.col("logit_swapped") - F.col("logit_baseline"), "half", (0.95, 1 - 0.05 / 28)))


@query("TST-7", f"WITH {E_SQL} SELECT perturbation, task, {R('CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) ELSE 0 END')} AS d FROM (SELECT perturbation, task, {jsd_sql('po', 'pp')} - {jsd_sql('po', 'pb')} AS d FROM v) GROUP BY 1, 2")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.cohens_d(chances(spark, sf_dir), CELLS, dv.jsd_bits(F.col("po"), F.col("pp")) - dv.jsd_bits(F.col("po"), F.col("pb"))))


@query(
    "TST-8 FUN-3",
    f"""WITH {E_SQL}, c AS (SELECT perturbation, task, CAST(count(*) FILTER (p = 1 AND b = 0) AS DOUBLE) AS x, CAST(count(*) FILTER (p = 0 AND b = 1) AS DOUBLE) AS y FROM v GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN x + y > 0 THEN pow(abs(x - y) - 1, 2) / (x + y) ELSE 0 END AS st FROM c)
SELECT perturbation, task, x AS only_first, y AS only_second, {R('st')} AS statistic, {R(f"CASE WHEN st > 0 THEN 2 * {nsf('sqrt(st)')} ELSE 1 END")} AS p FROM s""",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bt.answers(triples(spark, sf_dir)).groupBy(*CELLS).agg(F.count_if((F.col("p") == 1) & (F.col("b") == 0)).cast("double").alias("only_first"), F.count_if((F.col("p") == 0) & (F.col("b") == 1)).cast("double").alias("only_second"))
    stat, p = stats.mcnemar(F.col("only_first"), F.col("only_second"))
    return rounded(c.select("*", stat.alias("statistic"), p.alias("p")))


@query(
    "TST-6",
    f"""WITH {E_SQL}, d AS (SELECT perturbation, task, ROUND((l_sw) * 100) AS d FROM (SELECT *, logit_swapped - logit_baseline AS l_sw FROM v)),
r AS (SELECT *, rank() OVER (PARTITION BY perturbation, task ORDER BY abs(d)) + (count(*) OVER (PARTITION BY perturbation, task, abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY perturbation, task, abs(d)) AS t FROM d WHERE d <> 0),
s AS (SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1, 2)
SELECT perturbation, task, n, least(wp, wm) AS w, {R('(least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)')} AS z FROM s""",
)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round((F.col("logit_swapped") - F.col("logit_baseline")) * 100)
    return rounded(stats.wilcoxon(triples(spark, sf_dir), CELLS, d).select(*CELLS, "n", "w", "z"))


@query(
    "TST-6",
    f"""WITH {E_SQL}, d AS (SELECT perturbation, task, logit_swapped - logit_baseline AS d FROM v),
r AS (SELECT *, rank() OVER (PARTITION BY perturbation, task ORDER BY abs(d)) + (count(*) OVER (PARTITION BY perturbation, task, abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY perturbation, task, abs(d)) AS t FROM d WHERE d <> 0),
s AS (SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1, 2),
z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)
SELECT perturbation, task, n, least(wp, wm) AS w, {R('z')} AS z, {R('least(1, 2 * ' + nsf('abs(z)') + ')')} AS p_two, CAST(NULL AS DOUBLE) AS p_exact FROM z""",
)
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.wilcoxon(triples(spark, sf_dir), CELLS, F.col("logit_swapped") - F.col("logit_baseline")))


# Regression ------------------------------------------------------------------------------------------------------


@query(
    "TST-14 PRJ-6 RSH-1",
    f"""WITH {E_SQL}, x AS (SELECT perturbation, task, CASE WHEN cluster_id % 2 = 0 THEN 1 ELSE -1 END AS x, logit_swapped - logit_baseline AS y FROM v),
m AS (SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x * x) AS DOUBLE) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM x GROUP BY 1, 2),
f AS (SELECT *, sxy / sxx AS beta, syy - sxy * sxy / sxx AS rss FROM m), g AS (SELECT *, sqrt(rss / (n - 1) / sxx) AS se FROM f)
SELECT perturbation, task, n, {R('beta')} AS beta, {R('se')} AS se, {R('beta / se')} AS t, {R('1 - ' + tsf('beta / se', '(n - 1)'))} AS p_less, {R('1 - rss / syy')} AS r2 FROM g""",
)
def ols_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir)
    x = F.when(F.col("cluster_id") % 2 == 0, 1).otherwise(-1)
    return rounded(stats.ols_through_origin(rows, CELLS, x, F.col("logit_swapped") - F.col("logit_baseline")))


_LEVEL = """x AS (SELECT perturbation, task, cluster_id, logit_original AS z, CAST(cluster_id % 3 AS DOUBLE) AS s, logit_swapped AS y FROM v),
m AS (SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, avg(z) AS mz, avg(s) AS ms, avg(y) AS my, var_pop(z) AS vz, var_pop(s) AS vs, var_pop(y) AS vy, covar_pop(z, s) AS zs, covar_pop(z, y) AS zy, covar_pop(s, y) AS sy FROM x GROUP BY 1, 2),
f AS (SELECT *, vz * vs - zs * zs AS det, (vs * zy - zs * sy) / (vz * vs - zs * zs) AS b, (vz * sy - zs * zy) / (vz * vs - zs * zs) AS c FROM m)"""


@query(
    "TST-15",
    f"""WITH {E_SQL}, {_LEVEL},
u AS (SELECT perturbation, task, cluster_id, sum((z - mz) * e) AS u1, sum((s - ms) * e) AS u2, sum(e * e) AS rss FROM (SELECT x.*, f.* EXCLUDE (perturbation, task, n), y - my - b * (z - mz) - c * (s - ms) AS e FROM x JOIN f USING (perturbation, task)) GROUP BY 1, 2, 3),
q AS (SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS g, sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22, sum(rss) AS rss FROM u GROUP BY 1, 2),
h AS (SELECT f.*, q.* EXCLUDE (perturbation, task), vs / det AS i11, -zs / det AS i12, vz / det AS i22, g / (g - 1) * (n - 1) / (n - 3) / (n * n) AS k FROM f JOIN q USING (perturbation, task)),
w AS (SELECT *, sqrt(k * (i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22)) AS se_b, sqrt(k * (i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22)) AS se_c FROM h)
SELECT perturbation, task, n, g AS clusters, {R('my - b * mz - c * ms')} AS a, {R('b')} AS b, {R('c')} AS c, {R('se_b')} AS se_b, {R('se_c')} AS se_c, {R('c / se_c')} AS t_c, {R('2 * ' + nsf('abs(c / se_c)'))} AS p_two, {R('1 - ' + tsf('c / se_c', '(n - 3)'))} AS p_less, {R('1 - rss / (n * vy)')} AS r2 FROM w""",
)
def ols_level_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).select(*CELLS, "cluster_id", F.col("logit_original").alias("z"), (F.col("cluster_id") % 3).cast("double").alias("s"), F.col("logit_swapped").alias("y"))
    return rounded(stats.ols_clustered(rows, CELLS, "z", "s", "y", "cluster_id"))


@query(
    "TST-16",
    f"""WITH {E_SQL}, {_LEVEL.replace("FROM v)", "FROM v WHERE cluster_id % 2 = 0)", 1)},
test AS (SELECT perturbation, task, logit_original AS z, CAST(cluster_id % 3 AS DOUBLE) AS s, logit_swapped AS y FROM v WHERE cluster_id % 2 = 1)
SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, {R('sqrt(sum(pow(y - fit, 2)) / count(*))')} AS rmse, {R('1 - sum(pow(y - fit, 2)) / (var_pop(y) * count(*))')} AS r2
FROM (SELECT test.*, my + b * (test.z - mz) + c * (test.s - ms) AS fit FROM test JOIN f USING (perturbation, task)) GROUP BY 1, 2""",
)
def heldout_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).select(*CELLS, "cluster_id", F.col("logit_original").alias("z"), (F.col("cluster_id") % 3).cast("double").alias("s"), F.col("logit_swapped").alias("y"))
    fit = stats.ols_clustered(rows.where("cluster_id % 2 = 0"), CELLS, "z", "s", "y", "cluster_id").select(*CELLS, "a", "b", "c")
    test = rows.where("cluster_id % 2 = 1").join(windows.few(fit), CELLS)
    return rounded(stats.held_out(test, CELLS, F.col("y"), F.col("a") + F.col("b") * F.col("z") + F.col("c") * F.col("s")))


# Batteries -------------------------------------------------------------------------------------------------------

_BATTERY = f"""WITH {E_SQL}, a AS ({count4('p')}), b4 AS ({count4('b')}), c AS (SELECT * FROM a JOIN b4 USING (perturbation, task, n)),
l AS (SELECT perturbation, task, avg({jsd_sql('po', 'pp')}) AS jp, avg({jsd_sql('po', 'pb')}) AS jb, avg({kl_sql(clip_sql('po'), clip_sql('pp'))}) AS kp, avg({kl_sql(clip_sql('po'), clip_sql('pb'))}) AS kb FROM v GROUP BY 1, 2)
SELECT perturbation, task, metric, n, {R('x')} AS statistic_perturbation, {R('y')} AS statistic_baseline, {R('x - y')} AS difference FROM (
SELECT perturbation, task, n, unnest(['flip_rate', 'mutual_information', 'phi', 'jsd', 'kl']) AS metric, unnest([(p01 + p10) / n, {mi_sql('p')}, {phi_sql('p')}, jp, kp]) AS x, unnest([(b01 + b10) / n, {mi_sql('b')}, {phi_sql('b')}, jb, kb]) AS y FROM c JOIN l USING (perturbation, task))"""


@query("TST-19 RSH-4 UDF-1", _BATTERY)
def battery_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bt.battery(triples(spark, sf_dir), CELLS, 12, replicates=50)
    return rounded(got.select(*CELLS, "metric", "n", "statistic_perturbation", "statistic_baseline", "difference"))


@query(
    "TST-24 JOIN-6",
    f"""WITH v AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, o_orderstatus AS task, CAST(o_totalprice > 200000 AS INT) AS o, CAST(o_totalprice * (1 + 0.02::DOUBLE * CAST(substr(o_orderpriority, 1, 1) AS INT) * (o_orderkey % 7 - 3)) > 200000 AS INT) AS p FROM orders), c AS ({count4('p', 'level, task')})
SELECT level, task, n, {R('(p01 + p10) / n')} AS flip_rate, {R(mi_sql('p'))} AS mi FROM c""",
)
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(level.alias("level"), F.col("o_orderstatus").alias("task"), (price > 200000).cast("int").alias("o"), (price * (1 + 0.02 * level * (F.col("o_orderkey") % 7 - 3)) > 200000).cast("int").alias("p"))
    return rounded(bt.dose_response(rows, "level", "task", "o", "p"))


# Resampling ------------------------------------------------------------------------------------------------------

_HASH = """WITH t AS (SELECT row_number() OVER (ORDER BY quality, toxic, doc_id) - 1 AS i, quality AS x, toxic AS y, count(*) OVER () AS n FROM labels),
d AS (SELECT b, CAST(('0x' || substr(md5(concat_ws(':', b, k, 42)), 1, 8)) AS BIGINT) % (SELECT max(n) FROM t) AS i FROM range(200) r(b), range((SELECT max(n) FROM t)) s(k)),
v AS (SELECT b AS rep, x AS o, y AS p FROM d JOIN t USING (i)), c AS (""" + count4("p", "rep") + ")"


@query("TST-9 TST-11 UDF-2", f"{_HASH} SELECT rep AS b, {R('(p01 + p10) / n')} AS flip FROM c")
def bootstrap_flip_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.bootstrap_hash(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(c.select("b", stats.flip_rate({k: F.col(k) for k in ("n00", "n01", "n10", "n11")}).alias("flip")))


@query("TST-9 MET-10", f"{_HASH} SELECT rep AS b, {R(phi_sql('p'))} AS phi FROM c")
def bootstrap_phi_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.bootstrap_hash(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(c.select("b", stats.phi({k: F.col(k) for k in ("n00", "n01", "n10", "n11")}).alias("phi")))


def _drawn_sql(n: str, q: str, u: str) -> str:
    """A binomial draw by inversion: the least k whose cumulative probability is u or more."""
    spread = f"(9 * sqrt({n} * {q} * (1 - {q})) + 9)"
    low, high = f"CAST(greatest(0, floor({n} * {q} - {spread})) AS BIGINT)", f"CAST(least({n}, ceil({n} * {q} + {spread})) AS BIGINT)"
    chance = f"exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({q}) + ({n} - k) * ln(1 - {q}))"
    steps = f"list_reduce(list_transform(range({low}, {high} + 1), lambda k: {{'c': {chance}, 'n': 0}}), lambda s, x: {{'c': s.c + x.c, 'n': s.n + CAST(s.c + x.c < {u} AS INT)}}, {{'c': 0.0::DOUBLE, 'n': 0}}).n"
    return f"CAST(CASE WHEN {n} = 0 OR {q} <= 0 THEN 0 WHEN {q} >= 1 THEN {n} ELSE least({high}, {low} + {steps}) END AS BIGINT)"


_KINDS = [f"{i}{j}{k}" for i in (0, 1) for j in (0, 1) for k in (0, 1)]


def boot_sql(replicates: int, cells: str = "perturbation, task", seed: int = 42) -> str:
    """CTEs up to `boot`: the bootstrap of the three count metrics, over `v` with answers o, p and b."""
    key = f"concat_ws(':', '{seed}', {cells})"
    steps = [f"c8 AS (SELECT {cells}, {', '.join(f'count(*) FILTER (o = {x[0]} AND p = {x[1]} AND b = {x[2]}) AS n{x}' for x in _KINDS)}, count(*) AS n FROM v GROUP BY {cells})"]
    steps.append(f"d0 AS (SELECT *, n AS left0, n AS rest0 FROM c8, range({replicates}) r(rep))")
    for j, x in enumerate(_KINDS[:-1]):
        u = f"((CAST('0x' || substr(md5({key} || ':' || rep || ':{j}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
        prepared = f"(SELECT *, {u} AS u, CASE WHEN rest{j} > 0 THEN CAST(n{x} AS DOUBLE) / rest{j} ELSE 0 END AS q FROM d{j})"
        steps.append(f"d{j + 1} AS (SELECT * EXCLUDE (u, q, k), k AS m{x}, left{j} - k AS left{j + 1}, rest{j} - n{x} AS rest{j + 1} FROM (SELECT *, {_drawn_sql(f'left{j}', 'q', 'u')} AS k FROM {prepared}))")
    four = lambda arm, name: ", ".join(f"CAST({' + '.join(f'{name}{x}' for x in _KINDS if x[0] == i and x['pb'.index(arm) + 1] == j)} AS DOUBLE) AS {arm}{i}{j}" for i in "01" for j in "01")
    flip = lambda a: f"(({a}01 + {a}10) / n)"
    metrics = {"flip_rate": (flip, "greater"), "mutual_information": (mi_sql, "less"), "phi": (phi_sql, "less")}
    values = "UNION ALL ".join(f"SELECT {cells}, rep, '{m}' AS metric, '{side}' AS alternative, n, {f('p')} AS x, {f('b')} AS y FROM {{t}} " for m, (f, side) in metrics.items())
    steps.append(f"f AS (SELECT {cells}, rep, CAST(n AS DOUBLE) AS n, {four('p', 'm')}, {four('b', 'm')} FROM (SELECT *, left7 AS m111 FROM d7)), o AS (SELECT {cells}, -1 AS rep, CAST(n AS DOUBLE) AS n, {four('p', 'n')}, {four('b', 'n')} FROM c8)")
    steps.append(f"drawn AS ({values.format(t='f')}), seen AS ({values.format(t='o')})")
    steps.append(f"""boot AS (SELECT {', '.join('s.' + c for c in cells.split(', '))}, s.metric, s.alternative, s.n, s.x, s.y, s.x - s.y AS observed, avg(CAST(d.x - d.y <= 0 AS DOUBLE)) AS le, avg(CAST(d.x - d.y >= 0 AS DOUBLE)) AS ge,
  quantile_cont(d.x - d.y, 0.025) AS ci_low, quantile_cont(d.x - d.y, 0.975) AS ci_high, stddev_pop(d.x - d.y) AS se FROM seen s JOIN drawn d ON {' AND '.join(f's.{c} = d.{c}' for c in cells.split(', '))} AND s.metric = d.metric GROUP BY ALL)""")
    return ",\n".join(steps)


_TWO = "least(1.0::DOUBLE, 2 * CASE WHEN observed >= 0 THEN le ELSE ge END)"
REPLICATES = 300


@query("TST-9 TST-10 TST-12", f"WITH {E_SQL}, {boot_sql(REPLICATES)} SELECT perturbation, task, metric, n, {', '.join(f'{R(x)} AS {y}' for x, y in (('observed', 'observed'), (_TWO, 'p_two'), ('le', 'p_greater'), ('ge', 'p_less'), ('ci_low', 'ci_low'), ('ci_high', 'ci_high'), ('se', 'se')))} FROM boot")
def bootstrap_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.triple_counts(bt.answers(triples(spark, sf_dir)), CELLS, "o", "p", "b")
    return rounded(stats.bootstrap(c, CELLS, REPLICATES, draws="inverted"))


@query("TST-11 TST-9", f"WITH {E_SQL}, {boot_sql(REPLICATES, 'task', 7)} SELECT task, metric, n, {R('observed')} AS observed, {R('least(1.0::DOUBLE, 2 * least(le, ge))')} AS p_two FROM boot")
def bootstrap_both_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sided p that doubles the smaller tail."""
    c = stats.triple_counts(bt.answers(triples(spark, sf_dir)), ["task"], "o", "p", "b")
    return rounded(stats.bootstrap(c, ["task"], REPLICATES, seed=7, rule="both", draws="inverted").select("task", "metric", "n", "observed", "p_two"))


def battery_sql(tests: int) -> str:
    """CTEs up to `bat`, the five metrics' tests of every cell."""
    rows = []
    for m, f in (("jsd", jsd_sql), ("kl", lambda a, b: kl_sql(clip_sql(a), clip_sql(b)))):
        x, y = f("po", "pp"), f("po", "pb")
        moments = f"SELECT perturbation, task, CAST(count(*) AS DOUBLE) AS n, avg(x) AS x, avg(y) AS y, avg(x - y) AS mean, stddev_samp(x - y) AS sd FROM (SELECT perturbation, task, {x} AS x, {y} AS y FROM v) GROUP BY 1, 2"
        up = tsf("t", "(n - 1)")
        rows.append(f"SELECT perturbation, task, '{m}' AS metric, n, x AS statistic_perturbation, y AS statistic_baseline, mean AS difference, 2 * least(up, 1 - up) AS p_two, up AS p_one, 'greater' AS alternative FROM (SELECT *, {up} AS up FROM (SELECT *, mean * sqrt(n) / sd AS t FROM ({moments})))")
    counted = f"SELECT perturbation, task, metric, n, x AS statistic_perturbation, y AS statistic_baseline, observed AS difference, {_TWO} AS p_two, CASE WHEN alternative = 'less' THEN ge ELSE le END AS p_one, alternative FROM boot"
    return f"{boot_sql(REPLICATES)}, bat AS (SELECT *, p_two < 0.05::DOUBLE / {tests} AS significant FROM ({counted} UNION ALL {' UNION ALL '.join(rows)}))"


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.battery(triples(spark, sf_dir), CELLS, 12, REPLICATES, draws="inverted")


@query("TST-9 TST-10 TST-19 TST-21 MUL-1", f"WITH {E_SQL}, {battery_sql(12)} SELECT perturbation, task, metric, n, {', '.join(f'{R(c)} AS {c}' for c in ('statistic_perturbation', 'statistic_baseline', 'difference', 'p_two', 'p_one'))}, alternative, significant FROM bat")
def battery_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tested(spark, sf_dir))


@query("MUL-1 AGG-3 AGG-7 TST-21", f"WITH {E_SQL}, {battery_sql(12)} SELECT metric, count(*) FILTER (significant) AS survived, count(*) AS units FROM bat GROUP BY 1")
def bonferroni_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.survival(tested(spark, sf_dir), ["metric"], CELLS)


@query("TST-13")
def permutation_hypergeom(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("task")).agg(*[a for h in (0, 1) for a in (F.count_if((F.col("event_id") % 2 == h) & (F.col("value") > 20)).alias(f"k{h}"), F.count_if(F.col("event_id") % 2 == h).alias(f"n{h}"))])
    return rounded(stats.permutation(votes.where("n0 > 0 AND n1 > 0"), ["task"], "k0", "n0", "k1", "n1", replicates=2000))


@query("SIM-1 SIM-2 SIM-3 AGG-13 JOIN-10")
def power_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.power(alignment.grid(spark, sigma_pert=[0.0, 0.5, 1.0], sigma=[0.0, 0.3]), n=120, sims=40, replicates=100))


@query(
    "SIM-4 AGG-4",
    f"""WITH p AS (SELECT l_returnflag AS metric, l_linestatus AS condition, l_discount AS rate FROM lineitem WHERE l_tax > 0)
SELECT metric, condition, {R('avg(rate)')} AS mean_rate, {R('max(rate)')} AS max_rate, count(*) AS n FROM p GROUP BY GROUPING SETS ((), (metric), (condition))""",
)
def fp_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("condition"), F.col("l_discount").alias("detection_rate"), F.lit(0.0).alias("sigma_pert"), F.col("l_tax").alias("sigma"))
    return rounded(bt.calibration_summary(p))


# Votes, picks, shards ----------------------------------------------------------------------------------------------


@query(
    "AGG-1 AGG-2 TWN-1",
    "SELECT user_id, event_type AS task, count(*) AS n, CAST(sum(CAST(value > 20 AS INT)) > count(*) / 2.0::DOUBLE AS INT) AS majority, CAST(sum(CAST(value > 20 AS INT)) >= 2 AS INT) AS two_or_more FROM events GROUP BY 1, 2",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes counted per case; ties are 0."""
    n, ones = F.col("n"), F.col("ones")
    c = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("ones"))
    return c.select("user_id", "task", "n", (ones > n / 2).cast("int").alias("majority"), (ones >= 2).cast("int").alias("two_or_more"))


@query(
    "FLT-12 FLT-13 FLT-14",
    "SELECT user_id, count(*) AS votes, count(*) FILTER (value < 50) AS clean, CASE WHEN count(*) FILTER (value < 50) = 0 THEN 'no answers' WHEN count(*) FILTER (value < 50) < 5 THEN 'too few' END AS reason FROM events GROUP BY 1",
)
def vote_filter_min5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("votes"), F.count_if(F.col("value") < 50).alias("clean"))
    return c.withColumn("reason", F.when(F.col("clean") == 0, "no answers").when(F.col("clean") < 5, "too few"))


@query(
    "WIN-1 ORC-6 SRT-1 INC-1",
    "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1",
)
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return windows.first_wins(rows, ["l_orderkey", "l_linenumber"], order)


@query(
    "WIN-2 AGG-17 SRT-2",
    "WITH g AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(concat_ws(':', 42, doc_id)), doc_id) AS rn, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels) SELECT doc_id, quality, toxic, md5(concat_ws(':', 43, doc_id)) AS shuffled FROM g WHERE rn <= (SELECT min(n) FROM g)",
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.balanced_sample(table(spark, sf_dir, "labels"), ["quality", "toxic"], ["doc_id"])


@query("WIN-4 TWN-3 PRJ-3", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1")
def stride_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stride_shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 4, 1)


@query("WIN-5", "SELECT doc_id, CAST(least(floor(i / greatest(1, n // 7)), 6) AS BIGINT) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def contiguous_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.contiguous_shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7)


@query("WIN-3 JOIN-13", "SELECT doc_id, source, idx, CASE WHEN idx < 4 THEN ['Ada', 'Ben', 'Cy', 'Di'][idx + 1] END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)")
def context_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = windows.index_within_large(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return docs.select("doc_id", "source", "idx", alignment.named(F.col("idx"), ["Ada", "Ben", "Cy", "Di"]).alias("name"))


_FEW = """WITH d AS (SELECT doc_id, source, len(string_split(text, ' ')) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
t AS (SELECT doc_id, source, i, n, a, {h1} % (n - 1) AS x, {h2} % (n - 2) AS y FROM d, range(10) r(a) WHERE n > 2),
u AS (SELECT *, x + CAST(x >= i AS BIGINT) AS x1 FROM t), v AS (SELECT *, y + CAST(y >= least(x1, i) AS BIGINT) AS y1 FROM u), w AS (SELECT *, y1 + CAST(y1 >= greatest(x1, i) AS BIGINT) AS y2 FROM v),
f AS (SELECT w.doc_id, w.a, one.doc_id AS first, two.doc_id AS second FROM w JOIN d one ON one.source = w.source AND one.i = w.x1 JOIN d two ON two.source = w.source AND two.i = w.y2 WHERE one.cost + two.cost <= 400),
b AS (SELECT doc_id, arg_min(first, a) AS first, arg_min(second, a) AS second, min(a) AS attempt FROM f GROUP BY 1)
SELECT d.source, d.doc_id, d.cost, first, second, attempt FROM d LEFT JOIN b USING (doc_id)"""
_FEW = _FEW.format(**{f"h{k}": f"CAST(('0x' || substr(md5(concat_ws(':', 42, doc_id, a, {k})), 1, 8)) AS BIGINT)" for k in (1, 2)})


@query("TXT-21", _FEW)
def few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(F.split("text", " ")).alias("cost"))
    return windows.few_shot(docs, "source", "doc_id", "cost", 400, draws=10)


@query("WIN-6 FLT-1", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0' ORDER BY doc_id LIMIT 25")
def head_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").where(alignment.dataset_not("source", "src0"))
    return windows.head(docs, ["doc_id"], 25)


@query("WIN-8", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, arg_min(l_partkey, ROW(abs(l_quantity - 25), k)) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_tax, l_discount) AS k FROM lineitem)")
def closest_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.index_within(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_tax", "l_discount"], "k")
    rows = rows.withColumn("off", F.abs(F.col("l_quantity") - 25))
    return windows.best_so_far(rows, ["l_orderkey"], "k", "l_partkey", "off").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "best")


# Joins -----------------------------------------------------------------------------------------------------------


@query("JOIN-11 SET-4", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def pair_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.unordered_pairs(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query(
    "JOIN-5 RSH-2 SET-3",
    "SELECT conv_id, max(text) FILTER (turn = 0) AS t0, max(text) FILTER (turn = 1) AS t1, max(text) FILTER (turn = 2) AS t2 FROM conversations GROUP BY conv_id HAVING t0 IS NOT NULL AND t1 IS NOT NULL AND t2 IS NOT NULL",
)
def variant_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("variant"), "text")
    return alignment.align(long, ["conv_id"], "variant", "text", ["t0", "t1", "t2"])


@query("FLT-10 JOIN-14 INC-6", "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) = 4)")
def complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return alignment.complete_only(rows, ["conv_id"], "turn", 4)


@query("JOIN-9 INC-1 FLT-2", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("JOIN-1 FLT-11", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("doc_id", F.col("doc_id").cast("string"))
    return alignment.attach(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, ["doc_id"])


@query("JOIN-3 JOIN-4", "SELECT o.o_orderkey, o.o_orderstatus, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def checked_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    return alignment.checked_lookup(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], at_once=False).drop("c_custkey")


@query("JOIN-10 JOIN-12", "SELECT CAST(a AS DOUBLE) AS sigma_pert, CAST(b AS DOUBLE) AS sigma, c AS condition FROM (SELECT unnest([0, 0.5, 1]) AS a), (SELECT unnest([0.1, 0.2]) AS b), (SELECT unnest(['x', 'y']) AS c)")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.grid(spark, sigma_pert=[0.0, 0.5, 1.0], sigma=[0.1, 0.2], condition=["x", "y"])


@query(
    "JOIN-8 RSH-3",
    f"""WITH c AS (SELECT c_nationkey AS unit, c_mktsegment AS seg, c_acctbal > 0 AS pos, avg(c_acctbal) AS bal FROM customer GROUP BY 1, 2, 3),
r AS (SELECT unit, bal AS ref_bal FROM c WHERE seg = 'BUILDING' AND pos)
SELECT c.unit, CASE WHEN seg <> 'BUILDING' THEN 'seg' ELSE 'pos' END AS axis, CASE WHEN seg <> 'BUILDING' THEN seg ELSE CAST(pos AS VARCHAR) END AS level, {R('bal')} AS bal, {R('ref_bal')} AS ref_bal FROM c JOIN r USING (unit) WHERE (CAST(seg <> 'BUILDING' AS INT) + CAST(NOT pos AS INT)) = 1""",
)
def contrast_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("seg"), (F.col("c_acctbal") > 0).alias("pos")).agg(F.avg("c_acctbal").alias("bal"))
    return rounded(alignment.contrasts(source, "unit", ["seg", "pos"], {"seg": "BUILDING", "pos": True}))


@query("JOIN-6", "SELECT conv_id, count(*) AS turns, max(text) FILTER (turn = 1) AS second FROM conversations GROUP BY 1")
def variants_as_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = alignment.grouped_map(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return m.select("conv_id", F.size("variants").cast("long").alias("turns"), F.try_element_at("variants", F.lit(1).cast("long")).alias("second"))


@query(
    "JOIN-7 TST-5 PRJ-1 FLT-11",
    f"""WITH s AS (SELECT l_orderkey AS unit, l_linenumber AS g, avg(l_quantity) AS v, avg(l_tax) AS f FROM lineitem GROUP BY 1, 2),
t AS (SELECT a.g AS ga, b.g AS gb, b.v - a.v AS d, a.f AS f FROM s a JOIN s b ON a.unit = b.unit AND a.g < b.g)
SELECT ga || '_vs_' || gb AS comparison, count(*) AS n, {R('avg(d)')} AS mean, {R('avg(f)')} AS fixed, count(*) FILTER (f IS NULL) AS no_paraphrase FROM t GROUP BY 1""",
)
def subgroup_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("string").alias("subgroup")).agg(F.avg("l_quantity").alias("v"), F.avg("l_tax").alias("f"))
    kinds = F.explode(F.array(F.struct(F.lit("demographic").alias("variant_type"), F.col("v").alias("value")), F.struct(F.lit("fixed_sentence").alias("variant_type"), F.col("f").alias("value"))))
    scores = s.select("unit", "subgroup", F.lit(None).cast("string").alias("comparison"), kinds.alias("k")).select("unit", "subgroup", "comparison", "k.*")
    groups = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_linenumber").cast("string").alias("name")).distinct()
    pairs = alignment.unordered_pairs(groups, "l_linenumber", "name").select(F.concat_ws("_vs_", "a", "b").alias("comparison"), "a", "b")
    t = alignment.triple(scores, pairs, "value")
    return rounded(t.groupBy("comparison").agg(F.count("*").alias("n"), F.avg(F.col("swapped") - F.col("original")).alias("mean"), F.avg("fixed").alias("fixed"), F.count_if(F.col("fixed").isNull()).alias("no_paraphrase")))


# Shapes ----------------------------------------------------------------------------------------------------------


@query(
    "RSH-1 PRJ-2 SET-2",
    f"WITH {E_SQL} SELECT cluster_id, perturbation, 0 AS swap_direction, count(*) AS n, {R('avg(logit_baseline)')} AS logit FROM v GROUP BY 1, 2 UNION ALL SELECT cluster_id, perturbation, CASE WHEN perturbation = 'A' THEN 1 ELSE -1 END, count(*), {R('avg(logit_swapped)')} FROM v GROUP BY 1, 2",
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.when(F.col("perturbation") == "A", 1).otherwise(-1)
    pair = F.array(F.struct(F.lit(0).alias("swap_direction"), F.col("logit_baseline").alias("logit")), F.struct(direction.alias("swap_direction"), F.col("logit_swapped").alias("logit")))
    long = triples(spark, sf_dir).select("cluster_id", "perturbation", F.explode(pair).alias("r")).select("cluster_id", "perturbation", "r.*")
    return rounded(long.groupBy("cluster_id", "perturbation", "swap_direction").agg(F.count("*").alias("n"), F.avg("logit").alias("logit")))


@query("SRC-5 RSH-4", "SELECT event_id, k, CAST(json_extract(props, '$.' || k) AS BIGINT) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))


@query("MET-15 MET-13", f"WITH {E_SQL} SELECT cluster_id, {R('avg(j) FILTER (perturbation = $$A$$)')} AS a, {R('avg(j) FILTER (perturbation = $$N$$)')} AS n, {R('avg(j) FILTER (perturbation = $$R$$)')} AS r, coalesce(max(j) > quantile_cont(k, 0.95) + 1e-9::DOUBLE, false) AS outlier FROM (SELECT cluster_id, perturbation, {jsd_sql('po', 'pp')} AS j, {jsd_sql('po', 'pb')} AS k FROM v) GROUP BY 1")
def case_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence by case and cell, and whether a case's largest exceeds the 95th percentile of its benign ones."""
    rows = chances(spark, sf_dir).select("cluster_id", "perturbation", dv.jsd_bits(F.col("po"), F.col("pp")).alias("j"), dv.jsd_bits(F.col("po"), F.col("pb")).alias("k"))
    return rounded(rows.groupBy("cluster_id").agg(*[F.avg(F.when(F.col("perturbation") == c, F.col("j"))).alias(c.lower()) for c in "ANR"], F.coalesce(F.max("j") > F.percentile("k", F.lit(0.95)) + 1e-9, F.lit(False)).alias("outlier")))


@query("AGG-8 AGG-10 AGG-11", "SELECT lang, count(*) AS n, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS share, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("lang", "n", F.format_string("%.1f%%", 100.0 * F.col("n") / F.col("total")).alias("share"), "least", "most")


# Text ------------------------------------------------------------------------------------------------------------

WORDS = ("the", "and", "of", "that", "an", "or")
_LETTER = r"\pL\pM\pN\p{Pc}"
#: All words of a text in lower case.
_TOKENS = f"regexp_extract_all(lower(text), '[{_LETTER}]+')"


def word_sql(text: str, word: str, other: str) -> str:
    """Whole words replaced; twice, as neighbours share a border."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^{_LETTER}]){word}($|[^{_LETTER}])', '\\1{other}\\2', 'g')"
    return text


@query("FLT-5 FLT-3 FLT-4", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{'|'.join(k for k in ('license', 'token =', 'ation', 'pregnan'))}')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.mentions(F.col("text"), ("license", "token =", "ation", "pregnan"))).select("doc_id")


@query("FLT-6", "SELECT doc_id, array_to_string(list_concat(list_transform(list_filter(['license', 'rights'], lambda k: contains(lower(text), k)), lambda k: 'LEGAL: ' || k), list_transform(list_filter(['token', 'password'], lambda k: contains(lower(text), k)), lambda k: 'SECRET: ' || k)), '; ') AS matched FROM documents")
def matched_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.matched_keywords(F.col("text"), {"LEGAL": ["license", "rights"], "SECRET": ["token", "password"]})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "; ").alias("matched"))


_SWAP = "text"
for _i, _w in enumerate(WORDS):
    _SWAP = word_sql(_SWAP, _w, f"\x01{_i}\x01")
for _i, _w in enumerate(WORDS):
    _SWAP = f"replace({_SWAP}, '\x01{_i}\x01', '<{_w}>')"


@query("TXT-1 SRT-3", f"SELECT doc_id, md5({_SWAP}) AS swapped FROM documents")
def lexicon_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of frequent words, each put into brackets, in one pass."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.swap(F.col("text"), {w: f"<{w}>" for w in WORDS})).alias("swapped"))


def _terms_sql(lexicon: dict[str, str], tokens: str) -> str:
    """A text's tokens with the lexicon's counterparts, put together: a token as it is, without its last period, or the
    words around its apostrophe."""
    pairs = "MAP {" + ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in lexicon.items()) + "}"
    bare = f"coalesce({pairs}[rtrim(x, '.')], rtrim(x, '.')) || CASE WHEN ends_with(x, '.') THEN '.' ELSE '' END"
    parts = f"array_to_string(list_transform(string_split(x, chr(39)), lambda y: coalesce({pairs}[y], y)), chr(39))"
    return f"array_to_string(list_transform({tokens}, lambda x: coalesce({pairs}[x], CASE WHEN x IN ('.', chr(39)) THEN x WHEN contains(x, chr(39)) THEN {parts} ELSE {bare} END)), '')"


#: A sentence of terms (numbers pick them) that is put after a text.
_SENTENCE = (" ", 1, " said ", 3, ", ", 7, "'s. (", 11, ") ", 5, "x ", 13)
_LEXICONS = (lexicons.FEMALE_TO_MALE, lexicons.MALE_TO_FEMALE)


def _sentence_sql() -> str:
    keys = ["[" + ", ".join("'" + k.replace("'", "''") + "'" for k in lexicon) + "]" for lexicon in _LEXICONS]
    term = lambda k, a: f"{k}[1 + (doc_id * {a} + {a}) % len({k})]"
    return " || ".join("'" + p.replace("'", "''") + "'" if isinstance(p, str) else f"CASE WHEN doc_id % 2 = 0 THEN {term(keys[0], p)} ELSE {term(keys[1], p)} END" for p in _SENTENCE)


_SPLIT = f"regexp_extract_all(text || {_sentence_sql()}, '[{_LETTER}]+''[{_LETTER}]+|[{_LETTER}]+\\.?|(?s:[^{_LETTER}])')"


@query(
    "TXT-1 SRT-3 FLT-4",
    f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN {_terms_sql(_LEXICONS[0], 's')} ELSE {_terms_sql(_LEXICONS[1], 's')} END) AS swapped FROM (SELECT doc_id, {_SPLIT} AS s FROM documents)",
)
def gender_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both whole lexicons over all documents, each of which has a sentence of terms at its end, in one pass."""
    even = F.col("doc_id") % 2 == 0
    pick = lambda lexicon, a: F.element_at(F.array(*map(F.lit, lexicon)), (1 + (F.col("doc_id") * a + a) % len(lexicon)).cast("int"))
    said = [F.lit(p) if isinstance(p, str) else F.when(even, pick(_LEXICONS[0], p)).otherwise(pick(_LEXICONS[1], p)) for p in _SENTENCE]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", *said).alias("t"))
    return docs.select("doc_id", F.md5(text.swap_gender(F.col("t"), even)).alias("swapped"))


_CHAIN = (("the", "and"), ("and", "or"), ("of", "the"), ("or", "an"))
_CHAIN_SQL = "text"
for _w, _o in _CHAIN:
    _CHAIN_SQL = word_sql(_CHAIN_SQL, _w, _o)


@query("TXT-2", f"SELECT doc_id, md5({_CHAIN_SQL}) AS swapped FROM documents")
def ordered_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs one after the other, so that later ones meet what earlier ones have put in."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.swap_in_order(F.col("text"), _CHAIN)).alias("swapped"))


@query("TXT-4 FLT-7 FLT-8", f"SELECT doc_id, array_to_string(list_filter(['\\bhe\\b', '\\bhis\\b', '\\bhim\\b'], lambda p: list_contains(w, replace(p, '\\b', ''))), ' ') AS residue FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def residual_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.residue(F.col("text"), lexicons.MALE_RESIDUE[:3]), " ").alias("residue"))


@query(
    "TXT-10",
    f"""SELECT doc_id, CASE WHEN f AND NOT m THEN 'female' WHEN m AND NOT f THEN 'male' WHEN she > he AND she >= 2 THEN 'female' WHEN he > she AND he >= 2 THEN 'male' ELSE 'unclear' END AS gender FROM (
SELECT doc_id, list_has_any(w, ['woman', 'girl', 'female']) AS f, list_has_any(w, ['man', 'boy', 'male']) AS m, len(list_filter(w, lambda x: x IN ('she', 'her'))) AS she, len(list_filter(w, lambda x: x IN ('he', 'his', 'him'))) AS he FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))""",
)
def gender_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.patient_gender(F.col("text")).alias("gender"))


_SENTENCES = r"""list_filter(list_transform(regexp_split_to_array(text, '\.(?:\s+|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND len(regexp_split_to_array(x, '\s+')) >= 5 AND NOT regexp_matches(x, '^\s*[-•0-9]+[.)]\s*') AND NOT regexp_matches(x, '[,;]$'))"""


@query("TXT-15 TXT-22", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


_HASHED = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"
_PUT = " ".join(f"WHEN strpos(text, {a}) > 0 THEN substr(text, 1, strpos(text, {a}) - 1) || 'A new sentence stands here{m}' || substr(text, strpos(text, {a}) + len({a}))" for m, a in [(m, f"(CASE WHEN ends_with(old, '{k}') THEN old ELSE old || '{k}' END)") for k, m in ((".", "."), ("?", "."), ("!", "."))] + [("", "old")])


@query(
    "TXT-16 TXT-17",
    f"""WITH s AS (SELECT doc_id, text, {_SENTENCES} AS s FROM documents), o AS (SELECT doc_id, text, CASE WHEN len(s) > 0 THEN s[1 + {_HASHED.format(x="'42:' || doc_id")} % len(s)] END AS old FROM s)
SELECT doc_id, md5(CASE {_PUT} END) AS edited, CAST(len(old) AS INT) AS old_n FROM o""",
)
def sentence_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", "text", text.pick(text.sentences(F.col("text")), F.lit(42), F.col("doc_id")).alias("old"))
    return s.select("doc_id", F.md5(text.replace_sentence(F.col("text"), F.col("old"), F.lit("A new sentence stands here"))).alias("edited"), F.length("old").alias("old_n"))


@query("TOK-1 TOK-2 TOK-3 PRJ-8 UDF-5")  # DuckDB's levenshtein counts bytes, of which whole texts need more than one a token
def token_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.tokenized(F.col("text"), "words").alias("a"))
    edited = docs.withColumn("b", F.transform(F.filter("a", lambda x, i: (i + 1) % 7 != 0), lambda x: F.replace(x, F.lit("the"), F.lit("a"))))
    found = edited.select("doc_id", F.size("a").alias("n"), tokens.distance(F.col("a"), F.col("b")).alias("distance"))
    return rounded(found.select("doc_id", "distance", F.when(F.col("n") > 0, F.col("distance") * 100.0 / F.col("n")).otherwise(0.0).alias("pct")))


_WORD_LIST = "CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') END"


@query(
    "TOK-1 TOK-2 TOK-3 TOK-4 PRJ-8",
    f"""SELECT doc_id, n, CAST(n // 11 + (n - n // 11 + 8) // 9 AS INT) AS distance, {R('CASE WHEN n > 0 THEN (n // 11 + (n - n // 11 + 8) // 9) * 100.0::DOUBLE / n ELSE 0 END')} AS pct, CAST(greatest(1, round_even(7.5::DOUBLE * n / 100, 0)) AS INT) AS edits
FROM (SELECT doc_id, CAST(len({_WORD_LIST}) AS INT) AS n FROM documents)""",
)
def token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances that are known beforehand, over whole texts: every 11th word goes, and every 9th of the others becomes a
    mark that is no word of the text.

    A mark costs an edit, and so does each word that the text is shorter by, so that no fewer edits will do.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.tokenized(F.col("text")).alias("a"))
    kept = F.filter("a", lambda x, i: (i + 1) % 11 != 0)
    marks = docs.withColumn("b", F.transform(kept, lambda x, i: F.when(i % 9 == 0, F.concat(F.lit("\x02"), i.cast("string"))).otherwise(x)))
    n = F.size("a")
    made = marks.select("doc_id", n.alias("n"), tokens.distance(F.col("a"), F.col("b")).alias("distance"), tokens.change_pct(F.col("a"), F.col("b")).alias("pct"), tokens.target_edits(F.lit(7.5), n).alias("edits"))
    return rounded(made)


@query(
    "CAL-1 CAL-2 AGG-16 FLT-9",
    """WITH a AS (SELECT l_orderkey AS k, l_quantity AS actual, 25.0::DOUBLE AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem),
r AS (SELECT *, abs(actual - target) AS off, CASE WHEN abs(actual - target) <= 0.5 THEN 0 WHEN actual <= target THEN 1 ELSE 2 END AS kind FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY kind, CASE WHEN kind = 0 THEN 0 ELSE off END, ord) AS rn, bool_and(actual > target + 0.5) OVER (PARTITION BY k) AS overshoot_only FROM r)
SELECT k, actual, ord, kind = 0 AS accepted, overshoot_only FROM s WHERE rn = 1""",
)
def calibration_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    attempts = rows.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("actual"), F.lit(25.0).alias("target"), F.col("ord").cast("long").alias("ord"))
    return tokens.select_candidate(attempts, ["k"], "target", "actual", "ord").select("k", "actual", "ord", "accepted", "overshoot_only")


# Ages that are written into the documents, in ten ways: {n} an age, {d} the first digit of a decade.
AGES = ("I am {n} and well. ", "A {n}-year-old man. ", "early {d}0s patient, {n}M. ", "F{n} with pain. ", "{n}(M) here. ", "Age = {n}, smoker. ", "Female, {n}, tired. ", "in my late {d}0s. ", "No age at all. ", "999 years old, but {n} male. ")


def _aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, d = (18 + F.col("doc_id") % 60).cast("string"), (2 + F.col("doc_id") % 7).cast("string")
    phrase = F.element_at(F.array(*[F.lit(a) for a in AGES]), (F.col("doc_id") % 10 + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.replace(F.replace(phrase, F.lit("{n}"), n), F.lit("{d}"), d), "text").alias("t"))


def _age_sql() -> str:
    """The first pattern whose first match is a plausible age: a struct of age, matched, start."""
    found = []
    for kind, pattern, number, taken in text.AGES:
        whole, part = f"regexp_extract(t, '{pattern.replace(chr(39), chr(39) * 2)}', 0)", f"regexp_extract(t, '{pattern.replace(chr(39), chr(39) * 2)}', {taken})"
        age = f"TRY_CAST(regexp_extract(t, '{pattern.replace(chr(39), chr(39) * 2)}', {number}) AS INT)"
        start = f"len(regexp_split_to_array(t, '{pattern.replace(chr(39), chr(39) * 2)}')[1])"
        if kind == "decade":
            age = f"TRY_CAST(regexp_extract({part}, '([0-9])0s', 1) AS INT) * 10 + CASE WHEN contains({part}, 'early') THEN 2 WHEN contains({part}, 'late') THEN 7 ELSE 5 END"
        elif taken:
            start += f" + strpos({whole}, {part}) - 1"
        found.append(f"CASE WHEN {whole} <> '' AND {age} BETWEEN {text.MIN_AGE} AND {text.MAX_AGE} THEN {{'age': CAST({age} AS INT), 'matched': {part}, 'start': CAST({start} AS INT), 'decade': {kind == 'decade'}}} END")
    return f"coalesce({', '.join(found)})"


_PHRASE = f"replace(replace(([{', '.join(repr(a) for a in AGES)}])[doc_id % 10 + 1], '{{n}}', CAST(18 + doc_id % 60 AS VARCHAR)), '{{d}}', CAST(2 + doc_id % 7 AS VARCHAR))"
_AGED = f"a AS (SELECT doc_id, t, {_age_sql()} AS a FROM (SELECT doc_id, {_PHRASE} || text AS t FROM documents))"


@query("TXT-11 PRJ-10", f"WITH {_AGED} SELECT doc_id, a.age AS age, a.matched AS matched, a.start AS start FROM a")
def age_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aged(spark, sf_dir).select("doc_id", text.extract_age(F.col("t")).alias("a")).select("doc_id", "a.age", "a.matched", "a.start")


@query(
    "TXT-12 TXT-13 UDF-4",
    rf"""WITH {_AGED}, o AS (SELECT doc_id, a, substr(t, 1, a.start) || CASE WHEN a.decade THEN CAST(a.age + 1 AS VARCHAR) ELSE regexp_replace(a.matched, '[0-9]+', CAST(a.age + 1 AS VARCHAR), 'g') END || substr(t, a.start + len(a.matched) + 1) AS o FROM a)
SELECT doc_id, md5(replace(regexp_replace(regexp_replace(o, '\b' || a.age || '(\.[0-9])', chr(1) || '\1', 'g'), '\b' || a.age || '\b', CAST(a.age + 1 AS VARCHAR), 'g'), chr(1), CAST(a.age AS VARCHAR))) AS edited FROM o""",
)
def age_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aged(spark, sf_dir).withColumn("a", text.extract_age(F.col("t")))
    return a.select("doc_id", F.md5(text.replace_age(F.col("t"), F.col("a"), text.age_plus_one(F.col("a.age"), F.col("doc_id")))).alias("edited"))


@query(
    "TXT-14 TXT-12",
    rf"""WITH {_AGED}, n AS (SELECT doc_id, t, a, CASE WHEN a.age IS NULL THEN NULL WHEN a.age < 50 THEN 60 + {_HASHED.format(x="CAST(doc_id AS VARCHAR)")} % 21 ELSE 18 + {_HASHED.format(x="CAST(doc_id AS VARCHAR)")} % 18 END AS b FROM a),
o AS (SELECT *, substr(t, 1, a.start) || CASE WHEN a.decade THEN CAST(b AS VARCHAR) ELSE regexp_replace(a.matched, '[0-9]+', CAST(b AS VARCHAR), 'g') END || substr(t, a.start + len(a.matched) + 1) AS o FROM n)
SELECT doc_id, CAST(b AS INT) AS bracket, md5(replace(regexp_replace(regexp_replace(o, '' || a.age || '(\.[0-9])', chr(1) || '', 'g'), '' || a.age || '', CAST(b AS VARCHAR), 'g'), chr(1), CAST(a.age AS VARCHAR))) AS edited FROM o""",
)
def age_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The young made old, the old young, in the texts' own forms."""
    a = _aged(spark, sf_dir).withColumn("a", text.extract_age(F.col("t")))
    a = a.withColumn("bracket", text.bracket_age(F.col("a.age"), F.col("doc_id").cast("string")))
    return a.select("doc_id", "bracket", F.md5(text.replace_age(F.col("t"), F.col("a"), F.col("bracket"))).alias("edited"))


# What an extractor and a model say, by turns of the conversations.
EXTRACTED = (" 1 ", "Binary answer: 1. The binary answer is 0", "I say yes", "unsure", "none", "2", "binary answers are 1", "No, not 1 of them")
SAID = ("no", "yes", "No.", "I can’t help with that", "as an AI, I would say yes", "perhaps")


def array_sql(values: tuple[str, ...], index: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[{index} % {len(values)} + 1]"


def at(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


_REFUSALS = ", ".join("'" + r.replace("'", "''") + "'" for r in lexicons.REFUSALS)


@query(
    "SCR-6 TXT-19",
    rf"""WITH r AS (SELECT conv_id, turn, {array_sql(EXTRACTED, '(conv_id + turn)')} AS e, {array_sql(SAID, '(conv_id * 3 + turn)')} || CASE WHEN turn % 2 = 0 THEN '' ELSE ' ' || text END AS s FROM conversations),
w AS (SELECT *, TRY_CAST(regexp_extract(e, '^\s*([+-]?[0-9]+)\s*$', 1) AS INT) AS i, TRY_CAST((regexp_extract_all(lower(e), 'binary answer[s]?\s*(?:is|are)?[:\s]*([01])', 1))[-1] AS INT) AS l, {_TOKENS.replace('text', 'e')} AS we, {_TOKENS.replace('text', 's')} AS ws, replace(lower(regexp_replace(s, '^\s+|\s+$', '', 'g')), '’', chr(39)) AS norm FROM r)
SELECT conv_id, turn, CAST(CASE WHEN i IN (0, 1) THEN i WHEN l IS NOT NULL THEN l WHEN list_has_any(we, ['yes', '1']) THEN 1 WHEN list_has_any(we, ['no', '0']) THEN 0 WHEN list_contains(ws, 'yes') THEN 1 ELSE 0 END AS INT) AS value,
  CASE WHEN i IN (0, 1) THEN 'integer_parse' WHEN l IS NOT NULL OR list_has_any(we, ['yes', '1', 'no', '0']) THEN 'extractor_text_match' WHEN list_has_any(ws, ['yes', 'no']) THEN 'model_response_regex' ELSE 'default' END AS method,
  len(list_filter([{_REFUSALS}], lambda p: starts_with(norm, p))) > 0 AS refusal FROM w""",
)
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    said = F.concat(at(SAID, conv * 3 + turn), F.when(turn % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.col("text"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", at(EXTRACTED, conv + turn).alias("e"), said.alias("s"))
    return rows.select("conv_id", "turn", parse.binary_answer(F.col("e"), F.col("s")).alias("a"), text.is_refusal(F.col("s")).alias("refusal")).select("conv_id", "turn", "a.value", "a.method", "refusal")


SCORED_SQL = f"SELECT doc_id, variant, prompt, {_HASHED.format(x='prompt')} % 6000 / 1000.0::DOUBLE - 3 AS logit FROM (SELECT doc_id, unnest(['original', 'fixed_sentence']) AS variant, 'Answer yes or no. ' || unnest(['', '{lexicons.FIXED_SENTENCE} ']) || text AS prompt FROM documents)"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    variants = F.array(F.struct(F.lit("original").alias("variant"), F.col("text").alias("t")), F.struct(F.lit("fixed_sentence").alias("variant"), text.prefixed(F.col("text")).alias("t")))
    long = docs.select("doc_id", F.explode(variants).alias("v"))
    return long.select("doc_id", "v.variant", F.concat(F.lit("Answer yes or no. "), F.col("v.t")).alias("prompt"))


@query("UDF-3 EVL-3", f"SELECT doc_id, variant, {R('logit')} AS logit FROM ({SCORED_SQL})")
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each document and variant, each distinct one scored once by the stand-in scorer."""
    return rounded(parse.score(prompts(spark, sf_dir), "prompt", parse.scorer("hash")).select("doc_id", "variant", "logit"))
