import json
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evenkeel import schemas
from evenkeel.operators import alignment, windows
from evenkeel.sources import readers, writers
from evenkeel.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def test_csv(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "pain one.csv").write_text('Vignette,Question,Answer,Dosage,Explanation\n"a ""b""\nc [race]",q?,Yes,N/A,"x, y"\n')
    (folder / "other.csv").write_text("Vignette,Question,Answer,Dosage,Explanation\nz,q,No,1,e\n")
    rows = readers.csv_by_file(spark, str(folder), schemas.VIGNETTE, {"pain one.csv": "acute"}).collect()
    assert [(r["Vignette"], r["context"], r["Explanation"]) for r in rows] == [('a "b"\nc [race]', "acute", "x, y")]
    assert readers.csv_strings(spark, str(folder), ["Vignette", "Question", "Answer", "Dosage", "Explanation"]).count() == 2
    assert spark.createDataFrame([(" NA ",), ("5",), ("null",)], "d string").select(readers.na_as_text(F.col("d"))).collect() == [("nan",), ("5",), ("nan",)]


def test_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"bio_id": 1, "logit_original": 0.5}, {"bio_id": 2, "logit_paraphrase": None}], indent=2))
    rows = readers.json_records(spark, str(tmp_path / "r.json"), schemas.LOGODDS).orderBy("bio_id").collect()
    assert rows[0]["logit_original"] == 0.5 and rows[1]["logit_paraphrase"] is None
    (tmp_path / "m.json").write_text(json.dumps({"7": {"paraphrase": "p", "retries_used": 2}, "8": {"paraphrase": "q"}}, indent=2))
    got = {r["id"]: (r["paraphrase"], r["retries_used"]) for r in readers.json_map(spark, str(tmp_path / "m.json"), schemas.PARAPHRASE).collect()}
    assert got == {"7": ("p", 2), "8": ("q", None)}
    case = {"context_id": "N1", "gender_swap_MANAGE": {"binary_answers": [1, 0, 1], "logit_probs": 0.25}, "original_VISIT": {"binary_answers": [0], "logit_probs": None}}
    (tmp_path / "c.json").write_text(json.dumps([case]))
    cases = readers.json_cases(spark, str(tmp_path / "c.json"), "context_id string", "context_id", schemas.TRIAGE_ANSWER)
    assert {(r["variant"], r["task"], tuple(r["binary_answers"])) for r in cases.collect()} == {("gender_swap", "MANAGE", (1, 0, 1)), ("original", "VISIT", (0,))}
    z = readers.logits_of_votes(cases.where("task = 'MANAGE'"), "logit_probs", "binary_answers").first()
    assert z["y"] == 1 and round(z["z"], 6) == -1.098612
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, x double")
    assert [r["x"] for r in readers.nan_as_null(nan).orderBy("i").collect()] == [None, 1.0]
    assert spark.range(4).select(readers.label_letter(F.col("id").cast("int"))).collect() == [("A",), ("B",), ("C",), ("D",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x")], "a int, LLAMA_1 string, big string")
    root = str(tmp_path / "out")
    writers.sheets(root, {"s": df, "t": df.select("a")})
    writers.sheets(root + "c", {"s": df.select("a")}, "csv")
    assert spark.read.parquet(root + "/t").count() == 1 and os.path.exists(root + "/s/_SUCCESS")
    writers.guarded(df, spark.read.parquet(root + "/s"), str(tmp_path / "g"))
    full = df.withColumn("LLAMA_1", F.lit("yes"))
    with pytest.raises(writers.Occupied):
        writers.guarded(df, full, str(tmp_path / "g"))
    assert writers.version(df, root + "v", 1).endswith("v=1")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.version(df, root + "v", 1)
    assert writers.without(df, ["big"]).columns == ["a", "LLAMA_1"]
    assert [tuple(r) for r in writers.metric_value(spark.createDataFrame([(1.0, 2)], "m double, n int")).collect()] == [("m", 1.0), ("n", 2.0)]


def test_windows(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("a", 1, "tie"), ("b", 5, "only")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in windows.first_wins(df, ["k"], ["o", "v"]).collect()} == {"a": "first", "b": "only"}
    many = spark.range(100).repartition(7)
    numbered = windows.row_index(many, ["id"]).collect()
    assert all(r["rn"] == r["id"] for r in numbered)
    shards = [r["shard"] for r in windows.contiguous_shard(many, ["id"], 7).orderBy("id").collect()]
    assert shards == [min(i // 14, 6) for i in range(100)]
    assert sorted(r["id"] for r in windows.stride_shard(many, ["id"], 9, 4).collect()) == list(range(4, 100, 9))
    groups = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)], "i int, g boolean")
    picked = windows.balanced_sample(groups, ["g"], ["i"]).groupBy("g").count().collect()
    assert sorted(r["count"] for r in picked) == [20, 20]
    assert windows.row_index(many.limit(0), ["id"]).count() == 0


def test_few_shot(spark):
    df = spark.createDataFrame([("a", i, 10 * i) for i in range(8)] + [("b", 1, 1), ("b", 2, 1)], "c string, k int, cost int")
    rows = windows.few_shot(df, "c", "k", "cost", 60).collect()
    assert len(rows) == 10
    for r in rows:
        if r["c"] == "b":
            assert r["first"] is None
        else:
            assert len({r["k"], r["first"], r["second"]}) == 3 and 10 * (r["first"] + r["second"]) <= 60
    again = windows.few_shot(df.repartition(3), "c", "k", "cost", 60).collect()
    assert sorted(again, key=str) == sorted(rows, key=str)


def test_alignment(spark):
    long = spark.createDataFrame([(1, "o", "a"), (1, "s", "b"), (2, "o", "c"), (3, "o", "d"), (3, "s", "e"), (3, "x", "f")], "c int, v string, t string")
    assert {tuple(r) for r in alignment.align(long, ["c"], "v", "t", ["o", "s"]).collect()} == {(1, "a", "b"), (3, "d", "e")}
    assert {r["c"] for r in alignment.complete_only(long, ["c"], "v", 3).collect()} == {3}
    assert {r["c"] for r in alignment.pending(long, long.where("c = 1"), ["c"]).collect()} == {2, 3}
    with pytest.raises(ValueError, match="without a match"):
        alignment.checked_lookup(long, long.where("c = 1").select("c").distinct(), ["c"])
    source = spark.createDataFrame([(1, 60, "white", "male", "r"), (1, 20, "white", "male", "y"), (1, 60, "black", "male", "b"), (1, 20, "black", "male", "two"), (2, 20, "white", "male", "no ref")], "q int, age int, race string, gender string, t string")
    got = {(r["q"], r["axis"], r["level"], r["t"], r["ref_t"]) for r in alignment.contrasts(source, "q", ["age", "race", "gender"], {"age": 60, "race": "white", "gender": "male"}).collect()}
    assert got == {(1, "age", "20", "y", "r"), (1, "race", "black", "b", "r")}
    left = spark.createDataFrame([(1,), (2,)], "id long")
    right = spark.createDataFrame([("1", "p")], "id string, p string")
    assert {tuple(r) for r in alignment.attach(left, right, ["id"]).collect()} == {(1, "p"), (2, None)}
    kept = spark.createDataFrame([("a",), (None,), ("x",)], "s string").where(alignment.dataset_not("s", "x"))
    assert kept.count() == 2


def test_resume_and_stream(spark, tmp_path):
    items = spark.range(5).withColumnRenamed("id", "case")
    done = str(tmp_path / "done")
    assert ingest.resume(spark, items, done, ["case"]).count() == 5
    items.limit(2).write.parquet(done)
    assert ingest.resume(spark, items, done, ["case"]).count() == 3
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [(1, "2024-01-01 00:00:00", "a", 0, 1), (1, "2024-01-01 00:00:01", "a", 0, 1), (2, "2024-01-01 00:10:00", "a", 1, 1)]
    df = spark.createDataFrame(rows, "id int, ts string, cell string, original int, edited int").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(source)
    schema = "id int, ts timestamp, cell string, original int, edited int"
    ingest.score_stream(spark, source, schema, out, checkpoint, ["id"], "ts").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    ingest.score_stream(spark, source, schema, out, checkpoint, ["id"], "ts").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    ingest.flip_stream(spark, source, schema, "ts", "1 hour", "1 hour", f"flips_{int(time.time())}").awaitTermination()


def test_entry_and_catalogue(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(r["flip_pert"] > r["flip_base"] for r in rows)
    from evenkeel.plans import catalogue

    names = catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(names) == set(catalogue.OPERATORS)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from evenkeel.plans import catalogue

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")

    def rows(df):
        plain = lambda v: None if v is None or v != v else round(v, 5) if isinstance(v, float) else v
        columns = sorted(df.columns)
        return sorted(repr([plain(v.item() if hasattr(v, "item") else v) for v in r]) for r in df[columns].astype(object).itertuples(index=False))

    for name in ("flip_rate_by_cell", "jsd_bits_paired_t", "ols_level_cluster", "wilcoxon", "balanced_sample", "calibration_select", "sentence_split", "subgroup_triples"):
        got, want = catalogue.queries()[name](spark, SMALL).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
        assert rows(got) == rows(want), name


def test_queries_by_name_are_resumed(spark, tmp_path):
    from evenkeel.__main__ import run_all

    out = str(tmp_path / "out")
    assert run_all(spark, SMALL, out, ["mi_by_cell", "head_k"]) == ["mi_by_cell", "head_k"]
    assert run_all(spark, SMALL, out, ["mi_by_cell", "phi_by_cell"], "json") == ["phi_by_cell"]
    assert spark.read.parquet(f"{out}/mi_by_cell").count() == spark.read.json(f"{out}/phi_by_cell").count() == 6
    with pytest.raises(ValueError, match="no query"):
        run_all(spark, SMALL, out, ["nothing"])


def test_sinks_and_readers_of_the_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"'), (2, None)], "k long, v string")
    writers.csv_file(rows, f"{tmp_path}/in", "one file.csv")
    with pytest.raises(Exception, match="one file"):
        writers.csv_file(rows, f"{tmp_path}/in", "one file.csv")
    writers.json_object(rows, "k", f"{tmp_path}/object")
    assert sorted(map(tuple, readers.json_map(spark, f"{tmp_path}/object", "struct<v:string>").collect())) == [("1", 'a "b"'), ("2", None)]
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, f"{tmp_path}/in")
    assert readers.checked(rows, "v", ['a "b"']).count() == 2
    with pytest.raises(Exception, match="not allowed"):
        readers.checked(rows, "v", ["x"]).collect()


def test_gates_name_what_failed(spark):
    from evenkeel.plans import studies

    df = spark.createDataFrame([(1.0,), (0.5,)], "mass double")
    gates = studies.gate(df, "mass", F.col("mass") >= 0.99).unionByName(studies.gate(df.limit(0), "empty", F.lit(True))).unionByName(studies.gate(df, "good", F.lit(True)))
    with pytest.raises(ValueError, match="gates failed: (mass, empty|empty, mass)$"):
        studies.require(gates)
    studies.require(gates.where("passed"))
    with pytest.raises(ValueError, match="1 of 2 shards"):
        studies.merged(spark.createDataFrame([(1, 1)], "s int, k int"), "s", 2, ["k"], ["s"])
