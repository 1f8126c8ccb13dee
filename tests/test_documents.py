"""JSON files of any size, read by ranges; documents with keys of their own."""

import json
import random

import pytest

from evenkeel.sources import documents, readers, writers

ODD = ['plain', 'a "quoted" word', "brace } and { and ] [", 'back\\slash " } \\', "line\nend\ttab", "é 日本 😀", '\\"}', "", "}}}}", '{"x": [1, {"y": "}"}]}', "\\\\"]


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(n, seed=1):
    rng = random.Random(seed)
    return [{"id": i, "t": " ".join(rng.choice(ODD) for _ in range(rng.randint(0, 6))), "more": {"k": [rng.choice(ODD), {"z": i}], "e": {}}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays(spark, tmp_path, small_ranges, indent):
    rows = made(120)
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps(made(30, 2), indent=indent) + "\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "blank.json").write_text("")
    path = f"file://{tmp_path}/*.json"
    assert spark.read.text(f"{tmp_path}/one.json").rdd.getNumPartitions() > 20
    got = documents.records(spark, path, "id long, t string, more struct<k: array<string>, e: map<string,string>>").collect()
    want = rows + made(30, 2)
    assert sorted((r["id"], r["t"], r["more"]["k"][0]) for r in got) == sorted((r["id"], r["t"], r["more"]["k"][0]) for r in want)


def test_objects(spark, tmp_path, small_ranges):
    rows = {f'key "{i}" }}{{': r for i, r in enumerate(made(80))}
    (tmp_path / "o.json").write_text(json.dumps(rows))
    got = documents.entries(spark, f"file://{tmp_path}/o.json", "t string", "name").collect()
    assert {r["name"]: r["t"] for r in got} == {k: v["t"] for k, v in rows.items()} and len(got) == 80


@pytest.mark.parametrize("cut", [1, 2, 30, 700])
def test_files_that_were_cut_off_are_refused(spark, tmp_path, small_ranges, cut):
    (tmp_path / "c.json").write_text(json.dumps(made(40))[:-cut])
    with pytest.raises(Exception, match="brackets do not match"):
        documents.records(spark, f"file://{tmp_path}/c.json", "id long").collect()


def test_what_the_sinks_write_is_json_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, ODD[i % len(ODD)]) for i in range(50)], "id long, t string").repartition(4)
    for path, write, frame in (("array", writers.json_array, df), ("none", writers.json_array, df.limit(0))):
        write(frame, f"file://{tmp_path}/{path}")
        held = json.loads((tmp_path / path / "part-00000.json").read_text())
        back = sorted(map(tuple, documents.records(spark, f"file://{tmp_path}/{path}", "id long, t string").collect()))
        assert sorted((r["id"], r["t"]) for r in held) == back == sorted(map(tuple, frame.collect()))
    writers.json_object(df, "id", f"file://{tmp_path}/object")
    assert json.loads((tmp_path / "object" / "part-00000.json").read_text()) == {str(i): {"t": t} for i, t in df.collect()}
    assert readers.json_map(spark, f"file://{tmp_path}/object", "struct<t:string>").count() == 50


def test_cases_of_documents_with_keys_of_their_own(spark):
    docs = [
        {"context_id": "N1", "original_VISIT": {"logit_probs": 0.25, "binary_answers": [1, 0, 1]}, "pct2.5_MANAGE": {"binary_answers": [0]}, "note": "x", "other_VISIT": "no object"},
        {"context_id": 7, "gender_swap_VISIT": {"logit_probs": None, "binary_answers": []}},
        {"original_VISIT": {"logit_probs": "much"}}, [1, 2], {},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",), (None,)], "value string")
    got = sorted(map(tuple, documents.cases(spark, df).collect()), key=str)
    assert got == sorted([("N1", "original", "VISIT", 0.25, [1, 0, 1]), ("N1", "pct2.5", "MANAGE", None, [0]), ("7", "gender_swap", "VISIT", None, []), (None, "original", "VISIT", None, None)], key=str)


def test_no_row_goes_through_the_rest_of_its_range_anew(spark, tmp_path):
    """A frame from each row to the last takes the square of a range's pieces."""
    (tmp_path / "a.json").write_text(json.dumps(made(300)))
    read = documents.elements(spark, f"file://{tmp_path}/a.json")
    assert "unboundedfollowing" not in read._jdf.queryExecution().optimizedPlan().toString().lower()
    assert read.count() == 300
