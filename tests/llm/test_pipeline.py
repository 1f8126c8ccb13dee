import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SYLLABLES = {"en": ["the", "ing", "tion", "and", "er", "wh"], "fr": ["eau", "que", "le", "é", "oi", "tre"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)

    def text(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang := rng.choice(["en", "fr"]), rng.randint(60, 200)), lang) for i in range(120)]
    passage = text("en", 40)
    rows += [(200, rows[5][1], "en"), (201, rows[6][1] + " more", rows[6][2]), (202, text("en", 50) + " " + passage + " " + text("en", 50), "en"), (203, "123 456 ---", "en"), (204, None, "en"), (205, text("en", 80) + " token = abcdef123456 " + text("en", 80), "en")]
    root = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, la, "src", len(t or "")) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def test_each_stage_does_its_part(spark, folder):
    root, rows = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "leaks", "secrets", "pack"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), docs.schema)
    every = {i for i, _, _ in rows}
    assert every - set(kept["language"]) == {203, 204}
    assert set(kept["language"]) - set(kept["near_copies"]) == {200, 201}
    assert set(kept["near_copies"]) - set(kept["leaks"]) == {202}
    assert set(kept["secrets"]) == set(kept["leaks"])
    clean = kept["secrets"][205]
    assert " [secret] " in clean["text"] and "abcdef123456" not in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert all(kept["secrets"][i]["text"] == kept["leaks"][i]["text"] for i in kept["leaks"] if i != 205)


def test_run_packs_what_is_left(spark, folder):
    root, _ = folder
    got = corpus_pipeline.run(spark, root)
    whole = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(whole) == 121 and all(r["n"] == r["m"] for r in whole)


def test_near_copies_keep_one_row_of_each_group(spark):
    rng = random.Random(11)
    one, two, three, four, five = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(1, one), (1, one), (1, two), (None, three), (None, four), (None, four), (9, five), (None, five), (8, five + " more"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, one), (1, two), (None, three), (None, four), (8, five + " more"), (3, None)], key=str)


@pytest.fixture(scope="module")
def odd(spark, folder, tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    _, rows = folder
    rng = random.Random(21)
    long = " ".join("".join(rng.choice(SYLLABLES["en"]) for _ in range(3)) for _ in range(60_000))
    base = [(i, t, la, "src", len(t or ""), i, "x") for i, t, la in rows[:30]]
    base += [(None, rows[31][1], None, None, None, None, None), (40, None, "en", "s", 0, 1, "x"), (41, "", "en", "s", 0, 1, "x"), (42, long, "en", "s", len(long), 1, "x"), (43, long + " token = abcdef123456", "en", "s", 1, 1, "x"), base[2], base[2], (44, "…", None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, language long, secrets string"
    docs = spark.createDataFrame(base, schema).withColumns({"__key": F.lit("k"), "simhash": F.lit(1), "decontamination": F.lit(2.0), "component_id": F.lit(7), "ids": F.lit("i")})
    return docs.repartition(3)


@pytest.mark.parametrize("name", ["language", "near_copies", "leaks", "secrets"])
def test_stages_on_odd_rows(spark, folder, odd, name):
    root, _ = folder
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, root)
    assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
    got, every = [r.asDict() for r in out.collect()], [r.asDict() for r in odd.collect()]
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    key = lambda r: str([r[c] for c in rest])
    assert {key(r) for r in got} <= {key(r) for r in every}
    kept = sorted(str(r["doc_id"]) for r in got)
    want = sorted(str(r["doc_id"]) for r in every)
    if name == "language":
        gone = {"40", "41", "44"}  # nothing to tell a language by
        assert kept == [i for i in want if i not in gone]
    elif name == "near_copies":
        twice = str(every[[str(r["doc_id"]) for r in every].index("2")]["doc_id"])
        assert kept == sorted([i for i in want if i not in {twice, "43"}] + [twice])  # 43 is 42 and a little more
    else:
        assert kept == want
    if name == "secrets":
        by = {r["doc_id"]: r for r in got}
        assert by[43]["text"].endswith(" [secret]") and by[43]["n_chars"] == len(by[43]["text"]) and by[40]["text"] is None and by[42]["text"] == next(r["text"] for r in every if r["doc_id"] == 42)


def test_stages_on_an_empty_table(spark, folder, odd):
    root, _ = folder
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd.limit(0), root)
        assert out.columns == odd.columns and out.count() == 0, name
    assert corpus_pipeline.pack(spark, odd.limit(0), root).count() == 0


def test_packing_odd_rows(spark, folder, odd):
    root, _ = folder
    got = corpus_pipeline.pack(spark, odd, root)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
