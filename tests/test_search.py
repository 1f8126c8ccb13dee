"""The calibrated search on small cases: conversations, resets, refusals, the second phase, and taking up a search."""

from pyspark.sql import functions as F

from evenkeel.plans import search


def script(replies):
    """A rewriter that says what is written for the case and the number of messages; keeps what it was asked."""
    asked = []

    def rewrite(df):
        rows = df.select("id", "messages").collect()
        asked.extend((r["id"], [m["content"] for m in r["messages"]]) for r in rows)
        table = F.create_map(*[F.lit(x) for k, v in replies.items() for x in (k, F.array(*map(F.lit, v)))]) if replies else None
        turn = F.floor((F.size("messages") - 1) / 2)
        return df.withColumn("reply", F.get(F.element_at(table, F.col("id")), turn.cast("int")))

    return rewrite, asked


TEN = "a b c d e f g h i j"


def run(spark, cases, replies, **more):
    rewrite, asked = script(replies)
    df = spark.createDataFrame(cases, "id int, text string, target double")
    got = {r["id"]: r.asDict() for r in search.calibrate(spark, df, rewrite, ["id"], **more).collect()}
    return got, asked


def test_first_reply_within_the_tolerance_is_taken(spark):
    got, asked = run(spark, [(1, TEN, 10.0), (2, TEN, 10.0)], {1: [f' "{TEN.replace("a", "x")}" '], 2: [TEN, "x y c d e f g h i j", "x b c d e f g h i j", "never"]}, max_retries=5)
    assert got[1] == {"id": 1, "paraphrase": "x b c d e f g h i j", "actual_pct": 10.0, "deviation": 0.0, "retries_used": 0, "phase": 1, "attempts": 1}
    assert (got[2]["retries_used"], got[2]["attempts"], got[2]["paraphrase"]) == (2, 3, "x b c d e f g h i j")
    told = [m for i, m in asked if i == 2]
    assert [len(m) for m in told] == [1, 3, 5] and "10.0%" in told[0][0] and told[0][0].endswith(TEN)
    assert "Make more changes" in told[1][2] and "Make fewer changes" in told[2][4]


def test_refusals_and_failed_calls_use_up_rounds_but_are_no_attempts(spark):
    got, asked = run(spark, [(1, TEN, 10.0), (2, TEN, 10.0)], {1: ["I can’t assist with it", "x b c d e f g h i j"], 2: [None, None, None]}, max_retries=2)
    assert (got[1]["retries_used"], got[1]["attempts"]) == (1, 1)
    assert [m for i, m in asked if i == 1][1][2] == search.Prompts().refused
    assert got[2] == {"id": 2, "paraphrase": TEN, "actual_pct": 0.0, "deviation": 10.0, "retries_used": 2, "phase": 0, "attempts": 0}
    assert [len(m) for i, m in asked if i == 2] == [1, 1, 1]


def test_reset_tells_the_best_attempt(spark):
    got, asked = run(spark, [(1, TEN, 30.0)], {1: [TEN, "x y c d e f g h i j", TEN, TEN]}, max_retries=3, reset_every=3)
    told = [m for _, m in asked]
    assert [len(m) for m in told] == [1, 3, 5, 1]
    assert "An earlier attempt changed 20.0% of the tokens. Make more changes" in told[3][0]
    assert (got[1]["actual_pct"], got[1]["phase"], got[1]["retries_used"]) == (20.0, 0, 3)


def test_only_overshoots_get_the_second_phase(spark):
    over, out = "x y z d e f g h i j", "1 2 3 4 5 6 7 8 9 0"
    got, asked = run(spark, [(1, TEN, 10.0), (2, TEN, 10.0)], {1: [over, out], 2: [over, TEN]}, max_retries=1)
    assert [m[0][:13] for i, m in asked if i == 1] == ["Paraphrase th", "Paraphrase th", "Replace about", "Replace about"]
    assert len([1 for i, _ in asked if i == 2]) == 2
    assert (got[1]["actual_pct"], got[1]["attempts"], got[1]["phase"]) == (30.0, 4, 0)  # the closest
    assert (got[2]["actual_pct"], got[2]["paraphrase"]) == (0.0, TEN)  # the closest that does not overshoot
    got, _ = run(spark, [(1, TEN, 30.0)], {1: [over + " k l m n"]}, max_retries=0)
    assert got[1]["phase"] == 0
    rewrite = lambda df: df.withColumn("reply", F.when(F.startswith(df.messages[0].content, F.lit("Replace")), F.lit("x b c d e f g h i j")).otherwise(out))
    df = spark.createDataFrame([(1, TEN, 10.0)], "id int, text string, target double")
    r = search.calibrate(spark, df, rewrite, ["id"], max_retries=3).first()
    assert (r["phase"], r["retries_used"], r["attempts"]) == (2, 4, 5)


def test_nulls_empty_texts_repeats_and_no_rows(spark):
    got, asked = run(spark, [(1, None, 10.0), (2, TEN, None), (3, "", 10.0)], {3: ["", ""]}, max_retries=1)
    assert got[1]["paraphrase"] is None and got[2]["deviation"] is None and {i for i, _ in asked} == {3}
    assert (got[3]["paraphrase"], got[3]["actual_pct"], got[3]["deviation"]) == ("", 0.0, 10.0)
    rewrite, _ = script({1: ["x b c d e f g h i j"]})
    df = spark.createDataFrame([(1, TEN, 10.0)] * 3, "id int, text string, target double")
    assert search.calibrate(spark, df, rewrite, ["id"], max_retries=0).count() == 3
    assert search.calibrate(spark, df.limit(0), rewrite, ["id"], max_retries=2).count() == 0


def test_a_search_that_was_cut_off_goes_on_after_its_last_whole_round(spark, tmp_path):
    df = spark.createDataFrame([(1, TEN, 10.0), (2, TEN, 10.0)], "id int, text string, target double")
    first, asked = script({1: [TEN, TEN, "x b c d e f g h i j"], 2: ["x b c d e f g h i j"]})
    calls = []

    def breaking(d):
        calls.append(1)
        if len(calls) == 3:
            raise ConnectionError("the driver goes away")
        return first(d)

    folder = f"file://{tmp_path}/search"
    try:
        search.calibrate(spark, df, breaking, ["id"], max_retries=4, folder=folder)
    except ConnectionError:
        pass
    again, later = script({1: [TEN, TEN, "x b c d e f g h i j"], 2: ["x b c d e f g h i j"]})
    noted = []

    def counted(d):
        noted.append(d.count())
        return again(d)

    got = {r["id"]: r["retries_used"] for r in search.calibrate(spark, df, counted, ["id"], max_retries=4, folder=folder).collect()}
    assert got == {1: 2, 2: 0}
    assert noted == [2, 1, 1]  # plans of the two whole rounds are made, but what they wrote is read


def test_an_expression_of_a_round_stands_once_and_a_text_is_written_once_for_each_use(spark, tmp_path):
    """A reply that is written into the plan again for each use of it is trimmed, split and compared that often."""
    rewrite, _ = script({1: [TEN, "x y c d e f g h i j"], 2: ["x b c d e f g h i j"]})
    df = spark.createDataFrame([(1, TEN, 10.0), (2, TEN, 10.0)], "id int, text string, target double")
    folder, plans = f"file://{tmp_path}/search", []

    def seen(d):
        out = rewrite(d)
        plans.append(search._measured(out, 0, 0.5, "words")._jdf.queryExecution().optimizedPlan().toString())
        return out

    search.calibrate(spark, df, seen, ["id"], max_retries=1, folder=folder)
    assert plans[0].count("trim(") <= 10 and "regexp_replace" not in plans[0]
    written = spark.read.parquet(f"{folder}/phase-1-round-0")
    assert not {"prompt", "messages"} & set(written.columns)
    rows = {r["id"]: r for r in written.collect()}
    assert rows[2]["made"]["paraphrase"] == "x b c d e f g h i j" and rows[2]["text"] is None and rows[2]["best"] is None and rows[2]["turns"] is None
    assert rows[1]["made"] is None and rows[1]["best"]["paraphrase"] == TEN and rows[1]["under"]["paraphrase"] is None


def test_what_stands_for_two_attempts_is_kept_when_the_best_moves_on(spark):
    """The closest that does not overshoot is written with the best while they are the same, and alone afterwards."""
    got, _ = run(spark, [(1, TEN, 30.0)], {1: [TEN, "x y z w e f g h i j", "I cannot help with it"]}, max_retries=2)
    assert (got[1]["paraphrase"], got[1]["actual_pct"], got[1]["phase"]) == (TEN, 0.0, 0)


def test_a_table_of_one_part_is_dealt_to_all_cores(spark):
    df = spark.range(4000).coalesce(1).select("id", F.repeat(F.lit("a b c d e f g h i j "), 200).alias("text"), F.lit(10.0).alias("target"))
    df = df.withColumn("text", F.concat("text", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.md5(F.concat(F.col("id").cast("string"), i.cast("string")))), " ")))
    parts = []
    keep = search.Scratch.keep_once

    def noted(self, d, name):
        out = keep(self, d, name)
        parts.append(out.select(F.input_file_name()).distinct().count())
        return out

    search.Scratch.keep_once = noted
    try:
        search.calibrate(spark, df, lambda d: d.withColumn("reply", F.col("text")), ["id"], max_retries=0).count()
    finally:
        search.Scratch.keep_once = keep
    assert parts[0] >= 4
