import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import langid

SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "shi"], "bb": ["sch", "ung", "ein", "ver", "ße"], "cc": ["eau", "tre", "que", "oi", "é"]}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 80))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = texts(500, 1)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 + 3 = ?", "bb"), (1003, rows[0][1] * 400, None), (1003, rows[0][1] * 400, None), (None, rows[1][1], None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("language", F.lit(0))
    model = langid.train(spark, df, F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False)))
    assert model.labels == ["aa", "bb", "cc"] and model.reject_below <= 0.5
    made, c = langid.identify(spark, df, model)
    got = made.collect()
    assert len(got) == len(rows) + len(odd)
    test = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 4 == 2]
    assert sum(r[c]["lang_pred"] == r["lang"] for r in test) >= 0.97 * len(test)
    assert sum(r[c]["rejected"] for r in test) <= 0.02 * len(test)
    assert all(0 <= r[c]["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r[c] for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["rejected"] for i in (1000, 1001, 1002))
    assert by_id[1003]["lang_pred"] == rows[0][2]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(spark, df)
    made, c = langid.identify(spark, df, model)
    assert made.first()[c]["lang_pred"] == "und"
    assert langid.identify(spark, df.limit(0), model)[0].count() == 0


def test_one_label(spark):
    df = spark.createDataFrame([(1, "abc def", "x"), (2, "ghi jkl mno pqr", "x")], "doc_id long, text string, lang string")
    made, c = langid.identify(spark, df, langid.train(spark, df))
    assert {r[c]["lang_pred"] for r in made.collect()} == {"x"}


def test_the_sample_does_not_depend_on_the_tables_order(spark):
    rows = texts(400, 2)
    rows += [rows[0]] * 50  # copies count once
    one = langid.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), per_label=40)
    two = langid.train(spark, spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(2), per_label=40)
    assert one.labels == two.labels and np.array_equal(one.table, two.table) and one.temperature == two.temperature


def test_long_and_short_texts_train_together():
    rows = [(t, y) for _, t, y in texts(60, 3)] + [(t * 3000, y) for _, t, y in texts(6, 4)]
    model = langid.fit(rows)
    assert np.isfinite(model.table).all() and np.isfinite(model.bias).all()
    got = [model.predict(t) for t, _ in rows]
    assert sum(g[0] == y for g, (_, y) in zip(got, rows, strict=True)) >= 0.97 * len(rows)


def test_texts_beyond_the_longest_learned_are_predicted(spark, monkeypatch):
    monkeypatch.setattr(langid, "LONGEST_LEARNED", 5000)
    rows = texts(200, 5)
    rows.append((999, rows[0][1] * 200, rows[0][2]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made, c = langid.identify(spark, df, langid.train(spark, df))
    assert {r["doc_id"]: r[c]["lang_pred"] for r in made.collect()}[999] == rows[0][2]


TABLE = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(TABLE), reason="no test table")
def test_the_test_table_is_learned_finite_accurate_and_calibrated(spark):
    docs = spark.read.parquet(TABLE)
    model = langid.train(spark, docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    assert np.isfinite(model.table).all()
    test = [r for r in pq.read_table(TABLE).to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and langid.has_letter(r["text"])]
    got = [model.predict(r["text"]) for r in test]
    right = np.array([g[0] == r["lang"] for g, r in zip(got, test, strict=True)])
    sure = np.array([g[1] for g in got])
    assert right.mean() >= 0.99 and (0 <= sure).all() and (sure <= 1).all()
    bins = np.digitize(sure, [0.5, 0.8, 0.9, 0.95, 0.99])
    error = sum(abs(right[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert error < 0.03  # expected calibration error


def plain_prediction(m, text):
    """The mean of the subwords' rows, a softmax, and the largest of it, one subword at a time."""
    import math

    u32 = 0xFFFFFFFF
    folded = [c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
    a = [32]
    for c in [*folded, 32]:
        if c != 32 or a[-1] != 32:
            a.append(c)
    odd, total, count = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], [0.0] * len(m.labels), 0
    for start in range(len(a)):
        h = 0
        for n in range(1, max(langid.GRAMS) + 1):
            if start + n > len(a):
                break
            h = (h + (a[start + n - 1] + n) * odd[n - 1]) & u32
            h ^= h >> 15
            if n in langid.GRAMS:
                row = m.table[((h * 0x2C1B3C6D) & u32) >> 17]
                total = [t + x for t, x in zip(total, row, strict=True)]
                count += 1
    z = [(t / count + b) / m.temperature for t, b in zip(total, m.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    p = [x / sum(e) for x in e]
    k = p.index(max(p))
    return m.labels[k], p[k]


def test_predictions_against_a_plain_computation():
    rng = random.Random(8)
    words = {"aa": ["tha", "ing", "the"], "bb": ["eau", "que", "é"], "cc": ["sch", "ung", "ß"]}
    rows = [(" ".join(rng.choice(ws) + rng.choice(ws) for _ in range(rng.randint(3, 20))), y) for y, ws in words.items() for _ in range(60)]
    m = langid.fit(rows)
    for text in [t for t, _ in rows[::9]] + ["x", "The 12, que!", "日本 é", "a" * 3000]:
        label, score, _ = m.predict(text)
        want, p = plain_prediction(m, text)
        assert label == want and abs(score - p) < 1e-6


def test_many_languages_are_all_learned(spark):
    rows = [(f"w{k}a w{k}b " + f"{chr(97 + k % 26)}{chr(97 + k // 26)}q" * 3, f"l{k}") for k in range(300) for _ in range(2)]
    df = spark.createDataFrame([(t + f" {i}", y) for i, (t, y) in enumerate(rows)], "text string, lang string")
    assert len(langid.train(spark, df).labels) == 300
