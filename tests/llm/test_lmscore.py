import glob
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evenkeel import scratch as scratches
from evenkeel.llm import lmscore
from evenkeel.llm.common import Scratch

AZ = {i: i + 32 for i in range(65, 91)}


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ)), None]


def table(n=160):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "The"]
    follow = {w: rng.sample(words, 4) for w in words}
    rows = []
    for i in range(n):
        w = rng.choice(words)
        text = []
        for _ in range(rng.randint(1, 60)):
            text.append(w)
            w = rng.choice(follow[w])
        rows.append((i, "  ".join(text)))
    return [*rows, (500, None), (501, ""), (502, "never seen words"), (None, "no id"), (7, rows[7][1])]


@pytest.fixture(scope="module")
def scored(spark):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lm", F.lit(1))
    scratch = Scratch(spark, "test")
    model = lmscore.train(spark, scratch, df.where(~lmscore.held_out()))
    made, c = lmscore.score(spark, df, model, scratch)
    return rows, df, model, scratch, made.withColumnRenamed(c, "s").collect()


def test_base_scores_are_exact(scored):
    rows, _, model, _, got = scored
    train = Counter(t for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in plain_tokens(x))
    n, v = sum(train.values()), len(train)
    assert (model.totals.tokens, model.totals.distinct) == (n, v)
    assert len(got) == len(rows)
    for r in got:
        t = plain_tokens(r["text"])
        assert (r["s"]["n_tokens"], r["s"]["n_known"]) == (len(t), sum(train[x] > 0 for x in t))
        assert math.isclose(r["s"]["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert r["s"]["score"] < 0


def test_the_model_beats_the_base_on_held_out_texts(scored):
    _, _, _, _, got = scored
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert len(held) > 10 and sum(r["s"]["score"] for r in held) > 0.8 * sum(r["s"]["base_score"] for r in held)


def test_levels_read_back(scored):
    rows, _, model, _, _ = scored
    words, starts = lmscore.tokens([x for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    with np.errstate(over="ignore"):
        pairs, n = np.unique(lmscore.pair(lmscore.before(words, starts), words), return_counts=True)
        got = model.filter.levels(pairs, lmscore.place(pairs, model.segments))
        strange = lmscore.mix(np.arange(1, 20_001, dtype=np.uint64))
        wrong = model.filter.levels(strange, lmscore.place(strange, model.segments))
    want = lmscore.levels(n)
    assert (got >= want).all() and (got > want).mean() < 0.1
    assert (wrong > 0).mean() < 0.06
    assert lmscore.LEVELS[1:4].tolist() == [1, 2, 3]


@pytest.mark.parametrize("segment", [4 << 20, 1500])
def test_probabilities_add_up_to_one(spark, monkeypatch, segment):
    """Over all known tokens and one unknown, after every token and the start; in a filter that reads no level too high."""
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(lmscore, "BITS_EACH", 300.0)
    monkeypatch.setattr(lmscore, "SUM_BYTES", 2000)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lmscore.train(spark, Scratch(spark, "test"), df)
    lm, totals = model.filter, model.totals
    every = np.concatenate((lm.words, [np.uint64(12345)]))
    with np.errstate(over="ignore"):
        word = lmscore.LEVELS[lm.levels(lmscore.single(every), lmscore.place(lmscore.mix(every), model.segments))]
        assert word[-1] == 0 and (word[:-1] > 0).all()
        _, sums = lm.exact(every)
        for i, v in enumerate([*every, np.uint64(lmscore._START)]):
            prior = np.full(len(every), v, np.uint64)
            pairs = lmscore.pair(prior, every)
            both = lmscore.LEVELS[lm.levels(pairs, lmscore.place(pairs, model.segments))]
            k = min(i, len(every) - 1)
            context, own = np.full(len(every), word[k]), np.full(len(every), sums[k])
            made = totals.score(np.arange(len(every)), prior, word, context, both, own)
            assert abs((10.0**made).sum() - 1) < 1e-9, v


def key(r, s):
    return str(r["doc_id"]), str(r["text"]), s["n_tokens"], s["n_known"], round(s["base_score"], 8), round(s["score"], 8)


@pytest.mark.parametrize("limit", ["MAX_FILTER_BYTES", "MAX_SENT_WORDS"])
def test_routed_probes_give_the_same(spark, monkeypatch, limit):
    rows = [*table(), (600, "w1 w2 " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lm", F.lit(1)).repartition(3)
    train = df.where(~lmscore.held_out())
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", 2000)
    scratch = Scratch(spark, "test")
    made, c = lmscore.score(spark, df, lmscore.train(spark, scratch, train), scratch)
    want = sorted(key(r, r[c]) for r in made.collect())
    monkeypatch.setattr(lmscore, limit, 10)
    monkeypatch.setattr(lmscore, "TOKENS_AT_ONCE", 500)
    monkeypatch.setattr(lmscore, "TOKENS_A_SEGMENT", 1)
    monkeypatch.setattr(lmscore, "SUM_BYTES", 100)
    scratch = Scratch(spark, "test")
    model = lmscore.train(spark, scratch, train)
    assert model.filter is None and model.segments > 4
    made, c = lmscore.score(spark, df, model, scratch, keep=["doc_id", "text"])
    assert made.columns == ["doc_id", "text", "_lm"]
    assert sorted(key(r, r[c]) for r in made.collect()) == want
    assert lmscore.score(spark, df.limit(0), model, scratch)[0].count() == 0


@pytest.mark.parametrize("most", [0, 200, 60_000, 1 << 20, 1 << 33])
def test_counts_take_as_few_bytes_as_they_need(most):
    counts = np.array([0, 7, most])
    made = lmscore._narrow(counts)
    assert len(made) == 3 * next(b for b in (1, 2, 4, 8) if most < 1 << 8 * b)
    assert lmscore._widened(pa.py_buffer(made), 3).tolist() == counts.tolist() and len(lmscore._widened(pa.py_buffer(b""), 0)) == 0


def test_workers_share_the_filter_instead_of_holding_it(spark, monkeypatch):
    """What is sent to each worker as an object does not grow with the filter."""
    sent, put = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(pickle.dumps(x))) or put(x))
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(400)], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    model = lmscore.train(spark, scratch, df)
    made, c = lmscore.score(spark, df, model, scratch)
    assert made.agg(F.sum(f"{c}.n_known")).first()[0] == 400 * 51
    assert model.filter_bytes + 16 * model.totals.distinct > 300_000 and len(sent) == 1 and sent[0] < 10_000


def test_stretches_are_written_small_and_in_small_parts(spark, monkeypatch):
    """Tokens by their places among the distinct words of a stretch; row groups of megabytes, whatever the number of rows."""
    monkeypatch.setattr(lmscore, "MAX_SENT_WORDS", 10)
    monkeypatch.setattr(lmscore, "TOKENS_AT_ONCE", 60_000)
    monkeypatch.setattr(scratches, "WIDE_BYTES", 1 << 20)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 5000), x -> concat('w', (x * (id + 7)) % 5003)))").alias("text")).coalesce(1)
    scratch = Scratch(spark, "test")
    made, c = lmscore.score(spark, df, lmscore.train(spark, scratch, df), scratch, keep=["doc_id"])
    assert made.agg(F.sum(f"{c}.n_tokens"), F.sum(f"{c}.n_known")).first() == (400 * 5001, 400 * 5001)
    kept = pq.ParquetFile(*glob.glob(scratch.root.removeprefix("file://") + "/stretches-*/*.parquet"))
    size = sum(kept.read([c]).column(0).nbytes for c in kept.schema_arrow.names if kept.schema_arrow.field(c).type == pa.binary())
    assert size < 7 * 400 * 5001 and kept.num_row_groups > 1


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", 2000)
    df = spark.createDataFrame(table(), "doc_id long, text string")
    model = lmscore.train(spark, Scratch(spark, "test"), df)
    assert model.segments > 4
    counts = Counter(t for _, x in table() for t in plain_tokens(x))
    assert model.filter.counts.sum() == sum(counts.values()) and sorted(model.filter.counts.tolist()) == sorted(counts.values())


@pytest.mark.parametrize(("texts", "segment"), [(40, 4 << 20), (1500, 4 << 20), (1500, 8000)])
def test_the_error_rate_does_not_depend_on_the_size(spark, monkeypatch, texts, segment):
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", segment)
    rng = random.Random(texts)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(50))) for i in range(texts)], "doc_id long, text string")
    model = lmscore.train(spark, Scratch(spark, "test"), df)
    strange = lmscore.mix(np.arange(1, 40_001, dtype=np.uint64))
    wrong = (model.filter.levels(strange, lmscore.place(strange, model.segments)) > 0).mean()
    assert 0.02 < wrong < 0.045  # (1 - exp(-PROBES / BITS_EACH)) ** PROBES = 0.031
    assert model.filter_bytes * 8 < 1.1 * lmscore.BITS_EACH * model.entries + 64 * model.segments


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    model = lmscore.train(spark, scratch, df.limit(0))
    made, c = lmscore.score(spark, df, model, scratch)
    assert made.first()[c]["n_known"] == 0 and made.first()[c]["n_tokens"] == 3
    assert lmscore.score(spark, df.limit(0), model, scratch)[0].count() == 0
