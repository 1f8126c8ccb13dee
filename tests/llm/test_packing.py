import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import packing, repair
from evenkeel.llm.common import Scratch
from evenkeel.llm.queries import tokenizer_path
from evenkeel.llm.tokenise import PieceEncoder

TEXTS = [
    "", " ", "  ", " a  b   c \n d", " \n", "x <|endoftext|> y", "a | b |c| ||", "don't we'll É'S", "e \t f", "\n\nq", "tail ", "tail\n", "日本 語 ½ ２",
    "x½. b²! é. é.́ ab'll= x≠ y≠ ≠", "The thoundring thoundring. The\nNext line, ÉLAN straße İstanbul ǅ", "a b  c", "😀 😀! a😀b", "word " * 3000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    e = PieceEncoder(tokenizer_path(name))
    want = [x.ids for x in e.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(2):  # unseen and remembered pieces
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(TEXTS)] == want
    assert e.plain is not None


def test_packing_is_gapless_and_whole(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1))
    path = tokenizer_path("byte_bpe_50k.json")
    made = sorted(packing.pack(spark, df, path, length=64).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in made:
        assert (r["sequence_id"] * 64 + r["offset"], len(r["ids"])) == (at, 4 * r["length"])
        assert 0 < r["length"] <= 64 - r["offset"]
        at += r["length"]
    last = made[-1]["sequence_tokens"]
    assert last == (at - 1) % 64 + 1
    assert made[-1]["padded_length"] == (last if last & (last - 1) == 0 else 64)
    tokenizer = PieceEncoder(path).tokenizer
    want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    got, now = [], []
    for r in made:
        assert r["start"] == len(now)
        now += np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            got.append(tuple(now))
            now = []
    assert not now and sorted(got) == want
    assert packing.pack(spark, df.limit(0), path).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 30, rng.integers(0, 400)) for _ in range(40)]
    docs = [np.concatenate((b, [2])).astype("<u4") for b in base] * 2 + [np.full(500, 7, "<u4"), np.zeros(0, "<u4"), np.array([2], "<u4")]
    data = repair.compress(docs, 100)
    shard = repair.Shard(data)
    assert len(shard.rules) and len(data) < 4 * sum(map(len, docs))
    assert shard.ids().tolist() == np.concatenate(docs).tolist()
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d.tolist()
    size = {}
    for i, (a, b) in enumerate(shard.rules.tolist()):
        size[100 + i] = size.get(a, 1) + size.get(b, 1)
    assert list(size.values()) == shard.expands.tolist()
    assert repair.Shard(repair.compress([], 100)).ids().tolist() == []
    with pytest.raises(ValueError):
        repair.Shard(data[:-2])


def test_files_in_id_order(spark):
    rows = [(5, "five"), (1, "one two"), (None, "none"), (5, "five again"), (9, None), (2, ""), (5, "five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("n", F.lit(0))
    shards = repair.write(spark, df, Scratch(spark, "test"), tokenizer_path("word_bpe_49k.json"))
    got = sorted(repair.read(spark, shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 5, 5, 5, 9]
    tokenizer = PieceEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    want = {(i, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows}
    assert {(r["doc_id"], zlib.crc32(r["ids"])) for r in got} == want
    at = 0
    for r in got:
        assert (r["start"], 4 * r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    empty = repair.write(spark, df.limit(0), Scratch(spark, "test"), tokenizer_path("word_bpe_49k.json"))
    assert repair.read(spark, empty).count() == 0


def pair_uses(symbols, begins):
    """How often each pair of neighbours can be replaced (overlaps from the left), not across documents' starts."""
    uses, last = {}, {}
    for i in range(len(symbols) - 1):
        if i + 1 in begins:
            continue
        p = (symbols[i], symbols[i + 1])
        if last.get(p) == i - 1:
            continue
        last[p] = i
        uses[p] = uses.get(p, 0) + 1
    return uses


def plain_repair(docs, terminals, pays=5):
    """Re-Pair, one most frequent pair at a time; bytes of symbols and rules."""
    seqs, at = [list(d) for d in docs], terminals
    while True:
        uses = {}
        for s in seqs:
            for p, n in pair_uses(s, set()).items():
                uses[p] = uses.get(p, 0) + n
        best = max(uses, key=uses.get, default=None)
        if best is None or uses[best] < pays:
            return 2 * sum(map(len, seqs)) + 8 * (at - terminals)
        for k, s in enumerate(seqs):
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    out.append(at)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[k] = out
        at += 1


def test_no_pair_is_left_that_pays_and_the_size_is_near_that_of_single_steps():
    rng = np.random.default_rng(9)
    words = [rng.integers(0, 300, rng.integers(1, 5)) for _ in range(150)]
    docs = [np.concatenate([words[min(149, int(k))] for k in rng.zipf(1.4, rng.integers(5, 60)) % 150]).astype("<u4") for _ in range(60)]
    docs += docs[:5] + [np.full(301, 7, "<u4")]
    data = repair.compress(docs, 400)
    shard = repair.Shard(data)
    assert shard.ids().tolist() == np.concatenate(docs).tolist()
    assert max(pair_uses(shard.symbols.tolist(), set(shard.begin.tolist())).values()) < 5
    size = 2 * len(shard.symbols) + 8 * len(shard.rules)
    assert size <= 1.03 * plain_repair(docs, 400)


def test_wide_symbols():
    rng = np.random.default_rng(3)
    docs = [np.concatenate([rng.integers(0, 200_000, 40)] * 6).astype("<u4") for _ in range(5)]
    shard = repair.Shard(repair.compress(docs, 200_000))
    assert len(shard.rules) and shard.ids().tolist() == np.concatenate(docs).tolist()
    assert max(pair_uses(shard.symbols.tolist(), set(shard.begin.tolist())).values()) < 4


def test_ids_beyond_the_vocabulary_are_refused():
    repair.compress([np.array([1, 99], np.uint32)], 100)
    for bad in (100, 70_000):
        with pytest.raises(ValueError, match="rules start at 100"):
            repair.compress([np.array([1, bad], np.uint32)], 100)
