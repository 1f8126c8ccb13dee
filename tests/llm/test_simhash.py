import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evenkeel.llm import simhash
from evenkeel.llm.common import Scratch
from evenkeel.llm.components import components

FOLD = {i: i + 32 for i in range(65, 91)}


def plain_print(text, size=3):
    words = [w for w in (text or "").translate(FOLD).encode().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """prints: list of ints -> smallest index reachable."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b", "a b c", "A B C d é\x0bÉ x", "the the the the the the", "x " * 700])
def test_fingerprint_is_the_majority_of_the_hashes(text):
    assert simhash.fingerprint(text, 3) & (2**64 - 1) == plain_print(text)


def test_links_of_close_prints_are_exact(spark):
    rng = random.Random(5)
    prints = {0, 1, 2**64 - 1, 2**63}
    for _ in range(6):  # crowds around a centre, and loners
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "f long").repartition(5)
    scratch = Scratch(spark, "test")
    got = dict(map(tuple, components(scratch, simhash.link_close(scratch, df)).collect()))
    groups = {}
    for p in prints:
        groups.setdefault(got.get(signed(p), signed(p)), set()).add(p)
    want = {}
    for p, g in zip(prints, plain_groups(prints), strict=True):
        want.setdefault(g, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_groups_of_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (4, base), (7, base + " more"), (2, "quite other words here"), (5, None), (6, "   "), (None, base), (2, "quite other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("taken")).withColumn("fingerprint", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.close_groups(spark, df, 3).collect()), key=str)
    close = (plain_print(base) ^ plain_print(base + " more")).bit_count() <= 2
    want = [(9, 4), (4, 4), (7, 4 if close else 7), (2, 2), (2, 2), (5, 5), (6, 5), (None, 4)]
    assert got == sorted(want, key=str)
    assert simhash.close_groups(spark, df.limit(0), 3).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 260)]
    loops = [(7, 7), (300, 301), (301, 300), (300, 301)]
    edges = [tuple(rng.sample(e, 2)) for e in chain + star] + loops
    df = spark.createDataFrame(edges + [(None, 4)], "a long, b long")
    got = dict(map(tuple, components(Scratch(spark, "test"), df).collect()))
    assert got == {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 260)} | {300: 300, 301: 300}
    assert components(Scratch(spark, "test"), df.limit(0)).count() == 0


def test_similar_texts_meet(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(4):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(200)] = "changed"
            rows.append((10 * g + c, " ".join(copy)))
            want[10 * g + c] = 10 * g
    rows += [(1000, None), (1001, ""), (1002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark, df).collect()}
    assert got == want | {1000: 1000, 1001: 1001, 1002: 1002}


def test_bands_meet_as_often_as_stated():
    rng = np.random.default_rng(1)
    bands, met, n = 8, 0, 150
    for _ in range(n):
        every = rng.integers(0, 1 << 63, 110, np.uint64)
        met += bool((simhash.band_cells(every[:100], bands) == simhash.band_cells(every[10:], bands)).any())  # similarity 90 / 110
    want = 1 - (1 - (90 / 110) ** simhash.ROWS) ** bands
    assert abs(met / n - want) < 4 * (want * (1 - want) / n) ** 0.5
    assert 1 - (1 - 0.8**simhash.ROWS) ** simhash.bands_needed(0.8, 0.9999) >= 0.9999


def test_full_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(4)
    sets, rows = {}, []
    for g in range(40):  # three of a group: the second is like the first and the third, which are not alike
        x = rng.integers(0, 1 << 40, 130)
        for k in range(3):
            sets[3 * g + k] = np.unique(x[10 * k : 10 * k + 100]).tolist()
    rows = [(7, f, len(sets[f]), f) for f in sets] + [(8, f, len(sets[f]), 5) for f in range(4)]
    members = spark.createDataFrame(rows, "cell long, f long, size long, root long").repartition(3)
    grams = spark.createDataFrame(list(sets.items()), "f long, grams array<long>")
    got = simhash.dense_links(Scratch(spark, "test"), members, grams, 0.8)
    assert sorted(map(tuple, got.collect())) == [(3 * g + x, 3 * g + x + 1) for g in range(40) for x in (0, 1)]


def exact_groups(texts, similarity=0.8, size=5):
    """Index of the first of each text's group, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else None)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def plain_words(text):
    return (text or "").translate(FOLD).encode().split()


@pytest.mark.parametrize("cells", ["as made", "two in all"])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, cells):
    if cells == "two in all":  # every cell is full, and of many groups
        monkeypatch.setattr(simhash, "band_cells", lambda grams, bands: np.array([0, 1 + int(grams[0]) % 2], np.int64))
        monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = random.Random(12)
    texts = [None, "", " ", "one", "ONE", "one two", "long " * 3000]
    for _ in range(12):  # around and under the threshold, in chains and stars
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("taken")).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark, df).collect()}
    assert got == dict(enumerate(exact_groups(texts)))
    assert simhash.similar_groups(spark, df.limit(0)).count() == 0


def test_hot_fingerprints(spark, monkeypatch):
    from evenkeel.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(100 + i, base) for i in range(30)] + [(i, f"{base} and {i}") for i in range(20)] + [(500 + i, f"other words of {i} kind") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.close_groups(spark, df, 3).collect()}
    want = dict(zip([i for i, _ in rows], plain_groups([plain_print(t) for _, t in rows]), strict=True))
    least = {}
    for i, g in want.items():
        least[g] = min(least.get(g, i), i)
    assert got == {i: least[g] for i, g in want.items()}


def test_pairs_of_one_hub_are_dealt_out(spark, monkeypatch):
    from evenkeel.llm import common

    monkeypatch.setattr(simhash, "PAIRS_A_TASK", 7)
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[: 200 - k % 60] + [f"x{k}"]) for k in range(80)]  # similar to the first, down to 0.7
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    firsts = docs.selectExpr("row AS f", "row")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 80)] + [(3, 4)], "a long, b long")
    got = simhash.verified(Scratch(spark, "test"), pairs, firsts, docs, 5, 0.8, "edges").collect()
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    want = [(a, b) for a, b in [(0, k) for k in range(1, 80)] + [(3, 4)] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(map(tuple, got)) == sorted(want) and 20 < len(want) < 80
