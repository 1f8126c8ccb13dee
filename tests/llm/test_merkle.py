"""Trees, proofs and tampering against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(rows, fanout=3):
    """doc_id, leaf, subroot, root, proof, folded root, verified of each row."""
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    key = lambda x: (x is not None, x)

    def climb(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
        return levels

    def way(levels, i):
        out = []
        for last in levels[:-1]:
            start = i // fanout * fanout
            out.append((last[start:i], last[i + 1 : start + fanout]))
            i //= fanout
        return out

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((r, leaf(r, r[1])) for r in rows if r[3] == s), key=lambda x: (key(x[0][0]), x[1])) for s in sources}
    low = {s: climb([x[1] for x in t]) for s, t in trees.items()}
    top = climb([low[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (r, at) in enumerate(trees[s]):
            path = way(low[s], i) + way(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            cur = leaf(r, r[1].replace("\n", "")) if hit else at
            for before, after in path:
                cur = h(*before, cur, *after)
            proof = h(*[x for before, after in path for x in (*before, *after)])
            out.append((r[0], at, low[s][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return out


def run(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    made = queries.op11_merkle(spark, f"{tmp_path}/{name}")
    return [tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(i, f"text {i}\nline é {rng.random()}", rng.choice(["en", None]), f"s{rng.randint(0, 3)}", i) for i in rng.sample(range(500), 130)]
    made += [(1000 + i, "hot\nsource", "en", "hot", None) for i in range(82)]
    return made + [
        (None, "no id\n", "en", "s1", 3), (None, "no id\n", "en", "s1", 3), (7000, None, None, None, None), (7001, "", "", "", 0), (7002, "\n" * 3, "x", None, 3), (7002, "\n" * 3, "x", None, 3),
        (7003, "😀\n日本" * 20_000, "-", "ß", 5), (7003, "other", "-", "ß", 5), (7004, "alone\n", "en", "single", 1), (-5, "below zero\n", "en", "s1", 1), (7005, "a", "en", "Z", 1),
    ]


def test_against_plain_python(spark, tmp_path, rows):
    got = run(spark, tmp_path, rows, "all")
    assert ordered(got) == ordered(plain(rows))
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_sizes_around_a_run(spark, tmp_path, n):
    rows = [(i, f"t\n{i}", "en", "one", i) for i in range(n)]
    assert ordered(run(spark, tmp_path, rows, f"n{n}")) == ordered(plain(rows))


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], "empty") == []


def test_other_fanouts_and_carried_columns(spark):
    rows = [(i, f"s{i % 2}", h(str(i)), i * 10, "x") for i in range(23)]
    df = spark.createDataFrame(rows, "id long, src string, leaf string, tree long, Merkle string")
    for fanout in (2, 5):
        made, c = merkle.prove(spark, df, "src", "id", "leaf", fanout)
        assert made.columns == [*df.columns, c] and c == "_merkle"
        bad = made.where(merkle.folded(F.col("leaf"), F.col(f"{c}.path")) != F.col(f"{c}.root"))
        assert made.count() == 23 and bad.count() == 0 and made.where("tree != id * 10").count() == 0
    with pytest.raises(ValueError):
        merkle.prove(spark, df, "src", "id", "leaf", 1)
