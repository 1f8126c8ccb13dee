import random
import re

from pyspark.sql import functions as F

from evenkeel.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {i: i + 32 for i in range(65, 91)}
SETS = licenses.template_sets()


def words(t):
    return WORD.findall((t or "").translate(AZ))


def brute(text):
    w, places, labels, score = words(text), [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    lines = [x for x in map(words, (text or "").split("\n")) if x]
    for label, t, need, reach in SETS:
        for i, line in enumerate(lines):
            held, after = set(line), 0
            for more in lines[i + 1 :]:
                if after >= reach - 1:
                    break
                held |= set(more)
                after += len(more)
            both = len(held & set(t))
            if both >= need:
                labels.add(label)
                score = max(score, both / len(t))
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places}), sorted(labels), score


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = sorted({w for _, t, _, _ in SETS for w in t}) + ["mit license", "CC-BY", "GNU General Public License", "apache\nlicense", "é", "K", "İ"]
    texts = ["", None, "  ", "Released under the MIT License.", "mit\n\nlicense", "cc by cc by", "x\n\n" + licenses.TEMPLATES[7][1].replace(" ", "\n", 9) + "\n \ny", "gnu general public license " * 400]
    for _ in range(150):
        _, t = rng.choice(licenses.TEMPLATES)
        line = [w for w in t.split() if rng.random() < rng.choice([0.75, 0.9, 1])]
        texts.append("\n".join([" ".join(rng.sample(pool, 6)), " ".join(line), rng.choice(["", " - ", "z"]), " ".join(rng.sample(pool, 3))]))
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("taken")).repartition(3)
    got = licenses.scan(spark, df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[3] if r["doc_id"] is None else texts[r["doc_id"]]
        hits = {h["label"]: h for h in r["hits"]}
        first = min((h["before"] for h in hits.values()), default=None)
        last = max((r["n_words"] - h["after"] for h in hits.values()), default=None)
        assert (r["n_words"], sum(h["n"] for h in hits.values()), first, last, sorted(hits), r["labels"], r["score"]) == brute(t), t
    assert licenses.scan(spark, df.limit(0)).count() == 0


def test_notices_are_found_however_they_are_wrapped(spark):
    rows, want = [], {}
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for j, width in enumerate((1, 3, 9, 100)):
            wrapped = "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))
            rows += [(100 * k + j, wrapped), (100 * k + 10 + j, f"some words before it {wrapped}\n\nand after"), (100 * k + 20 + j, f"a line before\n# {wrapped}\n- -\nother words")]
            want |= {100 * k + 10 * x + j: label for x in range(3)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(spark, df).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"] and got[i]["score"] == 1.0, (i, label)
