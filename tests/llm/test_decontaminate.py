import random
import re

from pyspark.sql import functions as F

from evenkeel.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {i: i + 32 for i in range(65, 91)}


def brute(text, items, size):
    w = WORD.findall((text or "").translate(AZ))
    hit, ids = set(), set()
    for item, t in items:
        q = WORD.findall((t or "").translate(AZ))
        for i in range(max(1, len(q) - size + 1) if q else 0):
            part = q[i : i + size]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    ids.add(item)
    return len(w), len(hit), sorted(ids)


def test_scan_equals_brute_force_and_spans_name_the_words():
    rng = random.Random(2)
    vocabulary = ["a", "b", "ab", "é", "Ü1", "x9"]
    for _ in range(150):
        items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7)))) for i in range(4)]
        automaton = d._automaton(rng.random(), items, 3)
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, 40)))
        n, hit, ids, spans = d.scan(automaton, text)
        assert (n, hit, ids) == brute(text, items, 3)
        assert sum(len(WORD.findall(text[a:b].translate(AZ))) for a, b in spans) == hit


def test_odd_rows_and_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before. {passage.upper()}! After", "x"), (2, None, "y"), (None, "", "z"), (1, "nothing here", None), (3, "short ITEM", "w")], "doc_id long, text string, decontamination string")
    bench = spark.createDataFrame([(7, passage), (7, passage), (8, "Short, item"), (9, None), (10, "?!")], "item_id long, text string")
    made, c = d.decontaminate(spark, docs, bench)
    assert c != "decontamination" and made.columns == [*docs.columns, c]
    rows = {(r["doc_id"], r["text"]): r[c] for r in made.collect()}
    found = rows[1, f"Before. {passage.upper()}! After"]
    assert (found["n_words"], found["n_hit"], found["item_ids"]) == (13, 11, ["7"])
    assert [(s["start"], s["end"]) for s in found["spans"]] == [(8, 8 + len(passage))]
    assert rows[3, "short ITEM"]["item_ids"] == ["8"]
    assert rows[2, None]["n_words"] == 0 and rows[None, ""]["n_hit"] == 0 and rows[1, "nothing here"]["n_hit"] == 0
    assert d.decontaminate(spark, docs.limit(0), bench)[0].count() == 0
    none, c = d.decontaminate(spark, docs, bench.limit(0))
    assert none.where(F.col(f"{c}.n_hit") > 0).count() == 0


def test_very_long_text():
    long = "word " * 300_000 + "alpha beta gamma"
    automaton = d._automaton("long", [("1", "Alpha Beta Gamma")], 3)
    n, hit, ids, spans = d.scan(automaton, long)
    assert (n, hit, ids) == (300_003, 3, ["1"]) and long[spans[0][0] : spans[0][1]] == "alpha beta gamma"


def test_several_automata_find_what_one_finds(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "b", "ab", "é", "Ü1", "x9", "c"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 2, 5, 7, 9, 4, 300, 6, 3, 8])] + [(3, "a b"), (99, None)]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "?"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string").withColumns({n: F.lit("x") for n in ("__key", "n_hit", "item_ids", "spans", "runs", "__hits")}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, c = d.decontaminate(spark, docs, bench, 4)
    key = lambda r: str((r["doc_id"], r["text"], r["__key"], r[c]["n_words"], r[c]["n_hit"], r[c]["item_ids"], [tuple(s) for s in r[c]["spans"]]))
    want = sorted(map(key, one.collect()))
    monkeypatch.setattr(d, "AUTOMATON_BYTES", 160)
    more, c2 = d.decontaminate(spark, docs, bench, 4)
    assert c2 == c and more.columns == one.columns and more.schema.simpleString() == one.schema.simpleString()
    got = more.collect()
    assert sorted(map(key, got)) == want
    for r in got[:40]:
        assert (r[c]["n_words"], r[c]["n_hit"], r[c]["item_ids"]) == brute(r["text"], [(str(i), t) for i, t in items], 4)
