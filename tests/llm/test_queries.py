"""Every opN query over a small folder of tables, held against plain Python that follows the contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from evenkeel.llm import htmlcut, licenses, lmscore, queries, secretscan
from evenkeel.llm.tokenise import PieceEncoder

AZ = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SYLLABLES = {"en": ["the", "ing", "tion", "and", "er", "wh"], "fr": ["eau", "que", "le", "é", "oi", "tre"], "de": ["sch", "ung", "ein", "ver", "ße", "cht"]}
NOTICE = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software), to deal in the Software\nwithout restriction"


def crc(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(17)

    def text(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    items = [(1, text("en", 25)), (2, "short one"), (3, None), (4, text("fr", 12)), (5, "...")]
    rows = [(i, text(lang := rng.choice(sorted(SYLLABLES)), rng.randint(2, 60)), lang) for i in range(90)]
    rows += [
        (100, None, "en"), (101, "", "en"), (102, " \n\t ", None), (103, "12 34 -", "fr"), (104, rows[3][1], rows[3][2]), (105, rows[3][1].upper(), rows[3][2]), (106, rows[3][1] + " x", rows[3][2]),
        (107, text("en", 10) + " " + items[0][1].upper().replace(" ", ", ") + ". " + text("en", 5), "en"), (108, "it has the short, one here", "en"), (109, text("de", 20_000), "de"), (110, "one", "en"),
        (111, f"x\n{NOTICE}.\n{text('en', 6)}\nall rights reserved, mit license", "en"), (112, "GNU general\npublic license; apache license cc by CC-BY 4", "en"), (113, "é token = 'abcdef12' AKIA" + "Z9" * 9 + " " + "0f" * 15 + " passwd:abc", "en"),
        (114, "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 20 + "\n-----END RSA PRIVATE KEY-----\n" + "deadbeef" * 3 + "g secret:abcdef", "en"), (115, "<|endoftext|> x", "en"), (116, "😀 日本 語", None),
    ]
    root = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, la, f"src{i % 3}", len(t or "")) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    pages = [(1, "u", "<html><body><nav><a href=a>Menu one</a></nav><article><h1>Head&amp;line</h1><p>Some text, of  it.\n Yes.</p></article><footer>Imprint, of us.</footer>"), (2, "v", None), (3, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root, rows, items, pages


def run(spark, folder, name):
    return {r["page_id" if name == "op10_htmlcut" else "doc_id"]: r.asDict() for r in queries.queries()[name](spark, folder[0]).collect()}


def test_op1(spark, folder):
    _, rows, _, _ = folder
    prints = []
    for _, t, _ in rows:
        w = (t or "").translate(AZ).encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if w else 0)
    least = {i: i for i, _, _ in rows}
    for _ in range(len(rows)):
        for (i, _, _), a in zip(rows, prints, strict=True):
            for (j, _, _), b in zip(rows, prints, strict=True):
                if (a ^ b).bit_count() <= 2:
                    least[i] = least[j] = min(least[i], least[j])
        if all(least[i] == least[j] for (i, _, _), a in zip(rows, prints, strict=True) for (j, _, _), b in zip(rows, prints, strict=True) if (a ^ b).bit_count() <= 2):
            break
    got = run(spark, folder, "op1_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", least[i]) for (i, _, _), p in zip(rows, prints, strict=True)}


def test_op2(spark, folder):
    _, rows, items, _ = folder
    words = lambda t: WORD.findall((t or "").translate(AZ))
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            windows[str(i)] = {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    got = run(spark, folder, "op2_decontaminate")
    assert len(got) == len(rows)
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for item, wins in windows.items():
            for win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert got[i] == {"doc_id": i, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": sha, "contaminated": bool(hit)}, i


def test_op3(spark, folder):
    _, rows, _, _ = folder
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ)), None]
    train = Counter(x for i, t, _ in rows if crc(i, 7) != 2 for x in tokens(t))
    n, v = sum(train.values()), len(train)
    got = run(spark, folder, "op3_lmscore")
    for i, t, _ in rows:
        r, x = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(x), sum(train[y] > 0 for y in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[y] + 1) / (n + v + 1)) for y in x), rel_tol=1e-9)
        assert -20 * len(x) < r["score"] < 0
    assert got[104]["score"] == got[3]["score"]  # equal texts
    # The model with all counts read rightly; the filter reads some n-grams a level too high.
    pairs = Counter()
    for i, t, _ in rows:
        if crc(i, 7) != 2:
            x = tokens(t)
            pairs.update(zip(["start", *x], x, strict=False))
    level = lambda c: lmscore.LEVELS[int(lmscore.levels(np.array([c]))[0])] if c else 0.0
    near, mass, after = 0, sum(map(level, train.values())), Counter()
    for (v0, _), c in pairs.items():
        after[v0] += level(c)
    for i, t, _ in rows:
        x, want = tokens(t), 0.0
        for v0, w in zip(["start", *x], x, strict=False):
            want += math.log10((level(pairs[v0, w]) + lmscore.MU * (level(train[w]) + 1) / (mass + v + 1)) / (after[v0] + lmscore.MU))
        assert abs(got[i]["score"] - want) < 0.1 * abs(want)
        near += abs(got[i]["score"] - want) < 0.02 * abs(want)
    assert near > 0.8 * len(rows)


def test_op4(spark, folder):
    _, rows, _, _ = folder
    rules = secretscan.BASE + secretscan.MORE
    base = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    got = run(spark, folder, "op4_secrets")
    for i, t, _ in rows:
        spans = []
        for rank, rule in enumerate(rules):
            pattern, good = base.get(rule.kind, (rule.pattern, lambda m: True))
            spans += [(m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if good(m)]
        spans.sort()
        first = ",".join(s for _, k, s in spans if k < 3)
        want = [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["base_sha256"], got[i]["spans"]] == [*want, hashlib.sha256(first.encode()).hexdigest(), ",".join(s for _, _, s in spans)], i
    assert "private_key:0:" in got[114]["spans"]


def test_op5(spark, folder):
    _, rows, _, _ = folder
    got = run(spark, folder, "op5_licenses")
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(AZ))
        places = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None)), i
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "notice:mit" in got[111]["labels"].split(",") and got[111]["score"] == 1.0


def test_op6(spark, folder):
    _, rows, _, _ = folder
    tokenizer = PieceEncoder(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    got = [r.asDict() for r in queries.queries()["op6_packing"](spark, folder[0]).collect()]
    at = dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and len(piece) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    end = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= 2048 and sorted(end) == list(range(len(end))) and len(end) == -(-sum(map(len, ids.values())) // 2048)


def test_op7(spark, folder):
    _, rows, _, _ = folder
    tokenizer = PieceEncoder(queries.tokenizer_path("word_bpe_49k.json")).tokenizer
    got, at = run(spark, folder, "op7_repair"), 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == {"doc_id": i, "start": at, "n_tokens": len(x), "ids_crc32": zlib.crc32(np.array(x, "<u4").tobytes())}, i
        at += len(x)


def test_op8(spark, folder):
    _, rows, _, _ = folder
    got = run(spark, folder, "op8_tiff")
    for i, t, _ in rows:
        raw = (t or "").encode()
        pad = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])), i
        assert r["media_bytes"] > 0 and re.fullmatch("[0-9a-f]{64}", r["media_sha256"])
        f = dict(x.split("=") for x in r["feature"].split(";"))
        steps = sum(abs(pad[k] - pad[k - 1]) for k in range(1, len(pad)) if k % 64)
        assert {k: int(v) for k, v in f.items() if k != "pages"} == {"rows": len(pad) // 64, "levels": len(set(pad)), "sum": sum(pad), "steps": steps} and int(f["pages"]) >= 1
    same = lambda i: [got[i][k] for k in ("media_sha256", "feature", "media_bytes")]
    assert same(104) == same(3) and same(100) == same(101) and same(104) != same(105)


def test_op9(spark, folder):
    _, rows, _, _ = folder
    got = run(spark, folder, "op9_langid")
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == "und" if not any(map(str.isalpha, t or "")) else r["lang_pred"] in SYLLABLES
    plain = [(i, la) for i, _, la in rows if i < 90 and crc(i, 4) == 2]
    assert sum(got[i]["lang_pred"] == la for i, la in plain) >= 0.9 * len(plain)


def test_op10(spark, folder):
    _, _, _, pages = folder
    got = run(spark, folder, "op10_htmlcut")
    assert got == {i: {"page_id": i, "url": u, "text": htmlcut.extract(p), "n_chars": len(htmlcut.extract(p))} for i, u, p in pages}
    assert got[1]["text"] == "Head&line\n\nSome text, of it. Yes."


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    clients = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
    spark.createDataFrame([], clients).write.parquet(f"{tmp_path}/clients.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0
