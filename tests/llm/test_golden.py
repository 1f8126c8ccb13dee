"""Surviving values against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from evenkeel.llm import queries

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
COLUMNS = ["cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance_cents", "name_from", "email_from", "segment_from", "balance_from", "address_from"]
DAY = datetime(2024, 3, 1)


def plain(rows):
    import math

    blank = lambda s: None if s is None or not s.strip(" \t\n\v\f\r") else s
    clusters = {}
    for i, m, src, at, name, email, city, nation, seg, bal in rows:
        bal = bal if bal is not None and math.isfinite(bal) else None
        clusters.setdefault(i if m is None else m, []).append({"id": i, "trust": {"partner": 4, "store": 3, "web": 2, "crm": 1}.get(src, 0), "at": at, "name": blank(name), "email": blank(email), "city": blank(city), "nation": nation, "segment": blank(seg), "balance": bal})
    out = []
    for c, rs in clusters.items():
        latest = max((r["at"] for r in rs if r["at"]), default=None)
        for r in rs:
            r["stale"] = r["at"] is None or latest - r["at"] > timedelta(days=30)
        recent = lambda r: (r["at"] is None, -(r["at"] - datetime(2000, 1, 1)).total_seconds() if r["at"] else 0, -r["trust"], r["id"] is None, r["id"])
        trusted = lambda r: (r["stale"], -r["trust"], *recent(r))
        first = lambda f, order: min((r for r in rs if r[f] is not None), key=order, default={f: None, "id": None})
        name, email, seg = first("name", lambda r: (-len(r["name"]), *trusted(r))), first("email", trusted), first("segment", recent)
        bal = first("balance", lambda r: (seg["segment"] is None or r["segment"] != seg["segment"], *recent(r)))
        home = min(rs, key=lambda r: (-(r["city"] is not None) - (r["nation"] is not None), *trusted(r)))
        cents = None if bal["balance"] is None else math.floor(100 * bal["balance"] + 0.5)
        none = home["city"] is None and home["nation"] is None
        out.append((c, len(rs), sum(r["stale"] for r in rs), name["name"], email["email"], seg["segment"], home["city"], home["nation"], cents, name["id"], email["id"], seg["id"], bal["id"], None if none else home["id"]))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/clients.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_golden(spark, str(tmp_path)).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = []
    for i in range(400):
        master = rng.choice([None, 1, 1, 1, 2, i, i, rng.randint(0, 60)])
        at = rng.choice([None, DAY, DAY - timedelta(days=30), DAY - timedelta(days=30, microseconds=1), DAY - timedelta(hours=rng.randint(0, 2000))])
        made.append((i, master, rng.choice(["partner", "store", "web", "crm", "else", None]), at, rng.choice([None, "", " \t", "Ann", "Bo é", "日本語😀", " Ann ", "Anna"]), rng.choice([None, "\n", f"{i}@x", "same@x"]), rng.choice([None, "", "Rome", "Oslo"]), rng.choice([None, 1, 2]), rng.choice([None, "a", "b", " "]), rng.choice([None, 1.005, -2.5, float("nan"), float("inf"), float(i)])))
    return made


def test_against_plain_python(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == plain(rows)


def test_clusters_with_very_many_rows_are_joined_apart(spark, tmp_path, rows, monkeypatch):
    from evenkeel.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 20)
    assert run(spark, tmp_path, rows) == plain(rows)


def test_repeated_rows_count_and_change_nothing_else(spark, tmp_path, rows):
    once = {r[0]: r for r in run(spark, tmp_path, rows)}
    twice = {r[0]: r for r in run(spark, tmp_path, rows + rows)}
    assert {k: (v[0], 2 * v[1], 2 * v[2], *v[3:]) for k, v in once.items()} == twice


def test_no_rows_no_ids_and_more_columns(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    lost = [(None, None, "web", DAY, "x" * 200_000, None, None, None, None, None), (None, None, "crm", None, None, None, None, None, None, 1.0)]
    assert run(spark, tmp_path, lost) == [(None, 2, 1, "x" * 200_000, None, None, None, None, 100, None, None, None, None, None)]
    more = [(*r, "k", 1, True) for r in [(1, 2, "web", DAY, "n", None, None, 3, None, None)]]
    assert run(spark, tmp_path, more, SCHEMA + ", key string, n int, stale boolean") == [(2, 1, 0, "n", None, None, None, 3, None, 1, None, None, None, 1)]
