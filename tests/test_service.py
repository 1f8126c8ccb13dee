"""Calls in flight: their bound, order, retries, limits and errors."""

import asyncio
import time

import pytest

from evenkeel.functions import service


def asked(spark, n, parts=1):
    return spark.range(n).selectExpr("id", "concat('p', id) AS p", "id AS answers").repartition(parts).sortWithinPartitions("id")


def test_order_bound_and_speed(spark):
    def make():
        now = [0]

        async def call(p):
            now[0] += 1
            seen = now[0]
            await asyncio.sleep(0.01 * (int(p[1:]) % 7))
            now[0] -= 1
            return str(seen)

        return call

    df = asked(spark, 400)
    t = time.time()
    rows = service.fan_out(df, "p", make, in_flight=40, every=7).collect()
    took = time.time() - t
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and len(rows) == 400
    most = max(int(r["answer"]["value"]) for r in rows)
    assert 10 < most <= 40
    assert took < 400 * 0.03  # one after another


def test_retries_limits_and_errors_stay_with_their_rows(spark):
    def make():
        met = {}

        async def call(p):
            met[p] = met.get(p, 0) + 1
            if p == "p1":
                raise ValueError("bad")
            if p == "p2" and met[p] < 3:
                raise ConnectionError("again")
            if p == "p3":
                await asyncio.sleep(60)
            if p == "p4":
                raise OSError(f"never {met[p]}")
            return None if p is None else p.upper()

        return call

    got = {r["p"]: tuple(r["answer"]) for r in service.fan_out(asked(spark, 6).union(spark.sql("SELECT 9L, CAST(NULL AS STRING), 9L")), "p", make, seconds=0.3, retries=2, pause=0.01).collect()}
    assert got == {
        "p0": (True, "P0", None, 1), "p1": (False, None, "ValueError: bad", 1), "p2": (True, "P2", None, 3), "p3": (False, None, "TimeoutError: more than 0.3 s", 3), "p4": (False, None, "OSError: never 3", 3),
        "p5": (True, "P5", None, 1), None: (True, None, None, 1),
    }


def test_calls_that_block_run_in_threads(spark):
    def make():
        def call(p):
            time.sleep(0.05)
            return p[::-1]

        return service.threaded(call, 20)

    t = time.time()
    rows = service.fan_out(asked(spark, 100, 2), "p", make, in_flight=20, tasks=2).collect()
    assert {r["answer"]["value"] for r in rows} == {f"p{i}"[::-1] for i in range(100)} and time.time() - t < 100 * 0.05


@pytest.mark.parametrize("n", [0, 1, 50, 51])
def test_all_rows_come_out(spark, n):
    async def call(p):
        return p

    rows = service.fan_out(asked(spark, n, 3), "p", lambda: call, every=50).collect()
    assert sorted(r["p"] for r in rows) == sorted(r["answer"]["value"] for r in rows) and len(rows) == n


def test_a_broken_service_fails_the_task(spark):
    def make():
        raise RuntimeError("no credentials")

    with pytest.raises(Exception, match="no credentials"):
        service.fan_out(asked(spark, 3), "p", make).collect()


def slow_now_and_then():
    """Of forty calls one is slow; answers tell how many slow ones are under way."""

    def make():
        now = [0]

        async def call(p):
            slow = int(p[1:]) % 40 == 0
            now[0] += slow
            seen = now[0]
            await asyncio.sleep(0.6 if slow else 0)
            now[0] -= slow
            return str(seen)

        return call

    return make


def test_a_slow_call_keeps_no_others_from_being_made(spark):
    rows = service.fan_out(asked(spark, 800), "p", slow_now_and_then(), in_flight=10, every=5).collect()
    assert [r["id"] for r in rows] == list(range(800))
    assert max(int(r["answer"]["value"]) for r in rows) >= 6


@pytest.mark.parametrize("limit", ["held", "held_bytes"])
def test_what_is_held_behind_a_slow_call_is_bounded(spark, limit):
    rows = service.fan_out(asked(spark, 200), "p", slow_now_and_then(), in_flight=10, every=5, **{limit: 50}).collect()
    assert [r["id"] for r in rows] == list(range(200))
    assert max(int(r["answer"]["value"]) for r in rows) <= 3
