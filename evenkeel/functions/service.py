"""Calls to services that answer slowly: many in flight at once in every task, each with a time limit and retries."""

from __future__ import annotations

import asyncio
import threading
from collections import deque
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.session import ship

#: An answer to a prompt.
Call = Callable[[str | None], Awaitable[str | None]]

OUTCOME = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType()), T.StructField("calls", T.IntegerType())])


def threaded(call: Callable[[str | None], str | None], threads: int = 32) -> Call:
    """A call that blocks, as one that can be waited for.  What runs over its time is left behind in its thread."""
    pool = ThreadPoolExecutor(threads)

    async def one(prompt: str | None) -> str | None:
        return await asyncio.get_running_loop().run_in_executor(pool, call, prompt)

    return one


async def _answer(call: Call, prompt: str | None, seconds: float, retries: int, pause: float, final: tuple[type[Exception], ...]) -> tuple:
    """ok, value, error and the number of calls; a failure of any kind stays with its row."""
    for k in range(retries + 1):
        try:
            async with asyncio.timeout(seconds):
                return True, await call(prompt), None, k + 1
        except Exception as e:  # a service may fail in any way
            said = f"TimeoutError: more than {seconds:g} s" if isinstance(e, TimeoutError) else f"{type(e).__name__}: {e}"
            if k == retries or isinstance(e, final):
                return False, None, said, k + 1
        await asyncio.sleep(pause * 2**k)
    raise AssertionError


def fan_out(
    df: DataFrame, prompt: str, make: Callable[[], Call], name: str = "answer", in_flight: int = 300, seconds: float = 60.0, retries: int = 3, pause: float = 0.5,
    final: tuple[type[Exception], ...] = (ValueError,), every: int = 50, tasks: int | None = None, held: int = 20_000, held_bytes: int = 64 << 20,
) -> DataFrame:
    """Adds struct<ok, value, error, calls> from a service, in the rows' order.

    make() is called once per task.  Every task has at most `in_flight` calls under way; `tasks` deals the rows to so many
    tasks, and so bounds the calls of all of them.  A call that takes more than `seconds` is cancelled; one that fails is
    repeated up to `retries` times after `pause` seconds, twice as long each time, unless its error is one of `final`.
    Rows are handed on `every` so many, so that what is written grows while calls go on.  Rows behind one that is still
    waited for are kept, `held` rows or `held_bytes` in a task, so that a slow call keeps no others from being made.
    Null prompts are passed to the service as None.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, OUTCOME)])
    arrow, at = to_arrow_schema(schema), df.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The loop has a thread of its own, so that calls go on while Spark takes what was handed on.
        loop, free = asyncio.new_event_loop(), threading.BoundedSemaphore(in_flight)
        thread = threading.Thread(target=loop.run_forever, daemon=True)
        thread.start()
        call = asyncio.run_coroutine_threadsafe(_made(make), loop).result()
        waiting: deque[tuple[pa.RecordBatch, list[Future]]] = deque()
        # Each is changed by one thread only: bytes of all answers so far by the loop's, those of rows and answers handed on.
        answered, rows_in, bytes_in, bytes_out = [0], 0, 0, 0

        async def answer(p: str | None) -> tuple:
            made = await _answer(call, p, seconds, retries, pause, final)
            answered[0] += size(made)
            return made

        def size(made: tuple) -> int:
            return sum(len(x) for x in made[1:3] if isinstance(x, str))

        def asked(p: str | None) -> Future:
            free.acquire()
            future = asyncio.run_coroutine_threadsafe(answer(p), loop)
            future.add_done_callback(lambda _: free.release())
            return future

        def told(part: pa.RecordBatch, futures: list[Future]) -> pa.RecordBatch:
            nonlocal rows_in, bytes_out
            each = [f.result() for f in futures]
            rows_in -= part.num_rows
            bytes_out += part.nbytes + sum(map(size, each))
            rows = [dict(zip(OUTCOME.names, m, strict=True)) for m in each]
            made = pa.array(rows, arrow.field(len(arrow) - 1).type)
            return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)), made], schema=arrow)

        def full() -> bool:
            return rows_in > held or bytes_in + answered[0] - bytes_out > held_bytes

        try:
            for b in batches:
                for i in range(0, b.num_rows, every):
                    part = b.slice(i, every)
                    futures: list[Future] = []
                    waiting.append((part, futures))
                    rows_in, bytes_in = rows_in + part.num_rows, bytes_in + part.nbytes
                    futures.extend(asked(p) for p in part.column(at).to_pylist())
                    while waiting and (full() or all(f.done() for f in waiting[0][1])):
                        yield told(*waiting.popleft())
            while waiting:
                yield told(*waiting.popleft())
        finally:
            for _, futures in waiting:
                for f in futures:
                    f.cancel()
            loop.call_soon_threadsafe(loop.stop)
            thread.join()
            loop.close()

    return (df if tasks is None else df.repartition(tasks)).mapInArrow(run, schema)


async def _made(make: Callable[[], Call]) -> Call:
    return make()
