"""Sources of a provider with pages and look-ups: the caller's functions fetch, what they give is landed as JSON and read by ``works``.

``fetch(cursor)`` gives (results, next cursor or None); ``look_up(keys)`` gives results. Both raise ``HttpError`` with a status for
an answer that may be repeated, any other ``OSError`` for a lost connection.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between repeated requests, keys of a request, attempts, seconds per attempt after too many requests and after other errors.
WAIT, BATCH, ATTEMPTS, BUSY, FAILED = 10.0, 50, 3, 5.0, 2.0


class HttpError(OSError):
    """An answer of the provider that is an error."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def pages(fetch: Callable[[str], tuple[list[dict], str | None]], cursor: str | None = "*", wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """The pages from ``cursor`` on. An error of the provider is waited for and asked again; a lost connection ends the pages."""
    while cursor:
        try:
            results, following = fetch(cursor)
        except HttpError:
            sleep(wait)
            continue
        except OSError:
            return
        yield results
        cursor = following if results else None


def land(spark: SparkSession, found: Iterator[list[dict]], path: str, most: int | None = None) -> int:
    """Writes pages as they come, a file each, and says how many records there were; ``most`` is a limit of the request."""
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    total = 0
    for number, results in enumerate(found):
        kept = results if most is None else results[: most - total]
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/page-{number:06}.json"), True)
        out.write(bytearray(json.dumps({"results": kept}), "utf-8"))
        out.close()
        total += len(kept)
        if most is not None and total >= most:
            break
    return total


def patiently(look_up: Callable[[list[str]], list[dict]], keys: list[str], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The results for some keys; after the last failed attempt none. Waits longer after each attempt, longest after too many requests."""
    for n in range(1, attempts + 1):
        try:
            return look_up(keys)
        except OSError as error:
            if n < attempts:
                sleep((BUSY if getattr(error, "status", 0) == 429 else FAILED) * n)
    return []


def looked_up(keys: DataFrame, column: str, look_up: Callable[[list[str]], list[dict]], done: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """(results): one JSON text per record found for the different keys that ``done`` doesn't hold. Each task asks for its own keys, ``batch`` at a time."""
    own = keys.select(F.col(column).alias("key")).filter("key is not null").distinct()
    if done is not None:
        own = own.join(done.select(F.col(column).alias("key")), "key", "left_anti")

    def ask(batches):
        import pyarrow as pa

        waiting: list[str] = []
        for b in batches:
            waiting += b.column(0).to_pylist()
            while len(waiting) >= batch:
                asked, waiting = waiting[:batch], waiting[batch:]
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in patiently(look_up, asked)], pa.string())], ["result"])
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in patiently(look_up, waiting)], pa.string())], ["result"])

    return own.mapInArrow(ask, "result string")
