"""Calls to what lies outside (language models, recognisers, browsers) for the rows of a table: a few at once, with deadlines, retries and a record of every attempt."""

from __future__ import annotations

import json
import os
import queue
import random
import signal
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from keyloom.workers import ready

#: Calls of a task at once; seconds that an attempt and all attempts of a row may take; attempts; seconds before the second one, doubled for each further.
AT_ONCE, TIMEOUT, DEADLINE, ATTEMPTS, BACK_OFF = 8, 60.0, 300.0, 3, 0.5
#: An attempt's seconds and its error (null for the one that answered).
ATTEMPT = StructType([StructField("seconds", DoubleType()), StructField("error", StringType())])
#: Rows that a task holds at once.
HELD = 64

#: From a row and the seconds it has to the answer; raises if there is none.
Call = Callable[[dict, float], str | None]


class Refused(Exception):
    """An answer that will not change: the call is not made again."""


def _in_time(call: Call, row: dict, seconds: float) -> str | None:
    """The call's answer if it comes in time. A call that hangs is left behind in a thread that doesn't keep its process alive."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((call(row, seconds), None))
        except Exception as error:  # noqa: BLE001 - handed to the caller
            box.put((None, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        answer, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error
    return answer


def call_row(call: Call, row: dict, timeout: float = TIMEOUT, deadline: float = DEADLINE, attempts: int = ATTEMPTS, back_off: float = BACK_OFF) -> tuple[str | None, str | None, list[dict]]:
    """Answer, last error and all attempts of a row. An answer after its time counts as none."""
    began, record, error = time.monotonic(), [], None
    for n in range(attempts):
        left = deadline - (time.monotonic() - began)
        if left <= 0:
            record.append({"seconds": 0.0, "error": "deadline passed"})
            error = "deadline passed"
            break
        start = time.monotonic()
        try:
            answer = _in_time(call, row, min(timeout, left))
        except Exception as e:  # noqa: BLE001 - an outside service: the row stays, with the error
            error = f"{type(e).__name__}: {e}"
            record.append({"seconds": time.monotonic() - start, "error": error})
            if isinstance(e, Refused):
                break
            pause = back_off * 2**n * random.uniform(0.5, 1.0)  # spread, so that callers don't come back together
            if n + 1 < attempts:
                time.sleep(max(0.0, min(pause, deadline - (time.monotonic() - began))))
            continue
        record.append({"seconds": time.monotonic() - start, "error": None})
        return answer, None, record
    return None, error, record


def with_calls(df: DataFrame, call: Call, out_col: str = "answer", at_once: int = AT_ONCE, timeout: float = TIMEOUT, deadline: float = DEADLINE, attempts: int = ATTEMPTS, back_off: float = BACK_OFF) -> DataFrame:
    """Append the answer, its error and its attempts (``out_col``, and with ``_error`` and ``_attempts``). Rows come out in the order in which they came.

    A task makes ``at_once`` calls at a time and holds a bounded number of rows; the number of tasks bounds the load on the service.
    """
    names = (out_col, out_col + "_error", out_col + "_attempts")
    taken = {c.lower() for c in df.columns}
    if any(n.lower() in taken for n in names):
        raise ValueError(f"{names} must not be columns already")
    schema = StructType([*df.schema.fields, StructField(names[0], StringType()), StructField(names[1], StringType()), StructField(names[2], ArrayType(ATTEMPT))])
    kinds = (pa.string(), pa.string(), pa.list_(pa.struct([("seconds", pa.float64()), ("error", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for whole in batches:
                for i in range(0, whole.num_rows, HELD):
                    b = whole.slice(i, HELD)
                    made = list(pool.map(lambda row: call_row(call, row, timeout, deadline, attempts, back_off), b.to_pylist()))
                    yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([m[j] for m in made], k) for j, k in enumerate(kinds)]], names=schema.names)

    return ready(df).mapInArrow(run, schema)


def decoded(stream: bytes | None) -> str:
    """What a program wrote, in one of the character sets that it may use."""
    for name in ("utf-8", "cp949"):
        try:
            return (stream or b"").decode(name).strip()
        except UnicodeDecodeError:
            continue
    return (stream or b"").decode("utf-8", "replace").strip()


def program(command: list[str], environment: dict[str, str] | None = None) -> Call:
    """A call that starts a program, writes it the row as JSON, and takes the last line it prints. The program and all that it started end with its time."""

    def call(row: dict, seconds: float) -> str:
        own = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True, env={**os.environ, "PYTHONIOENCODING": "utf-8", **(environment or {})})
        try:
            out, err = own.communicate(json.dumps(row, ensure_ascii=False, default=str).encode(), timeout=max(0.05, seconds - 0.2))
        except subprocess.TimeoutExpired:
            os.killpg(own.pid, signal.SIGKILL)
            own.communicate()
            raise TimeoutError(f"ended after {seconds:g} s") from None
        if own.returncode:
            raise RuntimeError(decoded(err)[-500:] or f"exit code {own.returncode}")
        lines = decoded(out).splitlines()
        if not lines:
            raise RuntimeError(decoded(err)[-500:] or "nothing printed")
        return lines[-1]

    return call


#: What a recogniser prints.
RECOGNISED = "engine_ok boolean, engine_used string, error string, tile_count int, runtime_ms long, blocks array<struct<text: string, score: double, tile_index: int>>"


def recognised(images: DataFrame, call: Call, **limits: float) -> DataFrame:
    """Images (one row a pass) with what a recogniser says of them: the fields of RECOGNISED, block and code point counts, and the attempts.

    A recogniser that fails, hangs or prints what is no JSON gives a row with ``engine_ok`` false, no blocks and the error.
    """
    asked = with_calls(images, call, "said", **limits)
    said = F.from_json("said", RECOGNISED)
    none = F.array().cast("array<struct<text: string, score: double, tile_index: int>>")
    out = asked.withColumn("r_", said).withColumn("blocks", F.filter(F.coalesce("r_.blocks", none), lambda b: F.coalesce(F.trim(b["text"]), F.lit("")) != ""))
    known = F.coalesce("r_.engine_ok", F.lit(False))
    error = F.coalesce("said_error", F.nullif("r_.error", F.lit("")), F.when(~known, F.substring(F.coalesce("said", F.lit("no answer")), 1, 500)))
    seconds = F.aggregate("said_attempts", F.lit(0.0), lambda a, x: a + x["seconds"])
    text = F.trim(F.array_join(F.transform("blocks", lambda b: b["text"]), " "))
    return out.select(
        *images.columns,
        known.alias("engine_ok"),
        F.col("r_.engine_used").alias("engine_used"),
        F.when(known, F.lit(None).cast("string")).otherwise(error).alias("error"),
        F.coalesce("r_.tile_count", F.lit(1)).alias("tile_count"),
        F.coalesce("r_.runtime_ms", F.round(seconds * 1000).cast("long")).alias("runtime_ms"),
        F.when(known, F.col("blocks")).otherwise(none).alias("blocks"),
        F.when(known, F.size("blocks")).otherwise(0).alias("block_count"),
        F.when(known, F.length(text)).otherwise(0).alias("char_count"),
        F.col("said_attempts").alias("attempts"),
    )
