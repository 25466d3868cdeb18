"""Calls outside: programs that hang, fail, answer late or print nonsense; retries, deadlines, and how many run at once."""

import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from keyloom import calls

PROGRAM = """
import json, os, sys, time
row = json.load(sys.stdin)
kind, folder = row["kind"], row["folder"]
mark = os.path.join(folder, str(row["id"]))
open(mark, "a").write("x")
n = os.path.getsize(mark)
if kind == "hang" or (kind == "late" and n == 1):
    time.sleep(30)
if kind == "fail" or (kind == "flaky" and n < 3):
    sys.exit("broken " + str(n))
if kind == "mute":
    sys.exit(0)
print("noise")
print("nonsense" if kind == "nonsense" else json.dumps({"engine_ok": kind != "refuses", "error": "no engine" if kind == "refuses" else None, "blocks": [{"text": "보습 50ml", "score": 0.9}, {"text": " "}]}, ensure_ascii=False))
"""
KINDS = ("good", "hang", "late", "fail", "flaky", "mute", "nonsense", "refuses")


def test_a_recogniser_as_a_program(spark, tmp_path):
    rows = spark.createDataFrame([(i, k, str(tmp_path)) for i, k in enumerate(KINDS)], "id int, kind string, folder string").repartition(2)
    began = time.time()
    done = calls.recognised(rows, calls.program([sys.executable, "-c", PROGRAM]), timeout=4, attempts=3, back_off=0.01)
    got = {r.kind: r for r in done.collect()}
    assert time.time() - began < 60
    ok = lambda k: (got[k].engine_ok, got[k].block_count, got[k].char_count, got[k].error, len(got[k].attempts))
    assert ok("good") == (True, 1, 7, None, 1) and got["good"].blocks[0].text == "보습 50ml"
    assert ok("late") == (True, 1, 7, None, 2) and ok("flaky") == (True, 1, 7, None, 3)
    assert got["late"].attempts[0].error.startswith("TimeoutError") and got["late"].attempts[1].error is None
    assert [a.error for a in got["fail"].attempts] == [f"RuntimeError: broken {n}" for n in (1, 2, 3)] and got["fail"].error == "RuntimeError: broken 3"
    assert not got["hang"].engine_ok and len(got["hang"].attempts) == 3 and got["hang"].runtime_ms > 9_000
    assert ok("nonsense")[:4] == (False, 0, 0, "nonsense") and ok("refuses")[:4] == (False, 0, 0, "no engine") and not got["mute"].engine_ok
    assert (tmp_path / "1").stat().st_size == 3


def test_deadlines_refusals_and_hanging_calls():
    def hang(row, seconds):
        time.sleep(20)

    began = time.time()
    answer, error, tries = calls.call_row(hang, {}, timeout=0.2, deadline=0.5, attempts=9, back_off=0.01)
    assert answer is None and 2 <= len(tries) <= 5 and time.time() - began < 3 and ("Timeout" in error or "deadline" in error)

    def refuse(row, seconds):
        raise calls.Refused("never")

    assert calls.call_row(refuse, {}, attempts=5)[1:] == ("Refused: never", [{"seconds": pytest.approx(0, abs=1), "error": "Refused: never"}])
    waits = []

    def fail(row, seconds):
        waits.append(time.monotonic())
        raise ValueError("no")

    calls.call_row(fail, {}, attempts=4, back_off=0.1)
    gaps = [b - a for a, b in zip(waits, waits[1:], strict=False)]
    assert len(waits) == 4 and all(0.045 * 2**i <= g < 0.1 * 2**i + 0.1 for i, g in enumerate(gaps))


def test_calls_at_once_are_bounded_and_in_order(spark):
    def call(row, seconds):
        with call.lock:
            call.now += 1
            call.most = max(call.most, call.now)
        time.sleep(0.02)
        with call.lock:
            call.now -= 1
        return f"{row['id']} {call.most}"

    def attached(row, seconds):
        if not hasattr(call, "lock"):
            call.lock, call.now, call.most = threading.Lock(), 0, 0
        return call(row, seconds)

    df = spark.range(200).coalesce(1)
    got = calls.with_calls(df, attached, at_once=4).collect()
    assert [r.id for r in got] == list(range(200)) and [int(r.answer.split()[0]) for r in got] == list(range(200))
    assert 1 < max(int(r.answer.split()[1]) for r in got) <= 4 and all(r.answer_error is None and len(r.answer_attempts) == 1 for r in got)
    assert calls.with_calls(df.limit(0), attached).count() == 0
    with pytest.raises(ValueError):
        calls.with_calls(df.withColumn("Answer", F.lit(1)), attached)
