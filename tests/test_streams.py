"""Stateful streams over several micro-batches."""

import json
import os
import time

from pyspark.sql import functions as F

from fieldscope.streaming import live, stateful


def _drop(folder, name, lines, at):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (at, at))


def _line(run, n, text):
    return f"{run}\t{n}\tTHREADID\t1\t{text}"


def _state_rows(checkpoint_query):
    return sum(op["numRowsTotal"] for op in json.loads(checkpoint_query.lastProgress.json)["stateOperators"])


def _run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_taint_mark_and_lines_in_different_batches(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    os.mkdir(src)
    start = time.time() - 100_000
    _drop(src, "a", [_line("r1", 1, "BasicBlock\tb\tsize=1"), _line("r1", 2, "Taint\tx\t1"), _line("r2", 5, "BasicBlock\tb\tsize=1"), _line("r3", 1, "BasicBlock\tb\tsize=1")], start)
    _drop(src, "b", [_line("r1", 4, "BasicBlock\tb\tsize=1"), _line("r1", 3, "BasicBlock\tb\tsize=1"), _line("r2", 9, "Taint\tx\t1"), _line("r2", 11, "BasicBlock\tb\tsize=1")], start + 1)
    _drop(src, "c", [_line("r2", 3, "Taint\tx\t1"), _line("r2", 2, "BasicBlock\tb\tsize=1")], start + 2)
    lines = lambda: stateful.stream_after_taint(live.stream_trace(spark, src, 1), "1 second", 1000, ("run_id", "line_no", "kind"))
    _run(lines(), out, mark)
    got = sorted((r.run_id, r.line_no) for r in spark.read.parquet(out).collect())
    assert got == [("r1", 3), ("r1", 4), ("r2", 5), ("r2", 9), ("r2", 11)]
    # Much later files move the watermark: the state of all finished runs goes.
    for i in range(3):
        _drop(src, f"later{i}", [_line(f"z{i}", 1, "Taint\tx\t1")], start + 50_000 + 10_000 * i)
    q = _run(lines(), out, mark)
    assert _state_rows(q) <= 4  # at most the newest run's value, line and timer
    assert len(spark.read.parquet(out).collect()) == len(got)


def test_early_stop_over_batches_and_state_that_goes(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "k long, i long, a double, b double, at timestamp"

    def add(rows, at):
        spark.createDataFrame(rows, "k long, i long, a double, b double").withColumn("at", F.timestamp_seconds(F.lit(at))).coalesce(1).write.mode("append").parquet(src)

    add([(1, 2, 0.5, None), (1, 1, 0.5, 0.0), (2, 1, 0.1, 0.2), (None, 1, 0.0, 0.0)], 1000)
    add([(1, 3, 0.5, 0.0), (1, 4, 9.0, 9.0), (2, 2, 0.9, 0.2), (2, 3, 0.4, 0.7)], 1001)
    add([(1, 5, 0.5, 0.0), (2, 4, 0.9, 0.2)], 1002)
    stream = lambda: stateful.stream_early_stop(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "k", "i", ["a", "b"], 3, 1e-6, "at", "1 second", 1000)
    _run(stream(), out, mark)
    assert [(r.k, r.stop_at) for r in spark.read.parquet(out).collect()] == [(1, 3)]
    for i in range(3):
        add([(9 + i, 1, 0.0, 0.0)], 90_000 + 10_000 * i)
    assert _state_rows(_run(stream(), out, mark)) <= 3
    assert [(r.k, r.stop_at) for r in spark.read.parquet(out).collect()] == [(1, 3)]
