"""Replay of a host's task: the child process of a Spark task answers its rows one by one.

One long-lived child serves all rows of a task; requests and answers are JSON texts of one line each. A child that exits,
is late or writes no JSON is ended, and the next row gets a new one. A failure is a row with a code and no output.
"""

from __future__ import annotations

import json
import queue
import subprocess
import tempfile
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STDERR_CHARS, SECONDS = 2000, 30.0
RESULT = "example_id string, output string, code string, cause string"


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


class Child:
    """A host's process. Its error stream goes to a file of the task, of which the first STDERR_CHARS characters are kept."""

    def __init__(self, argv: list[str], seconds: float) -> None:
        self.argv, self.seconds, self.process = argv, seconds, None

    def _start(self) -> None:
        self.errors = tempfile.TemporaryFile()
        self.process = subprocess.Popen(self.argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=self.errors)
        self.lines: queue.Queue = queue.Queue()
        threading.Thread(target=self._pump, args=(self.process.stdout, self.lines), daemon=True).start()

    @staticmethod
    def _pump(stream, lines: queue.Queue) -> None:
        for line in stream:
            lines.put(line)
        lines.put(None)

    def end(self) -> str:
        """What the child wrote to its error stream, cut."""
        if self.process is None:
            return ""
        self.process.kill()
        self.process.wait()
        self.errors.seek(0)
        said = self.errors.read(4 * STDERR_CHARS).decode("utf-8", "replace")[:STDERR_CHARS]
        self.errors.close()
        self.process = None
        return said

    def ask(self, request: dict) -> tuple[str | None, str | None, str | None]:
        """(output as JSON, code, cause)."""
        if self.process is None or self.process.poll() is not None:
            self.end()
            try:
                self._start()
            except OSError as e:
                return None, "task_spawn_failed", str(e)[:STDERR_CHARS]
        try:
            self.process.stdin.write(json.dumps(request).encode() + b"\n")
            self.process.stdin.flush()
        except OSError:  # it has exited; what it wrote before decides
            pass
        try:
            line = self.lines.get(timeout=self.seconds)
        except queue.Empty:
            self.end()
            return None, "task_timeout", f"over {self.seconds} s"
        if line is None:
            status = self.process.wait()
            said = self.end()
            return None, "task_nonzero_exit" if status else "task_malformed_output", said or f"exited with {status}"
        try:
            got = json.loads(line, parse_constant=_refuse)
        except ValueError as e:
            self.end()  # its next lines cannot be told from the answer's rest
            return None, "task_malformed_output", str(e)[:STDERR_CHARS]
        if not isinstance(got, dict) or "output" not in got:
            return None, "task_missing_output", None
        return json.dumps(got["output"], sort_keys=True), None, None


def _replay(batches: Iterator[pa.RecordBatch], argv: list[str], seconds: float) -> Iterator[pa.RecordBatch]:
    child = Child(argv, seconds)
    try:
        for b in batches:
            rows = []
            for ident, permitted, given in zip(*[c.to_pylist() for c in b.columns]):
                got = child.ask({"example_id": ident, "input": None if given is None else json.loads(given)}) if permitted else (None, "task_egress_forbidden", None)
                rows.append((ident, *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["example_id", "output", "code", "cause"])
    finally:
        child.end()


def replayed(effects: DataFrame, argv: list[str], seconds: float = SECONDS, tasks: int | None = None) -> DataFrame:
    """effects: example_id, permitted, input (JSON text). RESULT for each: the host's output as JSON, or a code. Data that may
    not leave is not sent. tasks bounds the children that run at once."""
    own = effects.select(F.col("example_id").cast("string").alias("example_id"), F.coalesce("permitted", F.lit(False)).alias("permitted"), F.col("input").cast("string").alias("input"))
    if tasks:
        own = own.repartition(tasks)
    return own.mapInArrow(lambda it: _replay(it, argv, seconds), RESULT)
