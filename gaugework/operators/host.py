"""A host's own evaluators, run on Arrow batches where the examples are, and kept apart from scores when they fail.

An evaluator is a function from a batch (pyarrow.RecordBatch of the columns it names) to a mapping of its declared
outputs to arrays of numbers, NULL for rows it cannot evaluate. Whatever else happens - an exception, another type,
another length, an output that was not declared, a value outside the range or no finite number - is a fault: a row of
its own without a value, which `checked` turns into the end of the run. A fault is never a score.
"""

from __future__ import annotations

import hashlib
import math
import types
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugework.sinks.records import SetupError

Batch = Callable[[pa.RecordBatch], Mapping[str, Iterable]]
CAUSE_CHARS = 200
SCORES = "example_id string, metric string, value double, status string, validity string, code string, evaluator string, fault string"


@dataclass(frozen=True)
class Evaluator:
    """reads: columns of the examples; outputs: metrics; low and high bound every value. source: text of the host's file
    that defines function, for evaluators that executors cannot import; it is executed where it runs."""

    name: str
    version: str
    reads: tuple[str, ...]
    outputs: tuple[str, ...]
    evaluate: Batch | None = None
    low: float = -math.inf
    high: float = math.inf
    source: str | None = None
    function: str | None = None

    @property
    def ref(self) -> str:
        return f"{self.name}@{self.version}"

    def loaded(self) -> Batch:
        return self.evaluate if self.source is None else getattr(_module(self.source, self.name), self.function)


def by_row(fn: Callable[..., float | None], output: str) -> Batch:
    """A batch function from one of a row's values; the slow path, for evaluators that have no batch form."""
    return lambda batch: {output: [fn(*row.values()) for row in batch.to_pylist()]}


def _module(source: str, name: str) -> types.ModuleType:
    module = types.ModuleType(f"host_{name}")
    exec(compile(source, f"<{name}>", "exec"), module.__dict__)  # noqa: S102 - the host's own code, as a file of it
    return module


@dataclass
class Registry:
    known: dict[str, Evaluator] = field(default_factory=dict)

    def add(self, evaluator: Evaluator) -> None:
        if evaluator.ref in self.known:
            raise SetupError(f"evaluator_duplicate: {evaluator.ref}")
        self.known[evaluator.ref] = evaluator

    def resolve(self, ref: str) -> Evaluator:
        """By name@version: another version is never used in its place. A name alone must have one version."""
        name, _, version = ref.partition("@")
        have = [e for e in self.known.values() if e.name == name]
        if not have:
            raise SetupError(f"evaluator_unknown: {ref}; known are {sorted(self.known)}")
        found = [e for e in have if e.version == version] if version else have
        if len(found) != 1:
            raise SetupError(f"evaluator_version: {ref}; known are {sorted(e.ref for e in have)}")
        return found[0]

    def load(self, ref: str, root: str | Path, reads: tuple[str, ...], outputs: tuple[str, ...], **bounds: float) -> Evaluator:
        """The function of path.py:function below root. Its version is the digest of the file, so that provenance names what
        ran; a file that is missing, cannot be run or lacks the function ends the set-up."""
        path, _, function = ref.rpartition(":")
        file = Path(root) / path
        if not path or not file.is_file():
            raise SetupError(f"evaluator_file_not_found: {ref}")
        source = file.read_text(encoding="utf-8")
        try:
            found = getattr(_module(source, file.stem), function, None)
        except Exception as e:  # a host's file may raise anything
            raise SetupError(f"evaluator_import_failed: {ref}: {type(e).__name__}: {str(e)[:CAUSE_CHARS]}") from e
        if found is None:
            raise SetupError(f"evaluator_attr_missing: {ref}")
        if not callable(found):
            raise SetupError(f"evaluator_not_callable: {ref}")
        made = Evaluator(file.stem, hashlib.sha256(source.encode()).hexdigest()[:16], reads, outputs, None, source=source, function=function, **bounds)
        self.add(made)
        return made


def _values(evaluator: Evaluator, batch: pa.RecordBatch, run: Batch) -> tuple[dict[str, list], str | None]:
    """(values by output, fault)."""
    try:
        got = run(batch)
    except Exception as e:  # a host's fault is no score
        return {}, f"evaluator_crashed: {type(e).__name__}: {e}"[:CAUSE_CHARS]
    if not isinstance(got, Mapping):
        return {}, f"evaluator_bad_return: {type(got).__name__}"
    if set(got) != set(evaluator.outputs):
        return {}, f"evaluator_undeclared: {sorted(map(str, got))}"[:CAUSE_CHARS]
    out = {}
    for name, values in got.items():
        try:
            values = list(values.to_pylist() if isinstance(values, pa.Array | pa.ChunkedArray) else values)
        except TypeError:
            return {}, f"evaluator_bad_return: {name} is {type(values).__name__}"
        if len(values) != batch.num_rows:
            return {}, f"evaluator_bad_return: {name} has {len(values)} values for {batch.num_rows} rows"
        for v in values:
            if v is not None and (isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v)):
                return {}, f"evaluator_bad_return: {name} has {type(v).__name__} {v!r}"[:CAUSE_CHARS]
            if v is not None and not evaluator.low <= v <= evaluator.high:
                return {}, f"evaluator_contract: {name} has {v} outside [{evaluator.low}, {evaluator.high}]"
        out[name] = [None if v is None else float(v) for v in values]
    return out, None


_TYPES = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())


def _run(batches: Iterator[pa.RecordBatch], evaluators: list[Evaluator]) -> Iterator[pa.RecordBatch]:
    runs: list[tuple[Evaluator, Batch | None, str | None]] = []
    for e in evaluators:
        try:
            runs.append((e, e.loaded(), None))
        except Exception as x:  # the file ran where it was registered and does not here
            runs.append((e, None, f"evaluator_import_failed: {type(x).__name__}: {x}"[:CAUSE_CHARS]))
    for batch in batches:
        ids = batch.column(0)
        for e, run, broken in runs:
            read = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in e.reads], names=list(e.reads))
            values, fault = ({}, broken) if run is None else _values(e, read, run)
            if fault is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((ids[0].as_py(), None, None, "error", "invalid", fault.partition(":")[0], e.ref, fault), _TYPES)], names=_NAMES)
            for metric, found in values.items():
                absent = [v is None for v in found]
                cols = (ids.to_pylist(), [metric] * len(found), found, ["non_evaluable" if a else "scored" for a in absent], ["not_measured" if a else "valid" for a in absent], [f"{e.name}.not_evaluable" if a else None for a in absent], [e.ref] * len(found), [None] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


_NAMES = [c.split()[0] for c in SCORES.split(", ")]


def evaluated(examples: DataFrame, registry: Registry, refs: list[str], key: str = "example_id") -> DataFrame:
    """Scores of every example by every output of the evaluators, and a row with a fault for each batch that an evaluator
    failed on. One pass without a shuffle; only columns that some evaluator reads go to Python."""
    found = [registry.resolve(r) for r in refs]
    clash = [m for m in (o for e in found for o in e.outputs)]
    if len(set(clash)) != len(clash):
        raise SetupError(f"evaluator_outputs_clash: {sorted(m for m in set(clash) if clash.count(m) > 1)}")
    reads = sorted({c for e in found for c in e.reads})
    missing = [c for c in reads if c not in examples.columns]
    if missing:
        raise SetupError(f"evaluator_column_missing: {missing}")
    own = examples.select(F.col(key).cast("string").alias("__key"), *reads)
    return own.mapInArrow(lambda it: _run(it, found), SCORES)


def faults(scores: DataFrame) -> DataFrame:
    """(evaluator, code, batches, message): why a run has to end, once for each evaluator and code."""
    return scores.filter("fault IS NOT NULL").groupBy("evaluator", "code").agg(F.count("*").alias("batches"), F.min("fault").alias("message"))


def checked(scores: DataFrame) -> DataFrame:
    """The scores; an action on them fails at a fault, so no summary of part of them can be made."""
    fine = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("setup error: "), "evaluator", F.lit(": "), "fault")).cast("string")).otherwise(F.col("status"))
    return scores.withColumn("status", fine).drop("fault")
