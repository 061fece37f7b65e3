"""Run records: summaries as JSON files of the driver, written so that a crash leaves none half done; scores as Parquet.

A record is whole when its marker, written last, is the digest of its manifest, and the manifest's digests are those of
its files. Names of runs become safe file names, and nothing is written outside the root."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

RECORD, SUMMARY, MANIFEST, MARKER, SCORES = "runrecord.json", "scorecard.json", "manifest.json", "COMPLETE", "scores.parquet"


class SetupError(Exception):
    """A fault of the set-up: it ends the run without a verdict."""


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def safe_name(run_id: str) -> str:
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", run_id)
    if name.strip("._") == "":
        raise SetupError(f"run id {run_id!r} names no folder")
    return name


def inside(root: str | Path, *parts: str) -> Path:
    """A path below root; neither .. nor a symbolic link may lead out of it."""
    base = Path(root).resolve()
    path = base.joinpath(*parts)
    if ".." in Path(*parts).parts or base not in (path.resolve(), *path.resolve().parents):
        raise SetupError(f"{path} is outside {base}")
    for p in (path, *path.parents):
        if p == base:
            break
        if p.is_symlink():
            raise SetupError(f"{p} is a symbolic link")
    return path


def write_text(path: Path, text: str) -> None:
    """Written whole or not at all, readable by its owner alone."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def pretty(value: Any) -> str:
    return json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"


def persist(root: str | Path, run_id: str, record: dict, summary: dict, scores: DataFrame | None = None) -> Path:
    """The record's folder. Scores are written by Spark before the marker; a folder that is complete is never overwritten."""
    folder = inside(root, safe_name(run_id))
    if (folder / MARKER).exists():
        raise SetupError(f"{folder} holds a complete run")
    files = {RECORD: pretty(record), SUMMARY: pretty(summary)}
    for name, text in files.items():
        write_text(folder / name, text)
    if scores is not None:
        scores.write.mode("overwrite").partitionBy("metric").parquet((folder / SCORES).as_uri())
    manifest = pretty({"files": {name: digest(text) for name, text in files.items()}})
    write_text(folder / MANIFEST, manifest)
    write_text(folder / MARKER, digest(manifest) + "\n")
    return folder


def verified(folder: str | Path) -> str | None:
    """NULL for a whole record, else what is wrong with it."""
    folder = Path(folder)
    try:
        manifest = (folder / MANIFEST).read_text(encoding="utf-8")
        if (folder / MARKER).read_text(encoding="utf-8").strip() != digest(manifest):
            return "marker"
        files = json.loads(manifest)["files"]
        if not {RECORD, SUMMARY} <= set(files):
            return "manifest"
        for name, want in files.items():
            if digest(inside(folder, name).read_text(encoding="utf-8")) != want:
                return name
    except (OSError, ValueError, KeyError, TypeError, SetupError):
        return "incomplete"
    return None


def verified_many(spark: SparkSession, root: str) -> DataFrame:
    """(run, ok) of all records below root, read and hashed by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.json,COMPLETE}").option("recursiveFileLookup", "true").load(root)
    f = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("text")).filter(F.col("name").isin(RECORD, SUMMARY, MANIFEST, MARKER))
    one = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    g = f.groupBy("run").agg(one(MARKER, "text").alias("mark"), one(MANIFEST, "sha").alias("manifest_sha"), one(MANIFEST, "text").alias("manifest"), *[one(n, "sha").alias(f"s{i}") for i, n in enumerate((RECORD, SUMMARY))])
    want = F.from_json(F.get_json_object("manifest", "$.files"), "map<string,string>")
    ok = (F.trim(F.translate("mark", "\n\r", "  ")) == F.col("manifest_sha")) & (want[RECORD] == F.col("s0")) & (want[SUMMARY] == F.col("s1"))
    return g.select("run", F.coalesce(ok, F.lit(False)).alias("ok"))


def load(folder: str | Path) -> dict:
    """The record of a whole folder, as a baseline."""
    wrong = verified(folder)
    if wrong:
        raise SetupError(f"baseline at {folder}: {wrong}")
    return json.loads((Path(folder) / RECORD).read_text(encoding="utf-8"))


def promote(folder: str | Path, root: str | Path, name: str = "baseline") -> Path:
    """A whole record becomes the baseline: copied beside the old one, then put in its place."""
    if wrong := verified(folder):
        raise SetupError(f"{folder} can't be promoted: {wrong}")
    target = inside(root, safe_name(name))
    part = target.with_name(f".{target.name}.part")
    shutil.rmtree(part, ignore_errors=True)
    shutil.copytree(folder, part)
    shutil.rmtree(target, ignore_errors=True)
    os.replace(part, target)
    return target


def sidecar(root: str | Path, name: str, value: Any) -> Path:
    """Drift, findings or a run plan beside a run: after the verdict, and of no weight for it."""
    path = inside(root, name)
    write_text(path, pretty(value))
    return path


def redacted_url(url: str) -> str:
    """Without user, password, query and fragment."""
    return re.sub(r"^([a-z][a-z0-9+.-]*://)(?:[^/@]*@)?([^/?#]*)([^?#]*).*$", r"\1\2\3", url, flags=re.I)


def post(policy: str, url: str, value: Any, send) -> dict:
    """A hosted sink: nothing is sent unless the policy lets data out; a fault is a diagnostic, its address redacted."""
    if policy not in ("permitted", "redacted"):
        return {"status": "blocked", "code": "lane_export_failed", "endpoint": redacted_url(url)}
    try:
        send(url, canonical(value))
    except Exception as e:  # a sink's fault never changes the verdict
        return {"status": "blocked", "code": "lane_export_failed", "endpoint": redacted_url(url), "cause": type(e).__name__}
    return {"status": "ran", "endpoint": redacted_url(url)}
