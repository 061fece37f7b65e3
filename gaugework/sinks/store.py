"""Score tables that are committed whole and can be verified: `df.write.format("score_store").save(folder)`.

Each task writes a Parquet file under a name of its own attempt, and hands over its digest. The commit on the driver
writes the manifest - files, rows, digests, and the root of a Merkle tree over them, which is one digest for the table -
and last the marker, the manifest's digest. A table without a marker does not exist; files that the manifest does not
name, of lost or repeated tasks, are no part of it; a failed job's files are deleted. Digests are
checked by Spark where the files are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gaugework.sinks.records import SetupError

MANIFEST, MARKER = "_manifest.json", "_COMPLETE"


#: Bytes from which a task begins another file: Spark reads a file to be hashed as one value, of 2 GB at most.
FILE_BYTES = 256_000_000


@dataclass
class _Written(WriterCommitMessage):
    """(name, sha256, rows) of a task's files."""

    files: list[tuple[str, str, int]]


def merkle(leaves: list[str]) -> str:
    """The root over hexadecimal digests in order: pairs are hashed together, a last one without a partner goes up as it is."""
    level = leaves or [hashlib.sha256(b"").hexdigest()]
    while len(level) > 1:
        up = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0]


def _fs(folder: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class _Hashed:
    """A stream that hashes what goes through it."""

    def __init__(self, out) -> None:
        self.out, self.hash, self.closed, self.size = out, hashlib.sha256(), False, 0

    def write(self, data) -> int:
        data = bytes(data)
        self.hash.update(data)
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        self.closed = True

    def readable(self) -> bool:
        return False

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, job: str) -> None:
        self.folder, self.job = folder, job

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, at = _fs(self.folder)
        fs.create_dir(at, recursive=True)
        done: list[tuple[str, str, int]] = []
        name, out, writer, rows = "", None, None, 0

        def close() -> None:
            nonlocal out, writer, rows
            writer.close()
            out.close()
            done.append((name, out.hash.hexdigest(), rows))
            out = writer = None
            rows = 0

        try:
            for batch in iterator:
                if writer is None:
                    name = f"part-{self.job}-{uuid.uuid4().hex}.parquet"
                    out = _Hashed(fs.open_output_stream(f"{at}/{name}"))
                    writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
                if out.size >= FILE_BYTES:
                    close()
            if writer is not None:
                close()
        except BaseException:  # a failed attempt leaves nothing
            if out is not None:
                out.close()
                fs.delete_file(f"{at}/{name}")
            for n, _, _ in done:
                fs.delete_file(f"{at}/{n}")
            raise
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _fs(self.folder)
        fs.create_dir(at, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        body = json.dumps({"files": [{"name": n, "sha256": s, "rows": r} for n, s, r in files], "rows": sum(f[2] for f in files), "root": merkle([f[1] for f in files])}, sort_keys=True)
        for name, text in ((MANIFEST, body), (MARKER, hashlib.sha256(body.encode()).hexdigest())):
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(text.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _fs(self.folder)
        for name, _, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{at}/{name}")


class ScoreStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "score_store"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("job", "0"))


def put(scores: DataFrame, folder: str) -> str:
    """The table's root digest. A folder that holds a complete table is refused."""
    fs, at = _fs(folder)
    import pyarrow.fs as pafs

    if fs.get_file_info(f"{at}/{MARKER}").type == pafs.FileType.File:
        raise SetupError(f"{folder} holds a complete table")
    spark = scores.sparkSession
    spark.dataSource.register(ScoreStore)
    job = uuid.uuid4().hex
    try:
        scores.write.format("score_store").option("job", job).mode("append").save(folder)
    except Exception:  # tasks that were killed could not delete what they wrote
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.base_name.startswith(f"part-{job}-"):
                    fs.delete_file(f.path)
        raise
    return manifest(folder)["root"]


def _read(fs, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def manifest(folder: str) -> dict:
    """The manifest of a complete table; an interrupted or edited one is an error of the set-up. It has a line a file."""
    fs, at = _fs(folder)
    try:
        body, marker = _read(fs, f"{at}/{MANIFEST}"), _read(fs, f"{at}/{MARKER}").decode().strip()
    except (OSError, ValueError) as e:
        raise SetupError(f"run_incomplete: {folder}") from e
    if hashlib.sha256(body).hexdigest() != marker:
        raise SetupError(f"run_manifest_mismatch: {folder}")
    try:
        made = json.loads(body)
        if merkle([f["sha256"] for f in made["files"]]) != made["root"]:
            raise SetupError(f"run_manifest_mismatch: {folder}: root")
    except (ValueError, KeyError, TypeError) as e:
        raise SetupError(f"run_manifest_invalid: {folder}") from e
    return made


def tampered(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) of files that the manifest names and that are missing or changed; read and hashed by Spark."""
    want = spark.createDataFrame([(f["name"], f["sha256"]) for f in manifest(folder)["files"]], "name string, want string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    got = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("got"))
    bad = want.join(got, "name", "left").filter(~F.col("got").eqNullSafe(F.col("want")))
    return bad.select("name", F.when(F.col("got").isNull(), "missing").otherwise("changed").alias("problem"))


def get(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of a complete table whose files are unchanged; files that it does not name are not read."""
    files = manifest(folder)["files"]
    if wrong := tampered(spark, folder).limit(5).collect():
        raise SetupError("run_artifact_tampered: " + ", ".join(f"{r.name} is {r.problem}" for r in wrong))
    if not files:
        raise SetupError(f"run_empty: {folder}")
    return spark.read.parquet(*[f"{folder.rstrip('/')}/{f['name']}" for f in files])
