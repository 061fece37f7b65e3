"""Recorded pages of a provider as a Spark data source: `spark.read.format("recorded_pages").load(folder)`.

A recording is a folder whose files hold one page a line: {"cursor": null or text, "next": null or text, "items": [...]}.
Each recording is a partition. Its pages are followed from the one without a cursor, in the executor, with an index of
the lines' places alone, so neither the driver nor a task holds the pages. A fault ends that recording's read with a
row that has a code and no item; items read before it stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = 100
SCHEMA = "recording string, page int, place int, item string, code string, message string"


class _Recording(InputPartition):
    def __init__(self, name: str, files: list[str]) -> None:
        self.name, self.files = name, files


def _files(folder: str) -> dict[str, list[str]]:
    """Files of each recording below folder; names alone."""
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    out: dict[str, list[str]] = {}
    for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)):
        name = f.path.rsplit("/", 1)[-1]
        if f.type == pafs.FileType.File and not name.startswith(("_", ".")):
            out.setdefault(f.path.rsplit("/", 2)[-2], []).append(f.path)
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.limit = options["path"], int(options.get("pages", PAGES))

    def partitions(self) -> list[_Recording]:
        return [_Recording(name, sorted(files)) for name, files in sorted(_files(self.folder).items())] or [_Recording("", [])]

    def read(self, partition: _Recording) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        name, limit = partition.name, self.limit
        fs = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pafs.LocalFileSystem()
        fault = lambda page, code, message: (name, page, None, None, code, message)
        places: dict[str | None, tuple[int, int, int]] = {}
        opened = [fs.open_input_file(f) for f in partition.files]
        for i, f in enumerate(opened):
            at = 0
            for line in _lines(f):
                if line.strip():
                    try:
                        head = json.loads(line)
                        cursor = head.get("cursor") if isinstance(head, dict) else None
                    except ValueError:
                        cursor = f"?{i}:{at}"  # found only by the page that should name it, and so missing
                    places.setdefault(cursor, (i, at, len(line)))
                at += len(line)
        cursor, seen = None, set()
        for page in range(limit if partition.files else 0):
            if cursor not in places:
                yield fault(page, "fetch_failed", f"no page with cursor {cursor!r}")
                return
            i, at, size = places[cursor]
            opened[i].seek(at)
            try:
                body = json.loads(opened[i].read(size))
            except ValueError as e:
                yield fault(page, "page_malformed", str(e)[:200])
                return
            if not isinstance(body, dict) or not isinstance(body.get("items"), list):
                yield fault(page, "page_malformed", "a page has no list of items")
                return
            for place, item in enumerate(body["items"]):
                yield name, page, place, json.dumps(item, sort_keys=True), None, None
            cursor = body.get("next")
            if not isinstance(cursor, str) or not cursor:
                return
            if cursor in seen:
                yield fault(page, "cursor_repeated", f"cursor {cursor!r} came before")
                return
            seen.add(cursor)
        if partition.files:
            yield fault(limit, "page_limit", f"over {limit} pages")


def _lines(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, a chunk at a time."""
    held = b""
    while data := file.read(chunk):
        held += data
        *whole, held = held.split(b"\n")
        yield from (w + b"\n" for w in whole)
    if held:
        yield held


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def recorded(spark: SparkSession, folder: str, pages: int = PAGES) -> DataFrame:
    """SCHEMA of every recording below folder; faults are rows with a code."""
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").option("pages", str(pages)).load(folder)


def manifest(rows: DataFrame) -> DataFrame:
    """(recording, pages, items, rejected, codes, completeness): what each read has seen, in one pass over its rows."""
    g = rows.groupBy("recording").agg(F.coalesce(F.max(F.when(F.col("item").isNotNull(), F.col("page"))) + 1, F.lit(0)).alias("pages"), F.count("item").alias("items"), F.count("code").alias("rejected"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return g.withColumn("completeness", F.when(F.col("rejected") == 0, "complete_within_declared_scope").when(F.col("items") > 0, "partial").otherwise("blocked"))


def write_recordings(pages: DataFrame, folder: str) -> None:
    """pages: recording, line (a page's JSON text). A folder for each recording, written by Spark."""
    pages.repartition("recording").write.mode("errorifexists").partitionBy("recording").text(folder)
