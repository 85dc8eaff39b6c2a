"""Files as tables: manifests, texts, and directory rules; and the sinks that write one file per group."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST

SKIPPED = ("__pycache__", "bower_components", "build", "coverage", "dist", "node_modules", "out", "target", "vendor", "venv", ".git", ".hg", ".next", ".svn", ".venv")


def skipped(path: Column) -> Column:
    """Whether a part of the path is a folder that holds no sources."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(*SKIPPED))


#: Folders that a manifest leaves out.
NOT_LISTED = (".git", ".hg", ".svn", "node_modules", ".venv", "__pycache__")


def below(path: Column, root: str) -> Column:
    """The path without ``root``, whatever way either is spelt as a local one."""
    plain = F.regexp_replace(path, r"^file:/*", "/")
    return F.substring(plain, F.lit(len(re.sub(r"^file:/*", "/", root).rstrip("/")) + 2), F.length(plain))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files by path, read a piece at a time; null for links."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            store, name = (fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)) if re.match("file:|/", path) else fs.FileSystem.from_uri(path)
            if isinstance(store, fs.LocalFileSystem) and os.path.islink(name):
                found.append(None)
                continue
            digest = hashlib.sha256()
            with store.open_input_stream(name) as source:
                while piece := source.read(1 << 20):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), sha256, size, mtime of every file outside the folders that are left out.

    Files are listed first; only those that stay are opened, each by a task, and read in pieces, whatever their size. Links are no files.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    kept = listed.withColumn("rel", below(F.col("path"), root)).where(~F.exists(F.split("rel", "/"), lambda p: p.isin(*NOT_LISTED)))
    kept = kept.withColumn("mtime", F.col("modificationTime").cast("double")).drop("modificationTime")
    hashed = kept.mapInArrow(_hashes, "path string, length bigint, rel string, mtime double, sha256 string")
    return hashed.where("sha256 is not null").select(F.col("rel").alias("path"), "sha256", F.col("length").alias("size"), "mtime")


_NODE, _JVM, _PY = "node_modules", ".gradle .idea build out target", ".mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ env node_modules site-packages venv"
#: kind -> (endings, folders that are left out) of the files that an extractor of the kind reads.
FILE_LISTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    kind: (tuple(ends.split()), tuple(skip.split()))
    for kind, ends, skip in (
        ("ts", ".cjs .js .jsx .mjs .ts .tsx", _NODE), ("html", ".htm .html", _NODE), ("python", ".py .pyi", _PY), ("java", ".java", _JVM), ("kotlin", ".kt .kts", _JVM), ("go", ".go", "node_modules vendor"),
        ("ruby", ".rake .rb", "log node_modules tmp vendor"), ("php", ".php .phtml", "node_modules storage vendor"), ("csharp", ".cs", ".vs bin node_modules obj"), ("bash", ".bash .sh", _NODE), ("yaml", ".yaml .yml", _NODE),
    )
}


def file_lists(files: DataFrame) -> DataFrame:
    """kind, path of the files (path below the root) that each extractor reads; a file can be in several lists."""
    kinds = []
    for kind, (ends, skip) in FILE_LISTS.items():
        hit = F.rlike("path", F.lit("(?:" + "|".join(re.escape(e) for e in ends) + ")$")) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*skip))  # noqa: B023
        kinds.append(F.when(hit, kind))
    return files.select(F.explode(F.array_compact(F.array(*kinds))).alias("kind"), "path")


def folder_sizes(files: DataFrame) -> DataFrame:
    """folder, files, size of each folder of ``files`` (path, size) with all that lies below it; the root's name is empty."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def read_texts(spark: SparkSession, root: str, endings: tuple[str, ...] = ()) -> DataFrame:
    """path, content of text files, whole."""
    reader = spark.read.option("recursiveFileLookup", True)
    if endings:  # files of other names are not opened
        reader = reader.option("pathGlobFilter", "*{" + ",".join(endings) + "}")
    found = reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return found.where(~skipped(below(F.col("path"), root)))


def write_jsonl(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON Lines; with ``by`` a folder for each value."""
    if by is None:
        rows.write.json(path)
    else:
        rest = [c for c in rows.columns if c != by]
        rows.select(by, F.to_json(F.struct(*rest)).alias("value")).repartition(by).write.partitionBy(by).text(path)


def sidecar_path(file: Column, root: str) -> Column:
    """Where a file's records go: its path below the root, or its name alone if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    inside = F.startswith(file, F.lit(base))
    return F.concat(F.when(inside, F.substring(file, F.lit(len(base) + 1), F.length(file))).otherwise(F.substring_index(file, "/", -1)), F.lit(".enrich.jsonl"))


def write_sidecars(records: DataFrame, root: str, folder: str) -> DataFrame:
    """One file for each source file that has records (file, record), under its own name; gives path and records.

    A task streams its files' lines, sorted, into a hidden file that takes its name at the end, so a task that runs again
    replaces its own; files of equal place (outside the root, of one name) are one.
    """
    placed = records.select(sidecar_path(F.col("file"), root).alias("path"), "record")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = (fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)) if re.match("file:|/", folder) else fs.FileSystem.from_uri(folder)
        now, out, hidden, n = None, None, "", 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                store.move(hidden, f"{base}/{now}")
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for path, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != now:
                    yield from close()
                    now, n = path, 0
                    where, _, name = f"{base}/{path}".rpartition("/")
                    store.create_dir(where, recursive=True)
                    hidden = f"{where}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(hidden)
                out.write(record.encode() + b"\n")
                n += 1
        yield from close()

    return placed.repartition("path").sortWithinPartitions("path", "record").mapInArrow(write, "path string, records bigint")


def unchanged(old: DataFrame, new: DataFrame) -> bool:
    """Whether two manifests hold the same files: a gate before a new run."""
    mark = lambda m: m.agg(F.count("*"), F.sum(F.xxhash64("path", "sha256").cast("decimal(38,0)"))).first()
    return tuple(mark(old)) == tuple(mark(new))
