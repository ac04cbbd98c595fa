"""Certificate files, PEM or DER."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from certmill.functions.framing import pem_to_der
from certmill.session import stored

# Files that a task reads, unless that makes too many tasks.
FILES_PER_TASK = 2_000
MAX_TASKS = 10_000


def read_cert_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path`` and ``der`` of every file; of a PEM file the first certificate.

    The files are those of Spark's own reader of binary files: all levels of the folder, no hidden or
    empty file. That reader holds the status of every file on the driver, so a folder
    that Arrow can open is listed in tasks instead, level by level, into a stored table of names, and
    the files are read by other tasks. A single file, a path with wildcards and a
    store that only Spark opens go to Spark's reader.
    """
    folder = _folder(spark, path)
    if folder is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        files = reader.load(path).select("path", "content")
    else:
        uri, shown = folder
        names = _listed(spark, uri)
        if pattern:
            names = names.where(_file_name().rlike(_glob(spark, pattern)))
        tasks = min(-(-names.count() // FILES_PER_TASK), MAX_TASKS)
        lenient = spark.conf.get("spark.sql.files.ignoreMissingFiles", "false") == "true"
        read = names.repartition(max(1, tasks), "name").mapInArrow(_reader(uri, lenient), "name STRING, content BINARY")
        files = read.select(F.concat(F.lit(f"{shown.rstrip('/')}/"), "name").alias("path"), "content")
    return files.select("path", pem_to_der(F.col("content")).alias("der"))


def _folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The folder as a URI and as Spark shows it, if Arrow finds a folder there."""
    from pyarrow import fs

    if re.search(r"[*?\[\]{}\\]", path):
        return None
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(given)
    uri = full.toUri().toASCIIString()
    try:
        store, root = fs.FileSystem.from_uri(uri)
        there = store.get_file_info(root).type == fs.FileType.Directory
    except (OSError, ValueError):
        return None
    return (uri, full.toString()) if there else None


def _glob(spark: SparkSession, pattern: str) -> str:
    """A file name pattern as Spark's reader takes it, as a regular expression."""
    return f"(?s)^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})$"


def _file_name() -> Column:
    return F.element_at(F.split("name", "/"), -1)


def _listed(spark: SparkSession, uri: str) -> DataFrame:
    """``name``, from the folder on, of every file that is not hidden; one stored table for each level."""
    own = _file_name()
    # As Spark's reader has it, down to the folders of Parquet's summaries.
    marked = own.rlike("^_") & ~F.contains(own, F.lit("=")) & ~(F.col("folder") & own.rlike("^_(common_)?metadata"))
    hidden = own.rlike("^[.]") | marked | own.rlike("[.]_COPYING_$")
    level, files = spark.range(1).coalesce(1).selectExpr("'' AS name"), None
    while True:
        found = stored(level.mapInArrow(_lister(uri), "name STRING, folder BOOLEAN").where(~hidden), "listing")
        here = found.where("NOT folder").select("name")
        files = here if files is None else files.unionByName(here)
        level = found.where("folder").select("name")
        folders = level.count()
        if not folders:
            return files
        level = level.repartition(min(folders, MAX_TASKS))


def _lister(uri: str):
    """A function over Arrow batches of folders that gives what lies in them, a few thousand names at once.

    It is made here, like the one below, so executors get it by value and need no copy of this module.
    """
    def list_folders(batches):
        import os
        from itertools import batched

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)

        def inside(folder):
            if isinstance(store, fs.LocalFileSystem):  # the one that names files as it goes
                with os.scandir(f"{root}/{folder}") as found:
                    yield from ((f.name, f.is_dir()) for f in found if f.is_dir() or f.is_file())
            else:
                for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                    yield f.base_name, f.type == fs.FileType.Directory

        for batch in batches:
            for folder in batch.column("name").to_pylist():
                for some in batched(inside(folder), 10_000):
                    names = [f"{folder}/{n}" if folder else n for n, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([d for _, d in some], pa.bool_())], ["name", "folder"])

    return list_folders


def _reader(uri: str, lenient: bool, batch_bytes: int = 4 << 20):
    """A function over Arrow batches of names that gives the bytes of each file, some megabytes at once."""
    def read_files(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["name", "content"]
            )

        for batch in batches:
            rows, held = [], 0
            for name in batch.column("name").to_pylist():
                try:
                    with store.open_input_file(f"{root}/{name}") as file:
                        content = file.read()
                except FileNotFoundError:
                    if lenient:
                        continue
                    raise
                if content:  # Spark's reader leaves empty files out
                    rows.append((name, content))
                    held += len(content)
                if held >= batch_bytes:
                    yield packed(rows)
                    rows, held = [], 0
            yield packed(rows)

    return read_files
