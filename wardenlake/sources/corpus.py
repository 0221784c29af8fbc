"""File corpora: write, walk, filter, sniff, decode."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.sources.tables import spread

# Folders left out of a migration walk.
SKIP_DIRS = [".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", "env", "node_modules",
             "dist", "build", "htmlcov", ".migration-backups", ".migration-checkpoints", ".migration-logs"]
# Extensions and folders of the sensitive-data scan.
SCAN_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".vue", ".html", ".css", ".json", ".yaml", ".yml", ".md", ".txt", ".xml", ".sql", ".env"]
SCAN_SKIP_DIRS = [".git", ".venv", "venv", "node_modules", "__pycache__"]
#: Files that a written folder holds at most, and that one scan lists: the driver holds the listing of a scan.
FOLDER_FILES, SCAN_FILES = 1000, 50_000
#: What opening a file costs a scan of small files, in bytes read; by default, of 4 MB, a task reads 32 of them or fewer.
SMALL_OPEN_BYTES = 16 << 10


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text from the last dot of the name; a name that only starts with a dot has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def in_dirs(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def candidate_filter(files: DataFrame, extensions: list[str] | None = None, max_file_kb: int | None = None) -> DataFrame:
    """Extension and folder rules on (path, size_bytes), and a size limit if one is asked for; they run before any content is read."""
    kept = files.filter(~in_dirs(F.col("path"), SKIP_DIRS))
    if max_file_kb is not None:
        kept = kept.filter(F.col("size_bytes") <= max_file_kb * 1024)
    if extensions:
        kept = kept.filter(F.lower(extension(F.col("path"))).isin([e.lower() for e in extensions]))
    return kept


def scan_set(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether the sensitive-data scan reads a path: by name ending, folder and hidden-file rules."""
    name = file_name(path)
    ending = F.lit(False)
    for e in extensions or SCAN_EXTENSIONS:
        ending = ending | name.endswith(e)
    hidden = (name.startswith(".") & (name != ".env")) | name.startswith("__")
    return ending & ~in_dirs(path, SCAN_SKIP_DIRS) & ~hidden


def is_binary(content: Column) -> Column:
    """A NUL byte anywhere."""
    return content.cast("string").contains("\x00")


def lenient_text(content: Column) -> Column:
    """UTF-8 with undecodable bytes left out."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))


@contextmanager
def held(spark: SparkSession, key: str, value: str):
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_system(folder: str):
    """The pyarrow file system of a folder and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", folder)) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)


def write_files(rows: DataFrame, root: str, key: str, content: str) -> list[tuple[str, int]] | None:
    """A text file for each whole-number key below a folder, with a line for each of its rows; returns the folders that count, each with its number of files.

    Lines of a file stand in an order that depends on them only, null contents are empty lines, and rows without a key are a file each.
    A file's name ends in ``key=value.txt``.  An attempt of a task writes to folders of its own, so those of lost
    attempts aren't among the folders returned.  Where pyarrow has no access to the store Spark's writer makes the
    files, in a folder ``key=value`` each, and None is returned: the whole root counts.
    """
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    home = hadoop.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    lines = rows.select(F.col(key).cast("long").alias(key), F.col(content).cast("string").alias(content))
    try:
        file_system(home)
    except (OSError, ValueError, NotImplementedError):
        # tasks put their files in place themselves, where the driver would move one after the other
        spread(lines, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(root)
        return None

    def pack(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            texts = [data.as_buffer() for data in batch.column(1)]
            sizes = pa.array([None if t is None else t.size for t in texts], pa.int64())
            packed = pa.array([None if t is None else codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, packed], names=["k", "size", "packed"])

    def write(batches):
        system, base = file_system(home)
        codec, number, folder, files, last, out = pa.Codec("zstd"), TaskContext.get().partitionId(), None, 0, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([folder], pa.string()), pa.array([files], pa.int64())], names=["folder", "files"])

        for batch in batches:
            for k, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if out is None or k is None or k != last:
                    if out is not None:
                        out.close()
                    if files == FOLDER_FILES:
                        yield done()
                        folder = None
                    if folder is None:
                        folder, files = f"{number:05d}-{uuid.uuid4().hex}", 0
                        system.create_dir(f"{base}/{folder}", recursive=True)
                    out = system.open_output_stream(f"{base}/{folder}/part-{number:05d}-{files:05d}-{key}={'' if k is None else k}.txt", compression=None)
                    files, last = files + 1, k
                if size:
                    out.write(codec.decompress(data.as_buffer(), size))
                out.write(b"\n")
        if out is not None:
            out.close()
            yield done()

    # packed one by one, texts take less room in the shuffle than its own blocks would give them
    packed = lines.withColumn(content, F.col(content).cast("binary")).mapInArrow(pack, "k long, size long, packed binary")
    ordered = spread(packed, "k").sortWithinPartitions("k", "packed")
    return [(r["folder"], r["files"]) for r in ordered.mapInArrow(write, "folder string, files long").collect()]


def scan_groups(folders: list[tuple[str, int]] | None) -> list[list[str] | None]:
    """The folders of ``write_files`` in groups of at most ``SCAN_FILES`` files, for a scan each; at least one group."""
    if folders is None:
        return [None]
    groups, files = [[]], 0
    for folder, n in folders:
        if groups[-1] and files + n > SCAN_FILES:
            groups.append([])
            files = 0
        groups[-1].append(folder)
        files += n
    return groups


def read_corpus(spark: SparkSession, root: str, project: str, extensions: list[str] | None = None, max_file_kb: int | None = None,
                glob: str | None = None, folders: list[str] | None = None) -> DataFrame:
    """``files(project, path, ext, size_bytes, content)`` below a folder, or below some ``folders`` in it.

    Path and size filters are pushed to the listing, so skipped files are not opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # folders are listed by as many tasks as a shuffle has; by default each folder, up to 10,000, is a task of its own
    with held(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.shuffle.partitions")):
        listed = reader.load(root if folders is None else [f"{root.rstrip('/')}/{f}" for f in folders])
    if max_file_kb is not None:
        listed = listed.filter(F.col("length") <= max_file_kb * 1024)
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "")
    named = listed.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("_bytes"))
    kept = candidate_filter(named, extensions, max_file_kb).filter(~is_binary(F.col("_bytes")))
    return kept.select(F.lit(project).alias("project"), "path", extension(F.col("path")).alias("ext"), "size_bytes", lenient_text(F.col("_bytes")).alias("content"))
