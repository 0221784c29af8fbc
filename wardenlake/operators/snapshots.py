"""Checkpoints of file or row tables: compare, verify, preview, restore, retain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.sources.corpus import extension


MANIFEST_SCHEMA = "checkpoint_id string, path string, checksum string, size_bytes bigint, modified timestamp_ntz"


def file_manifest(files: DataFrame, checkpoint_id: str, key: str = "path", content: str = "content", modified: str | None = None) -> DataFrame:
    """One checksum row per file."""
    stamp = F.col(modified) if modified else F.lit(None).cast("timestamp_ntz")
    return files.select(F.lit(checkpoint_id).alias("checkpoint_id"), F.col(key).cast("string").alias("path"), F.sha2(content, 256).alias("checksum"),
                        F.octet_length(content).cast("bigint").alias("size_bytes"), stamp.alias("modified"))


def row_manifest(table: DataFrame, checkpoint_id: str, key: str, modified: str | None = None) -> DataFrame:
    """The same for any table: the checksum covers the whole row as JSON."""
    body = F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"})
    return file_manifest(table.withColumn("_body", body), checkpoint_id, key, "_body", modified)


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("checkpoint_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size"))


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("path", F.lit(True).alias("in_old"), F.col("checksum").alias("old_checksum"), F.col("size_bytes").alias("old_size"), F.col("modified").alias("old_modified"))
    b = new.select("path", F.lit(True).alias("in_new"), F.col("checksum").alias("new_checksum"), F.col("size_bytes").alias("new_size"), F.col("modified").alias("new_modified"))
    return a.join(b, "path", "full_outer")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified or unchanged per path; one sort-merge join on unique paths.

    A file without a checksum is there all the same: it differs from one with a checksum only.
    """
    change = (F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
              .when(~F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "modified").otherwise("unchanged"))
    return _sides(old, new).withColumn("change", change).drop("in_old", "in_new")


def integrity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Checkpoint rows whose file is missing or differs; empty means intact."""
    now = actual.select("path", F.lit(True).alias("there"), F.col("checksum").alias("actual"))
    return (expected.join(now, "path", "left").filter(F.col("there").isNull() | ~F.col("actual").eqNullSafe(F.col("checksum")))
            .select("path", F.when(F.col("there").isNull(), "missing").otherwise("changed").alias("problem")))


def rollback_preview(checkpoint: DataFrame, current: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """What a rollback would do: restore, create or delete; for all files or a named subset."""
    delta = compare(checkpoint, current)
    action = F.when(F.col("change") == "modified", "restore").when(F.col("change") == "removed", "create").when(F.col("change") == "added", "delete")
    rows = delta.withColumn("action", action).filter(F.col("action").isNotNull())
    return rows if paths is None else rows.join(paths.select("path"), "path", "left_semi")


def version_compare(checkpoint: DataFrame, current: DataFrame) -> DataFrame:
    state = (F.when(F.col("in_old").isNull(), "NOT_IN_CHECKPOINT").when(F.col("in_new").isNull(), "NOT_IN_CURRENT")
             .when(F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "IDENTICAL").otherwise("DIFFERENT"))
    return _sides(checkpoint, current).select("path", state.alias("state"), (F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))).alias("size_delta"))


def content_diff(checkpoint_files: DataFrame, current_files: DataFrame) -> DataFrame:
    """Line and byte difference per file that exists on both sides."""
    lines = F.size(F.split("content", "\n", -1))
    a = checkpoint_files.select("path", lines.alias("old_lines"), F.octet_length("content").alias("old_bytes"))
    b = current_files.select("path", lines.alias("new_lines"), F.octet_length("content").alias("new_bytes"))
    return a.join(b, "path").select("path", (F.col("new_lines") - F.col("old_lines")).alias("line_difference"), (F.col("new_bytes") - F.col("old_bytes")).alias("size_difference"))


def impact(preview: DataFrame) -> DataFrame:
    """File count, minutes (half a minute each, at least one), level, extensions."""
    ext = extension(F.col("path"))
    return (preview.agg(F.count("*").alias("files"), F.sort_array(F.collect_set(ext)).alias("extensions"))
            .withColumn("estimated_minutes", F.greatest(F.lit(1.0), F.col("files") * 0.5))
            .withColumn("impact_level", F.when(F.col("files") > 20, "HIGH").when(F.col("files") > 10, "MEDIUM").otherwise("LOW")))


def conflicts(checkpoint: DataFrame, current: DataFrame) -> DataFrame:
    """Different, and modified after the checkpoint."""
    rows = _sides(checkpoint, current).filter((F.col("old_checksum") != F.col("new_checksum")) & (F.col("new_modified") > F.col("old_modified")))
    return rows.select("path", "old_modified", "new_modified")


def restore(checkpoint_files: DataFrame, current_files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The next version of the table.

    Full: exactly the checkpoint rows.  Partial: checkpoint rows for the named paths
    (a named path absent from the checkpoint is deleted), current rows elsewhere.
    The caller writes it to a new path, keeps the old one as backup, and checks it
    with :func:`integrity`.
    """
    if paths is None:
        return checkpoint_files
    named = paths.select("path").distinct()
    return checkpoint_files.join(named, "path", "left_semi").unionByName(current_files.join(named, "path", "left_anti"))


def list_checkpoints(checkpoints: DataFrame, k: int | None = None) -> DataFrame:
    """All checkpoints, or the newest ``k``."""
    return checkpoints if k is None else checkpoints.orderBy(F.desc("created_at"), "checkpoint_id").limit(k)


def expired_checkpoints(checkpoints: DataFrame, keep: int, days: int, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """Not among the newest ``keep`` and older than ``days``.

    Only the ``keep`` newest rows per group pass the ranking (each task holds at most
    that many), and everything else is found by an anti join.
    """
    by = by or ["workspace"]
    order = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("checkpoint_id"))
    newest = checkpoints.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).select("checkpoint_id")
    old = checkpoints.filter(F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return old.join(newest, "checkpoint_id", "left_anti")


def expired_backups(backups: DataFrame, keep: int, days: int, as_of: Column) -> DataFrame:
    """Per file: beyond the newest ``keep``, or older than ``days``."""
    order = Window.partitionBy("path").orderBy(F.desc("created_at"), F.desc("backup_id"))
    newest = backups.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    alive = newest.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).select("backup_id")
    return backups.join(alive, "backup_id", "left_anti")


def incremental(base: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Rows to add to a base checkpoint: changed or new rows, and deletion marks."""
    delta = compare(base, current).filter(F.col("change") != "unchanged")
    return delta.select("path", F.col("new_checksum").alias("checksum"), F.col("new_size").alias("size_bytes"), F.col("new_modified").alias("modified"),
                        (F.col("change") == "removed").alias("deleted"))


def materialise(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Base plus deltas(version, path, …, deleted): the newest row per path wins, marks drop it."""
    columns = ["path", "checksum", "size_bytes", "modified"]
    rows = base.select(*columns, F.lit(False).alias("deleted"), F.lit(0).alias("version")).unionByName(deltas.select(*columns, "deleted", "version"))
    newest = rows.groupBy("path").agg(F.max_by(F.struct("checksum", "size_bytes", "modified", "deleted"), "version").alias("n"))
    return newest.select("path", "n.*").filter(~F.col("deleted")).drop("deleted")


FINGERPRINT_BUCKETS = 4096


def revision_fingerprint(manifest: DataFrame) -> DataFrame:
    """One digest over all (path, checksum) pairs, independent of row order and partitioning.

    Rows hash into 4096 buckets by path; a bucket keeps two exact sums of row-hash
    halves, and the digest covers the fixed list of bucket sums.  No group gathers rows.
    """
    row = F.sha2(F.concat("path", F.lit("\x00"), "checksum"), 256)
    half = [F.conv(F.substring(row, start, 14), 16, 10).cast("decimal(38,0)") for start in (1, 15)]
    bucket = F.conv(F.substring(F.sha2("path", 256), 1, 3), 16, 10).cast("int")
    sums = manifest.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"), F.sum(half[0]).alias("_a"), F.sum(half[1]).alias("_b"))
    line = F.concat_ws(":", F.lpad(F.col("_bucket").cast("string"), 4, "0"), F.col("_n").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return sums.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


#: Hexadecimal digits of a range of paths, and of its parents up to the root.
TREE_DIGITS = 2


def path_range(path: Column, digits: int = TREE_DIGITS) -> Column:
    """The range of a path: the first digits of its hash, so ranges are of equal size."""
    return F.substring(F.sha2(path, 256), 1, digits)


def hash_tree(manifest: DataFrame, digits: int = TREE_DIGITS) -> DataFrame:
    """(level, range, rows, a, b) for every range and its parents up to the root, whose range is empty.

    A node has the number of its rows and two exact sums of halves of the row hashes, so a parent
    is the sum of its children and the order of rows doesn't matter.  A null checksum counts as a value of its own.
    """
    row = F.sha2(F.concat("path", F.lit("\x00"), F.coalesce("checksum", F.lit("\x01"))), 256)
    half = [F.conv(F.substring(row, start, 14), 16, 10).cast("decimal(38,0)") for start in (1, 15)]
    leaves = manifest.groupBy(path_range(F.col("path"), digits).alias("range")).agg(F.count("*").alias("rows"), F.sum(half[0]).alias("a"), F.sum(half[1]).alias("b"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("level")
    nodes = leaves.select(levels, "range", "rows", "a", "b").withColumn("range", F.expr("substring(range, 1, level)"))
    return nodes.groupBy("level", "range").agg(F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def write_checkpoint(manifest: DataFrame, path: str, digits: int = TREE_DIGITS) -> None:
    """The manifest's rows in one folder a range, and the hash tree over them beside it."""
    ranged = manifest.withColumn("range", path_range(F.col("path"), digits))
    ranged.repartition("range").write.mode("errorifexists").partitionBy("range").parquet(f"{path}/rows")
    hash_tree(manifest, digits).coalesce(1).write.mode("errorifexists").parquet(f"{path}/tree")


def changed_ranges(old: DataFrame, new: DataFrame, digits: int = TREE_DIGITS) -> DataFrame:
    """Ranges in which two trees differ; a level is compared only below the nodes that differ one level up."""
    differ = None
    for level in range(digits + 1):
        a, b = (tree.filter(F.col("level") == level).select("range", F.struct("rows", "a", "b").alias(name)) for tree, name in ((old, "_old"), (new, "_new")))
        if differ is not None:
            up = F.expr(f"substring(range, 1, {level - 1})")
            a, b = (side.withColumn("_up", up).join(differ.select(F.col("range").alias("_up")), "_up", "left_semi").drop("_up") for side in (a, b))
        differ = a.join(b, "range", "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("range")
    return differ


def compare_checkpoints(spark: SparkSession, old: str, new: str, digits: int = TREE_DIGITS) -> DataFrame:
    """What changed between two written checkpoints, as :func:`compare` says it, without the unchanged rows.

    Only the folders of ranges whose trees differ are opened; there are at most 16 ** digits of them.
    """
    trees = [spark.read.parquet(f"{side}/tree") for side in (old, new)]
    ranges = [r["range"] for r in changed_ranges(*trees, digits).collect()]
    sides = [spark.read.schema(f"{MANIFEST_SCHEMA}, range string").parquet(f"{side}/rows").filter(F.col("range").isin(ranges)) for side in (old, new)]
    return compare(*sides).filter("change <> 'unchanged'")


def approval_current(approved: DataFrame, current_manifest: DataFrame) -> DataFrame:
    """Whether the table is still the one the preview saw."""
    now = revision_fingerprint(current_manifest).select(F.col("fingerprint").alias("current_fingerprint"))
    seen = approved.select(F.col("fingerprint").alias("approved_fingerprint"))
    # the current side is one row, so its value reaches every approval as a scalar subquery, not by a join
    return seen.withColumn("current_fingerprint", now.scalar()).withColumn("may_apply", F.col("approved_fingerprint") == F.col("current_fingerprint"))
