"""Checkpoints over orders and a derived second version, and over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardenlake.operators import snapshots as sn
from wardenlake.plans.registry import derive, plain, query
from wardenlake.session import ensure_checkpoint_dir
from wardenlake.sources.tables import load

# The second version drops some orders, changes others and adds new ones.
VERSION_ONE = """
SELECT concat('orders/', cast(o_orderkey AS string), '.csv') AS path, concat(cast(o_custkey AS string), ',', o_orderstatus, chr(10), o_orderpriority) AS content,
       o_orderdate AS modified FROM {orders}
"""
VERSION_TWO = """
SELECT concat('orders/', cast(o_orderkey + CASE WHEN o_orderkey % 17 = 3 THEN 100000000 ELSE 0 END AS string), '.csv') AS path,
       concat(cast(o_custkey AS string), ',', CASE WHEN o_orderkey % 10 = 4 THEN concat('X', chr(10)) ELSE o_orderstatus END, chr(10), o_orderpriority) AS content,
       CASE WHEN o_orderkey % 20 = 4 THEN o_orderdate + INTERVAL '1' DAY ELSE o_orderdate END AS modified
FROM {orders} WHERE o_orderkey % 13 <> 5
"""
_A, _B = plain(VERSION_ONE), plain(VERSION_TWO)
_DELTA = f"""
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'modified' ELSE 'unchanged' END AS change,
  a.content AS old_content, b.content AS new_content, a.modified AS old_modified, b.modified AS new_modified FROM ({_A}) a FULL JOIN ({_B}) b ON a.path = b.path"""


def _files(spark, sf_dir):
    return derive(spark, sf_dir, VERSION_ONE, "orders"), derive(spark, sf_dir, VERSION_TWO, "orders")


def _manifests(spark, sf_dir):
    one, two = _files(spark, sf_dir)
    return sn.file_manifest(one, "cp1", modified="modified"), sn.file_manifest(two, "cp2", modified="modified")


@query("snapshot_manifest", f"SELECT path, sha256(content) AS checksum, CAST(strlen(content) AS BIGINT) AS size_bytes FROM ({_A})")
def snapshot_manifest(spark, sf_dir):
    return _manifests(spark, sf_dir)[0].select("path", "checksum", "size_bytes")


@query("snapshot_summary", f"SELECT 'cp1' AS checkpoint_id, count(*) AS file_count, CAST(sum(strlen(content)) AS BIGINT) AS total_size FROM ({_A})")
def snapshot_summary(spark, sf_dir):
    return sn.summary(_manifests(spark, sf_dir)[0])


@query("row_manifest", "SELECT CAST(c_custkey AS VARCHAR) AS path, sha256('{\"c_acctbal\":' || c_acctbal || ',\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}') AS checksum FROM customer")
def row_manifest(spark, sf_dir):
    return sn.row_manifest(load(spark, sf_dir, "customer"), "c1", "c_custkey").select("path", "checksum")


@query("snapshot_diff", f"SELECT path, change FROM ({_DELTA})")
def snapshot_diff(spark, sf_dir):
    return sn.compare(*_manifests(spark, sf_dir)).select("path", "change")


@query("snapshot_integrity", f"SELECT path, CASE change WHEN 'removed' THEN 'missing' ELSE 'changed' END AS problem FROM ({_DELTA}) WHERE change IN ('removed', 'modified')")
def snapshot_integrity(spark, sf_dir):
    return sn.integrity(*_manifests(spark, sf_dir))


_ACTION = "CASE change WHEN 'modified' THEN 'restore' WHEN 'removed' THEN 'create' ELSE 'delete' END"


@query("rollback_preview", f"SELECT path, {_ACTION} AS action FROM ({_DELTA}) WHERE change <> 'unchanged'")
def rollback_preview(spark, sf_dir):
    return sn.rollback_preview(*_manifests(spark, sf_dir)).select("path", "action")


@query("rollback_preview_subset", f"""
SELECT path, {_ACTION} AS action FROM ({_DELTA}) WHERE change <> 'unchanged' AND path IN (SELECT 'orders/' || l_orderkey || '.csv' FROM lineitem WHERE l_quantity > 45)""")
def rollback_preview_subset(spark, sf_dir):
    named = load(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("orders/"), "l_orderkey", F.lit(".csv")).alias("path"))
    return sn.rollback_preview(*_manifests(spark, sf_dir), named).select("path", "action")


@query("version_compare", f"""
SELECT path, CASE change WHEN 'added' THEN 'NOT_IN_CHECKPOINT' WHEN 'removed' THEN 'NOT_IN_CURRENT' WHEN 'unchanged' THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS state,
  CAST(coalesce(strlen(new_content), 0) - coalesce(strlen(old_content), 0) AS BIGINT) AS size_delta FROM ({_DELTA})""")
def version_compare(spark, sf_dir):
    return sn.version_compare(*_manifests(spark, sf_dir))


@query("content_diff", f"""
SELECT path, CAST((length(new_content) - length(replace(new_content, chr(10), ''))) - (length(old_content) - length(replace(old_content, chr(10), ''))) AS INT) AS line_difference,
  CAST(strlen(new_content) - strlen(old_content) AS INT) AS size_difference FROM ({_DELTA}) WHERE change IN ('modified', 'unchanged')""")
def content_diff(spark, sf_dir):
    return sn.content_diff(*_files(spark, sf_dir))


@query("rollback_impact", f"""
SELECT count(*) AS files, '.csv' AS extensions, CAST(greatest(1.0, count(*) * 0.5) AS DOUBLE) AS estimated_minutes,
  CASE WHEN count(*) > 20 THEN 'HIGH' WHEN count(*) > 10 THEN 'MEDIUM' ELSE 'LOW' END AS impact_level FROM ({_DELTA}) WHERE change <> 'unchanged'""")
def rollback_impact(spark, sf_dir):
    i = sn.impact(sn.rollback_preview(*_manifests(spark, sf_dir)))
    return i.withColumn("extensions", F.array_join("extensions", ",")).withColumn("estimated_minutes", F.col("estimated_minutes").cast("double"))


@query("rollback_conflicts", f"SELECT path FROM ({_DELTA}) WHERE change = 'modified' AND new_modified > old_modified")
def rollback_conflicts(spark, sf_dir):
    return sn.conflicts(*_manifests(spark, sf_dir)).select("path")


@query("restore_partial", f"""
WITH named AS (SELECT path FROM ({_DELTA}) WHERE change <> 'unchanged' AND path LIKE '%7.csv')
SELECT path, sha256(content) AS checksum FROM ({_A}) WHERE path IN (SELECT path FROM named)
UNION ALL SELECT path, sha256(content) FROM ({_B}) WHERE path NOT IN (SELECT path FROM named)""")
def restore_partial(spark, sf_dir):
    one, two = _files(spark, sf_dir)
    named = sn.rollback_preview(*_manifests(spark, sf_dir)).filter(F.col("path").like("%7.csv")).select("path")
    return sn.restore(one, two, named).select("path", F.sha2("content", 256).alias("checksum"))


@query("restore_verified", f"SELECT path, 'missing' AS problem FROM ({_A}) WHERE false")
def restore_verified(spark, sf_dir):
    one, two = _files(spark, sf_dir)
    restored = sn.file_manifest(sn.restore(one, two), "restored", modified="modified")
    return sn.integrity(_manifests(spark, sf_dir)[0], restored)


@query("incremental_checkpoint", f"SELECT path, change = 'removed' AS deleted FROM ({_DELTA}) WHERE change <> 'unchanged'")
def incremental_checkpoint(spark, sf_dir):
    return sn.incremental(*_manifests(spark, sf_dir)).select("path", "deleted")


@query("incremental_materialised", f"SELECT path, sha256(content) AS checksum FROM ({_B})")
def incremental_materialised(spark, sf_dir):
    base, current = _manifests(spark, sf_dir)
    return sn.materialise(base, sn.incremental(base, current).withColumn("version", F.lit(1))).select("path", "checksum")


# A checkpoint per order, in the workspace of its customer.
CHECKPOINTS = "SELECT cast(o_custkey AS string) AS workspace, o_orderkey AS checkpoint_id, o_orderdate AS created_at FROM {orders}"
_CP = plain(CHECKPOINTS)


@query("checkpoint_listing", f"SELECT checkpoint_id, workspace FROM ({_CP})")
def checkpoint_listing(spark, sf_dir):
    return sn.list_checkpoints(derive(spark, sf_dir, CHECKPOINTS, "orders")).select("checkpoint_id", "workspace")


@query("retention", f"""
SELECT checkpoint_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY created_at DESC, checkpoint_id DESC) AS rn FROM ({_CP}))
WHERE rn > 3 AND created_at < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 1000 DAY""")
def retention(spark, sf_dir):
    as_of = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")
    return sn.expired_checkpoints(derive(spark, sf_dir, CHECKPOINTS, "orders"), 3, 1000, as_of).select("checkpoint_id")


BACKUPS = "SELECT concat('f', cast(l_partkey AS string)) AS path, l_orderkey * 10 + l_linenumber AS backup_id, l_shipdate AS created_at FROM {lineitem}"


@query("backup_retention", f"""
SELECT count(*) AS dropped, count(DISTINCT path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, backup_id DESC) AS rn
  FROM (SELECT path, backup_id, max(created_at) AS created_at FROM ({plain(BACKUPS)}) GROUP BY path, backup_id))
WHERE rn > 5 OR created_at < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 900 DAY""")
def backup_retention(spark, sf_dir):
    backups = derive(spark, sf_dir, BACKUPS, "lineitem").groupBy("path", "backup_id").agg(F.max("created_at").alias("created_at"))
    unique = backups.withColumn("backup_id", F.struct("backup_id", "path"))
    gone = sn.expired_backups(unique, 5, 900, F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"))
    return gone.agg(F.count("*").alias("dropped"), F.countDistinct("path").alias("paths"))


@query("revision_fingerprint", f"""
SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, CAST(sum(n) AS BIGINT) AS "rows" FROM (
  SELECT lpad(CAST(b AS VARCHAR), 4, '0') || ':' || count(*) || ':' || sum(CAST('0x' || r[1:14] AS HUGEINT)) || ':' || sum(CAST('0x' || r[15:28] AS HUGEINT)) AS line, count(*) AS n
  FROM (SELECT CAST('0x' || left(sha256(path), 3) AS INT) AS b, sha256(concat(path, chr(0), sha256(content))) AS r FROM ({_A})) GROUP BY b)""")
def revision_fingerprint(spark, sf_dir):
    return sn.revision_fingerprint(_manifests(spark, sf_dir)[0])


@query("stale_approval", "SELECT false AS may_apply UNION ALL SELECT true")
def stale_approval(spark, sf_dir):
    one, two = _manifests(spark, sf_dir)
    approved = sn.revision_fingerprint(one)
    return sn.approval_current(approved, two).select("may_apply").unionByName(sn.approval_current(approved, one.repartition(3)).select("may_apply"))


# A third version in which few paths change, go or come, so most ranges of the two trees are equal.
VERSION_THREE = """
SELECT concat('orders/', cast(o_orderkey + CASE WHEN o_orderkey % 2999 = 5 THEN 100000000 ELSE 0 END AS string), '.csv') AS path,
       concat(cast(o_custkey AS string), ',', CASE WHEN o_orderkey % 1999 = 4 THEN concat('X', chr(10)) ELSE o_orderstatus END, chr(10), o_orderpriority) AS content,
       o_orderdate AS modified
FROM {orders} WHERE o_orderkey % 3001 <> 7
"""
_FEW = f"""
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change,
  sha256(a.content) AS old_checksum, sha256(b.content) AS new_checksum
FROM ({_A}) a FULL JOIN ({plain(VERSION_THREE)}) b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content"""


def _written(spark, sf_dir):
    """Both versions as written checkpoints in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    for name, version in (("cp1", VERSION_ONE), ("cp3", VERSION_THREE)):
        sn.write_checkpoint(sn.file_manifest(derive(spark, sf_dir, version, "orders"), name, modified="modified"), f"{folder}/{name}")
    return f"{folder}/cp1", f"{folder}/cp3"


@query("snapshot_tree_diff", _FEW)
def snapshot_tree_diff(spark, sf_dir):
    return sn.compare_checkpoints(spark, *_written(spark, sf_dir)).select("path", "change", "old_checksum", "new_checksum")


@query("snapshot_tree_ranges", f"SELECT DISTINCT left(sha256(path), 2) AS range FROM ({_FEW})")
def snapshot_tree_ranges(spark, sf_dir):
    return sn.changed_ranges(*[spark.read.parquet(f"{side}/tree") for side in _written(spark, sf_dir)])
