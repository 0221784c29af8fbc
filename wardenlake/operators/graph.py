"""Dependency graph, waves, plan checks and schedule for a whole portfolio at once."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.functions.text import let
from wardenlake.functions.windows import number_rows
from wardenlake.session import cut_and_count

# Import forms of JavaScript, group 1 is the module.
SCRIPT_IMPORTS = [r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)", r"import\s+['\"]([^'\"]+)['\"]"]
SCRIPT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
PLAIN_LEVELS = 6  # levels that are taken off one by one before chains are shortened
FAR = 1 << 40  # longer than any chain; lengths that run round a cycle stop here
HOURS_PER_FILE, CYCLE_FACTOR, LATER_WAVE_FACTOR = 0.5, 1.5, 1.2


def import_edges(files: DataFrame, structures: DataFrame) -> DataFrame:
    """file → imported module; relative imports are left out."""
    python = structures.filter("parsed").select("project", F.col("path").alias("src"), F.explode(F.transform("imports", lambda i: i["module"])).alias("dst"))
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in SCRIPT_IMPORTS])
    script = files.filter(F.col("ext").isin(SCRIPT_EXTENSIONS)).select("project", F.col("path").alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    return python.unionByName(script).filter((F.col("dst") != "") & ~F.col("dst").startswith(".")).distinct()


def module_name(path: Column) -> Column:
    """The name other files import: the file name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def module_names(path: Column) -> Column:
    """All dotted names under which a file may be imported: each end of its path, a package by its folder."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"/__init__$", "")
    return let(F.filter(F.split(bare, "/"), lambda s: s != ""), lambda parts: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def resolve_modules(edges: DataFrame, files: DataFrame, across_projects: bool = False) -> DataFrame:
    """Replace a module by the file that provides it; other modules stay external.

    A file provides the dotted names that end its path: ``a/b.py`` and ``a/b/__init__.py`` are both
    ``a.b`` and ``b``; slashes in a module count as dots.  Of several files of a name the one nearest
    to the root is taken, then the first by path, and the edge is marked ambiguous.  A popular module may be
    imported by a third of all files.  The module side has one row per name, so AQE can split the hot
    partition of the edge side, and no importer meets more than one file.
    """
    keys = [] if across_projects else ["project"]
    provided = (files.select(*keys, F.explode(module_names(F.col("path"))).alias("_name"), F.struct(F.size(F.split("path", "/")).alias("depth"), "path").alias("_at"))
                .groupBy(*keys, "_name").agg(F.min("_at")["path"].alias("_file"), (F.min("_at.path") < F.max("_at.path")).alias("_several")))
    return edges.withColumn("_name", F.translate("dst", "/", ".")).join(provided, [*keys, "_name"], "left").select(
        "project", "src", F.coalesce("_file", "dst").alias("dst"), F.col("_file").isNotNull().alias("internal"), F.coalesce("_several", F.lit(False)).alias("ambiguous"))


def graph_nodes(files: DataFrame, edges: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """File nodes with their metrics and the external endpoints."""
    nodes = files.select("project", F.col("path").alias("id"), F.lit("file").alias("type"))
    if structures is not None:
        metrics = structures.select("project", F.col("path").alias("id"), F.col("line_count").alias("size"), "complexity",
                                    F.size("functions").alias("functions"), F.size("classes").alias("classes"))
        nodes = nodes.join(metrics, ["project", "id"], "left")
    external = edges.select("project", F.col("dst").alias("id")).distinct().join(files.select("project", F.col("path").alias("id")), ["project", "id"], "left_anti")
    return nodes.unionByName(external.withColumn("type", F.lit("external")), allowMissingColumns=True)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("project", F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select("project", F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("project", "id").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def graph_statistics(nodes: DataFrame, edges: DataFrame, waves: DataFrame | None = None) -> DataFrame:
    """Node and edge counts, mean degree 2E/N, density E/(N(N-1)), cycle flag from the wave leftovers."""
    n = nodes.groupBy("project").agg(F.count("*").alias("total_nodes"), F.sum((F.col("type") == "file").cast("int")).alias("file_nodes"))
    e = edges.groupBy("project").agg(F.count("*").alias("total_edges"))
    total, links = F.col("total_nodes"), F.col("total_edges")
    stats = (n.join(e, "project", "left").fillna({"total_edges": 0}).withColumn("external_nodes", total - F.col("file_nodes"))
             .withColumn("average_degree", 2 * links / F.greatest(total, F.lit(1)))
             .withColumn("density", F.when(total > 1, links / (total * (total - 1))).otherwise(0.0)))
    if waves is None:
        return stats
    cyclic = waves.groupBy("project").agg(F.bool_or("cyclic").alias("circular_dependencies"))
    return stats.join(cyclic, "project", "left").fillna({"circular_dependencies": False})


def _contract(rows: DataFrame) -> DataFrame:
    """One round over ``rows``: an edge ``id -> dst`` of length w, or without dst a known length w of chains below ``id``.

    An edge takes over the known length of its target.  It goes where the target has no edges left,
    and leads on to the next node where the target has one edge only, so chains halve.  No edge becomes two.
    """
    state = rows.select("project", F.col("dst").alias("_next"), F.col("id").alias("dst"), "w").groupBy("project", "dst").agg(
        F.max(F.when(F.col("_next").isNull(), F.col("w"))).alias("_base"), F.count("_next").alias("_open"),
        F.max("_next").alias("_next"), F.max(F.when(F.col("_next").isNotNull(), F.col("w"))).alias("_far"))
    single = F.col("_open") == 1
    known = F.struct(F.lit(None).cast("string").alias("dst"), F.least(F.col("w") + F.col("_base"), F.lit(FAR)).alias("w"))
    onward = F.struct(F.when(single, F.col("_next")).otherwise(F.col("dst")).alias("dst"),
                      F.when(single, F.least(F.col("w") + F.col("_far"), F.lit(FAR))).otherwise(F.col("w")).alias("w"))
    moved = rows.filter("dst IS NOT NULL").join(state, ["project", "dst"]).select("project", "id", F.inline(F.array_compact(F.array(known, F.when(F.col("_open") > 0, onward)))))
    return rows.filter("dst IS NULL").unionByName(moved).groupBy("project", "id", "dst").agg(F.max("w").alias("w"))


def _levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Rows as in ``_contract`` when no edge leads to a node without edges any more, and the number of edges left.

    The first ``PLAIN_LEVELS`` rounds keep the edges whose target still needs something itself, which is
    cheap; what is deeper is contracted.  Edges that are left belong to nodes in or behind a cycle.  While
    any other node has edges, some edge ends at a node without, and that edge goes; so an unchanged
    number means the end.
    """
    ids, one = nodes.select("project", "id").distinct(), F.lit(1).cast("long").alias("w")
    remaining, left = cut_and_count(
        edges.select("project", F.col("src").alias("id"), "dst").distinct().join(ids, ["project", "id"], "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi").select("project", "id", "dst"))
    known, level, before = ids.withColumn("w", F.lit(0).cast("long")), 0, None
    while left and left != before and level < PLAIN_LEVELS:
        holders = remaining.select("project", F.col("id").alias("dst")).distinct()
        following, now = cut_and_count(remaining.join(holders, ["project", "dst"], "left_semi").select("project", "id", "dst"))
        if now != left:
            level += 1
            known = known.unionByName(remaining.select("project", "id", F.lit(level).cast("long").alias("w")))
        remaining, left, before = following, now, left
    rows = remaining.select("project", "id", "dst", one)
    if left and left != before:  # every node that is left has chains of that many levels below it
        ends = remaining.select("project", F.explode(F.array("id", "dst")).alias("id")).distinct()
        rows, before = rows.unionByName(ends.select("project", "id", F.lit(None).cast("string").alias("dst"), F.lit(level).cast("long").alias("w"))), None
        while left and left != before:
            before = left
            rows, left = cut_and_count(_contract(rows), F.col("dst"))
    known = known.unionByName(rows.filter("dst IS NULL").select("project", "id", "w")).groupBy("project", "id").agg(F.max("w").alias("w"))
    return known.withColumn("dst", F.lit(None).cast("string")).unionByName(rows.filter("dst IS NOT NULL")), left


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Wave of each node: dependencies first; nodes in or behind a cycle get one wave each, after the rest.

    ``edges`` point from a file to what it needs.  A node's wave is the length of the longest chain
    below it.  Each round takes away the edges to finished nodes, for all projects together, and beyond
    the first few levels also shortens chains: a plain chain of n nodes takes about log2(n) rounds more,
    a mesh one a level.  The edges are written out each round, and the driver sees only their count.  The join streams the edge side, so
    a module that a third of all files import is split, not gathered.
    """
    rows, left = _levels(nodes, edges)
    stuck = rows.filter("dst IS NOT NULL").select("project", "id").distinct()
    known = rows.filter("dst IS NULL").select("project", "id", F.col("w").cast("int").alias("wave"), F.lit(False).alias("cyclic"))
    level = known.join(stuck, ["project", "id"], "left_anti") if left else known
    if not left:
        return level
    last = level.groupBy("project").agg(F.max("wave").alias("_last"))
    # Their order is free; by digest it splits into 4096 even segments per project.
    hashed = stuck.withColumn("_digest", F.md5("id"))
    ordered = number_rows(hashed, ["project"], ["_digest", "id"], F.substring("_digest", 1, 3))
    behind = ordered.join(last, "project", "left").select(
        "project", "id", (F.coalesce("_last", F.lit(-1)) + F.col("ordinal")).cast("int").alias("wave"), F.lit(True).alias("cyclic"))
    return level.unionByName(behind)


def _smallest_behind(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, label): the smallest id of all nodes that reach a node, itself included.

    Whoever reaches a node's label reaches the node, so labels also take the label of their label and
    long paths are covered in few rounds.
    """
    labels, changed = ids.select("project", "id", F.col("id").alias("label")), 1
    while changed:
        handed = edges.join(labels.select("project", F.col("id").alias("src"), "label"), ["project", "src"]).select("project", F.col("dst").alias("id"), "label")
        near = (labels.withColumn("_old", F.col("label")).unionByName(handed, allowMissingColumns=True)
                .groupBy("project", "id").agg(F.min("label").alias("label"), F.max("_old").alias("_old")))
        further = near.select("project", F.col("id").alias("label"), F.col("label").alias("_further"))
        new = near.join(further, ["project", "label"]).select("project", "id", F.col("_further").alias("label"), "_old")
        new, changed = cut_and_count(new, F.when(F.col("label") != F.col("_old"), 1))
        labels = new.drop("_old")
    return labels


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, cycle) of the nodes that no plan can order: ``cycle`` is the smallest id of all nodes that need each
    other with this one, or null for a node that only waits behind a cycle.

    Nodes are coloured by the smallest id that reaches them; those of a colour that reach its id
    in turn are one strongly connected component and leave, and edges between colours can't be in a
    cycle.  Every round takes at least the component of each colour's id.  A node that needs itself is a cycle.
    """
    rows, left = _levels(nodes, edges)
    stuck = rows.filter("dst IS NOT NULL").select("project", "id").distinct()
    members = stuck.limit(0).withColumn("cycle", F.lit(None).cast("string"))
    inner = edges.select("project", "src", "dst").distinct()
    for end in ("src", "dst"):
        inner = inner.join(stuck.withColumnRenamed("id", end), ["project", end], "left_semi")
    remaining, left = cut_and_count(inner) if left else (inner, 0)
    while left:
        ids = remaining.select("project", F.col("src").alias("id")).union(remaining.select("project", "dst")).distinct()
        colour = _smallest_behind(ids, remaining).withColumnRenamed("label", "_colour")
        tinted = remaining
        for end in ("src", "dst"):
            tinted = tinted.join(colour.withColumnsRenamed({"id": end, "_colour": f"_{end}"}), ["project", end])
        tinted = tinted.filter("_src = _dst").select("project", "src", "dst", F.col("_src").alias("_colour"))
        back = _smallest_behind(ids, tinted.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")))
        for end in ("src", "dst"):
            tinted = tinted.join(back.withColumnsRenamed({"id": end, "label": f"_{end}"}), ["project", end])
        tinted, _ = cut_and_count(tinted.filter("_src = _dst"))
        found = tinted.filter("_src = _colour")
        members = members.unionByName(found.select("project", F.explode(F.array("src", "dst")).alias("id"), F.col("_colour").alias("cycle")))
        remaining, left = cut_and_count(tinted.filter("_src <> _colour").select("project", "src", "dst"))
    return stuck.join(members.distinct(), ["project", "id"], "left")


def plan_estimate(stats: DataFrame) -> DataFrame:
    cyclic = F.col("circular_dependencies")
    return stats.select(
        "project", (F.col("file_nodes") * HOURS_PER_FILE * F.when(cyclic, CYCLE_FACTOR).otherwise(1.0)).alias("estimated_duration"),
        F.when(cyclic | (F.col("density") > 0.3), "HIGH").when(F.col("average_degree") > 5, "MEDIUM").otherwise("LOW").alias("risk_level"))


def apply_overrides(plan: DataFrame, overrides: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Move files to another wave, add files that are not planned yet, drop removed ones."""
    moved = overrides.select("project", "path", F.col("wave").alias("_wave"))
    out = plan.join(moved, ["project", "path"], "full_outer").select("project", "path", F.coalesce("_wave", "wave").alias("wave"))
    return out if removals is None else out.join(removals.select("project", "path"), ["project", "path"], "left_anti")


def reorder_waves(plan: DataFrame, order: DataFrame) -> DataFrame:
    """``order(project, wave, new_wave)`` renames whole waves."""
    return (plan.join(order, ["project", "wave"], "left").withColumn("wave", F.coalesce("new_wave", "wave")).drop("new_wave"))


def wave_details(plan: DataFrame, files: DataFrame) -> DataFrame:
    """File and line counts, hours at 1000 lines each; ``files`` has line_count."""
    lines = files.select("project", "path", "line_count")
    per = plan.join(lines, ["project", "path"], "left").groupBy("project", "wave").agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    return per.withColumn("estimated_hours", F.col("total_lines") / 1000).withColumn("average_lines_per_file", F.col("total_lines") / F.greatest("file_count", F.lit(1)))


def plan_violations(plan: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Errors (file in several waves) and warnings (empty wave, missing file, dependency in a later wave)."""
    copies = plan.groupBy("project", "path").agg(F.count("*").alias("n")).filter("n > 1").select(
        "project", F.lit("error").alias("kind"), F.lit("duplicate_file").alias("rule"), F.col("path").alias("subject"))
    missing = plan.select("project", "path").distinct().join(files.select("project", "path"), ["project", "path"], "left_anti").select(
        "project", F.lit("warning").alias("kind"), F.lit("missing_file").alias("rule"), F.col("path").alias("subject"))
    numbers = plan.select("project", "wave").distinct()
    following = F.lead("wave").over(Window.partitionBy("project").orderBy("wave"))
    empty = (numbers.withColumn("_next", following).filter(F.col("_next") - F.col("wave") > 1)
             .select("project", F.explode(F.sequence(F.col("wave") + 1, F.col("_next") - 1)).alias("w"))
             .select("project", F.lit("warning").alias("kind"), F.lit("empty_wave").alias("rule"), F.col("w").cast("string").alias("subject")))
    of_src = plan.select("project", F.col("path").alias("src"), F.col("wave").alias("w1"))
    of_dst = plan.select("project", F.col("path").alias("dst"), F.col("wave").alias("w2"))
    late = (edges.join(of_src, ["project", "src"]).join(of_dst, ["project", "dst"]).filter("w1 < w2")
            .select("project", F.lit("warning").alias("kind"), F.lit("late_dependency").alias("rule"), F.concat_ws(" -> ", "src", "dst").alias("subject")))
    return copies.unionByName(missing).unionByName(empty).unionByName(late)


def plan_verdict(violations: DataFrame, plan: DataFrame) -> DataFrame:
    found = violations.groupBy("project").agg(F.sum((F.col("kind") == "error").cast("int")).alias("errors"), F.sum((F.col("kind") == "warning").cast("int")).alias("warnings"))
    sizes = plan.groupBy("project", "wave").agg(F.count("*").alias("n")).groupBy("project").agg(F.sum("n").alias("total_files"), F.count("*").alias("total_waves"))
    return (sizes.join(found, "project", "left").fillna({"errors": 0, "warnings": 0}).withColumn("valid", F.col("errors") == 0))


# --- schedule -------------------------------------------------------------------------
# Work time is counted in tenths of an hour: a file takes 5 (6 after the first wave) and
# a working day, 9 to 17 o'clock, has 80.  The pause of one clock hour after a wave costs
# 10, but never crosses the end of the day.
DAY, PAUSE = 80, 10
#: Waves in a segment, and segments in a block.
SEGMENT, BLOCK = 512, 256


def _after_pause(end: Column) -> Column:
    return end + F.least(F.lit(PAUSE), F.pmod(F.lit(DAY) - F.pmod(end, F.lit(DAY)), F.lit(DAY)))


def _calendar_day(index: Column, start: date, work_days_only: bool) -> Column:
    if not work_days_only:
        return F.date_add(F.lit(start), index.cast("int"))
    weekday = start.weekday()
    first = 7 - weekday if weekday >= 5 else 0
    base = 0 if weekday >= 5 else weekday
    return F.date_add(F.lit(start), (index + first + 2 * F.floor((index + base) / 5)).cast("int"))


def _clock(units: Column, start: date, work_days_only: bool) -> Column:
    """End instant of a wave; the end of a day is 17:00 of that day."""
    index, rest = F.floor((units - 1) / DAY), F.pmod(units - 1, F.lit(DAY)) + 1
    day = _calendar_day(index, start, work_days_only).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.lit(9), (rest * 6).cast("int"))


def _chain(maps: Column, begin: Column) -> Column:
    """Where each of the maps starts when they follow one another from ``begin``, and where the last one ends."""
    return F.aggregate(
        maps, F.struct(begin.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, m: F.struct((acc["at"] + F.get(m["_moved"], F.pmod(acc["at"], F.lit(DAY)).cast("int"))).alias("at"),
                                F.concat(acc["out"], F.array(acc["at"])).alias("out")))


def _segment_starts(segments: DataFrame, offset: int) -> DataFrame:
    """(project, _segment, _begin): a prefix scan in two levels over maps of the 80 day positions.

    The maps of ``BLOCK`` segments compose to one, the blocks of a project are chained, and each
    block's segments are then chained from its start.  No group holds more than a block of segments,
    or a project's blocks, of which there is one for each 131,072 waves.
    """
    blocks = segments.groupBy("project", F.floor(F.col("_segment") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_segment", "_moved"))).alias("_maps"))
    whole = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(DAY - 1).cast("bigint")), lambda s: F.aggregate(
        F.col("_maps"), s, lambda c, m: c + F.get(m["_moved"], F.pmod(c, F.lit(DAY)).cast("int"))) - s)
    chains = blocks.select("project", "_block", whole.alias("_moved")).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("_block", "_moved"))).alias("_blocks"))
    starts = chains.select("project", F.explode(F.arrays_zip(F.transform("_blocks", lambda x: x["_block"]).alias("b"), _chain(F.col("_blocks"), F.lit(offset))["out"].alias("at"))).alias("r"))
    inside = blocks.join(starts.select("project", F.col("r.b").alias("_block"), F.col("r.at").alias("_at")), ["project", "_block"])
    return inside.select("project", F.explode(F.arrays_zip(F.transform("_maps", lambda x: x["_segment"]).alias("s"), _chain(F.col("_maps"), F.col("_at"))["out"].alias("at"))).alias("r")).select(
        "project", F.col("r.s").alias("_segment"), F.col("r.at").alias("_begin"))


def timeline(plan: DataFrame, start: datetime, work_days_only: bool = True) -> DataFrame:
    """Start, end and hours of each wave (project, wave = 0, 1, …).

    Each wave starts when the one before it ends, so times chain.  The chain only
    depends on the position inside the working day, which has 80 values: a segment
    of 512 waves is folded once from each of them, the segment results are chained in
    two levels, and the waves of a segment are then filled in.  No group holds all waves.
    """
    minutes = (start.hour - 9) * 60 + start.minute
    weekend = work_days_only and start.weekday() >= 5
    if minutes % 6 or start.second or start.microsecond:
        raise ValueError("the start must lie on the six-minute grid")
    offset = 0 if weekend else min(max(minutes // 6, 0), DAY)
    per = plan.groupBy("project", "wave").agg(F.count("*").alias("file_count"))
    ordered = number_rows(per, ["project"], ["wave"], F.floor(F.col("wave") / SEGMENT), "_nth").withColumn("_nth", F.col("_nth") - 1)
    units = F.col("file_count") * F.when(F.col("_nth") == 0, 5).otherwise(6)
    shaped = ordered.withColumn("_units", units.cast("bigint")).withColumn("_segment", F.floor(F.col("_nth") / SEGMENT))
    folded = shaped.groupBy("project", "_segment").agg(F.sort_array(F.collect_list(F.struct("_nth", "_units", "wave", "file_count"))).alias("_waves"))
    # Units that pass from each start position to the start of the next segment.
    moved = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(DAY - 1).cast("bigint")), lambda s: F.aggregate(
        F.col("_waves"), s, lambda c, w: _after_pause(c + w["_units"])) - s)
    chained = folded.join(_segment_starts(folded.select("project", "_segment", moved.alias("_moved")), offset), ["project", "_segment"])
    filled = F.aggregate(
        F.col("_waves"), F.struct(F.col("_begin").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("out")),
        lambda acc, w: let(acc["at"] + w["_units"], lambda end: F.struct(
            _after_pause(end).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("begin"), end.alias("end")))).alias("out"))))
    rows = chained.select("project", F.explode(F.arrays_zip(F.col("_waves").alias("w"), filled["out"].alias("t"))).alias("r"))
    first_day = start.date()
    out = rows.select("project", F.col("r.w.wave").alias("wave"), F.col("r.w._nth").alias("position"), F.col("r.w.file_count").alias("file_count"),
                      (F.col("r.w._units") / 10).alias("duration_hours"), _clock(F.col("r.t.end"), first_day, work_days_only).alias("end"), F.col("r.t.begin").alias("_begin"))
    # A wave is shown to start one clock hour after the one before it, even outside working hours.
    shown = out.select("project", (F.col("position") + 1).alias("position"), (F.col("end") + F.expr("INTERVAL 1 HOUR")).alias("start"))
    return (out.drop("_begin").join(shown, ["project", "position"], "left")
            .withColumn("start", F.coalesce("start", F.lit(start).cast("timestamp_ntz"))))


def milestones(schedule: DataFrame, migration_type: str) -> DataFrame:
    """Start, end of each wave, finish."""
    begin = schedule.filter("position = 0").select("project", F.lit("Migration Start").alias("title"), F.col("start").alias("date"), F.lit("start").alias("type"),
                                                   F.lit(f"Start {migration_type} migration").alias("description"))
    each = schedule.select("project", F.concat(F.lit("Wave "), (F.col("position") + 1).cast("string"), F.lit(" Complete")).alias("title"), F.col("end").alias("date"),
                           F.lit("milestone").alias("type"), F.concat(F.lit("Completed "), F.col("file_count").cast("string"), F.lit(" files")).alias("description"))
    finish = schedule.groupBy("project").agg(F.max("end").alias("date")).select(
        "project", F.lit("Migration Complete").alias("title"), "date", F.lit("end").alias("type"), F.lit(f"{migration_type} migration completed").alias("description"))
    return begin.unionByName(each).unionByName(finish)


def gantt(schedule: DataFrame) -> DataFrame:
    """Bar rows with the id of the wave before; positions are dense, so no window is needed."""
    name = F.concat(F.lit("wave-"), F.col("position").cast("string"))
    before = F.when(F.col("position") > 0, F.concat(F.lit("wave-"), (F.col("position") - 1).cast("string")))
    return schedule.select("project", name.alias("id"), "start", "end", F.col("duration_hours").alias("duration"), before.alias("dependency"), "file_count")


def set_progress(schedule: DataFrame, progress: DataFrame) -> DataFrame:
    clamped = progress.select("project", "wave", F.least(F.lit(100.0), F.greatest(F.lit(0.0), "percentage")).alias("progress"))
    return schedule.join(clamped, ["project", "wave"], "left").fillna({"progress": 0.0})


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import one of the changed files, by exact module."""
    modules = changed.select("project", module_name(F.col("path")).alias("dst"), F.col("path").alias("changed_path"))
    return edges.join(modules, ["project", "dst"]).select("project", F.col("src").alias("path"), "changed_path").distinct()
