"""Near copies among documents by HyperMinHash.

A document is the set of its distinct word shingles.  Each shingle's 64-bit hash falls into one of
``REGISTERS`` buckets by its first bits; a bucket keeps its smallest remaining hash as the number of
leading zeros and the ten bits behind the first one, in 16 bits.  Neighbouring registers make a
band, and documents that agree in a band are compared: first by size and by the estimate from all
registers less the collisions that short registers make by chance, then on the full sets.

How many bands there are follows from the size of the set, so that two linked sets miss each other
with a chance of about ``MISS``: see ``band_plan``.

Documents with equal sets are one class from the start.  Every class is compared with the hub of each
of its buckets, the one that meets most others.  Most buckets are one component by then.  What a hub
leaves outside meets the hub's other members in blocks of bounded size, less those that their
distances from the hub rule out; so no link between agreeing documents is lost, a member stands once
in a cluster however many buckets it shares with the hub, and no group's pairs are written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm.common import Words, arrow_bytes, drop_tables, mix, send, small_batches, through_table
from wardenlake.llm.components import components

INDEX_BITS = 8
REGISTERS = 1 << INDEX_BITS
EMPTY = 65535
#: Chance that two sets just at the threshold agree in no band.
MISS = 3e-9
MANTISSA_BITS = 10
#: Standard deviations that the estimate may lie below the threshold before a pair is dropped.
SLACK = 6.0
#: Shingles in a block of a bucket, and members in one.
BLOCK_SHINGLES = 1 << 20
BLOCK_MEMBERS = 1024
FILTER_BITS = 1 << 26


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; with fewer words the whole sequence is one shingle."""
    words = Words(data, offsets)
    h, first, n = words.hashes, words.first, len(words.hashes)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        step = np.zeros(n, np.uint64)
        step[: n - k] = h[k:] if k else h
        run = run * np.uint64(0x9E3779B97F4A7C15) + (step ^ np.uint64(0xA5A5A5A5 + k))
    run = mix(run)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix(np.array([whole ^ x]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(run[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers a set."""
    out = np.full(len(sets) * REGISTERS, EMPTY, np.uint16)
    if sets:
        h = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * REGISTERS + (h >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        rest = (h & np.uint64((1 << (64 - INDEX_BITS)) - 1)).astype(np.float64)
        # a float's exponent is the place of the first one bit, its leading mantissa bits are those behind it
        code = (rest.view(np.int64) >> (52 - MANTISSA_BITS)) - (1023 << MANTISSA_BITS)
        np.minimum.at(out, at, np.maximum(code, 0).astype(np.uint16))
    return out.reshape(len(sets), REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of register rows, corrected for chance collisions, and how many registers it rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    large, small = np.maximum(size_a, size_b).astype(float), np.maximum(np.minimum(size_a, size_b), 1).astype(float)
    chance = np.where(same < used, collisions(large, small), 0)
    return np.clip(same - chance, 0, None) / np.maximum(used, 1), used


def collisions(large: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Registers in which two sets without a common element are expected to agree."""
    return 0.169919487159739093975315012348 * 2.0 ** (INDEX_BITS - MANTISSA_BITS) * 4 * (large / small) / (1 + large / small) ** 2


def bounds(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest similarity that the sizes and the estimate allow, SLACK deviations to each side.

    The registers sample the union without replacement, so in small sets they leave little to chance.
    """
    guess, used = estimate(a, b, size_a, size_b)
    small, large = np.minimum(size_a, size_b), np.maximum(np.maximum(size_a, size_b), 1)
    unseen = np.clip(1 - used * (1 + guess) / np.maximum(size_a + size_b, 1), 0.1, 1)
    # the variance is that at the end of the range that lies nearer to a half
    off = SLACK * np.sqrt(0.25 * unseen / np.maximum(used, 1)) + 0.02
    return np.clip(guess - off, 0, 1), np.minimum(np.clip(guess + off, 0, 1), small / large)


def plausible(a, b, size_a, size_b, percent: int) -> np.ndarray:
    """False only where the sizes exclude the threshold or the estimate lies SLACK deviations below it."""
    share = percent / 100
    guess, used = estimate(a, b, size_a, size_b)
    fits = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    unseen = np.clip(1 - used * (1 + share) / np.maximum(size_a + size_b, 1), 0.1, 1)
    return fits & (guess >= share - SLACK * np.sqrt(share * (1 - share) * unseen / np.maximum(used, 1)) - 0.02)


def sketch(docs: DataFrame, text: str, size: int, keep: list[Column]) -> DataFrame:
    """Each row's n_shingles, a 128-bit digest of its set and its registers."""
    carried = docs.select(*keep, F.col(text).alias("__text"))
    schema = carried.drop("__text").schema.add("n_shingles", "long").add("d1", "long").add("d2", "long").add("registers", "binary")

    def run(batches):
        for batch in batches:
            sets = shingles(*arrow_bytes(batch.column(batch.num_columns - 1)), size)
            d1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            d2 = [int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            rows = [r.tobytes() for r in registers(sets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(rows, pa.binary())], names=schema.names)

    return carried.mapInArrow(run, schema)


def _rows(column: pa.Array) -> np.ndarray:
    data, _ = arrow_bytes(column)
    return data.view(np.uint16).reshape(len(column), REGISTERS)


def band_plan(percent: int) -> list[int]:
    """The number of bands for each size class.

    Class c holds sets of at least q**-c shingles, q the threshold; the last class is open.  Sets that
    link lie in one class or in neighbouring ones, so a set is banded for its own class and the next.

    In a small set the D shingles by which two linked sets can differ spoil at most D bands, and the
    sets miss each other only if all their common shingles lie in those.  In a large set each register
    agrees with the chance q, and bands of equal width are chosen by the usual formula.
    """
    q, plan = percent / 100, []
    width = max(w for w in range(1, 9) if (1 - q**w) ** (REGISTERS // w) <= MISS or w == 1)
    most = REGISTERS // width
    if percent >= 100:
        return [1]
    while True:
        low, high = q ** -len(plan), q ** -(len(plan) + 1)
        differ = int((1 - q) * 2 * high / (1 + q)) + 1
        shared = max(q * low, 1.0)
        wanted = int(np.ceil(differ * min(MISS ** (-1 / shared), 1e6)))
        if low > REGISTERS / 2 and wanted >= most or low > 2 * REGISTERS:
            return [*plan, most]
        plan.append(min(wanted, REGISTERS))


def size_class(sizes: np.ndarray, percent: int, classes: int) -> np.ndarray:
    if classes == 1:
        return np.zeros(len(sizes), np.int64)
    return np.minimum(np.floor(np.log(np.maximum(sizes, 1)) / -np.log(percent / 100) + 1e-9).astype(np.int64), classes - 1)


def band_tables(rows: np.ndarray, sizes: np.ndarray, percent: int):
    """(class, row numbers, keys, used): the band keys of the rows that are banded for a class, and which bands hold anything."""
    plan = band_plan(percent)
    weights = np.random.default_rng(11).integers(1, 1 << 63, (2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    own = size_class(sizes, percent, len(plan))
    after = np.minimum(own + 1, len(plan) - 1)
    for c in np.unique(np.concatenate([own, after])):
        members = np.flatnonzero((own == c) | (after == c))
        starts = np.arange(plan[c]) * REGISTERS // plan[c]
        key = np.add.reduceat(mix(rows[members].astype(np.uint64) * weights[0] + weights[1]), starts, axis=1)
        used = np.maximum.reduceat(rows[members] != EMPTY, starts, axis=1)
        yield c, members, mix(key ^ (np.arange(plan[c], dtype=np.uint64) << np.uint64(16)) ^ np.uint64(c)), used


def band_keys(rows: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every band that holds anything."""
    at, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for _, members, key, used in band_tables(rows, sizes, percent):
        at.append(np.repeat(members, used.sum(axis=1)))
        keys.append(key[used])
    return np.concatenate(at), np.concatenate(keys)


def _bands(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, id) for each band of a class that holds anything."""

    def run(batches):
        for batch in batches:
            at, keys = band_keys(_rows(batch.column(1)), batch.column(2).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(batch.column(0).to_numpy()[at])], names=["bucket", "id"])

    return classes.select("id", "registers", "n_shingles").mapInArrow(run, "bucket long, id long")


def _bounds(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) with the similarity that registers and sizes allow: low and high, SLACK deviations around the estimate."""
    own = classes.select("id", "n_shingles", "registers")
    wide = pairs.join(own.toDF("u", "n_u", "r_u"), "u").join(own.toDF("v", "n_v", "r_v"), "v").select("u", "v", "n_u", "n_v", "r_u", "r_v")

    def run(batches):
        for b in batches:
            low, high = bounds(_rows(b.column(4)), _rows(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low), pa.array(high)], names=["u", "v", "low", "high"])

    return wide.mapInArrow(run, "u long, v long, low double, high double")


def mark_of(key: str | Column, text: str) -> Column:
    """One number for a key and a text: a key may stand with several texts."""
    return F.xxhash64((F.col(key) if isinstance(key, str) else key).cast("long"), F.col(text))


def _sets_of(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, shingles) of the documents whose keys and texts have these marks, one row a mark.

    A bitmap of fixed size over the hashed ids goes to the scan, so that the texts of other
    documents are skipped before they are shuffled; the join decides.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    # bucket numbers and positions of these functions count from one
    bits = ids.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    whole = np.zeros(FILTER_BITS // 8, np.uint8)  # the first bit of a byte is its lowest
    for n, part in zip(bits["n"].to_pylist(), bits["bits"].to_pylist()):
        whole[(n - 1) * 4096 : n * 4096] = np.frombuffer(part, np.uint8)
    receive = send(spark, whole)

    def run(batches):
        wanted = receive()
        for batch in batches:
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7)) & 1 == 1))
            if batch.num_rows:
                sets = shingles(*arrow_bytes(batch.column(2)), size)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "shingles"])

    named = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(mark_of(key, text).alias("id"), F.col(text).alias("t"))
    found = named.select("id", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("p"), "t").mapInArrow(run, "id long, shingles array<long>")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with the exact similarity of their full sets, and whether it reaches the threshold."""
    wide = pairs.join(sets.toDF("u", "s_u"), "u").join(sets.toDF("v", "s_v"), "v")
    both = F.size(F.array_intersect("s_u", "s_v"))
    wide = wide.select("u", "v", both.alias("both"), (F.size("s_u") + F.size("s_v") - both).alias("all"))
    return wide.select("u", "v", (F.col("both") / F.col("all")).alias("exact"), (100 * F.col("both") >= percent * F.col("all")).alias("linked"))


def _forest(members: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], sides: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between left and right members that join different groups, only as many as join them."""
    size = np.array([len(s) for s in sets])
    rows = registers(sets)
    parent = {int(g): int(g) for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    found = []
    for left, right in sides:
        for i in left:
            tried = right[groups[right] != groups[i]]
            for j in tried[plausible(rows[i], rows[tried], size[i], size[tried], percent)]:
                a, b = root(int(groups[i])), root(int(groups[j]))
                if a != b:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * shared >= percent * (size[i] + size[j] - shared):
                        parent[a] = b
                        found.append((int(members[i]), int(members[j])))
    return found


def _rest(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members of a hub that it left in several components.

    Rows are (hub, id, component, outside, part, parts): ``outside`` members are not in the hub's
    component and must meet all.  The parts of a cluster meet pairwise, one task group a pair of
    parts, and each group gives a forest of the links that it finds.
    """
    columns = ["hub", "id", "component", "outside", "part"]
    whole = clusters.where("parts = 1").select(*columns, F.lit(0).alias("a"), F.lit(0).alias("b"))
    pairs = clusters.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = whole.unionByName(pairs.select(*columns, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")))
    wide = cells.join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        members, outside, part = (table[c].to_numpy() for c in ("id", "outside", "part"))
        lists = table["shingles"].combine_chunks()
        values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets_ = [np.sort(values[x:y]) for x, y in zip(ends[:-1], ends[1:])]
        order = np.argsort(members)
        in_first = part[order] == table["a"][0].as_py()
        first, second = order[in_first], order[~in_first]
        sides = [(first[outside[first]], second), (second[outside[second]], first)] if len(second) else [(first[outside[first]], first)]
        found = _forest(members, table["component"].to_numpy(), sets_, sides, percent)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    return wide.groupBy("hub", "a", "b").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept, mark and first.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of ``size``-word
    shingles (lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``); component_id is the smallest key
    reachable, kept says whether that is the row's own key.  Null and empty texts have no shingles and
    link with nothing; very long texts count as a whole, one at a time; null keys stay alone with a
    null component and kept false.  Rows that repeat a key come out as often as they went in; each
    links by its own text, and components that have no link between them share an id where their
    smallest key is the same.  ``mark`` (``mark_of``) tells the texts of a key apart, and ``first`` is true
    for one key and text of each component: the smallest key, and of its texts that with the smallest mark.
    Ties fall to the smaller key.  An empty table gives no rows.  Other columns, whatever their
    names, are left out.
    """
    small_batches(docs.sparkSession)
    sketched = through_table(sketch(docs, text, size, [F.col(key).cast("long").alias("id"), mark_of(key, text).alias("mark")]), "sketches")
    same = sketched.where("n_shingles > 0 and id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("id", "mark")).alias("x"), F.min_by("registers", "id").alias("registers"))
    classes = through_table(same.select("d1", "d2", "n_shingles", F.col("x.id").alias("key"), F.col("x.mark").alias("id"), "registers"), "classes")
    rows = through_table(sketched.drop("registers"), "rows")
    drop_tables(sketched)
    links = class_links(docs, classes, key, text, size, percent)
    of = through_table(components(links).withColumnRenamed("node", "id").join(classes.select("id", "key"), "id"), "components")
    of = of.join(of.groupBy("component").agg(F.min(F.struct("key", "id")).alias("least")), "component").select("id", "least")
    named = classes.join(of, "id", "left").select("d1", "d2", "n_shingles", F.coalesce("least", F.struct("key", "id")).alias("least"))
    out = rows.join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.coalesce("least.key", "id")
    return out.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
        "mark", F.coalesce((F.col("least.key") == F.col("id")) & (F.col("least.id") == F.col("mark")), F.lit(True)).alias("first"))


def class_links(docs: DataFrame, classes: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that give the components of all links.

    The hub of a bucket is the member that meets most others over all its buckets, so one hub serves
    many buckets.  All that agree with one another have a hub in common: a hub's members, each named
    once, are one cluster.
    """
    share = percent / 100
    bands = through_table(_bands(classes, percent), "bands")
    several = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = through_table(bands.join(several, "bucket"), "crowded")
    degree = crowded.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = crowded.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id")).alias("h")).select("bucket", F.col("h.id").alias("hub"))
    star = through_table(crowded.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct(), "star")
    drop_tables(bands, crowded)

    bounded = through_table(_bounds(star, classes), "bounds")
    tried = bounded.where(F.col("high") >= share - 1e-9).select("u", "v")
    ends = tried.select(F.col("u").alias("id")).unionByName(tried.select(F.col("v").alias("id"))).distinct()
    sets = through_table(_sets_of(docs, ends, key, text, size), "sets")
    exact = through_table(_similar(tried, sets, percent), "exact")
    found = through_table(exact.where("linked").select("u", "v"), "found")

    # One minus the similarity is a metric: a member of the hub's component can link with one outside
    # only where their distances from the hub differ by no more than the threshold allows.
    of = through_table(components(found).withColumnRenamed("node", "id"), "star-components")
    known = bounded.join(exact, ["u", "v"], "left").select(
        F.col("u").alias("hub"), F.col("v").alias("id"), (1 - F.coalesce("exact", "high")).alias("near"), (1 - F.coalesce("exact", "low")).alias("far"))
    known = known.join(of, "id", "left").join(of.toDF("hub", "hub_component"), "hub", "left")
    known = known.withColumn("component", F.coalesce("component", "id")).withColumn("outside", F.col("component") != F.coalesce("hub_component", "hub"))
    known = through_table(known.select("hub", "id", "near", "far", "component", "outside"), "known")
    least = known.where("outside").groupBy("hub").agg(F.min("near").alias("least"))
    kept = known.join(least, "hub").where(F.col("outside") | (F.col("far") >= F.col("least") - (1 - share) - 1e-6))
    kept = through_table(kept.select("hub", "id", "component", "outside").join(classes.select("id", "n_shingles"), "id"), "kept")
    weight = kept.groupBy("hub").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("members"), F.min("component").alias("one"), F.max("component").alias("two"))
    parts = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_MEMBERS)).cast("int")
    cut = kept.join(weight.where("one <> two").select("hub", parts.alias("parts")), "hub").withColumn("part", F.pmod(F.xxhash64("id", "hub"), F.col("parts")).cast("int"))
    cut = through_table(cut.select("hub", "id", "component", "outside", "part", "parts"), "clusters")
    drop_tables(star, bounded, sets, exact, of, known, kept)
    more = through_table(_sets_of(docs, cut.select("id").distinct(), key, text, size), "more-sets")
    links = through_table(found.unionByName(_rest(cut, more, percent)), "class-links")
    drop_tables(found, cut, more)
    return links
