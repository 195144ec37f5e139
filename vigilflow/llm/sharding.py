"""Sharding by sampled splitters; DataFrame functions only. The law that holds is `bytes`.

The key is a 64-bit hash of the text, so equal texts are neighbours. A sample of keys, each drawn with a
chance in proportion to its size, gives splitters at its quantiles; these cut the keys into many small
ranges (RANGES for each shard). Measured in full, a range above twice its share is overfull: its large
groups of equal texts leave it as units of their own, and a group above a shard's fair size is cut
again by a number that each row gets once, so null and repeated ids are cut like others. Those units (totals of ranges and of groups above a range's share: SHARDS * 4096
each at most, 98,304 for 24 shards, whatever the input) are planned on the driver: they are
dealt to the emptiest shards, largest first, and the ranges fill what is left of each shard in key
order. So equal texts stay in one shard unless they alone exceed it, and sizes differ by about one range.

Slots are numbered by range totals and a window inside each piece of a range.

Defined results: null text: size of 8 bytes, crc32 of the empty string, one group of its own; a null id
sorts first; repeated rows each get a slot; no rows, no result; extra columns are ignored. Rows are numbered as they
are read: runs over equal files agree, and rows of one text may be cut elsewhere where files are split differently.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilflow.llm.common import written

SHARDS = 24
OVERHEAD = 8
#: Ranges for each shard, and keys that are sampled for each range.
RANGES, PER_RANGE = 64, 32
#: Equal cells of the key space, by which a key finds its range in a hash join.
CELLS_PER_RANGE = 2
#: Rows in one piece of a unit, which one window orders.
PIECE_ROWS = 20_000


def _cell(key: Column, cells: int) -> Column:
    """The cell, 0 to cells-1, of a signed 64-bit key; in whole numbers, so order is kept."""
    width = (1 << 64) // cells + 1
    return F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) / F.lit(max(1, width >> 32))).cast("int")


def splitters(slim: DataFrame, total: int, n_ranges: int) -> list[int]:
    """Quantiles of a size-weighted key sample of about n_ranges * PER_RANGE keys, fewer than n_ranges of them."""
    rate = n_ranges * PER_RANGE / max(total, 1)
    draw = (F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # A document of several shares counts as often as it holds one.
    sample = (
        slim.withColumn("share", F.col("size") * rate)
        .withColumn("times", (F.floor("share") + F.when(draw < F.col("share") - F.floor("share"), 1).otherwise(0)).cast("long"))
        .filter("times > 0")
        .groupBy("key")
        .agg(F.sum("times").alias("times"))
    )
    # Quantiles are cut where the keys are: running totals of blocks of keys, then inside each; the driver gets n_ranges keys at most.
    keys = written(sample, "shard-sample").withColumn("block", F.shiftright("key", 56))
    blocks = keys.groupBy("block").agg(F.sum("times").alias("n"))
    first = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("everything"))
    seen = keys.join(F.broadcast(first), "block").withColumn("seen", F.col("first") + F.sum("times").over(Window.partitionBy("block").orderBy("key")))
    cut = lambda total: F.floor(total * n_ranges / F.col("everything"))
    found = seen.filter((cut(F.col("seen")) > cut(F.col("seen") - F.col("times"))) & (F.col("seen") < F.col("everything"))).select("key")
    return sorted(r["key"] for r in found.collect())


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A plan's rows as a table: Arrow data that the JVM reads itself, so no Python worker starts."""
    kinds = {"int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, columns, strict=True)}), schema)


def _range_table(spark: SparkSession, bounds: list[int], cells: int) -> DataFrame:
    """(cell, range, low, high): a range holds low < key <= high, listed under each cell that it meets."""
    low = [-(1 << 63) - 1, *bounds]
    high = [*bounds, (1 << 63) - 1]
    rows = [(i, None if i == 0 else low[i], high[i]) for i in range(len(high))]
    table = _table(spark, rows, "range int, low long, high long")
    first = F.coalesce(_cell(F.col("low"), cells), F.lit(0))
    return table.withColumn("cell", F.explode(F.sequence(first, _cell(F.col("high"), cells))))


def _deal(units: list[tuple], total: int, shards: int) -> tuple[dict, list[int]]:
    """Whole units to the emptiest shard, largest first; what each shard then holds."""
    heap, to = [(0, s) for s in range(shards)], {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        to[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    held = [0] * shards
    for load, shard in heap:
        held[shard] = load
    return to, held


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row a document: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("key"),
        # A number of each row's own: what is dealt by it is spread whatever the ids are.
        F.monotonically_increasing_id().alias("row"),
    )
    slim = written(slim, "shard-keys")
    whole = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    total, n_rows = whole["bytes"], whole["rows"]
    # More rows, more ranges, so that no range outgrows a task; the sample and the plan stay bounded.
    per_shard = min(4096, max(RANGES, n_rows // (shards * 10 * PIECE_ROWS)))
    n_ranges = shards * per_shard
    bounds = splitters(slim, total, n_ranges)
    cells = CELLS_PER_RANGE * n_ranges
    # Two rows a range at most on average: bounded by the parameters, so it may be broadcast.
    ranges = F.broadcast(_range_table(spark, bounds, cells))
    inside = (F.col("key") <= F.col("high")) & (F.col("low").isNull() | (F.col("key") > F.col("low")))
    ranged = slim.withColumn("cell", _cell(F.col("key"), cells)).join(ranges, "cell").filter(inside).drop("cell", "low", "high")
    ranged = written(ranged, "shard-ranges")

    share = max(1, total // n_ranges)
    sums = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    overfull = [r for r, (b, _) in sums.items() if b > 2 * share]
    large: dict[int, tuple[int, int, int]] = {}
    if overfull:
        # The ranges above twice their share; of their groups, those above one share: at most n_ranges.
        some = F.broadcast(_table(spark, [(r,) for r in overfull], "range int"))
        groups = ranged.join(some, "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).filter(F.col("bytes") > share)
        large = {r["key"]: (r["range"], r["bytes"], r["rows"]) for r in groups.collect()}
    # A group above a shard's fair size is cut into cuts of about one share by the rows' numbers.
    fair = total / shards
    cuts = {k: (-(-b // share) if b > fair else 1) for k, (_, b, _) in large.items()}
    cut_rows = _table(spark, [(k, int(c)) for k, c in cuts.items()], "key long, cuts int")
    part = F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("row", F.lit(11)), F.col("cuts"))).otherwise(0).cast("int")
    parted = ranged.join(F.broadcast(cut_rows), "key", "left").withColumn("group", F.when(F.col("cuts").isNotNull(), F.col("key"))).withColumn("part", part)
    units: list[tuple] = []
    split = [k for k, c in cuts.items() if c > 1]
    if split:
        measured = parted.filter(F.col("cuts") > 1).groupBy("key", "part").agg(F.sum("size").alias("bytes")).collect()
        units += [((r["key"], r["part"]), r["bytes"]) for r in measured]
    units += [((k, 0), large[k][1]) for k, c in cuts.items() if c == 1]
    to, held = _deal(units, total, shards)
    # The ranges, less their large groups, fill each shard up to an even level, in key order.
    light = {r: b for r, (b, _) in sums.items()}
    for r, b, _ in large.values():
        light[r] -= b
    rest = sum(light.values())
    level = total / shards
    for _ in range(shards):
        under = [h for h in held if h < level]
        level = (rest + sum(under)) / max(1, len(under))
    room, ends = [max(0.0, level - h) for h in held], []
    for r in room:
        ends.append((ends[-1] if ends else 0.0) + r)
    homes, seen, at = [], 0, 0
    for r in sorted(light):
        middle = seen + light[r] / 2
        while at < shards - 1 and middle > ends[at]:
            at += 1
        homes.append((r, None, 0, at))
        seen += light[r]
    homes += [(None, k, p, s) for (k, p), s in to.items()]
    plan = _table(spark, homes, "p_range int, p_group long, p_part int, shard int")
    light_plan = F.broadcast(plan.filter("p_range is not null").select(F.col("p_range").alias("range"), F.col("shard").alias("light_shard")))
    large_plan = F.broadcast(plan.filter("p_range is null").select(F.col("p_group").alias("group"), F.col("p_part").alias("part"), F.col("shard").alias("large_shard")))
    placed = parted.join(large_plan, ["group", "part"], "left").join(light_plan, "range", "left").withColumn("shard", F.coalesce("large_shard", "light_shard"))
    # Slots: pieces of bounded rows in each (range, group, part), numbered by totals and then inside.
    biggest = max([rows for _, rows in sums.values()], default=1)
    pieces = max(1, -(-biggest // PIECE_ROWS))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("row", F.lit(13)), F.lit(pieces)).cast("int"))
    by = ["shard", "range", "group", "part", "piece"]
    counts = placed.groupBy(*by).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", F.col("group").asc_nulls_first(), "part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in by], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy(*by).orderBy("key", F.col("id").asc_nulls_first(), "row")
    numbered = placed.withColumn("rn", F.row_number().over(order))
    match = (F.col("group").eqNullSafe(F.col("c_group"))) & (F.col("shard") == F.col("c_shard")) & (F.col("range") == F.col("c_range")) & (F.col("part") == F.col("c_part")) & (F.col("piece") == F.col("c_piece"))
    return numbered.join(counts, match).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The rows of docs, all columns, with their shard, slot and size_bytes; these replace columns of the same names.

    Rows are matched to their places by id, text hash and, among equal ones, a number; one shuffle moves the rows.
    """
    named = F.col(id_col)
    places = shard(docs, id_col, text_col, shards)
    one = Window.partitionBy("__id", "__crc", "__bytes")
    places = places.select(named.alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__bytes"), "shard", "slot")
    places = places.withColumn("__turn", F.row_number().over(one.orderBy("shard", "slot")))
    text = F.col(text_col)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    rows = docs.select(*[c for c in docs.columns if c not in ("shard", "slot", "size_bytes")], named.alias("__id"), crc.alias("__crc"), size.alias("__bytes"))
    # Rows that repeat a document are numbered by all they hold, so that a task that is run again agrees.
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = rows.withColumn("__turn", F.row_number().over(one.orderBy(F.xxhash64(*[F.col(c) for c in hashable if c in rows.columns]))))
    p = places.select(*[F.col(c).alias(f"{c}_p") for c in ("__id", "__crc", "__bytes", "__turn")], "shard", "slot")
    match = F.col("__id").eqNullSafe(F.col("__id_p")) & (F.col("__crc") == F.col("__crc_p")) & (F.col("__bytes") == F.col("__bytes_p")) & (F.col("__turn") == F.col("__turn_p"))
    joined = rows.join(p, match)
    kept = [c for c in rows.columns if not c.startswith("__")]
    return joined.select(*kept, F.col("__bytes").alias("size_bytes"), "shard", "slot")
