"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each source's documents are shuffled by a hash of their id. A document's virtual finish time is the
words of its source up to and including it, over the source's target; a source whose target is above
its size is read again, up to REPEATS times in all. The copies of all sources are range-sorted by
finish time and cut where their words reach the total budget (the words of all sources together).

Running totals take two levels, so no task ever orders a whole source or the whole mix: totals of
hash buckets (or of finish-time buckets), a running total over those few rows, then a window inside
each bucket.

Defined results: a null text has size 0; a null source is a source of its own, the last; a null id
hashes as its text; repeated rows are documents of their own; no rows, no result. Columns of
the input other than id, text and source are ignored, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilflow.llm.common import written

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows that one window bucket holds on average.
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Each source's target from rows (source, source_size): one row a source, so windows over all are small.

    Shares of the total by weight; a target stops at repeats times the source's size and the excess goes
    to the others by weight, until none is above. In closed form: sources in order of cap/weight stop at
    their caps until the level that the rest can share evenly is not above the next cap/weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_rank"))
    level = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(Window.partitionBy())["level"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return level.select("source", "source_rank", "source_size", "total", target.alias("target"))


def running(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], amount: str, out: str) -> DataFrame:
    """A running total of amount in each group over (bucket, order): bucket totals first, then inside each bucket."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*groups, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_inside", F.sum(amount).over(inside))
    return summed.join(totals, [*groups, "_bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside", "_sum")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row a document: id, size, source_rank, source_size, target, taken, first_finish (of its first copy in the mix).

    taken is size times the copies that the mix reads, 0 to repeats; the mix reads them in order of finish time.
    """
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))).alias("shuffle_key"),
    )
    slim = written(slim, "mix-sizes")
    goals = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "mix-targets")
    n_rows = slim.count()
    digits = next(d for d in range(1, 9) if 16**d * BUCKET_ROWS >= n_rows or d == 8)
    n_buckets = max(1, -(-repeats * n_rows // BUCKET_ROWS))
    # One row a source: the smaller side by far. From here on ranks stand for sources, as they have no nulls.
    goal = goals.withColumnRenamed("source", "_s")
    slim = slim.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    order = [F.col(c) for c in ("shuffle_key", "id", "size")]
    # Documents without words take no time, and without id and text they all have one key: they stay out of the order.
    wordless, slim = slim.filter("size = 0"), slim.filter("size > 0")
    slim = running(slim, ["source_rank"], F.substring("shuffle_key", 1, digits), order, "size", "finish_words")
    # Rows that repeat a document in full share a key; their finish times still differ where they have words.
    slim = written(slim, "mix-order")
    copies = (
        slim.filter(F.col("target") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("finish_words")) / F.col("target"))
        .withColumn("all", F.lit(0))
        .select("all", "id", "size", "source_rank", "source_size", "total", "target", "shuffle_key", "epoch", "finish_words", "finish")
    )
    # Where the copies that finish by some time already fill the budget, none that finishes later is read.
    times = [2.0**i for i in range(1, 21)]
    by_time = copies.agg(F.max("total").alias("total"), *[F.sum(F.when(F.col("finish") <= t, F.col("size"))).alias(f"by_{i}") for i, t in enumerate(times)]).first()
    horizon = next((t for i, t in enumerate(times) if (by_time[f"by_{i}"] or 0) >= (by_time["total"] or 0)), None)
    if horizon is not None:
        copies = copies.withColumn("late", F.col("finish") > horizon)
    else:
        copies = copies.withColumn("late", F.lit(False))
    # Words come evenly over finish time, so buckets of equal time have about equal words.
    order = [F.col(c) for c in ("finish", "source_rank", "epoch", "shuffle_key", "id")]
    mixed = running(copies.filter(~F.col("late")), ["all"], F.floor(F.col("finish") * n_buckets).cast("long"), order, "size", "mixed_words")
    kept = mixed.select("id", "size", "source_rank", "source_size", "total", "target", "shuffle_key", "finish_words", "finish", "mixed_words")
    unread = copies.filter("late").select(*[c for c in kept.columns if c != "mixed_words"], (F.col("total") + 1).alias("mixed_words"))
    mixed = kept.unionByName(unread)
    in_mix = F.col("mixed_words") <= F.col("total")
    with_words = mixed.groupBy("id", "size", "source_rank", "source_size", "target", "shuffle_key", "finish_words").agg(
        F.sum(F.when(in_mix, F.col("size")).otherwise(0)).alias("taken"), F.min(F.when(in_mix, F.col("finish"))).alias("first_finish")
    )
    columns = ["id", "size", "source_rank", "source_size", "target", "taken", "first_finish"]
    unread = [c for c in columns if c not in ("taken", "first_finish")]
    without = wordless.select(unread).unionByName(slim.filter(F.col("target") <= 0).select(unread)).withColumns({"taken": F.lit(0).cast("long"), "first_finish": F.lit(None).cast("double")})
    return with_words.select(columns).unionByName(without.select(columns)).withColumnRenamed("id", id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as the mix reads it (0 to repeats times).

    Rows that repeat an id and a size share what the mix reads of them evenly, rounded up.
    """
    taken = mix(docs, id_col, text_col, source_col, weights, repeats).filter("taken > 0")
    copies = taken.groupBy(F.col(id_col).alias("__id"), F.col("size").alias("__size")).agg(F.ceil(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int").alias("__copies"))
    columns = docs.columns
    sized = docs.withColumn("__size_of", word_count(F.col(text_col)))
    chosen = sized.join(copies, sized[id_col].eqNullSafe(copies["__id"]) & (sized["__size_of"] == copies["__size"]))
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)
