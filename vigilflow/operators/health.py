"""Source health, counters and rates: sums that merge, so that cycles add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("cycles_seen", "cycles_empty", "total_fetched", "total_relevant", "cred_n")


def cycle(fetched: DataFrame, configured: DataFrame) -> DataFrame:
    """One cycle's part for each configured source; one that fetched nothing only counts as empty."""
    part = fetched.groupBy("source").agg(
        F.count("*").alias("total_fetched"), F.count_if("relevant").alias("total_relevant"), F.max("published_at").alias("last_published_at"),
        F.sum(F.when(F.col("relevant") & (F.col("credibility") > 0), F.col("credibility"))).alias("cred_sum"), F.count_if(F.col("relevant") & (F.col("credibility") > 0)).alias("cred_n"),
    )
    rows = configured.select("source").join(part, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_fetched", "total_relevant", "cred_n")}
    return rows.withColumns({"cycles_seen": F.lit(1).cast("long"), "cycles_empty": F.col("total_fetched").isNull().cast("long"), "cred_sum": F.coalesce("cred_sum", F.lit(0.0)), **zero})


def merged(parts: DataFrame) -> DataFrame:
    """Parts of any number of cycles, merged: partial and final aggregation of the same sums."""
    return parts.groupBy("source").agg(*[F.sum(c).alias(c) for c in SUMS], F.sum("cred_sum").alias("cred_sum"), F.max("last_published_at").alias("last_published_at"))


def rate(a: Column, b: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(a, b), digits)


def with_rates(health: DataFrame) -> DataFrame:
    c = F.col
    return health.withColumns({"relevance_rate": rate(c("total_relevant"), c("total_fetched")), "avg_credibility": rate(c("cred_sum"), c("cred_n")), "empty_rate": rate(c("cycles_empty"), c("cycles_seen"))})


def merged_counters(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("name").agg(F.sum("value").alias("value"))


# Prefixes of rejections, in order, and the counters that they raise.
REJECTIONS = (
    ("near-copy", "plagiarism_rejects"), ("AI cliché", "cliche_rejects"), ("empty", "empty_field_rejects"), ("duplicate entries", "dup_rec_rejects"),
    ("summary echoes title", "title_echo_rejects"), ("hallucinated threat_level", "hallucinated_threat_level"),
)


def rejection_counter(message: Column) -> Column:
    found = None
    for prefix, counter in REJECTIONS:
        test = F.startswith(F.lower(message), F.lit(prefix.lower()))
        found = F.when(test, counter) if found is None else found.when(test, counter)
    return found


def rejection_counters(messages: DataFrame) -> DataFrame:
    """(name, value): every rejection raises the general counter, and its own where its prefix is known."""
    both = F.array(F.lit("ai_validation_rejects"), rejection_counter(F.trim("message")))
    return messages.select(F.explode(F.filter(both, lambda c: c.isNotNull())).alias("name")).groupBy("name").agg(F.count("*").alias("value"))


def top_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    return messages.groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(n)


def heavy(messages: DataFrame, k: int = 50) -> DataFrame:
    """(message, n, lost): a summary of frequent messages in k rows at most (Misra and Gries), however many there are.

    n is too small by lost at most, and a message that isn't in the summary occurs lost times at most; lost is at most the number of
    messages / (k + 1). So every message above that share is in it.
    """
    return _trimmed(messages.groupBy("message").agg(F.count("*").alias("n")), F.lit(0).cast("long"), k)


def heavy_merged(parts: DataFrame, k: int = 50, part: str = "part") -> DataFrame:
    """One summary of several (part, message, n, lost), with the bounds of one that saw all messages."""
    lost = parts.groupBy(part).agg(F.max("lost").alias("lost")).agg(F.coalesce(F.sum("lost"), F.lit(0)))
    return _trimmed(parts.groupBy("message").agg(F.sum("n").alias("n")), lost.scalar(), k)


def _trimmed(counts: DataFrame, before: Column, k: int) -> DataFrame:
    """The k most frequent messages, less the count of the next one, which is lost to all. Only k + 1 rows meet in one task."""
    first = counts.orderBy(F.desc("n"), "message").limit(k + 1).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "message")))
    cut = F.coalesce(F.max(F.when(F.col("place") == k + 1, F.col("n"))).over(Window.partitionBy()), F.lit(0))
    rows = first.withColumns({"cut": cut, "_so_far": before})
    return rows.filter((F.col("place") <= k) & (F.col("n") > F.col("cut"))).select("message", (F.col("n") - F.col("cut")).alias("n"), (F.col("_so_far") + F.col("cut")).alias("lost"))
