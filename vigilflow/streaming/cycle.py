"""The ingest cycle as a micro-batch: new rows against the store, normalisation, filter, enrichment, merge, health.

A cycle changes several tables (items, verdicts, health) and remembers its batch; all of it is one commit
(sources/commits.py). A cycle that is lost on its way has changed nothing and is run again; a batch that is run again after its
commit finds itself there, and only hooks that weren't noted as done are called once more. State lies in the store
and not in the stream. (A watermark would forget; the cycle never does.)

Items lie in buckets by their fingerprints: a cycle reads and writes the buckets that its rows fall into.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigilflow.functions import text as tx
from vigilflow.operators import enrich, health, provider, store
from vigilflow.sources.commits import Commits, Conflict, bucket
from vigilflow.sources.feeds import NEWS
from vigilflow.sources.ledger import Ledger
from vigilflow.sources.tables import ITEM

log = logging.getLogger(__name__)
COLUMNS = [c.split(" ")[0] for c in ITEM.split(", ")]
FETCHED = f"doc_id bigint, {NEWS}"
HEALTH = "source string, cycles_seen bigint, cycles_empty bigint, total_fetched bigint, total_relevant bigint, cred_n bigint, cred_sum double, last_published_at timestamp"
VERDICTS = "fingerprint string, relevant boolean"
#: What the hybrid filter counts of a cycle's rows.
PATHS = {
    "fetched": F.count, "language_rejected": ("language",), "rules_rejected": ("rules-reject",), "rules_accepted": ("rules-accept",), "ai_cache_hits": ("ai-cached",),
    "ai_validated": ("ai-cached", "ai-accept", "ai-reject"), "ai_accepted": True, "ai_rejected": False, "ai_errors": ("ai-error",),
}
GRAY = ("ai-cached", "ai-accept", "ai-reject", "ai-error", "ai-disabled")


def path_counts() -> list:
    """Aggregates of the nine counters over rows (path, is_relevant)."""
    path, out = F.col("path"), []
    for name, what in PATHS.items():
        if isinstance(what, tuple):
            test = path.isin(*what)
        elif isinstance(what, bool):
            test = path.isin(*GRAY) & (F.col("is_relevant") == what)
        else:
            test = F.lit(True)
        out.append(F.count_if(test).alias(name))
    return out


def decided(fresh: DataFrame, verdicts: DataFrame | None = None, classifier: provider.Factory | None = None) -> DataFrame:
    """Normalised rows with txt, hits, score, path and is_relevant.

    Without verdicts and classifier the rules alone decide, at their own threshold; with any, rows between sure rejects and sure
    accepts take a stored verdict (fingerprint, relevant) or ask the classifier.
    """
    rows = enrich.with_text(tx.normalized_news(fresh)).withColumn("score", enrich.relevance_score(F.col("hits")))
    if verdicts is None and classifier is None:
        own = F.when(F.col("language") == "other", "language").when(F.col("score") >= 3, "rules-accept").otherwise("rules-reject")
        return rows.withColumn("path", own).withColumn("is_relevant", F.col("path") == "rules-accept")
    known = verdicts.select("fingerprint", F.col("relevant").alias("_known")) if verdicts is not None else None
    rows = rows.join(known, "fingerprint", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("boolean"))
    rows = rows.withColumn("path", enrich.decision(F.col("language"), F.col("score"), F.col("_known")))
    cached = F.col("path") == "ai-cached"
    told = rows.filter(cached).withColumn("is_relevant", F.col("_known"))
    return told.unionByName(provider.with_verdicts(rows.filter(~cached), classifier)).drop("_known")


def enriched_relevant(kept: DataFrame, now: str) -> DataFrame:
    """Rows that the filter kept, classified, corroborated and scored as one batch: doc_id and the columns of an item."""
    rows = enrich.scored(kept, now).withColumns({"tags": F.array("category"), "fetched_at": F.to_timestamp(F.lit(now))})
    return rows.select("doc_id", *COLUMNS)


def enriched(fresh: DataFrame, now: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Rows that the store lacks, through the stages in order: normalised, filtered, then classified, corroborated and scored among what is left.

    So a row that isn't relevant never corroborates one that is. Rows need doc_id, the order in which they came. What the
    filter keeps is read twice (as rows and as titles): keep may write it somewhere and read it back.
    """
    return enriched_relevant(keep(decided(fresh).filter("is_relevant")), now)


def in_order(batch: DataFrame) -> DataFrame:
    """Fetched rows with doc_id, their place in order: of a doc_id that they have, else of source and time. Kept once written."""
    own = ["doc_id"] if "doc_id" in batch.columns else []
    names = [c.split(" ")[0] for c in NEWS.split(", ")]
    rows = batch.orderBy(*own, "source", "published_at", "fingerprint", "url", "title", "raw_content")
    return rows.select(F.monotonically_increasing_id().alias("doc_id"), *names)


def _observed(rows: DataFrame, name: str, *counts) -> tuple[DataFrame, Observation]:
    """Rows whose counts come along when they are written."""
    seen = Observation(name)
    return rows.observe(seen, *counts), seen


def _buckets(rows: DataFrame, n: int) -> list[int]:
    """The buckets of rows' keys: as many numbers as the store has buckets at most."""
    return sorted(r[0] for r in rows.select(bucket("fingerprint", n)).distinct().collect())


def _retained(commits: Commits, state: dict, changed: dict, retention: int) -> dict:
    """changed, and the buckets that hold items beyond the newest retention ones written anew without them."""
    view = {"keyed": {"items": {b: f for b, f in (state["keyed"].get("items", {}) | changed).items() if f}}}
    items = commits.read_keyed(view, "items", ITEM)
    order = [F.col("published_at").desc_nulls_last(), F.col("fingerprint")]
    first_out = items.select("published_at", "fingerprint").orderBy(*order).offset(retention).limit(1).collect()
    if not first_out:
        return changed
    time, key = F.lit(first_out[0]["published_at"]), F.lit(first_out[0]["fingerprint"])
    at = F.col("published_at")
    late = at.isNull() & F.when(time.isNull(), F.col("fingerprint") >= key).otherwise(True)
    out = late | F.coalesce((at < time) | ((at == time) & (F.col("fingerprint") >= key)), F.lit(False))
    some = _buckets(items.filter(out), commits.buckets)
    left = commits.stage_keyed(commits.read_keyed(view, "items", ITEM, some).filter(~out), "items", "fingerprint")
    return changed | {str(b): left.get(str(b)) for b in some}


def _attempt(commits: Commits, base: dict, fetched: DataFrame, counts: dict, now: str, retention: int, configured, number, stream, hybrid: bool, classifier) -> dict:
    """One cycle against a state: write all that changes, then commit."""
    spark = fetched.sparkSession
    fresh = store.fresh(fetched, commits.read_keyed(base, "items", ITEM, _buckets(fetched, commits.buckets)))
    verdicts = commits.read_keyed(base, "verdicts", VERDICTS, _buckets(fetched, commits.buckets)) if hybrid else None
    judged, paths = _observed(decided(fresh, verdicts, classifier), "paths", *path_counts())
    judged = commits.staged(commits.stage(judged, "judged"), judged.schema)
    new, seen = _observed(
        enriched_relevant(judged.filter("is_relevant"), now), "relevant", F.count(F.lit(1)).alias("relevant"), F.count_if(F.col("category") != "other").alias("categorized"),
        F.count_if(F.size("audience_targets") > 0).alias("audience_tagged"), F.count_if(F.col("actionability_level") != "informational").alias("actionable"), F.count_if(F.col("source_tier") == "trusted").alias("trusted"),
    )
    new = commits.staged(commits.stage(new, "new"), new.schema)

    touched = _buckets(new, commits.buckets)
    known = commits.read_keyed(base, "items", ITEM, touched).withColumn("doc_id", F.lit(-1).cast("long"))
    merged, inserted = _observed(store.merge_file(known, new).select(*COLUMNS, "is_new"), "inserted", F.count_if("is_new").alias("new"))
    written = commits.stage_keyed(merged, "items", "fingerprint") if touched else {}
    changed = _retained(commits, base, written, retention)
    keyed = {"items": changed}
    if hybrid:
        told = judged.filter(F.col("path").isin("ai-accept", "ai-reject")).groupBy("fingerprint").agg(F.max("is_relevant").alias("relevant"))
        asked = _buckets(told, commits.buckets)
        if asked:
            keyed["verdicts"] = commits.stage_keyed(commits.read_keyed(base, "verdicts", VERDICTS, asked).unionByName(told), "verdicts", "fingerprint")

    relevant = new.select("doc_id", F.lit(True).alias("relevant"), F.col("source_credibility_score").alias("credibility"))
    rows = fetched.select("doc_id", "source", "published_at").join(relevant, "doc_id", "left").withColumns({"relevant": F.coalesce("relevant", F.lit(False)), "credibility": F.coalesce("credibility", F.lit(0.0))})
    before = commits.read(base, "health", HEALTH)
    names = rows.select("source") if configured is None else rows.select("source").unionByName(spark.createDataFrame([(n,) for n in configured], "source string"))
    part = health.cycle(rows, names.distinct())
    tables = {"health": commits.stage(health.merged(before.unionByName(part)), "health")}

    counts = counts | seen.get | (inserted.get if touched else {"new": 0})
    own = {"number": number, "counts": counts, "state": base["number"] + 1, "inserted": sorted({f.rsplit("/", 1)[0] for f in written.values()})}
    streams = base["facts"].get("streams", {}) | {stream: own}
    facts = {"streams": streams, "folders": sorted({f for s in streams.values() for f in s["inserted"]})}
    if hybrid:
        facts["paths"] = {k: base["facts"].get("paths", {}).get(k, 0) + v for k, v in paths.get.items()}
        own["paths"] = paths.get
    return commits.commit(base, tables, keyed, facts)


def run_cycle(
    batch: DataFrame, commits: Commits, now: str, retention: int = 200, configured: Iterable[str] | None = None, after: tuple[Callable[[DataFrame], None], ...] = (),
    number: int | None = None, stream: str = "", hybrid: bool = False, classifier: provider.Factory | None = None, tries: int = 5,
) -> dict[str, int]:
    """One cycle over fetched rows; the counters of what it did. Hooks see the rows that it inserted; what they raise stays theirs.

    number is that of the batch in its stream: the store remembers the last one of each stream, and a batch that is run again
    changes nothing. configured: names of all sources, so that silent ones count as such. hybrid (or a classifier) lets stored verdicts
    and the classifier decide between sure accepts and rejects. Another writer's commit in between makes the cycle try again on
    its state.
    """
    names, hybrid = None if configured is None else list(configured), hybrid or classifier is not None
    base = commits.last()
    mine = base["facts"].get("streams", {}).get(stream)
    if number is None or mine is None or mine["number"] is None or number > mine["number"]:
        rows, seen = _observed(in_order(batch), "fetched", F.count(F.lit(1)).alias("fetched"))
        folder = commits.stage(rows, "fetched")
        fetched = commits.staged(folder, FETCHED)
        for i in range(tries):
            try:
                base = _attempt(commits, base, fetched, seen.get, now, retention, names, number, stream, hybrid, classifier)
                break
            except Conflict:
                if i + 1 == tries:
                    raise
                log.info("another writer was first; the cycle starts again on its state")
                base = commits.last()
        mine = base["facts"]["streams"][stream]
    elif number < mine["number"]:
        return dict.fromkeys(mine["counts"], 0)
    done = f"hooks-{mine['state']}"
    if after and mine["inserted"] and not commits.marked(done):
        inserted = commits.staged(mine["inserted"][0], f"{ITEM}, is_new boolean").filter("is_new").drop("is_new")
        for hook in after:
            try:
                hook(inserted)
            except Exception:
                log.warning("a hook failed", exc_info=True)
        commits.mark(done)
    return mine["counts"]


def start(stream: DataFrame, path: str, checkpoint: str, now: str | Callable[[], str], every: str | None = None, prepare: Callable[[DataFrame, str], DataFrame] | None = None, **options):
    """The cycle over a stream of fetched rows: at an interval, or once over what is there.

    now may be a function: each batch asks it for its own time. prepare makes news rows of a batch (fetch.news_rows for the format
    "feeds"). options: of run_cycle().
    """
    spark: SparkSession = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        time = now() if callable(now) else now
        counts = run_cycle(prepare(batch, time) if prepare else batch, Commits(spark, path), time, number=number, stream=checkpoint, **options)
        log.info("cycle %s: %s", number, counts)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def write_both(rows: DataFrame, primary: Callable[[DataFrame], None], secondary: Callable[[DataFrame], None]) -> bool:
    """The primary sink's errors are raised, the secondary's logged; whether both have the rows."""
    primary(rows)
    try:
        secondary(rows)
        return True
    except Exception:
        log.warning("the secondary sink failed", exc_info=True)
        return False


class ChannelFatal(Exception):
    """A sender's error that concerns a whole channel: a wrong chat, a missing right, a bad token."""


def channel_fatal(status: int, description: str = "") -> bool:
    """Whether an answer of a channel's service means that no other message will go through either."""
    told = description.lower()
    return status in (401, 403) or (status == 400 and ("chat not found" in told or "chat_id is empty" in told))


def publish(selection: DataFrame, send: Callable[[str, str], bool], ledger_path: str, dry_run: bool = True, most: int = 100) -> dict[str, int]:
    """Send a bounded selection (locale, fingerprint, message), newest first where it has published_at; what was done, as counts.

    A message is claimed in the ledger before it goes out and settled after it: whatever ends the process, a message that
    may have gone out is never sent again. One that a sender refuses, or fails to take, is released and sent again next time. Claims that were
    never settled, and messages of another sender's run, are held back and counted; so are those beyond most (left). A sender
    that raises ChannelFatal ends its locale.
    """
    order = [F.desc("published_at")] if "published_at" in selection.columns else []
    rows = selection.orderBy(*order, "fingerprint", "locale", "message").select("locale", "fingerprint", "message").limit(most).collect()
    left = selection.count() - len(rows) if len(rows) == most else 0
    ledger = Ledger(selection.sparkSession, ledger_path)
    done = {"sent": 0, "errors": 0, "closed": 0, "held": 0, "left": left}
    closed = set()
    for row in rows:
        locale, key = row["locale"], (row["fingerprint"], row["locale"])
        if locale in closed:
            continue
        if dry_run:
            done["sent"] += 1
            continue
        claim = ledger.claim(*key)
        if claim is None:
            done["held"] += 1
            continue
        try:
            went = send(locale, row["message"])
        except ChannelFatal:
            log.error("channel %s takes nothing", locale, exc_info=True)
            closed.add(locale)
            went = False
        except Exception:
            log.warning("%s/%s could not be sent", *key, exc_info=True)
            went = False
        ledger.settle(claim, bool(went))
        done["sent" if went else "errors"] += 1
    return done | {"closed": len(closed)}
