"""What was published: a claim before each message, an end after it, each a small new file that no other writer can make.

A key (fingerprint, locale) has attempts 0, 1, 2, ... Its claim file is created exclusively, so of several publishers one
sends; it ends as sent or as failed. Only a failed attempt opens the next one: a claim without an end may have
gone out, is held back, and shows in unsettled() until someone resolves it.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilflow.sources.commits import Files

RECORD = "fingerprint string, locale string, attempt int, event string, at string"


class Ledger:
    """A folder of claims and ends; records() reads it as a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    @staticmethod
    def _folder(fingerprint: str, locale: str) -> str:
        """Keys lie in 256 folders by hash, so that none holds them all."""
        named = hashlib.sha256(f"{locale}\n{fingerprint}".encode()).hexdigest()
        return f"events/{named[:2]}/{named[2:34]}"

    def _put(self, fingerprint: str, locale: str, attempt: int, event: str) -> bool:
        kind = "claim" if event == "claimed" else "end"
        record = {"fingerprint": fingerprint, "locale": locale, "attempt": attempt, "event": event, "at": datetime.now(UTC).isoformat(timespec="seconds")}
        return self.files.create(f"{self._folder(fingerprint, locale)}-{attempt}-{kind}.json", json.dumps(record) + "\n")

    def claim(self, fingerprint: str, locale: str) -> tuple[str, str, int] | None:
        """The next attempt at a key, or None: it was sent, is being sent, or may have been."""
        at = self._folder(fingerprint, locale)
        attempt = 0
        while self.files.exists(f"{at}-{attempt}-claim.json"):
            end = f"{at}-{attempt}-end.json"
            if not self.files.exists(end) or json.loads(self.files.text(end))["event"] != "failed":
                return None
            attempt += 1
        return (fingerprint, locale, attempt) if self._put(fingerprint, locale, attempt, "claimed") else None

    def settle(self, claim: tuple[str, str, int], sent: bool) -> bool:
        """End a claim; False if it has an end."""
        return self._put(*claim, "sent" if sent else "failed")

    def records(self) -> DataFrame:
        if not self.files.exists("events"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).option("recursiveFileLookup", "true").json(f"{self.path}/events")

    def _last(self) -> DataFrame:
        """Each key's last event: of its last attempt, the end if there is one."""
        rank = F.struct("attempt", (F.col("event") != "claimed").alias("ended"))
        return self.records().groupBy("fingerprint", "locale").agg(F.max_by("event", rank).alias("event"), F.max("attempt").alias("attempt"))

    def published(self) -> DataFrame:
        """(fingerprint, locale) that were sent."""
        return self._last().filter("event = 'sent'").select("fingerprint", "locale")

    def unsettled(self) -> DataFrame:
        """(fingerprint, locale, attempt) whose last claim has no end: they may have been sent."""
        return self._last().filter("event = 'claimed'").select("fingerprint", "locale", "attempt")

    def blocked(self) -> DataFrame:
        """(fingerprint, locale) that a selection leaves out: sent, or perhaps sent."""
        return self._last().filter("event <> 'failed'").select("fingerprint", "locale")
