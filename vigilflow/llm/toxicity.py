"""Toxicity by weak supervision: many voters, a generative label model over their votes, a linear classifier on its labels.

Voters look at the words of a whole text. Some count hits of fixed lexicons, some of lexicons of word stems that
labelled rows tell (dealt out by hash, and once more all together by strength), some read patterns: density of
hits, shouting, exclamation, masked words, address by the second person. A vote is one of LEVELS grades; grade 0 abstains.

The label model has a hidden label a text and a table of each voter's grades under it; correlated voters lean on each
other by a tree of largest mutual information under the label (expectation and maximisation in turn).
The given labels are one voter more, that abstains on rows without label and is believed to err rarely. A logistic
regression over hits, grades and hashed stems is then fitted to the posterior labels.

Fitting takes a bounded sample: ROWS_PER_LABEL labelled rows of each label (half of them tell the stems, the others and
UNLABELLED rows without label the rest), those with the smallest hashes of their ids; only counts of MOST_STEMS stems
and rows of counts reach the driver. The share of toxic rows is counted over all labelled rows that may be learned
from. Every text is scored in full.

Defined results: a null or empty text has no hit and gets the score of such a text; null labels are no labels; of several
labels of an id the largest holds; a null id has no label; without any label the fixed lexicons alone decide;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.llm.common import limit_batches, written

ROWS_PER_LABEL, UNLABELLED = 3000, 2000
MOST_STEMS = 2000
#: Stems are beginnings of so many letters, and whole words.
STEMS = range(3, 8)
#: A stem is held in so many toxic rows at least, and so many times as often as in others.
LEAST_ROWS, LEAST_ODDS = 4, 6.0
STRONG, MEDIUM = 40.0, 15.0
DEALT, HASHED = 12, 48
LEVELS = 4
#: Grade 0 below the first bound, 1 from it on, and so on.
HITS, PER_THOUSAND = (1, 2, 4), (1, 5, 20)
#: How often the given labels are believed to be right.
TRUST = 0.98
THRESHOLD = 0.3
TOXIC_LABEL = "toxic"

#: Words of abuse, by kind: beginnings, or whole words where they end in a dot.
LEXICONS = {
    "stupid": ("idiot", "moron", "stupid", "imbecil", "dumb.", "dumbass", "dummkopf", "blöd", "dämlich", "trottel", "crétin", "débile", "abruti", "estúpid", "tonto.", "bobo.", "brainless", "halfwit", "clown"),
    "filth": ("scum", "trash.", "garbage.", "filth", "vermin", "abschaum", "drecks", "ordure", "pourriture", "basura", "escoria", "disgusting", "pig.", "schwein", "cochon", "cerdo.", "rat."),
    "worthless": ("worthless", "useless", "loser", "pathetic", "failure.", "nutzlos", "versager", "minable", "inútil", "fracasad", "nobody likes", "waste of"),
    "hate": ("hate you", "i hate", "despise", "hasse dich", "déteste", "odio.", "go to hell", "shut up", "halt die klappe", "ferme la", "cállate", "get lost"),
    "threat": ("kill you", "kill yourself", "hurt you", "bring dich um", "töte dich", "te tuer", "te matar", "die in", "beat you"),
    "slur": ("bitch", "bastard", "asshole", "arschloch", "wichser", "hure.", "salope", "connard", "putain", "puta.", "pendej", "cabrón", "gilipollas", "fuck", "shit.", "scheiß", "merde.", "mierda"),
}
#: Pronouns that address a reader.
ADDRESS = frozenset("you your youre u ya du dich dein deine ihr euch tu te toi vous votre tú te ti usted vosotros".split())

_BREAK = re.compile(r"[\W_]+")
_MASKED = re.compile(r"[^\W\d_][*#@$%]{2,}[^\W\d_]|[^\W\d_]\*+[^\W\d_]+")


def spaced(text: str | None) -> str:
    """Lower-cased words with one space before and after each."""
    return f" {_BREAK.sub(' ', text.lower()).strip()} " if text else " "


def stems(text: str | None) -> set[str]:
    """Distinct stems of a text; a whole word ends in a space."""
    found = set()
    for word in set(spaced(text).split()):
        if len(word) >= STEMS[0]:
            found.update(word[:n] for n in STEMS if n <= len(word))
            found.add(f"{word} ")
    return found


def likely_equal(text: str | None) -> int:
    """The smallest hash of five words in a row: equal for copies, and for near copies as likely as they are alike."""
    words = spaced(text).split()
    return min((crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 modulo 4 (a null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Voters:
    """Finds the hits of all lexicons in one pass and grades them. mined: odds of each stem."""

    names = (*LEXICONS, "fixed", *(f"mined{i}" for i in range(DEALT)), "strong", "medium", "any", "density", "fixed_density", "shouting", "exclaiming", "masked", "addressed")

    def __init__(self, mined: dict[str, float]):
        self.mined, self._found = mined, None

    def __getstate__(self):
        return {"mined": self.mined, "_found": None}

    def _automaton(self):
        if self._found is None:
            self._found, known = ahocorasick.Automaton(), {}
            for kind, entries in enumerate(LEXICONS.values()):
                for entry in entries:
                    known.setdefault(f" {entry.replace('.', ' ')}", []).append((kind, 0.0, 0))
            for stem, odds in self.mined.items():
                known.setdefault(f" {stem}", []).append((-1, odds, crc32(stem.encode())))
            for key, values in known.items():
                self._found.add_word(key, (len(key), values))
            if known:
                self._found.make_automaton()
        return self._found

    def counts(self, text: str | None) -> np.ndarray:
        """Hits and measures of a text: one number a voter, then hits of stems by hash."""
        out = np.zeros(len(self.names) + HASHED)
        if not text:
            return out
        plain, at = spaced(text), len(LEXICONS)
        hits: dict[int, float] = {}
        fixed = set()
        for end, (length, values) in self._automaton().iter(plain):
            start = end - length + 1
            for kind, odds, code in values:
                if kind >= 0:
                    fixed.add(start)
                    out[kind] += 1
                else:
                    hits[start] = max(hits.get(start, 0.0), odds)
                    out[at + 1 + code % DEALT] += 1
                    out[len(self.names) + code // DEALT % HASHED] += 1
        n = max(1, plain.count(" ") - 1)
        odds = np.fromiter(hits.values(), float, len(hits))
        addressed = sum(1 for s in hits.keys() | fixed if not ADDRESS.isdisjoint(plain[max(0, s - 24) : s].split()[-3:]))
        raw = np.frombuffer(text.encode(), np.uint8)
        upper, lower = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
        out[at] = len(fixed)
        rest = ((odds >= STRONG).sum(), ((odds >= MEDIUM) & (odds < STRONG)).sum(), len(hits), 1000 * len(hits) / n, 1000 * len(fixed) / n, 10 * upper / max(1, upper + lower), 1000 * int((raw == 33).sum()) / n, len(_MASKED.findall(text)), addressed)
        out[at + 1 + DEALT : len(self.names)] = rest
        return out


def grades(counted: np.ndarray) -> np.ndarray:
    """Votes: grades of the voters' counts, one column a voter."""
    out = np.empty((len(counted), len(Voters.names)), np.int64)
    for j, name in enumerate(Voters.names):
        bounds = PER_THOUSAND if "density" in name else (3, 6, 9) if name == "shouting" else (20, 100, 500) if name == "exclaiming" else HITS
        out[:, j] = np.searchsorted(bounds, counted[:, j], side="right")
    return out


class LabelModel:
    """Accuracies and correlations of voters, estimated without knowing the labels for sure.

    given: 1, 0 or -1 (none) for each row. share: of label 1.
    """

    def __init__(self, votes: np.ndarray, given: np.ndarray, weight: np.ndarray, share: float, rounds: int = 20, smooth: float = 2.0):
        self.smooth, self.prior = smooth, np.log([1 - share, share])
        truth = np.where(given >= 0, np.where(given == 1, TRUST, 1 - TRUST), np.clip((votes >= 2).sum(axis=1) / 4, 0.02, 0.98))
        lean = np.where(given >= 0, np.log(TRUST / (1 - TRUST)) * np.where(given == 1, 1, -1), 0.0)
        # Where there are labels, they alone start the estimate: else many voters that copy each other would be taken for the truth.
        few = min((given == 0).sum(), (given == 1).sum()) < 25
        known = weight if few else np.where(given >= 0, weight, 0.0)
        for i in range(rounds):
            if i in (0, 8):
                self.parent = self._tree(votes, truth, known)
            self.tables = self._estimated(votes, truth, known)
            truth, known = self.posterior(votes, lean), weight
        self.truth = truth

    def _estimated(self, votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Log of P(grade | label, parent's grade) for each voter; a voter without parent has one row."""
        out = []
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            counts = np.zeros((2, LEVELS if p >= 0 else 1, LEVELS))
            for label, mass in ((0, 1 - truth), (1, truth)):
                np.add.at(counts[label], (above, votes[:, j]), mass * weight)
            alone = counts.sum(axis=1, keepdims=True) + self.smooth / LEVELS
            counts += self.smooth * alone / alone.sum(axis=2, keepdims=True)
            out.append(np.log(counts / counts.sum(axis=2, keepdims=True)))
        return out

    @staticmethod
    def _tree(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each voter's parent (-1: none) in the tree of largest mutual information between voters given the label; what chance gives so few rows is none."""
        m, least = votes.shape[1], max(0.002, (LEVELS - 1) ** 2 / max(1, (weight > 0).sum()))
        one_hot = (votes[:, :, None] == np.arange(LEVELS)).reshape(len(votes), -1).astype(np.float64)
        shared = np.zeros((m, m))
        for mass in (weight * (1 - truth), weight * truth):
            if mass.sum() <= 0:
                continue
            joint = (one_hot.T * mass) @ one_hot / mass.sum()
            own = np.diag(joint)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(joint > 0, joint * np.log(joint / np.outer(own, own)), 0.0)
            shared += mass.sum() / weight.sum() * part.reshape(m, LEVELS, m, LEVELS).sum(axis=(1, 3))
        parent, inside, best, by = np.full(m, -1), np.zeros(m, bool), shared[0].copy(), np.zeros(m, np.int64)
        inside[0] = True
        for _ in range(m - 1):
            j = int(np.where(inside, -np.inf, best).argmax())
            parent[j] = by[j] if best[j] >= least else -1
            inside[j] = True
            closer = shared[j] > best
            best, by = np.where(closer, shared[j], best), np.where(closer, j, by)
        return parent

    def posterior(self, votes: np.ndarray, lean: np.ndarray | float = 0.0) -> np.ndarray:
        """Chance of label 1. lean: log odds that the given label adds."""
        log = np.tile(self.prior, (len(votes), 1))
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            log += self.tables[j][:, above, votes[:, j]].T
        return 1 / (1 + np.exp(-np.clip(log[:, 1] - log[:, 0] + lean, -40, 40)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """(share of label 1 rows, of label 0 rows) on which each voter without parent speaks up."""
        return {Voters.names[j]: (1 - float(np.exp(t[1, 0, 0])), 1 - float(np.exp(t[0, 0, 0]))) for j, t in enumerate(self.tables) if self.parent[j] < 0}


def inputs(counted: np.ndarray) -> np.ndarray:
    """What the classifier reads: logarithms of all counts, and each grade."""
    graded = grades(counted)
    return np.hstack([np.log1p(counted), (graded[:, :, None] >= np.arange(1, LEVELS)).reshape(len(counted), -1)])


class Model:
    """A logistic regression over the voters' counts."""

    def __init__(self, voters: Voters, counted: np.ndarray, truth: np.ndarray, weight: np.ndarray, decay: float = 1.0, steps: int = 30):
        self.voters = voters
        x = inputs(counted)
        self.middle, spread = np.average(x, axis=0, weights=weight), np.sqrt(np.average((x - np.average(x, axis=0, weights=weight)) ** 2, axis=0, weights=weight))
        self.spread = np.where(spread > 1e-9, spread, np.inf)
        z = np.hstack([(x - self.middle) / self.spread, np.ones((len(x), 1))])
        ridge = np.full(z.shape[1], decay)
        ridge[-1] = 1e-6
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            pull = z.T @ (weight * (truth - p)) - ridge * self.w
            step = np.linalg.solve((z.T * (weight * np.maximum(p * (1 - p), 1e-4))) @ z + np.diag(ridge), pull)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def score(self, counted: np.ndarray) -> np.ndarray:
        z = (inputs(counted) - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))


def _fewest(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n rows those most with the smallest hashes of id, thinned by hash first."""
    space = 1 << 30
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(space))
    thin = rows.withColumn("draw", draw)
    if n > 4 * most:
        thin = thin.filter(F.col("draw") < int(space * (2 * most + 50) / n))
    return thin.orderBy("draw", "id").limit(most)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """The bounded sample (id, label, half, text), label null for rows without; and the number of all rows of each label that may be learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    learned = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label"))
    counts = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull())
    space = 1 << 30
    total = ids.count()
    few = ids.filter(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(space)) < int(space * min(1.0, (6 * UNLABELLED + 50) / max(1, total)))).distinct()
    parts = [_fewest(few.join(known.select("id").distinct(), "id", "left_anti"), 0, UNLABELLED).select("id", F.lit(None).cast("int").alias("label"), "draw")]
    parts += [_fewest(learned.filter(F.col("label") == c), n, ROWS_PER_LABEL).select("id", "label", "draw") for c, n in counts.items()]
    drawn = parts[0]
    for part in parts[1:]:
        drawn = drawn.unionByName(part)
    # At most 2 * ROWS_PER_LABEL + UNLABELLED ids; one text an id.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    @F.arrow_udf("long")
    def likeness(batch: pa.Array) -> pa.Array:
        return pa.array([likely_equal(x) for x in batch.to_pylist()], pa.int64())

    # Copies count once, and near copies nearly always: else what a copied text holds would look like a rule.
    once = texts.withColumn("key", likeness("text")).groupBy("key", "label").agg(F.min_by(F.struct("id", "text"), "id").alias("row"))
    half = F.when(F.col("label").isNull(), 1).otherwise(F.pmod(F.xxhash64("key", F.lit(37)), F.lit(2))).cast("int")
    return once.select("row.id", "label", half.alias("half"), "row.text"), counts


def mined(rows: DataFrame) -> dict[str, float]:
    """Odds of the stems that toxic rows of (label, text) hold far more often than others; a stem goes whose beginning says as much."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        size = [0, 0]
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found[label].update(stems(text))
                size[label] += 1
        for label in (0, 1):
            keys = [*found[label], ""]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([label] * len(keys), pa.int32()), pa.array([*found[label].values(), size[label]], pa.int64())], names=["stem", "label", "n"])

    counted = rows.select("label", "text").mapInArrow(of, "stem string, label int, n long")
    by = written(counted.groupBy("stem").agg(*[F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)]), "toxic-stems")
    size = by.filter("stem = ''").first()
    if size is None:
        return {}
    odds = ((F.col("n1") + 0.5) / (size["n1"] + 1)) / ((F.col("n0") + 0.5) / (size["n0"] + 1))
    best = by.filter("stem <> ''").withColumn("odds", odds).filter((F.col("n1") >= LEAST_ROWS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc(F.col("n1") * F.log("odds")), "stem").limit(MOST_STEMS).collect()
    kept: dict[str, float] = {}
    for row in sorted(best, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(kept.get(row["stem"][:n], 0.0) >= 0.5 * row["odds"] for n in STEMS if n < len(row["stem"])):
            kept[row["stem"]] = row["odds"]
    return kept


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = TOXIC_LABEL) -> Model | None:
    """A model of the rows whose labels may be learned; None for no rows."""
    limit_batches(docs.sparkSession)
    rows, counts = sample(docs, labels, id_col, text_col, label_col)
    rows = written(rows, "toxic-sample")
    voters = Voters(mined(rows.filter("half = 0")))

    @F.arrow_udf("binary")
    def counted_bytes(texts: pa.Array) -> pa.Array:
        return pa.array([voters.counts(t).tobytes() for t in texts.to_pylist()], pa.binary())

    got = rows.filter("half = 1").orderBy("id").select("label", counted_bytes("text").alias("x")).collect()
    if not got:
        return None
    counted = np.stack([np.frombuffer(r["x"]) for r in got])
    given = np.array([-1 if r["label"] is None else r["label"] for r in got])
    share = np.clip((counts.get(1, 0) + 1) / (sum(counts.values()) + 2), 0.01, 0.99)
    weight = np.ones(len(got))
    for c in (0, 1):
        # A drawn row stands for all of its label.
        if (given == c).any():
            weight[given == c] = (share if c else 1 - share) * (given >= 0).sum() / (given == c).sum()
    votes = grades(counted)
    truth = LabelModel(votes, given, weight, float(share)).truth
    return Model(voters, counted, truth, weight)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), one row a document."""
    limit_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counted = np.stack([model.voters.counts(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, len(Voters.names) + HASHED))
            yield pa.array(model.score(counted), pa.float64())

    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), (F.lit(0.0) if model is None else of(F.col(text_col))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
