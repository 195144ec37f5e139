"""Language identification in two steps: first the family, then one-versus-one linear SVMs inside it.

Features are hashed byte n-grams (one to three bytes, letters folded, all else one space) of the whole
text, square-rooted counts of unit length. Families are told apart by one-versus-one linear support vector
machines over all their languages; inside a family of several languages each pair has its own machine.
Machines are fitted by accelerated gradient descent on the squared hinge loss, so a rerun agrees.

Fitting takes a bounded sample of labelled rows: at most ROWS_PER_LANGUAGE of a language and SAMPLE_ROWS in
all, those with the smallest hashes of their ids. Only the sample's feature rows reach the driver. Every
text of the input is predicted in full.

Defined results: a text that is null or has no letter is `und` with score 0; labels that are null are never
learned; with no labelled row every text is `und`; with one language every other text is that language;
ids may be null or repeated; extra columns are ignored by predict() and kept by keep_known().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilflow.llm import shingles
from vigilflow.llm.common import limit_batches

#: Related languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"
SIZE = 1 << 12
ROWS_PER_LANGUAGE, SAMPLE_ROWS = 500, 4000
#: Steepness of the score: how sure a margin of one is.
SLOPE = 3.0
#: (letters, likeness): a text of so many letters whose likeness is lower is in no learned language. Measured on
#: 266,000 documents in learned languages: 0.437 or more from 30 letters on and 0.527 from 200 on; Finnish, Czech,
#: Turkish, Russian, Greek, Arabic and Japanese sentences: 0.04 to 0.45, whatever their length (Dutch: 0.56).
UNLIKE = ((30, 0.40), (200, 0.50))

_fold = np.full(256, 32, np.uint8)
_fold[128:] = np.arange(128, 256)
_fold[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


#: Bytes of text that are counted at a time.
PIECE = 1 << 19


def counts(data: np.ndarray, offsets: np.ndarray, begin: int | None = None) -> np.ndarray:
    """Hashed n-grams of each text that lies between offsets, one row of SIZE counts each; of the first begin places only, if given."""
    n = len(offsets) - 1
    folded = _fold[data].astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int64) * SIZE, np.diff(offsets))
    out = np.zeros(n * SIZE, np.float32)
    code = np.zeros(len(folded), np.int64)
    for size in (1, 2, 3):
        if len(folded) < size:
            break
        code = code[: len(folded) - size + 1] * 256 + folded[size - 1 :]
        # n-grams stay inside their text.
        inside = owner[: len(code)] == owner[size - 1 :]
        if begin is not None:
            inside[begin:] = False
        slot = ((code + (size << 26)) * 0x9E3779B1 >> 15) & (SIZE - 1)
        out += np.bincount((owner[: len(code)] + slot)[inside], minlength=n * SIZE).astype(np.float32)
    return out.reshape(n, SIZE)


def unit(counted: np.ndarray) -> np.ndarray:
    """Square-rooted counts of unit length."""
    rows = np.sqrt(counted)
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """One row of SIZE values for each text that lies between offsets. A text longer than a piece is counted piece by piece, so memory follows the piece."""
    if len(offsets) != 2 or offsets[1] - offsets[0] <= piece:
        return unit(counts(data, offsets))
    total = np.zeros((1, SIZE))
    for low in range(0, len(data), piece):
        # Two bytes more: n-grams that begin in this piece and end in the next.
        part = data[low : low + piece + 2]
        total += counts(part, np.array([0, len(part)]), piece)
    return unit(total)


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in shingles.chunks(texts, PIECE):
        yield features(data, offsets)


def fit_svm(x: np.ndarray, positive: np.ndarray, decay: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine: squared hinge loss, classes of equal weight."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), np.float32(0)
    last, last_bias, step = w, bias, 0.25
    for i in range(steps):
        pull = np.float32(i / (i + 3))
        ahead, ahead_bias = w + pull * (w - last), bias + pull * (bias - last_bias)
        slack = np.maximum(0, 1 - y * (x @ ahead + ahead_bias))
        force = 2 * share * slack * y
        last, last_bias = w, bias
        w = ahead + step * (x.T @ force - decay * ahead)
        bias = ahead_bias + np.float32(step * force.sum())
    return w, float(bias)


class Model:
    """Machines between families, and between the languages of each."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, families: dict[str, tuple[str, ...]] | None = None):
        of = {lang: name for name, langs in (families or FAMILIES).items() for lang in langs}
        self.languages = sorted(set(labels))
        family = np.array([of.get(lang, f"={lang}") for lang in labels])
        self.families = sorted(set(family))
        self.members = {f: sorted({lang for lang in self.languages if of.get(lang, f"={lang}") == f}) for f in self.families}
        self.between = self._pairs(x, family, self.families)
        self.inside = {f: self._pairs(x[family == f], labels[family == f], m) for f, m in self.members.items()}
        centres = np.stack([x[labels == lang].mean(axis=0) for lang in self.languages])
        self.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _pairs(x: np.ndarray, labels: np.ndarray, names: list[str]) -> list[tuple[int, int, np.ndarray, float]]:
        out = []
        for a, b in combinations(range(len(names)), 2):
            rows = (labels == names[a]) | (labels == names[b])
            out.append((a, b, *fit_svm(x[rows], labels[rows] == names[a])))
        return out

    @staticmethod
    def _vote(x: np.ndarray, pairs: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The name with most duels won (ties: most sure), and how sure its closest duel is."""
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        votes, least = np.zeros((len(x), n)), np.ones((len(x), n))
        for a, b, w, bias in pairs:
            sure = 1 / (1 + np.exp(-SLOPE * (x @ w + bias).astype(np.float64)))
            votes[:, a] += (sure >= 0.5) + sure * 1e-3
            votes[:, b] += (sure < 0.5) + (1 - sure) * 1e-3
            least[:, a] = np.minimum(least[:, a], sure)
            least[:, b] = np.minimum(least[:, b], 1 - sure)
        best = votes.argmax(axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and likeness (cosine with the mean of the language's rows) of each row."""
        family, sure = self._vote(x, self.between, len(self.families))
        labels, score = [UNKNOWN] * len(x), np.zeros(len(x))
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            members = self.members[name]
            best, inner = self._vote(x[rows], self.inside[name], len(members))
            score[rows] = sure[rows] * inner
            for r, b in zip(rows, best, strict=True):
                labels[r] = members[b]
        centre = self.centres[[self.languages.index(lang) for lang in labels]]
        return labels, np.clip(score, 0, 1), (x * centre).sum(axis=1)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by crc32 of its id as text (a null id: the empty text) is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = ROWS_PER_LANGUAGE, most: int = SAMPLE_ROWS) -> DataFrame:
    """The bounded training sample: (label, text); rows with the smallest hashes of each language. Of more labels than most, the most frequent are learned, one row each."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(
        F.col("label").isNotNull() & ~held_out(F.col(id_col)) & F.col("text").isNotNull()
    )
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most).collect()}
    each = max(1, min(per_language, most // max(1, len(counts))))
    # Rows are thinned by hash first, so that no window holds all of a language.
    space = 1 << 30
    keep = {lang: space if n <= 4 * each else int(space * (2 * each + 50) / n) for lang, n in counts.items()}
    if not keep:
        return labelled.select("label", "text").limit(0)
    limits = docs.sparkSession.createDataFrame(list(keep.items()), "label string, most long")
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(space))
    thin = labelled.withColumn("draw", draw).join(F.broadcast(limits), "label").filter("draw < most")
    order = Window.partitionBy("label").orderBy("draw", "id", F.xxhash64("text"))
    return thin.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= each).select("label", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", families: dict[str, tuple[str, ...]] | None = None) -> Model | None:
    """A model of the labelled rows that aren't held out; None without any."""
    limit_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def row_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([r.tobytes() for part in _rows(texts) for r in part], pa.binary())

    rows = sample(docs, id_col, text_col, label_col).filter(has_letter(F.col("text"))).select("label", row_bytes("text").alias("x")).collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    return Model(x, np.array([r["label"] for r in rows]), families)


def predicted(model: Model | None, text: Column) -> Column:
    """struct<lang, score, likeness> of a text."""

    @F.arrow_udf("struct<lang:string,score:double,likeness:double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            labels, scores, alike = [], [np.zeros(0)], [np.zeros(0)]
            for x in _rows(texts):
                some, sure, like = model.predict(x)
                labels += some
                scores.append(sure)
                alike.append(like)
            whole = lambda parts: pa.array(np.concatenate(parts), pa.float64())
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), whole(scores), whole(alike)], names=["lang", "score", "likeness"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("likeness"))
    if model is None:
        return nothing
    return F.when(has_letter(text), of(text)).otherwise(nothing)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score), one row a document."""
    limit_batches(docs.sparkSession)
    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predicted(model, F.col(text_col)).alias("_p"))
    return found.select(id_col, "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text", unlike: tuple[tuple[int, float], ...] = UNLIKE) -> DataFrame:
    """The rows of docs, all columns, in a language that was learned.

    Texts without a letter go, and texts that are too unlike the language predicted for so many letters: those in
    languages or scripts that were not learned, or in none. Shorter ones stay, as a word tells no language.
    """
    limit_batches(docs.sparkSession)
    columns = docs.columns
    marked = docs.withColumn("__lang", predicted(model, F.col(text_col)))
    letters, alike = F.length(F.regexp_replace(F.col(text_col), r"\P{L}+", "")), F.col("__lang.likeness")
    odd = F.lit(False)
    for least, value in unlike:
        odd = odd | ((alike < value) & (letters >= least))
    return marked.filter((F.col("__lang.lang") != UNKNOWN) & ~odd).select(*columns)
