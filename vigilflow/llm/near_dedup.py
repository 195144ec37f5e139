"""Near-duplicate classes by DartMinHash and banded joining.

A text is the multiset of its word shingles (shingles.SHINGLE words); similarity is weighted Jaccard.
Each occurrence of a shingle is a region of weight one, in which darts arrive at the exponential times
that hashes of the region give. A text keeps the darts that arrive before a time that leaves it about
K ln K + 2K of them, deals them to K coordinates by hash and keeps the earliest of each; where a
coordinate stays empty it waits twice as long. Two texts agree in a coordinate with the chance of their
weighted Jaccard similarity. BANDS of ROWS coordinates: at similarity 0.8 a pair shares no band with
a chance of (1 - 0.8**5)**25 = 5e-5.

Texts that are equal after normalisation are one node, found by two 64-bit hashes before any comparison. Nodes of a
band bucket aren't paired with each other: each is compared with one leader of its bucket, exactly, and
links make components. A bucket that then holds nodes of more than one component is still open. In a small
one (SMALL nodes or fewer) the nodes of different components are compared. In a large one, nodes outside its hub's
component are compared with the hub, the node that shares most of the large buckets (where copies differ from one
text and more from each other, that text). Large buckets that are open even then and overlap make a
group, whose components are compared in full, in blocks of bounded size: a block counts the shared shingles of all
its texts by a matrix product and returns a spanning forest of the links, not the pairs. Two chunks of one
component make no block. So no cap loses a link; a component of n texts that r others are left beside is sent
to r / CHUNK_NODES blocks. Joins by a node or a leader with very many
rows are plain joins that adaptive execution splits; sums by them are taken in each task first. Nothing but row
counts reaches the driver.

Defined results: a null or empty text, or one without words, forms a class with the rows of equal text
(null with null); texts of one to four words compare as one shingle; a class's id is its smallest doc_id
that isn't null; repeated rows are in one class; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilflow.llm import shingles
from vigilflow.llm.common import limit_batches, normalized, written

BANDS, ROWS = 25, 5
K = BANDS * ROWS
SIMILARITY = 0.8
#: Nodes in a bucket up to which the pairs of an open bucket are listed.
SMALL = 8
#: Shingles and nodes that a chunk of a group holds on average; a block compares two chunks.
CHUNK_SHINGLES, CHUNK_NODES = 1 << 20, 1024


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(hashes: np.ndarray, bounds: np.ndarray, k: int = K) -> np.ndarray:
    """One row of k dart ids for each multiset of hashes between bounds; rows of empty ones are 0."""
    n = len(bounds) - 1
    out = np.zeros((n, k), np.uint64)
    sizes = np.diff(bounds)
    owners = np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        regions = shingles.mix(hashes + shingles.occurrences(hashes, owners).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        todo = np.flatnonzero(sizes > 0)
        wait = (k * np.log(k) + 2 * k) / np.maximum(sizes, 1)
        while len(todo):
            if len(todo) < n:
                kept = np.isin(owners, todo)
                own, seeds = owners[kept], regions[kept]
            else:
                own, seeds = owners, regions
            arrived = np.zeros(len(own))
            dart = shingles.mix(seeds + np.uint64(0x9E3779B97F4A7C15))
            ids, times, of = [], [], []
            while len(own):
                # The next dart of each region comes after an exponential time.
                arrived = arrived - np.log(_uniform(shingles.mix(dart ^ np.uint64(0x6A09E667F3BCC909))))
                soon = arrived < wait[own]
                own, arrived, dart = own[soon], arrived[soon], dart[soon]
                ids.append(dart)
                times.append(arrived)
                of.append(own)
                dart = shingles.mix(dart + np.uint64(0x9E3779B97F4A7C15))
            ids, times, of = np.concatenate(ids), np.concatenate(times), np.concatenate(of)
            cell = of * k + (shingles.mix(ids ^ np.uint64(0xBB67AE8584CAA73B)) % np.uint64(k)).astype(np.int64)
            # The latest first, so that the earliest of a cell is written last.
            order = np.argsort(-times)
            flat = out.reshape(-1)
            flat[cell[order]] = ids[order] | np.uint64(1)
            todo = todo[(out[todo] == 0).any(axis=1)]
            out[todo] = 0
            wait[todo] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit hash for each band of each signature."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), bands, rows)
        mixed = np.zeros((len(signatures), bands), np.uint64)
        for j in range(rows):
            mixed = shingles.mix(mixed + parts[:, :, j])
        mixed = shingles.mix(mixed + np.arange(bands, dtype=np.uint64) * np.uint64(0x3C6EF372FE94F82B))
    return mixed.view(np.int64)


def _bands_of(bands: int, rows: int):
    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values, counts = [], np.zeros(len(texts), np.int64)
            for first, last, hashes, bounds, _ in shingles.text_shingles(texts):
                full = np.diff(bounds) > 0
                counts[first:last] = full * bands
                values.append(band_hashes(dart_signatures(hashes, bounds, bands * rows), bands, rows)[full].reshape(-1))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, pa.int64()))

    return of


def _similarity():
    @F.arrow_udf("double")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([shingles.weighted_jaccard(x, y) for x, y in zip(_each(left), _each(right), strict=True)], pa.float64())

    return of


def _each(texts: pa.Array) -> Iterator[np.ndarray]:
    for first, last, hashes, bounds, _ in shingles.text_shingles(texts):
        for i in range(last - first):
            yield hashes[bounds[i] : bounds[i + 1]]


def _node(text: Column, norm: Column, seed: int = 0) -> Column:
    """A 64-bit hash of the normalised text; of the raw text where no word is left. Seeds give hashes that collide independently."""
    return F.when(norm != "", F.xxhash64(F.lit(seed), norm)).otherwise(F.xxhash64(F.lit(seed), text.isNull(), text))


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label): each linked node with a node that stands for its component.

    Rounds of contraction: each vertex takes the smallest vertex around it, and that one's own choice at once;
    links are renamed, those inside a vertex go, equal ones become one. The links shrink each round, and so do the
    joins; rounds grow with the logarithm of a component's length. Each round is written out.
    """
    links = edges
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not links.isEmpty():
        both = links.select(F.col("a").alias("vertex"), F.col("b").alias("other")).union(links.select("b", "a"))
        least = written(both.groupBy("vertex").agg(F.least(F.col("vertex"), F.min("other")).alias("to")), "labels")
        up = least.select(F.col("vertex").alias("to"), F.col("to").alias("next"))
        moves = written(least.join(up, "to").select("vertex", "next"), "labels")
        of_a, of_b = moves.select(F.col("vertex").alias("a"), F.col("next").alias("to_a")), moves.select(F.col("vertex").alias("b"), F.col("next").alias("to_b"))
        labels = written(labels.join(moves.withColumnRenamed("vertex", "label"), "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        links = written(links.join(of_a, "a").join(of_b, "b").filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
    return labels


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; texts are joined by shuffles, the pairs' many-to-one side last."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("norm").alias("norm_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("norm_a")), "a")
    return with_both.withColumn("similarity", _similarity()("norm_a", "norm_b")).filter(F.col("similarity") >= similarity).select("a", "b")


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the smallest row of its component."""
    root = np.arange(len(near))
    for start in range(len(near)):
        if root[start] < start or not near[start].any():
            continue
        front = np.array([start])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & (root > start))
            root[reached] = start
            front = reached
    return root


def linked_block(nodes: np.ndarray, sets: list[np.ndarray], similarity: float, columns: int = 4096) -> list[tuple[int, int]]:
    """(root, node) links that join each component of the texts of a block; exact weighted Jaccard of all pairs."""
    owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    hashes = np.concatenate(sets)
    with np.errstate(over="ignore"):
        # An occurrence is an element: shared elements count as the smaller of two weights.
        elements = shingles.mix(hashes + shingles.occurrences(hashes, owners).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, element, times = np.unique(elements, return_inverse=True, return_counts=True)
    common = times[element] > 1
    dense = np.cumsum(times > 1) - 1
    element, owner = dense[element[common]], owners[common]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        i, j = np.searchsorted(element, [low, low + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[i:j], element[i:j] - low] = 1
        shared += held @ held.T
    sizes = np.array([len(x) for x in sets], np.float32)
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-3
    np.fill_diagonal(near, False)
    root = _forest(near)
    return [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(root) if r != i]


def _dealt(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(label, low, high, node): the blocks of the groups, each between two chunks of a group, and the nodes of both.

    members has rows (node, label, part): label names the group, part the component that the node is in. A component
    that fills more than one chunk has chunks of its own, which meet those of all others and not each other; the rest of
    a group shares its chunks. Rows carry no texts, as a group may hold very many.
    """
    fill = F.greatest(F.ceil(F.sum("size") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_NODES)).cast("int").alias("own")
    weighed = written(texts.select("node", (F.length("norm") / 6).alias("size")).join(members, "node"), "dart-sizes")
    large = weighed.groupBy("label", "part").agg(fill).filter("own > 1").select("label", "part", F.lit(True).alias("large"))
    pool = F.coalesce("large", F.lit(False))
    pooled = weighed.join(large, ["label", "part"], "left").select("label", "node", "size", pool.alias("alone"), F.when(pool, F.col("part")).otherwise(0).alias("pool"))
    pooled = written(pooled, "dart-pools")
    # One row a pool: at most one for each CHUNK_NODES nodes or CHUNK_SHINGLES shingles of a group, and one more.
    group = Window.partitionBy("label")
    before = F.coalesce(F.sum("own").over(group.orderBy("alone", "pool").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = pooled.groupBy("label", "alone", "pool").agg(fill).withColumn("before", before).withColumn("chunks", F.sum("own").over(group))
    rows = pooled.join(sums, ["label", "alone", "pool"]).withColumn("chunk", F.col("before") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("own")))
    # A chunk meets every other once; alone in its group it meets itself.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.filter((F.col("chunk") != F.col("other")) | (F.col("chunks") == 1))
    rows = rows.filter(~F.col("alone") | (F.col("other") < F.col("before")) | (F.col("other") >= F.col("before") + F.col("own")))
    return written(rows.select("label", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node"), "dart-blocks")


def _block_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components of a group (members as in _dealt). Texts join last, by node; each block is a group
    of its own for the shuffle, whatever group it belongs to."""
    dealt = _dealt(members, texts).join(texts, "node").select("label", "low", "high", "node", "norm")

    def links(table: pa.Table) -> pa.Table:
        nodes, texts_of = table.column("node").to_numpy(), table.column("norm").combine_chunks()
        found = linked_block(nodes, list(_each(texts_of)), similarity)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return dealt.groupBy("label", "low", "high").applyInArrow(links, "a long, b long")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (bucket, node, n, leader, label) of buckets whose nodes are in more than one component."""
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("bucket")
    return written(labelled.join(mixed, "bucket"), "dart-open")


def _hub_pairs(large: DataFrame) -> DataFrame:
    """(a, b): each node of a large open bucket (b) with the bucket's hub (a), where their components differ."""
    weighed = large.join(large.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    hub = F.max(F.struct("weight", "node", "label")).alias("hub")
    hubs = weighed.groupBy("bucket").agg(hub).select("bucket", F.col("hub.node").alias("a"), F.col("hub.label").alias("of_a"))
    # A hub that leads its bucket has met its nodes.
    return large.join(hubs, "bucket").filter("label <> of_a and a <> leader").select("a", F.col("node").alias("b")).distinct()


def _apart(signed: DataFrame, twins: DataFrame) -> DataFrame:
    """signed, where different texts that share a node get nodes of their own, by their second hash."""
    marked = signed.join(twins.select("node", F.lit(True).alias("twin")), "node", "left")
    return written(marked.withColumn("node", F.when(F.col("twin"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("twin"), "dart-apart")


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, node, check, bands, norm) of each row, and (node, bands) of each node with words.

    Texts are normalised once, here. Two 64-bit hashes tell texts apart: where one node holds two values of the
    second, its texts differ (about one such node in 10**10 texts) and it is split.
    """
    text = F.col(text_col)
    normed = docs.select(F.col(id_col).alias("id"), text.alias("text"), normalized(text).alias("norm"))
    node, check = (_node(F.col("text"), F.col("norm"), seed) for seed in (0, 1))
    signed = written(normed.select("id", node.alias("node"), check.alias("check"), _bands_of(bands, rows)("norm").alias("bands"), "norm"), "dart-bands")
    sides = written(signed.groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).filter("c0 <> c1"), "dart-twins")
    if not sides.isEmpty():
        signed = _apart(signed, sides)
    return signed, signed.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (id, node), and (node, label, low, n): each node's component, smallest id and rows."""
    limit_batches(docs.sparkSession)
    signed, nodes = _signed(docs, id_col, text_col, bands, rows)
    members = signed.select("id", "node")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
    in_bucket = written(buckets.join(shared, "bucket"), "dart-buckets")
    # Texts of the nodes that share any bucket, once each; each task sends one of a node's copies.
    wanted = in_bucket.select("node").distinct()
    texts = signed.filter("norm <> ''").groupBy("node").agg(F.first("norm").alias("norm"))
    texts = written(texts.join(wanted, "node", "left_semi"), "dart-texts")

    tried = written(in_bucket.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "dart-pairs")
    edges = written(_verified(tried, texts, similarity), "dart-links")
    labels = _labels(edges)
    still = _open(in_bucket, labels)

    few = still.filter(F.col("n") <= SMALL)
    left = few.select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = few.select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"))
    pairs = left.join(right, "bucket").filter("a < b and label_a <> label_b").select("a", "b").distinct()
    untried = pairs.join(tried, ["a", "b"], "left_anti")
    more = _verified(untried, texts, similarity)
    large = still.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        edges = edges.union(written(_verified(written(_hub_pairs(large), "dart-pairs"), texts, similarity), "dart-links"))
        labels = _labels(edges)
        large = _open(large.drop("label"), labels)
        many = written(large.select(F.col("leader").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct(), "dart-groups")
        if not many.isEmpty():
            parts = large.select("node", F.col("label").alias("part")).distinct()
            more = more.union(_block_links(_labels(many).join(parts, "node"), texts, similarity))
    more = written(more, "dart-links")
    if not more.isEmpty():
        labels = _labels(edges.union(more))
    # Row counts and smallest ids: first by node, then (where they are asked for) by component.
    by_node = members.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    return members, written(by_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "dart-nodes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, class_size), one row for each row of docs."""
    members, by_node = _grouped(docs, id_col, text_col, similarity, bands, rows)
    by_label = by_node.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    named = by_node.select("node", "label").join(by_label, "label").select("node", "class_id", "class_size")
    return members.join(named, "node").select(F.col("id").alias(id_col), "class_id", "class_size")


#: Ids (of a numeric type) up to which the rows to drop go to every task: 16 MB. More are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, less all but one of each class: the one of the smallest id (a null id comes last).

    Where ids are whole, the ids to drop are taken out of docs. Where some are null or repeated, rows are told by id and text.
    """
    members, by_node = _grouped(docs, id_col, text_col, similarity, bands, rows)
    first = F.min(F.struct(F.col("low").isNull().alias("no_id"), "low", "node")).alias("first")
    chosen = written(by_node.groupBy("label").agg(first).select(F.col("first.node").alias("__node"), F.col("first.low").alias("__low")), "dart-chosen")
    columns = docs.columns
    if members.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").isEmpty():
        lost = members.join(chosen, (members["node"] == chosen["__node"]) & (members["id"] == chosen["__low"]), "left_anti").select(F.col("id").alias(id_col))
        lost = written(lost, "dart-lost")
        few = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") and lost.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(lost) if few else lost, id_col, "left_anti").select(*columns)
    marked = docs.withColumn("__node", _node(F.col(text_col), normalized(F.col(text_col)))).withColumn("__check", _node(F.col(text_col), normalized(F.col(text_col)), 1))
    # A node that was split goes by its texts' second hash.
    known = chosen.select("__node").withColumn("__plain", F.lit(True))
    marked = marked.join(known, "__node", "left").withColumn("__node", F.when(F.col("__plain"), F.col("__node")).otherwise(F.xxhash64("__node", "__check"))).drop("__plain")
    kept = marked.join(chosen, (marked["__node"] == chosen["__node"]) & marked[id_col].eqNullSafe(chosen["__low"]), "left_semi")
    # Rows that repeat a chosen id and text: only these few ids need another look.
    rows_of = members.withColumnRenamed("node", "__node").join(chosen, "__node").filter(F.col("id").eqNullSafe(F.col("__low")))
    repeated = written(rows_of.groupBy("__node").agg(F.count("*").alias("n")).filter("n > 1").select("__node"), "dart-repeats")
    if repeated.isEmpty():
        return kept.select(*columns)
    once = kept.join(repeated, "__node", "left_anti")
    return once.unionByName(kept.join(repeated, "__node", "left_semi").dropDuplicates(["__node"])).select(*columns)
