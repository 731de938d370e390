"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes are dealt over buckets by their leading bits. Of a
bucket's smallest remainder the register keeps the number of leading zeros and
some mantissa bits. Bands of registers propose pairs; a Jaccard estimate from
the registers, corrected for accidental register collisions, discards hopeless
ones; the full sets decide.

Texts with the same shingle set are one node. Nodes that share bands, directly
or through others, are a cluster. A small cluster is settled by one task. A
large one is dealt to chunks, which share a few pivots; most of what is truly
linked is joined by that. What is still apart is held against the rest in
blocks, either of the whole cluster or of each band's group by itself,
whichever carries fewer rows: where many near copies leave few apart the
cluster, where many texts share bands but no links the groups. Pairs are never
rows: a block gives at most a spanning forest of its links, and pairs that are
already joined are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fresh, pieces, table, written
from .components import components
from .shingles import mixed, shingle_sets

BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
#: A pair at similarity 0.8 shares no band with a chance of (1 - 0.8**6)**42, 3 in a million.
BAND_ROWS, BANDS = 6, 42
_SALT = mixed(np.arange(1, BUCKETS + 1, dtype=np.uint64))
_ODD = mixed(np.arange(1000, 1000 + BAND_ROWS, dtype=np.uint64)) | np.uint64(1)


def register_values(rest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of remainders of 64 - BUCKET_BITS bits, never 0."""
    bits = 64 - BUCKET_BITS
    length = np.frexp(np.maximum(rest, 1).astype(np.float64))[1]
    length -= (rest >> (length - 1).astype(np.uint64)) == 0  # a number just below a power of two may round up
    zeros = bits - length
    below = rest ^ (np.uint64(1) << (length - 1).astype(np.uint64))
    up = np.maximum(MANTISSA_BITS - (length - 1), 0).astype(np.uint64)
    down = np.maximum(length - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    return (((zeros + 1) << MANTISSA_BITS) | ((below << up) >> down).astype(np.int64)).astype(np.uint16)


def _least_salted(hashes: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """For each empty bucket the place of the hash that is smallest once salted."""
    step = max(1, (1 << 18) // len(hashes))
    return np.concatenate([mixed(hashes[None, :] ^ _SALT[empty[k : k + step], None]).argmin(1) for k in range(0, len(empty), step)])


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set of hashes: the registers (0: empty bucket) and the band keys.

    For banding, an empty bucket has the register of the hash of the set that
    is smallest once salted by the bucket's number.
    """
    registers = np.zeros(BUCKETS, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    filled, least = bucket[first], hashes[first]
    registers[filled] = register_values(least & np.uint64((1 << 64 - BUCKET_BITS) - 1))
    lent = registers
    if len(filled) < BUCKETS:
        empty = np.flatnonzero(registers == 0)
        lent = registers.copy()
        chosen = hashes[_least_salted(hashes, empty)]
        lent[empty] = register_values(chosen & np.uint64((1 << 64 - BUCKET_BITS) - 1))
    with np.errstate(over="ignore"):
        rows = lent[: BAND_ROWS * BANDS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
        bands = mixed((mixed(rows + np.uint64(1)) * _ODD).sum(1) + _SALT[:BANDS])
    return registers, bands.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, and the number of buckets that each rests on."""
    either, both = ((a > 0) | (b > 0)).sum(1), ((a > 0) & (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    by_chance = both / np.maximum(either, 1) / 3 / (1 << MANTISSA_BITS)
    return np.clip((equal / np.maximum(either, 1) - by_chance) / (1 - by_chance), 0, 1), either


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            n, a, b, bands, texts = [], [], [], [], as_bytes(batch.column(1))
            with np.errstate(over="ignore"):
                for s in shingle_sets(texts, width):
                    n.append(len(s))
                    a.append(int(mixed(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)))
                    bands.append(sketch(s)[1] if len(s) else np.zeros(0, np.int64))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, a, b, map(len, texts))), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "ka", "kb", "bytes", "bands"])

    return run


class Forest:
    """Disjoint sets of nodes that remember the links which joined them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int, by_link: bool = True) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            if by_link:
                self.links.append((a, b))


class Block:
    """Nodes with their sets and registers."""

    def __init__(self, nodes: list[int], texts: list[bytes], width: int) -> None:
        self.nodes = np.array(nodes, np.int64)
        self.sets = shingle_sets(texts, width)
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.registers = np.stack([sketch(s)[0] for s in self.sets]) if nodes else np.zeros((0, BUCKETS), np.uint16)

    def hopeful(self, k: int, other: Block, least: float) -> np.ndarray:
        """The members of ``other`` that member ``k`` may be linked with, by size and estimate."""
        low, high = np.minimum(self.n[k], other.n), np.maximum(self.n[k], other.n)
        at = np.flatnonzero((low >= least * high) & (low > 0))
        guess, on = estimate(self.registers[k][None], other.registers[at])
        return at[guess >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(on, 1))]


def join_linked(left: Block, right: Block, percent: int, forest: Forest) -> None:
    """Joins what is linked by its full sets, unless joined already."""
    same = left is right
    for k in range(len(left.nodes)):
        node = int(left.nodes[k])
        for j in left.hopeful(k, right, percent / 100).tolist():
            if same and j <= k or forest.root(node) == forest.root(int(right.nodes[j])):
                continue
            x, y = left.sets[k], right.sets[j]
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                forest.join(node, int(right.nodes[j]))


def _block(group: pa.Table, width: int) -> Block:
    by = np.argsort(group["node"].to_numpy(), kind="stable")
    texts = as_bytes(group["text"].combine_chunks())
    return Block(group["node"].to_numpy()[by].tolist(), [texts[k] for k in by.tolist()], width)


#: A chunk holds about this many nodes and bytes of text; both bounds hold for a small cluster.
CHUNK, CHUNK_BYTES = 512, 16 << 20
PIVOTS = 8


def _chunks(n: str, size: str) -> str:
    """SQL for how many chunks ``n`` nodes of ``size`` bytes need."""
    return f"int(greatest(ceil({n} / {CHUNK}), ceil({size} / {CHUNK_BYTES}), 1))"


def _links(forest: Forest) -> pa.Table:
    a, b = zip(*forest.links, strict=True) if forest.links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _settle(rows: DataFrame, by: tuple[str, ...], width: int, percent: int) -> DataFrame:
    """(a, b): links that hold the components of each group of ``rows`` together."""

    def settle(group: pa.Table) -> pa.Table:
        forest, block = Forest(), _block(group, width)
        join_linked(block, block, percent, forest)
        return _links(forest)

    return rows.groupBy(*by).applyInArrow(settle, "a long, b long")


def _groups_apart(members: DataFrame, bands: DataFrame) -> DataFrame:
    """What is to be held against what: part, node, comp, apart, chunks, shares.

    ``members`` (cluster, node, bytes, comp) are labelled by what is joined
    already, ``bands`` (node, bands) are arrays of their bands, a row for each
    text of a node; they are opened only once they lie beside it. A part is a whole cluster or
    one band's group; of a part's nodes those outside its largest component
    are apart. A part without any is left out.
    """
    whole = members.select("cluster", F.lit(None).cast("long").alias("band"), "node", "bytes", "comp")
    grouped = members.join(bands, "node").select("cluster", F.explode("bands").alias("band"), "node", "bytes", "comp").distinct()
    every = whole.union(grouped).withColumn("part", F.struct("cluster", "band"))
    comps = every.groupBy("part", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    parts = comps.groupBy("part").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("b").alias("b")).where("n > most")
    parts = parts.withColumn("chunks", F.expr(_chunks("n", "b"))).withColumn("shares", F.expr(_chunks("(n - most)", "b * (n - most) / n")))
    parts = written(parts.withColumn("cost", F.expr("n * shares + (n - most) * chunks")), "near-parts")
    cost = parts.groupBy("part.cluster").agg(F.sum(F.when(F.col("part.band").isNull(), F.col("cost"))).alias("by_cluster"), F.sum(F.when(F.col("part.band").isNotNull(), F.col("cost"))).alias("by_band"))
    chosen = parts.join(cost, F.col("part.cluster") == cost["cluster"]).where("(part.band is null) = (by_cluster <= coalesce(by_band, 0))")
    return every.select("part", "node", "comp").join(chosen.select("part", "major", "chunks", "shares"), "part").withColumn("apart", F.expr("comp != major")).drop("major")


def _settle_large(rows: DataFrame, bands: DataFrame, width: int, percent: int) -> DataFrame:
    """The same for clusters of any size: chunks with shared pivots, then what is apart against the rest of its part."""
    chunked = rows.withColumn("chunks", F.expr(_chunks("size", "cluster_bytes"))).withColumn("chunk", F.expr("int(pmod(xxhash64(node), chunks))"))
    chunked = written(chunked, "near-large")
    order = "row_number() over (partition by cluster order by xxhash64(1, node), node)"
    pivots = chunked.withColumn("turn", F.expr(order)).where(F.col("turn") <= PIVOTS)
    pivots = pivots.select("cluster", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "node", "text")
    placed = chunked.select("cluster", "chunk", "node", "text").union(pivots).dropDuplicates(["cluster", "chunk", "node", "text"])
    first = written(_settle(placed, ("cluster", "chunk"), width, percent), "near-links")
    nodes = chunked.groupBy("cluster", "node").agg(F.sum(F.octet_length("text")).alias("bytes"))
    labelled = nodes.join(components(first), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = written(_groups_apart(written(labelled.select("cluster", "node", "bytes", "comp"), "near-labelled"), bands), "near-apart")
    texts = chunked.select("node", "text")
    # a text meets all blocks of its part: as one that is held, and if it is apart also as one that asks
    chunk, share = F.expr("int(pmod(xxhash64(3, node), chunks))").alias("chunk"), F.expr("int(pmod(xxhash64(2, node), shares))").alias("share")
    held = parts.select("part", chunk, F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "node", "comp").join(texts.hint("merge"), "node")
    asking = parts.where("apart").select("part", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), share, "node", "comp").join(texts.hint("merge"), "node")
    names = ("part", "chunk", "share", "node", "comp", "text")
    asking = asking.select(*(F.col(c).alias(f"{c}_asking") for c in names))  # names of their own, as both sides come from one table

    def across(one: pa.Table, other: pa.Table) -> pa.Table:
        one, forest = one.rename_columns(list(names)), Forest()
        for side in (one, other):
            for node, comp in zip(side["node"].to_pylist(), side["comp"].to_pylist(), strict=True):
                forest.join(node, comp, by_link=False)
        if one.num_rows and other.num_rows:
            join_linked(_block(one, width), _block(other, width), percent, forest)
        return _links(forest)

    asked, by = asking.groupBy(*(f"{c}_asking" for c in names[:3])), held.select(*names).groupBy(*names[:3])
    return first.union(asked.cogroup(by).applyInArrow(across, "a long, b long"))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs that are not white space, A-Z as a-z; the set holds the
    distinct shingles of ``width`` words, of a shorter text the whole text as
    one. Two documents are linked when their sets' similarity is ``percent``
    or more; component_id is the smallest doc_id reachable. Null, empty and
    blank texts have no shingles and no links: each is its own component. Rows
    that repeat a doc_id are one document with the links of each. A null
    doc_id is in no component (component_id and kept are null). Other columns
    are not looked at.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, n long, ka long, kb long, bytes long, bands array<long>"
    sketches = written(read.mapInArrow(_sketches(width), kind), "near-sketches")
    known = sketches.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("ka", "kb").agg(F.min("doc_id").alias("node")), "near-classes")

    placed = known.join(classes.withColumnRenamed("node", "doc_id"), ["ka", "kb", "doc_id"], "left_semi")
    rows = placed.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("band", "low")
    together = rows.join(shared.hint("merge"), "band").where("node != low").select("low", "node").distinct()
    # for being connected, a node's least low and that low's links to its others are enough
    least = together.withColumn("a", F.expr("min(low) over (partition by node)"))
    together = least.select("a", F.col("node").alias("b")).union(least.where("a != low").select("a", F.col("low").alias("b"))).distinct()
    clusters = components(together).withColumnRenamed("comp", "cluster")
    sizes = clusters.join(sketches.select(F.col("doc_id").alias("node"), "bytes"), "node").groupBy("cluster").agg(F.count("*").alias("size"), F.sum("bytes").alias("cluster_bytes"))
    members = written(read.withColumnRenamed("doc_id", "node").join(clusters.join(sizes, "cluster").hint("merge"), "node"), "near-members")

    small = F.expr(_chunks("size", "cluster_bytes")) == 1
    links = _settle(members.where(small), ("cluster",), width, percent)
    large = members.where(~small)
    if large.limit(1).count():
        nodes = written(large.select("node").distinct(), "near-large-nodes")  # written, so that the planner knows its size
        bands = known.select(F.col("doc_id").alias("node"), "bands").join(nodes, "node", "left_semi").distinct()
        links = links.union(_settle_large(large, written(bands, "near-bands"), width, percent))
    comps = components(links)
    by_class = classes.join(comps, "node", "left").select("ka", "kb", F.coalesce("comp", "node").alias("comp"))
    every = sketches.select("doc_id", F.col("n").alias("n_shingles"), "ka", "kb").join(by_class, ["ka", "kb"], "left")
    return every.select("doc_id", "n_shingles", F.expr("if(doc_id is null, null, if(n_shingles > 0, comp, doc_id))").alias("component_id")).withColumn("kept", F.expr("doc_id = component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of the smallest id, with all columns of ``docs``.

    A document without words, or without an id, stays. Rows that repeat the id that
    stays all stay; an empty table stays empty; columns of other names are carried along unread.
    """
    (stay,) = fresh(docs, "_stay")
    kept = near_components(docs, width, percent).where("kept").select(F.col("component_id").alias(stay)).distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, F.col("doc_id") == F.col(stay), "left_semi"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_components`` of all documents by shingles of two words at a similarity of 0.8; nulls, short texts, repeated rows and the empty table as there."""
    return near_components(table(spark, sf_dir, "documents"), width=2, percent=80)
