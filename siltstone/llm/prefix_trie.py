"""The trie of conversations: nodes are the distinct beginnings of conversations, turn by turn.

Conversations are dealt to shards, ranges of their ids of a bounded number of
turns, and long ones are cut into blocks of turns. A shard indexes each (position, turn) to
the bitset of its conversations that have that turn there, and walks depth-first:
a node's bitset and the posting of the next turn of its lowest member give a
child, until no member is left; the counts are popcounts, and the members whose
last turn this is are its end list. Nodes of all shards then meet by a 128-bit
hash of their turns, at most one row for each shard, and are added up.

A node belongs to its smallest member. The nodes of one conversation lie one
below the other, so what lies below a node is the rest of its conversation's
nodes and all nodes of those that leave them further down. Sums over subtrees
are so taken without following links and without a row for each node and ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, table, written

#: Turns of a shard, about, and of a block of a conversation.
SHARD = 8192
BLOCK = 64

_KEY = ("a", "b")
_EMPTY = hashlib.sha256().hexdigest()
_NODES = "shard long, a long, b long, up_a long, up_b long, depth long, n long, conv_id long, chars long, members array<long>, first_end long, ends string"


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, h1, h2, chars): each turn's place in the order of all turns, and its hashes and code points.

    Turns follow in the order of conversation, turn (null first), role and text;
    texts that agree in their first 64 code points follow in the order of their
    hashes. A null role or text counts as empty; rows without a conversation id
    belong to none and are left out. The order is one of all partitions, so a
    conversation of any length is dealt to many.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("lead"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.length(text).cast("long").alias("chars"),
    )
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "lead", "h1", "h2")
    place = F.monotonically_increasing_id()
    kept = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "h1", "h2", "chars", place.alias("place"))
    return written(kept, "turns").withColumns({"part": F.shiftright("place", 33), "at": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})


def _pieces(placed: DataFrame) -> DataFrame:
    """(conv_id, part, low, before, n, shard): where the turns of a conversation begin in each part, how many came before, how many there are."""
    per = placed.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("own"))
    by = Window.partitionBy("conv_id")
    upto = F.sum("own").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min(F.struct("part", "low")).over(by)
    shard = F.shiftleft(first["part"], 32).bitwiseOR(F.floor(first["low"] / SHARD))
    return per.select("conv_id", "part", "low", (upto - F.col("own")).alias("before"), F.sum("own").over(by).alias("n"), shard.alias("shard"))


def _rows(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, shard, length, depth, h1, h2, chars) with hashes that hold for their depth only, in the shared folder."""
    k1, k2 = F.xxhash64("h1", "h2", "depth"), F.xxhash64("depth", "h2", "h1")
    root = F.col("depth") == 0
    named = turns.select("conv_id", "shard", "length", "depth", F.when(root, 0).otherwise(k1).alias("k1"), F.when(root, 0).otherwise(k2).alias("k2"), "chars")
    return written(named.withColumn("block", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BLOCK)), "paths")


def own_turns(conversations: DataFrame) -> DataFrame:
    """The conversations as they are, as rows of turns for ``trie``; see ``placed_turns`` for their order, nulls and ties."""
    return rebuilt_turns(conversations, 1, F.lit(0))


def rebuilt_turns(conversations: DataFrame, group: int = 100, heads: Column | None = None) -> DataFrame:
    """Conversations that begin as the first one of their group does, as rows of turns for ``trie``.

    Conversation c takes the first h turns of conversation c - c % ``group``, all
    if it has fewer, and none if there is no such conversation, then its own turns
    after its first h. ``heads`` is h, at most 5: by default the CRC-32 of
    the id's decimal digits modulo 6. A conversation of no turn keeps its row of
    depth 0. Order, nulls and ties are those of ``placed_turns``.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6 if heads is None else heads
    placed = placed_turns(conversations)
    pieces = written(_pieces(placed), "pieces")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = pieces.where("before = 0").select("conv_id", "shard", "n", base.alias("base"), heads.alias("h"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = written(convs.select("conv_id", "shard", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    turns = placed.join(pieces.select("conv_id", "part", "low", "before"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("low"))
    # What is known of a conversation goes to its turns by its pieces: one row for each part, however many turns there are.
    known = pieces.select("conv_id", "part", "low", "before").join(convs, "conv_id")
    own = placed.join(known, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("low")).where("pos >= h")
    own = own.select("conv_id", "shard", "length", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "h1", "h2", "chars")
    head = turns.where((F.col("pos") < 5) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "chars")
    lent = convs.join(head, "base").where("pos < h").select("conv_id", "shard", "length", (F.col("pos") + 1).alias("depth"), "h1", "h2", "chars")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "shard", "length", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("chars"))
    return _rows(own.unionByName(lent).unionByName(roots))


def _blocks(turns: DataFrame) -> DataFrame:
    """``turns`` with the hash of all turns before their block."""
    zero = F.lit(0).cast("long")
    short = turns.where(f"length <= {BLOCK}").withColumns({"start_a": zero, "start_b": zero})
    long = turns.where(f"length > {BLOCK}")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = long.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("a"), F.bit_xor("k2").alias("b"))
    starts = starts.select("conv_id", "block", *(F.coalesce(F.bit_xor(k).over(before), zero).alias(f"start_{k}") for k in _KEY))
    return short.unionByName(long.join(starts, ["conv_id", "block"]))


class Shard:
    """The vertical bitmaps of the conversations of one shard in one block of positions, and the walk over them."""

    def __init__(self, rows: pa.Table) -> None:
        at = {name: rows[name].to_numpy() for name in ("conv_id", "length", "depth", "k1", "k2", "chars", "start_a", "start_b")}
        self.block = rows["block"][0].as_py()
        self.ids, member = np.unique(at["conv_id"], return_inverse=True)
        count = len(self.ids)
        length, starts = np.zeros(count, np.int64), np.zeros((count, 2), np.int64)
        length[member], starts[member, 0], starts[member, 1] = at["length"], at["start_a"], at["start_b"]
        self.base = BLOCK * self.block
        self.ending = self._bitsets(length, count)
        self.starting = self._bitsets(list(map(tuple, starts.tolist())), count)
        self.turns: list[list[tuple | None]] = [[None] * count for _ in range(BLOCK + 2)]
        self.postings: list[dict[tuple, int]] = [{} for _ in range(BLOCK + 2)]
        self.present = [0] * (BLOCK + 2)
        for m, depth, turn in zip(member.tolist(), at["depth"].tolist(), zip(at["k1"].tolist(), at["k2"].tolist(), at["chars"].tolist(), strict=True), strict=True):
            if depth:
                place, bit = depth - self.base, 1 << m
                self.turns[place][m] = turn
                self.postings[place][turn] = self.postings[place].get(turn, 0) | bit
                self.present[place] |= bit

    @staticmethod
    def _bitsets(keys, count: int) -> dict:
        found: dict = {}
        for m, key in enumerate(keys.tolist() if isinstance(keys, np.ndarray) else keys):
            found[key] = found.get(key, 0) | 1 << m
        return found

    def members(self, bits: int) -> list[int]:
        """The ids of a bitset's conversations, ascending."""
        raw = np.frombuffer(bits.to_bytes(len(self.ids) // 8 + 1, "little"), np.uint8)
        return self.ids[np.flatnonzero(np.unpackbits(raw, bitorder="little"))].tolist()

    def nodes(self) -> Iterator[tuple]:
        """(a, b, up_a, up_b, depth, n, conv_id, chars, members, first_end, ends) of each node of this block's positions."""
        for (a, b), bits in self.starting.items():
            if not self.block:
                yield self._node(a, b, None, None, 0, bits, 0)
            stack = [(a, b, 0, bits)]
            while stack:
                up_a, up_b, place, bits = stack.pop()
                left = bits & self.present[place + 1] if place < BLOCK else 0
                while left:
                    turn = self.turns[place + 1][(left & -left).bit_length() - 1]
                    inside = left & self.postings[place + 1][turn]
                    left ^= inside
                    a, b = up_a ^ turn[0], up_b ^ turn[1]
                    yield self._node(a, b, up_a, up_b, self.base + place + 1, inside, turn[2])
                    stack.append((a, b, place + 1, inside))

    def _node(self, a: int, b: int, up_a: int | None, up_b: int | None, depth: int, bits: int, chars: int) -> tuple:
        n, ended = bits.bit_count(), bits & self.ending.get(depth, 0)
        ends = self.members(ended) if ended else []
        return a, b, up_a, up_b, depth, n, int(self.ids[(bits & -bits).bit_length() - 1]), chars, self.members(bits) if n > 1 else None, ends[0] if ends else None, ",".join(map(str, ends)) if ends else None


def shard_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of each shard, with its members (null for one alone) and the ids of those that end there."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_NODES))

    def walk(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        columns = list(zip(*Shard(rows).nodes(), strict=True)) or [()] * (len(schema) - 1)
        return pa.table([pa.array([shard] * len(columns[0]), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return written(_blocks(turns).groupBy("shard", "block").applyInArrow(walk, _NODES), "shard-nodes")


def _end_hashes(parts: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): end lists of all shards, one after the other, hashed as they pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for a, b, ends in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (a, b) == now:
                    digest.update(b",")
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256()
                digest.update(ends.encode())
            yield _digests(done)
        if now:
            yield _digests([(*now, digest.hexdigest())])

    ends = parts.where("ends is not null").select(*_KEY, "first_end", "ends").repartition(*_KEY).sortWithinPartitions(*_KEY, "first_end").select(*_KEY, "ends")
    return ends.mapInArrow(run, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])


def _sums_below(values: DataFrame, block: int = 1024) -> DataFrame:
    """``values`` (conv_id, depth, saved, leaves) added up from each depth downwards; long conversations in blocks of depths."""
    by = values.groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).withColumn("part", F.floor(F.col("depth") / block))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = by.groupBy("conv_id", "part").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    rest = whole.select("conv_id", "part", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"more_{c}") for c in ("saved", "leaves")))
    runs = by.select("conv_id", "part", "depth", *(F.sum(c).over(inside).alias(c) for c in ("saved", "leaves")))
    return runs.join(rest, ["conv_id", "part"]).select("conv_id", "depth", *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in ("saved", "leaves")))


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of all conversations of ``turns``, as ``own_turns`` or ``rebuilt_turns`` give them.

    conv_id is a node's smallest member, depth its number of turns,
    parent_conv_id its parent's conv_id (null for the root), n_convs its members,
    n_children and n_leaves its children and the childless nodes of its subtree,
    saved_tokens the sum over its subtree of (n_convs - 1) times the code points
    of a node's last text, and ends_sha256 the hash of the ids of the members that
    end there, ascending and joined by commas. conv_id and depth are unique.
    Without conversations there is no node, not even a root.
    """
    parts = shard_nodes(turns)
    whole = parts.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.sum("n").alias("n_convs"))
    known = written(parts.drop("first_end", "ends").join(whole, list(_KEY)), "nodes")
    nodes = known.where("conv_id = owner").select("shard", *_KEY, "up_a", "up_b", "depth", "chars", "owner", "n_convs")
    children = nodes.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    # A node's parent is in the same shard, where no key has more rows than the shard.
    parents = known.select("shard", F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("parent_conv_id"))
    nodes = nodes.join(children, list(_KEY), "left").join(_end_hashes(parts), list(_KEY), "left").join(parents, ["shard", "up_a", "up_b"], "left")
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    nodes = written(nodes.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), saved), "trie")
    own = nodes.select("conv_id", "depth", "saved", (F.col("n_children") == 0).cast("long").alias("leaves"))
    chains = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    # Where a conversation leaves the nodes of each of the others that own some of its own.
    met = known.select(F.explode(F.coalesce("members", F.array("conv_id"))).alias("conv_id"), "owner", "depth").where("conv_id <> owner")
    left = met.groupBy("conv_id", "owner").agg(F.max("depth").alias("depth")).join(chains, "conv_id")
    sums = _sums_below(own.unionByName(left.select(F.col("owner").alias("conv_id"), "depth", "saved", "leaves")))
    found = nodes.drop("saved").join(sums, ["conv_id", "depth"])
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``: see ``rebuilt_turns`` and ``trie``."""
    return trie(rebuilt_turns(table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH o AS (
  SELECT conv_id, list(md5(concat(length(coalesce(role, '')), ':', role, text)) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
    list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
),
c AS (SELECT *, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns, list_concat(coalesce(b.chars, [])[1:h], c.chars[h + 1:]) AS chars FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
d AS (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM r),
k AS (
  SELECT conv_id, depth, md5(array_to_string(turns[1:depth], ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(turns[1:depth - 1], ',')) END AS up,
    CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END AS chars, depth = len(turns) AS ends FROM d
),
n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS owner, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM k GROUP BY 1),
u AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
s AS (
  SELECT a.node, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE u.node IS NULL) AS n_leaves
  FROM n JOIN k a ON a.conv_id = n.owner AND a.depth <= n.depth LEFT JOIN u ON u.node = n.node GROUP BY 1
)
SELECT n.owner AS conv_id, n.depth, p.owner AS parent_conv_id, n.n_convs, coalesce(u.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN u USING (node) LEFT JOIN n p ON p.node = n.up
"""
