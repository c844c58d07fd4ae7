"""Conversation prefix trie: which conversations begin alike, and what sharing their beginnings saves.

Conversations are sorted as arrays of turns, over all partitions. In a sorted
partition each row shares its longest common prefix (LCP) with the row before it, so a
stack of open nodes is cut down to that depth and grown again: what is cut off is a
finished node. The nodes on the paths of a partition's first and last row may go on in
its neighbours; only those, a path or two for each partition, are stitched afterwards.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, integer_key, text_or_empty, write_table

#: Conversations start with up to SHARED - 1 turns of the conversation whose id is the next lower multiple of HUNDRED.
SHARED, HUNDRED = 6, 100

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: part, slot: a node that may go on in a neighbouring partition; up: the slot of a finished node's parent, where that may.
_SWEPT = _NODE + ", part int, slot long, up long, k1 long, k2 long, chars long, ends string"
_NAMES = [c.split()[0] for c in _SWEPT.split(", ")]
_ROWS = 20_000


class _Node:
    """An open node; its counts cover what is known of it so far, without children that are still open."""

    __slots__ = ("depth", "key", "chars", "slot", "low", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth, key, chars, slot):
        self.depth, self.key, self.chars, self.slot = depth, key, chars, slot
        self.low = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list = []
        self.waiting: list = []

    def member(self, low, n=1):
        self.n += n
        if low is not None and (self.low is None or low < self.low):
            self.low = low

    def close(self):
        """Count the node itself in its subtree."""
        self.saved += (self.n - 1) * self.chars
        self.leaves = self.leaves or 1

    def child(self, node):
        """Take in a closed child."""
        self.member(node.low, node.n)
        self.children += 1
        self.leaves += node.leaves
        self.saved += node.saved

    def row(self, **more):
        return {"conv_id": self.low, "depth": self.depth, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved} | more


def _joined(ids) -> str:
    return ",".join("" if i is None else str(i) for i in ids)


def _batches(rows, schema: pa.Schema):
    """``rows`` (dicts) as record batches."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def sweep(rows, part: int):
    """Sorted (key: two hashes for each turn, chars of each turn, conv_id) to the nodes of a partition, as dicts.

    A finished node is given out once its parent's smallest member is known: when the
    parent closes, or at once with ``up`` where the parent may go on elsewhere. What
    waits is at most the children of open nodes.
    """
    stack: list[_Node] = []
    edge: dict[int, _Node] = {}
    before, slots = None, 0

    def cut(depth: int):
        """Close all nodes deeper than ``depth``."""
        while len(stack) > depth + 1:
            node, parent = stack.pop(), stack[-1]
            if node.slot in edge:
                continue
            node.close()
            parent.child(node)
            for child in node.waiting:
                yield child | {"parent_conv_id": node.low}
            row = node.row(ends_sha256=sha256(_joined(node.ends).encode()).hexdigest())
            if parent.slot in edge:
                yield row | {"part": part, "up": parent.slot}
            else:
                parent.waiting.append(row)

    for key, chars, conv in rows:
        common = 0
        if before is not None:
            most = min(len(key), len(before)) // 2
            while common < most and key[2 * common] == before[2 * common] and key[2 * common + 1] == before[2 * common + 1]:
                common += 1
        else:
            stack.append(_Node(0, (None, None), 0, 0))
            edge[0], slots = stack[0], 1
        yield from cut(common)
        for d in range(common, len(chars)):
            node = _Node(d + 1, (key[2 * d], key[2 * d + 1]), chars[d], slots)
            stack.append(node)
            if before is None:
                edge[slots] = node
            slots += 1
        stack[-1].member(conv)
        stack[-1].ends.append(conv)
        before = key
    # The last row's path is open too; its nodes' finished children need not wait for it.
    for node in stack:
        for child in node.waiting:
            yield child | {"part": part, "up": node.slot}
        edge[node.slot] = node
    for slot, node in sorted(edge.items()):
        more = {"part": part, "slot": slot, "k1": node.key[0], "k2": node.key[1], "chars": node.chars}
        yield node.row(ends=_joined(node.ends) if node.ends else None, **more)


def _sweep_partition(batches):
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
    yield from _batches(sweep(rows, TaskContext.get().partitionId()), _schema(_SWEPT))


def stitch(rows):
    """The paths at the partitions' edges, in order of partition and slot, to whole nodes, and to each slot's conv_id (part and slot set).

    A partition's first path is merged with the open one as far as they agree; the rest
    of the open path is finished. Each text of ids is hashed as it comes.
    """
    stack: list[tuple] = []

    def cut(depth: int):
        while len(stack) > depth:
            node, digest, slots = stack.pop()
            node.close()
            for part, slot in slots:
                yield {"conv_id": node.low, "part": part, "slot": slot}
            for child in node.waiting:
                yield child | {"parent_conv_id": node.low}
            row = node.row(ends_sha256=digest.hexdigest())
            if stack:
                stack[-1][0].child(node)
                stack[-1][0].waiting.append(row)
            else:
                yield row

    for r in rows:
        depth, key = r["depth"], (r["k1"], r["k2"])
        if len(stack) <= depth or stack[depth][0].key != key:
            yield from cut(depth)
            stack.append((_Node(depth, key, r["chars"], None), sha256(), []))
        node, digest, slots = stack[depth]
        node.member(r["conv_id"], r["n_convs"])
        node.children += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        if r["ends"] is not None:
            if node.ends:
                digest.update(b",")
            digest.update(r["ends"].encode())
            node.ends = [True]
        slots.append((r["part"], r["slot"]))
    yield from cut(0)


_STITCHED = _NODE + ", part int, slot long"


def _stitch_rows(batches):
    yield from _batches(stitch(r for b in batches for r in b.to_pylist()), _schema(_STITCHED))


def turn_arrays(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns: array of (k1, k2: role's and text's hashes, n: code points of the text)) for each conversation."""
    said = conversations.select(
        integer_key(conversations, key).alias("id"), column(conversations, turn).alias("turn"),
        text_or_empty(column(conversations, role)).alias("role"), text_or_empty(column(conversations, text)).alias("text"),
    )
    slim = said.select(
        "id", F.struct(F.col("turn").isNotNull().alias("a"), "turn", "role", F.xxhash64("role", "text").alias("k1"),
                       F.xxhash64(F.lit(7), "role", "text").alias("k2"), F.length("text").alias("n")).alias("t"),
    )
    turns = slim.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return turns.select("id", F.transform("t", lambda t: F.struct(t.k1.alias("k1"), t.k2.alias("k2"), t.n.alias("n"))).alias("turns"))


def shared_starts(arrays: DataFrame) -> DataFrame:
    """Conversations with the first turns of the conversation at the next lower multiple of HUNDRED in place of their own."""
    heads = arrays.where(F.col("id") % HUNDRED == 0).select(F.col("id").alias("at"), F.slice("turns", 1, SHARED - 1).alias("head"))
    h = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % SHARED, F.lit(0)).cast("int")
    own = arrays.select("id", "turns", h.alias("h"), (F.col("id") - F.col("id") % HUNDRED).alias("at"))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "at", "left").select("id", F.concat(head, rest).alias("turns"))


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie over ``arrays`` (id long, turns: array of k1, k2 long, n int): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256.

    Equal arrays are one path; the ids of those that end at a node stand in ends_sha256 in
    numerical order. A null id counts as a member, is never the smallest and is empty
    among the ids, before all others. Empty arrays end at the root. Ids that occur twice
    count twice. An empty table has no nodes. A conversation is one row, so its turns'
    hashes must fit in memory; a group of equal ones of any size is spread over tasks.
    """
    spark = arrays.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = arrays.select(
        F.flatten(F.transform("turns", lambda t: F.array(t.k1, t.k2))).alias("key"), F.transform("turns", lambda t: t.n).alias("chars"), "id"
    )
    ordered = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    nodes = write_table(ordered.mapInArrow(_sweep_partition, _SWEPT), "trie")
    # A path or two for each partition: their number doesn't grow with the rows.
    edges = nodes.where("slot is not null").repartition(1).sortWithinPartitions("part", "slot")
    whole = write_table(edges.mapInArrow(_stitch_rows, _STITCHED), "trie-edges")
    columns = [c.split()[0] for c in _NODE.split(", ")]
    parents = whole.where("part is not null").select("part", F.col("slot").alias("up"), F.col("conv_id").alias("_parent"))
    under = nodes.where("up is not null").join(parents, ["part", "up"]).withColumn("parent_conv_id", F.col("_parent"))
    inner = nodes.where("slot is null and up is null")
    return inner.select(columns).unionByName(whole.where("part is null").select(columns)).unionByName(under.select(columns))


def query(spark, sf_dir):
    arrays = write_table(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(shared_starts(arrays))


SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
),
-- CRC-32 of the decimal id, bit by bit.
ids AS (
  SELECT c, coalesce(xor(list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i::BIGINT, 1))::UBIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))
  ), 4294967295::UBIGINT) % {SHARED}, 0)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations)
),
heads AS (SELECT ids.c, h, t.i, t.role, t.text FROM ids JOIN turns t ON t.c = ids.c - ids.c % {HUNDRED} AND t.i <= h),
counts AS (SELECT c, count(*) AS m FROM heads GROUP BY c),
rebuilt AS (
  SELECT c, i AS pos, role, text FROM heads
  UNION ALL
  SELECT ids.c, coalesce(m, 0) + t.i - h, t.role, t.text FROM ids JOIN turns t ON t.c IS NOT DISTINCT FROM ids.c AND t.i > h LEFT JOIN counts ON counts.c = ids.c
),
paths AS (
  SELECT c, pos AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos) AS k, length(text) AS chars,
         pos = max(pos) OVER (PARTITION BY c) AS last FROM rebuilt
  UNION ALL
  SELECT c, 0, '', 0, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.c IS NOT DISTINCT FROM ids.c) FROM ids
),
nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars,
         sha256(coalesce(string_agg(coalesce(c::VARCHAR, ''), ',' ORDER BY c NULLS FIRST) FILTER (last), '')) AS ends
  FROM paths GROUP BY k, d
),
children AS (SELECT left(k, 64 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(y.k, 64 * u.d) AS k, count(*) FILTER (ch.n IS NULL) AS leaves, sum((y.n - 1) * y.chars) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM nodes) y JOIN (SELECT DISTINCT d FROM nodes) u ON u.d = y.up LEFT JOIN children ch ON ch.k = y.k GROUP BY 1
)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, p.c AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(ch.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON x.d > 0 AND p.k = left(x.k, 64 * (x.d - 1)) LEFT JOIN children ch ON ch.k = x.k JOIN below ON below.k = x.k
"""
