"""Conversation prefix trie against a dictionary of prefixes, over partitions of all kinds."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import prefix_trie as trie


def by_hand(paths):
    """paths: (id, list of (turn, code points)) to the rows of the trie."""
    members, ends, last = defaultdict(list), defaultdict(list), {(): 0}
    for c, turns in paths:
        for d in range(len(turns) + 1):
            k = tuple(t for t, _ in turns[:d])
            members[k].append(c)
            if d:
                last[k] = turns[d - 1][1]
        ends[tuple(t for t, _ in turns)].append(c)
    low = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * last[k]
    text = lambda k: ",".join("" if c is None else str(c) for c in sorted(ends[k], key=lambda c: (c is not None, c or 0)))
    return sorted(
        (repr((low[k], len(k), low[k[:-1]] if k else None, len(v), children[k], leaves[k], saved[k], sha256(text(k).encode()).hexdigest())) for k, v in members.items())
    )


def collected(df):
    return sorted(repr(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def arrays(spark, paths):
    rows = [(c, [(t, t * 31, n) for t, n in turns]) for c, turns in paths]
    return spark.createDataFrame(rows, "id long, turns array<struct<k1: long, k2: long, n: int>>")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_random_tries(spark, parts):
    rng = np.random.default_rng(parts)
    paths = [(int(c), [(int(t), int(t) + 1) for t in rng.integers(0, 3, rng.integers(0, 7))]) for c in rng.permutation(120) - 20]
    # A hot conversation, one without an id, an id that occurs twice, and a deep chain with branches.
    paths += [(1000 + i, [(1, 2), (2, 3)]) for i in range(200)] + [(None, [(1, 2)]), (1000, [(1, 2), (2, 3)])]
    paths += [(2000 + i, [(7, 8)] * (40 * i) + [(8, 9)]) for i in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert collected(trie.prefix_trie(arrays(spark, paths))) == by_hand(paths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sweep_and_stitch_without_spark():
    paths = sorted((k, c) for c, k in enumerate([(1, 2), (1, 2), (1, 2, 3), (1, 3), (1,), (), (2,), (2, 2, 2), (2, 2, 2)]))
    want = by_hand([(c, [(t, 5) for t in k]) for k, c in paths])
    for cuts in range(1, 1 << (len(paths) - 1), 7):
        parts, start = [], 0
        for i in range(1, len(paths) + 1):
            if i == len(paths) or cuts >> (i - 1) & 1:
                parts.append(paths[start:i])
                start = i
        swept = [r for p, rows in enumerate(parts) for r in trie.sweep((([x for t in k for x in (t, t)], [5] * len(k), c) for k, c in rows), p)]
        edges = [r for r in swept if r.get("slot") is not None]
        whole = list(trie.stitch([{"ends": None} | r for r in edges]))
        named = {(r["part"], r["slot"]): r["conv_id"] for r in whole if "slot" in r}
        rows = [r for r in swept if r.get("slot") is None] + [r for r in whole if "slot" not in r]
        rows = [r | {"parent_conv_id": named[r["part"], r["up"]]} if "up" in r else r for r in rows]
        got = sorted(repr((r["conv_id"], r["depth"], r.get("parent_conv_id"), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])) for r in rows)
        assert got == want


def test_rebuilt_conversations(spark):
    """Null roles, texts, turns and ids, ties, repeated rows, negative ids, a missing first conversation, extra columns."""
    rng = np.random.default_rng(1)
    rows = [(c, int(t), "user" if t % 2 else None, f"t{rng.integers(0, 3)} {'é' * int(rng.integers(0, 4))}")
            for c in (0, 3, 5, 17, 99, -7, -100, 250, 251, 300, 301, 302) for t in range(int(rng.integers(1, 9)))]
    rows += [(0, None, "system", None), (3, 50, "user", "a"), (3, 50, "user", "a"), (None, 1, "user", "x"), (None, 2, None, None)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("id"), F.lit(2).alias("k1"))
    own = defaultdict(list)
    for c, _, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append(((r or "", x or ""), len(x or "")))
    paths = []
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        at = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths.append((c, ([] if c is None else own.get(at, [])[:h]) + turns[h:]))
    assert collected(trie.prefix_trie(trie.shared_starts(trie.turn_arrays(talks)))) == by_hand(paths)
    assert trie.prefix_trie(trie.shared_starts(trie.turn_arrays(talks.where("false")))).count() == 0


def test_ties_of_different_turns_have_one_order(spark):
    rows = [(1, 0, "user", f"t{i}") for i in range(9)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    orders = {str(trie.turn_arrays(t.repartition(3)).collect()) for t in (talks, talks.orderBy("text"), talks.orderBy(F.desc("text")))}
    assert len(orders) == 1
