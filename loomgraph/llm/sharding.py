"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then Fisher-Yates in each."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import column, drop_table, row_hash, text_or_empty, unwrap, wrap, write_table

N_SHARDS = 40
#: A bucket's expected size; a task holds one bucket in memory at a time.
BUCKET_BYTES = 16 << 20
#: Besides its text, a row counts as so many bytes.
ROW_BYTES = 16
#: Copies of a row that fill more than this part of a bucket are dealt over all buckets.
HEAVY = 8
SEED = 29


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys to 0..n-1: growing n by one moves keys only into the new place."""
    keys = keys.astype(np.uint64).copy()
    at, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.float64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live].astype(np.int64)
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = np.floor((at[live] + 1) * (float(1 << 31) / ((keys[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        live = live[ahead[live] < n]
    return at


def _shards(n: int):
    """Shard of a hashed key among ``n``, and among one more."""

    def shards(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(keys, n).astype(np.int32), "grown": jump_hash(keys, n + 1).astype(np.int32)})

    return F.pandas_udf(shards, "shard int, grown int")


def row_size(text: Column) -> Column:
    return (F.octet_length(text_or_empty(text)) + F.lit(ROW_BYTES)).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the end, each place swaps with a random one not after it."""
    rng, order = np.random.default_rng(seed), np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else ()):
        order[i], order[j] = order[j], order[i]
    return order


@lru_cache(maxsize=8)
def _places(seed: int, shard: int, bucket: int, n: int) -> np.ndarray:
    """Where Fisher-Yates puts each of a bucket's ``n`` rows."""
    out = np.empty(n, np.int64)
    out[fisher_yates(n, seed * 1_000_003 + shard * 1_009 + bucket * 7_919_113)] = np.arange(n)
    return out


def _shuffled(seed: int):
    def shuffled(shard: pd.Series, bucket: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        both, out = shard.to_numpy(np.int64) << 40 | bucket.to_numpy(np.int64), np.empty(len(at), np.int64)
        for b in np.unique(both):
            own = both == b
            out[own] = _places(seed, int(b >> 40), int(b & ((1 << 40) - 1)), int(n[own].iloc[0]))[at[own]]
        return pd.Series(out)

    return F.pandas_udf(shuffled, T.LongType())


def _key(docs: DataFrame, key: str, seed: int):
    return F.xxhash64(F.lit(seed), F.coalesce(column(docs, key).cast("string"), F.lit("\0null")))


class Layout:
    """Which bucket rows go to: ``heavy`` (_h1, _h2, _n) groups of equal rows, ``starts`` (_shard, _bucket, _count, _start), ``buckets`` of each shard.

    Depends on the rows alone, not on their order or partitions.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, n_shards: int, bucket_bytes: int, seed: int):
        h1, h2 = row_hash(docs)
        slim = docs.select(_key(docs, key, seed).alias("_key"), h1.alias("_h1"), h2.alias("_h2"), row_size(column(docs, text)).alias("_size"))
        counted = slim.groupBy("_key", "_h1", "_h2", "_size").agg(F.count(F.lit(1)).alias("_n"))
        counted = write_table(counted.withColumn("_s", _shards(n_shards)("_key")).select("_h1", "_h2", "_size", "_n", F.col("_s")["shard"].alias("_shard")), "shard-rows")
        sizes = dict(counted.groupBy("_shard").agg(F.sum(F.col("_size") * F.col("_n"))).collect())  # one row for each shard
        self.buckets = [max(1, math.ceil(sizes.get(s, 0) / bucket_bytes)) for s in range(n_shards)]
        self.seed = seed
        large = (F.col("_n") > 1) & (F.col("_n") * F.col("_size") * HEAVY > bucket_bytes)
        self.heavy = write_table(counted.where(large).select("_h1", "_h2", "_n"), "shard-heavy")
        light = counted.where(~large).select("_shard", self.bucket().alias("_bucket"), "_n")
        dealt = counted.where(large).select("_shard", F.explode(self.deal()).alias("_d")).select("_shard", "_d.bucket", "_d.n")
        per = light.unionByName(dealt.toDF("_shard", "_bucket", "_n")).groupBy("_shard", "_bucket").agg(F.sum("_n").alias("_count"))
        in_shard = W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        self.starts = write_table(per.withColumn("_start", F.coalesce(F.sum("_count").over(in_shard), F.lit(0))), "shard-starts")
        drop_table(counted)

    def n_buckets(self):
        return F.get(F.lit(self.buckets), F.col("_shard"))

    def bucket(self):
        """Of a row that is no heavy group's: by a seeded hash, uniform over its shard's buckets."""
        return F.pmod(F.xxhash64(F.lit(self.seed + 2), "_h1", "_h2"), self.n_buckets()).cast("int")

    def deal(self):
        """Of a heavy group: array of (bucket, n), its copies dealt evenly over all buckets of its shard."""
        total, first = self.n_buckets(), F.pmod(F.xxhash64(F.lit(self.seed + 3), "_h1", "_h2"), self.n_buckets())
        each = F.transform(F.sequence(F.lit(0), total - 1), lambda b: F.struct(
            b.cast("int").alias("bucket"), (F.floor(F.col("_n") / total) + (F.pmod(b - first, total) < F.col("_n") % total).cast("int")).cast("long").alias("n")))
        return F.filter(each, lambda d: d["n"] > 0)


def scatter(docs: DataFrame, layout: Layout, key: str, n_shards: int, seed: int) -> DataFrame:
    """Pass 1: every row as _doc with _shard, _grown, _bucket, _tag and its hashes.

    Copies of a row go to one bucket together, unless they would fill a good part
    of it: such groups are carried as one row and a count to each bucket of their
    shard, and spread out there.
    """
    h1, h2 = row_hash(docs)
    rows = wrap(docs, _shards(n_shards)(_key(docs, key, seed)).alias("_s"), h1.alias("_h1"), h2.alias("_h2"))
    rows = rows.select("_doc", "_h1", "_h2", F.col("_s")["shard"].alias("_shard"), F.col("_s")["grown"].alias("_grown"))
    light = rows.join(layout.heavy, ["_h1", "_h2"], "left_anti").withColumn("_bucket", layout.bucket())
    one = rows.join(layout.heavy, ["_h1", "_h2"]).groupBy("_h1", "_h2", "_n", "_shard", "_grown").agg(F.first("_doc").alias("_doc"))
    dealt = one.withColumn("_d", F.explode(layout.deal())).withColumns({"_bucket": F.col("_d")["bucket"], "_m": F.col("_d")["n"]})
    dealt = dealt.repartition("_shard", "_bucket").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_m")))
    both = light.unionByName(dealt.select(*light.columns))
    return both.withColumn("_tag", F.xxhash64(F.lit(seed + 1), "_h1", "_h2"))


def shard_documents(
    docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> DataFrame:
    """``docs`` with shard (int), slot (long, gapless from 0 in a shard) and grown_shard (int, with one more shard).

    Law ``key``: the key and the number of shards decide the shard (jump consistent
    hash), and one more shard takes rows only into itself. Inside its shard a row
    goes to a bucket by a seeded hash of its content; each bucket is put into the
    order of another such hash and then shuffled by Fisher-Yates with a seed of its
    own; slots run through the buckets in turn. Texts stay in the JVM, which sorts a
    bucket on disk if it must; only places go through Python. Shards and slots depend
    on the rows alone: rows in another order or other partitions get the same ones.
    Null key: one key of its own. Null text: no bytes. Very long texts: a row may
    exceed a bucket's size, and is then alone in its part of it. Equal rows (ties)
    are interchangeable; a key or a group of copies that holds a third of all rows
    spreads over all buckets of its shard. An empty table stays empty. Columns named
    like the results are replaced, all others pass through, whatever their names.
    """
    layout = Layout(docs, key, text, n_shards, bucket_bytes, seed)
    scattered = scatter(docs, layout, key, n_shards, seed)
    in_bucket = W.partitionBy("_shard", "_bucket").orderBy("_tag", "_h1", "_h2")
    placed = scattered.withColumn("_at", F.row_number().over(in_bucket) - 1).join(layout.starts, ["_shard", "_bucket"])
    slot = F.col("_start") + _shuffled(seed)("_shard", "_bucket", "_at", "_count")
    return unwrap(placed.withColumn("_slot", slot), docs.columns, {"shard": F.col("_shard"), "slot": F.col("_slot").cast("long"), "grown_shard": F.col("_grown")})


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder for each shard; rows carry their slot, which sorts a shard."""
    sharded.write.partitionBy("shard").parquet(path)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_or_empty(F.col("text"))
    return shard_documents(docs).select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )
