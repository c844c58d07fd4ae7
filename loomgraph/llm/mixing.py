"""Mixing sources to target weights by temperature: DataFrame operations only.

Source token shares are raised to an exponent that bisection finds, and the
normalised weights are realised as permutations of blocks of documents, cut off
at each source's budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import column, redeal, row_hash, text_or_empty, unwrap, wrap, write_table

#: No document is used more often than this over the mix.
MAX_REPEATS = 2.0
#: About so many documents make one block, the unit of a permutation.
BLOCK_DOCS = 2048
#: Copies of one row up to so many tokens are one unit of a block.
UNIT_TOKENS = 65_536
#: So many units of a large group of copies are made from its row in one place.
SALT_CHUNKS = 64
#: Each round splits the exponent's interval into so many parts; a round is one small job.
WAYS, ROUNDS = 32, 6
SEED = 17
#: Blocks are ordered in 2 ** PART_BITS stretches of their hashes.
PART_BITS = 8


def token_count(text: Column) -> Column:
    """Words of a text; at least 1, so that every document weighs something."""
    return F.greatest(F.lit(1), F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def _source(col: Column) -> Column:
    return F.struct(col.isNull().alias("none"), F.coalesce(col.cast("string"), F.lit("")).alias("name"))


def source_totals(units: DataFrame) -> DataFrame:
    """(src, tokens, docs, share); one row for each source, pre-aggregated before the shuffle."""
    sums = units.groupBy("_src").agg(F.sum(F.col("_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs"))
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    return sums.withColumn("share", F.col("tokens") / F.lit(total))


def find_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent in [0, 1] for which the mix meets the target.

    Weights are share ** a, normalised. ``target_entropy`` (a share of log(number of
    sources)): the largest exponent whose entropy reaches it. ``max_repeats``: the
    smallest exponent for which, when every document is used at least once, none is
    used more than so many times (up to the last part of an epoch). Entropy falls
    and the repeats fall as the exponent rises, so both are found by bisection, WAYS
    parts at a time; each round aggregates the sources' table in Spark and brings
    WAYS + 1 rows to the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / WAYS for i in range(WAYS + 1)]
        at = totals.select("share", F.explode(F.array(*map(F.lit, grid))).alias("a")).withColumn("x", F.pow("share", "a"))
        seen = {
            r["a"]: r for r in at.groupBy("a").agg(
                (F.log(F.sum("x")) - F.sum(F.col("x") * F.log("x")) / F.sum("x")).alias("entropy"),
                (F.max(F.col("x") / F.col("share")) / F.min(F.col("x") / F.col("share"))).alias("repeats"),
                F.count(F.lit(1)).alias("n"),
            ).collect()
        }
        if not seen:
            return 1.0
        if target_entropy is not None:
            ok = [a for a in grid if seen[a]["entropy"] >= target_entropy * _log(seen[a]["n"])]
            if not ok:
                return 0.0
            low, high = max(ok), min([a for a in grid if a > max(ok)], default=max(ok))
        else:
            ok = [a for a in grid if seen[a]["repeats"] <= max_repeats]
            if not ok:
                return 1.0
            low, high = max([a for a in grid if a < min(ok)], default=min(ok)), min(ok)
        if low == high:
            break
    return low if target_entropy is not None else high


def _log(n: int) -> float:
    import math

    return math.log(n) if n > 1 else 0.0


def mix_weights(totals: DataFrame, exponent: float, budget_tokens: int | None = None) -> DataFrame:
    """Adds weight and quota (tokens to take) to the sources' table.

    Without a budget, the quota is the smallest for which each source is used whole
    at least once, so no document is lost; with one, the quotas sum to it.
    """
    raised = totals.withColumn("x", F.pow("share", F.lit(float(exponent))))
    scale, once = raised.agg(F.sum("x"), F.max(F.col("tokens") / F.col("x"))).first()
    scale, once = scale or 1.0, once or 0.0
    budget = float(budget_tokens) if budget_tokens is not None else once * scale
    out = raised.withColumn("weight", F.col("x") / F.lit(scale))
    # Rounded, so that the last place of a double never costs the last document.
    return out.withColumn("quota", F.round(F.col("weight") * F.lit(budget), 3)).select("_src", "tokens", "docs", "share", "weight", "quota")


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", target_entropy: float | None = None,
    max_repeats: float | None = MAX_REPEATS, budget_tokens: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED,
) -> DataFrame:
    """``docs`` repeated or cut to the mix's weights, plus mix_epoch (int, from 0), mix_block, mix_order (long), mix_weight and mix_quota (double).

    Each source's budget is its quota of tokens. Its documents lie in blocks of about
    ``block_docs`` by a seeded hash; each epoch is a permutation of its blocks and,
    inside each, of the documents, both seeded by the epoch. Whole epochs are taken
    while the quota lasts; of the last one, the documents that start before the quota
    ends. mix_order sorts the mix: a document stands where its middle lies in its
    source's quota, so that any stretch of the mix holds the sources by their weights.
    All of it depends on the rows alone, not on their order or partitions.

    Null source: a source of its own; null or empty text: a document of one token; very
    long texts: a document weighs its tokens, so a source may exceed its quota by a
    part of one. Repeated rows are separate documents, but equal ones (ties) up to
    UNIT_TOKENS stand together; a larger group of copies is split into such units,
    which go to different blocks. An empty table stays empty. Columns named like the
    results are replaced, all others pass through, whatever their names. A hot source
    is spread over its blocks; only one small row for each block is sorted in one place.
    """
    h1, h2 = row_hash(docs)
    slim = docs.select(_source(column(docs, source)).alias("_src"), token_count(column(docs, text)).alias("_tokens"), h1.alias("_h1"), h2.alias("_h2"))
    # Rows that are equal in all columns are one unit with a count; there is nothing to tell them apart.
    units = write_table(slim.groupBy("_src", "_h1", "_h2", "_tokens").agg(F.count(F.lit(1)).alias("copies")), "mix-units")
    totals = write_table(source_totals(units), "mix-sources")
    exponent = find_exponent(totals, target_entropy, max_repeats)
    quotas = write_table(mix_weights(totals, exponent, budget_tokens), "mix-quotas")
    plan = write_table(placed_units(units, quotas, block_docs, seed), "mix-plan")
    large = write_table(units.where(F.col("copies") > _most_copies()).select("_h1", "_h2"), "mix-heavy")
    rows = wrap(docs, h1.alias("_h1"), h2.alias("_h2"))
    used = rows.join(large, ["_h1", "_h2"], "left_anti").join(redeal(plan.where("not large").drop("large", "copies", "chunk"), "_h1"), ["_h1", "_h2"])
    # Of a large group one row is carried, to as many places as its units fill, and copied there.
    chunks = plan.where("large").withColumn("_salt", F.floor(F.col("chunk") / SALT_CHUNKS))
    places = chunks.select("_h1", "_h2", "_salt").distinct()
    one = rows.join(large, ["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.first("_doc").alias("_doc")).join(places, ["_h1", "_h2"])
    copied = one.join(chunks, ["_h1", "_h2", "_salt"]).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*used.columns)
    return unwrap(used.unionByName(copied), docs.columns, {
        "mix_epoch": F.col("epoch"), "mix_block": F.col("block"), "mix_order": F.col("order"), "mix_weight": F.col("weight"), "mix_quota": F.col("quota"),
    })


def _most_copies() -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(UNIT_TOKENS) / F.col("_tokens")))


def placed_units(units: DataFrame, quotas: DataFrame, block_docs: int, seed: int) -> DataFrame:
    """(_h1, _h2, chunk, copies, large, epoch, block, order, weight, quota): where units stand in the mix, once for each epoch that takes them."""
    per = quotas.withColumn("whole", F.floor(F.col("quota") / F.col("tokens")).cast("int")).select(
        "_src", "tokens", "weight", "quota", "whole", (F.col("quota") - F.col("whole") * F.col("tokens")).alias("rest"),
        F.ceil(F.col("docs") / F.lit(block_docs)).alias("blocks"),
    ).withColumn("last", F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)).where("last >= 0")
    most = _most_copies()
    each = units.withColumn("large", F.col("copies") > most)
    each = each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most))))
    each = each.withColumn("copies", F.least(most, F.col("copies") - F.col("chunk") * most)).join(per, "_src").withColumns({
        "block": F.pmod(F.xxhash64(F.lit(seed + 2), "_h1", "_h2", "chunk"), F.col("blocks")), "size": F.col("_tokens") * F.col("copies"),
    })
    sizes = each.groupBy("_src", "block").agg(F.sum("size").alias("block_size"), F.first("last").alias("last"))
    sizes = sizes.select("_src", "block", "block_size", F.explode(F.sequence(F.lit(0), "last")).alias("epoch"))
    # A source's blocks stand by their hashes; stretches of hashes are summed up first, so that no task sorts all of them.
    sizes = sizes.withColumn("_h", F.xxhash64(F.lit(seed + 4), "block", "epoch")).withColumn("_part", F.shiftright("_h", 64 - PART_BITS))
    earlier = lambda keys, by: F.coalesce(F.sum("block_size").over(W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("_src", "epoch", "_part").agg(F.sum("block_size").alias("block_size"))
    parts = parts.select("_src", "epoch", "_part", earlier(["_src", "epoch"], ["_part"]).alias("_before"))
    own = sizes.withColumn("before", earlier(["_src", "epoch", "_part"], ["_h", "block"]))
    sizes = own.join(parts, ["_src", "epoch", "_part"]).select("_src", "block", "epoch", (F.col("before") + F.col("_before")).alias("before"))
    inside = W.partitionBy("_src", "block", "epoch").orderBy(F.xxhash64(F.lit(seed + 3), "_h1", "_h2", "chunk", "epoch"), "_h1", "_h2", "chunk")
    rows = each.join(sizes, ["_src", "block"]).where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest")))
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("rest")))
    at = F.least((F.col("epoch") * F.col("tokens") + F.col("start") + F.col("size") / 2) / F.col("quota"), F.lit(1.999))
    tie = F.pmod(F.xxhash64(F.lit(seed + 1), "_h1", "_h2", "chunk", "epoch"), F.lit(1 << 22))
    place = F.floor(at * F.lit(float(1 << 40))).cast("long") * F.lit(1 << 22) + tie
    return rows.select("_h1", "_h2", "chunk", "copies", "large", "epoch", "block", place.alias("order"), "weight", "quota")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "mix_weight", "mix_quota")
