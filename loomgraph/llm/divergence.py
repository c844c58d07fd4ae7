"""Source divergence audit: how each source's words differ from its language's and from the other sources'.

Texts are cut into terms by a byte-level tokenizer over whole blocks of documents, terms
are counted by source, and shares are compared by exact whole-number divergences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks_of, column, text_or_empty, write_table

#: A language keeps the terms of at least so many of its documents.
MIN_DOCS = 10
#: Terms reported for each source.
TOP = 10
#: A share of 1.
UNIT = 1_000_000_000
#: Bytes of text that are tokenized at once.
BLOCK_BYTES = 8 << 20
#: Terms and sources whose counts one task compares at once; more are dealt to more tasks.
BLOCK_TERMS, TILE = 4096, 64

#: By byte: 0 if it parts terms, else itself, A-Z lower-cased.
TABLE = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokenizer's bytes, and where terms start and end; ``offsets``: the texts' bounds in ``data``, which no term crosses."""
    out = TABLE[data]
    inside = np.zeros(len(out) + 1, bool)
    inside[:-1] = out != 0
    before = np.zeros(len(out) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(out) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return out, starts, ends


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i: whether the ``size`` bytes at ``a`` and at ``b`` are others; eight bytes at a time."""
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    out = np.zeros(len(a), bool)
    for at in range(0, 64, 8):
        i = np.flatnonzero(size > at)
        if not len(i):
            return out
        out[i] |= ((words[a[i] + at] ^ words[b[i] + at]) & _MASKS[np.minimum(size[i] - at, 8)]) != 0
    for i in np.flatnonzero(size > 64):
        out[i] |= not np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The terms' order by content (equal ones stay in order of place), and the places in it where another content begins.

    Terms are sorted by hash; those of one hash are compared byte by byte, and told apart where they differ.
    """
    raw, n = data.tobytes(), len(starts)
    key = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n)
    order = np.argsort(key, kind="stable")
    size = (ends - starts)[order]
    same = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    unlike = size[same] != size[same - 1]
    alike = same[~unlike]
    unlike[~unlike] = _differ(data, starts[order[alike]], starts[order[alike - 1]], size[alike])
    second = np.zeros(n, np.int64)
    if unlike.any():
        for h in np.unique(key[order[same[unlike]]]).tolist():
            numbers: dict = {}
            for i in np.flatnonzero(key == h).tolist():
                second[i] = numbers.setdefault(raw[starts[i] : ends[i]], len(numbers))
        order = np.lexsort((second, key))
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, new


def _count_terms(batches):
    """(lang, source, text) rows to (lang, source, term, n: occurrences, d: documents with it), for each block."""
    for batch in (part for whole in batches for part in blocks_of(whole, 2, BLOCK_BYTES, 1 << 20)):
        keys = pa.Table.from_batches([batch.select([0, 1])]).combine_chunks()
        pairs = pa.StructArray.from_arrays([keys.column(0).combine_chunks(), keys.column(1).combine_chunks()], names=["l", "s"])
        named: dict = {}
        group = np.fromiter((named.setdefault((x["l"], x["s"]), len(named)) for x in pairs.to_pylist()), np.int64, len(pairs))
        # By group, so that one stable sort by content leaves each term's rows by group and document.
        by = np.argsort(group, kind="stable")
        texts = batch.column(2).cast(pa.large_binary()).take(pa.array(by))
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data, starts, ends = bounds(data, offsets)
        if not len(starts):
            continue
        doc = np.searchsorted(offsets, starts, "right") - 1
        order, new = grouped(data, starts, ends)
        doc, of = doc[order], group[by][doc[order]]
        new[1:] |= of[1:] != of[:-1]
        first = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        raw, at = data.tobytes(), order[first]
        langs, sources = (pa.array([k[i] for k in named], pa.string()).take(pa.array(of[first])) for i in (0, 1))
        terms = pa.array([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], pa.binary())
        n, d = np.diff(first, append=len(new)), np.add.reduceat(other.astype(np.int64), first)
        for i in range(0, len(first), 1 << 17):
            yield pa.RecordBatch.from_arrays(
                [x.slice(i, 1 << 17) for x in (langs, sources, terms, pa.array(n), pa.array(d))], names=["lang", "source", "term", "n", "d"]
            )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, spread: array of (source, n)) of the terms that a language keeps; ``docs``: lang, source, text without nulls.

    One exchange, by language and term: blocks are counted before it, so a frequent term
    is one row for each block and source.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("lang", "source", "text").mapInArrow(_count_terms, "lang string, source string, term binary, n long, d long")
    by_source = parts.repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = by_source.groupBy("lang", "term").agg(
        F.sum("d").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("spread")
    )
    return kept.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "spread")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) squared / (p + q)); both are at most UNIT + 1, so 64 bits hold all of it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(count: np.ndarray, whole) -> np.ndarray:
    """As ``share``, of count + 2 <= whole: by long division in three digits of 1000, each within 64 bits."""
    left, out = np.asarray(count, np.int64) + 2, 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def _gaps(p, q) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare(row: np.ndarray, col: np.ndarray, count: np.ndarray, whole: np.ndarray, left: range, right: range):
    """For each pair of a source in ``left`` and one in ``right``: the divergences summed over the terms that either has, and their number.

    A CSR matrix (row: source, col: term) of counts; ``whole``: each source's total plus
    twice its language's terms. A source's shares are spread over the terms once and
    compared with all rows of ``right`` at a time, summed by ``reduceat``.
    """
    by = np.lexsort((col, row))
    row, col = row[by], col[by]
    p, none = shares(count[by], whole[row]), shares(np.full(len(whole), 0), whole)
    indptr = np.searchsorted(row, np.arange(len(whole) + 1))
    lo, hi = indptr[right.start], indptr[right.stop]
    cols, values, rows = col[lo:hi], p[lo:hi], row[lo:hi]
    full = [r for r in right if indptr[r] < indptr[r + 1]]
    at, full = indptr[full] - lo, np.array(full, np.int64) - right.start
    sums = np.zeros((len(left), len(right)), np.int64)
    either = np.zeros_like(sums)
    size = np.diff(indptr)
    for i, g in enumerate(left):
        mine = slice(indptr[g], indptr[g + 1])
        spread, has = np.full(col.max() + 1 if len(col) else 0, none[g]), np.zeros(col.max() + 1 if len(col) else 0, bool)
        spread[col[mine]], has[col[mine]] = p[mine], True
        sums[i] = _gaps(p[mine][:, None], none[None, right.start : right.stop]).sum(0)
        either[i] = size[g] + size[right.start : right.stop]
        if len(full):
            both = has[cols]
            # A term of both: its own divergence instead of the one from a source without it.
            again = np.where(both, _gaps(spread[cols], none[rows]), 0)
            sums[i, full] += np.add.reduceat(_gaps(spread[cols], values) - again, at)
            either[i, full] -= np.add.reduceat(both.astype(np.int64), at)
    return sums, either


def _compare_blocks(batches):
    """Rows (lang, a: sources, b, cells: (side, slot, tid, n)) to sums for each pair of sources."""
    for r in (r for b in batches for r in pa.Table.from_batches([b]).to_batches(max_chunksize=1)):
        lang, same = r.column("lang")[0].as_py(), r.column("ti")[0].as_py() == r.column("tj")[0].as_py()
        one, two = (r.column(k).flatten() for k in ("a", "b"))
        names = [x.field("source").to_pylist() for x in (one, two)]
        whole = np.concatenate([x.field("whole").to_numpy(zero_copy_only=False) for x in ((one,) if same else (one, two))])
        cells = r.column("cells").flatten()
        side, slot, tid, n = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("side", "slot", "tid", "n"))
        k = len(names[0])
        left, right = range(k), range(k) if same else range(k, len(whole))
        sums, either = compare(slot + side * k, np.unique(tid, return_inverse=True)[1], n, whole, left, right)
        i, j = np.nonzero(either)
        pick = i < j if same else slice(None)
        i, j = i[pick], j[pick]
        a, b = (pa.array(x, pa.string()).take(pa.array(y)) for x, y in zip(names, (i, j)))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), a, b, pa.array(sums[i, j]), pa.array(either[i, j])], names=["lang", "a", "b", "w", "u"])


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, low, high, w, u): for two sources of a language, divergences summed over the terms that either has, and their number.

    Terms are dealt out in blocks and sources in tiles of about TILE; a task gets two
    tiles of a block, so a term that all sources have makes no pairs of rows.
    """
    tiles = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "whole"))).alias("sources"))
    slots = tiles.select("lang", "tile", F.posexplode("sources").alias("slot", "s")).select("lang", "tile", "slot", F.col("s.source").alias("source"))
    block = F.pmod(F.xxhash64("tid"), F.ceil(F.col("v") / BLOCK_TERMS)).alias("block")
    placed = cells.join(groups.select("lang", "source", "v", "tiles").join(slots, ["lang", "source"]), ["lang", "source"])
    dealt = placed.select("lang", block, "tile", "slot", "tid", "n", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")).select(
        "lang", "block", F.least("tile", "o").alias("ti"), F.greatest("tile", "o").alias("tj"),
        F.struct((F.col("tile") > F.col("o")).cast("int").alias("side"), "slot", "tid", "n").alias("cell"),
    )
    rows = dealt.groupBy("lang", "block", "ti", "tj").agg(F.collect_list("cell").alias("cells"))
    for side, tile in (("a", "ti"), ("b", "tj")):
        rows = rows.join(tiles.select("lang", F.col("tile").alias(tile), F.col("sources").alias(side)), ["lang", tile])
    sums = rows.select("lang", "ti", "tj", "a", "b", "cells").mapInArrow(_compare_blocks, "lang string, a string, b string, w long, u long")
    return sums.groupBy("lang", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum("w").alias("w"), F.sum("u").alias("u"))


def audit_sources(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value long, rank int): each source's distance to the other sources of its
    language (part ``pair``, all of them), and the terms that it uses most beyond its language (part ``term``,
    up to rank ``top``); rank 1 has the largest value, ties go by the item's bytes.

    Terms are runs of ASCII letters and bytes from 0x80, only A-Z lower-cased; a
    language keeps those of at least ``min_docs`` of its documents. Null texts,
    languages and sources are empty ones; empty texts have no terms, but their source
    occurs. Texts and terms may be of any length and are read whole. Repeated rows count
    each. Without kept terms all pairs have the value 0. An empty table gives no rows.
    Further columns are ignored, whatever their names.
    """
    named = docs.select(*(text_or_empty(column(docs, c).cast("string")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = write_table(kept_terms(named, min_docs).withColumn("tid", F.monotonically_increasing_id()), "terms")
    cells = kept.select("lang", "term", "tid", "total", F.explode("spread").alias("s")).select("lang", "term", "tid", "total", "s.source", "s.n")
    seen = named.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    width = seen.groupBy("lang").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.lit(1)).cast("int").alias("tiles"))
    langs = width.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all")), "lang", "left")
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    zero = F.lit(0).cast("long")
    groups = seen.join(own, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("own", zero).alias("own"), F.coalesce("v", zero).alias("v"), F.coalesce("all", zero).alias("all"), "tiles",
        F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile"),
    )
    groups = write_table(groups.withColumn("whole", F.col("own") + 2 * F.col("v")), "sources")

    p, q = share(F.col("n"), F.col("own"), F.col("v")), share(F.col("total"), F.col("all"), F.col("v"))
    more = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    sums = _pair_sums(cells.select("lang", "source", "tid", "n"), groups)
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("its"))
    pairs = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "own", "its", "v", F.least("source", "item").alias("low"), F.greatest("source", "item").alias("high"))
    none = gap(share(zero, F.col("own"), F.col("v")), share(zero, F.col("its"), F.col("v")))
    value = F.when(F.col("v") == 0, zero).otherwise(F.coalesce("w", zero) + (F.col("v") - F.coalesce("u", zero)) * none)
    pairs = pairs.join(sums, ["lang", "low", "high"], "left").select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(best))
    out = [x.select("lang", "source", F.lit(k).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for k, x in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])


def query(spark, sf_dir):
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT rid, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM docs)
),
vocab AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
cells AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS total FROM vocab GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0) AS lang_total, coalesce(own, 0)::HUGEINT AS own
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS own FROM cells GROUP BY ALL) USING (lang, source)
),
shares AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + 2)) // (own + 2 * g.v) AS p,
         1 + ({UNIT}::HUGEINT * (total + 2)) // (lang_total + 2 * g.v) AS q
  FROM groups g JOIN vocab USING (lang) LEFT JOIN cells c USING (lang, source, term)
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
