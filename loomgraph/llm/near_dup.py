"""MinHash near-dedup: fast similarity sketching, banding, exact verification, connected components."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import blocks_of, column, drop_table, hash128, integer_key, redeal, unwrap, wrap, write_table
from loomgraph.operators.components import connected_components

#: A link: 100 * intersection >= PERCENT * union, over distinct shingles of SHINGLE words.
SHINGLE, PERCENT = 5, 80
#: What the registered query links by instead.
QUERY_SHINGLE, QUERY_PERCENT = 3, 85
#: 128 coordinates in 32 bands of 4: a pair shares no band with probability (1 - s ** 4) ** 32: below 1e-7 at similarity 0.8, 1e-10 at 0.85.
BANDS, BAND_ROWS = 32, 4
SEED = 41
#: Texts that are sketched at a time; bounds a worker's memory.
BLOCK_BYTES = 1 << 20
#: The word cache of a worker is emptied at this many words.
CACHE_WORDS = 100_000

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input changes half of the output's bits."""
    x = (x ^ (x >> np.uint64(33))) * _K[2]
    x = (x ^ (x >> np.uint64(33))) * _K[3]
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words as bytes, remembered up to CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words, of the whole sequence; none without words.

    A-Z are lower-cased; words are parted by space and tab to carriage return.
    """
    split = text.lower().split() if text else ()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * _K[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int, seed: int = SEED) -> np.ndarray:
    """Fast similarity sketches, one row of t values for each set of a batch (empty sets: zeros).

    Round i < t throws each element into a random bin with a random value, round
    t + j throws all into bin j; a bin's coordinate is its smallest (round, value).
    A set stops after the round that fills its last bin, so by round 2 t at the
    latest every coordinate is filled. The number of equal coordinates of two sets
    concentrates around similarity * t as if they were independent.
    """
    best = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    live = [i for i, s in enumerate(sets) if len(s)]
    for i in range(len(sets)):
        if not len(sets[i]):
            best[i] = 0
    if not live:
        return best
    sizes = np.array([len(sets[i]) for i in live])
    owner, x = np.repeat(np.array(live), sizes), np.concatenate([sets[i] for i in live])
    flat = best.reshape(-1)
    for r in range(2 * t):
        h = mix64(x ^ mix64(np.full(1, seed * 65_537 + r, np.uint64) * _K[1]))
        place = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32) if r < t else np.full(len(h), r - t, np.uint64)
        value = (np.uint64(r) << np.uint64(32)) | (h >> np.uint64(32))
        np.minimum.at(flat, owner * t + place.astype(np.int64), value)
        keep = (best == np.iinfo(np.uint64).max).any(axis=1)[owner]
        if not keep.all():
            owner, x = owner[keep], x[keep]
        if not len(x):
            break
    return best


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _K[1], parts.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * _K[0] + parts[:, :, i])
    return key


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(1).cast(pa.large_binary()).to_pylist()


def _sketch_rows(batches, k: int, bands: int, rows: int):
    words = WordHashes()
    for whole in batches:
        for batch in blocks_of(whole, 1, BLOCK_BYTES):
            sets = [shingle_set(t, words, k) for t in _texts(batch)]
            keys = band_keys(sketch(sets, bands * rows), bands, rows).view(np.int64)
            marks = [(s.sum(dtype=np.uint64), mix64(s ^ _K[1]).sum(dtype=np.uint64)) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), batch.column(3), pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(np.array([m[i] for m in marks], np.uint64).view(np.int64)) for i in (0, 1)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1))),
            ], names=["id", "h1", "h2", "n", "s1", "s2", "keys"])


def _set_rows(batches, k: int):
    words = WordHashes()
    for whole in batches:
        for batch in blocks_of(whole, 1, BLOCK_BYTES):
            sets = [shingle_set(t, words, k) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"])


def _verify_rows(batches, percent: int):
    for batch in batches:
        good = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = a.values.to_numpy(), b.values.to_numpy()
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            good.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(partial(_verify_rows, percent=percent), "a long, b long")


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Without pairs whose set sizes alone rule a link out, each pair once."""
    return pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _judged(slim: DataFrame, shingle: int, percent: int, bands: int, band_rows: int, same_key: bool) -> DataFrame:
    """``slim`` (id long, h1, h2: the text's 128-bit hash, text) to (id, h1, h2, n, component, low), a row for each of its rows.

    component numbers the group of linked texts (null without words), low is the smallest
    id in it (null if none has an id). ``same_key``: rows of one id belong together.

    Documents with one and the same shingle set are one class, a numbered node. Only
    classes are banded. In a bucket all members are checked against its hub: the member
    that most others share bands with. A bucket whose members are then in several
    components could hide further links; among the members of all such buckets, links
    are completed by prefix filtering. So each pair that shares a band is either checked,
    ruled out by a bound, or already connected. Buckets are never gathered in a task: all
    of this is joins on keys, with only classes of different components paired.
    """
    form = "id long, h1 long, h2 long, n long, s1 long, s2 long, keys array<long>"
    sketched = write_table(slim.select("id", "text", "h1", "h2").mapInArrow(partial(_sketch_rows, k=shingle, bands=bands, rows=band_rows), form), "sketches")
    # Copies fall together where they lie, before anything is sent.
    classes = sketched.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min(F.struct("h1", "h2", F.col("id").isNull().alias("none"), "id")).alias("rep"), F.min("id").alias("low"), F.first("keys").alias("keys"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = write_table(classes.select(F.col("node").alias("id"), "n", F.explode("keys").alias("k")), "bands")
    shared = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counted = write_table(rows.join(redeal(shared, "k"), "k"), "members")
    drop_table(rows)
    popular = counted.groupBy("id").agg(F.sum("c").alias("p"))
    members = write_table(counted.join(redeal(popular, "id"), "id").select("k", "id", "n", "p"), "members")
    drop_table(counted)
    found = classes.join(redeal(members.select(F.col("id").alias("node")).distinct(), "node"), "node", "left_semi")
    found = found.select(F.col("node"), F.col("rep.h1").alias("h1"), F.col("rep.h2").alias("h2"), F.col("rep.id").alias("_id"))
    texts = slim.join(redeal(found, "h1"), ["h1", "h2"]).where(F.col("id").eqNullSafe(F.col("_id"))).select(F.col("node").alias("id"), "text")
    sets = write_table(texts.mapInArrow(partial(_set_rows, k=shingle), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")
    edges = _hub_links(members, sets, percent)
    named = classes.select("n", "s1", "s2", "node", "low")
    if same_key:
        edges = edges.unionByName(_same_key(sketched, named))
    groups = write_table(connected_components(edges, "a", "b"), "groups")
    open_ = write_table(_open_members(members, groups).select("id").distinct(), "open")
    drop_table(members)
    if not open_.isEmpty():
        links = _prefix_links(sets.join(open_, "id", "left_semi"), groups, percent)
        groups = write_table(connected_components(edges.unionByName(links), "a", "b"), "groups")
    named = named.join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low").alias("low"))
    named = named.select("n", "s1", "s2", "component").join(redeal(low, "component"), "component")
    return sketched.select("id", "h1", "h2", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left").select("id", "h1", "h2", "n", "component", "low")


def near_dup_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """(id, n_shingles, component_id) of every row (keys are whole numbers): component_id is the smallest key it is linked with.

    Rows with a null key are documents like others, and link those on both sides of them;
    their component_id is null if nothing that they are linked with has a key. A row
    without words has its own key.
    """
    h1, h2 = hash128(column(docs, text))
    slim = docs.select(integer_key(docs, key).alias("id"), h1.alias("h1"), h2.alias("h2"), column(docs, text).alias("text"))
    out = _judged(slim, shingle, percent, bands, band_rows, same_key=True)
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("low")).alias("component_id"))


def _same_key(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of the rows that carry one key, from each to the smallest."""
    many = sketched.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = sketched.where("n > 0").select("id", "n", "s1", "s2").join(redeal(many, "id"), "id", "left_semi").distinct()
    nodes = write_table(rows.join(classes, ["n", "s1", "s2"]).select("id", "node"), "same-key")
    first = nodes.groupBy("id").agg(F.min("node").alias("first"))
    return nodes.join(redeal(first, "id"), "id").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()


def _hub_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links of each bucket's members with its hub: the member that shares bands with most others, or the smallest."""
    hubs = members.groupBy("k").agg(F.max(F.struct("p", (-F.col("id")).alias("t"), "n")).alias("h")).select("k", (-F.col("h.t")).alias("b"), F.col("h.n").alias("nb"))
    pairs = members.select("k", F.col("id").alias("a"), F.col("n").alias("na")).join(redeal(hubs, "k"), "k").where("a <> b")
    return write_table(_links(_sized(pairs, percent), sets, percent), "links")


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of keys k with more than one component g, and whether they are outside of the key's largest one."""
    named = members.join(groups.select(F.col("node").alias("id"), F.col("component").alias("g")), "id", "left").withColumn("g", F.coalesce("g", "id"))
    named = write_table(named, "named")
    largest = (
        named.groupBy("k", "g").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("k").agg(F.max(F.struct("m", "g")).alias("top"), F.count(F.lit(1)).alias("gs")).where("gs > 1").select("k", F.col("top.g").alias("top"))
    )
    return named.join(redeal(largest, "k"), "k").withColumn("outside", F.col("g") != F.col("top"))


def _prefix_links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Verified links between different components among the documents of ``sets``, complete by prefix filtering.

    With each set ordered from rare to frequent shingles, two sets that are similar
    enough share one of the first n - ceil(n * percent / 100) + 1 of each, at places that
    leave room for the overlap they need. Passages that many documents share are
    frequent and come last, so they make no pairs. For each such shingle, documents
    outside of its largest component meet those of its other components.
    """
    each = sets.select("id", F.size("shingles").alias("n"), "shingles").select("id", "n", F.explode("shingles").alias("k"))
    counts = each.groupBy("k").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles of one document come first in its order and pair with nothing, so only their number matters.
    ranked = write_table(each.join(redeal(counts, "k"), "k"), "frequent")
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "k")) + F.col("n") - F.count(F.lit(1)).over(W.partitionBy("id"))
    first = ranked.select("id", "n", "k", place.alias("i")).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    open_ = write_table(_open_members(first, groups), "open-prefixes")
    drop_table(ranked)
    a = open_.where("outside").select("k", F.col("id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("g").alias("ga"))
    b = open_.select("k", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("g").alias("gb"), F.col("outside").alias("ob"))
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    need = F.col("na") + F.col("nb")
    fits = (room * (100 + percent) >= need * percent) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    # Of two outside members the pair comes once.
    pairs = a.join(b, (a["k"] == b["k"]) & (F.col("ga") != F.col("gb")) & (~F.col("ob") | (F.col("a") < F.col("b"))) & fits)
    return write_table(_links(_sized(pairs, percent), sets, percent), "links")


def near_dups(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with n_shingles, component_id (long) and kept (boolean: the key is the component's smallest).

    Null or empty text, or one without words: no shingles, linked with nothing,
    kept. Null key: judged by its text; kept if nothing that it is linked with has a key.
    Repeated keys: rows with the same key are one node, whatever their texts, so
    all of them are kept or none; ties are that. Texts of any length are compared whole,
    an empty table stays empty. Columns named like the results are replaced, all others
    pass through, whatever their names.
    """
    h1, h2 = hash128(column(docs, text))
    slim = docs.select(integer_key(docs, key).alias("id"), h1.alias("h1"), h2.alias("h2"), column(docs, text).alias("text"))
    how = {"shingle": SHINGLE, "percent": PERCENT, "bands": BANDS, "band_rows": BAND_ROWS} | how
    found = write_table(_judged(slim, **how, same_key=True).withColumn("low", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("low"))), "near-dups")
    low = found.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.min("low").alias("_low"), F.max("n").alias("_n"))
    none = found.where("id is null").groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("low").alias("_low"), F.max("n").alias("_n"))
    rows = wrap(docs, integer_key(docs, key).alias("_k"), h1.alias("_x1"), h2.alias("_x2"))
    named = rows.where("_k is not null").join(redeal(low, "_id"), F.col("_k") == F.col("_id")).select("_doc", "_k", "_low", "_n")
    unnamed = rows.where("_k is null").join(redeal(none, "_h1"), (F.col("_x1") == F.col("_h1")) & (F.col("_x2") == F.col("_h2"))).select("_doc", "_k", "_low", "_n")
    return unwrap(named.unionByName(unnamed), docs.columns, {
        "n_shingles": F.col("_n"), "component_id": F.col("_low"), "kept": F.col("_k").eqNullSafe(F.col("_low")),
    })


def keep_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of rows whose texts are linked: the one with the smallest key (null last; ties: by text, then by content).

    Texts are told apart by 128 bits, so rows are judged alike whether their keys are
    unique, repeated or null. Rows without words are linked with nothing and stay.
    Texts of any length are compared whole; an empty table stays empty; all columns pass
    through, whatever their names.
    """
    body, k = column(docs, text), column(docs, key)
    worded = F.coalesce(body.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    h1, h2 = hash128(body)
    slim = docs.where(worded).select(F.lit(None).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), body.alias("text"))
    how = {"shingle": SHINGLE, "percent": PERCENT, "bands": BANDS, "band_rows": BAND_ROWS} | how
    found = _judged(slim, **how, same_key=False).select("h1", "h2", "component").distinct()
    counts = docs.where(worded).select(k.alias("key"), h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2", "key").agg(F.count(F.lit(1)).alias("c"))
    first = counts.groupBy("h1", "h2").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h1", "h2", "c")).alias("m"))
    won = write_table(first.join(found, ["h1", "h2"]).groupBy("component").agg(F.min("m").alias("m")).select("m.*"), "kept")
    won = redeal(won.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("key").alias("_key"), F.col("c").alias("_c")), "_h1")
    one = wrap(docs.where(worded), h1.alias("_x1"), h2.alias("_x2"), k.alias("_k")).join(
        won, (F.col("_x1") == F.col("_h1")) & (F.col("_x2") == F.col("_h2")) & F.col("_k").eqNullSafe(F.col("_key")))
    same = one.where("_c > 1").groupBy("_h1", "_h2").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
    kept = one.where("_c = 1").select("_doc").unionByName(same.select("_doc"))
    return docs.where(~worded).unionByName(unwrap(kept, docs.columns, {}))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_dup_components(docs, shingle=QUERY_SHINGLE, percent=QUERY_PERCENT)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = f"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
split AS (
  SELECT rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM rows_
),
shingles AS (
  SELECT DISTINCT rid, CASE WHEN len(w) < {QUERY_SHINGLE} THEN w ELSE w[i:i + {QUERY_SHINGLE - 1}] END AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - {QUERY_SHINGLE - 2}))) AS i FROM split WHERE len(w) > 0)
),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
common AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= {QUERY_PERCENT} * (p.n + q.n - c)
  UNION ALL SELECT a.rid, b.rid FROM rows_ a JOIN rows_ b ON a.doc_id = b.doc_id AND a.rid < b.rid JOIN sizes p ON p.rid = a.rid JOIN sizes q ON q.rid = b.rid
),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(rid, other) AS (SELECT rid, rid FROM rows_ UNION SELECT r.rid, e.y FROM reach r JOIN both_ways e ON r.other = e.x),
low AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN rows_ d ON d.rid = r.other GROUP BY r.rid)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM rows_ d JOIN low USING (rid) LEFT JOIN sizes s ON s.rid = d.rid
"""
