"""Line dedup by distinct-site spread: HyperLogLog per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, hash128, redeal, text_or_empty, unwrap, wrap

#: A line that this many sites carry is boilerplate.
MIN_SITES = 5
#: log2 of the sketch's registers; its standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Share of the threshold, on both sides, within which the sites are counted exactly (over 7 standard errors).
BAND = 0.25

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (t1, t2, pos, k1, k2, site) of lines with a word; t: the text's hash, k: the trimmed line's."""
    t1, t2 = hash128(text_or_empty(F.col("text")))
    rows = docs.select(t1.alias("t1"), t2.alias("t2"), "site", F.posexplode(F.split(text_or_empty(F.col("text")), "\n", -1)))
    rows = rows.select("t1", "t2", "site", "pos", F.regexp_replace("col", _TRIM, "").alias("line")).where("line <> ''")
    k1, k2 = hash128(F.col("line"))
    return rows.select("t1", "t2", "pos", k1.alias("k1"), k2.alias("k2"), "site")


def boilerplate_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND
) -> DataFrame:
    """(k1, k2, sites) of the lines that at least ``min_sites`` sites carry.

    One sketch of sites per line hash, merged by aggregation. A line whose estimate
    is within ``band`` of the threshold gets its exact distinct count instead.
    """
    lines = _lines(docs.select(column(docs, text).alias("text"), column(docs, site).cast("string").alias("site"))).where("site is not null")
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    far = spread.where(F.col("sites") > high)
    near = spread.where(F.col("sites").between(low, high)).select("k1", "k2")
    exact = (
        lines.select("k1", "k2", "site").join(redeal(near, "k1", "k2"), ["k1", "k2"], "left_semi").distinct()
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    )
    return far.unionByName(exact)


def dedup_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND
) -> DataFrame:
    """``docs`` with cross-site boilerplate lines cut out of ``text``, plus n_lines and n_removed (long).

    A line's identity is its text without white space at the ends; lines without a
    word are neither counted nor removed. The kept lines stay in order, joined by
    ``\\n``. Null site: the row's lines count for no site, but are still removed
    where others make them boilerplate. Null text: stays null, no lines; empty text: no
    lines. Texts and lines may be of any length and are read whole. Repeated rows (ties)
    are each kept and cleaned alike. An empty table stays empty. Columns named n_lines or
    n_removed are replaced, all others pass through, whatever their names.
    """
    bad = boilerplate_lines(docs, text, site, min_sites, lg_k, band).select("k1", "k2")
    lines = _lines(docs.select(column(docs, text).alias("text"), F.lit(None).cast("string").alias("site")))
    # One row for each text with something to remove, so copies of a text cost one set.
    cut = (
        lines.join(redeal(bad, "k1", "k2"), ["k1", "k2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("pos").alias("_cut"))
        .select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_cut")
    )
    t1, t2 = hash128(text_or_empty(column(docs, text)))
    out = wrap(docs, t1.alias("_t1"), t2.alias("_t2")).join(redeal(cut, "_t1"), ["_t1", "_t2"], "left")
    out = out.withColumn("_parts", F.split(text_or_empty(F.col("_doc")[text]), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_cut"))
    clean = F.array_join(F.transform(kept, lambda i: F.col("_parts")[i]), "\n")
    return unwrap(out, docs.columns, {
        text: F.when(F.col("_cut").isNull(), F.col("_doc")[text]).otherwise(clean),
        "n_lines": F.size(F.filter("_parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long"),
        "n_removed": F.coalesce(F.size("_cut"), F.lit(0)).cast("long"),
    })


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs)
    clean = text_or_empty(F.col("text"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.length(clean).cast("long").alias("kept_chars"), F.sha2(clean, 256).alias("text_sha256")
    )


SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_
),
trimmed AS (SELECT rid, source, raw, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
bad AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
flagged AS (SELECT t.*, b.line IS NOT NULL AS cut FROM trimmed t LEFT JOIN bad b ON t.line = b.line),
clean AS (
  SELECT rid, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (cut) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text
  FROM flagged GROUP BY rid
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(c.text)::BIGINT AS kept_chars, sha256(c.text) AS text_sha256
FROM rows_ JOIN clean c USING (rid)
"""
