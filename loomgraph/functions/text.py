"""Paragraphs and sentence spans with exact offsets, and text comparisons; built-in functions throughout."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space as str.isspace has it.
SPACE = r"[\s\x1c-\x1f]"
#: The same, character by character: what is cut off at the ends is looked for only there.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = r"(?>\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}])"
_BLANK = r"[\s\x1f&&[^\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]]"
#: Tiles a text into sentences: after each ! or ?, after a . before white space or the end; the tail is one too.
#: Mostly the first of these marks ends one, which is found without a step back.
SENTENCE_TILES = rf"(?Us)[^!?.]*+(?:[!?]|\.(?={SPACE}|\z))|(?Us).*?(?:[!?]|\.(?={SPACE}|\z))|(?Us).+\z"
#: Tiles a text into paragraphs with the blank lines that end them.
PARAGRAPH_TILES = rf"(?Us).+?(?:{_BREAK}{_BLANK}*{_BREAK}{SPACE}*|\z)"
#: What parts paragraphs; a text without it is one.
PARTED = rf"(?U){_BREAK}{_BLANK}*+{_BREAK}"


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF, before any hash or offset."""
    return F.regexp_replace(text, "\r\n?", "\n")


def numbered(letter: str, number: Column) -> Column:
    """An id: a letter and a number of three digits or more."""
    digits = number.cast("string")
    return F.concat(F.lit(letter), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def trim_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def trim_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _tiles(df: DataFrame, keys: list[str], text: str, tiles: Column, order: list[str], more: list[str]) -> DataFrame:
    """keys, order, more, number (from 1 for each key, blanks left out), text (trimmed, not empty), start and end in code points.

    ``tiles``: the array of them, which together are ``text``. Starts are prefix sums
    over the tiles of a row of ``df``, numbers go through all rows of a key by
    ``order``: both from one exchange and one sort by key.
    """
    if order:
        # A row's first tile begins at 0: what the key's rows before it hold is taken off again.
        earlier = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        df, more = df.withColumn("_before", F.coalesce(F.sum(F.length(text)).over(earlier), F.lit(0))), [*more, "_before"]
    # Outer, as Spark would else cut every text once more to leave out those without tiles; a row of nulls is left out below.
    exploded = df.select(*keys, *order, *more, F.posexplode_outer(tiles).alias("pos", "_tile"))
    left = trim_left(F.col("_tile"))
    cut = exploded.select(*keys, *order, *more, "pos", F.length("_tile").alias("_all"), F.length(left).alias("_rest"), trim_right(left).alias("text"))
    in_row = W.partitionBy(*keys).orderBy(*order, "pos")
    total = F.sum("_all").over(in_row.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_all")
    placed = cut.withColumns({"_total": total, "_filled": F.sum((F.col("text") != "").cast("int")).over(in_row.rowsBetween(W.unboundedPreceding, W.currentRow))})
    start = F.col("_total") - (F.col("_before") if order else F.lit(0)) + F.col("_all") - F.col("_rest")
    return placed.where("text <> ''").select(*keys, *order, *more, F.col("_filled").cast("int").alias("number"), "text", start.alias("start_offset"), (start + F.length("text")).alias("end_offset"))


def split_units(docs: DataFrame, key: str = "doc_id", text: str = "text", empty: str = "skip") -> DataFrame:
    """(key, unit_no from 1, text, start_offset, end_offset): paragraphs parted by blank lines, trimmed, inner newlines kept.

    A text without any is an error if ``empty`` is "error", else it has no rows.
    """
    if empty not in ("skip", "error"):
        raise ValueError(f"unknown choice {empty!r}")
    body = F.coalesce(F.col(text), F.lit(""))
    if empty == "error":
        body = F.when(trim_left(body) != "", body).otherwise(F.raise_error(F.concat(F.lit("no paragraph in "), F.col(key).cast("string"))).cast("string"))
    whole = F.when(F.col("_text") != "", F.array("_text")).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.col("_text").rlike(PARTED), F.regexp_extract_all("_text", F.lit(PARAGRAPH_TILES), F.lit(0))).otherwise(whole)
    tiles = _tiles(docs.select(key, body.alias("_text")), [key], "_text", parts, [], [])
    return tiles.select(key, F.col("number").alias("unit_no"), "text", "start_offset", "end_offset")


def split_spans(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, unit_no, span_no, span_id, unit_id, text, start/end offsets in the unit, document_start/end): sentences.

    Spans are numbered through the whole document; ids have three digits or more.
    """
    source = units.select(key, "unit_no", F.col("text").alias("_text"), F.col("start_offset").alias("_unit"))
    tiles = _tiles(source, [key], "_text", F.regexp_extract_all("_text", F.lit(SENTENCE_TILES), F.lit(0)), ["unit_no"], ["_unit"])
    out = tiles.withColumn("span_no", F.col("number")).withColumn("span_id", numbered("S", F.col("span_no")))
    return out.select(
        key, "unit_no", "span_no", "span_id", F.concat(numbered("U", F.col("unit_no")), F.lit("_"), "span_id").alias("unit_id"), "text",
        "start_offset", "end_offset", (F.col("_unit") + F.col("start_offset")).alias("document_start"), (F.col("_unit") + F.col("end_offset")).alias("document_end"),
    )


def document_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of documents, paragraph by paragraph."""
    return split_spans(split_units(docs.select(key, normalize_newlines(F.col(text)).alias("text")), key), key)


def source_identity(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "source", path: str | None = None, root: str | None = None) -> DataFrame:
    """(key, source_name, source_sha256, source_size_bytes, source_location_policy, repository_relative_path) of the newline-normalised text.

    A document whose ``path`` column lies below the folder ``root`` is
    repository_relative, with its path from there; every other one is external,
    without a path. No absolute path leaves this function.
    """
    body = normalize_newlines(F.coalesce(F.col(text), F.lit("")))
    relative = F.lit(None).cast("string")
    if path is not None and root is not None:
        below = F.lit(root.rstrip("/") + "/")
        relative = F.when(F.startswith(F.col(path), below), F.substr(F.col(path), F.length(below) + 1))
    return docs.select(
        key, F.col(name).alias("source_name"), F.sha2(body, 256).alias("source_sha256"), F.octet_length(body).cast("long").alias("source_size_bytes"),
        F.when(relative.isNotNull(), "repository_relative").otherwise("external").alias("source_location_policy"), relative.alias("repository_relative_path"),
    )


def source_policy_violations(sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rule) of sources whose path and policy don't fit: only a repository_relative source has a path, and it must."""
    policy, path = F.col("source_location_policy"), F.coalesce(F.col("repository_relative_path"), F.lit(""))
    rule = (
        F.when(~F.coalesce(policy.isin("repository_relative", "external"), F.lit(False)), "unknown_policy")
        .when((policy == "repository_relative") & (path == ""), "relative_without_path")
        .when((policy == "external") & F.col("repository_relative_path").isNotNull(), "external_with_path")
        .when(~F.coalesce(F.col("source_sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), "source_hash")
        .when(F.coalesce(F.col("source_name"), F.lit("")) == "", "source_name")
        .when(~F.coalesce(F.col("source_size_bytes") >= 0, F.lit(False)), "source_size")
    )
    return sources.select(key, rule.alias("rule")).where("rule is not null")


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def neutral_surface(text: Column) -> Column:
    """White space collapsed, Unicode composed. ASCII needs no composing and stays in the JVM."""
    plain = F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), plain).otherwise(F.pandas_udf(_nfc, "string")(F.when(~text.rlike(r"\A\p{ASCII}*\z"), text)))


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What full case folding changes in lower-case text: characters that become one other, and those that become several."""
    lower = (c for c in map(chr, range(0x80, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c == c.lower())
    folds = {c: c.casefold() for c in lower}
    return {c: f for c, f in folds.items() if len(f) == 1}, {c: f for c, f in folds.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding, all in the JVM: lower case, and what folding does beyond that."""
    one, many = _folds()
    low = F.translate(F.lower(text), "".join(one), "".join(one.values()))
    # Few texts hold a character that becomes several: those go through it character by character.
    table = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    spelt = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    full = F.when(low.rlike("[" + "".join(many) + "]"), spelt).otherwise(low)
    # ASCII has nothing to fold but its capitals.
    return F.when(text.rlike(r"\A\p{ASCII}*+\z"), F.lower(text)).otherwise(full)


def collapsed(text: Column) -> Column:
    """Case folded, white space at the ends cut and between words as one space."""
    return casefold(F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " ")))


def name_tokens(name: Column) -> Column:
    """Case-folded runs of letters and digits."""
    return F.array_remove(F.split(casefold(name), r"[^\p{L}\p{N}]+"), "")


def relation_key(raw: Column) -> Column:
    """Case-folded letters and digits, everything between as one underscore."""
    return F.regexp_replace(F.regexp_replace(casefold(F.trim(raw)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def contains_tokens(container: Column, part: Column) -> Column:
    """Whether a strictly longer token list holds the other one in a row; tokens hold no white space."""
    spaced = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (F.size(part) > 0) & (F.size(container) > F.size(part)) & F.contains(spaced(container), spaced(part))


def name_relation(left: Column, right: Column) -> Column:
    """EXACT, CASE_ONLY, TOKEN_CONTAINMENT_EXPANSION or DIFFERENT."""
    a, b = F.trim(left), F.trim(right)
    x, y = name_tokens(left), name_tokens(right)
    return (
        F.when(a == b, "EXACT").when(casefold(a) == casefold(b), "CASE_ONLY")
        .when(contains_tokens(x, y) | contains_tokens(y, x), "TOKEN_CONTAINMENT_EXPANSION").otherwise("DIFFERENT")
    )
