"""Helpers of the training-data operators: text hashes, batches, columns that can't clash."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.shared import drop_table, redeal, write_table  # noqa: F401

#: The bytes that separate words; ``bytes.split()`` cuts at exactly these.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def hash128(col: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes; as a pair they identify a string."""
    return F.xxhash64(col), F.xxhash64(F.lit(7), col)


def column(df: DataFrame, name: str) -> Column:
    """A column of ``df`` by its exact name, whatever characters that has."""
    return df["`" + name.replace("`", "``") + "`"]


def integer_key(df: DataFrame, name: str) -> Column:
    """A key column as long; a key of another kind than whole numbers is an error, as its text would be lost."""
    if not isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"the key {name!r} must be a whole number, not {df.schema[name].dataType.simpleString()}")
    return column(df, name).cast("long")


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1 and so on, and those names by the old ones; no operator's columns clash with them."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {c: f"c{i}" for i, c in enumerate(df.columns)}


def row_hash(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row. Nulls count by their place; what isn't atomic is hashed as JSON."""
    values, nulls = [], []
    for f in df.schema.fields:
        value = column(df, f.name)
        nulls.append(F.when(value.isNull(), "1").otherwise("0"))
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        values.append(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}) if nested else value)
    where = F.concat(*nulls) if nulls else F.lit("")
    return F.xxhash64(F.lit(11), where, *values), F.xxhash64(F.lit(13), where, *values)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def wrap(df: DataFrame, *more: Column) -> DataFrame:
    """``df``'s rows as one struct column ``_doc`` beside ``more``: derived columns can't clash with its own."""
    return df.select(F.struct("*").alias("_doc"), *more)


def unwrap(df: DataFrame, columns: list[str], replace: dict[str, Column]) -> DataFrame:
    """The original ``columns`` of ``_doc`` in order, with ``replace``'s in place of equal names or after them."""
    lower = {c.lower(): c for c in replace}
    own = [replace[lower[c.lower()]].alias(c) if c.lower() in lower else F.col("_doc")[c].alias(c) for c in columns]
    have = {c.lower() for c in columns}
    return df.select(*own, *(v.alias(k) for k, v in replace.items() if k.lower() not in have))


def blocks_of(batch: pa.RecordBatch, column: int, limit: int = 4 << 20, rows: int = 2048):
    """Slices of a batch with at most ``rows`` rows and about ``limit`` bytes of text in a column, or one row if that has more."""
    size = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if i > start and (total + n > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
