"""Embedding calls of a graph as one logical call: numbered batches, answers judged together, usage summed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names in a request at most.
BATCH = 512
_BODY = "model string, data array<struct<index: double, embedding: array<double>>>, usage struct<prompt_tokens: bigint, total_tokens: bigint>"
#: What is wrong with answers, by batch or, for dimensions, by graph.
RULES = ("http_status", "data", "count", "index", "vector", "dimension")


def embedding_requests(entities: DataFrame, model: str, batch: int = BATCH) -> DataFrame:
    """(g, batch, size, request): the names of each graph's entities (g, ord from 1 without gaps, name) in order, ``batch`` to a request."""
    placed = entities.select("g", F.floor((F.col("ord") - 1) / batch).cast("long").alias("batch"), "ord", "name")
    grouped = placed.groupBy("g", "batch").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("n"))
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.transform("n", lambda x: x["name"]).alias("input")))
    return grouped.select("g", "batch", F.size("n").cast("long").alias("size"), body.alias("request"))


def read_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (g, batch, size, http_status, body) with what their bodies hold: model, data, usage; data is null where there is none or it isn't a list."""
    return answers.withColumn("_b", F.from_json("body", _BODY)).select(
        "g", "batch", "size", "http_status", F.col("_b.model").alias("model"), F.col("_b.data").alias("data"), F.col("_b.usage").alias("usage"))


def embedding_violations(read: DataFrame) -> DataFrame:
    """(g, batch, rule): what makes a graph's answers unusable. Dimensions are compared over all of a graph's batches (batch is null).

    Indexes must be whole numbers from 0 to size - 1, each once, in any order.
    """
    index = F.transform("data", lambda x: x["index"])
    whole = F.forall("data", lambda x: F.coalesce(x["index"] == F.floor(x["index"]), F.lit(False)))
    wanted = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))
    vectors = F.forall("data", lambda x: F.coalesce(F.size(x["embedding"]) > 0, F.lit(False)) & F.coalesce(F.forall(x["embedding"], lambda v: v.isNotNull()), F.lit(False)))
    rule = (
        F.when(~F.col("http_status").eqNullSafe(200), "http_status").when(F.col("data").isNull(), "data").when(F.size("data") != F.col("size"), "count")
        .when(~whole | (F.array_sort(index) != wanted), "index").when(~vectors, "vector")
    )
    single = read.select("g", "batch", rule.alias("rule")).where("rule is not null")
    sizes = read.select("g", F.explode("data").alias("d")).select("g", F.size("d.embedding").alias("n"))
    uneven = sizes.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low <> high")
    return single.unionByName(uneven.select("g", F.lit(None).cast("long").alias("batch"), F.lit("dimension").alias("rule")))


def embedding_vectors(read: DataFrame, batch: int = BATCH) -> DataFrame:
    """(g, ord, vector) of answers without violations."""
    each = read.select("g", "batch", F.explode("data").alias("d"))
    return each.select("g", (F.col("batch") * batch + F.col("d.index") + 1).cast("int").alias("ord"), F.col("d.embedding").alias("vector"))


def embedding_metadata(read: DataFrame, model: str) -> DataFrame:
    """(g, calls, models, data_count, vector_dimension, prompt_tokens, total_tokens): each graph's calls as they were made, usage summed (null where no answer says any)."""
    return read.groupBy("g").agg(
        F.count(F.lit(1)).alias("calls"), F.sort_array(F.collect_set(F.coalesce("model", F.lit(model)))).alias("models"), F.sum(F.size("data")).cast("long").alias("data_count"),
        F.max(F.size(F.get("data", F.lit(0))["embedding"])).alias("vector_dimension"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.total_tokens").alias("total_tokens"))
