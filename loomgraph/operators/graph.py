"""Consolidated nodes and edges, their integrity, and what a graph looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.ids import edge_id
from loomgraph.operators import components, rules
from loomgraph.operators.extract import MAX_DESCRIPTION, MODALITIES

_LOCAL = r"\bM[0-9]{3,}\b"


def consolidate_nodes(resolved: DataFrame) -> DataFrame:
    """(g, entity_id, canonical_name, primary_type, aliases, local_entity_ids, evidence_span_ids) of ``resolved`` local entities.

    Name and type are the first member's; aliases are the other members' distinct names, sorted.
    """
    members = F.sort_array(F.collect_list(F.struct("ord", "name", "type", "local_id", "span_id")))
    grouped = resolved.groupBy("g", "entity_id").agg(members.alias("m"))
    return grouped.select(
        "g", "entity_id", F.col("m")[0]["name"].alias("canonical_name"), F.col("m")[0]["type"].alias("primary_type"),
        F.sort_array(F.array_distinct(F.transform(F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))), lambda x: x["name"]))).alias("aliases"),
        F.transform("m", lambda x: x["local_id"]).alias("local_entity_ids"),
        F.sort_array(F.array_distinct(F.transform("m", lambda x: x["span_id"]))).alias("evidence_span_ids"),
    )


def project_edges(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges between resolved entities with their hashed ids, all occurrences, and ``unresolved``: what could not be rebound.

    ``relations``: g, ordinal (one for each in a graph), source/target_local_id, raw_relation, relation_family,
    relation_description, span_id, unit_id, support_level, qualifiers. A qualifier
    that is exactly a local id becomes its entity's; one that only contains a local id is unresolved.
    """
    fields = ("temporality", "condition", "quantity", "version")
    # What a relation names and what defines it meet as rows of one graph; qualifiers take part only where they are an id.
    carried = [c for c in relations.columns if c != "g"]
    kinds = dict(relations.dtypes)
    known = resolved.select("g", "local_id", "entity_id", *(F.lit(None).cast(kinds[c]).alias(c) for c in carried), F.lit(False).alias("_uses"))
    asks = relations.select("g", *(F.lit(None).cast("string").alias(c) for c in ("local_id", "entity_id")), *carried, F.lit(True).alias("_uses"))
    named = F.array(
        *(F.struct(F.lit(e).alias("role"), F.col(f"{e}_local_id").alias("local_id")) for e in ("source", "target")),
        *(F.struct(F.lit(f).alias("role"), F.when(F.col("qualifiers")[f].rlike(r"\AM[0-9]{3,}\z"), F.col("qualifiers")[f]).alias("local_id")) for f in fields),
    )
    used = F.filter(named, lambda x: (x["role"] == "source") | x["local_id"].isNotNull())
    defined = F.array(F.struct(F.lit("").alias("role"), F.col("local_id").alias("local_id")))
    # Relations first: Spark knows a union of tables in buckets as dealt only if the first names its bucket column anew.
    each = asks.unionByName(known).withColumn("_x", F.explode(F.when(F.col("_uses"), used).otherwise(defined)))
    # A relation's own columns go on with its source alone.
    own = F.col("_x.role") == "source"
    each = each.select("g", "entity_id", F.col("_x.role").alias("role"), F.col("_x.local_id").alias("local_id"), "ordinal", *(F.when(own, F.col(c)).alias(c) for c in carried if c != "ordinal"))
    found = F.when(F.col("g").isNotNull() & F.col("local_id").isNotNull(), F.max("entity_id").over(W.partitionBy("g", "local_id")))
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("_found"))).over(W.partitionBy("g", "ordinal"))
    uses = each.withColumn("_found", found).where("role <> ''")
    out = uses.withColumns({**{f"{e}_entity_id": of(e) for e in ("source", "target")}, **{f"_{f}": of(f) for f in fields}}).where("role = 'source'")
    q = F.col("qualifiers")
    rebound = F.struct(*(
        (F.coalesce(F.col(f"_{f}"), q[f]) if f in fields else q[f]).alias(f) for f in ("temporality", "condition", "modality", "negated", "quantity", "version")
    ))
    bad = F.array_compact(F.array(
        *(F.when(F.col(f"{e}_entity_id").isNull(), F.lit(e)) for e in ("source", "target")),
        *(F.when(F.col(f"_{f}").isNull() & F.coalesce(q[f].rlike(_LOCAL), F.lit(False)), F.lit(f)) for f in fields),
    ))
    out = out.withColumns({"qualifiers": rebound, "unresolved": bad, "evidence_span_ids": F.array("span_id")})
    return out.select(
        "g", edge_id(F.col("source_entity_id"), F.col("raw_relation"), F.col("target_entity_id"), F.col("evidence_span_ids"), F.col("qualifiers")).alias("edge_id"),
        "ordinal", "source_entity_id", "target_entity_id", "raw_relation", "relation_family", "relation_description", "evidence_span_ids",
        "support_level", "qualifiers", "unit_id", "unresolved",
    )


def dedup_edges(edges: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(the first of each edge_id in source order, the others), in each graph or within further columns, such as unit_id."""
    ranked = edges.withColumn("_n", F.row_number().over(W.partitionBy("g", *within, "edge_id").orderBy("ordinal")))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def integrity_claims(nodes: DataFrame, edges: DataFrame, units: DataFrame, more: dict[str, dict] | None = None, uses: tuple = ()) -> list[DataFrame]:
    """What a graph's rows break, define and use; ``more``: further rules by table, ``uses``: further uses by edges."""
    more = more or {}
    local = lambda c: F.coalesce(F.col(c).rlike(_LOCAL), F.lit(False))
    qualified = F.exists(F.array("qualifiers.temporality", "qualifiers.condition", "qualifiers.quantity", "qualifiers.version"), lambda v: F.coalesce(v.rlike(_LOCAL), F.lit(False)))
    edge = {
        "blank_relation": F.trim("raw_relation") == "", "long_description": F.length("relation_description") > MAX_DESCRIPTION,
        "modality": ~F.coalesce(F.col("qualifiers.modality").isin(*MODALITIES), F.lit(False)), "local_endpoint": local("source_entity_id") | local("target_entity_id"), "local_qualifier": qualified,
    }
    node = {"local_entity": local("entity_id"), "empty_node": (F.size("evidence_span_ids") == 0) | (F.trim("canonical_name") == "")}
    # Units first: Spark knows a union of tables in buckets as dealt only if the first names its bucket column anew.
    return [
        rules.claims(units, "unit_id", more.get("units", {}), (("unit", "unit_id", None), ("span", "span_ids", None), ("units", F.lit(""), None))),
        rules.claims(edges, "edge_id", edge | more.get("edges", {}), (("edge", "edge_id", "duplicate_edge"),), (
            ("entity", "source_entity_id", "dangling_source"), ("entity", "target_entity_id", "dangling_target"), ("unit", "unit_id", "unknown_unit"),
            ("span", "evidence_span_ids", "unknown_edge_span"), *uses)),
        rules.claims(nodes, "entity_id", node | more.get("nodes", {}), (("entity", "entity_id", "duplicate_node"),), (("span", "evidence_span_ids", "unknown_node_span"),)),
    ]


def graph_violations(nodes: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(g, rule, id): what breaks a graph's integrity, once each; empty for a sound graph.

    ``units``: g, unit_id, span_ids. Checks ids, endpoints, spans, units, texts, modality
    and unresolved local ids, with one scan of each table.
    """
    return rules.violations(*integrity_claims(nodes, edges, units))


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, components, isolated): connected components, isolated nodes included, and sorted ids of isolated nodes."""
    member = components.graph_components(edges, "g", "source_entity_id", "target_entity_id")
    ends = edges.select("g", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).where("g is not null and entity_id is not null")
    row = lambda df, nodes, ends, c: df.select("g", "entity_id", F.lit(nodes).alias("_nodes"), F.lit(ends).alias("_ends"), c.alias("_c"))
    none = F.lit(None).cast(dict(member.dtypes)["component"])
    # Nodes, what edges name and its components meet as rows of one graph.
    known = member.where("g is not null").select("g", F.col("node").alias("entity_id"), "component")
    every = row(nodes, 1, 0, none).unionByName(row(ends, 0, 1, none)).unionByName(row(known, 0, 0, F.col("component")))
    named = every.groupBy("g", "entity_id").agg(F.sum("_nodes").cast("int").alias("_nodes"), F.max("_ends").alias("_ends"), F.max("_c").alias("_c")).where("_nodes > 0")
    lone = F.when(F.col("_ends") == 0, F.array_repeat("entity_id", F.col("_nodes")))
    return named.groupBy("g").agg(
        F.count_distinct(F.coalesce("_c", "entity_id")).alias("components"), F.sort_array(F.flatten(F.collect_list(lone))).alias("isolated"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, entity_id) of nodes that no edge ends at."""
    ends = edges.select("g", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    return nodes.select("g", "entity_id").join(ends, ["g", "entity_id"], "left_anti")
