"""The authoritative graphs: one nested row for each, its hash, its contract, and the way back to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import lower_escapes
from loomgraph.functions.text import source_policy_violations
from loomgraph.operators.graph import integrity_claims
from loomgraph.operators.rules import claims, violations

#: Where edges come from, and how strong their support may be.
PROVENANCE, SUPPORT = "fact_extraction", ("EXPLICIT", "LOCALLY_ENTAILED", "PLAUSIBLE")
#: The fields of a graph, in the order of its canonical JSON.
HEADER = ("graph_id", "manifest_identity_hash", "prompt_hash", "prompt_id", "run_id")
NODE = ("aliases", "canonical_name", "entity_id", "evidence_span_ids", "local_entity_ids", "primary_type")
EDGE = (
    "edge_id", "evidence_span_ids", "provenance", "qualifiers", "raw_relation", "relation_description", "relation_family", "source_entity_id", "support_level",
    "target_entity_id", "unit_id",
)
QUALIFIERS = ("condition", "modality", "negated", "quantity", "temporality", "version")
SOURCE = ("repository_relative_path", "source_location_policy", "source_name", "source_sha256", "source_size_bytes")
SCHEMA = (
    "struct<edges:array<struct<edge_id:string,evidence_span_ids:array<string>,provenance:struct<prompt_id:string,source:string>,"
    "qualifiers:struct<condition:string,modality:string,negated:boolean,quantity:string,temporality:string,version:string>,raw_relation:string,"
    "relation_description:string,relation_family:string,source_entity_id:string,support_level:string,target_entity_id:string,unit_id:string>>,"
    "graph_id:string,manifest_identity_hash:string,nodes:array<struct<aliases:array<string>,canonical_name:string,entity_id:string,evidence_span_ids:array<string>,"
    "local_entity_ids:array<string>,primary_type:string>>,prompt_hash:string,prompt_id:string,run_id:string,source:struct<repository_relative_path:string,"
    "source_location_policy:string,source_name:string,source_sha256:string,source_size_bytes:bigint,units:array<struct<span_ids:array<string>,unit_id:string>>>>"
)


def with_provenance(edges: DataFrame, prompt_id: str | Column) -> DataFrame:
    prompt = F.lit(prompt_id) if isinstance(prompt_id, str) else prompt_id
    return edges.withColumn("provenance", F.struct(prompt.alias("prompt_id"), F.lit(PROVENANCE).alias("source")))


def nested_graphs(headers: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(g, graph): each header's graph as one struct, nodes by entity number, edges and units in source order.

    ``headers``: g and HEADER; ``sources``: g and SOURCE; ``edges`` with ordinal and
    provenance; ``units``: g, unit_id, span_ids. A graph lies in one row, as in its
    file; that is for files, all other operators work on the tables.
    """

    def listed(rows: DataFrame, order: list[Column], fields: tuple[str, ...], name: str, replace: dict | None = None) -> DataFrame:
        item = F.struct(*((replace or {}).get(f, F.col(f)).alias(f) for f in fields))
        one = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), item.alias("x"))
        return rows.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(one)), lambda r: r["x"]).alias(name))

    in_order = F.struct(*(F.col("qualifiers")[q].alias(q) for q in QUALIFIERS))
    number = F.substring("entity_id", 2, 20).cast("long")
    out = headers.join(sources, "g")
    for part in (
        listed(nodes, [number, F.col("entity_id")], NODE, "nodes"), listed(edges, [F.col("ordinal"), F.col("edge_id")], EDGE, "edges", {"qualifiers": in_order}),
        listed(units, [F.length("unit_id"), F.col("unit_id")], ("span_ids", "unit_id"), "units"),
    ):
        out = out.join(part, "g", "left")
    kinds = {k: t for k, t in (("nodes", nodes), ("edges", edges), ("units", units))}
    empty = {k: F.coalesce(F.col(k), F.array().cast(out.schema[k].dataType)) for k in kinds}
    source = F.struct(*(F.col(c) for c in SOURCE), empty["units"].alias("units"))
    fields = {"edges": empty["edges"], "nodes": empty["nodes"], "source": source, **{h: F.col(h) for h in HEADER}}
    return out.select("g", F.struct(*(fields[f].alias(f) for f in sorted(fields))).alias("graph"))


def graph_json(graph: Column) -> Column:
    """A nested graph as canonical JSON: keys sorted, nulls kept, nothing between."""
    return lower_escapes(F.to_json(graph, {"ignoreNullFields": "false"}))


def graph_hash(graph: Column) -> Column:
    return F.sha2(graph_json(graph), 256)


def read_graphs(texts: DataFrame, column: str = "value") -> DataFrame:
    """(g, graph) from canonical JSON; text that is no graph is an error."""
    graph = F.from_json(column, SCHEMA)
    checked = F.when(graph["graph_id"].isNotNull(), graph).otherwise(F.raise_error(F.concat(F.lit("not a graph: "), F.substring(column, 1, 60))).cast(SCHEMA))
    return texts.select(checked.alias("graph")).select(F.col("graph.graph_id").alias("g"), "graph")


def tables_of(graphs: DataFrame) -> dict[str, DataFrame]:
    """headers, sources, nodes, edges (with ordinal) and units of nested graphs."""
    of = lambda name: graphs.select("g", F.posexplode(f"graph.{name}").alias("ordinal", "x"))
    units = graphs.select("g", F.explode("graph.source.units").alias("x"))
    return {
        "headers": graphs.select("g", *(f"graph.{h}" for h in HEADER)), "sources": graphs.select("g", *(f"graph.source.{c}" for c in SOURCE)),
        "nodes": of("nodes").select("g", *(f"x.{c}" for c in NODE)), "edges": of("edges").select("g", (F.col("ordinal") + 1).alias("ordinal"), *(f"x.{c}" for c in EDGE)),
        "units": units.select("g", "x.unit_id", "x.span_ids"),
    }


def contract_violations(headers: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(g, rule, id) of everything that the contract of a final graph forbids; nothing is repaired.

    Beyond a graph's integrity: the header's fields and hash, the source's policy, at
    least one unit with spans, texts that must not be empty, enums, and that each edge
    comes from the graph's own prompt.
    """
    no = lambda good: ~F.coalesce(good, F.lit(False))
    full, some = (lambda c: F.col(c) != ""), (lambda c: F.size(c) > 0)
    more = {
        "units": {"empty_unit": no(some("span_ids") & full("unit_id"))},
        "nodes": {**{f"node_{c}": no(full(c)) for c in ("entity_id", "primary_type")}, "no_local_entities": no(some("local_entity_ids"))},
        "edges": {
            **{f"edge_{c}": no(full(c)) for c in ("edge_id", "source_entity_id", "target_entity_id", "relation_description", "unit_id")},
            "blank_family": no(F.col("relation_family").rlike(r"\S")), "support_level": no(F.col("support_level").isin(*SUPPORT)), "negated": F.col("qualifiers.negated").isNull(),
            "no_evidence": no(some("evidence_span_ids") & ~F.array_contains("evidence_span_ids", "")), "provenance": no(F.col("provenance.source") == PROVENANCE),
        },
    }
    header = {f"header_{h}": no(full(h)) for h in HEADER} | {"header_hash_form": no(F.col("manifest_identity_hash").rlike(r"\A[0-9a-f]{64}\z"))}
    # A row for each graph: dealt like tables in buckets by graph, which then need not be dealt again.
    headers = headers.repartition(int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g")
    heads = claims(headers, "g", header, (("prompt", "prompt_id", None),), (("units", F.lit(""), "no_units"),))
    policy = source_policy_violations(sources, "g").select("g", "rule", F.col("g").cast("string").alias("id"))
    rows = integrity_claims(nodes, edges, units, more, (("prompt", F.col("provenance.prompt_id"), "foreign_prompt"),))
    return violations(*rows, heads).unionByName(policy)
