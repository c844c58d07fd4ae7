"""Exact parity of graphs and what is stored of them: data, schema, namespaces, and a status for each graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.project import blank_graphs, edges_without_graph, index_names, parity
from loomgraph.operators.store import digest_columns, digests
from loomgraph.sources.shared import write_table

#: The properties that every stored node and edge must have.
NODE_PROPERTIES = (
    "entity_id", "graph_id", "canonical_name", "primary_type", "aliases", "local_entity_ids", "evidence_span_ids", "display_name", "run_id", "source_sha256",
    "manifest_identity_hash",
)
EDGE_PROPERTIES = (
    "edge_id", "graph_id", "source_entity_id", "target_entity_id", "raw_relation", "relation_family", "relation_description", "evidence_span_ids", "support_level",
    "unit_id", "display_relation", "qualifiers_json", "provenance_json", "run_id", "source_sha256", "manifest_identity_hash",
)
#: What must be empty for a graph to pass.
MUST_BE_EMPTY = (
    "graph_only_nodes", "store_only_nodes", "graph_only_edges", "store_only_edges", "source_target_mismatches", "duplicate_edges", "import_errors",
    "missing_expected_node_labels", "unexpected_node_labels", "missing_expected_relationship_types", "unexpected_relationship_types",
    "missing_required_node_properties", "missing_required_relationship_properties", "node_property_mismatches", "relationship_property_mismatches",
    "missing_indexes", "unexpected_indexes", "misconfigured_indexes", "edges_without_graph_id", "unexpected_graph_ids",
)


def index_differences(indexes: DataFrame, label: str, relation: str) -> DataFrame:
    """One row: missing_indexes, unexpected_indexes and misconfigured_indexes, sorted names.

    Expected and recorded indexes (name, labels_or_types, properties) are joined by
    name. One that isn't expected counts only if it is for one of the two types; unknown properties count as right.
    """
    expected = indexes.sparkSession.createDataFrame(list(index_names(label, relation).items()), "name string, type string")
    none = F.array().cast("array<string>")
    found = indexes.select("name", F.coalesce("labels_or_types", none).alias("kinds"), "properties", F.lit(True).alias("found"))
    both = expected.join(found, "name", "full_outer")
    wrong = (F.array_distinct("kinds") != F.array("type")) | F.coalesce(F.col("properties") != F.array(F.lit("graph_id")), F.lit(False))
    fault = (
        F.when(F.col("found").isNull(), "missing").when(F.col("type").isNotNull() & wrong, "misconfigured")
        .when(F.col("type").isNull() & F.arrays_overlap("kinds", F.array(F.lit(label), F.lit(relation))), "unexpected")
    )
    judged = both.select("name", fault.alias("fault"))
    return judged.agg(*(F.sort_array(F.collect_set(F.when(F.col("fault") == f, F.col("name")))).alias(f"{f}_indexes") for f in ("missing", "unexpected", "misconfigured")))


def differing_graphs(nodes: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """graph_id of the namespaces whose rows are others than those that were ``stored``, by the digests of both."""
    want = digests(nodes, "vertices", digest_columns(nodes)).unionByName(digests(edges, "edges", digest_columns(edges)))
    mark = lambda df, name: df.select("table", "graph_id", F.struct("columns", "n", "d1", "d2").alias(name))
    both = mark(want, "w").join(mark(stored, "h"), ["table", "graph_id"], "full_outer")
    return both.where(~F.col("w").eqNullSafe(F.col("h"))).select("graph_id").distinct()


def parity_report(
    nodes: DataFrame, edges: DataFrame, vertices: DataFrame, stored: DataFrame, indexes: DataFrame, label: str, relation: str,
    duplicates: DataFrame | None = None, import_errors: DataFrame | None = None, stored_digests: DataFrame | None = None,
) -> DataFrame:
    """One row for each graph of ``nodes``: counts, everything that differs as sorted arrays, and status (passed or failed).

    ``nodes`` and ``edges``: as they should be stored (vertex_rows, edge_rows);
    ``vertices`` and ``stored``: the store's tables, whole. ``duplicates`` and
    ``import_errors``: graph_id, edge_id. Edges without a graph_id, blank graph_ids
    and indexes concern the whole store and stand in each row. ``stored_digests``: what
    the store kept of its rows as they were written; of graphs with equal digests no
    property is read and nothing is joined.
    """
    graphs = nodes.select("graph_id").distinct()
    types = [df.select("graph_id", c) for df, c in ((vertices, "label"), (stored, "relation_type"))]
    if stored_digests is None:
        # What there is of other graphs is left out as the parts are joined on to the graphs.
        own_v, own_e = vertices, stored
        differences = parity(nodes, edges, own_v, own_e)
    else:
        own_v, own_e = vertices.join(graphs, "graph_id", "left_semi"), stored.join(graphs, "graph_id", "left_semi")
        differ = write_table(differing_graphs(nodes, edges, stored_digests).join(graphs, "graph_id", "left_semi"), "differing-graphs")
        some = not differ.isEmpty()
        only = lambda df: df.join(differ, "graph_id", "left_semi")
        rest = lambda df: df.join(differ, "graph_id", "left_anti") if some else df
        differences = parity(*map(only, (nodes, edges, own_v, own_e)))
        # What is stored of the others is what should be.
        own_v, own_e = ((only(have).unionByName(rest(want), allowMissingColumns=True) if some else want) for have, want in ((own_v, nodes), (own_e, edges)))
        differences = differences if some else differences.limit(0)
    ids = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("id"))))
    pairs = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.concat_ws(":", "id", "property"))))
    out = graphs.join(differences.groupBy("graph_id").agg(
        ids("missing_node").alias("graph_only_nodes"), ids("unexpected_node").alias("store_only_nodes"), ids("missing_edge").alias("graph_only_edges"),
        ids("unexpected_edge").alias("store_only_edges"), F.array_distinct(ids("endpoint_mismatch")).alias("source_target_mismatches"),
        pairs("node_property").alias("node_property_mismatches"), pairs("edge_property").alias("relationship_property_mismatches"),
    ), "graph_id", "left")
    count = lambda df, key, name: df.groupBy("graph_id").agg(F.count_distinct(key).alias(name))
    counted = ((nodes, "entity_id", "graph_node_count"), (own_v, "entity_id", "store_node_count"), (edges, "edge_id", "graph_edge_count"), (own_e, "edge_id", "store_edge_count"))
    for df, key, name in counted:
        out = out.join(count(df, key, name), "graph_id", "left")

    def lacking(df: DataFrame, key: str, wanted: tuple[str, ...], name: str) -> DataFrame:
        lacks = F.array_compact(F.array(*(F.when(F.col(p).isNull(), F.lit(p)) if p in df.columns else F.lit(p) for p in wanted)))
        each = df.select("graph_id", F.col(key).alias("_id"), F.explode(lacks).alias("_p"))
        return each.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", "_id", "_p"))).alias(name))

    kinds = lambda df, col, name: df.groupBy("graph_id").agg(F.sort_array(F.collect_set(col)).alias(name))
    given = lambda df, name: df.groupBy("graph_id").agg(F.sort_array(F.collect_list("edge_id")).alias(name))
    parts = [
        lacking(own_v, "entity_id", NODE_PROPERTIES, "missing_required_node_properties"), lacking(own_e, "edge_id", EDGE_PROPERTIES, "missing_required_relationship_properties"),
        kinds(types[0], "label", "node_labels"), kinds(types[1], "relation_type", "relationship_types"),
        *(given(df, name) for df, name in ((duplicates, "duplicate_edges"), (import_errors, "import_errors")) if df is not None),
    ]
    for part in parts:
        out = out.join(part, "graph_id", "left")
    none = F.array().cast("array<string>")
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    lists = [c for c in MUST_BE_EMPTY if c in out.columns] + ["node_labels", "relationship_types"]
    out = out.withColumns({**{c: F.coalesce(c, none) for c in lists}, **{n: F.coalesce(n, F.lit(0)) for _, _, n in counted}})
    for kind, have, want in (("node_labels", "node_labels", label), ("relationship_types", "relationship_types", relation)):
        out = out.withColumns({f"missing_expected_{kind}": F.array_except(strings([want]), F.col(have)), f"unexpected_{kind}": F.array_except(F.col(have), strings([want]))})
    # A graph without edges has no relationship type to be active.
    out = out.withColumn("missing_expected_relationship_types", F.when(F.col("graph_edge_count") > 0, F.col("missing_expected_relationship_types")).otherwise(none))
    # One row for the whole store, joined on to every graph's.
    stray = edges_without_graph(stored).agg(F.sort_array(F.collect_list("edge_id")).alias("edges_without_graph_id"))
    blank = blank_graphs(vertices, stored).where("graph_id is not null").agg(F.sort_array(F.collect_list("graph_id")).alias("unexpected_graph_ids"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    wide = one(index_differences(indexes, label, relation)).join(one(stray), "_one").join(one(blank), "_one")
    out = one(out).join(wide, "_one").drop("_one")
    for c in MUST_BE_EMPTY:
        if c not in out.columns:
            out = out.withColumn(c, none)
    failed = F.lit(False)
    for c in MUST_BE_EMPTY:
        failed = failed | (F.size(c) > 0)
    return out.select(
        "graph_id", *(n for _, _, n in counted), F.lit(label).alias("expected_node_label"), F.lit(relation).alias("expected_relationship_type"), "node_labels", "relationship_types",
        *MUST_BE_EMPTY, F.when(failed, "failed").otherwise("passed").alias("status"),
    )
