"""Run reports and comparison with a golden contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What a run report says of each graph, in its order.
REPORT = (
    "run_id", "graph_id", "source_words", "units", "primary_successful_calls", "primary_http_attempts", "primary_failed_attempts", "primary_timeout_attempts",
    "automatic_retries", "transport_successes", "transport_failures", "provider_response_rejections", "tool_contract_failures", "schema_failures", "evidence_failures",
    "accepted_extractions", "post_extraction_llm_calls", "prompt_tokens", "completion_tokens", "total_tokens", "embedding_usage", "finish_reasons", "transports",
    "local_entities", "local_relations", "global_entities", "merged_entities", "keep_separate_pairs", "unresolved_merge_candidates", "nodes_before_resolution", "nodes",
    "edges", "connected_components", "isolated_nodes", "store", "validation", "embedding_calls", "remote_model_calls", "candidate_threshold", "merge_threshold",
    "vector_dimension", "unique_pair_count",
)


def source_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return docs.select(F.col(key).alias("g"), words.cast("long").alias("source_words"))


def run_report(
    docs: DataFrame, spans: DataFrame, entities: DataFrame, relations: DataFrame, nodes: DataFrame, edges: DataFrame, components: DataFrame, *,
    headers: DataFrame | None = None, accounts: DataFrame | None = None, resolution: DataFrame | None = None, responses: DataFrame | None = None,
    parity: DataFrame | None = None, validation: DataFrame | None = None, embedding_usage: DataFrame | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """g and the columns of REPORT: one row for each graph; what isn't given is null, or 0 where it is a count.

    ``headers``: g, run_id, graph_id. ``accounts``: totals of the calls by g.
    ``resolution``: a resolution's summary. ``responses``: g, span_no, finish_reason,
    transport (listed in the order of spans). ``parity``: graph_id, store_node_count,
    store_edge_count, node_labels, relationship_types. ``validation``: g, passed.
    ``embedding_usage``: g, prompt_tokens, total_tokens. The lists grow with a graph's
    spans, as in its report file.
    """
    count = lambda df, k, name: df.groupBy(F.col(k).alias("g")).agg(F.count(F.lit(1)).alias(name))
    out = source_words(docs, key, text)
    for df, k, name in ((spans, key, "units"), (entities, "g", "local_entities"), (relations, "g", "local_relations"), (nodes, "g", "nodes"), (edges, "g", "edges")):
        out = out.join(count(df, k, name), "g", "left")
    out = out.join(components.select("g", F.col("components").alias("connected_components"), F.col("isolated").alias("isolated_nodes")), "g", "left")
    parts = []
    if headers is not None:
        parts.append(headers.select("g", "run_id", "graph_id"))
    if accounts is not None:
        parts.append(accounts.drop("units", "schema_valid_extractions", "evidence_valid_extractions", "persisted_span_units", "thinking_responses"))
    if resolution is not None:
        parts.append(resolution.select(
            "g", F.col("merged_pairs").alias("merged_entities"), "keep_separate_pairs", F.col("unresolved_pairs").alias("unresolved_merge_candidates"), "candidate_threshold",
            "merge_threshold", "vector_dimension", F.col("unique_pairs").alias("unique_pair_count")))
    if responses is not None:
        listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("span_no", F.col(c).alias("x")))), lambda r: r["x"]).alias(f"{c}s")
        parts.append(responses.groupBy("g").agg(listed("finish_reason"), listed("transport")))
    if parity is not None:
        store = F.struct("graph_id", F.col("store_node_count").alias("nodes"), F.col("store_edge_count").alias("edges"), F.struct(
            F.element_at("node_labels", 1).alias("entity_label"), F.try_element_at("relationship_types", F.lit(1)).alias("relation_type")).alias("projection"))
        parts.append(parity.select(F.col("graph_id").alias("g"), store.alias("store")))
    if validation is not None:
        parts.append(validation.select("g", F.struct(*(c for c in validation.columns if c != "g")).alias("validation")))
    if embedding_usage is not None:
        parts.append(embedding_usage.select("g", F.struct("prompt_tokens", "total_tokens").alias("embedding_usage")))
    for part in parts:
        out = out.join(part, "g", "left")
    kinds = {"run_id": "string", "graph_id": "string", "embedding_usage": "struct<prompt_tokens:bigint,total_tokens:bigint>", "finish_reasons": "array<string>", "transports": "array<string>",
             "store": "struct<graph_id:string,nodes:bigint,edges:bigint,projection:struct<entity_label:string,relation_type:string>>", "validation": "struct<passed:boolean>",
             "candidate_threshold": "double", "merge_threshold": "double", "vector_dimension": "int", "isolated_nodes": "array<string>"}
    same = {"global_entities": "nodes", "nodes_before_resolution": "local_entities", "remote_model_calls": "primary_http_attempts"}

    def value(name: str):
        of = same.get(name, name)
        if of not in out.columns:
            return F.lit(None).cast(kinds[of]) if of in kinds else F.lit(0).cast("long")
        return F.col(of) if of in kinds else F.coalesce(F.col(of), F.lit(0)).cast("long")

    return out.select("g", *(value(n).alias(n) for n in REPORT))


def family_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_family").agg(F.count(F.lit(1)).alias("edges"))


def compare_golden(nodes: DataFrame, edges: DataFrame, required: DataFrame, forbidden: DataFrame, merged: DataFrame, separate: DataFrame, entities: DataFrame | None = None, qualifiers: DataFrame | None = None) -> DataFrame:
    """(check, detail) of what a golden contract asks for and the graph doesn't have.

    ``required`` and ``forbidden``: source, raw_relation, target and optionally negated
    (null: not negated for what is required, either for what is forbidden), by canonical
    names; ``merged`` and ``separate``: a, b: two names that must, or must not, be one
    entity; ``entities``: name; ``qualifiers``: source, raw_relation, field, value: what
    the first edge of that source and relation must say.
    """
    names = nodes.select("g", "entity_id", F.explode(F.array_union(F.array("canonical_name"), F.col("aliases"))).alias("name")).distinct()
    of = lambda e: nodes.select("g", F.col("entity_id").alias(f"{e}_entity_id"), F.col("canonical_name").alias(e))
    whole = edges.join(of("source"), ["g", "source_entity_id"]).join(of("target"), ["g", "target_entity_id"])
    there = whole.select("source", "raw_relation", "target", F.col("qualifiers.negated").alias("negated")).distinct()
    signed = lambda df, default: df if "negated" in df.columns else df.withColumn("negated", F.lit(default).cast("boolean"))
    three, line = ["source", "raw_relation", "target"], lambda cols: F.concat_ws(" ", *cols).alias("detail")
    want = signed(required, False).withColumn("negated", F.coalesce("negated", F.lit(False)))
    never, facts = signed(forbidden, None), there.withColumnRenamed("negated", "_n")
    shared = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in three]
    found = never.alias("x").join(facts.alias("y"), [*shared, F.col("x.negated").isNull() | (F.col("x.negated") == F.col("y._n"))], "left_semi")
    same = lambda df: df.join(names.withColumnRenamed("name", "a"), "a").join(names.select("g", "entity_id", F.col("name").alias("b")), ["g", "entity_id", "b"], "left_semi").select("a", "b").distinct()
    out = (
        want.join(there, [*three, "negated"], "left_anti").select(F.lit("required_relation").alias("check"), line(three))
        .unionByName(found.select(F.lit("forbidden_relation").alias("check"), line(three)))
        .unionByName(merged.join(same(merged), ["a", "b"], "left_anti").select(F.lit("required_merge").alias("check"), line(["a", "b"])))
        .unionByName(same(separate).select(F.lit("required_separation").alias("check"), line(["a", "b"])))
    )
    if entities is not None:
        lost = entities.join(names.select("name").distinct(), "name", "left_anti")
        out = out.unionByName(lost.select(F.lit("required_entity").alias("check"), F.col("name").alias("detail")))
    if qualifiers is not None:
        q = F.col("qualifiers")
        said = F.create_map(*(x for f in ("temporality", "condition", "modality", "quantity", "version") for x in (F.lit(f), q[f])), F.lit("negated"), q["negated"].cast("string"))
        first = whole.groupBy("source", "raw_relation").agg(F.min_by(said, F.struct("g", "ordinal")).alias("_said"))
        cases = qualifiers.join(first, ["source", "raw_relation"], "left")
        bad = cases.where(F.col("_said").isNull() | ~F.try_element_at("_said", "field").eqNullSafe(F.col("value")))
        out = out.unionByName(bad.select(F.lit("required_qualifier").alias("check"), line(["source", "raw_relation", "field"])))
    return out


def contract_differences(totals: DataFrame, parity: DataFrame, expected: dict[str, int], units: DataFrame, label: str, relation: str) -> DataFrame:
    """(check, detail) where accounts or the projection of a graph are not what a golden contract says.

    ``totals``: g and counters; ``expected``: counters by name, ``unit_count`` among
    them; ``parity``: the parity report, which must have passed under these types.
    """
    counted = totals.join(units.groupBy("g").agg(F.count(F.lit(1)).alias("unit_count")), "g", "left")
    bad = [F.when(~F.col(k).eqNullSafe(F.lit(v)), F.concat(F.lit(f"{k}: expected {v}, got "), F.coalesce(F.col(k).cast("string"), F.lit("nothing")))) for k, v in expected.items()]
    calls = counted.select(F.lit("call_budget").alias("check"), F.explode(F.array_compact(F.array(*bad))).alias("detail")) if bad else None
    wrong = F.array_compact(F.array(
        F.when(F.col("status") != "passed", F.lit("parity")), F.when(~F.array_contains("node_labels", label), F.lit("node label")),
        F.when(~F.array_contains("relationship_types", relation), F.lit("relationship type")), F.when(F.size("missing_indexes") > 0, F.lit("index")),
    ))
    stored = parity.select(F.lit("projection").alias("check"), F.explode(wrong).alias("detail"))
    return stored if calls is None else calls.unionByName(stored)


def assertion_counts(failed: DataFrame, required: int, forbidden: int) -> DataFrame:
    """One row: how many of a contract's required (relations and qualifier cases) and forbidden assertions hold."""
    lost = lambda *kinds: F.count_if(F.col("check").isin(*kinds))
    out = failed.agg(lost("required_relation", "required_qualifier").alias("r"), lost("forbidden_relation").alias("f"), F.count(F.lit(1)).alias("n"))
    good, kept = F.lit(required) - F.col("r"), F.lit(forbidden) - F.col("f")
    return out.select(
        good.alias("required_assertions_passed"), F.lit(required).alias("required_assertions_total"), kept.alias("forbidden_assertions_passed"),
        F.lit(forbidden).alias("forbidden_assertions_total"), (good + kept).alias("passed"), F.lit(required + forbidden).alias("total"), (F.col("n") == 0).alias("semantic_assertions_passed"),
    )


def observed_metrics(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, units: DataFrame, totals: DataFrame, parity: DataFrame) -> DataFrame:
    """g, graph_hash, nodes, edges, unit_count, the accounts, projection_parity_status and relation_family_distribution (map).

    ``graphs``: g, graph_hash; ``parity``: g, status.
    """
    count = lambda df, name: df.groupBy("g").agg(F.count(F.lit(1)).alias(name))
    families = edges.groupBy("g", "relation_family").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation_family", "n")))).alias("relation_family_distribution"))
    out = graphs.join(count(nodes, "nodes"), "g", "left").join(count(edges, "edges"), "g", "left").join(count(units, "unit_count"), "g", "left")
    kept = [c for c in totals.columns if c not in ("g", "units", "primary_failed_attempts", "primary_timeout_attempts", "thinking_responses", "prompt_tokens", "completion_tokens",
                                                   "total_tokens", "schema_valid_extractions", "evidence_valid_extractions", "persisted_span_units")]
    out = out.join(totals.select("g", *kept), "g", "left").join(parity.select("g", F.col("status").alias("projection_parity_status")), "g", "left").join(families, "g", "left")
    return out.fillna(0, ["nodes", "edges", "unit_count"])
