"""A run: documents to stored graphs, every gate on the way, and what is left behind to check it by."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Settings, resolved
from loomgraph.functions.ids import check_run_id, identity_columns, new_run_id, sha256_json, vector_hash
from loomgraph.functions.text import document_spans, source_identity
from loomgraph.operators import accounting, audit, extract, final_graph, graph, parity, project, report, resolve
from loomgraph.operators.store import GraphSink
from loomgraph.prompts import Bundle, resolve_prompt
from loomgraph.sources import clients, runs, viewer
from loomgraph.sources.shared import write_table

#: The rules by which a run can end before anything is stored.
EXTRACTION_FAILED, EVIDENCE_FAILED, CONTRACT_FAILED = "span_flat_extraction", "extraction_evidence", "final_graph_contract"

#: Spans (doc_id, unit_no, span_no, span_id, unit_id, text) to the same with request, http_status and body.
Extractor = Callable[[DataFrame], DataFrame]
#: Entities (g, ord, local_id, name, type, ...) to their vectors and what the calls came to.
Embedder = Callable[[DataFrame], clients.Embeddings]


class RunFailed(RuntimeError):
    """A run ended at a gate; ``category`` names it."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def rule_responses(spans: DataFrame) -> DataFrame:
    """The built-in rules as an extractor: each span answered by a well-formed response."""
    call = F.array(F.struct(F.struct(F.lit(extract.TOOL).alias("name"), F.col("arguments")).alias("function")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(call.alias("tool_calls")).alias("message"))).alias("choices")))
    return extract.rule_extract(spans).withColumns({"request": F.lit(None).cast("string"), "http_status": F.lit(200), "body": body}).drop("arguments")


def replayed_responses(recorded: DataFrame) -> Extractor:
    """An extractor that answers from ``recorded``: unit_id and arguments (JSON), and doc_id where there are several documents; a unit without a record times out."""
    keys = [c for c in ("doc_id", "unit_id") if c in recorded.columns]
    call = F.array(F.struct(F.struct(F.lit(extract.TOOL).alias("name"), F.col("arguments")).alias("function")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("tool_calls").alias("finish_reason"), F.struct(call.alias("tool_calls")).alias("message"))).alias("choices")))

    def answer(spans: DataFrame) -> DataFrame:
        found = extract.replay(spans, recorded, keys)
        there = F.col("arguments").isNotNull()
        return found.withColumns({"request": F.lit(None).cast("string"), "http_status": F.when(there, 200), "body": F.when(there, body)}).drop("arguments")

    return answer


def remote_responses(settings: Settings, bundle: Bundle, post: clients.Post | None = None) -> Extractor:
    return lambda spans: clients.request_extractions(spans, settings.runtime.provider, bundle, settings.extraction.max_concurrency, post)


def remote_vectors(settings: Settings, post: clients.Post | None = None) -> Embedder:
    return lambda entities: clients.request_embeddings(entities, settings.embedding, post, settings.extraction.max_concurrency)


@dataclass
class Prepared:
    """A run's documents, one for each different text, with the identities of their graphs."""

    docs: DataFrame
    headers: DataFrame
    sources: DataFrame


def prepare(docs: DataFrame, run_id: str, bundle: Bundle, settings: Settings, root: str | None = None) -> Prepared:
    """``docs``: doc_id, text, source and optionally path. Documents of one text are one source; the one with the smallest doc_id stands for them."""
    schema = clients.tool_schema(settings.extraction.max_entities, settings.extraction.max_relations, settings.runtime.provider.strict)
    identity = source_identity(docs, path="path" if "path" in docs.columns else None, root=root)
    body = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n").alias("text"))
    first = identity.groupBy("source_sha256").agg(F.min_by(F.struct(*identity.columns), "doc_id").alias("s")).select("s.*")
    fields = {
        "contract_id": F.lit(settings.extraction.contract_id), "prompt_hash": F.lit(bundle.content_hash), "provider_profile_id": F.lit(settings.runtime.profile),
        "run_id": F.lit(run_id), "schema_hash": F.lit(sha256_json(schema)), "source_sha256": F.col("source_sha256"),
    }
    digest, gid = identity_columns(fields)
    named = write_table(first.withColumns({"manifest_identity_hash": digest, "g": gid}), "sources")
    headers = named.select("g", F.col("g").alias("graph_id"), "manifest_identity_hash", F.lit(bundle.content_hash).alias("prompt_hash"), F.lit(bundle.prompt_id).alias("prompt_id"), F.lit(run_id).alias("run_id"))
    return Prepared(write_table(body.join(named.select("doc_id", "g"), "doc_id").select(F.col("g").alias("doc_id"), "text"), "texts"), headers, named.select("g", *final_graph.SOURCE))


def _fail(folder: runs.RunFolder, category: str, message: str, rows: list) -> None:
    folder.json("terminal_failure", {"status": "terminal_validation_failure", "rule_category": category, "error": message, "examples": [r.asDict(True) for r in rows]})
    raise RunFailed(category, message)


def run(
    spark: SparkSession, docs: DataFrame, output: str, sink: GraphSink, settings: Settings, run_id: str | None = None,
    extractor: Extractor = rule_responses, embedder: Embedder | None = None, root: str | None = None,
) -> DataFrame:
    """Build, check, store and report the graphs of ``docs``; returns the run reports.

    Nothing is stored unless every span's response passes all gates, evidence is known,
    and all graphs keep their contract: the run then ends with terminal_failure.json
    and RunFailed. Without an ``embedder`` names are resolved by equality. Artifacts are
    tables in ``output``/run_id, a row for each graph, span or call; single small
    ones are files. Between the steps tables are written once and read by all that follow.
    """
    run_id = check_run_id(run_id or new_run_id())
    bundle, provider = resolve_prompt(settings.extraction.prompt_id), settings.runtime.provider
    schema = clients.tool_schema(settings.extraction.max_entities, settings.extraction.max_relations, provider.strict)
    identity = clients.request_identity(provider, settings.runtime.profile, bundle, schema)
    folder = runs.RunFolder(spark, f"{output.rstrip('/')}/{run_id}", new=True)
    folder.json("resolved_run_config", resolved(settings))
    folder.json("prompt_manifest", {"prompt_id": bundle.prompt_id, "prompt_hash": bundle.content_hash, "contract_id": settings.extraction.contract_id, "request_identity": identity})
    ready = prepare(docs, run_id, bundle, settings, root)
    folder.table("run_manifest", ready.headers.join(ready.sources, "g").drop("g"))
    folder.table("source", ready.docs.select(F.col("doc_id").alias("graph_id"), "text"))

    spans = write_table(document_spans(ready.docs), "spans")
    folder.table("spans", spans)
    answered = audit.discard_reasoning(write_table(extractor(spans), "answers"))
    folder.table("requests", answered.select("doc_id", "unit_id", "request"))
    responses = folder.table("responses", answered.select("doc_id", "unit_id", "span_no", "http_status", "body", "reasoning_present", "reasoning_tokens"))
    # Reasoning is judged where it was, though it isn't kept.
    gated = extract.gate_responses(answered.withColumnRenamed("reasoning_present", "_had"), allow_reasoning=provider.reasoning_policy != "require_empty")
    forbidden = F.lit(provider.reasoning_policy == "require_empty") & F.col("_had") & (F.col("terminal_outcome") != extract.OUTCOMES[1])
    gated = write_table(gated.withColumns({
        "reasoning_present": F.col("_had"), "terminal_outcome": F.when(forbidden, extract.OUTCOMES[2]).otherwise(F.col("terminal_outcome")),
        "terminal_subcategory": F.when(forbidden, "reasoning_policy_violation").otherwise(F.col("terminal_subcategory")),
    }).drop("_had", "request"), "gated")
    folder.table("parsed_tool_arguments", gated.select("doc_id", "unit_id", "arguments"))
    folder.table("model_call_attempts", accounting.unit_accounts(gated))
    bad = gated.where(F.col("terminal_outcome") != "accepted").select("doc_id", "unit_id", "terminal_outcome", "terminal_subcategory").limit(20).collect()
    if bad:
        _fail(folder, EXTRACTION_FAILED, f"extraction failed for {gated.where(F.col('terminal_outcome') != 'accepted').count()} spans", bad)

    folder.table("span_extraction_results", gated.select("doc_id", "unit_id", "span_id", "extraction"))
    local = write_table(extract.local_entities(gated), "local-entities")
    relations = write_table(extract.local_relations(gated), "local-relations")
    folder.table("local_entities", local)
    folder.table("local_relations", relations)
    bad = local.select("doc_id", "span_id").unionByName(relations.select("doc_id", "span_id")).join(spans.select("doc_id", "span_id"), ["doc_id", "span_id"], "left_anti").limit(20).collect()
    if bad:
        _fail(folder, EVIDENCE_FAILED, "extraction names unknown spans", bad)

    entities = local.select(F.col("doc_id").alias("g"), F.col("ordinal").alias("ord"), "local_id", "name", "type", "span_id", F.col("unit_id").alias("unit"))
    summary, calls, usage = None, None, None
    if embedder is None:
        named = write_table(resolve.resolve_by_name(entities), "entities")
    else:
        folder.table("entity_embedding_inputs", entities)
        embedded = embedder(entities)
        usage = folder.table("embedding_response_metadata", embedded.metadata)
        vectors = write_table(entities.join(embedded.vectors, ["g", "ord"]), "vectors")
        folder.table("embedding_vectors", vectors.select("g", "local_id", F.size("vector").alias("dimension"), vector_hash(F.col("vector")).alias("vector_sha256")))
        ends = relations.select(F.col("doc_id").alias("g"), F.concat_ws(":", "unit_id", F.format_string("R%03d", "ordinal")).alias("relation_id"), "raw_relation", F.col("relation_family").alias("family"),
                                F.array("span_id").alias("spans"), "source_local_id", "target_local_id")
        for end, name in (("source", "l"), ("target", "r")):
            ends = ends.join(entities.select("g", F.col("local_id").alias(f"{end}_local_id"), F.col("ord").alias(name)), ["g", f"{end}_local_id"])
        found = resolve.resolve_entities(entities, vectors.select("g", "ord", "vector"), ends.drop("source_local_id", "target_local_id"), settings.thresholds.candidate,
                                         settings.thresholds.merge, settings.decisions, settings.retrieval.pairwise_limit, settings.retrieval.top_k)
        folder.table("entity_similarity", found.decisions)
        # Of graphs whose every pair counts, the whole matrix, block by block.
        small = vectors.join(entities.groupBy("g").count().where(F.col("count") <= settings.retrieval.pairwise_limit).select("g"), "g", "left_semi")
        folder.table("entity_similarity_matrix", resolve.similarity_matrix(small.select("g", "ord", "local_id", "vector")))
        folder.table("entity_similarity_candidates", found.candidates)
        summary = folder.table("entity_resolution_summary", found.summary)
        named = write_table(found.entities.select(*entities.columns, "entity_id"), "entities")
        calls = usage.select(F.col("g").alias("doc_id"), "calls")
    folder.table("entity_resolution", named.select("g", "local_id", "entity_id"))
    nodes = folder.table("global_entities", graph.consolidate_nodes(named))

    every = graph.project_edges(relations.withColumnRenamed("doc_id", "g"), named)
    edges, again = graph.dedup_edges(write_table(final_graph.with_provenance(every, bundle.prompt_id), "edges"))
    units = spans.select(F.col("doc_id").alias("g"), "unit_id", F.array("span_id").alias("span_ids"))
    bad = final_graph.contract_violations(ready.headers, ready.sources, nodes, edges, units).limit(20).collect()
    if bad:
        _fail(folder, CONTRACT_FAILED, "the graphs break their contract", bad)
    graphs = write_table(final_graph.nested_graphs(ready.headers, ready.sources, nodes, edges, units), "graphs")
    folder.texts("fact_graph", graphs.select(final_graph.graph_json(F.col("graph")).alias("value")))

    accounts = folder.table("model_call_budget", accounting.unit_accounts(gated, embedding_calls=calls))
    bad = accounting.account_violations(accounts).limit(20).collect()
    if bad:
        raise RunFailed("call_accounting", f"the accounts of {bad[0]['unit_id']} don't add up: {bad[0]['rule']}")
    totals = folder.table("model_call_totals", accounting.totals(accounts).withColumnRenamed("doc_id", "g"))
    label, relation = settings.store.entity_label, settings.store.relation_type
    folder.table("projection_manifest", ready.headers.select(F.lit(runs.MANIFEST_VERSION).alias("manifest_version"), "graph_id", F.lit(label).alias("entity_label"), F.lit(relation).alias("relation_type")))
    diff = folder.table("edge_diff", store_graphs(sink, ready.headers, ready.sources, nodes, edges, label, relation, again))

    finish = responses.select(F.col("doc_id").alias("g"), "span_no", F.get_json_object("body", "$.choices[0].finish_reason").alias("finish_reason"), F.lit(provider.transport).alias("transport"))
    failed = diff.where("status <> 'passed'").select("graph_id")
    valid = folder.table("validation_report", audit.validation_report(responses.select("doc_id", "body"), relations, spans, failed, accounts))
    components = graph.graph_components(nodes, edges)
    reports = folder.table("run_report", report.run_report(
        ready.docs, spans, named, relations.withColumnRenamed("doc_id", "g"), nodes, edges, components, headers=ready.headers, accounts=totals, resolution=summary,
        responses=finish, parity=diff, validation=valid, embedding_usage=usage))
    if valid.where("not passed").limit(1).collect():
        raise RunFailed("validation", "validation failed after the graphs were stored")
    folder.table("completion_status", audit.completion_status(valid))
    now = datetime.datetime.now(datetime.UTC).isoformat()
    folder.table("graph_view", graph_views(reports, settings, now))
    return reports


def store_graphs(sink: GraphSink, headers: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, label: str, relation: str, duplicates: DataFrame | None = None) -> DataFrame:
    """Replace the graphs' namespaces in a store and say what then differs: the parity report. Graphs with an edge to nowhere are not imported."""
    whose = headers.select("g", "run_id", "manifest_identity_hash").join(sources.select("g", "source_sha256"), "g")
    vertices = project.vertex_rows(nodes.join(whose, "g"))
    rows = project.edge_rows(edges.join(whose, "g"))
    lost = project.import_errors(vertices, rows).select("graph_id", "edge_id").distinct()
    sink.ensure_indexes()
    if not lost.limit(1).collect():
        sink.replace(vertices, rows)
    again = None if duplicates is None else duplicates.select(F.col("g").alias("graph_id"), "edge_id")
    return parity.parity_report(vertices, rows, sink.read("vertices"), sink.read("edges"), sink.indexes(), label, relation, again, lost, sink.digests() if hasattr(sink, "digests") else None)


def graph_views(reports: DataFrame, settings: Settings, completed: str) -> DataFrame:
    """(run_id, graph_id, statement, browser_url, database, node_count, relationship_count, entity_label, relation_type, completed_at_utc); no url where no browser is configured."""
    s = settings.store
    statement = viewer.path_statements(F.col("graph_id"), s.limit, s.entity_label, s.relation_type)
    url = viewer.browser_links(s.browser, s.uri, s.database, statement) if s.browser and s.uri else F.lit(None).cast("string")
    return reports.select("run_id", "graph_id", statement.alias("statement"), url.alias("browser_url"), F.lit(s.database).alias("database"), F.col("nodes").alias("node_count"),
                          F.col("edges").alias("relationship_count"), F.lit(s.entity_label).alias("entity_label"), F.lit(s.relation_type).alias("relation_type"), F.lit(completed).alias("completed_at_utc"))


def read_run(spark: SparkSession, outputs: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a run's graphs (headers, sources, nodes, edges, units), from its authoritative graphs alone."""
    folder = runs.RunFolder(spark, f"{outputs.rstrip('/')}/{check_run_id(run_id)}")
    if not folder.has("fact_graph"):
        raise LookupError(f"run {run_id} has no graphs")
    tables = final_graph.tables_of(write_table(final_graph.read_graphs(spark.read.text(f"{folder.path}/fact_graph")), "graphs"))
    bad = final_graph.contract_violations(**tables).limit(1).collect()
    if bad:
        raise RunFailed(CONTRACT_FAILED, f"graph {bad[0]['g']}: {bad[0]['rule']} {bad[0]['id']}")
    return tables


def rebuild(spark: SparkSession, outputs: str, run_id: str, sink: GraphSink, settings: Settings) -> DataFrame:
    """Store a run's graphs once more from their files and return the parity report; the types must be those they were stored under."""
    label, relation = settings.store.entity_label, settings.store.relation_type
    tables = read_run(spark, outputs, run_id)
    runs.require_projection(spark.read.schema(runs._MANIFEST).json(f"{outputs.rstrip('/')}/{run_id}/projection_manifest"), label, relation)
    return store_graphs(sink, tables["headers"], tables["sources"], tables["nodes"], tables["edges"], label, relation)


def check_run(spark: SparkSession, outputs: str, run_id: str) -> DataFrame:
    """(g, error): what a run's artifacts say against each other; a missing one is an error without a graph."""
    path = f"{outputs.rstrip('/')}/{check_run_id(run_id)}"
    folder = runs.RunFolder(spark, path)
    needed = ("fact_graph", "projection_manifest", "model_call_totals", "edge_diff", "validation_report", "run_report", "prompt_manifest.json", "completion_status")
    lost = [n for n in needed if not folder.has(n)]
    if lost:
        return spark.createDataFrame([(None, f"missing artifact: {n}") for n in lost], "g string, error string")
    tables = final_graph.tables_of(write_table(final_graph.read_graphs(spark.read.text(f"{path}/fact_graph")), "graphs"))
    broken = final_graph.contract_violations(**tables).select("g", F.col("rule").alias("error")).distinct()
    read = lambda name: spark.read.json(f"{path}/{name}")
    checks = audit.conformance(
        tables["nodes"], tables["edges"], tables["units"], read("model_call_totals").select("g", "accepted_extractions", "post_extraction_llm_calls"), read("validation_report"),
        read("completion_status"), tables["headers"], runs.read_json(spark, f"{path}/prompt_manifest.json"), read("edge_diff").select(F.col("graph_id").alias("g"), "status"))
    return checks.unionByName(broken).distinct()
