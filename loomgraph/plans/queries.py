"""Registered queries of the evidence-graph engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import identity_columns
from loomgraph.functions.text import document_spans, source_identity, source_policy_violations, split_units
from loomgraph.operators import accounting, extract, graph, project, report, resolve
from loomgraph.operators.components import connected_components
from loomgraph.plans.build import build_graphs
from loomgraph.sources.shared import write_table

CANDIDATE, MERGE, TOP_K = 0.30, 0.40, 10
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graphs(spark, sf_dir, texts: bool = False):
    return build_graphs(_table(spark, sf_dir, "documents"), texts=texts)


_SPANS = r"""
docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
tiles AS (
  SELECT doc_id, unnest(parts) AS tile, generate_subscripts(parts, 1) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([!?])', '\1' || chr(1), 'g'), '\.(\s|$)', '.' || chr(1) || '\1', 'g'), chr(1)) AS parts FROM docs)
),
placed AS (
  SELECT doc_id, pos, regexp_replace(tile, '^\s+|\s+$', '', 'g') AS text,
         sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY pos) - length(regexp_replace(tile, '^\s+', '')) AS start_
  FROM tiles
),
spans AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS span_no, text, start_ FROM placed WHERE text <> ''
),
named AS (SELECT *, 'S' || CASE WHEN span_no < 1000 THEN lpad(span_no::VARCHAR, 3, '0') ELSE span_no::VARCHAR END AS span_id FROM spans),
words AS (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM named),
facts AS (SELECT *, len(w) AS n FROM words WHERE len(w) >= 3),
mentions AS (
  SELECT doc_id, span_no, span_id, i, CASE i WHEN 0 THEN w[1] ELSE w[-1] END AS name,
         row_number() OVER (PARTITION BY doc_id ORDER BY span_no, i) AS ord
  FROM facts, (VALUES (0), (1)) AS x(i)
),
firsts AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, replace(lower(name), 'ß', 'ss')) AS first_ FROM mentions),
resolved AS (
  SELECT *, 'E' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS entity_id FROM (
    SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first_) AS k FROM firsts)
),
nodes AS (
  SELECT doc_id, entity_id, arg_min(name, ord) AS canonical_name, count(*) AS members,
         array_to_string(list_sort(list_distinct(list(name) FILTER (ord > first_))), '|') AS aliases,
         array_to_string(list_sort(list_distinct(list(span_id))), '|') AS span_ids
  FROM resolved GROUP BY doc_id, entity_id
),
families AS (SELECT ['COMPOSITION', 'DATA_FLOW', 'PROCESSING_SEQUENCE', 'DEPENDENCY', 'VALIDATION_QUALITY', 'RESPONSIBILITY_OWNERSHIP',
                     'LIFECYCLE_VERSION', 'CONDITION_REQUIREMENT', 'CAUSAL_RESULT', 'ASSERTION_CONTEXT'] AS f),
edges AS (
  SELECT f.doc_id, f.span_no, f.span_id, a.entity_id AS s, b.entity_id AS t, array_to_string(w[2:1 + greatest(1, least(2, n - 2))], ' ') AS raw,
         families.f[n % 10 + 1] AS family, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.span_no) AS ordinal
  FROM facts f CROSS JOIN families
  JOIN resolved a ON a.doc_id = f.doc_id AND a.span_no = f.span_no AND a.i = 0
  JOIN resolved b ON b.doc_id = f.doc_id AND b.span_no = f.span_no AND b.i = 1
),
ided AS (
  SELECT *, 'R_' || substr(sha256('["' || s || '","' || raw || '","' || t || '",["' || span_id || '"],"{\"condition\": null, \"modality\": \"ASSERTED\", \"negated\": false, \"quantity\": null, \"temporality\": null, \"version\": null}","forward",false,"ASSERTED"]'), 1, 16) AS edge_id
  FROM edges
),
paths AS (
  SELECT e.doc_id AS graph_id, e.edge_id, a.canonical_name AS source, e.raw AS relation, b.canonical_name AS target
  FROM ided e JOIN nodes a ON a.doc_id = e.doc_id AND a.entity_id = e.s JOIN nodes b ON b.doc_id = e.doc_id AND b.entity_id = e.t
)
"""


def _sql(select: str, ctes: str = _SPANS) -> str:
    return f"WITH {ctes.strip()}\n{select}"


@_register("a2_source_identity", """
SELECT doc_id, source AS source_name, sha256(t) AS source_sha256, octet_length(encode(t))::BIGINT AS source_size_bytes,
  CASE WHEN doc_id % 3 = 0 THEN 'repository_relative' ELSE 'external' END AS source_location_policy,
  CASE WHEN doc_id % 3 = 0 THEN 'docs/' || doc_id || '.txt' END AS repository_relative_path
FROM (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents)""")
def a2(spark, sf_dir):
    place = F.concat(F.when(F.col("doc_id") % 3 == 0, "/repo/docs/").otherwise("/elsewhere/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return source_identity(_table(spark, sf_dir, "documents").withColumn("path", place), path="path", root="/repo")


@_register("l4_source_policy", """
SELECT doc_id, ['relative_without_path', 'external_with_path', 'source_hash', 'unknown_policy'][doc_id % 5] AS rule FROM documents WHERE doc_id % 5 > 0""")
def l4(spark, sf_dir):
    k, sources = F.col("doc_id") % 5, source_identity(_table(spark, sf_dir, "documents"))
    return source_policy_violations(sources.withColumns({
        "source_location_policy": F.when(k == 1, "repository_relative").when(k == 4, "somewhere").otherwise("external"), "repository_relative_path": F.when(k == 2, "/x"),
        "source_sha256": F.when(k == 3, F.upper(F.concat(F.lit("x"), "source_sha256"))).otherwise(F.col("source_sha256")), "source_name": F.lit("a.txt"),
    }))


@_register("i11_graph_identity", """
SELECT doc_id, h AS manifest_identity_hash, 'fact_extraction_run-' || doc_id || '_' || substr(h, 1, 12) AS graph_id FROM (
  SELECT doc_id, sha256('{"contract_id":"c","prompt_hash":"p","provider_profile_id":"default","run_id":"run-' || doc_id || '","schema_hash":"s","source_sha256":"' || sha256(coalesce(text, '')) || '"}') AS h FROM documents)""")
def i11(spark, sf_dir):
    fields = {"contract_id": F.lit("c"), "prompt_hash": F.lit("p"), "provider_profile_id": F.lit("default"), "schema_hash": F.lit("s"),
              "run_id": F.concat(F.lit("run-"), F.col("doc_id").cast("string")), "source_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    digest, gid = identity_columns(fields)
    return _table(spark, sf_dir, "documents").select("doc_id", digest.alias("manifest_identity_hash"), gid.alias("graph_id"))


@_register("c2_paragraph_units", r"""
WITH joined AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
tiles AS (
  SELECT conv_id, unnest(parts) AS tile, generate_subscripts(parts, 1) AS pos
  FROM (SELECT conv_id, string_split(regexp_replace(t, '(\n\s*\n\s*)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM joined)
),
placed AS (
  SELECT conv_id, pos, regexp_replace(tile, '^\s+|\s+$', '', 'g') AS text,
         sum(length(tile)) OVER (PARTITION BY conv_id ORDER BY pos) - length(regexp_replace(tile, '^\s+', '')) AS start_offset
  FROM tiles
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos)::BIGINT AS unit_no, text, start_offset::BIGINT AS start_offset,
       (start_offset + length(text))::BIGINT AS end_offset
FROM placed WHERE text <> ''""")
def c2(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    joined = turns.select("conv_id", F.array_join(F.transform("x", lambda t: t["t"]), "\n\n").alias("text"))
    out = split_units(joined, "conv_id")
    return out.select("conv_id", F.col("unit_no").cast("long").alias("unit_no"), "text", F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))


@_register("c3_sentence_spans", _sql("""
SELECT doc_id, span_no::BIGINT AS span_no, span_id, 'U001_' || span_id AS unit_id, text, start_::BIGINT AS document_start, (start_ + length(text))::BIGINT AS document_end
FROM named"""))
def c3(spark, sf_dir):
    out = document_spans(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("span_no").cast("long").alias("span_no"), "span_id", "unit_id", "text",
                      F.col("document_start").cast("long").alias("document_start"), F.col("document_end").cast("long").alias("document_end"))


def _responses(spans: DataFrame) -> DataFrame:
    """A response for each span, with one kind of failure for each remainder of its number by 9."""
    k = F.pmod("span_no", F.lit(9))
    spans = extract.rule_extract(spans)
    empty = '{"status":"facts_present","entities":[],"relations":[],"temporal_bindings":[],"no_graph_fact_reason":null}'
    arguments = F.when(k == 7, '{"status":').when(k == 8, empty).otherwise(F.col("arguments"))
    call = F.array(F.struct(F.struct(F.when(k == 6, "other").otherwise(extract.TOOL).alias("name"), arguments.alias("arguments")).alias("function")))
    message = F.struct(F.when(k == 5, "because").alias("reasoning"), call.alias("tool_calls"))
    usage = F.struct(F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"), F.lit(15).alias("total_tokens"))
    body = F.to_json(F.struct(F.array(F.struct(F.when(k == 4, "length").otherwise("tool_calls").alias("finish_reason"), message.alias("message"))).alias("choices"), usage.alias("usage")))
    return spans.withColumns({
        "http_status": F.when(k == 1, F.lit(None).cast("int")).when(k == 2, 500).otherwise(200),
        "body": F.when(k.isin(1, 2), F.lit(None).cast("string")).when(k == 3, '{"usage":{"prompt_tokens":10,"completion_tokens":5,"total_tokens":15}}').otherwise(body),
    }).drop("arguments")


@_register("c10_response_gate", _sql("""
SELECT doc_id, span_id, ['accepted', 'timeout', 'http_error', 'missing_choices', 'invalid_finish_reason', 'reasoning_policy_violation', 'wrong_tool_name',
       'malformed_arguments', 'pydantic_validation_failed'][span_no % 9 + 1] AS terminal_subcategory,
       ['accepted', 'transport_failed', 'transport_failed', 'provider_response_rejected', 'provider_response_rejected', 'provider_response_rejected',
        'tool_contract_failed', 'tool_contract_failed', 'schema_failed'][span_no % 9 + 1] AS terminal_outcome
FROM named"""))
def c10(spark, sf_dir):
    return extract.gate_responses(_responses(document_spans(_table(spark, sf_dir, "documents")))).select("doc_id", "span_id", "terminal_subcategory", "terminal_outcome")


def _accounts(spark, sf_dir) -> DataFrame:
    """The accounts of those responses, and one embedding call for each document."""
    docs = _table(spark, sf_dir, "documents")
    gated = extract.gate_responses(_responses(document_spans(docs)))
    return accounting.unit_accounts(gated, embedding_calls=docs.select("doc_id", F.lit(1).alias("calls")).distinct())


_K = "SELECT doc_id, unit_id, k, min(k = 0) OVER (PARTITION BY doc_id) AS whole FROM (SELECT doc_id, 'U001_' || span_id AS unit_id, span_no % 9 AS k FROM named)"


@_register("e5_call_budget", _sql(f"""
SELECT doc_id, count(*)::BIGINT AS units, N(k = 0) AS primary_successful_calls, count(*)::BIGINT AS primary_http_attempts, N(k IN (1, 2)) AS primary_failed_attempts,
  N(k = 1) AS primary_timeout_attempts, N(k NOT IN (1, 2)) AS transport_successes, N(k IN (1, 2)) AS transport_failures, N(k IN (3, 4, 5)) AS provider_response_rejections,
  N(k IN (6, 7)) AS tool_contract_failures, N(k = 8) AS schema_failures, 0::BIGINT AS evidence_failures, N(k = 0) AS accepted_extractions, 0::BIGINT AS automatic_retries,
  0::BIGINT AS post_extraction_llm_calls, 1::BIGINT AS embedding_calls, 10 * N(k NOT IN (1, 2)) AS prompt_tokens, 5 * N(k NOT IN (1, 2)) AS completion_tokens,
  15 * N(k NOT IN (1, 2)) AS total_tokens, N(k = 5) AS thinking_responses, N(k = 0) AS schema_valid_extractions, N(k = 0) AS evidence_valid_extractions, N(whole) AS persisted_span_units
FROM ({_K}) GROUP BY doc_id""".replace("N(", "count(*) FILTER (")))
def e5(spark, sf_dir):
    return accounting.totals(_accounts(spark, sf_dir))


@_register("l5_account_violations", _sql(f"""
SELECT doc_id, unit_id, unnest(CASE WHEN k = 0 THEN [] ELSE ['one successful call', 'one accepted extraction', 'one valid schema', 'one valid evidence'] END || CASE WHEN whole THEN [] ELSE ['one unit kept'] END) AS rule
FROM ({_K})"""))
def l5(spark, sf_dir):
    return accounting.account_violations(_accounts(spark, sf_dir))


@_register("c15_local_entities", _sql("""
SELECT doc_id, ord::BIGINT AS ordinal, 'M' || CASE WHEN ord < 1000 THEN lpad(ord::VARCHAR, 3, '0') ELSE ord::VARCHAR END AS local_id, name, 'TERM' AS type, span_id FROM mentions"""))
def c15(spark, sf_dir):
    return _graphs(spark, sf_dir).entities.select(F.col("g").alias("doc_id"), F.col("ord").cast("long").alias("ordinal"), "local_id", "name", "type", "span_id")


@_register("e1_nodes", _sql("SELECT doc_id, entity_id, canonical_name, members::BIGINT AS members, coalesce(aliases, '') AS aliases, span_ids FROM nodes"))
def e1(spark, sf_dir):
    return _graphs(spark, sf_dir).nodes.select(
        F.col("g").alias("doc_id"), "entity_id", "canonical_name", F.size("local_entity_ids").cast("long").alias("members"),
        F.array_join("aliases", "|").alias("aliases"), F.array_join("evidence_span_ids", "|").alias("span_ids"))


@_register("c19_edges", _sql("SELECT doc_id, edge_id, s AS source_entity_id, raw AS raw_relation, t AS target_entity_id, family AS relation_family, 'U001_' || span_id AS unit_id FROM ided"))
def c19(spark, sf_dir):
    return _graphs(spark, sf_dir).edges.select(F.col("g").alias("doc_id"), "edge_id", "source_entity_id", "raw_relation", "target_entity_id", "relation_family", "unit_id")


@_register("e6_family_distribution", _sql("SELECT family AS relation_family, count(*)::BIGINT AS edges FROM edges GROUP BY family"))
def e6(spark, sf_dir):
    return report.family_distribution(_graphs(spark, sf_dir).edges)


@_register("j3_isolated_nodes", _sql("""
SELECT doc_id AS g, entity_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = n.doc_id AND e.ordinal % 3 <> 0 AND (e.s = n.entity_id OR e.t = n.entity_id))"""))
def j3(spark, sf_dir):
    # Every node of these graphs has an edge; with each third edge taken away some stand alone.
    g = _graphs(spark, sf_dir)
    return graph.isolated_nodes(g.nodes, g.edges.where("ordinal % 3 <> 0"))


@_register("q12_path_query", _sql("SELECT * FROM paths ORDER BY graph_id, edge_id LIMIT 500"))
def q12(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    return project.path_query(project.vertex_rows(g.nodes), project.edge_rows(g.edges))


@_register("q15_all_paths", _sql("SELECT * FROM paths"))
def q15(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    return project.all_paths(project.vertex_rows(g.nodes), project.edge_rows(g.edges))


@_register("q14_preflight", _sql("""
SELECT doc_id AS graph_id, count(*)::BIGINT AS nodes, coalesce(any_value(e.c), 0)::BIGINT AS relationships, coalesce(any_value(e.c), 0)::BIGINT AS paths
FROM nodes LEFT JOIN (SELECT doc_id, count(*) AS c FROM edges GROUP BY doc_id) e USING (doc_id) GROUP BY doc_id"""))
def q14(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    return project.preflight(project.vertex_rows(g.nodes), project.edge_rows(g.edges))


@_register("q14_path_counts", _sql("""
SELECT count(*)::BIGINT AS unfiltered, (count(*) FILTER (a = 7))::BIGINT AS source, (count(*) FILTER (e.doc_id = 7))::BIGINT AS relationship, (count(*) FILTER (b = 7))::BIGINT AS target,
  (count(*) FILTER (a = 7 AND e.doc_id = 7 AND b = 7))::BIGINT AS "all"
FROM (SELECT doc_id, s, t, CASE WHEN ordinal % 5 = 0 THEN 7 ELSE doc_id END AS a, CASE WHEN ordinal % 7 = 0 THEN 7 ELSE doc_id END AS b FROM edges) e
JOIN nodes x ON x.doc_id = e.a AND x.entity_id = e.s JOIN nodes y ON y.doc_id = e.b AND y.entity_id = e.t"""))
def q14_paths(spark, sf_dir):
    # Some edges end in another namespace, where a node of that number may be.
    g = _graphs(spark, sf_dir)
    far = lambda every: F.when(F.col("ordinal") % every == 0, F.lit(7)).otherwise(F.col("g")).cast(dict(g.edges.dtypes)["g"])
    edges = project.edge_rows(g.edges.withColumns({"source_graph_id": far(5), "target_graph_id": far(7)}))
    return project.path_counts(project.vertex_rows(g.nodes), edges, 7)


@_register("l3_graph_violations", _sql("""
SELECT rule, count(*)::BIGINT AS n FROM (
  SELECT 'dangling_target' AS rule FROM edges WHERE ordinal % 17 = 0 UNION ALL SELECT 'unknown_unit' FROM edges WHERE ordinal % 19 = 0
  UNION ALL SELECT 'blank_relation' FROM edges WHERE ordinal % 29 = 0 UNION ALL SELECT 'modality' FROM edges WHERE ordinal % 31 = 0
) GROUP BY rule"""))
def l3(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    edges = g.edges.withColumns({
        "target_entity_id": F.when(F.col("ordinal") % 17 == 0, "E_NONE").otherwise(F.col("target_entity_id")),
        "unit_id": F.when(F.col("ordinal") % 19 == 0, "U_NONE").otherwise(F.col("unit_id")),
        "raw_relation": F.when(F.col("ordinal") % 29 == 0, " ").otherwise(F.col("raw_relation")),
        "qualifiers": F.col("qualifiers").withField("modality", F.when(F.col("ordinal") % 31 == 0, "MAYBE").otherwise(F.col("qualifiers.modality"))),
    })
    return graph.graph_violations(g.nodes, edges, g.units).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@_register("l6_parity", _sql("""
SELECT kind, property, count(*)::BIGINT AS n FROM (
  SELECT 'missing_edge' AS kind, '' AS property FROM edges WHERE ordinal % 23 = 0
  UNION ALL SELECT 'edge_property', 'raw_relation' FROM edges WHERE ordinal % 23 <> 0 AND ordinal % 11 = 0
  UNION ALL SELECT 'endpoint_mismatch', 'target_entity_id' FROM edges WHERE ordinal % 23 <> 0 AND ordinal % 13 = 0
  UNION ALL SELECT 'unexpected_node', '' FROM nodes WHERE entity_id = 'E001'
  UNION ALL SELECT 'missing_node', '' FROM nodes WHERE entity_id = 'E001'
) GROUP BY kind, property"""))
def l6(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    nodes, edges = write_table(g.nodes, "nodes", "g"), write_table(g.edges, "edges", "g")
    stored = edges.where("ordinal % 23 <> 0").withColumns({
        "raw_relation": F.when(F.col("ordinal") % 11 == 0, F.concat("raw_relation", F.lit("!"))).otherwise(F.col("raw_relation")),
        "target_entity_id": F.when(F.col("ordinal") % 13 == 0, F.concat("target_entity_id", F.lit("x"))).otherwise(F.col("target_entity_id")),
    }).withColumn("display_relation", F.lit(None).cast("string"))
    renamed = nodes.withColumn("entity_id", F.when(F.col("entity_id") == "E001", "E001x").otherwise(F.col("entity_id")))
    want = project.edge_rows(edges).drop("display_relation")
    have = project.edge_rows(stored).drop("display_relation")
    return project.parity(project.vertex_rows(nodes), want, project.vertex_rows(renamed), have).groupBy("kind", "property").agg(F.count(F.lit(1)).alias("n"))


_COMPONENTS = """
both_ways AS (SELECT DISTINCT doc_id, s AS a, t AS b FROM edges WHERE ordinal % 3 <> 0 UNION SELECT doc_id, t, s FROM edges WHERE ordinal % 3 <> 0),
reach(doc_id, a, b) AS (SELECT doc_id, entity_id, entity_id FROM nodes UNION SELECT r.doc_id, r.a, e.b FROM reach r JOIN both_ways e ON e.doc_id = r.doc_id AND e.a = r.b),
parts AS (
  SELECT r.doc_id, count(DISTINCT c) AS components, (count(*) FILTER (x.a IS NULL))::BIGINT AS isolated FROM (SELECT doc_id, a, min(b) AS c FROM reach GROUP BY doc_id, a) r
  LEFT JOIN (SELECT DISTINCT doc_id, a FROM both_ways) x ON x.doc_id = r.doc_id AND x.a = r.a GROUP BY r.doc_id)"""


def _thinned(spark, sf_dir):
    """The graphs with each third edge taken away, so that they fall into parts, and those parts."""
    g = _graphs(spark, sf_dir)
    nodes, edges = write_table(g.nodes, "nodes", "g"), write_table(g.edges.where("ordinal % 3 <> 0"), "edges", "g")
    return g, nodes, edges, graph.graph_components(nodes, edges)


@_register("n2_run_report", "WITH RECURSIVE " + _sql(r"""
SELECT d.doc_id AS g, len(list_filter(regexp_split_to_array(d.t, '\s+'), lambda w: w <> ''))::BIGINT AS source_words,
  coalesce((SELECT count(*) FROM spans x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS units,
  coalesce((SELECT count(*) FROM mentions x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS local_entities,
  coalesce((SELECT count(*) FROM edges x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS local_relations,
  coalesce((SELECT count(*) FROM nodes x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS nodes,
  coalesce((SELECT count(*) FROM nodes x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS global_entities,
  coalesce((SELECT count(*) FROM edges x WHERE x.doc_id = d.doc_id AND ordinal % 3 <> 0), 0)::BIGINT AS edges,
  coalesce((SELECT components FROM parts x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS connected_components,
  coalesce((SELECT isolated FROM parts x WHERE x.doc_id = d.doc_id), -1)::BIGINT AS isolated,
  coalesce((SELECT count(*) FROM named x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS primary_http_attempts,
  coalesce((SELECT count(*) FROM named x WHERE x.doc_id = d.doc_id AND span_no % 9 = 0), 0)::BIGINT AS accepted_extractions,
  15 * coalesce((SELECT count(*) FROM named x WHERE x.doc_id = d.doc_id AND span_no % 9 NOT IN (1, 2)), 0)::BIGINT AS total_tokens
FROM docs d""", _SPANS.strip() + "," + _COMPONENTS).removeprefix("WITH "))
def n2(spark, sf_dir):
    g, nodes, edges, components = _thinned(spark, sf_dir)
    totals = accounting.totals(_accounts(spark, sf_dir)).withColumnRenamed("doc_id", "g")
    out = report.run_report(_table(spark, sf_dir, "documents"), g.spans, g.entities, g.relations.withColumnRenamed("doc_id", "g"), nodes, edges, components, accounts=totals)
    return out.select("g", "source_words", "units", "local_entities", "local_relations", "nodes", "global_entities", "edges", "connected_components",
                      F.coalesce(F.size("isolated_nodes"), F.lit(-1)).cast("long").alias("isolated"), "primary_http_attempts", "accepted_extractions", "total_tokens")


@_register("j2_document_components", "WITH RECURSIVE " + _sql("SELECT doc_id AS g, components::BIGINT AS components, isolated AS isolated_nodes FROM parts", _SPANS.strip() + "," + _COMPONENTS).removeprefix("WITH "))
def j2_docs(spark, sf_dir):
    return _thinned(spark, sf_dir)[3].select("g", "components", F.size("isolated").cast("long").alias("isolated_nodes"))


def _star(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The star schema's keys as one typed graph (g = 0)."""
    t = lambda n: _table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kinds = (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("supplier", "s", "s_suppkey"), ("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"))
    nodes = None
    for table, p, c in kinds:
        part = t(table).select(F.lit(0).alias("g"), name(p, c).alias("entity_id"), F.lit(table).alias("primary_type"))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = None
    for table, a, ka, b, kb, family in (
        ("nation", "n", "n_nationkey", "r", "n_regionkey", "COMPOSITION"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "COMPOSITION"),
        ("customer", "c", "c_custkey", "n", "c_nationkey", "COMPOSITION"), ("orders", "o", "o_orderkey", "c", "o_custkey", "RESPONSIBILITY_OWNERSHIP"),
    ):
        part = t(table).select(F.lit(0).alias("g"), name(a, ka).alias("source_entity_id"), name(b, kb).alias("target_entity_id"), F.lit(family).alias("relation_family"))
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges


@_register("j2_components", """
SELECT component, count(*)::BIGINT AS members FROM (
  SELECT 'n' || (SELECT min(n2.n_nationkey::VARCHAR) FROM nation n2 WHERE n2.n_regionkey = n.n_regionkey) AS component FROM nation n WHERE false
  UNION ALL SELECT least_ FROM (
    SELECT r.r_regionkey, min(id) OVER (PARTITION BY r.r_regionkey) AS least_ FROM region r JOIN (
      SELECT r_regionkey AS k, 'r' || r_regionkey AS id FROM region
      UNION ALL SELECT n_regionkey, 'n' || n_nationkey FROM nation
      UNION ALL SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT n_regionkey, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    ) m ON m.k = r.r_regionkey)
) GROUP BY component""")
def j2(spark, sf_dir):
    _, edges = _star(spark, sf_dir)
    return connected_components(edges, "source_entity_id", "target_entity_id").groupBy("component").agg(F.count(F.lit(1)).alias("members"))


@_register("star_family_distribution", """
SELECT relation_family, count(*)::BIGINT AS edges FROM (
  SELECT 'COMPOSITION' AS relation_family FROM nation UNION ALL SELECT 'COMPOSITION' FROM supplier UNION ALL SELECT 'COMPOSITION' FROM customer
  UNION ALL SELECT 'RESPONSIBILITY_OWNERSHIP' FROM orders) GROUP BY relation_family""")
def star(spark, sf_dir):
    return report.family_distribution(_star(spark, sf_dir)[1])


def _vectors(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("g"), (F.col("vec_id") + 1).alias("ord"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id", "label")


_PAIRS = """
v AS (SELECT vec_id + 1 AS ord, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
sims AS (SELECT a.ord AS l, b.ord AS r, round(list_cosine_similarity(a.x, b.x), 6) AS similarity FROM v a JOIN v b ON a.ord < b.ord)"""


@_register("d4_similar_pairs", _sql(f"SELECT l, r, similarity FROM sims WHERE similarity >= {CANDIDATE}", _PAIRS))
def d4(spark, sf_dir):
    return resolve.similar_pairs(_vectors(spark, sf_dir), CANDIDATE).where(F.col("similarity") >= CANDIDATE).select("l", "r", "similarity")


@_register("f4_top_neighbours", _sql(f"""
SELECT ord, neighbour, similarity, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ord ORDER BY similarity DESC, neighbour DESC) AS rank
  FROM (SELECT l AS ord, r AS neighbour, similarity FROM sims UNION ALL SELECT r, l, similarity FROM sims)) WHERE rank <= {TOP_K}""", _PAIRS))
def f4(spark, sf_dir):
    return resolve.nearest(_vectors(spark, sf_dir), TOP_K).select("ord", "neighbour", "similarity", "rank")


def _linked_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Vectors as entities, and relations between some neighbours."""
    v = _vectors(spark, sf_dir)
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    entities = v.select("g", "ord", text("M", F.col("ord")).alias("local_id"), text("V", F.col("vec_id") % 50).alias("name"), F.col("label").cast("string").alias("type"),
                        text("U", F.col("vec_id") % 7).alias("unit"), F.lit("S001").alias("span_id"))
    i = F.col("vec_id")
    return entities, v.where((i % 5 == 0) & (i > 0)).select(
        "g", F.col("ord").alias("l"), (F.col("ord") - 1).alias("r"), F.when(i % 25 == 0, "Same as").otherwise("feeds").alias("raw_relation"),
        F.when(i % 2 == 0, "DATA_FLOW").otherwise("DEPENDENCY").alias("family"), text("R", i).alias("relation_id"), F.array(F.lit("S001")).alias("spans"))


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    entities, relations = _linked_vectors(spark, sf_dir)
    return entities, _vectors(spark, sf_dir), relations


def _decided(spark, sf_dir, floor: float = CANDIDATE, pairs: DataFrame | None = None, written: bool = True) -> tuple[DataFrame, DataFrame]:
    """Those entities, and the decisions of their pairs: of all that reach ``floor``, or of ``pairs``, and of those with evidence."""
    v, (entities, relations) = _vectors(spark, sf_dir), _linked_vectors(spark, sf_dir)
    pairs = resolve.similar_pairs(v, floor) if pairs is None else pairs
    pairs = resolve.add_evidence_pairs(pairs.where(F.col("similarity") >= floor), v, relations)
    decided = resolve.decide(entities, relations, pairs, CANDIDATE, MERGE)
    return entities, write_table(decided, "decisions") if written else decided


_DECIDED = f"""{_PAIRS},
rel AS (SELECT vec_id AS l, vec_id + 1 AS r, vec_id % 25 = 0 AS same, CASE WHEN vec_id % 2 = 0 THEN 'DATA_FLOW' ELSE 'DEPENDENCY' END AS family FROM embeddings WHERE vec_id % 5 = 0 AND vec_id > 0),
ends AS (SELECT l AS ord, r AS other, family FROM rel UNION ALL SELECT r, l, family FROM rel),
ctx AS (SELECT e.ord, list_distinct(list(family)) AS fam, list_distinct(list(v.label)) AS types FROM ends e JOIN v ON v.ord = e.other GROUP BY e.ord),
joined AS (
  SELECT s.l, s.r, s.similarity, coalesce(rel.same, false) AS explicit_, coalesce(NOT rel.same, false) AS distinct_,
    a.vec_id % 50 = b.vec_id % 50 AS exact_, a.vec_id % 7 <> b.vec_id % 7 AS units_,
    len(list_intersect(coalesce(ca.fam, []), coalesce(cb.fam, []))) > 0 OR len(list_intersect(coalesce(ca.types, []), coalesce(cb.types, []))) > 0 AS structural_
  FROM sims s JOIN v a ON a.ord = s.l JOIN v b ON b.ord = s.r LEFT JOIN rel ON rel.l = s.l AND rel.r = s.r
  LEFT JOIN ctx ca ON ca.ord = s.l LEFT JOIN ctx cb ON cb.ord = s.r
  WHERE s.similarity >= {CANDIDATE} OR rel.l IS NOT NULL
),
decided AS (
  SELECT l, r, similarity, explicit_, CASE WHEN distinct_ AND NOT explicit_ THEN 'KEEP_SEPARATE' WHEN explicit_ THEN 'MERGE' WHEN similarity < {CANDIDATE} THEN 'BELOW_CANDIDATE_THRESHOLD'
    WHEN similarity < {MERGE} THEN 'UNRESOLVED' WHEN NOT ((units_ AND exact_) OR structural_) THEN 'UNRESOLVED' ELSE 'MERGE' END AS decision,
    (units_ AND exact_) OR structural_ AS context_compatible
  FROM joined
)"""


@_register("k5_decisions", _sql("SELECT l, r, similarity, decision, context_compatible FROM decided", _DECIDED))
def k5(spark, sf_dir):
    # Read once and only in part: not written before.
    return _decided(spark, sf_dir, written=False)[1].select("l", "r", "similarity", "decision", "context_compatible")


@_register("e4_decision_counts", _sql("SELECT decision, count(*)::BIGINT AS pairs FROM decided WHERE decision <> 'BELOW_CANDIDATE_THRESHOLD' GROUP BY decision", _DECIDED))
def e4(spark, sf_dir):
    return resolve.count_decisions(*_linked(spark, sf_dir), CANDIDATE, MERGE).select("decision", "pairs")


@_register("k8_resolved_entities", "WITH RECURSIVE " + _sql("""
SELECT ord, 'E' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS entity_id
FROM (SELECT ord, dense_rank() OVER (ORDER BY c) AS k FROM (SELECT ord, min(other) AS c FROM reach GROUP BY ord))""", _DECIDED + """,
both_ways AS (SELECT l, r FROM decided WHERE decision = 'MERGE' UNION ALL SELECT r, l FROM decided WHERE decision = 'MERGE'),
reach(ord, other) AS (SELECT ord, ord FROM v UNION SELECT x.ord, e.r FROM reach x JOIN both_ways e ON e.l = x.other)""").removeprefix("WITH "))
def k8(spark, sf_dir):
    # Below the merge threshold only evidence merges, and pairs with evidence are decided in any case.
    entities, decided = _decided(spark, sf_dir, MERGE)
    return resolve.resolve(entities, decided).select("ord", "entity_id")


_NEAR = f"""
near AS (SELECT DISTINCT least(ord, neighbour) AS l, greatest(ord, neighbour) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY ord ORDER BY similarity DESC, neighbour DESC) AS rank
  FROM (SELECT l AS ord, r AS neighbour, similarity FROM sims UNION ALL SELECT r, l, similarity FROM sims)) WHERE rank <= {TOP_K})"""


@_register("k9_selected_candidates", _sql("""
SELECT d.l, d.r, d.decision FROM decided d LEFT JOIN near ON near.l = d.l AND near.r = d.r LEFT JOIN (SELECT l, r FROM rel WHERE same) x ON x.l = d.l AND x.r = d.r
WHERE near.l IS NOT NULL OR x.l IS NOT NULL""", _DECIDED + "," + _NEAR))
def k9(spark, sf_dir):
    # Only what may be selected is decided: the nearest, and pairs with evidence.
    near = write_table(resolve.nearest(_vectors(spark, sf_dir), TOP_K), "nearest")
    return resolve.select_candidates(_decided(spark, sf_dir, pairs=resolve.neighbour_pairs(near))[1], near).select("l", "r", "decision")


def _resolution(spark, sf_dir, limit: int):
    entities, relations = _linked_vectors(spark, sf_dir)
    return resolve.resolve_entities(entities, _vectors(spark, sf_dir).select("g", "ord", "vector"), relations, CANDIDATE, MERGE, pairwise_limit=limit, top_k=TOP_K)


_GROUPED = """
both_ways AS (SELECT l, r FROM chosen WHERE decision = 'MERGE' UNION ALL SELECT r, l FROM chosen WHERE decision = 'MERGE'),
reach(ord, other) AS (SELECT ord, ord FROM v UNION SELECT x.ord, e.r FROM reach x JOIN both_ways e ON e.l = x.other)"""
_IDS = """
SELECT ord, 'E' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS entity_id
FROM (SELECT ord, dense_rank() OVER (ORDER BY c) AS k FROM (SELECT ord, min(other) AS c FROM reach GROUP BY ord))"""


@_register("k9_resolve_small", "WITH RECURSIVE " + _sql(_IDS, _DECIDED + ", chosen AS (SELECT * FROM decided)," + _GROUPED).removeprefix("WITH "))
def k9_small(spark, sf_dir):
    return _resolution(spark, sf_dir, 1_000_000).entities.select("ord", "entity_id")


@_register("k9_resolve_large", "WITH RECURSIVE " + _sql(_IDS, _DECIDED + "," + _NEAR + """,
chosen AS (SELECT d.* FROM decided d LEFT JOIN near ON near.l = d.l AND near.r = d.r WHERE near.l IS NOT NULL OR d.explicit_),""" + _GROUPED).removeprefix("WITH "))
def k9_large(spark, sf_dir):
    return _resolution(spark, sf_dir, 1).entities.select("ord", "entity_id")


@_register("e10_resolution_summary", _sql(f"""
SELECT (SELECT count(*) FROM v)::BIGINT AS entities, (SELECT count(*) * (count(*) - 1) // 2 FROM v)::BIGINT AS unique_pairs, 'top_k_from_full_matrix' AS retrieval_method, {TOP_K} AS top_k, 64 AS vector_dimension,
  count(*)::BIGINT AS candidate_pairs, (count(*) FILTER (decision = 'MERGE'))::BIGINT AS merged_pairs, (count(*) FILTER (decision = 'KEEP_SEPARATE'))::BIGINT AS keep_separate_pairs,
  (count(*) FILTER (decision = 'UNRESOLVED'))::BIGINT AS unresolved_pairs
FROM decided d LEFT JOIN near ON near.l = d.l AND near.r = d.r WHERE (near.l IS NOT NULL OR d.explicit_) AND decision <> 'BELOW_CANDIDATE_THRESHOLD'""", _DECIDED + "," + _NEAR))
def e10(spark, sf_dir):
    return _resolution(spark, sf_dir, 1).summary.drop("g", "candidate_threshold", "merge_threshold")


@_register("d16_golden", _sql("""
SELECT 'forbidden_relation' AS "check", source || ' ' || relation || ' ' || target AS detail FROM paths WHERE relation = 'of' GROUP BY ALL
UNION ALL SELECT 'required_relation', 'nobody likes nothing' UNION ALL SELECT 'required_entity', 'nobody at all' UNION ALL SELECT 'required_merge', 'nobody nothing'
UNION ALL SELECT DISTINCT 'required_separation', a.name || ' ' || b.name FROM pairs p JOIN firsts a ON a.doc_id = p.doc_id AND a.first_ = p.first_ AND a.ord = p.first_ JOIN firsts b ON b.doc_id = p.doc_id AND b.first_ = p.first_ AND b.ord = p.other
UNION ALL SELECT DISTINCT 'required_qualifier', source || ' ' || relation || ' version' FROM paths WHERE relation = 'of'""", _SPANS.strip() + """,
pairs AS (SELECT doc_id, first_, min(ord) AS other FROM firsts f WHERE name <> (SELECT name FROM firsts x WHERE x.doc_id = f.doc_id AND x.ord = f.first_) GROUP BY doc_id, first_)"""))
def d16(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    nodes, edges, entities = write_table(g.nodes, "nodes", "g"), write_table(g.edges, "edges", "g"), g.entities
    paths = project.all_paths(project.vertex_rows(nodes), project.edge_rows(edges))
    some = lambda rows, schema: spark.createDataFrame(rows, schema)
    of = write_table(paths.where("relation = 'of'").select("source", F.col("relation").alias("raw_relation"), "target").distinct(), "paths")
    # Names that were merged though they are written differently: as if they had to be apart, and as merges that are there.
    member = entities.select("g", "entity_id", "ord", "name")
    first = member.groupBy("g", "entity_id").agg(F.min_by("name", "ord").alias("a"))
    second = member.join(first, ["g", "entity_id"]).where("name <> a").groupBy("g", "entity_id", "a").agg(F.min_by("name", "ord").alias("b"))
    written = write_table(second.select("a", "b").distinct(), "names")
    required = some([("nobody", "likes", "nothing")], "source string, raw_relation string, target string").unionByName(of)
    merged = written.unionByName(some([("nobody", "nothing")], "a string, b string"))
    names = nodes.select(F.col("canonical_name").alias("name")).distinct().unionByName(some([("nobody at all",)], "name string"))
    says = of.select("source", "raw_relation", F.explode(F.array(F.struct(F.lit("version").alias("field"), F.lit("2").alias("value")), F.struct(F.lit("modality").alias("field"), F.lit("ASSERTED").alias("value")))).alias("c"))
    return report.compare_golden(nodes, edges, required, of, merged, written, names, says.select("source", "raw_relation", "c.field", "c.value").distinct()).distinct()
