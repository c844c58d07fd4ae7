"""Registered queries of audits, evidence, names and the store's namespaces, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.ids import vector_hash
from loomgraph.functions.text import document_spans, name_relation, relation_key
from loomgraph.operators import accounting, audit, extract, final_graph, graph, parity, project, report, resolve
from loomgraph.operators.store import INDEX_SCHEMA
from loomgraph.plans.queries import _DECIDED, _SPANS, CANDIDATE, MERGE, _graphs, _linked_vectors, _register, _responses, _sql, _table, _vectors
from loomgraph.sources.shared import write_table
from loomgraph.sources.viewer import credential_free_address

OWNER = {"label": "FACT_ENTITY", "relation_type": "FACT_RELATION"}


def _responses_of(spark, sf_dir):
    return _responses(document_spans(_table(spark, sf_dir, "documents")))


def _owned(df):
    return df.withColumns({"owner": F.concat(F.lit("run_"), F.pmod("graph_id", F.lit(3)).cast("string")), **{k: F.lit(v) for k, v in OWNER.items()}})


def _foreign_relations(g):
    """Each 41st relation names a span that is not its document's."""
    return g.relations.withColumn("span_id", F.when(F.col("ordinal") % 41 == 0, "S000").otherwise(F.col("span_id")))


@_register("l13_response_evaluation", _sql("""
SELECT doc_id, span_id, CASE WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END AS result, (k NOT IN (1, 2, 3))::BIGINT AS tool_calls, k = 5 AS reasoning_present, k = 4 AS truncated,
  k IN (0, 4, 5, 6) AS contract_valid, CASE WHEN k = 8 THEN 'SCHEMA_INVALID_RESPONSE' ELSE '' END AS failure_categories,
  CASE WHEN k = 8 THEN 0 WHEN k NOT IN (1, 2, 3, 7) THEN (n >= 3)::BIGINT ELSE -1 END AS relation_count,
  CASE WHEN k NOT IN (1, 2, 3, 7, 8) AND n >= 3 THEN f[n % 10 + 1] WHEN k NOT IN (1, 2, 3, 7) THEN '' END AS relation_families
FROM (SELECT *, span_no % 9 AS k, len(w) AS n FROM words) CROSS JOIN families"""))
def l13(spark, sf_dir):
    out = audit.evaluate_responses(_responses_of(spark, sf_dir))
    return out.select("doc_id", "span_id", "result", "tool_calls", "reasoning_present", "truncated", "contract_valid", F.array_join("failure_categories", "|").alias("failure_categories"),
                      F.coalesce("relation_count", F.lit(-1)).alias("relation_count"), F.array_join("relation_families", "|").alias("relation_families"))


@_register("i14_relation_hashes", _sql("""
SELECT doc_id, span_id, sha256(replace(lower(array_to_string(w[2:1 + greatest(1, least(2, n - 2))], ' ')), 'ß', 'ss')) AS relation_hash FROM facts WHERE span_no % 9 NOT IN (1, 2, 3, 7, 8)"""))
def i14(spark, sf_dir):
    return audit.evaluate_responses(_responses_of(spark, sf_dir)).select("doc_id", "span_id", F.explode("relation_hashes").alias("relation_hash"))


@_register("c11_discard_reasoning", _sql("SELECT doc_id, span_id, span_no % 9 = 5 AS reasoning_present, false AS reasoning_left FROM named WHERE span_no % 9 NOT IN (1, 2)"))
def c11(spark, sf_dir):
    out = audit.discard_reasoning(_responses_of(spark, sf_dir)).where("body is not null")
    return out.select("doc_id", "span_id", "reasoning_present", F.col("body").contains('"reasoning"').alias("reasoning_left"))


@_register("n1_validation_report", _sql("""
SELECT doc_id AS g, bad AS invalid_finish_reasons, foreign_ AS unknown_evidence, lost AS parity_differences, called AS forbidden_calls, bad + foreign_ + lost + called = 0 AS passed FROM (
  SELECT doc_id, (count(*) FILTER (span_no % 9 = 4))::BIGINT AS bad,
    (SELECT count(DISTINCT 1) FROM edges e WHERE e.doc_id = s.doc_id AND e.ordinal % 41 = 0)::BIGINT AS foreign_,
    (SELECT count(*) FROM edges e WHERE e.doc_id = s.doc_id AND e.ordinal % 97 = 0)::BIGINT AS lost, (count(*) FILTER (span_no % 53 = 0))::BIGINT AS called
  FROM named s GROUP BY doc_id)"""))
def n1(spark, sf_dir):
    g = _graphs(spark, sf_dir, texts=True)
    nodes, edges = write_table(g.nodes, "nodes", "g"), write_table(g.edges, "edges", "g")
    v, e = project.vertex_rows(nodes), project.edge_rows(edges)
    differences = project.parity(v, e, v, project.edge_rows(edges.where("ordinal % 97 <> 0")))
    gated = extract.gate_responses(_responses(g.spans))
    calls = gated.unionByName(gated.where("span_no % 53 = 0").withColumn("forbidden", F.lit(True)), allowMissingColumns=True)
    return audit.validation_report(_responses(g.spans), _foreign_relations(g), g.spans, differences, accounting.unit_accounts(calls))


@_register("l12_conformance", _sql("""
SELECT error, count(*)::BIGINT AS graphs FROM (
  SELECT 'accepted calls differ from units' AS error FROM (SELECT DISTINCT doc_id FROM named WHERE span_no % 9 <> 0)
  UNION ALL SELECT 'parity failed' FROM (SELECT DISTINCT doc_id FROM edges WHERE ordinal % 97 = 0)
  UNION ALL SELECT unnest(['validation failed', 'run not completed']) FROM (SELECT DISTINCT doc_id FROM edges WHERE ordinal % 97 = 0)
  UNION ALL SELECT 'blank_relation' FROM (SELECT DISTINCT doc_id FROM edges WHERE ordinal % 29 = 0)
) GROUP BY error"""))
def l12(spark, sf_dir):
    g = _graphs(spark, sf_dir, texts=True)
    nodes, edges = write_table(g.nodes, "nodes", "g"), write_table(g.edges, "edges", "g")
    v, e = project.vertex_rows(nodes), project.edge_rows(edges)
    differences = project.parity(v, e, v, project.edge_rows(edges.where("ordinal % 97 <> 0")))
    budget = accounting.totals(accounting.unit_accounts(extract.gate_responses(_responses(g.spans)))).withColumnRenamed("doc_id", "g")
    sound = g.spans.select("doc_id", F.lit('{"choices":[{"finish_reason":"stop"}]}').alias("body"))
    validation = write_table(audit.validation_report(sound, g.relations, g.spans, differences), "validation")
    blank = edges.withColumn("raw_relation", F.when(F.col("ordinal") % 29 == 0, " ").otherwise(F.col("raw_relation")))
    return audit.conformance(nodes, blank, g.units, budget, validation, audit.completion_status(validation)).groupBy("error").agg(F.count(F.lit(1)).alias("graphs"))


@_register("l1_unknown_evidence", _sql("SELECT doc_id, ordinal::BIGINT AS ordinal, 'S000' AS span_id FROM edges WHERE ordinal % 41 = 0"))
def l1(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    return extract.unknown_evidence(_foreign_relations(g), g.spans).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "span_id")


@_register("f5_duplicate_edges", _sql("SELECT doc_id AS g, count(*)::BIGINT AS duplicates FROM edges WHERE ordinal % 3 = 0 GROUP BY doc_id"))
def f5(spark, sf_dir):
    edges = _graphs(spark, sf_dir).edges
    again = edges.where("ordinal % 3 = 0").withColumn("ordinal", (F.col("ordinal") + 1_000_000_000).cast(dict(edges.dtypes)["ordinal"]))
    return graph.dedup_edges(edges.unionByName(again))[1].groupBy("g").agg(F.count(F.lit(1)).alias("duplicates"))


@_register("f6_unit_duplicates", _sql("SELECT doc_id AS g, count(*)::BIGINT AS duplicates FROM edges WHERE ordinal % 3 = 0 GROUP BY doc_id"))
def f6(spark, sf_dir):
    # Each third edge twice in its unit, each fourth once more in another one, where it is no duplicate.
    edges = _graphs(spark, sf_dir).edges
    later = lambda df, k: df.withColumn("ordinal", (F.col("ordinal") + k * 1_000_000_000).cast(dict(edges.dtypes)["ordinal"]))
    again = later(edges.where("ordinal % 3 = 0"), 1).unionByName(later(edges.where("ordinal % 4 = 0"), 2).withColumn("unit_id", F.lit("U999_S001")))
    return graph.dedup_edges(edges.unionByName(again), ("unit_id",))[1].groupBy("g").agg(F.count(F.lit(1)).alias("duplicates"))


@_register("d18_import_errors", _sql("""
SELECT doc_id AS graph_id, edge_id, 'source' AS "end" FROM ided WHERE ordinal % 7 = 0 UNION ALL SELECT doc_id, edge_id, 'target' FROM ided WHERE ordinal % 17 = 0"""))
def d18(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    lost = lambda every, col: F.when(F.col("ordinal") % every == 0, "E_NONE").otherwise(F.col(col))
    edges = g.edges.withColumns({"source_entity_id": lost(7, "source_entity_id"), "target_entity_id": lost(17, "target_entity_id")})
    return project.import_errors(project.vertex_rows(g.nodes), project.edge_rows(edges))


@_register("q1_namespaces", _sql("""
SELECT n.doc_id AS graph_id, 'run_' || (n.doc_id % 3) AS owners, 'FACT_ENTITY' AS labels, 'FACT_RELATION' AS relation_types, n.c AS nodes, e.c AS relationships
FROM (SELECT doc_id, count(*)::BIGINT AS c FROM nodes GROUP BY doc_id) n JOIN (SELECT doc_id, count(*)::BIGINT AS c FROM edges GROUP BY doc_id) e ON e.doc_id = n.doc_id"""))
def q1(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    out = project.namespaces(_owned(project.vertex_rows(g.nodes)), _owned(project.edge_rows(g.edges)))
    return out.select("graph_id", *(F.array_join(c, "|").alias(c) for c in ("owners", "labels", "relation_types")), "nodes", "relationships")


@_register("q8_edges_without_graph", _sql("SELECT edge_id, count(*)::BIGINT AS edges FROM ided WHERE ordinal % 37 = 0 GROUP BY edge_id"))
def q8(spark, sf_dir):
    edges = project.edge_rows(_graphs(spark, sf_dir).edges.withColumn("g", F.when(F.col("ordinal") % 37 != 0, F.col("g"))))
    return project.edges_without_graph(edges).groupBy("edge_id").agg(F.count(F.lit(1)).alias("edges"))


@_register("q11_blank_graphs", _sql("SELECT DISTINCT CASE WHEN ordinal % 2 = 0 THEN ' ' END AS graph_id FROM edges WHERE ordinal % 37 = 0"))
def q11(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    blank = F.when(F.col("ordinal") % 37 != 0, F.col("g").cast("string")).when(F.col("ordinal") % 2 == 0, " ")
    nodes = g.nodes.withColumn("g", F.col("g").cast("string"))
    return project.blank_graphs(project.vertex_rows(nodes), project.edge_rows(g.edges.withColumn("g", blank)))


@_register("d7_incident_context", _sql("""
SELECT e.ord, array_to_string(list_sort(list_distinct(list(family))), '|') AS families, array_to_string(list_sort(list_distinct(list(v.label::VARCHAR))), '|') AS neighbour_types
FROM ends e JOIN v ON v.ord = e.other GROUP BY e.ord""", _DECIDED))
def d7(spark, sf_dir):
    entities, relations = _linked_vectors(spark, sf_dir)
    out = resolve.incident_context(entities, relations)
    return out.select("ord", *(F.array_join(F.sort_array(c), "|").alias(c) for c in ("families", "neighbour_types")))


@_register("e3_equivalence_evidence", _sql("SELECT l, r, 'R' || l AS relation_ids, 'S001' AS span_ids FROM rel WHERE same", _DECIDED))
def e3(spark, sf_dir):
    equal, _ = resolve.relation_evidence(_linked_vectors(spark, sf_dir)[1])
    return equal.select(F.col("a").alias("l"), F.col("b").alias("r"), F.array_join("equivalence_relation_ids", "|").alias("relation_ids"), F.array_join("equivalence_span_ids", "|").alias("span_ids"))


@_register("d6_direct_distinct", _sql("SELECT l, r FROM rel WHERE NOT same", _DECIDED))
def d6(spark, sf_dir):
    return resolve.relation_evidence(_linked_vectors(spark, sf_dir)[1])[1].select(F.col("a").alias("l"), F.col("b").alias("r"))


@_register("k7_saved_matrix", _sql("SELECT l, r, similarity, decision, context_compatible FROM decided", _DECIDED))
def k7(spark, sf_dir):
    entities, relations = _linked_vectors(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).select("g", "ord", "vector").join(entities.select("g", "ord", "local_id"), ["g", "ord"])
    matrix = write_table(resolve.similarity_matrix(vectors, 64), "matrix")
    out = resolve.decide(entities, relations, resolve.saved_matrix_pairs(entities, matrix, 64, CANDIDATE, relations), CANDIDATE, MERGE)
    seen = (F.col("similarity") >= CANDIDATE) | F.col("explicit_equivalence") | F.col("direct_distinct")
    return out.where(seen).select("l", "r", "similarity", "decision", "context_compatible")


@_register("i3_relation_key", _sql(r"SELECT DISTINCT raw AS raw_relation, trim(regexp_replace(replace(lower(trim(raw)), 'ß', 'ss'), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS relation_key FROM edges"))
def i3(spark, sf_dir):
    return _graphs(spark, sf_dir).edges.select("raw_relation").distinct().withColumn("relation_key", relation_key(F.col("raw_relation")))


@_register("i6_name_relation", _sql(r"""
SELECT graph_id, edge_id, CASE WHEN trim(a) = trim(b) THEN 'EXACT' WHEN replace(lower(trim(a)), 'ß', 'ss') = replace(lower(trim(b)), 'ß', 'ss') THEN 'CASE_ONLY'
  WHEN (len(x) > len(y) AND len(y) > 0 AND contains(' ' || array_to_string(x, ' ') || ' ', ' ' || array_to_string(y, ' ') || ' '))
    OR (len(y) > len(x) AND len(x) > 0 AND contains(' ' || array_to_string(y, ' ') || ' ', ' ' || array_to_string(x, ' ') || ' ')) THEN 'TOKEN_CONTAINMENT_EXPANSION'
  ELSE 'DIFFERENT' END AS name_relation
FROM (SELECT graph_id, edge_id, a, b, regexp_extract_all(replace(lower(a), 'ß', 'ss'), '[\p{L}\p{N}]+') AS x, regexp_extract_all(replace(lower(b), 'ß', 'ss'), '[\p{L}\p{N}]+') AS y
      FROM (SELECT graph_id, edge_id, relation || ' ' || target AS a, CASE WHEN length(relation) % 4 = 0 THEN translate(relation, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' || target WHEN length(relation) % 4 = 1 THEN target ELSE source END AS b FROM paths))"""))
def i6(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    paths = project.all_paths(project.vertex_rows(g.nodes), project.edge_rows(g.edges))
    k = F.length("relation") % 4
    other = F.when(k == 0, F.concat(F.translate("relation", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), "target")).when(k == 1, F.col("target")).otherwise(F.col("source"))
    return paths.select("graph_id", "edge_id", name_relation(F.concat("relation", F.lit(" "), "target"), other).alias("name_relation"))


@_register("i13_store_address", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?[^/?#:@]+(:[0-9]+)?([/?#]|$)') THEN
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))
  || regexp_extract(url, '^[^:]*://(?:[^/?#@]*@)?[^/?#:@]+(:[0-9]+)', 1) END AS address
FROM pages""")
def i13(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", credential_free_address(F.col("url")).alias("address"))


@_register("i16_vector_hash")
def i16(spark, sf_dir):
    """No SQL: DuckDB writes doubles in another way than the hash wants; tests compare with Python."""
    return _vectors(spark, sf_dir).select("vec_id", vector_hash(F.col("vector")).alias("vector_sha256"))


def _identified(spark, sf_dir):
    """Headers and sources of the documents' graphs, by document."""
    d = _table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    headers = d.select(F.col("doc_id").alias("g"), F.concat(F.lit("fact_extraction_r_"), F.col("doc_id").cast("string")).alias("graph_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("manifest_identity_hash"),
                       F.lit("h").alias("prompt_hash"), F.lit("default").alias("prompt_id"), F.lit("r").alias("run_id"))
    sources = d.select(F.col("doc_id").alias("g"), F.lit(None).cast("string").alias("repository_relative_path"), F.lit("external").alias("source_location_policy"), F.lit("a.txt").alias("source_name"),
                       F.sha2(body, 256).alias("source_sha256"), F.octet_length(body).cast("long").alias("source_size_bytes"))
    return headers, sources


_NESTED = """
jnodes AS (
  SELECT doc_id, string_agg('{"aliases":' || als || ',"canonical_name":"' || canonical_name || '","entity_id":"' || entity_id || '","evidence_span_ids":' || spn || ',"local_entity_ids":' || loc || ',"primary_type":"TERM"}', ',' ORDER BY k) AS j
  FROM (
    SELECT doc_id, entity_id, any_value(k) AS k, arg_min(name, ord) AS canonical_name,
      coalesce('["' || array_to_string(list_sort(list_distinct(list(name) FILTER (ord > first_))), '","') || '"]', '[]') AS als,
      '["' || array_to_string(list_sort(list_distinct(list(span_id))), '","') || '"]' AS spn,
      '["' || string_agg('M' || CASE WHEN ord < 1000 THEN lpad(ord::VARCHAR, 3, '0') ELSE ord::VARCHAR END, '","' ORDER BY ord) || '"]' AS loc
    FROM resolved GROUP BY doc_id, entity_id) GROUP BY doc_id),
jedges AS (
  SELECT doc_id, string_agg('{"edge_id":"' || edge_id || '","evidence_span_ids":["' || span_id || '"],"provenance":{"prompt_id":"default","source":"fact_extraction"},"qualifiers":{"condition":null,"modality":"ASSERTED","negated":false,"quantity":null,"temporality":null,"version":null},"raw_relation":"'
    || raw || '","relation_description":"' || raw || '","relation_family":"' || family || '","source_entity_id":"' || s || '","support_level":"EXPLICIT","target_entity_id":"' || t || '","unit_id":"U001_' || span_id || '"}', ',' ORDER BY ordinal) AS j
  FROM ided GROUP BY doc_id),
junits AS (SELECT doc_id, string_agg('{"span_ids":["' || span_id || '"],"unit_id":"U001_' || span_id || '"}', ',' ORDER BY span_no) AS j FROM named GROUP BY doc_id),
whole AS (
  SELECT d.doc_id, '{"edges":[' || coalesce(e.j, '') || '],"graph_id":"fact_extraction_r_' || d.doc_id || '","manifest_identity_hash":"' || sha256(d.doc_id::VARCHAR) || '","nodes":[' || coalesce(n.j, '')
    || '],"prompt_hash":"h","prompt_id":"default","run_id":"r","source":{"repository_relative_path":null,"source_location_policy":"external","source_name":"a.txt","source_sha256":"' || sha256(coalesce(d.text, ''))
    || '","source_size_bytes":' || octet_length(encode(coalesce(d.text, ''))) || ',"units":[' || coalesce(u.j, '') || ']}}' AS j
  FROM documents d LEFT JOIN jnodes n ON n.doc_id = d.doc_id LEFT JOIN jedges e ON e.doc_id = d.doc_id LEFT JOIN junits u ON u.doc_id = d.doc_id)"""


def _nested(spark, sf_dir, g=None):
    g = g or _graphs(spark, sf_dir)
    headers, sources = _identified(spark, sf_dir)
    return g, headers, sources, final_graph.nested_graphs(headers, sources, g.nodes, final_graph.with_provenance(g.edges, "default"), g.units)


@_register("b9_fact_graph", "WITH " + _SPANS.strip() + "," + _NESTED + " SELECT doc_id, sha256(j) AS graph_hash, length(j)::BIGINT AS chars FROM whole")
def b9(spark, sf_dir):
    text = final_graph.graph_json(F.col("graph"))
    return _nested(spark, sf_dir)[3].select(F.col("g").alias("doc_id"), F.sha2(text, 256).alias("graph_hash"), F.length(text).cast("long").alias("chars"))


@_register("b9_read_back", _sql("""
SELECT d.doc_id, (SELECT count(*) FROM nodes n WHERE n.doc_id = d.doc_id)::BIGINT AS nodes, (SELECT count(*) FROM edges e WHERE e.doc_id = d.doc_id)::BIGINT AS edges,
  (SELECT count(*) FROM named s WHERE s.doc_id = d.doc_id)::BIGINT AS units FROM documents d"""))
def b9_back(spark, sf_dir):
    text = write_table(_nested(spark, sf_dir)[3].select(final_graph.graph_json(F.col("graph")).alias("value")), "fact-graphs")
    out = final_graph.read_graphs(text)
    return out.select(F.regexp_extract("g", "([0-9]+)$", 1).cast("long").alias("doc_id"), F.size("graph.nodes").cast("long").alias("nodes"), F.size("graph.edges").cast("long").alias("edges"), F.size("graph.source.units").cast("long").alias("units"))


@_register("l2_final_graph_contract", _sql("""
SELECT rule, count(*)::BIGINT AS n FROM (
  SELECT 'support_level' AS rule FROM edges WHERE ordinal % 13 = 0 UNION ALL SELECT 'foreign_prompt' FROM edges WHERE ordinal % 17 = 0 UNION ALL SELECT 'provenance' FROM edges WHERE ordinal % 19 = 0
  UNION ALL SELECT 'blank_family' FROM edges WHERE ordinal % 23 = 0 UNION ALL SELECT 'no_local_entities' FROM nodes WHERE entity_id = 'E002' UNION ALL SELECT 'header_hash_form' FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 'header_prompt_id' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'foreign_prompt' FROM edges WHERE doc_id % 11 = 0 AND ordinal % 17 <> 0
  UNION ALL SELECT 'external_with_path' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'no_units' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = d.doc_id)
) GROUP BY rule"""))
def l2(spark, sf_dir):
    g, headers, sources, _ = _nested(spark, sf_dir)
    k = F.col("ordinal")
    provenance = F.struct(F.when(k % 17 == 0, "other").otherwise("default").alias("prompt_id"), F.when(k % 19 == 0, "guess").otherwise("fact_extraction").alias("source"))
    edges = g.edges.withColumns({"provenance": provenance, "support_level": F.when(k % 13 == 0, "MAYBE").otherwise(F.col("support_level")), "relation_family": F.when(k % 23 == 0, " ").otherwise(F.col("relation_family"))})
    nodes = g.nodes.withColumn("local_entity_ids", F.when(F.col("entity_id") != "E002", F.col("local_entity_ids")).otherwise(F.array().cast("array<string>")))
    headers = headers.withColumns({"manifest_identity_hash": F.when(F.col("g") % 7 == 0, "x").otherwise(F.col("manifest_identity_hash")), "prompt_id": F.when(F.col("g") % 11 == 0, "").otherwise(F.col("prompt_id"))})
    sources = sources.withColumn("repository_relative_path", F.when(F.col("g") % 5 == 0, "p"))
    return final_graph.contract_violations(headers, sources, nodes, edges, g.units).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@_register("l6_parity_report", _sql("""
SELECT d.doc_id AS graph_id, (SELECT count(*) FROM nodes n WHERE n.doc_id = d.doc_id)::BIGINT AS graph_node_count, (SELECT count(*) FROM nodes n WHERE n.doc_id = d.doc_id)::BIGINT AS store_node_count,
  (SELECT count(*) FROM edges e WHERE e.doc_id = d.doc_id)::BIGINT AS graph_edge_count, (SELECT count(*) FROM edges e WHERE e.doc_id = d.doc_id AND ordinal % 23 <> 0)::BIGINT AS store_edge_count,
  coalesce((SELECT string_agg(edge_id, '|' ORDER BY edge_id) FROM ided e WHERE e.doc_id = d.doc_id AND ordinal % 23 = 0), '') AS graph_only_edges,
  coalesce((SELECT string_agg(edge_id, '|' ORDER BY edge_id) FROM ided e WHERE e.doc_id = d.doc_id AND ordinal % 23 <> 0 AND ordinal % 13 = 0), '') AS source_target_mismatches,
  CASE WHEN d.doc_id % 4 = 0 THEN 'OTHER' ELSE '' END AS unexpected_node_labels,
  (SELECT count(*) FROM nodes n WHERE n.doc_id = d.doc_id AND entity_id = 'E001')::BIGINT AS property_mismatches,
  CASE WHEN d.doc_id % 4 = 0 OR EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = d.doc_id AND entity_id = 'E001') THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT DISTINCT doc_id FROM nodes) d"""))
def l6_report(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    owner = {"run_id": "r", "source_sha256": "s", "manifest_identity_hash": "m"}
    nodes, edges = write_table(g.nodes, "nodes", "g"), write_table(final_graph.with_provenance(g.edges, "default"), "edges", "g")
    k = F.col("ordinal")
    stored = edges.where("ordinal % 23 <> 0").withColumn("target_entity_id", F.when(k % 13 == 0, F.concat("target_entity_id", F.lit("x"))).otherwise(F.col("target_entity_id")))
    v, e = project.vertex_rows(nodes, owner), project.edge_rows(edges, owner)
    have = v.withColumns({"canonical_name": F.when(F.col("entity_id") == "E001", F.concat("canonical_name", F.lit("!"))).otherwise(F.col("canonical_name")), "label": F.when(F.col("graph_id") % 4 == 0, "OTHER").otherwise("FACT_ENTITY")})
    index = spark.createDataFrame([(n, "RANGE", [t], ["graph_id"]) for n, t in project.index_names("FACT_ENTITY", "FACT_RELATION").items()], INDEX_SCHEMA)
    out = parity.parity_report(v, e, have, project.edge_rows(stored, owner).withColumn("relation_type", F.lit("FACT_RELATION")), index, "FACT_ENTITY", "FACT_RELATION")
    return out.select("graph_id", "graph_node_count", "store_node_count", "graph_edge_count", "store_edge_count", *(F.array_join(c, "|").alias(c) for c in ("graph_only_edges", "source_target_mismatches", "unexpected_node_labels")),
                      F.size("node_property_mismatches").cast("long").alias("property_mismatches"), "status")


@_register("n4_observed_metrics", "WITH " + _SPANS.strip() + "," + _NESTED + """
SELECT d.doc_id AS g, sha256(w.j) AS graph_hash, (SELECT count(*) FROM nodes n WHERE n.doc_id = d.doc_id)::BIGINT AS nodes, (SELECT count(*) FROM edges e WHERE e.doc_id = d.doc_id)::BIGINT AS edges,
  (SELECT count(*) FROM named x WHERE x.doc_id = d.doc_id)::BIGINT AS unit_count, (SELECT count(*) FROM named x WHERE x.doc_id = d.doc_id AND span_no % 9 = 0)::BIGINT AS accepted_extractions,
  coalesce((SELECT string_agg(family || '=' || c, '|' ORDER BY family) FROM (SELECT doc_id, family, count(*) AS c FROM edges GROUP BY doc_id, family) f WHERE f.doc_id = d.doc_id), '') AS families
FROM documents d JOIN whole w ON w.doc_id = d.doc_id""")
def n4(spark, sf_dir):
    g, _, _, nested = _nested(spark, sf_dir, _graphs(spark, sf_dir, texts=True).written())
    totals = accounting.totals(accounting.unit_accounts(extract.gate_responses(_responses(g.spans)))).withColumnRenamed("doc_id", "g")
    graphs = write_table(nested.select("g", final_graph.graph_hash(F.col("graph")).alias("graph_hash")), "graph-hashes")
    out = report.observed_metrics(graphs, g.nodes, g.edges, g.units, totals, graphs.select("g", F.lit("passed").alias("status")))
    pairs = F.transform(F.map_entries("relation_family_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("g", "graph_hash", "nodes", "edges", "unit_count", F.coalesce("accepted_extractions", F.lit(0)).alias("accepted_extractions"), F.coalesce(F.array_join(pairs, "|"), F.lit("")).alias("families"))


@_register("c18_local_violations", _sql("""
SELECT rule, count(*)::BIGINT AS units FROM (
  SELECT DISTINCT 'duplicate_local_id' AS rule, doc_id, span_no FROM mentions WHERE span_no % 5 = 0 UNION ALL SELECT DISTINCT 'undeclared_endpoint', doc_id, span_no FROM edges WHERE span_no % 7 = 0 OR span_no % 5 = 0
  UNION ALL SELECT DISTINCT 'long_description', doc_id, span_no FROM edges WHERE span_no % 11 = 0 UNION ALL SELECT DISTINCT 'local_id_form', doc_id, span_no FROM mentions WHERE span_no % 5 = 0
) GROUP BY rule"""))
def c18(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    n = F.substring("span_id", 2, 20).cast("int")
    entities = g.entities.select(F.col("g").alias("doc_id"), F.col("unit").alias("unit_id"), "span_id", F.when(n % 5 == 0, "X").otherwise(F.col("local_id")).alias("local_id"))
    relations = g.relations.withColumns({"target_local_id": F.when(n % 7 == 0, "M0").otherwise(F.col("target_local_id")), "relation_description": F.when(n % 11 == 0, F.repeat("relation_description", 301)).otherwise(F.col("relation_description"))})
    return extract.local_violations(entities, relations).groupBy("rule").agg(F.count(F.lit(1)).alias("units"))
