"""Registered queries of service answers and of reads from the store, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import accounting, compatibility, embedding, project, report
from loomgraph.operators.store import GraphStore
from loomgraph.plans.queries import _COMPONENTS, _SPANS, ORACLE_SQL, _accounts, _register, _sql, _table, _thinned
from loomgraph.sources.shared import new_path, write_table


@_register("a13_probe_answers", """
SELECT doc_id, kind, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'FAIL' END AS result, coalesce(reason, '') AS classification, calls::BIGINT AS tool_calls, (k = 3) AS reasoning_present, (k = 2) AS truncated
FROM (
  SELECT *, CASE WHEN kind = 'plain' THEN CASE k WHEN 1 THEN 'PLAIN_CHAT_FAILED' WHEN 2 THEN 'OUTPUT_BUDGET_EXHAUSTED' WHEN 3 THEN 'CHAT_TEMPLATE_KWARGS_IGNORED_OR_UNSUPPORTED' WHEN 5 THEN 'PLAIN_CHAT_FAILED' END
              ELSE CASE k WHEN 1 THEN 'SERVER_TOOL_CHOICE_MODE_UNSUPPORTED' WHEN 2 THEN 'OUTPUT_BUDGET_EXHAUSTED' WHEN 3 THEN 'THINKING_DISABLE_PARAMETER_IGNORED' WHEN 4 THEN 'SERVER_TOOL_PARSER_MISSING'
                          WHEN 5 THEN 'MODEL_DID_NOT_CALL_TOOL' WHEN 6 THEN 'TOOL_PARSER_OR_MODEL_OUTPUT_INVALID' WHEN 7 THEN 'TOOL_PARSER_OR_MODEL_OUTPUT_INVALID' END END AS reason,
         CASE WHEN kind = 'tool' AND k NOT IN (3, 4, 5) THEN CASE WHEN k = 7 THEN 2 ELSE 1 END ELSE 0 END AS calls
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plain' ELSE 'tool' END AS kind, (doc_id // 2) % 8 AS k FROM documents)
)""")
def probe_answers(spark, sf_dir):
    """A service that answers each document in one of eight ways, every other time with a tool."""
    k, tool = F.floor(F.col("doc_id") / 2) % 8, F.col("doc_id") % 2 == 1
    call = lambda name: F.struct(F.struct(F.lit(name).alias("name"), F.to_json(F.struct(F.substring("text", 1, 40).alias("value"))).alias("arguments")).alias("function"))
    good, other = call(compatibility.PROBE_TOOL), call("another")
    calls = F.when(~tool | k.isin(3, 4, 5), F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")).when(k == 7, F.array(good, good)).when(k == 6, F.array(other)).otherwise(F.array(good))
    content = F.when(k == 4, F.concat(F.lit("<|tool_call_begin"), F.substring("text", 1, 20))).when(k == 5, F.when(tool, "no call")).when(~tool, F.lit("OK"))
    message = F.struct(content.alias("content"), F.when(k == 3, F.lit("let me think")).alias("reasoning"), calls.alias("tool_calls"))
    body = F.to_json(F.struct(F.array(F.struct(F.when(k == 2, "length").otherwise("stop").alias("finish_reason"), message.alias("message"))).alias("choices")))
    answers = _table(spark, sf_dir, "documents").select("doc_id", F.when(tool, "tool").otherwise("plain").alias("kind"), "text", F.when(k == 1, 500).otherwise(200).alias("http_status"), body.alias("body"))
    return compatibility.judge_answers(answers).select("doc_id", "kind", "result", F.coalesce("classification", F.lit("")).alias("classification"), "tool_calls", "reasoning_present", "truncated")


@_register("b6_embedding_answers", """
WITH placed AS (SELECT vec_id % 25 AS g, row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id) - 1 AS i, len(embedding) AS dim FROM embeddings),
batches AS (SELECT g, i // 4 AS batch, count(*) AS size, max(dim) AS dim FROM placed GROUP BY g, i // 4),
rules AS (
  SELECT g, batch, CASE WHEN g % 7 = 1 THEN 'http_status' WHEN g % 7 = 2 THEN 'count' WHEN g % 7 = 3 THEN 'index' WHEN g % 7 = 4 THEN 'vector' END AS rule FROM batches WHERE batch % 2 = 1
)
SELECT b.g, count(*)::BIGINT AS calls, sum(CASE WHEN b.g % 7 = 1 AND batch % 2 = 1 THEN 0 WHEN b.g % 7 = 2 AND batch % 2 = 1 THEN size - 1 ELSE size END)::BIGINT AS data_count,
       sum(CASE WHEN b.g % 7 = 1 AND batch % 2 = 1 THEN 0 ELSE size END)::BIGINT AS prompt_tokens,
       coalesce((SELECT string_agg(batch || ':' || rule, '|' ORDER BY batch) FROM rules r WHERE r.g = b.g AND rule IS NOT NULL), '')
         || CASE WHEN b.g % 7 IN (4, 5) AND count(*) > 1 THEN '|dimension' ELSE '' END AS violations
FROM batches b GROUP BY b.g""")
def embedding_answers(spark, sf_dir):
    """Answers of a service to each graph's batches of four vectors: out of order, and with a fault in every other batch of some graphs."""
    v = _table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("g"), "vec_id", "embedding")
    at = v.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("all"))
    parts = at.select("g", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 4).cast("int")), lambda i: F.slice("all", i * 4 + 1, 4))).alias("batch", "part"))
    fault = F.when(F.col("batch") % 2 == 1, F.col("g") % 7).otherwise(0)
    item = lambda x, i: F.struct(F.when((fault == 3) & (i == 0), i + 7).otherwise(i).alias("index"), F.when(fault == 4, F.slice(x["embedding"], 1, 0)).when(fault == 5, F.slice(x["embedding"], 2, 100)).otherwise(x["embedding"]).alias("embedding"))
    data = F.reverse(F.transform("part", item))
    data = F.when(fault == 2, F.slice(data, 2, 4)).otherwise(data)
    body = F.to_json(F.struct(data.alias("data"), F.struct(F.size("part").alias("prompt_tokens"), F.size("part").alias("total_tokens")).alias("usage")))
    answers = parts.select("g", F.col("batch").cast("long").alias("batch"), F.size("part").cast("long").alias("size"), F.when(fault == 1, 503).otherwise(200).alias("http_status"), F.when(fault != 1, body).alias("body"))
    read = write_table(embedding.read_answers(answers), "embedding-answers")
    said = embedding.embedding_violations(read).groupBy("g").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("batch").isNull().alias("joint"), "batch", "rule"))), lambda x: F.when(x["joint"], F.concat(F.lit("|"), x["rule"])).otherwise(F.concat(x["batch"].cast("string"), F.lit(":"), x["rule"]))), "|").alias("violations"))
    known = embedding.embedding_metadata(read, "m").select("g", "calls", "data_count", "prompt_tokens")
    return known.join(said, "g", "left").withColumn("violations", F.replace(F.coalesce("violations", F.lit("")), F.lit("||"), F.lit("|")))


@_register("q10_indexed_reads", """
WITH paths AS (
  SELECT c.c_nationkey::VARCHAR AS graph_id, 'o' || o_orderkey AS source, c_name AS target, c_acctbal AS balance, c.c_nationkey AS k
  FROM orders JOIN customer c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)
SELECT graph_id, count(*)::BIGINT AS paths, min(source) AS first_source, max(target) AS last_target FROM paths
WHERE (k % 5 <> 0 OR balance > 0) AND k IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY graph_id""")
def indexed_reads(spark, sf_dir):
    """Orders and customers of each nation as a namespace of a store; some are replaced by a later commit; a region's nations are read back by their ids."""
    t = lambda name: _table(spark, sf_dir, name)
    nation, customer = t("nation"), t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = customer.select(F.col("c_nationkey").cast("string").alias("graph_id"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_name").alias("display_name"), "c_acctbal", "c_custkey")
    orders = t("orders").join(own, F.col("o_custkey") == F.col("c_custkey")).select("graph_id", F.concat(F.lit("o"), "o_orderkey").alias("order"), "entity_id", "c_acctbal")
    vertices = own.select("graph_id", "entity_id", "display_name", "c_acctbal").unionByName(orders.select("graph_id", F.col("order").alias("entity_id"), F.col("order").alias("display_name"), "c_acctbal"))
    edges = orders.select("graph_id", F.concat(F.lit("r"), "order").alias("edge_id"), F.col("order").alias("source_entity_id"), F.col("entity_id").alias("target_entity_id"), F.lit("ordered by").alias("display_relation"), "c_acctbal")
    store = GraphStore(spark, new_path(spark, "store"))
    store.ensure_indexes()
    store.replace(vertices, edges, "first")
    later = lambda df: df.where((F.col("graph_id").cast("int") % 5 == 0) & (F.col("c_acctbal") > 0))
    store.replace(later(vertices), later(edges), "first")
    ids = [r["id"] for r in nation.where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("id")).collect()]
    found = project.all_paths(store.read("vertices", ids), store.read("edges", ids))
    return found.groupBy("graph_id").agg(F.count(F.lit(1)).alias("paths"), F.min("source").alias("first_source"), F.max("target").alias("last_target"))


_COUNTERS = (
    "primary_successful_calls", "primary_http_attempts", "primary_failed_attempts", "primary_timeout_attempts", "automatic_retries", "transport_successes", "transport_failures",
    "provider_response_rejections", "tool_contract_failures", "schema_failures", "evidence_failures", "accepted_extractions", "post_extraction_llm_calls", "prompt_tokens",
    "completion_tokens", "total_tokens", "embedding_calls",
)


@_register("n2_whole_report", "WITH RECURSIVE " + _sql(f"""
SELECT d.doc_id AS g, 'run_1' AS run_id, 'graph_' || d.doc_id AS graph_id, len(list_filter(regexp_split_to_array(d.t, '\\s+'), lambda w: w <> ''))::BIGINT AS source_words, coalesce(s.n, 0)::BIGINT AS units,
  {", ".join(f"coalesce(a.{c}, 0)::BIGINT AS {c}" for c in _COUNTERS)},
  coalesce(a.primary_http_attempts, 0)::BIGINT AS remote_model_calls, d.doc_id AS embedding_prompt_tokens, 2 * d.doc_id AS embedding_total_tokens,
  coalesce(s.reasons, '') AS finish_reasons, coalesce(s.n, 0)::BIGINT AS transports, coalesce(m.n, 0)::BIGINT AS local_entities, coalesce(m.n, 0)::BIGINT AS nodes_before_resolution,
  coalesce(e.n, 0)::BIGINT AS local_relations, coalesce(k.n, 0)::BIGINT AS global_entities, coalesce(k.n, 0)::BIGINT AS nodes, coalesce(e.kept, 0)::BIGINT AS edges,
  d.doc_id % 3 AS merged_entities, d.doc_id % 5 AS keep_separate_pairs, d.doc_id % 7 AS unresolved_merge_candidates, coalesce(p.components, 0)::BIGINT AS connected_components, coalesce(k.isolated, '') AS isolated_nodes,
  'graph_' || d.doc_id || '/' || d.doc_id % 11 || '/' || d.doc_id % 13 || '/FACT_ENTITY/FACT_RELATION' AS store, d.doc_id % 2 = 0 AS validation,
  0.3::DOUBLE AS candidate_threshold, 0.4::DOUBLE AS merge_threshold, 64 AS vector_dimension, d.doc_id * (d.doc_id - 1) // 2 AS unique_pair_count
FROM docs d LEFT JOIN acc a ON a.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(CASE WHEN span_no % 9 = 0 THEN 'stop' ELSE 'tool_calls' END, '|' ORDER BY span_no) AS reasons FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM mentions GROUP BY doc_id) m ON m.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (ordinal % 3 <> 0) AS kept FROM edges GROUP BY doc_id) e ON e.doc_id = d.doc_id
LEFT JOIN (
  SELECT n.doc_id, count(*) AS n, string_agg(n.entity_id, '|' ORDER BY n.entity_id) FILTER (x.a IS NULL) AS isolated
  FROM nodes n LEFT JOIN (SELECT DISTINCT doc_id, a FROM both_ways) x ON x.doc_id = n.doc_id AND x.a = n.entity_id GROUP BY n.doc_id
) k ON k.doc_id = d.doc_id
LEFT JOIN parts p ON p.doc_id = d.doc_id""", _SPANS.strip() + "," + _COMPONENTS + ", acc AS (" + ORACLE_SQL["e5_call_budget"] + ")").removeprefix("WITH "))
def whole_report(spark, sf_dir):
    """The run report with all its columns, of each document's graph without every third edge; lists and records as text."""
    g, nodes, edges, components = _thinned(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents")
    ids, name = docs.select(F.col("doc_id").alias("g")), F.concat(F.lit("graph_"), F.col("g").cast("string"))
    table = lambda **columns: ids.select("g", *(c.alias(k) for k, c in columns.items()))
    n, texts = F.col("g"), (F.array(F.lit("FACT_ENTITY")), F.array(F.lit("FACT_RELATION")))
    out = report.run_report(
        docs, g.spans, g.entities, g.relations.withColumnRenamed("doc_id", "g"), nodes, edges, components, headers=table(run_id=F.lit("run_1"), graph_id=name),
        accounts=accounting.totals(_accounts(spark, sf_dir)).withColumnRenamed("doc_id", "g"),
        resolution=table(merged_pairs=n % 3, keep_separate_pairs=n % 5, unresolved_pairs=n % 7, candidate_threshold=F.lit(0.3), merge_threshold=F.lit(0.4), vector_dimension=F.lit(64), unique_pairs=F.floor(n * (n - 1) / 2)),
        responses=g.spans.select(F.col("doc_id").alias("g"), "span_no", F.when(F.col("span_no") % 9 == 0, "stop").otherwise("tool_calls").alias("finish_reason"), F.lit("native_tool_call").alias("transport")),
        parity=ids.select(F.col("g").alias("graph_id"), (n % 11).alias("store_node_count"), (n % 13).alias("store_edge_count"), texts[0].alias("node_labels"), texts[1].alias("relationship_types")),
        validation=table(passed=n % 2 == 0), embedding_usage=table(prompt_tokens=n, total_tokens=2 * n))
    s = F.col("store")
    flat = {
        "embedding_prompt_tokens": F.col("embedding_usage.prompt_tokens"), "embedding_total_tokens": F.col("embedding_usage.total_tokens"), "validation": F.col("validation.passed"),
        "finish_reasons": F.coalesce(F.array_join("finish_reasons", "|"), F.lit("")), "transports": F.coalesce(F.greatest(F.size("transports"), F.lit(0)), F.lit(0)).cast("long"),
        "isolated_nodes": F.coalesce(F.array_join("isolated_nodes", "|"), F.lit("")),
        "store": F.concat_ws("/", F.concat(F.lit("graph_"), s["graph_id"]), s["nodes"].cast("string"), s["edges"].cast("string"), s["projection"]["entity_label"], s["projection"]["relation_type"]),
    }
    return out.select("g", *(flat.get(c, F.col(c)).alias(c) for c in report.REPORT if c != "embedding_usage"), *(flat[c].alias(c) for c in ("embedding_prompt_tokens", "embedding_total_tokens")))
