"""Whole runs: artifacts, gates, stores, and the commands over them."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.config import Provider, load_settings
from loomgraph.functions.ids import canonical_json, graph_id, sha256_json
from loomgraph.operators import compatibility, extract, final_graph, parity, project
from loomgraph.operators.store import INDEX_SCHEMA, GraphStore
from loomgraph.plans import golden
from loomgraph.plans import run as plan
from loomgraph.prompts import resolve_prompt
from loomgraph.sources import clients, probe, runs
from loomgraph.sources.shared import write_table

TEXT = "Policy applies to servers.\r\nServers need patches."


def embeddings(vectors):
    """What an embedder gives back, from a table with ``vector``."""
    meta = vectors.groupBy("g").agg(F.lit(1).cast("long").alias("calls"), F.lit(7).cast("long").alias("prompt_tokens"), F.lit(7).cast("long").alias("total_tokens"))
    return clients.Embeddings(vectors.select("g", "ord", "vector"), meta)


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("runs")
    (path / "in").mkdir()
    (path / "in/a.txt").write_bytes(TEXT.encode())
    (path / "in/b.txt").write_bytes("Cats like warm milk. Dogs chase grey cats.".encode())
    (path / "in/same.txt").write_bytes(TEXT.replace("\r\n", "\n").encode())
    args = ["build", "--input", str(path / "in"), "--output", str(path / "out"), "--store", str(path / "store"), "--run-id", "run_1", "--root", str(path)]
    assert cli.main(args) == 0
    with pytest.raises(FileExistsError):
        cli.main(args)
    return path


def test_artifacts_fit_together(spark, finished):
    out = f"{finished}/out/run_1"
    graphs = [json.loads(r["value"]) for r in spark.read.text(f"{out}/fact_graph").collect()]
    assert len(graphs) == 2  # two different texts
    for g in graphs:
        text = canonical_json(g)
        assert text in {r["value"] for r in spark.read.text(f"{out}/fact_graph").collect()}
        one = spark.createDataFrame([(text,)], "value string")
        assert final_graph.read_graphs(one).select(final_graph.graph_hash(F.col("graph")).alias("h")).first()["h"] == sha256_json(g)
        source = g["source"]
        digest, gid = graph_id("run_1", {
            "source_sha256": source["source_sha256"], "prompt_hash": g["prompt_hash"], "contract_id": "span_semantic_temporal", "provider_profile_id": "default",
            "schema_hash": json.load(open(f"{out}/prompt_manifest.json"))["request_identity"]["schema_hash"]})
        assert (g["graph_id"], g["manifest_identity_hash"]) == (gid, digest) and source["repository_relative_path"].startswith("in/")
    reports = {r["graph_id"]: r for r in spark.read.json(f"{out}/run_report").collect()}
    assert all(r["validation"]["passed"] and r["store"]["nodes"] == r["nodes"] == r["global_entities"] and r["accepted_extractions"] == r["units"] == 2 for r in reports.values())
    assert {r["status"] for r in spark.read.json(f"{out}/edge_diff").collect()} == {"passed"}
    assert plan.check_run(spark, f"{finished}/out", "run_1").count() == 0
    assert [r["error"] for r in plan.check_run(spark, f"{finished}/out", "none").limit(1).collect()] == ["missing artifact: fact_graph"]


def test_commands(spark, finished, capsys):
    out, store = str(finished / "out"), str(finished / "store")
    assert cli.main(["paths", "--store", store]) == 0
    assert "Policy -[applies to]-> servers" in capsys.readouterr().out and cli.main(["paths", "--store", str(finished / "none")]) == 2
    assert cli.main(["rebuild", "--outputs", out, "--run-id", "run_1", "--store", str(finished / "again")]) == 0
    assert GraphStore(spark, str(finished / "again")).read("edges").count() == GraphStore(spark, store).read("edges").count()
    assert cli.main(["open", "--outputs", out, "--store", store, "--latest", "--show-query"]) == 0
    assert "MATCH p" in capsys.readouterr().out
    assert cli.main(["open", "--outputs", out, "--store", store, "--run-id", "other"]) == 2
    assert cli.main(["conformance", "--outputs", out, "--artifact-run", "run_1"]) == 0
    (finished / "types.json").write_text('{"store": {"entity_label": "THING"}}')
    with pytest.raises(ValueError, match="stored as"):
        cli.main(["rebuild", "--outputs", out, "--run-id", "run_1", "--store", str(finished / "other"), "--config", str(finished / "types.json")])
    found = runs.select_run(spark, out)
    assert found["run_id"] == "run_1" and runs.select_run(spark, out, graph_id=found["graph_id"])["graph_id"] == found["graph_id"]
    for bad in ({"run_id": "x", "graph_id": "y"}, {"run_id": "a/b"}, {"graph_id": "y"}):
        with pytest.raises(ValueError):
            runs.select_run(spark, out, **bad)


def test_runs_that_cannot_be_trusted_are_left_out(spark, finished, tmp_path):
    import shutil

    shutil.copytree(f"{finished}/out/run_1", tmp_path / "run_2")  # names another run
    shutil.copytree(f"{finished}/out/run_1", tmp_path / "half")
    shutil.rmtree(tmp_path / "half/edge_diff")
    assert runs.successful_graphs(spark, str(tmp_path)).count() == 0 and runs.successful_graphs(spark, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(LookupError):
        runs.select_run(spark, str(tmp_path))
    runs.write_json(spark, f"{tmp_path}/x.json", {"a": 1})
    runs.write_json(spark, f"{tmp_path}/x.json", {"a": "é"})
    assert runs.read_json(spark, f"{tmp_path}/x.json") == {"a": "é"} and not list(tmp_path.glob(".*part"))
    runs.write_text(spark, f"{tmp_path}/y.json", "[1]")
    with pytest.raises(ValueError):
        runs.read_json(spark, f"{tmp_path}/y.json")


def _arguments(raw="feeds", status="facts_present", surface=None):
    e = [{"canonical_name": n, "entity_type": "T"} for n in ("Alpha", "Beta")]
    r = [{"source_entity_index": 0, "target_entity_index": 1, "relation_family": "DATA_FLOW", "raw_relation": raw, "condition": None, "modality": None, "quantity": None, "version": None, "negated": False}]
    return json.dumps({"status": status, "entities": e, "relations": r, "temporal_bindings": [{"relation_index": 0, "surface": surface}] if surface else [], "no_graph_fact_reason": None})


def test_a_run_ends_at_its_first_gate(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha feeds Beta in May. More here.", "a.txt")], "doc_id long, text string, source string")
    store, settings = GraphStore(spark, f"{tmp_path}/store"), load_settings(environment={})
    recorded = lambda *rows: plan.replayed_responses(spark.createDataFrame(list(rows), "unit_id string, arguments string"))
    with pytest.raises(plan.RunFailed) as failed:
        plan.run(spark, docs, str(tmp_path), store, settings, "r1", recorded(("U001_S001", _arguments(surface="in June"))))
    assert failed.value.category == plan.EXTRACTION_FAILED and store.version() is None
    ended = json.load(open(tmp_path / "r1/terminal_failure.json"))
    assert ended["rule_category"] == plan.EXTRACTION_FAILED and {e["terminal_subcategory"] for e in ended["examples"]} == {"temporal_evidence_failed", "timeout"}
    good = recorded(("U001_S001", _arguments(surface="in May")), ("U001_S002", _arguments(raw="M001 feeds")))
    embedder = lambda e: embeddings(e.withColumn("vector", F.when(F.col("name") == "Alpha", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))))
    out = plan.run(spark, docs, str(tmp_path), store, settings, "r2", good, embedder).first()
    assert (out["nodes"], out["edges"], out["embedding_calls"], out["vector_dimension"], out["unique_pair_count"]) == (2, 2, 1, 2, 6)
    assert tuple(out["embedding_usage"]) == (7, 7)
    edge = [x for r in spark.read.text(f"{tmp_path}/r2/fact_graph").collect() for x in json.loads(r["value"])["edges"] if x["qualifiers"]["temporality"]]
    assert edge[0]["qualifiers"]["temporality"] == "in May" and edge[0]["provenance"] == {"prompt_id": "default", "source": "fact_extraction"}
    assert (tmp_path / "r2/entity_similarity").is_dir() and plan.check_run(spark, str(tmp_path), "r2").count() == 0


def test_golden_contract_offline(spark, tmp_path, capsys):
    (tmp_path / "sample.txt").write_text("Alpha feeds Beta in May.")
    (tmp_path / "recorded.json").write_text(json.dumps({"units": [{"unit_id": "U001_S001", "arguments": json.loads(_arguments(surface="in May"))}]}))
    contract = {
        "contract_version": "1", "fixture": "sample.txt", "structured_fixture": "recorded.json", "required_entities": ["Alpha"], "required_alias_merges": [], "required_separate_entities": [["Alpha", "Beta"]],
        "required_relations": [{"source": "Alpha", "raw_relation": "feeds", "target": "Beta"}], "forbidden_relations": [{"source": "Beta", "raw_relation": "feeds", "target": "Alpha"}],
        "required_qualifier_cases": [{"source": "Alpha", "raw_relation": "feeds", "field": "temporality", "value": "in May"}], "call_budget": {"unit_count": 1, "primary_http_attempts": 1, "automatic_retries": 0},
        "projection_contract": {"node_label": "FACT_ENTITY", "relationship_type": "FACT_RELATION", "parity_status": "passed"},
    }
    (tmp_path / "contract.json").write_text(json.dumps(contract))
    args = ["golden", "--offline", "--manifest", f"{tmp_path}/contract.json", "--root", str(tmp_path)]
    assert cli.main([*args, "--outputs", f"{tmp_path}/out", "--run-id", "g1", "--json-output", f"{tmp_path}/report.json"]) == 0
    got = json.load(open(tmp_path / "report.json"))
    assert got["assertion_counts"]["passed"] == got["assertion_counts"]["total"] == 3 and got["observed_metrics"]["relation_family_distribution"] == {"DATA_FLOW": 1}
    bad = contract | {"required_entities": ["Gamma"], "call_budget": {"unit_count": 2}, "prompt_hash": "x", "fixture": "other.txt"}
    out = golden.compare(spark, f"{tmp_path}/out", "g1", bad, load_settings(environment={}))
    assert out["status"] == "failed" and [x.split(":")[0] for x in out["failed_assertions"]] == ["call_budget", "fixture", "prompt_hash", "required_entity"]


def test_parity_finds_every_difference(spark):
    owner = {"run_id": "r", "source_sha256": "s", "manifest_identity_hash": "m"}
    text = "graph_id string, entity_id string, canonical_name string, primary_type string, aliases array<string>, local_entity_ids array<string>, evidence_span_ids array<string>, display_name string"
    v = spark.createDataFrame([("g", f"E{i}", "n", "T", [], ["M001"], ["S001"], "n") for i in (1, 2)], text).withColumns({k: F.lit(x) for k, x in owner.items()})
    q = F.struct(*(F.lit(None).cast("string").alias(k) for k in ("temporality", "condition")), F.lit("ASSERTED").alias("modality"), F.lit(False).alias("negated"), *(F.lit(None).cast("string").alias(k) for k in ("quantity", "version")))
    raw = spark.createDataFrame([("g", "R1", "E1", "E2", "feeds", "DATA_FLOW", "feeds", ["S001"], "EXPLICIT", "U1")], "g string, edge_id string, source_entity_id string, target_entity_id string, raw_relation string, relation_family string, relation_description string, evidence_span_ids array<string>, support_level string, unit_id string")
    e = project.edge_rows(final_graph.with_provenance(raw.withColumn("qualifiers", q), "default")).withColumns({k: F.lit(x) for k, x in owner.items()})
    kept = lambda df, **how: df.withColumns({"label": F.lit("FACT_ENTITY"), "relation_type": F.lit("FACT_RELATION"), **how})
    index = lambda *rows: spark.createDataFrame(list(rows), INDEX_SCHEMA)
    good = index(*((n, "RANGE", [t], ["graph_id"]) for n, t in project.index_names("FACT_ENTITY", "FACT_RELATION").items()))
    report = lambda vv, ee, ii=good, **how: parity.parity_report(v, e, vv, ee, ii, "FACT_ENTITY", "FACT_RELATION", **how).first()
    assert report(kept(v), kept(e))["status"] == "passed"
    r = report(kept(v.where("entity_id = 'E1'")).unionByName(kept(v.limit(1)).withColumn("entity_id", F.lit("E9"))), kept(e, target_entity_id=F.lit("E1"), raw_relation=F.lit("x")))
    assert (r["graph_only_nodes"], r["store_only_nodes"], r["source_target_mismatches"], r["status"]) == (["E2"], ["E9"], ["R1"], "failed") and "R1:raw_relation" in r["relationship_property_mismatches"]
    r = report(kept(v, label=F.lit("OTHER"), display_name=F.lit(None).cast("string")), kept(e.where("false")), index(("x", "RANGE", ["FACT_ENTITY"], ["graph_id"]), ("fact_entity_graph_id", "RANGE", ["OTHER"], ["id"])))
    assert r["missing_expected_node_labels"] == ["FACT_ENTITY"] and r["unexpected_node_labels"] == ["OTHER"] and r["graph_only_edges"] == ["R1"] and r["missing_expected_relationship_types"] == ["FACT_RELATION"]
    assert (r["missing_indexes"], r["unexpected_indexes"], r["misconfigured_indexes"]) == (["fact_relation_graph_id"], ["x"], ["fact_entity_graph_id"]) and "E1:display_name" in r["missing_required_node_properties"]
    twice = spark.createDataFrame([("g", "R1")], "graph_id string, edge_id string")
    stray = kept(e).unionByName(kept(e).withColumns({"graph_id": F.lit(None).cast("string"), "edge_id": F.lit("R5")})).unionByName(kept(e).withColumn("graph_id", F.lit(" ")))
    r = report(kept(v), stray, duplicates=twice, import_errors=twice)
    assert (r["duplicate_edges"], r["import_errors"], r["edges_without_graph_id"], r["unexpected_graph_ids"]) == (["R1"], ["R1"], ["R5"], [" "])


class ListSink:
    """No more than what the protocol asks of a sink."""

    def __init__(self):
        self.tables = {}

    def replace(self, vertices, edges, owner=None):
        self.tables = {"vertices": vertices.withColumn("label", F.lit("FACT_ENTITY")), "edges": edges.withColumn("relation_type", F.lit("FACT_RELATION"))}
        return "1"

    def read(self, table, graphs=None):
        return self.tables[table]

    def ensure_indexes(self):
        self.indexed = True

    def indexes(self):
        spark = self.tables["edges"].sparkSession
        return spark.createDataFrame([(n, "RANGE", [t], ["graph_id"]) for n, t in project.index_names("FACT_ENTITY", "FACT_RELATION").items()], INDEX_SCHEMA)


def test_any_sink_of_the_protocol_will_do(spark, finished):
    sink = ListSink()
    diff = plan.rebuild(spark, f"{finished}/out", "run_1", sink, load_settings(environment={}))
    assert sink.indexed and diff.count() == 2 and diff.where("status <> 'passed'").count() == 0
    # Without a commit's digests every property is compared.
    sink.tables["vertices"] = sink.tables["vertices"].withColumn("display_name", F.lit("x"))
    assert parity.parity_report(*(sink.tables[t].drop("label", "relation_type").withColumn("display_name", F.col("canonical_name")) if t == "vertices" else sink.tables[t].drop("relation_type") for t in ("vertices", "edges")),
                                sink.read("vertices"), sink.read("edges"), sink.indexes(), "FACT_ENTITY", "FACT_RELATION").where("status = 'failed'").count() == 2


def test_equal_stores_are_not_read(spark, tmp_path):
    """Of graphs whose digests agree no stored property is looked at; where one differs, all that differs is found."""
    v = spark.createDataFrame([(g, e, "n", [e]) for g in ("a", "b") for e in ("E1", "E2")], "graph_id string, entity_id string, canonical_name string, aliases array<string>")
    e = spark.createDataFrame([(g, "R1", "E1", "E2", "feeds") for g in ("a", "b")], "graph_id string, edge_id string, source_entity_id string, target_entity_id string, raw_relation string")
    store = GraphStore(spark, f"{tmp_path}/store")
    store.replace(v, e, "me")
    store.ensure_indexes()
    broken = lambda df, c: df.withColumn(c, F.raise_error(F.lit("a property was read")).cast("string"))
    whole = lambda nodes, edges: parity.parity_report(nodes, edges, store.read("vertices"), store.read("edges"), store.indexes(), "FACT_ENTITY", "FACT_RELATION", stored_digests=store.digests())
    keys = ("graph_id", "status", "graph_only_nodes", "node_property_mismatches", "source_target_mismatches", "misconfigured_indexes", "node_labels")
    seen = lambda df: sorted(tuple(map(str, (r[k] for k in keys if k != "status"))) for r in df.collect())
    blind = parity.parity_report(v, e, broken(store.read("vertices"), "canonical_name"), broken(store.read("edges"), "raw_relation"), store.indexes(), "FACT_ENTITY", "FACT_RELATION", stored_digests=store.digests())
    assert seen(blind) == [(g, "[]", "[]", "[]", "[]", "['FACT_ENTITY']") for g in "ab"]
    more = v.where("graph_id <> 'b' or entity_id <> 'E2'").withColumn("canonical_name", F.when(F.col("graph_id") == "b", "other").otherwise(F.col("canonical_name")))
    more = more.unionByName(spark.createDataFrame([("b", "E3", "n", ["E3"])], v.schema))
    got = {r["graph_id"]: r for r in whole(more, e).collect()}
    assert (got["b"]["graph_only_nodes"], got["b"]["store_only_nodes"], got["b"]["node_property_mismatches"]) == (["E3"], ["E2"], ["E1:canonical_name"]) and got["a"]["graph_only_nodes"] == []
    # The same as without digests.
    plain = parity.parity_report(more, e, store.read("vertices"), store.read("edges"), store.indexes(), "FACT_ENTITY", "FACT_RELATION")
    assert sorted(map(str, whole(more, e).collect())) == sorted(map(str, plain.collect()))


def test_contract_names_every_violation(spark, finished):
    tables = plan.read_run(spark, f"{finished}/out", "run_1")
    assert final_graph.contract_violations(**tables).count() == 0
    first = tables["edges"].select("g").first()["g"]
    worse = dict(tables)
    worse["headers"] = tables["headers"].withColumn("manifest_identity_hash", F.lit("xyz"))
    worse["sources"] = tables["sources"].withColumn("source_location_policy", F.lit("external"))
    worse["edges"] = tables["edges"].withColumns({"support_level": F.lit("MAYBE"), "provenance": F.struct(F.lit("other").alias("prompt_id"), F.lit("fact_extraction").alias("source"))})
    worse["nodes"] = tables["nodes"].withColumn("local_entity_ids", F.array().cast("array<string>"))
    rules = {r["rule"] for r in final_graph.contract_violations(**worse).where(F.col("g") == first).collect()}
    assert rules == {"header_hash_form", "external_with_path", "support_level", "foreign_prompt", "no_local_entities"}
    assert {r["rule"] for r in final_graph.contract_violations(**(tables | {"units": tables["units"].limit(0)})).collect()} >= {"no_units", "unknown_unit", "unknown_edge_span"}
    # Each of the five tables is read once, and their claims meet in one exchange (and one more makes the result distinct).
    written = {k: write_table(t, "contract-test") for k, t in tables.items()}
    whole = final_graph.contract_violations(**written)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 5
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_probe(spark):
    provider = Provider(url="http://x")
    call = lambda name, arguments: {"choices": [{"finish_reason": "tool_calls", "message": {"tool_calls": [{"function": {"name": name, "arguments": arguments}}]}}]}

    def post(url, body, timeout):
        if not body.get("tools"):
            return 200, json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": "OK"}}]})
        if body["tools"][0]["function"]["name"] == compatibility.PROBE_TOOL:
            return 200, json.dumps(call(compatibility.PROBE_TOOL, '{"value": "OK"}'))
        return 200, json.dumps(call(extract.TOOL, _arguments()))

    span = {"unit_id": "U001_S001", "span_id": "S001", "text": "Alpha feeds Beta."}
    contract = {"required_relations": [{"source": "Alpha", "raw_relation": "feeds", "target": "Beta"}, {"source": "Elsewhere", "raw_relation": "x", "target": "Beta"}], "forbidden_relations": [{"source": "Alpha", "raw_relation": "feeds", "target": "Beta"}],
                "required_qualifier_cases": [{"source": "Alpha", "raw_relation": "feeds", "field": "version", "value": "2"}]}
    out = probe.run_probe(spark, provider, "p", resolve_prompt(), span, 2, manifest=contract, post=post)
    assert out["status"] == "passed" and set(out["tool_matrix"]) == set(probe.MODES) and len(out["production"]) == 2
    assert [x.split(":")[0] for x in out["production"][0]["semantic_assertions"]["failures"]] == ["FORBIDDEN_CONTEXT_ENDPOINT", "QUALIFIER_RECALL_FAILURE"]
    answer = lambda body, status=200: (lambda u, b, t: (status, json.dumps(body)))
    message = lambda finish="stop", **m: {"choices": [{"finish_reason": finish, "message": m}]}
    reason = {(kind, frozenset(seen)): why for kind, why, seen in compatibility.REASONS}
    tools = {"SERVER_TOOL_CHOICE_MODE_UNSUPPORTED": answer({}, 500), "OUTPUT_BUDGET_EXHAUSTED": answer(message("length")), "THINKING_DISABLE_PARAMETER_IGNORED": answer(message(reasoning="hm")),
             "SERVER_TOOL_PARSER_MISSING": answer(message(content="<|tool_call_begin")), "MODEL_DID_NOT_CALL_TOOL": answer(message(content="no")), "TOOL_PARSER_OR_MODEL_OUTPUT_INVALID": answer(call("other", "{}"))}
    for why, p in tools.items():
        assert probe.run_probe(spark, provider, "p", resolve_prompt(), tools_only=True, post=p)["classification"] == why
    for why, body in (("CHAT_TEMPLATE_KWARGS_IGNORED_OR_UNSUPPORTED", message(content="x", reasoning="y")), ("OUTPUT_BUDGET_EXHAUSTED", message("length", content="x")), ("PLAIN_CHAT_FAILED", message())):
        assert probe.run_probe(spark, provider, "p", resolve_prompt(), post=answer(body))["classification"] == why
    assert probe.run_probe(spark, provider, "p", resolve_prompt(), span, 1, production_only=True, post=answer(message(content="x")))["classification"] == reason["production", frozenset()]
    timed = json.loads(_arguments()) | {"temporal_bindings": [{"relation_index": 0, "surface": "now"}]}
    out = probe.run_probe(spark, provider, "p", resolve_prompt(), span, 1, production_only=True, no_times=True, post=answer(call(extract.TOOL, json.dumps(timed))))
    assert out["production"][0]["semantic_assertions"]["failures"] == ["UNEXPECTED_TEMPORAL_BINDING"]
    used = answer(message(content="OK") | {"usage": {"prompt_tokens": 3, "completion_tokens": 1, "total_tokens": 4}})
    assert probe.run_probe(spark, provider, "p", resolve_prompt(), post=used)["plain_chat"]["total_tokens"] == 4
    unread = spark.createDataFrame([(0, "{}"), (1, json.dumps(call(extract.TOOL, "[]")))], "g int, body string")
    assert sorted(map(tuple, compatibility.semantic_failures(unread, *probe._contract(spark, contract, span["text"])).collect())) == [(0, "NO_TOOL_CALL"), (1, "SCHEMA_INVALID_RESPONSE")]
    with pytest.raises(ValueError):
        probe.run_probe(spark, provider, "p", resolve_prompt(), production_only=True, post=post)
