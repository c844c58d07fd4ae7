"""Audits of runs, replayed matrices, namespaces and viewer links."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgraph.functions.ids import relation_hash, sha256_json, vector_hash
from loomgraph.operators import audit, project, resolve
from loomgraph.operators.extract import TOOL
from loomgraph.sources import viewer

FACT = {
    "status": "facts_present", "entities": [{"canonical_name": "A", "entity_type": "T"}, {"canonical_name": "B", "entity_type": "T"}],
    "relations": [{"source_entity_index": 0, "target_entity_index": 1, "relation_family": "DATA_FLOW", "raw_relation": "Feeds  INTO", "condition": None,
                   "modality": None, "quantity": None, "version": None, "negated": False}],
    "temporal_bindings": [{"relation_index": 0, "surface": "in 2020"}], "no_graph_fact_reason": None,
}


def response(arguments=FACT, finish="tool_calls", calls=1, name=TOOL, details=None, **message):
    call = {"function": {"name": name, "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments)}}
    usage = {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5} | ({"completion_tokens_details": details} if details else {})
    return json.dumps({"choices": [{"finish_reason": finish, "message": {**message, "tool_calls": [call] * calls}}], "usage": usage})


def evaluated(spark, bodies, **how):
    rows = [(i, "A feeds into B in  2020.", 200, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "i int, text string, http_status int, body string")
    return {r["i"]: r for r in audit.evaluate_responses(df, **how).collect()}


def test_responses_are_evaluated_whole(spark):
    missing = {k: v for k, v in FACT.items() if k != "status"}
    elsewhere = FACT | {"temporal_bindings": [{"relation_index": 0, "surface": "in 1999"}]}
    bodies = [
        response(), response(finish="length"), response(reasoning="because"), response(content="<think>x"), response(calls=2), response(name="other"),
        response("[1]"), response("{"), response(missing), response(elsewhere), response(finish="other"), None, "nonsense", '{"choices":[]}',
    ]
    out = evaluated(spark, bodies)
    assert [i for i, r in out.items() if r["result"] == "PASS"] == [0, 10]
    assert [i for i, r in evaluated(spark, bodies, finish_reasons=audit.FINISH_REASONS).items() if r["result"] == "PASS"] == [0]
    assert [i for i, r in evaluated(spark, bodies, policy="allow_nonempty").items() if r["result"] == "PASS"] == [2]
    assert out[0]["relation_hashes"] == [hashlib.sha256(b"feeds into").hexdigest()] and out[0]["relation_families"] == ["DATA_FLOW"]
    assert out[1]["truncated"] and out[2]["reasoning_separated"] and out[3]["special_marks_present"] and out[3]["content_and_tool_coexist"]
    assert out[4]["tool_calls"] == 2 and not out[4]["correct_function"] and not out[5]["correct_function"]
    assert not out[6]["arguments_json_object"] and not out[7]["arguments_json_object"] and out[9]["contract_valid"] and not out[9]["evidence_valid"]
    assert "MISSING_REQUIRED_FIELD" in out[8]["failure_categories"] and out[11]["tool_calls"] == 0
    assert out[0]["argument_hash"] == sha256_json(FACT) and out[7]["argument_hash"] is None and out[6]["argument_hash"] is None
    assert out[0]["entities_is_array"] and out[0]["relations_is_array"] and not out[6]["entities_is_array"] and (out[0]["prompt_tokens"], out[0]["total_tokens"]) == (3, 5)
    ids = lambda *v: response(FACT | {"entities": [e | {"local_id": i} for e, i in zip(FACT["entities"], v)]}, details={"reasoning_tokens": 4})
    named = evaluated(spark, [ids("M001", "M002"), ids("M001", "X2"), ids("E1")])
    assert ["INVALID_LOCAL_ID" in named[i]["failure_categories"] for i in range(3)] == [False, True, True] and named[0]["reasoning_tokens"] == 4
    with pytest.raises(ValueError):
        evaluated(spark, bodies, policy="sometimes")


def test_reasoning_is_cut_out(spark):
    bodies = [response(reasoning="why", reasoning_content="so", content="kept", details={"reasoning_tokens": 7}), response(reasoning=""), response(), "{broken \"reasoning\"", None]
    got = {r["i"]: r for r in audit.discard_reasoning(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).collect()}
    assert got[0]["reasoning_present"] and got[0]["reasoning_tokens"] == 7
    message = json.loads(got[0]["body"])["choices"][0]["message"]
    assert set(message) == {"content", "tool_calls"} and message["content"] == "kept"
    assert not got[1]["reasoning_present"] and "reasoning" not in got[1]["body"]
    assert [got[i]["body"] for i in (2, 3, 4)] == bodies[2:] and got[2]["reasoning_tokens"] is None


def test_validation_and_completion(spark):
    spans = spark.createDataFrame([(i, "S001") for i in range(4)], "doc_id long, span_id string")
    relations = spark.createDataFrame([(0, "S001"), (1, "S009"), (1, "S009")], "doc_id long, span_id string")
    bodies = spark.createDataFrame([(0, response()), (2, response(finish="length")), (3, None)], "doc_id long, body string")
    parity = spark.createDataFrame([(3,)], "graph_id long")
    out = audit.validation_report(bodies, relations, spans, parity)
    assert {r["g"]: (r["invalid_finish_reasons"], r["unknown_evidence"], r["parity_differences"], r["passed"]) for r in out.collect()} == {
        0: (0, 0, 0, True), 1: (0, 1, 0, False), 2: (1, 0, 0, False), 3: (0, 0, 1, False)}
    done = audit.completion_status(out).collect()
    assert [r["g"] for r in done] == [0] and done[0]["run_status"] == "completed" and set(done[0]) == {0, "completed", "passed"}


def test_saved_matrix_must_fit(spark):
    import numpy as np

    rows = [(g, i + 1, f"M{i + 1:03d}", [float(x) for x in np.random.default_rng(i).standard_normal(4)]) for g, n in ((0, 7), (1, 2), (2, 1)) for i in range(n)]
    vectors = spark.createDataFrame(rows, "g int, ord int, local_id string, vector array<double>")
    entities = vectors.drop("vector")
    matrix = resolve.similarity_matrix(vectors, 3)
    assert matrix.groupBy("g").count().orderBy("g").collect() == [(0, 6), (1, 1), (2, 1)]
    got = {(r["g"], r["l"], r["r"]): r["similarity"] for r in resolve.saved_matrix_pairs(entities, matrix, 3).collect()}
    want = {(g, a, b): float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for g, a, _, v in rows for h, b, _, w in rows if g == h and a < b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 and got[k] == round(got[k], 6) for k in want)
    other = entities.withColumn("local_id", F.when(F.col("ord") == 5, "M999").otherwise(F.col("local_id")))
    more = entities.unionByName(spark.createDataFrame([(1, 3, "M003")], entities.schema))
    for who, what in ((other, matrix), (entities.where("ord < 7"), matrix), (more, matrix), (entities, matrix.where("bl = br")), (entities, matrix.where("g = 0")), (entities, matrix.withColumn("cells", F.substring("cells", 1, 8)))):
        with pytest.raises((ValueError, PySparkException), match="does not belong"):
            resolve.saved_matrix_pairs(who, what, 3).collect()


def test_namespaces_and_import_errors(spark):
    v = spark.createDataFrame([("a", "E1", "x", "N"), ("a", "E2", "x", "N"), (" ", "E1", "y", "N")], "graph_id string, entity_id string, owner string, label string")
    e = spark.createDataFrame([("a", "R1", "E1", "E2", "z", "L"), ("a", "R2", "E1", "E9", "x", "L"), (None, "R3", "E1", "E2", "x", "L")],
                              "graph_id string, edge_id string, source_entity_id string, target_entity_id string, owner string, relation_type string")
    got = {r["graph_id"]: r for r in project.namespaces(v, e).collect()}
    assert got["a"]["owners"] == ["x", "z"] and (got["a"]["nodes"], got["a"]["relationships"]) == (2, 2) and got[" "]["relation_types"] == []
    assert {(r["edge_id"], r["end"]) for r in project.import_errors(v, e).collect()} == {("R2", "target"), ("R3", "source"), ("R3", "target")}
    assert [r["edge_id"] for r in project.edges_without_graph(e).collect()] == ["R3"]
    assert {r["graph_id"] for r in project.blank_graphs(v, e).collect()} == {" ", None}


def test_hashes_equal_python(spark):
    vectors = [[0.1, 1e-7, -3.0, 1e22], [], None]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<double>").select(vector_hash(F.col("v")).alias("h"))
    assert [r["h"] for r in df.collect()] == [sha256_json(vectors[0]), sha256_json([]), None]
    got = spark.createDataFrame([(["Straße  X", ""],)], "r array<string>").select(relation_hash(F.col("r")).alias("h")).first()["h"]
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"strasse x", b"")]


def test_viewer_links(spark):
    cases = {"Bolt://me:pw@Host.example:7687/db?x=1": "bolt://host.example:7687", "http://[::1]:80/": "http://[::1]:80", "neo://h": "neo://h", "nothing": None, None: None, "a:///p": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", viewer.credential_free_address(F.col("u")).alias("a"))
    assert {r["u"]: r["a"] for r in df.collect()} == cases
    statement = viewer.path_statement("fact_extraction_run_1_abc", 10)
    link = viewer.browser_link(spark, "http://b/?", "bolt://me:pw@h:1", "graphs", statement)
    assert link.startswith("http://b/?dbms=bolt%3A%2F%2Fh%3A1&db=graphs&cmd=edit&arg=MATCH") and "pw" not in link
    for bad in (lambda: viewer.path_statement("a b"), lambda: viewer.path_statement("a", 5001), lambda: viewer.browser_link(spark, "", "bolt://h", "d", "x"), lambda: viewer.browser_link(spark, "http://b", "h", "d", "x")):
        with pytest.raises(ValueError):
            bad()
