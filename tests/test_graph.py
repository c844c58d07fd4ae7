"""The evidence-graph engine on small tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import ids, text
from loomgraph.operators import accounting, components, extract, graph, neighbours, project, report, resolve
from loomgraph.operators.store import GraphStore, OwnershipError
from loomgraph.plans.build import build_graphs
from loomgraph.sources.shared import new_path

SAMPLE = "Version v1.2.3 ships 10.0.0.1 now. Really?Yes! It ends...\n\n  Второй абзац тут. tail without end\r\n\r\nLast."


def plain_spans(s):
    """The sentence rule, said plainly."""
    out, start = [], 0
    cuts = [i + 1 for i, c in enumerate(s) if c in "!?" or c == "." and (i + 1 == len(s) or s[i + 1].isspace())]
    for end in [*cuts, len(s)]:
        part = s[start:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((part.strip(), start + lead, start + lead + len(part.strip())))
        start = end
    return out


def test_spans_cut_and_keep_offsets(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, ""), (3, None), (4, " \n\n ")], "doc_id long, text string")
    got = text.document_spans(docs).orderBy("doc_id", "span_no").collect()
    whole = SAMPLE.replace("\r\n", "\n")
    assert {r["doc_id"] for r in got} == {1}
    assert all(whole[r["document_start"] : r["document_end"]] == r["text"] for r in got)
    assert [r["span_id"] for r in got] == [f"S{i:03d}" for i in range(1, len(got) + 1)]
    expected = [s for unit in re.split(r"\n\s*\n", whole) for s, _, _ in plain_spans(unit)]
    assert [r["text"] for r in got] == expected
    assert [r["unit_no"] for r in got] == [1, 1, 1, 1, 2, 2, 3]


def test_edge_id_is_stable(spark):
    q = F.struct(F.lit(None).cast("string").alias("temporality"), F.lit(None).cast("string").alias("condition"), F.lit("ASSERTED").alias("modality"),
                 F.lit(False).alias("negated"), F.lit(None).cast("string").alias("quantity"), F.lit("E_VERSION").alias("version"))
    row = spark.range(1).select(ids.edge_id(F.lit("E_POLICY"), F.lit("applies_in_version"), F.lit("E_VERSION"), F.array(F.lit("S001")), q).alias("x")).first()
    assert row["x"] == "R_2182522958e1b32b"


@pytest.mark.parametrize("s", ['plain', 'a"b\\c', "tab\tnew\nline", "\x1f\x0b", "é ü", "\\u001F stays"])
def test_json_string_matches_python(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(ids.json_string(F.col("s")).alias("j")).first()["j"] == json.dumps(s, ensure_ascii=False)


def _arguments(**change):
    base = {
        "status": "facts_present", "entities": [{"canonical_name": "A", "entity_type": "T"}, {"canonical_name": "B", "entity_type": "T"}],
        "relations": [{"source_entity_index": 0, "target_entity_index": 1, "relation_family": "DATA_FLOW", "raw_relation": "feeds", "condition": None,
                       "modality": None, "quantity": None, "version": None, "negated": False}],
        "temporal_bindings": [{"relation_index": 0, "surface": "in  May"}], "no_graph_fact_reason": None,
    }
    return json.dumps(base | change)


def _response(arguments=None, name=extract.TOOL, finish="tool_calls", reasoning=None, calls=1, choices=True):
    call = {"function": {"name": name, "arguments": arguments}}
    message = {"reasoning": reasoning, "tool_calls": [call] * calls}
    return json.dumps({"choices": [{"finish_reason": finish, "message": message}] if choices else [], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}})


def test_every_gate(spark):
    cases = [
        (200, _response(_arguments()), "accepted"), (None, None, "timeout"), (503, None, "http_error"), (200, _response(choices=False), "missing_choices"),
        (200, _response(_arguments(), finish="length"), "invalid_finish_reason"), (200, _response(_arguments(), reasoning="x"), "reasoning_policy_violation"),
        (200, _response(_arguments(), calls=2), "tool_contract_violation"), (200, _response(_arguments(), name="other"), "wrong_tool_name"),
        (200, _response("{no"), "malformed_arguments"), (200, _response(_arguments(entities=[])), "pydantic_validation_failed"),
        (200, _response(_arguments(extra=1)), "pydantic_validation_failed"), (200, _response(json.dumps({"status": "facts_present"})), "pydantic_validation_failed"),
        (200, _response(_arguments(temporal_bindings=[{"relation_index": 1, "surface": "x"}])), "pydantic_validation_failed"),
        (200, _response(_arguments(temporal_bindings=[{"relation_index": 0, "surface": "in June"}])), "temporal_evidence_failed"),
    ]
    rows = [(i, "A feeds B in\tMay.", h, b) for i, (h, b, _) in enumerate(cases)]
    gated = extract.gate_responses(spark.createDataFrame(rows, "i int, text string, http_status int, body string"))
    assert [r["terminal_subcategory"] for r in gated.orderBy("i").collect()] == [c[2] for c in cases]
    outcomes = dict(zip((c[2] for c in cases), (r["terminal_outcome"] for r in gated.orderBy("i").collect())))
    assert outcomes["timeout"] == outcomes["http_error"] == "transport_failed" and outcomes["wrong_tool_name"] == "tool_contract_failed" and outcomes["missing_choices"] == "provider_response_rejected"
    accounts = accounting.unit_accounts(gated.withColumns({"doc_id": F.lit(1), "unit_id": F.concat(F.lit("U"), F.col("i").cast("string"))}))
    total = accounting.totals(accounts).first()
    assert (total["units"], total["primary_http_attempts"], total["accepted_extractions"], total["transport_failures"], total["primary_timeout_attempts"]) == (14, 14, 1, 2, 1)
    assert (total["provider_response_rejections"], total["tool_contract_failures"], total["schema_failures"], total["evidence_failures"]) == (3, 3, 4, 1)
    assert (total["thinking_responses"], total["schema_valid_extractions"], total["persisted_span_units"], total["total_tokens"]) == (1, 2, 0, 60)
    broken = {}
    for r in accounting.account_violations(accounts).collect():
        broken.setdefault(r["unit_id"], set()).add(r["rule"])
    assert broken["U0"] == {"one unit kept"} and broken["U1"] == {"one successful call", "one accepted extraction", "one valid schema", "one valid evidence", "one unit kept"}
    assert "one valid schema" not in broken["U13"] and "one valid evidence" in broken["U13"]


def test_accounts_of_a_sound_run(spark):
    rows = [(1, f"U{i}", "accepted", "accepted", 3, 2, False, False) for i in range(3)] + [(2, "U0", "accepted", "accepted", 1, 1, False, True), (2, "U0", "accepted", "accepted", 1, 1, True, False)]
    attempts = spark.createDataFrame(rows, "doc_id int, unit_id string, terminal_outcome string, terminal_subcategory string, prompt_tokens int, completion_tokens int, forbidden boolean, automatic_retry boolean")
    calls = spark.createDataFrame([(1, 1)], "doc_id int, calls int")
    accounts = accounting.unit_accounts(attempts.withColumn("reasoning_present", F.lit(False)), embedding_calls=calls)
    assert {(r["doc_id"], r["unit_id"]) for r in accounts.where("embedding_calls = 1").collect()} == {(1, "U0")}
    assert {(r["doc_id"], r["rule"]) for r in accounting.account_violations(accounts).collect()} == {(2, "no call after extraction")}
    two = accounting.totals(accounts).where("doc_id = 2").first()
    assert (two["automatic_retries"], two["post_extraction_llm_calls"], two["primary_http_attempts"], two["total_tokens"]) == (1, 1, 1, 2)


def test_graph_from_text_is_sound(spark):
    docs = spark.createDataFrame([(1, "Policy applies to servers. SERVERS need the policy. Too short."), (2, "x")], "doc_id long, text string")
    g = build_graphs(docs)
    nodes = {r["entity_id"]: r for r in g.nodes.collect()}
    assert nodes["E001"]["canonical_name"] == "Policy" and nodes["E001"]["aliases"] == ["policy"] and nodes["E002"]["aliases"] == ["SERVERS"]
    assert [(r["source_entity_id"], r["raw_relation"], r["target_entity_id"]) for r in g.edges.orderBy("ordinal").collect()] == [("E001", "applies to", "E002"), ("E002", "need the", "E001")]
    assert graph.graph_violations(g.nodes, g.edges, g.units).count() == 0
    assert graph.graph_components(g.nodes, g.edges).first()["components"] == 1
    edges = g.edges.unionByName(g.edges.limit(1)).withColumn("target_entity_id", F.when(F.col("ordinal") == 2, "E9").otherwise(F.col("target_entity_id")))
    assert {r["rule"] for r in graph.graph_violations(g.nodes, edges, g.units).collect()} == {"duplicate_edge", "dangling_target"}
    again = build_graphs(docs.repartition(3, "doc_id"))
    assert sorted(r["edge_id"] for r in again.edges.collect()) == sorted(r["edge_id"] for r in g.edges.collect())


def test_qualifiers_are_rebound(spark):
    schema = "g int, ordinal int, source_local_id string, target_local_id string, raw_relation string, relation_family string, relation_description string, span_id string, unit_id string, support_level string, qualifiers struct<temporality:string,condition:string,modality:string,negated:boolean,quantity:string,version:string>"
    row = lambda i, v, t="M002": (0, i, "M001", t, "r", "DATA_FLOW", "r", "S001", "U001_S001", "EXPLICIT", (None, None, "ASSERTED", False, None, v))
    resolved = spark.createDataFrame([(0, "M001", "E001"), (0, "M002", "E002")], "g int, local_id string, entity_id string")
    out = graph.project_edges(spark.createDataFrame([row(1, "M002"), row(2, "M100 motorway"), row(3, None, "M009")], schema), resolved).orderBy("ordinal").collect()
    assert out[0]["qualifiers"]["version"] == "E002" and out[0]["unresolved"] == []
    assert out[1]["unresolved"] == ["version"] and out[2]["unresolved"] == ["target"]


def _decide(spark, pairs, names=("Alpha", "alpha", "Alpha Beta", "Gamma"), relations=(), units=("U1", "U2", "U3", "U4"), **how):
    e = spark.createDataFrame([(0, i + 1, f"M{i + 1:03d}", n, "T" if i < 3 else "X", u, "S001") for i, (n, u) in enumerate(zip(names, units))],
                              "g int, ord int, local_id string, name string, type string, unit string, span_id string")
    r = spark.createDataFrame(list(relations), "g int, l int, r int, raw_relation string, family string, relation_id string, spans array<string>")
    p = spark.createDataFrame(pairs, "g int, l int, r int, similarity double")
    out = resolve.decide(e, r, p, **how)
    return e, out, {(x["l"], x["r"]): (x["decision"], x["reason"]) for x in out.collect()}


def test_decision_cascade(spark):
    pairs = [(0, 1, 2, 0.95), (0, 1, 3, 0.99), (0, 1, 4, 0.95), (0, 2, 3, 0.8), (0, 2, 4, 0.1), (0, 3, 4, 0.798407)]
    _, _, got = _decide(spark, pairs)
    assert got[1, 2] == ("MERGE", "similar with context") and got[1, 3] == ("UNRESOLVED", "name expansion") and got[1, 4] == ("UNRESOLVED", "no context")
    assert got[2, 3][0] == "UNRESOLVED" and got[2, 4][0] == "BELOW_CANDIDATE_THRESHOLD" and got[3, 4] == ("UNRESOLVED", "below merge threshold")
    _, _, got = _decide(spark, pairs, relations=[(0, 2, 4, "Also-known as", "F", "R1", ["S1"]), (0, 4, 1, "feeds", "F", "R2", ["S1"]), (0, 3, 4, "feeds", "F", "R3", [])])
    assert got[2, 4] == ("MERGE", "explicit equivalence") and got[1, 4] == ("KEEP_SEPARATE", "direct relation") and got[3, 4][0] == "UNRESOLVED"
    with pytest.raises(ValueError):
        resolve.check_thresholds(0.9, 0.8)


def test_typed_conflict_blocks(spark):
    e = spark.createDataFrame([(0, 1, "A", "T", "U1", "v1"), (0, 2, "A", "T", "U2", "v2")], "g int, ord int, name string, type string, unit string, semantic_version string")
    none = spark.createDataFrame([], "g int, l int, r int, raw_relation string, family string, relation_id string, spans array<string>")
    p = spark.createDataFrame([(0, 1, 2, 1.0)], "g int, l int, r int, similarity double")
    assert resolve.decide(e, none, p).first()["decision"] == "KEEP_SEPARATE"
    assert resolve.decide(e, none, p, decisions={"semantic_conflict_blocks_merge": False}).first()["decision"] == "MERGE"


def test_merges_are_transitive(spark):
    pairs = [(0, 1, 2, 0.95), (0, 2, 3, 0.95), (0, 1, 3, 0.1)]
    e, out, _ = _decide(spark, pairs, names=("A", "A", "A", "B"))
    got = {r["ord"]: r["entity_id"] for r in resolve.resolve(e, out).collect()}
    assert got == {1: "E001", 2: "E001", 3: "E001", 4: "E002"}


def test_rounding_is_pythons():
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate((rng.random(20_000) * 2 - 1, np.round(rng.random(20_000), 6) + 5e-7, [0.1234565, 0.5, -0.0000005, 1.0, 2.5e-6]))
    assert resolve.round6(x).tolist() == [round(float(v), 6) for v in x]


def _components_by_hand(edges):
    """{node: smallest node reachable} of (u, v)."""
    low = {x: x for e in edges for x in e}
    while any(low[u] != low[v] for u, v in edges):
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    return low


@pytest.mark.parametrize("kind", ["long", "string", "struct"])
def test_components_by_rounds(spark, kind):
    import random

    rng = random.Random(7)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (900, 900)]
    name = {"long": lambda x: x, "string": lambda x: f"n{x}é", "struct": lambda x: (str(x % 3), x)}[kind]
    ddl = {"long": "a long, b long", "string": "a string, b string", "struct": "a struct<g: string, o: long>, b struct<g: string, o: long>"}[kind]
    edges = [(name(u), name(v)) for u, v in rows]
    want = _components_by_hand(edges)
    df = spark.createDataFrame(edges + [(None, name(3))], ddl).repartition(5)
    plain = lambda x: tuple(x) if kind == "struct" else x
    assert {plain(r["node"]): plain(r["component"]) for r in components.connected_components(df, "a", "b").collect()} == want
    assert {plain(r["node"]): plain(r["component"]) for r in components.connected_components(df, "a", "b", contract=False).collect()} == want
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_of_edges_keep_what_they_connect(monkeypatch, block):
    import random

    import pyarrow as pa

    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    rng = random.Random(5)
    rows = sorted((f"g{rng.randrange(4)}", rng.randrange(30), rng.randrange(30)) for _ in range(50))
    edges = [(u, v) for _, u, v in rows if u != v]
    batches = lambda table: iter(table.to_batches(max_chunksize=3))
    table = pa.table({"u": [max(e) for e in edges], "v": [min(e) for e in edges]})
    stars = [(u, v) for b in components._contract(batches(table)) for u, v in zip(*(c.to_pylist() for c in b.columns))]
    assert len(stars) <= len(edges) and all(u > v for u, v in stars) and _components_by_hand(stars) == _components_by_hand(edges)
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate("guv")})
    got = {(g, k): c for b in components._finish_graphs(batches(table)) for g, k, c in zip(*(x.to_pylist() for x in b.columns))}
    assert got == {(g, k): c for g in {r[0] for r in rows} for k, c in _components_by_hand([(u, v) for h, u, v in rows if h == g]).items()}


@pytest.mark.parametrize("bound", [0, 12, 1000])
def test_each_graph_takes_its_own_way(spark, bound):
    """Graphs under the bound are finished by a task, the others in rounds; the result is the same."""
    import random

    rng = random.Random(11)
    rows = [(g, rng.randrange(20), rng.randrange(20)) for g in ("a", "b", None, "d") for _ in range({"a": 40, "b": 9}.get(g, 6))]
    rows += [("long", i, i + 1) for i in range(60)] + [("a", 5, None)]
    want = {}
    for g in {g for g, _, _ in rows}:
        want |= {(g, k): v for k, v in _components_by_hand([(u, v) for h, u, v in rows if h == g and v is not None]).items()}
    df = spark.createDataFrame(rows, "g string, a int, b int")
    got = components.graph_components(df, "g", "a", "b", bound).collect()
    assert {(r["g"], r["node"]): r["component"] for r in got} == want and len(got) == len(want)
    assert components.graph_components(df.limit(0), "g", "a", "b").count() == 0


def test_no_task_gets_all_graphs(spark):
    """Many graphs are dealt out: none of the tasks that finish them sees more than its share."""
    edges = spark.range(4000).select((F.col("id") % 200).alias("g"), F.col("id").alias("a"), (F.col("id") + 200).alias("b"))
    out = components.graph_components(edges, "g", "a", "b").withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < sum(sizes) * 0.5


def test_similar_pairs_blocks_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.standard_normal((23, 5))
    v[7] = v[3]
    rows = [(0, i + 1, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, ord int, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i + 1, j + 1): round(float(unit[i] @ unit[j]), 6) for i in range(23) for j in range(i + 1, 23)}
    got = {(r["l"], r["r"]): r["similarity"] for r in resolve.similar_pairs(df, 0.2, block=4).collect() if r["similarity"] >= 0.2}
    assert got.keys() == {k for k, s in want.items() if s >= 0.2} and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    near = resolve.top_neighbours(resolve.similar_pairs(df, 2.0, 3, block=4), 3).collect()
    for i in range(1, 24):
        order = sorted((j for j in range(1, 24) if j != i), key=lambda j: (-want[min(i, j), max(i, j)], -j))[:3]
        assert [r["neighbour"] for r in sorted(near, key=lambda r: r["rank"]) if r["ord"] == i] == order
    with pytest.raises(Exception, match="zero norm"):
        resolve.similar_pairs(spark.createDataFrame([(0, 1, [0.0]), (0, 2, [1.0])], df.schema), 0.1).collect()


def _clustered(groups, members, dim, spread, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    v = centres[rng.integers(0, groups, groups * members)] + spread * rng.standard_normal((groups * members, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("spread, floor, top_k", [(0.05, 0.9, None), (0.05, 2.0, 4), (0.6, 0.7, 3), (5.0, 0.8, None), (0.0, 0.99, None)])
def test_pruned_blocks_find_what_all_blocks_find(spark, spread, floor, top_k):
    v = _clustered(12, 20, 8, spread)
    v[5] = -v[7]
    rows = [("a", i + 1, x.tolist()) for i, x in enumerate(v)] + [("b", i + 1, x.tolist()) for i, x in enumerate(v[:9])]
    df = spark.createDataFrame(rows, "g string, ord int, vector array<double>")

    def found(few):
        pairs = neighbours.similar_pairs(df, floor, top_k, block=16, few=few)
        if top_k is not None:
            top = resolve.top_neighbours(pairs, top_k).collect()
            return sorted((r["g"], r["ord"], r["rank"], r["neighbour"], round(r["similarity"], 5)) for r in top)
        return sorted((r["g"], r["l"], r["r"], round(r["similarity"], 5)) for r in pairs.where(F.col("similarity") >= floor).collect())

    assert found(1) == found(1000)


def test_blocks_that_cannot_matter_are_skipped(spark):
    v = _clustered(40, 25, 16, 0.03)
    df = spark.createDataFrame([(0, i + 1, x.tolist()) for i, x in enumerate(v)], "g int, ord int, vector array<double>")
    blocks = neighbours.gather_blocks(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), 25)
    n = blocks.select("b").distinct().count()
    assert blocks.count() == 1000 and blocks.groupBy("b").count().agg(F.max("count")).first()[0] < 100
    for floor, top_k, share in ((0.9, None, 0.2), (2.0, 3, 0.4)):
        met = neighbours.meeting_blocks(blocks, floor, top_k)
        assert met.where("bl > br").count() == 0 and n <= met.count() < share * n * (n + 1) / 2


def test_store_replaces_and_keeps_owners_apart(spark):
    docs = spark.createDataFrame([(1, "Policy applies to servers."), (2, "Cats like warm milk.")], "doc_id long, text string")
    g = build_graphs(docs)
    v, e = project.vertex_rows(g.nodes), project.edge_rows(g.edges)
    store = GraphStore(spark, new_path(spark, "store"))
    store.replace(v, e, "me")
    assert project.parity(v, e, store.read("vertices"), store.read("edges")).count() == 0
    first = store.version()
    store.replace(v.where("graph_id = 1"), e.where("graph_id = 1"), "me")
    assert store.version() != first and store.read("vertices").count() == v.count()
    with pytest.raises(OwnershipError):
        store.replace(v, e, "you")
    with pytest.raises(ValueError, match="endpoints"):
        store.replace(v.where("entity_id <> 'E001'"), e, "me")
    assert project.parity(v, e, store.read("vertices"), store.read("edges")).count() == 0
    assert project.path_query(v, e, 1).count() == 1
    for bad in (0, 5001):
        with pytest.raises(ValueError):
            project.path_query(v, e, bad)


def test_store_survives_cut_off_writes(spark):
    v = lambda g, *es: spark.createDataFrame([(g, e) for e in es], "graph_id string, entity_id string")
    none = spark.createDataFrame([], "graph_id string, edge_id string, source_entity_id string, target_entity_id string")
    store = GraphStore(spark, new_path(spark, "store"))
    store.replace(v("a", "E1", "E2"), none, "me")
    store.replace(v("b", "E1"), none, "me")
    store.replace(v("a", "E3"), none, "me")
    seen = lambda: {(r["graph_id"], r["entity_id"]) for r in store.read("vertices").collect()}
    assert seen() == {("a", "E3"), ("b", "E1")} and [c["number"] for c in store._commits()] == [1, 2, 3]
    # A segment without a commit, and a commit that was cut off, count for nothing.
    store._write({"vertices": v("b", "E9"), "edges": none}, v("b", "x").select("graph_id"))
    fs, p = store._fs(f"{store.path}/log/{4:020d}")
    fs.create(p, False).close()
    assert seen() == {("a", "E3"), ("b", "E1")}
    # No two writers get one number.
    with pytest.raises(Exception, match="exist"):
        store._commit(4, "replace", {"segment": "s"})
    assert store.compact() == f"{5:020d}" and seen() == {("a", "E3"), ("b", "E1")} and len(store._commits()) == 1
    store.delete(v("a", "x"))
    assert seen() == {("b", "E1")} and store.read("vertices", v("a", "x")).count() == 0
    store.ensure_indexes()
    store.ensure_indexes()
    assert sorted(r["name"] for r in store.indexes().collect()) == ["fact_entity_graph_id", "fact_relation_graph_id"]
    assert project.index_names("PERSON", "KNOWS") == {"person_node_graph_id": "PERSON", "knows_relationship_graph_id": "KNOWS"}
    with pytest.raises(ValueError, match="differ"):
        GraphStore(spark, "/x", "SAME", "SAME")


def _small_graphs(spark, names, marker):
    v = spark.createDataFrame([(g, f"E{i}", marker) for g in names for i in (1, 2)], "graph_id string, entity_id string, canonical_name string")
    e = spark.createDataFrame([(g, "R1", "E1", "E2", marker) for g in names], "graph_id string, edge_id string, source_entity_id string, target_entity_id string, raw_relation string")
    return v, e


def test_reads_of_a_namespace_open_one_bucket_of_one_segment(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    for i in range(4):
        store.replace(*_small_graphs(spark, [f"g{i}-{j}" for j in range(30)], f"first {i}"), "me")
    files = lambda *graphs: {tuple(f.rsplit("/", 4)[1:4]) for f in store.read("edges", list(graphs)).inputFiles()}
    assert len({f[0] for f in files("g2-7")}) == 4 and len({f[2] for f in files("g2-7")}) == 1  # without indexes: the bucket of each segment
    store.ensure_indexes()
    segment = store._commits()[2]["segment"]
    assert {f[0] for f in files("g2-7")} == {segment} and len(files("g2-7")) == 1
    assert [r["raw_relation"] for r in store.read("edges", ["g2-7"]).collect()] == ["first 2"] and files("unknown") == set()
    # A namespace that is replaced later lies in both segments; the newer one counts.
    store.replace(*_small_graphs(spark, ["g2-7"], "second"), "me")
    assert len({f[0] for f in files("g2-7")}) == 2 and [r["raw_relation"] for r in store.read("edges", ["g2-7"]).collect()] == ["second"]
    every = store.read("edges")
    assert every.count() == 120 and store.read("edges", every.where("graph_id like 'g1-%'")).count() == 30
    # No id is ever lost to a filter.
    assert all(store.read("vertices", [g]).count() == 2 for g in ("g0-0", "g1-29", "g3-5", "g2-7"))


def test_small_segments_are_merged(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    for i in range(10):
        store.replace(*_small_graphs(spark, [f"g{i}", "again"], f"n{i}"), "me", batch=("s", i))
    assert len(store._commits()) <= 3
    seen = {r["graph_id"]: r["raw_relation"] for r in store.read("edges").collect()}
    assert seen == {f"g{i}": f"n{i}" for i in range(10)} | {"again": "n9"}
    # A batch that comes once more makes no commit.
    at = store.version()
    assert store.replace(*_small_graphs(spark, ["g3"], "replay"), "me", batch=("s", 9)) == at and store.version() == at
    store.delete(spark.createDataFrame([("g4",)], "graph_id string"))
    assert store.replace(*_small_graphs(spark, ["g11"], "other"), "me", batch=("t", 0)) != at and store.read("edges", ["g4"]).count() == 0
    store.compact()
    assert len(store._commits()) == 1 and store.read("edges").count() == 11 and store._commits()[0]["streams"] == {"s": 9, "t": 0}


def test_preflight_counts(spark):
    v = spark.createDataFrame([(g, e) for g in "ab" for e in ("E1", "E2")], "graph_id string, entity_id string").withColumn("display_name", F.col("entity_id"))
    e = spark.createDataFrame([("a", "R1", "E1", "E2", "a", "a"), ("a", "R2", "E1", "E2", "a", "b"), ("b", "R3", "E1", "E2", "b", "b"), ("b", "R4", "E1", "E9", "b", "b")],
                              "graph_id string, edge_id string, source_entity_id string, target_entity_id string, source_graph_id string, target_graph_id string").withColumn("display_relation", F.lit("r"))
    assert project.path_counts(v, e, "a").first().asDict() == {"unfiltered": 3, "source": 2, "relationship": 2, "target": 1, "all": 1}
    assert project.check_preflight(v, e, "b")["paths"] == 1
    for g, database, message in (("c", "", "exist"), ("a", "System", "system")):
        with pytest.raises(project.PreflightError, match=message):
            project.check_preflight(v, e, g, database=database)
    with pytest.raises(project.PreflightError, match="relationships") as failed:
        project.check_preflight(v, e.where("graph_id = 'a'"), "b")
    assert failed.value.diagnostics["nodes"] == 2


def test_names_are_compared_case_folded(spark):
    df = spark.createDataFrame([("Straße  neu", " STRASSE neu"), ("ΣΑΣ", "σας"), ("a\u2003b", "A B")], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(text.collapsed(F.col("a")), text.collapsed(F.col("b"))).collect())
    got = df.select(text.name_relation(F.trim("a"), F.trim("b")).alias("r"), text.relation_key(F.lit("Große Straße!")).alias("k")).collect()
    assert [r["r"] for r in got[1:2]] == ["CASE_ONLY"] and got[0]["k"] == "grosse_strasse"
    with pytest.raises(Exception, match="no paragraph"):
        text.split_units(spark.createDataFrame([(1, " \n ")], "doc_id int, text string"), empty="error").collect()


def test_resolution_in_one_call(spark):
    v = {1: [1.0, 0.0], 2: [1.0, 0.01], 3: [0.0, 1.0], 4: [0.9, 0.1], 5: [0.1, 1.0]}
    entities = spark.createDataFrame([(g, i, f"M{i:03d}", "Same" if i < 3 else f"N{i}", "T", f"U{i}", "S001") for g in (1, 2) for i in v], "g int, ord int, local_id string, name string, type string, unit string, span_id string")
    vectors = spark.createDataFrame([(g, i, x) for g in (1, 2) for i, x in v.items()], "g int, ord int, vector array<double>")
    none = spark.createDataFrame([(2, 3, 4, "same as", "F", "R1", ["S001"])], "g int, l int, r int, raw_relation string, family string, relation_id string, spans array<string>")
    out = resolve.resolve_entities(entities, vectors, none, 0.7, 0.9)
    ids = {(r["g"], r["ord"]): r["entity_id"] for r in out.entities.collect()}
    assert ids[1, 1] == ids[1, 2] == "E001" and ids[1, 3] == "E002" and ids[2, 3] == ids[2, 4] and len({ids[1, i] for i in v}) == 4
    s = {r["g"]: r for r in out.summary.collect()}
    assert (s[1]["retrieval_method"], s[1]["top_k"], s[1]["unique_pairs"], s[1]["vector_dimension"]) == (resolve.METHODS[0], None, 10, 2)
    assert s[1]["candidate_pairs"] == s[1]["merged_pairs"] + s[1]["keep_separate_pairs"] + s[1]["unresolved_pairs"] and s[2]["merged_pairs"] == 2
    top = resolve.resolve_entities(entities, vectors, none, 0.7, 0.9, pairwise_limit=4, top_k=1)
    assert {r["retrieval_method"] for r in top.summary.collect()} == {resolve.METHODS[1]}
    near = {(r["l"], r["r"]) for r in top.candidates.where("g = 2").collect()}
    assert (3, 4) in near and (1, 2) in near and near < {(r["l"], r["r"]) for r in out.candidates.where("g = 2").collect()}
    with pytest.raises(ValueError, match="one vector"):
        resolve.resolve_entities(entities, vectors.where("ord < 5"), none)


def test_golden_contract(spark):
    g = build_graphs(spark.createDataFrame([(1, "Policy applies to servers. servers need the POLICY.")], "doc_id long, text string"))
    rel = lambda *rows: spark.createDataFrame(list(rows), "source string, raw_relation string, target string")
    two = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    out = report.compare_golden(g.nodes, g.edges, rel(("Policy", "applies to", "servers"), ("a", "b", "c")), rel(("servers", "need the", "Policy")), two(("Policy", "servers")), two(("Policy", "POLICY")),
                                entities=spark.createDataFrame([("Policy",), ("nobody",)], "name string"),
                                qualifiers=spark.createDataFrame([("Policy", "applies to", "modality", "ASSERTED"), ("Policy", "applies to", "version", "2"), ("x", "y", "negated", "false")], "source string, raw_relation string, field string, value string"))
    rows = out.collect()
    assert sorted(r["check"] for r in rows) == ["forbidden_relation", "required_entity", "required_merge", "required_qualifier", "required_qualifier", "required_relation", "required_separation"]
    negated = spark.createDataFrame([("Policy", "applies to", "servers", True)], "source string, raw_relation string, target string, negated boolean")
    empty = two().limit(0)
    assert [r["check"] for r in report.compare_golden(g.nodes, g.edges, negated, negated, empty, empty).collect()] == ["required_relation"]
    assert report.assertion_counts(out, 5, 1).first().asDict() == {
        "required_assertions_passed": 2, "required_assertions_total": 5, "forbidden_assertions_passed": 0, "forbidden_assertions_total": 1, "passed": 2, "total": 6, "semantic_assertions_passed": False}
