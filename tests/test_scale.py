"""What must not grow faster than the input: repeated work, shuffles and results of the shared steps."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.ids import edge_id, json_string, lower_escapes
from loomgraph.functions.text import document_spans
from loomgraph.operators import extract, graph, neighbours, project, resolve  # noqa: F401
from loomgraph.plans.build import build_graphs


def test_json_strings_equal_python(spark):
    texts = ["", "plain", 'say "x"', "back\\slash", '\\"', "\\u001F", "a\x1fb", "\\\x0b\\\\", "tab\tline\n\r\x08\x0c", "\x7f é   😀", "�", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["j"] for r in df.select(json_string(F.col("t")).alias("j")).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]
    whole = df.select(lower_escapes(F.to_json(F.array("t"))).alias("j")).collect()
    assert [r["j"] for r in whole] == [json.dumps([t], ensure_ascii=False) for t in texts]


def test_written_graphs_are_not_made_again(spark):
    g = build_graphs(spark.createDataFrame([(1, "Policy applies to servers. Cats like warm milk.")], "doc_id long, text string")).written()
    for df, n in ((g.edges, 2), (g.nodes, 4)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == n and not any(x in plan for x in ("Join", "Aggregate", "Window"))


@pytest.mark.parametrize("copies", [0, 30, 90])
def test_nearest_by_tiles_equal_all_pairs(spark, copies):
    rng = np.random.default_rng(copies)
    v = rng.standard_normal((90, 6))
    v[90 - copies :] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [("a", i + 1, x.tolist()) for i, x in enumerate(v)] + [("b", i + 1, x.tolist()) for i, x in enumerate(v[:3])] + [(None, 1, v[0].tolist())]
    df = spark.createDataFrame(rows, "g string, ord int, vector array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, 4, tile=16).collect():
        got.setdefault((r["g"], r["ord"]), []).append((r["rank"], r["neighbour"], r["similarity"]))
    for g, n in (("a", 90), ("b", 3)):
        s = np.round(v[:n] @ v[:n].T, 6)
        for i in range(n):
            best = sorted(((-s[i, j], -(j + 1)) for j in range(n) if j != i))[:4]
            have = sorted(got[g, i + 1])
            assert [x[:2] for x in have] == [(k + 1, -o) for k, (_, o) in enumerate(best)] and all(abs(x[2] + y) < 2e-6 for x, (y, _) in zip(have, best))
    assert (None, 1) not in got


def test_best_of_chunks_bounds_its_candidates():
    best = neighbours._Best(2, 3)
    for o in (20, 10):
        best.offer(slice(0, 2), np.full((2, 5), 0.5), np.arange(o, o + 5))
    # Equal ones with smaller ordinals are not even looked at.
    assert sorted(best.codes[0] & 1023) == [22, 23, 24] and (best.least > 0.5).all()


def test_nearest_sends_no_pairs(spark):
    df = spark.range(40).select(F.lit(0).alias("g"), (F.col("id") + 1).alias("ord"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("vector"))
    left, right = neighbours._tile_sides(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), 10)
    # Four sides: each vector goes to five places, not to its 40 pairs.
    assert left.count() + right.count() == 40 * 5 and left.select("sl", "sr").distinct().count() == 10


def test_large_graphs_decide_their_nearest_only(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 60
    v = spark.createDataFrame([(0, i + 1, [float(x) for x in rng.standard_normal(4)]) for i in range(n)], "g int, ord int, vector array<double>")
    entities = v.select("g", "ord", F.format_string("M%03d", "ord").alias("local_id"), F.lit("x").alias("name"), F.lit("T").alias("type"), F.col("ord").cast("string").alias("unit"), F.lit("S001").alias("span_id"))
    relations = spark.createDataFrame([], "g int, l int, r int, raw_relation string, family string, relation_id string, spans array<string>")
    made = []
    of = resolve.similar_pairs
    monkeypatch.setattr(resolve, "similar_pairs", lambda *a, **k: made.append(of(*a, **k)) or made[-1])
    out = resolve.resolve_entities(entities, v, relations, -0.0, 0.4, pairwise_limit=1, top_k=3)
    assert made[0].count() == 0 and out.decisions.count() <= 3 * n and out.decisions.select("l", "r").distinct().count() == out.decisions.count()
    assert out.summary.first()["unique_pairs"] == n * (n - 1) // 2 and out.entities.count() == n


def test_extraction_needs_no_text_in_between(spark):
    texts = ["One two three four.", "Straße É 😀 𝒳y zwei drei!", 'a "b" c\\d', "no fact", "", "x\ty\nz", None]
    spans = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    parsed = extract.rule_extract(spans).select("i", F.from_json("arguments", extract.EXTRACTION).alias("extraction"), F.to_json(F.from_json("arguments", extract.EXTRACTION), {"ignoreNullFields": "false"}).alias("again"), "arguments")
    made = extract.rule_extraction(spans).select("i", "extraction")
    assert sorted(made.collect()) == sorted(parsed.select("i", "extraction").collect())
    assert all(r["again"] == r["arguments"] for r in parsed.collect())
    g = build_graphs(spark.createDataFrame([(1, "Policy applies to servers.")], "doc_id long, text string"))
    assert "arguments" not in g.extracted.columns and g.edges.count() == 1


def test_spans_of_odd_texts_equal_python(spark):
    space = lambda c: c.isspace()
    texts = [
        "1.2.3. v1.0! a.b.c", "....", "a....b. c", "\x85 x.\xa0y \x1c.", "  lead. trail　", "p\n \nq\r\n\r\nr. s", "\n\n\nx\n\n", "no break\nhere. Yes?", "a  b", "x.​y. z", "!?!", "",
        "." * 20_000 + "x", "a." * 20_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in document_spans(df).orderBy("doc_id", "span_no").collect():
        got.setdefault(r["doc_id"], []).append((r["span_id"], r["text"], r["document_start"], r["document_end"]))
    for i, t in enumerate(texts):
        t, want = t.replace("\r\n", "\n").replace("\r", "\n"), []
        ends = [m.end() for m in re.finditer(r"[\n\x0b\f\x1c-\x1e\x85  ][^\S\n\x0b\f\x1c-\x1e\x85  ]*[\n\x0b\f\x1c-\x1e\x85  ]\s*", t[1:])]
        for a, b in zip([0, *(e + 1 for e in ends)], [*(e + 1 for e in ends), len(t)]):
            while a < b and space(t[a]):
                a += 1
            while a < b and space(t[b - 1]):
                b -= 1
            cut = a
            for j in range(a, b):
                if t[j] in "!?" or (t[j] == "." and (j + 1 == b or space(t[j + 1]))) or j + 1 == b:
                    s, e = cut, j + 1
                    while s < e and space(t[s]):
                        s += 1
                    while s < e and space(t[e - 1]):
                        e -= 1
                    if s < e:
                        want.append((f"S{len(want) + 1:03d}", t[s:e], s, e))
                    cut = j + 1
        assert got.get(i, []) == want, i


def test_spans_are_placed_by_one_window_over_sentences(spark):
    plan = document_spans(spark.createDataFrame([(1, "a. b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate posexplode(regexp_extract_all(_text")]
    assert above.count("Window [") == 1


def test_edge_ids_of_plain_qualifiers_equal_python(spark):
    rows = [(m, c, n) for m in ("ASSERTED", "REQUIRED", 'odd "m"', "ämter", None) for c in (None, "if\\x") for n in (True, False, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "modality string, condition string, negated boolean, i int")
    null = F.lit(None).cast("string")
    q = F.struct("condition", "modality", "negated", null.alias("quantity"), null.alias("temporality"), null.alias("version"))
    got = {r["i"]: r["e"] for r in df.select("i", edge_id(F.lit("E1"), F.lit("r"), F.lit("E2"), F.array(F.lit("S001")), q).alias("e")).collect()}
    for i, (m, c, n) in enumerate(rows):
        inner = json.dumps({"condition": c, "modality": m, "negated": bool(n), "quantity": None, "temporality": None, "version": None}, ensure_ascii=False)
        body = json.dumps(["E1", "r", "E2", ["S001"], inner, "forward", bool(n), m], ensure_ascii=False, separators=(",", ":"))
        assert got[i] == "R_" + hashlib.sha256(body.encode()).hexdigest()[:16], rows[i]


def test_saved_matrix_is_read_down_to_a_floor(spark):
    n, block = 23, 3
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(0, i + 1, f"M{i + 1:03d}", [float(x) for x in rng.standard_normal(5)]) for i in range(n)], "g int, ord int, local_id string, vector array<double>")
    entities = v.drop("vector")
    relations = spark.createDataFrame([(0, 23, 1), (0, 22, 23), (0, 5, 4), (0, 1, 9)], "g int, l int, r int")
    # Tiles of seven: vectors go to a few tiles, though there are 36 pairs of blocks.
    matrix = neighbours.similarity_matrix(v, block, tile=7).cache()
    assert matrix.count() == 36 and all(len(r["cells"]) == 3 * len(r["left_ids"]) * len(r["right_ids"]) for r in matrix.collect())
    every = {(r["l"], r["r"]): r["similarity"] for r in neighbours.saved_matrix_pairs(entities, matrix, block).collect()}
    assert len(every) == n * (n - 1) // 2
    some = {(r["l"], r["r"]): r["similarity"] for r in neighbours.saved_matrix_pairs(entities, matrix, block, 0.3, relations).collect()}
    assert some == {k: s for k, s in every.items() if s >= 0.3 or k in {(1, 23), (22, 23), (4, 5), (1, 9)}}


def test_entities_are_resolved_without_pairs_below_the_merge_threshold(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(0, i + 1, [float(x) for x in rng.standard_normal(4)]) for i in range(20)], "g int, ord int, vector array<double>")
    entities = v.select("g", "ord", F.format_string("M%03d", "ord").alias("local_id"), F.lit("x").alias("name"), F.lit("T").alias("type"), F.col("ord").cast("string").alias("unit"), F.lit("S001").alias("span_id"))
    relations = spark.createDataFrame([(0, 2, 1, "feeds", "F", "R1", ["S001"]), (0, 9, 4, "same as", "F", "R2", ["S001"])], "g int, l int, r int, raw_relation string, family string, relation_id string, spans array<string>")
    floors, of = [], resolve.similar_pairs
    monkeypatch.setattr(resolve, "similar_pairs", lambda x, floor, *a, **k: floors.append(floor) or of(x, floor, *a, **k))
    few = sorted(resolve.resolve_entities(entities, v, relations, 0.0, 0.7).entities.select("ord", "entity_id").collect())
    assert floors == [0.7]
    whole = resolve.resolve_entities(entities, v, relations, 0.0, 0.7)
    counts = {r["decision"]: r["pairs"] for r in resolve.decision_counts(whole.decisions).collect()}
    assert whole.candidates.count() and sorted(whole.entities.select("ord", "entity_id").collect()) == few
    assert {r["decision"]: r["pairs"] for r in resolve.count_decisions(entities, v, relations, 0.0, 0.7).collect()} == counts


def test_what_is_asked_of_built_graphs_needs_no_exchange(spark):
    docs = spark.createDataFrame([(i, "Policy applies to servers. Cats like warm milk. servers need the POLICY.") for i in range(5)], "doc_id long, text string")
    g = build_graphs(docs, texts=False)
    assert "text" not in g.spans.columns
    written = g.written()
    asked = {
        "nodes": g.nodes, "edges": g.edges, "violations": graph.graph_violations(g.nodes, g.edges, g.units),
        "parity": project.parity(*(f(x) for x in (written, written) for f in (lambda w: project.vertex_rows(w.nodes), lambda w: project.edge_rows(w.edges)))),
    }
    for name, df in asked.items():
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert (g.nodes.count(), g.edges.count(), asked["violations"].count(), asked["parity"].count()) == (20, 15, 0, 0)


def test_parity_meets_each_row_with_each_and_nulls_with_none(spark):
    form = "graph_id int, entity_id string, a string"
    want = spark.createDataFrame([(1, "x", "p"), (1, "x", "q"), (1, None, "p"), (None, "y", "p"), (2, "z", None)], form)
    have = spark.createDataFrame([(1, "x", "p"), (1, "x", "p"), (1, None, "p"), (3, "w", "p"), (2, "z", None)], form)
    none = spark.createDataFrame([], "graph_id int, edge_id string, b string")
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in project.parity(want, none, have, none).collect())
    assert got == sorted([
        ("1", "node_property", "x", "a"), ("1", "node_property", "x", "a"), ("1", "missing_node", "None", ""), ("1", "unexpected_node", "None", ""),
        ("None", "missing_node", "y", ""), ("3", "unexpected_node", "w", "")])


def test_first_paths_join_their_own_graphs_only(spark, monkeypatch):
    vertices = spark.createDataFrame([(g, f"E{i}", f"n{g}.{i}") for g in range(9) for i in range(3)], "graph_id int, entity_id string, display_name string")
    edges = spark.createDataFrame([(g, f"R{i}", "E0", f"E{i}", "r") for g in range(9) for i in range(4)], "graph_id int, edge_id string, source_entity_id string, target_entity_id string, display_relation string")
    want = sorted(project.all_paths(vertices, edges).collect(), key=lambda r: (r["graph_id"], r["edge_id"]))
    joined, of = [], project.all_paths
    monkeypatch.setattr(project, "all_paths", lambda v, e: joined.append(v) or of(v, e))
    # R3 ends nowhere: the first four edges have three paths, so more edges are looked at.
    for limit in (3, 4, 27, 100):
        joined.clear()
        assert project.path_query(vertices, edges, limit).collect() == want[:limit]
        assert limit > 3 or {r["graph_id"] for v in joined for r in v.collect()} == {0}
