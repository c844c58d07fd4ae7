"""Sources, settings, command line, streaming."""

import json
import uuid
from functools import partial

import pytest
from pyspark.sql import functions as F

from loomgraph.config import PROFILE_VARIABLE, PROFILES_VARIABLE, Embedding, Provider, load_settings
from loomgraph.functions import text
from loomgraph.operators import embedding, extract, project
from loomgraph.operators.store import GraphStore
from loomgraph.prompts import load_bundle, resolve_prompt
from loomgraph.sources import calls, clients
from loomgraph.streaming.spans import stream_graphs


def test_settings_are_strict():
    s = load_settings({"thresholds": {"candidate": 0.5}}, overrides={"thresholds.merge": 0.6, "store.limit": 7, "runtime.profiles.default.seed": 3}, environment={})
    assert (s.thresholds.candidate, s.thresholds.merge, s.store.limit, s.runtime.provider.seed) == (0.5, 0.6, 7, 3)
    profile = lambda **p: {"runtime": {"profiles": {"default": p}}}
    for bad in ({"nothing": 1}, {"thresholds": {"candidate": 0.99}}, {"store": {"entity_label": "lower"}}, {"store": {"entity_label": "FACT_RELATION"}}, profile(extensions={"Api-Key": "x"}),
                profile(extensions={"a": [{"auth_token": 1}]}), profile(extensions={"model": "x"}), profile(reasoning_policy="x"), {"decisions": {"other": True}}, {"runtime": {"profile": "none"}}, {"retrieval": {"top_k": 0}}):
        with pytest.raises(ValueError):
            load_settings(bad, environment={})


def test_settings_come_from_folders_and_the_environment(tmp_path):
    (tmp_path / "thresholds.json").write_text('{"candidate": 0.4, "merge": 0.5}')
    (tmp_path / "store.json").write_text('{"limit": 9}')
    (tmp_path / "profiles.txt").write_text('{"slow": {"timeout_seconds": 900, "reasoning_policy": "allow_nonempty", "extensions": {"chat_template_kwargs": {"thinking": true}}}}')
    s = load_settings(str(tmp_path), environment={PROFILES_VARIABLE: str(tmp_path / "profiles.txt"), PROFILE_VARIABLE: "slow"})
    assert (s.thresholds.candidate, s.store.limit, s.runtime.provider.timeout_seconds, s.runtime.profiles["default"].timeout_seconds) == (0.4, 9, 900, 600.0)


def test_prompt_bundles(monkeypatch):
    b = resolve_prompt()
    assert len(b.content_hash) == 64 and "[{" in b.render("U1", "Cats.", [{"span_id": "S001", "text": "Cats.", "secret": 1}]) and "secret" not in b.render("U1", "x", [{"span_id": "S001", "text": "x", "secret": 1}])
    content = {"version": "1", "system": "s", "template": "{text}", "types": {}, "families": dict.fromkeys(extract.RELATION_FAMILIES, "x")}
    assert load_bundle("p", content).content_hash != load_bundle("q", content).content_hash != load_bundle("q", content | {"system": "t"}).content_hash
    for bad in (content | {"more": 1}, content | {"families": {}}):
        with pytest.raises(ValueError):
            load_bundle("p", bad)
    with pytest.raises(ValueError):
        resolve_prompt("none")
    body = clients.request_body(Provider(seed=1, extensions={"top_k": 5}), b, "U001_S001", [{"span_id": "S001", "text": "Cats."}])
    assert body["seed"] == 1 and body["top_k"] == 5 and "temperature" not in body and body["tools"][0]["function"]["name"] == extract.TOOL
    identity = clients.request_identity(Provider(), "default", b, clients.tool_schema())
    assert identity["schema_hash"] != clients.request_identity(Provider(), "default", b, clients.tool_schema(3))["schema_hash"] and not any("key" in k for k in identity)
    with pytest.raises(ValueError):
        clients.request_body(Provider(transport="json"), b, "U", [{"span_id": "S", "text": "x"}])


def test_extensions_are_an_allow_list():
    good = {"chat_template_kwargs": {"thinking": False, "preserve_thinking": True}}
    profile = lambda e: load_settings({"runtime": {"profiles": {"default": {"extensions": e}}}}, environment={})
    assert profile(good).runtime.provider.extensions == good
    for bad, why in (({"tool_choice": "none"}, "must not set"), ({"Stream": True}, "must not set"), ({"functions": []}, "must not set"), ({"x_api_key": 1}, "must not set"), ({"top_k": 5}, "unknown"),
                     ({"chat_template_kwargs": {"Max-Tokens": 1}}, "must not set"), ({"chat_template_kwargs": {"other": 1}}, "unknown"), ({"chat_template_kwargs": 1}, "object")):
        with pytest.raises(ValueError, match=why):
            profile(bad)


def test_embedding_answers_are_judged_together(spark):
    item = lambda i, *v: {"index": i, "embedding": list(v)}
    bodies = {  # graph: (size, data) of each batch
        "good": [(2, [item(1, 2.0, 0), item(0, 1, 0)]), (1, [item(0, 3, 3)])], "short": [(2, [item(0, 1)])], "double": [(2, [item(0, 1), item(0, 1)])],
        "fraction": [(2, [item(0, 1), item(0.5, 1)])], "uneven": [(2, [item(0, 1), item(1, 1, 2)])], "between": [(1, [item(0, 1)]), (1, [item(0, 1, 2)])],
        "text": [(1, "x")], "flat": [(1, [{"index": 0, "embedding": 1}])], "empty": [(1, [item(0)])], "past": [(1, [item(1, 1)])],
    }
    rows = [(g, i, n, 200, json.dumps({"model": "m2", "data": d, "usage": {"prompt_tokens": 3, "total_tokens": 4}})) for g, x in bodies.items() for i, (n, d) in enumerate(x)]
    rows += [("lost", 0, 1, None, None), ("broken", 0, 1, 200, "{"), ("denied", 0, 1, 401, "{}")]
    read = embedding.read_answers(spark.createDataFrame(rows, "g string, batch long, size long, http_status int, body string"))
    assert sorted((r["g"], r["batch"], r["rule"]) for r in embedding.embedding_violations(read).collect()) == [
        ("between", None, "dimension"), ("broken", 0, "data"), ("denied", 0, "http_status"), ("double", 0, "index"), ("empty", 0, "vector"), ("flat", 0, "vector"),
        ("fraction", 0, "index"), ("lost", 0, "http_status"), ("past", 0, "index"), ("short", 0, "count"), ("text", 0, "data"), ("uneven", None, "dimension")]
    good = read.where("g = 'good'")
    assert [(r["ord"], r["vector"]) for r in embedding.embedding_vectors(good, 2).orderBy("ord").collect()] == [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 3.0])]
    assert tuple(embedding.embedding_metadata(good, "m").first()) == ("good", 2, ["m2"], 3, 2, 6, 8)


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    """A task dies after some of its calls; its next attempt finds their answers, so that each unit has one call and one account."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def post(url, body, timeout):
        name = body["input"][0]
        with open(asked / f"{name}-{uuid.uuid4().hex}", "w"):
            pass
        return 200, json.dumps({"data": [{"index": 0, "embedding": [1.0, 2.0]}], "usage": {"prompt_tokens": 1, "total_tokens": 1}})

    def dying(batches, **how):
        for b in batches:
            for i in range(b.num_rows):
                yield from calls._ask(iter([b.slice(i, 1)]), **how)
                if i == 2:
                    raise RuntimeError("the executor is lost")

    requests = embedding.embedding_requests(spark.createDataFrame([(f"g{i}", 1, f"n{i}") for i in range(6)], "g string, ord int, name string"), "m")
    requests = requests.withColumn("call_key", calls.call_key("u", F.col("g"), F.col("request"))).coalesce(1)
    how = {"url": "u", "timeout": 1.0, "post": post, "cache": str(tmp_path / "answers")}
    with pytest.raises(Exception, match="lost"):
        requests.mapInArrow(partial(dying, **how), "g string, batch long, size long, request string, call_key string, http_status int, body string").collect()
    assert len(list(asked.iterdir())) == 3
    done = calls.call_once(requests, "u", 1.0, post, 2, how["cache"])
    assert done.where("http_status = 200").count() == 6 and sorted(f.name.split("-")[0] for f in asked.iterdir()) == [f"n{i}" for i in range(6)]
    # The same request of another graph is a call of its own.
    twin = requests.limit(1).withColumn("g", F.lit("twin")).withColumn("call_key", calls.call_key("u", F.col("g"), F.col("request")))
    assert calls.call_once(twin, "u", 1.0, post, 1, how["cache"]).count() == 1 and len(list(asked.iterdir())) == 7


def test_remote_extraction_through_a_fake(spark):
    spans = spark.createDataFrame([("S001", "U001_S001", "Cats like milk."), ("S002", "U001_S002", "slow")], "span_id string, unit_id string, text string")
    good = {"status": "no_graph_fact", "entities": [], "relations": [], "temporal_bindings": [], "no_graph_fact_reason": "pure_context"}

    def post(url, body, timeout):
        if "slow" in body["messages"][1]["content"]:
            return None, None
        call = {"function": {"name": extract.TOOL, "arguments": json.dumps(good)}}
        return 200, json.dumps({"choices": [{"finish_reason": "stop", "message": {"tool_calls": [call]}}]})

    got = extract.gate_responses(clients.request_extractions(spans, Provider(url="http://x"), resolve_prompt(), 2, post)).orderBy("span_id").collect()
    assert [r["terminal_subcategory"] for r in got] == ["accepted", "timeout"]
    names = spark.createDataFrame([("a", 1, "x"), ("a", 2, "yy"), ("a", 3, "z"), ("b", 1, "w")], "g string, ord int, name string")
    answer = lambda size: lambda u, b, t: (200, json.dumps({"data": [{"index": i, "embedding": [float(ord(x[0]))] * size(x)} for i, x in reversed(list(enumerate(b["input"])))]}))
    found = clients.request_embeddings(names, Embedding(url="http://x", key_variable=None), answer(lambda x: 2), batch=2)
    assert sorted((r["g"], r["ord"], chr(int(r["vector"][0]))) for r in found.vectors.collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "w")]
    assert {r["g"]: (r["calls"], r["data_count"], r["prompt_tokens"]) for r in found.metadata.collect()} == {"a": (2, 3, None), "b": (1, 1, None)}
    with pytest.raises(ValueError, match="dimension"):
        clients.request_embeddings(names, Embedding(url="http://x"), answer(len), batch=2)


def test_keys_are_sent(monkeypatch):
    sent = []

    class Opener:
        def open(self, request, timeout):
            sent.append(dict(request.header_items()))
            raise OSError

    monkeypatch.setattr(clients.urllib.request, "build_opener", lambda *a: Opener())
    monkeypatch.setenv("SERVICE_KEY", "abc")
    assert clients.http_post("http://x", {}, 1.0, "SERVICE_KEY") == (None, None) and sent[0]["Authorization"] == "Bearer abc"
    with pytest.raises(RuntimeError, match="NO_KEY"):
        clients.http_post("http://x", {}, 1.0, "NO_KEY")


def test_stream_adds_to_the_store_once(spark, tmp_path):
    spark.createDataFrame([(1, "Cats like warm milk."), (2, "Dogs feed cats.")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    store = GraphStore(spark, str(tmp_path / "store"))

    def ingest(progress):
        docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))
        query = stream_graphs(docs, store, str(tmp_path / progress))
        query.awaitTermination(120)
        query.stop()
        assert query.exception() is None

    ingest("progress")
    store.ensure_indexes()
    edges = store.read("edges", ["1"])
    assert edges.count() == 1 and project.path_query(store.read("vertices", ["1"]), edges).count() == 1
    # The progress is lost, and the batch comes again: no second commit.
    at = store.version()
    ingest("progress-2")
    assert store.version() == at and len(store._commits()) == 1 and store._commits()[0]["streams"] == {"documents": 0}


def test_case_folding_is_full_and_native(spark):
    texts = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF and chr(c).casefold() != chr(c)] + ["Straße 😀 ŉ", "ΑΣ ας", "İı", "", "ﬃ𐐀", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.casefold(F.col("t")).alias("f"))
    assert [r for r in df.collect() if r.f != (None if r.t is None else r.t.casefold())] == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
