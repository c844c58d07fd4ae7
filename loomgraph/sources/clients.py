"""Remote extraction and embedding behind the same tables as replay; each call is one row."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.ids import sha256_json
from loomgraph.operators import embedding
from loomgraph.operators.extract import MAX_ENTITIES, MAX_RELATIONS, MODALITIES, NO_FACT_REASONS, RELATION_FAMILIES, TOOL
from loomgraph.prompts import Bundle
from loomgraph.sources.calls import Post, call_key, call_once
from loomgraph.sources.shared import write_table

def http_post(url: str, body: dict, timeout: float, key_variable: str | None = None, trust_env: bool = False) -> tuple[int | None, str | None]:
    """(status, body); a timeout or a broken connection has no status. One attempt.

    ``key_variable`` names the environment variable with the bearer token, which is read
    where the call is made and never enters a plan. ``trust_env``: whether proxies of
    the environment are used.
    """
    headers = {"Content-Type": "application/json"}
    if key_variable:
        if not os.environ.get(key_variable):
            raise RuntimeError(f"environment variable {key_variable} is not set")
        headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
    opener = urllib.request.build_opener() if trust_env else urllib.request.build_opener(urllib.request.ProxyHandler({}))
    try:
        with opener.open(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return None, None


def tool_schema(max_entities: int = MAX_ENTITIES, max_relations: int = MAX_RELATIONS, strict: bool = False) -> dict:
    """The tool that a model must call once for each span: all fields of the extraction contract, bounded, and no others."""
    text, optional = {"type": "string", "minLength": 1}, {"type": ["string", "null"]}

    def record(properties: dict) -> dict:
        return {"type": "object", "properties": properties, "required": sorted(properties), "additionalProperties": False}

    index = {"type": "integer", "minimum": 0}
    relation = record({
        "source_entity_index": index, "target_entity_index": index, "relation_family": {"enum": list(RELATION_FAMILIES)}, "raw_relation": text, "condition": optional,
        "modality": {"enum": [*MODALITIES, None]}, "quantity": optional, "version": optional, "negated": {"type": "boolean"},
    })
    parameters = record({
        "status": {"enum": ["facts_present", "no_graph_fact"]}, "no_graph_fact_reason": {"enum": [*NO_FACT_REASONS, None]},
        "entities": {"type": "array", "maxItems": max_entities, "items": record({"canonical_name": text, "entity_type": text})},
        "relations": {"type": "array", "maxItems": max_relations, "items": relation},
        "temporal_bindings": {"type": "array", "items": record({"relation_index": index, "surface": text})},
    })
    function = {"name": TOOL, "description": "State what a span names and relates.", "parameters": parameters}
    return {"type": "function", "function": function | ({"strict": True} if strict else {})}


def request_body(provider, bundle: Bundle, unit_id: str, spans: list[dict], schema: dict | None = None) -> dict:
    """A chat request for one unit; options that are None are left out, and the provider's extensions set nothing that stands here."""
    if provider.transport != "native_tool_call":
        raise ValueError("extraction supports the transport native_tool_call only")
    text = spans[0]["text"] if len(spans) == 1 else "\n".join(s["text"] for s in spans)
    messages = [{"role": "system", "content": bundle.system}, {"role": "user", "content": bundle.render(unit_id, text, spans)}]
    body = {"model": provider.model, "max_tokens": provider.max_output_tokens, "messages": messages, "tools": [schema or tool_schema(strict=provider.strict)]}
    options = {k: getattr(provider, k) for k in ("tool_choice", "parallel_tool_calls", "stream", "temperature", "top_p", "seed")}
    return provider.extensions | body | {k: v for k, v in options.items() if v is not None}


def request_identity(provider, profile: str, bundle: Bundle, schema: dict) -> dict[str, str | None]:
    """What a request depends on besides its text, without any secret."""
    return {
        "provider_profile_id": profile, "model": provider.model, "prompt_id": bundle.prompt_id, "prompt_hash": bundle.content_hash, "schema_hash": sha256_json(schema),
        "transport": provider.transport, "reasoning_policy": provider.reasoning_policy,
        "options_hash": sha256_json({k: getattr(provider, k) for k in ("tool_choice", "parallel_tool_calls", "stream", "temperature", "top_p", "seed", "max_output_tokens", "extensions")}),
    }


def _bodies(batches: Iterator[pd.DataFrame], provider, bundle: Bundle) -> Iterator[pd.DataFrame]:
    for b in batches:
        bodies = [request_body(provider, bundle, u, [{"span_id": s, "text": t}]) for u, s, t in zip(b["unit_id"], b["span_id"], b["text"])]
        yield b.assign(request=[json.dumps(x, ensure_ascii=False) for x in bodies])


def request_extractions(spans: DataFrame, provider, bundle: Bundle, concurrency: int = 4, post: Post | None = None, cache: str | None = None) -> DataFrame:
    """``spans`` with request, http_status and body, written as a table at once, so that later reads never ask again.

    Each unit asks once, whatever tasks are lost. ``concurrency`` tasks call at a time; ``cache`` as in ``call_once``.
    """
    post = post or partial(http_post, key_variable=provider.key_variable, trust_env=provider.trust_env)
    schema = T.StructType([*spans.schema.fields, T.StructField("request", T.StringType())])
    url = f"{provider.url.rstrip('/')}/chat/completions"
    whose = [F.col(c) for c in ("doc_id", "unit_id") if c in spans.columns]
    asked = spans.mapInPandas(partial(_bodies, provider=provider, bundle=bundle), schema).withColumn("call_key", call_key(url, *whose, F.col("request")))
    return call_once(asked, url, provider.timeout_seconds, post, concurrency, cache).drop("call_key")


@dataclass
class Embeddings:
    """Vectors (g, ord, vector) and what the calls came to (``embedding_metadata``)."""

    vectors: DataFrame
    metadata: DataFrame


def request_embeddings(entities: DataFrame, settings, post: Post | None = None, concurrency: int = 4, batch: int = embedding.BATCH, cache: str | None = None) -> Embeddings:
    """Vectors of ``entities`` (g, ord, name): for each graph one logical call, in as many requests as its names fill.

    Answers are judged together before any is used: what breaks a rule is an error that names the first.
    """
    post = post or partial(http_post, key_variable=settings.key_variable, trust_env=settings.trust_env)
    url = f"{settings.url.rstrip('/')}/embeddings"
    asked = embedding.embedding_requests(entities, settings.model, batch)
    asked = asked.withColumn("call_key", call_key(url, F.col("g"), F.col("batch"), F.col("request")))
    read = write_table(embedding.read_answers(call_once(asked, url, settings.timeout_seconds, post, concurrency, cache)), "embedded")
    wrong = embedding.embedding_violations(read).orderBy("g", "batch", "rule").limit(1).collect()
    if wrong:
        raise ValueError(f"the embeddings of graph {wrong[0]['g']} can't be used: {wrong[0]['rule']} of batch {wrong[0]['batch']}")
    return Embeddings(embedding.embedding_vectors(read, batch), embedding.embedding_metadata(read, settings.model))


def probe(url: str, body: dict, timeout: float, post: Post = http_post) -> tuple[dict, dict | None]:
    """One request: (what the transport came to, the parsed body or None); nothing secret is in either."""
    began = time.perf_counter()
    status, text = post(url, body, timeout)
    seen = {"http_status": status, "timed_out": status is None, "latency_seconds": round(time.perf_counter() - began, 3), "json_body": False}
    try:
        value = json.loads(text) if text else None
    except ValueError:
        value = None
    return seen | {"json_body": isinstance(value, dict)}, value if isinstance(value, dict) else None


def text_documents(spark, path: str) -> DataFrame:
    """Files as documents: doc_id by path hash, strict UTF-8, newlines normalised, source = file name."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"))
    checked = F.coalesce(text, F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string"))
    return files.select(F.xxhash64("path").alias("doc_id"), checked.alias("text"), F.element_at(F.split("path", "/"), -1).alias("source"), "path")
