"""A golden contract: its files as tables, and a run's graphs held against it, offline from recorded responses or after the fact."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Settings
from loomgraph.operators import project, report
from loomgraph.operators.store import GraphStore
from loomgraph.plans import run as runs_of
from loomgraph.prompts import resolve_prompt
from loomgraph.sources import runs
from loomgraph.sources.calls import Post
from loomgraph.sources.clients import text_documents

_RELATION = "source string, raw_relation string, target string, negated boolean"


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The contract file. Fields: fixture, structured_fixture, required_entities, required_relations, forbidden_relations, required_alias_merges,
    required_separate_entities, required_qualifier_cases, call_budget, projection_contract; optionally prompt_id and prompt_hash."""
    return runs.read_json(spark, path)


def recorded_responses(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, arguments) of a file of recorded tool arguments: {"units": [{"unit_id", "arguments"}]}."""
    units = F.from_json("value", "struct<units:array<string>>")["units"]
    each = spark.read.text(path, wholetext=True).select(F.explode(units).alias("u"))
    return each.select(F.get_json_object("u", "$.unit_id").alias("unit_id"), F.get_json_object("u", "$.arguments").alias("arguments"))


def contract_tables(spark: SparkSession, manifest: dict) -> dict[str, DataFrame]:
    """The contract's lists as small tables for ``report.compare_golden``."""
    relations = lambda key: spark.createDataFrame([(r["source"], r["raw_relation"], r["target"], r.get("negated")) for r in manifest.get(key, [])], _RELATION)
    two = lambda rows: spark.createDataFrame([tuple(r) for r in rows], "a string, b string")
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    cases = [(c["source"], c["raw_relation"], c["field"], text(c["value"])) for c in manifest.get("required_qualifier_cases", [])]
    return {
        "required": relations("required_relations"), "forbidden": relations("forbidden_relations"),
        "merged": two((m["canonical_name"], m["alias"]) for m in manifest.get("required_alias_merges", [])), "separate": two(manifest.get("required_separate_entities", [])),
        "entities": spark.createDataFrame([(n,) for n in manifest.get("required_entities", [])], "name string"),
        "qualifiers": spark.createDataFrame(cases, "source string, raw_relation string, field string, value string"),
    }


def compare(spark: SparkSession, outputs: str, run_id: str, manifest: dict, settings: Settings) -> dict:
    """What a run's graphs lack of a contract: status, failed_assertions, assertion_counts and observed_metrics of the first graph."""
    path, tables = f"{outputs.rstrip('/')}/{run_id}", runs_of.read_run(spark, outputs, run_id)
    read = lambda name: spark.read.json(f"{path}/{name}")
    wanted = contract_tables(spark, manifest)
    failed = report.compare_golden(tables["nodes"], tables["edges"], **wanted)
    diff, totals, projection = read("edge_diff"), read("model_call_totals"), manifest.get("projection_contract", {})
    failed = failed.unionByName(report.contract_differences(
        totals, diff, manifest.get("call_budget", {}), tables["units"], projection.get("node_label", settings.store.entity_label), projection.get("relationship_type", settings.store.relation_type)))
    for field in ("prompt_id", "prompt_hash"):
        if field in manifest:
            other = tables["headers"].where(F.col(field) != manifest[field])
            failed = failed.unionByName(other.select(F.lit(field).alias("check"), F.col(field).alias("detail")))
    if manifest.get("fixture") is not None:
        other = tables["sources"].where(~F.col("repository_relative_path").eqNullSafe(F.lit(manifest["fixture"].replace("\\", "/"))))
        failed = failed.unionByName(other.select(F.lit("fixture").alias("check"), F.coalesce("repository_relative_path", F.lit("external")).alias("detail")))
    rows = failed.orderBy("check", "detail").collect()  # no more than the contract's own assertions, and two for each graph
    n = lambda key: len(manifest.get(key, []))
    counts = report.assertion_counts(spark.createDataFrame([tuple(r) for r in rows], "check string, detail string"), n("required_relations") + n("required_qualifier_cases"), n("forbidden_relations")).first()
    graphs = spark.read.text(f"{path}/fact_graph").select(F.get_json_object("value", "$.graph_id").alias("g"), F.sha2("value", 256).alias("graph_hash"))
    metrics = report.observed_metrics(graphs, tables["nodes"], tables["edges"], tables["units"], totals, diff.select(F.col("graph_id").alias("g"), "status")).orderBy("g").first()
    return {
        "status": "failed" if rows else "passed", "failed_assertions": [f"{r['check']}: {r['detail']}" for r in rows], "assertion_counts": counts.asDict(),
        "observed_metrics": metrics.asDict(True) if metrics else {}, "contract_version": manifest.get("contract_version"),
    }


def _run_fixture(spark: SparkSession, manifest: dict, root: str, output: str, settings: Settings, run_id: str | None, **how) -> dict:
    docs = text_documents(spark, f"{root}/{manifest['fixture']}").withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    store = GraphStore(spark, f"{output}/store", settings.store.entity_label, settings.store.relation_type)
    reports = runs_of.run(spark, docs, output, store, settings, run_id, root=root, **how)
    return compare(spark, output, reports.first()["run_id"], manifest, settings)


def run_offline(spark: SparkSession, manifest_path: str, root: str, output: str, settings: Settings, run_id: str | None = None) -> dict:
    """Run a contract's fixture through the whole engine with its recorded responses, names resolved by equality, and compare.

    Paths of the contract are relative to ``root``; the store is a new one in ``output``.
    """
    manifest = load_manifest(spark, manifest_path)
    answers = runs_of.replayed_responses(recorded_responses(spark, f"{root}/{manifest['structured_fixture']}"))
    return _run_fixture(spark, manifest, root, output, settings, run_id, extractor=answers) | {"mode": "offline"}


def run_live(spark: SparkSession, manifest_path: str, root: str, output: str, settings: Settings, run_id: str | None = None, post: Post | None = None) -> dict:
    """As ``run_offline``, asking the services that the settings name for extractions and embeddings."""
    manifest = load_manifest(spark, manifest_path)
    how = {"extractor": runs_of.remote_responses(settings, resolve_prompt(settings.extraction.prompt_id), post), "embedder": runs_of.remote_vectors(settings, post)}
    return _run_fixture(spark, manifest, root, output, settings, run_id, **how) | {"mode": "live"}
