"""python -m loomgraph.cli build|paths|rebuild|open|golden|conformance|probe: runs, stores and what checks them."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import webbrowser

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.config import load_settings
from loomgraph.functions.text import document_spans
from loomgraph.operators import project
from loomgraph.operators.store import GraphStore
from loomgraph.plans import golden
from loomgraph.plans import run as plan
from loomgraph.prompts import resolve_prompt
from loomgraph.sources import runs, viewer
from loomgraph.sources.clients import text_documents
from loomgraph.sources.probe import SAMPLING, run_probe


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **required) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--config", help="a JSON file, or a folder with one for each section")
        for k, v in required.items():
            c.add_argument(f"--{k.replace('_', '-')}", required=v)
        return c

    b = command("build", input=True, output=True, store=True, run_id=False, root=False)
    b.add_argument("--candidate-threshold", type=float)
    b.add_argument("--merge-threshold", type=float)
    b.add_argument("--extractor", choices=("rules", "remote"), default="rules")
    b.add_argument("--embed", action="store_true", help="resolve names by embeddings")
    b.add_argument("--open-graph", action="store_true")
    q = command("paths", store=True, graph_id=False)
    q.add_argument("--limit", type=int, default=project.DEFAULT_LIMIT)
    command("rebuild", outputs=True, run_id=True, store=True)
    o = command("open", outputs=True, store=True)
    which = o.add_mutually_exclusive_group(required=True)
    which.add_argument("--latest", action="store_true")
    which.add_argument("--run-id")
    which.add_argument("--graph-id")
    o.add_argument("--limit", type=int, default=project.DEFAULT_LIMIT)
    o.add_argument("--open", action="store_true")
    o.add_argument("--show-query", action="store_true")
    g = command("golden", manifest=True, outputs=True, run_id=False, root=False, json_output=False)
    g.add_argument("--offline", action="store_true", help="run the contract's fixture with its recorded responses")
    g.add_argument("--live", action="store_true", help="run the contract's fixture against the model service first, unless a run is named")
    g.add_argument("--policy", choices=("blocking", "report-only"), default="blocking")
    g.add_argument("--non-blocking", action="store_const", dest="policy", const="report-only")
    c = command("conformance", outputs=False, artifact_run=False, tests=False, json_output=False)
    c.add_argument("--git-diff-check", action="store_true")
    pr = command("probe", profile=True, input=False, unit_id=False, span_id=False, semantic_manifest=False, json_output=False)
    pr.add_argument("--production-repeats", type=int, default=0)
    pr.add_argument("--production-only", action="store_true")
    pr.add_argument("--capability-tool-only", action="store_true")
    pr.add_argument("--expect-empty-temporal-bindings", action="store_true")
    pr.add_argument("--sampling-profile", help="take temperature, top_p and seed from this profile")
    return p


#: Conformance errors that the summary shows; all stand in the run's folder.
SHOWN = 20


def _store(spark, path: str, settings) -> GraphStore:
    return GraphStore(spark, path, settings.store.entity_label, settings.store.relation_type)


def _say(spark, value: dict, path: str | None = None) -> None:
    if path:
        runs.write_json(spark, path, value)
    print(json.dumps(value, ensure_ascii=False, indent=1, default=str))


def _build(spark, args, settings) -> int:
    docs = text_documents(spark, args.input).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    extractor = plan.remote_responses(settings, resolve_prompt(settings.extraction.prompt_id)) if args.extractor == "remote" else plan.rule_responses
    embedder = plan.remote_vectors(settings) if args.embed else None
    try:
        reports = plan.run(spark, docs, args.output, _store(spark, args.store, settings), settings, args.run_id, extractor, embedder, args.root)
    except plan.RunFailed as e:
        print(f"{e.category}: {e}", file=sys.stderr)
        return 1
    for r in reports.select("run_id", "graph_id", "nodes", "edges", "connected_components").orderBy("graph_id").limit(20).collect():
        _say(spark, r.asDict())
    if args.open_graph:
        _open(spark, args.output, args.store, settings, None, None, settings.store.limit, True, False)
    return 0


def _open(spark, outputs: str, store_path: str, settings, run_id, graph_id, limit: int, launch: bool, show: bool) -> int:
    try:
        found = runs.select_run(spark, outputs, run_id, graph_id)
        store = GraphStore(spark, store_path, found["entity_label"], found["relation_type"])
        vertices, edges = store.read("vertices"), store.read("edges")
        if vertices is None:
            raise LookupError("the store holds no graph")
        counts = project.check_preflight(vertices, edges, found["graph_id"], limit, settings.store.database)
    except (LookupError, ValueError, project.PreflightError) as e:
        print(e, file=sys.stderr)
        return 2
    statement = viewer.path_statement(found["graph_id"], limit, found["entity_label"], found["relation_type"])
    link = viewer.browser_link(spark, settings.store.browser, settings.store.uri, settings.store.database, statement) if settings.store.browser else None
    _say(spark, {"run_id": found["run_id"], "graph_id": found["graph_id"], "url": link, **counts} | ({"query": statement} if show else {}))
    if launch and link:
        try:
            opened = webbrowser.open(link)
        except Exception as e:  # a browser that can't be started fails no run
            opened, link = False, str(e)
        if not opened:
            print(f"the browser was not opened: {link}", file=sys.stderr)
    return 0


def _conformance(spark, args) -> int:
    checks: dict = {}
    if args.artifact_run:
        # All errors are written; the summary shows the first ones and how many there are.
        path = f"{args.outputs.rstrip('/')}/{args.artifact_run}/conformance_errors"
        plan.check_run(spark, args.outputs, args.artifact_run).write.mode("overwrite").json(path)
        found = spark.read.schema("g string, error string").json(path)
        n = found.count()
        shown = [f"{r['g'] or 'run'}: {r['error']}" for r in found.orderBy("g", "error").limit(SHOWN).collect()]
        checks["artifacts"] = {"status": "failed" if n else "passed", "error_count": n, "errors": shown, "all_errors": path}
    if args.tests:
        done = subprocess.run([sys.executable, "-m", "pytest", "-q", args.tests], capture_output=True, text=True, check=False)
        checks["tests"] = {"status": "failed" if done.returncode else "passed", "output": done.stdout[-2000:]}
    if args.git_diff_check:
        done = subprocess.run(["git", "diff", "--check"], capture_output=True, text=True, check=False)
        checks["git_diff_check"] = {"status": "failed" if done.returncode else "passed", "output": done.stdout.strip()}
    passed = bool(checks) and all(c["status"] == "passed" for c in checks.values())
    _say(spark, {"status": "passed" if passed else "failed", "checks": checks}, args.json_output)
    return 0 if passed else 1


def _probe(spark, args, settings) -> int:
    span = None
    if args.sampling_profile:
        if args.sampling_profile not in settings.runtime.profiles:
            raise SystemExit(f"profile {args.sampling_profile!r} is not registered")
        other = settings.runtime.profiles[args.sampling_profile]
        for k in SAMPLING:
            setattr(settings.runtime.provider, k, getattr(other, k))
    if args.production_repeats:
        spans = document_spans(text_documents(spark, args.input))
        wanted = spans.where(F.col("span_id") == args.span_id) if args.span_id else spans.where(F.col("unit_id").startswith(f"{args.unit_id or 'U001'}_"))
        rows = wanted.orderBy("span_no").limit(1).collect()
        if not rows:
            print("no such span", file=sys.stderr)
            return 2
        span = {k: rows[0][k] for k in ("unit_id", "span_id", "text")}
    manifest = runs.read_json(spark, args.semantic_manifest) if args.semantic_manifest else None
    out = run_probe(spark, settings.runtime.provider, args.profile, resolve_prompt(settings.extraction.prompt_id), span, args.production_repeats, args.capability_tool_only, args.production_only, manifest,
                    no_times=args.expect_empty_temporal_bindings)
    _say(spark, out, args.json_output)
    return 0 if out["status"] == "passed" else 1


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    given = {"thresholds.candidate": getattr(args, "candidate_threshold", None), "thresholds.merge": getattr(args, "merge_threshold", None)}
    if args.command == "probe":
        given["runtime.profile"] = args.profile
    settings = load_settings(*([args.config] if args.config else []), overrides={k: v for k, v in given.items() if v is not None})
    if args.command == "build":
        return _build(spark, args, settings)
    if args.command == "paths":
        store = _store(spark, args.store, settings)
        vertices, edges = store.read("vertices"), store.read("edges")
        if vertices is None or vertices.isEmpty() or edges.isEmpty():
            print("the store holds no graph", file=sys.stderr)
            return 2
        if args.graph_id:
            vertices, edges = (t.where(F.col("graph_id") == args.graph_id) for t in (vertices, edges))
        for r in project.path_query(vertices, edges, args.limit).collect():
            print(f"{r['source']} -[{r['relation']}]-> {r['target']}")
        return 0
    if args.command == "rebuild":
        diff = plan.rebuild(spark, args.outputs, args.run_id, _store(spark, args.store, settings), settings)
        failed = diff.where("status <> 'passed'").count()
        _say(spark, {"run_id": args.run_id, "graphs": diff.count(), "failed": failed})
        return 1 if failed else 0
    if args.command == "open":
        return _open(spark, args.outputs, args.store, settings, args.run_id, args.graph_id, args.limit, args.open, args.show_query)
    if args.command == "golden":
        if args.offline:
            out = golden.run_offline(spark, args.manifest, args.root or ".", args.outputs, settings, args.run_id)
        elif args.live and not args.run_id:
            out = golden.run_live(spark, args.manifest, args.root or ".", args.outputs, settings)
        else:
            out = golden.compare(spark, args.outputs, args.run_id, golden.load_manifest(spark, args.manifest), settings)
        _say(spark, out, args.json_output)
        return 1 if args.policy == "blocking" and out["status"] != "passed" else 0
    if args.command == "conformance":
        return _conformance(spark, args)
    return _probe(spark, args, settings)


if __name__ == "__main__":
    sys.exit(main())
