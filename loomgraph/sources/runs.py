"""Run folders on any file system that Spark reaches: small artifacts written whole or not at all, large ones as tables, and the choice of a finished run."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import GRAPH_ID, RUN_ID

MANIFEST_VERSION = "1"
#: What a run must have left behind to be read again.
REQUIRED = ("fact_graph", "run_report", "validation_report", "edge_diff", "projection_manifest")
#: What must be empty in a graph's parity report.
DIFFERENCES = (
    "graph_only_nodes", "store_only_nodes", "graph_only_edges", "store_only_edges", "source_target_mismatches", "edges_without_graph_id", "duplicate_edges", "import_errors",
)
_DIFF = "graph_id string, status string, " + ", ".join(f"{c} array<string>" for c in DIFFERENCES)
_REPORT = "run_id string, graph_id string, store struct<graph_id:string,nodes:bigint,edges:bigint>"
_VALIDATION = "g string, passed boolean, parity_differences bigint"
_MANIFEST = "manifest_version string, graph_id string, entity_label string, relation_type string"
_VIEW = "graph_id string, completed_at_utc string"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file in one step, from a part file beside it; the old one survives any failure."""
    folder, _, name = path.rpartition("/")
    fs, part = _path(spark, f"{folder or '.'}/.{name}.{uuid.uuid4().hex}.part")
    try:
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.hflush()
        out.close()
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        option = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        option[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(part, _path(spark, path)[1], option)
    finally:
        if fs.exists(part):
            fs.delete(part, False)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1) + "\n")


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON file that must hold an object."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold a JSON object")
    return value


class RunFolder:
    """One run's artifacts. A run never goes into a folder that is there already."""

    def __init__(self, spark: SparkSession, path: str, new: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        if new:
            fs, p = _path(spark, self.path)
            if fs.exists(p):
                raise FileExistsError(f"{self.path} is there already; runs are not resumed")
            fs.mkdirs(p)

    def json(self, name: str, value) -> None:
        write_json(self.spark, f"{self.path}/{name}.json", value)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table as JSON lines, and read it back."""
        df.write.option("ignoreNullFields", "false").json(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).json(f"{self.path}/{name}")

    def texts(self, name: str, df: DataFrame) -> DataFrame:
        df.write.text(f"{self.path}/{name}")
        return self.spark.read.text(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}")


def check_projection_manifest(row: dict, graph_id: str) -> tuple[str, str]:
    """(entity label, relation type) of a manifest row that is of this version and graph."""
    if row.get("manifest_version") != MANIFEST_VERSION:
        raise ValueError("unknown version of the projection manifest")
    if row.get("graph_id") != graph_id:
        raise ValueError("the projection manifest is another graph's")
    if set(row) != {"manifest_version", "graph_id", "entity_label", "relation_type"}:
        raise ValueError("a projection manifest names the entity label and the relation type, and nothing else")
    return row["entity_label"], row["relation_type"]


def require_projection(manifests: DataFrame, label: str, relation: str) -> None:
    """The types that a run was stored under must be the configured ones."""
    other = manifests.where((F.col("manifest_version") != MANIFEST_VERSION) | (F.col("entity_label") != label) | (F.col("relation_type") != relation)).limit(1).collect()
    if other:
        raise ValueError(f"graph {other[0]['graph_id']} was stored as {other[0]['entity_label']} and {other[0]['relation_type']}, not as configured")


def successful_graphs(spark: SparkSession, outputs: str, run_id: str | None = None) -> DataFrame:
    """(run_id, graph_id, nodes, edges, completed_at_utc, entity_label, relation_type) of all graphs of runs that can be trusted.

    A run counts if it has all REQUIRED artifacts, its graphs name the folder as their
    run, and validation passed; a graph counts if its parity report is empty where it must be,
    and its nodes and edges are as many as were stored. Incomplete and unreadable runs
    are left out.
    """
    fs, p = _path(spark, outputs)
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []
    names = [n for n in names if RUN_ID.fullmatch(n) and (run_id is None or n == run_id) and all(exists(spark, f"{outputs}/{n}/{r}") for r in REQUIRED)]
    if not names:
        return spark.createDataFrame([], "run_id string, graph_id string, nodes long, edges long, completed_at_utc string, entity_label string, relation_type string")
    at = lambda table: [f"{outputs}/{n}/{table}" for n in names]
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("folder")
    read = lambda table, schema: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(at(table)).select("*", folder)
    text = spark.read.text(at("fact_graph")).select("value", folder)
    size = lambda k: F.json_array_length(F.get_json_object("value", f"$.{k}")).cast("long")
    graphs = text.select("folder", *(F.get_json_object("value", f"$.{k}").alias(k) for k in ("run_id", "graph_id")), size("nodes").alias("nodes"), size("edges").alias("edges"))
    report = read("run_report", _REPORT).select("folder", "graph_id", F.col("run_id").alias("_run"), "store")
    valid = read("validation_report", _VALIDATION).where("passed").select("folder", F.col("g").alias("graph_id"))
    diff = read("edge_diff", _DIFF)
    for c in DIFFERENCES:
        diff = diff.where(F.coalesce(F.size(c), F.lit(0)) == 0)
    manifest = read("projection_manifest", _MANIFEST).where(F.col("manifest_version") == MANIFEST_VERSION).drop("manifest_version")
    out = graphs.join(report, ["folder", "graph_id"]).join(valid, ["folder", "graph_id"]).join(diff.where("status = 'passed'").select("folder", "graph_id"), ["folder", "graph_id"])
    out = out.join(manifest, ["folder", "graph_id"])
    same = (F.col("run_id") == F.col("folder")) & (F.col("_run") == F.col("folder")) & (F.col("store.graph_id") == F.col("graph_id"))
    out = out.where(same & (F.col("store.nodes") == F.col("nodes")) & (F.col("store.edges") == F.col("edges")) & F.col("graph_id").rlike(rf"\A(?:{GRAPH_ID.pattern})\z"))
    views = [n for n in names if exists(spark, f"{outputs}/{n}/graph_view")]
    when = spark.read.schema(_VIEW).json([f"{outputs}/{n}/graph_view" for n in views]) if views else spark.createDataFrame([], _VIEW)
    return out.join(when, "graph_id", "left").select("run_id", "graph_id", "nodes", "edges", "completed_at_utc", "entity_label", "relation_type")


def select_run(spark: SparkSession, outputs: str, run_id: str | None = None, graph_id: str | None = None):
    """The first graph of the run with this id, the graph with this id, or the first one of the run that was completed last (ties: the larger run_id)."""
    if run_id is not None and graph_id is not None:
        raise ValueError("choose a run or a graph, not both")
    if run_id is not None and not RUN_ID.fullmatch(run_id):
        raise ValueError(f"bad run id {run_id!r}")
    if graph_id is not None and not GRAPH_ID.fullmatch(graph_id):
        raise ValueError(f"bad graph id {graph_id!r}")
    found = successful_graphs(spark, outputs, run_id)
    if graph_id is not None:
        found = found.where(F.col("graph_id") == graph_id)
    elif run_id is None:
        found = found.where("completed_at_utc is not null")
    rows = found.orderBy(F.desc("completed_at_utc"), F.desc("run_id"), "graph_id").limit(1).collect()
    if not rows:
        raise LookupError("no such successful run")
    return rows[0]
