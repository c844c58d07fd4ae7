"""The graph store: Parquet segments behind a log of commits, indexes that skip segments and buckets, digests of what was written."""

from __future__ import annotations

import base64
import json
import zlib
from typing import Protocol

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from loomgraph.operators.project import OWNER, check_type_names, import_errors, index_names
from loomgraph.sources.shared import new_path

INDEX_SCHEMA = "name string, type string, labels_or_types array<string>, properties array<string>"
TABLES = ("vertices", "edges")
#: So many small segments at the log's end are merged into one.
FAN = 8
#: Bits of a segment's filter for each namespace, and at most; hashes for each namespace.
FILTER_BITS, MOST_BITS, FILTER_HASHES = 12, 1 << 23, 4
#: Spark's xxhash64 is XXH64 with this seed.
_SEED = 42


class OwnershipError(RuntimeError):
    """A namespace belongs to another run or another pair of type names."""


class GraphSink(Protocol):
    """Where graphs go: anything that replaces namespaces whole, gives their tables back, and has indexes."""

    def replace(self, vertices: DataFrame, edges: DataFrame, owner: str | None = None) -> str: ...

    def read(self, table: str, graphs: DataFrame | list[str] | None = None) -> DataFrame | None: ...

    def ensure_indexes(self) -> None: ...

    def indexes(self) -> DataFrame: ...


def row_digest(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """128 bits of a row's ``columns``, which of them are null included."""
    values = [F.col(c) for c in columns]
    nulls = F.concat(*(F.when(v.isNull(), "1").otherwise("0") for v in values))
    return F.xxhash64(F.lit(5), nulls, *values), F.xxhash64(F.lit(6), nulls, *values)


def digests(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, graph_id, columns, n, d1, d2): for each namespace the number of its rows and two sums of their hashes, whatever their order."""
    total = lambda h, name: F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias(name)
    h1, h2 = row_digest(df, columns)
    return df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), total(h1, "d1"), total(h2, "d2")).select(
        F.lit(table).alias("table"), "graph_id", F.lit(",".join(columns)).alias("columns"), "n", "d1", "d2")


def digest_columns(df: DataFrame) -> list[str]:
    """The columns that a digest is about: all but those that the store adds."""
    return sorted(c for c in df.columns if c not in ("owner", "label", "relation_type", "bucket", "_commit"))


class GraphStore:
    """Vertices and edges as Parquet segments behind a log of numbered commits.

    A replacement writes one new segment with its namespaces' rows and their names, in
    buckets of a hash of graph_id, and then creates the next commit, which no two
    writers can: until then readers see what was. A namespace's rows are those of the
    newest segment that names it. A commit that was cut off, and a segment without a
    commit, count for nothing.

    Each further segment makes reads slower, so small ones at the log's end are merged
    once there are FAN of about a size: a row is rewritten about log(store / write) times.

    With its indexes (``ensure_indexes``) each segment has a filter of its graph_ids: a
    read of some namespaces opens only segments that may name them, and in those only the
    namespaces' buckets.
    """

    def __init__(self, spark: SparkSession, path: str, label: str = "FACT_ENTITY", relation: str = "FACT_RELATION", buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.label, self.relation = check_type_names(label, relation)

    # Files and the log.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _create(self, path: str, value: dict) -> None:
        """Write a small file, unless there is one."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray((json.dumps(value) + "\n").encode()))
        out.close()

    def _files(self, *paths: str) -> dict[str, dict]:
        """Small files as they were written, by their paths' last two parts; those that were cut off are left out."""
        found = [p for p in paths if self._fs(p)[0].globStatus(self._fs(p)[1])]
        if not found:
            return {}
        rows = self.spark.read.text(found, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).collect()  # a file for each commit
        return {"/".join(r["path"].rsplit("/", 2)[1:]): json.loads(r["value"]) for r in rows if r["value"].endswith("}\n")}

    def _commits(self) -> list[dict]:
        """The commits that still count, in order: a merge takes the place of those it names."""
        named = {int(p.rsplit("/", 1)[1]): c for p, c in self._files(f"{self.path}/log/*").items() if p.rsplit("/", 1)[1].isdigit()}
        out: list[dict] = []
        for number in sorted(named):
            commit = named[number] | {"number": number}
            if commit["since"] is not None:
                out = [c for c in out if c["number"] < commit["since"]]
            out.append(commit)
        return out

    def _next(self) -> int:
        fs, p = self._fs(f"{self.path}/log")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0) + 1

    def version(self) -> str | None:
        commits = self._commits()
        return f"{commits[-1]['number']:020d}" if commits else None

    # Reading.

    def _read_part(self, commit: dict, part: str, schema: StructType, buckets: set[int] | None) -> DataFrame:
        """Rows of a segment's ``part``, of the buckets that it has of ``buckets``, with the commit's number."""
        base = f"{self.path}/segments/{commit['segment']}/{part}"
        have = commit["buckets"][part]
        paths = [base] if buckets is None else [f"{base}/bucket={b}" for b in sorted(buckets & set(have))]
        if not have or not paths:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.option("basePath", base).schema(StructType(list(schema)).add("bucket", IntegerType())).parquet(*paths).drop("bucket")
        return rows.withColumn("_commit", F.lit(commit["number"]))

    def _chosen(self, commits: list[dict], graphs) -> tuple[list[dict], set[int] | None]:
        """The commits and buckets that could hold the namespaces ``graphs``."""
        if graphs is None:
            return commits, None
        if isinstance(graphs, DataFrame):
            found = graphs.select(_place(self.buckets).alias("b")).distinct().collect()  # a row for each bucket
            return commits, {r["b"] for r in found}
        filters = self._files(f"{self.path}/segments/*/filter")
        keep = [c for c in commits if (f := filters.get(f"{c['segment']}/filter")) is None or any(_may_hold(f, g) for g in graphs)]
        return keep, {_hash(g) % self.buckets for g in graphs}

    def _visible(self, part: str, commits: list[dict], buckets: set[int] | None, schema) -> DataFrame | None:
        rows = None
        for c in commits:
            own = self._read_part(c, part, schema(c), buckets)
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if rows is not None and len(commits) > 1:
            names = None
            for c in commits:
                own = self._read_part(c, "names", _names(c), buckets)
                names = own if names is None else names.unionByName(own)
            rows = rows.join(names.groupBy("graph_id").agg(F.max("_commit").alias("_commit")), ["graph_id", "_commit"], "left_semi")
        return rows

    def read(self, table: str, graphs: DataFrame | list[str] | None = None) -> DataFrame | None:
        """The rows of a table, of the namespaces in ``graphs`` (a list, or a table with graph_id) or all; None before the first commit."""
        every = self._commits()
        if not every:
            return None
        commits, buckets = self._chosen(every, graphs)
        schema = lambda c: StructType.fromJson(c["schemas"][table])
        rows = self._visible(table, commits, buckets, schema)
        if rows is None:
            return self.spark.createDataFrame([], schema(every[-1]))
        rows = rows.drop("_commit")
        if isinstance(graphs, DataFrame):
            return rows.join(graphs.select("graph_id").distinct(), "graph_id", "left_semi")
        return rows if graphs is None else rows.where(F.col("graph_id").isin(list(graphs)))

    def digests(self, graphs: DataFrame | list[str] | None = None) -> DataFrame | None:
        """What ``digests`` gave for the visible namespaces as they were written."""
        every = self._commits()
        if not every:
            return None
        commits, buckets = self._chosen(every, graphs)
        rows = self._visible("digests", commits, buckets, _digest_schema)
        return self.spark.createDataFrame([], _digest_schema(every[-1])) if rows is None else rows.drop("_commit")

    # Writing.

    def _write(self, tables: dict[str, DataFrame], names: DataFrame) -> dict:
        """A new segment; what the log must say of it."""
        segment = new_path(self.spark, "s").rsplit("/", 1)[1]
        base = f"{self.path}/segments/{segment}"
        known = [digests(rows, t, digest_columns(rows)) for t, rows in tables.items()]
        parts = tables | {"names": names.select("graph_id"), "digests": known[0].unionByName(known[1])}
        for part, rows in parts.items():
            rows.withColumn("bucket", _place(self.buckets).cast("int")).write.partitionBy("bucket").parquet(f"{base}/{part}")
        if self._has_indexes():
            self._build_filter(segment)
        return {"segment": segment, "buckets": {p: self._buckets_of(f"{base}/{p}") for p in parts}, "schemas": {t: rows.schema.jsonValue() for t, rows in tables.items()}}

    def _buckets_of(self, path: str) -> list[int]:
        fs, p = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=") and n.removeprefix("bucket=").isdigit())

    def _commit(self, number: int, kind: str, segment: dict, since: int | None = None, size: int = 0, streams: dict | None = None) -> str:
        self._create(f"{self.path}/log/{number:020d}", {"kind": kind, "since": since, "size": size, "streams": streams or {}} | segment)
        return f"{number:020d}"

    def replace(self, vertices: DataFrame, edges: DataFrame, owner: str | None = None, batch: tuple[str, int] | None = None) -> str:
        """Replace the namespaces that ``vertices`` names; others stay. Returns the new version.

        ``owner``: who they belong to; None: each row says so by its columns run_id,
        source_sha256 and manifest_identity_hash. ``batch``: a stream's name and the number
        of its batch; one that the log already has makes no second commit.
        """
        commits = self._commits()
        streams = commits[-1]["streams"] if commits else {}
        if batch is not None and streams.get(batch[0], -1) >= batch[1]:
            return f"{commits[-1]['number']:020d}"
        mine = F.lit(owner) if owner is not None else F.concat_ws("|", *OWNER)
        mark = {"owner": mine, "label": F.lit(self.label), "relation_type": F.lit(self.relation)}
        new = {"vertices": vertices.withColumns(mark), "edges": edges.withColumns(mark)}
        lost = import_errors(vertices, edges).limit(1).collect()
        if lost:
            raise ValueError(f"edge endpoints are missing among the nodes ({lost[0]['edge_id']}); nothing was imported")
        names = new["vertices"].select("graph_id", F.col("owner").alias("_mine")).distinct()
        number, old = self._next(), self.read("vertices", vertices)
        if old is not None:
            theirs = old.join(names, "graph_id").where(
                (F.col("owner") != F.col("_mine")) | (F.col("label") != self.label) | (F.col("relation_type") != self.relation)).select("graph_id", "owner").limit(1).collect()
            if theirs:
                raise OwnershipError(f"namespace {theirs[0]['graph_id']} belongs to {theirs[0]['owner']}")
        return self._add(number, new, names.select("graph_id").distinct(), streams | ({batch[0]: batch[1]} if batch else {}))

    def delete(self, graphs: DataFrame) -> str:
        """Empty the namespaces in ``graphs`` (graph_id)."""
        commits, number = self._commits(), self._next()
        if not commits:
            raise LookupError("the store holds nothing")
        empty = {t: self.spark.createDataFrame([], StructType.fromJson(commits[-1]["schemas"][t])) for t in TABLES}
        return self._add(number, empty, graphs.select(F.col("graph_id").cast(_names(commits[-1])["graph_id"].dataType).alias("graph_id")).distinct(), commits[-1]["streams"])

    def _add(self, number: int, tables: dict[str, DataFrame], names: DataFrame, streams: dict) -> str:
        segment = self._write(tables, names)
        size = self._read_part(segment | {"number": 0}, "names", _names(segment), None).count()
        version = self._commit(number, "replace", segment, size=size, streams=streams)
        self.merge_small()
        return version

    def merge_small(self, fan: int = FAN) -> str | None:
        """Merge the segments at the log's end that are about as large as all newer ones together, if they are ``fan``; other writers go first."""
        number, tail = self._next(), []
        for c in reversed(self._commits()):
            if tail and c["size"] > fan * sum(x["size"] for x in tail):
                break
            tail.insert(0, c)
        if len(tail) < fan:
            return None
        try:
            return self._merge(number, tail, "merge")
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return None
            raise

    def compact(self) -> str:
        """Write all that is visible as one segment; older ones may then be removed by age."""
        number, commits = self._next(), self._commits()
        if not commits:
            raise LookupError("the store holds nothing")
        return self._merge(number, commits, "compact")

    def _merge(self, number: int, commits: list[dict], kind: str) -> str:
        """One segment instead of the last ones in the log; the names of emptied namespaces stay as long as older segments could hold them.

        ``number`` was free before ``commits`` were read: whoever commits meanwhile takes it, and this merge fails.
        """
        tables = {t: self._visible(t, commits, None, lambda c, t=t: StructType.fromJson(c["schemas"][t])).drop("_commit") for t in TABLES}
        if kind == "compact":
            names = tables["vertices"].select("graph_id").distinct()
        else:
            names = None
            for c in commits:
                own = self._read_part(c, "names", _names(c), None).drop("_commit")
                names = own if names is None else names.unionByName(own)
            names = names.distinct()
        segment = self._write(tables, names)
        size = self._read_part(segment | {"number": 0}, "names", _names(segment), None).count()
        return self._commit(number, kind, segment, since=commits[0]["number"] if kind == "merge" else 0, size=size, streams=commits[-1]["streams"])

    # Indexes.

    def _has_indexes(self) -> bool:
        fs, p = self._fs(f"{self.path}/indexes")
        return fs.exists(p)

    def _build_filter(self, segment: str) -> None:
        """A filter of a segment's graph_ids: bits at FILTER_HASHES places for each, set by many tasks and gathered as words."""
        names = self.spark.read.parquet(f"{self.path}/segments/{segment}/names")
        n = names.count()
        bits = min(MOST_BITS, max(64, 1 << (n * FILTER_BITS - 1).bit_length() if n else 64))
        places = F.array(*(_place(bits, i) for i in range(FILTER_HASHES)))
        words = names.select(F.explode(places).alias("p")).groupBy(F.floor(F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        data = np.zeros(bits // 64, np.int64)
        for r in words.toLocalIterator():  # at most MOST_BITS / 64 rows
            data[r["w"]] = r["v"]
        self._create(f"{self.path}/segments/{segment}/filter", {"bits": bits, "words": base64.b64encode(zlib.compress(data.tobytes())).decode()})

    def ensure_indexes(self) -> None:
        """Record the indexes on graph_id, if they aren't yet, and give each segment that has none its filter."""
        have = {r["name"] for r in self.indexes().select("name").collect()}
        rows = [(n, "RANGE", [t], ["graph_id"]) for n, t in index_names(self.label, self.relation).items() if n not in have]
        if rows:
            self.spark.createDataFrame(rows, INDEX_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/indexes")
        built = self._files(f"{self.path}/segments/*/filter")
        for c in self._commits():
            if f"{c['segment']}/filter" not in built:
                self._build_filter(c["segment"])

    def indexes(self) -> DataFrame:
        return self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.path}/indexes") if self._has_indexes() else self.spark.createDataFrame([], INDEX_SCHEMA)


def _names(commit: dict) -> StructType:
    """The columns of a segment's names; its schemas know of which type graph_id is."""
    return StructType([StructType.fromJson(commit["schemas"]["vertices"])["graph_id"]])


def _digest_schema(commit: dict) -> StructType:
    form = StructType.fromDDL("table string, graph_id string, columns string, n long, d1 decimal(38,0), d2 decimal(38,0)")
    return StructType([form["table"], *_names(commit), *form.fields[2:]])


def _place(n: int, *before: int) -> Column:
    """0 to n - 1, by a hash of graph_id."""
    return F.pmod(F.xxhash64(*map(F.lit, before), F.col("graph_id").cast("string")), F.lit(n))


def _hash(graph_id: str, *before: int) -> int:
    """Spark's xxhash64 of some ints and then a string: each value's hash is the next one's seed."""
    seed = _SEED
    for i in before:
        seed = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed)
    h = xxhash.xxh64_intdigest(graph_id.encode(), seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def _may_hold(kept: dict, graph_id: str) -> bool:
    """Whether a segment's filter has the bits of ``graph_id``."""
    words = np.frombuffer(zlib.decompress(base64.b64decode(kept["words"])), np.uint64)
    places = (_hash(graph_id, i) % kept["bits"] for i in range(FILTER_HASHES))
    return all(int(words[p // 64]) >> p % 64 & 1 for p in places)
