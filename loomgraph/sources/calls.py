"""Calls to a service, each made once: its answer is kept under its request's key before the task goes on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.shared import new_path, write_table

Post = Callable[[str, dict, float], tuple[int | None, str | None]]


class AnswerCache:
    """Answers as small files in a folder that all tasks see, by the hash of what was asked.

    A file is written beside its place and then moved there, so it is whole or not there.
    A lost task's next attempt finds the answers of the calls that the lost one made; only
    an answer that was on its way when the task died is asked for again. Without
    speculative execution no two tasks ask the same.
    """

    def __init__(self, path: str):
        self.fs, self.base = filesystems.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (filesystems.LocalFileSystem(), path)
        self.fs.create_dir(self.base, recursive=True)

    def get(self, key: str) -> dict | None:
        place = f"{self.base}/{key}"
        if self.fs.get_file_info(place).type != filesystems.FileType.File:
            return None
        with self.fs.open_input_stream(place) as f:
            return json.loads(f.read())

    def put(self, key: str, answer: dict) -> None:
        draft = f"{self.base}/_{key}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(answer).encode())
        self.fs.move(draft, f"{self.base}/{key}")


def call_key(url: str, *parts: Column) -> Column:
    """What a call is told by: where it goes, whose it is and what it asks."""
    return F.sha2(F.to_json(F.array(F.lit(url), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


def _ask(batches: Iterator[pa.RecordBatch], url: str, timeout: float, post: Post, cache: str) -> Iterator[pa.RecordBatch]:
    kept = AnswerCache(cache)
    for b in batches:
        status, body = [], []
        for key, request in zip(b.column("call_key").to_pylist(), b.column("request").to_pylist()):
            answer = kept.get(key)
            if answer is None:
                code, text = post(url, json.loads(request), timeout)
                answer = {"http_status": code, "body": text}
                kept.put(key, answer)
            status.append(answer["http_status"])
            body.append(answer["body"])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status, pa.int32()), pa.array(body, pa.string())], names=[*b.schema.names, "http_status", "body"])


def call_once(requests: DataFrame, url: str, timeout: float, post: Post, concurrency: int = 4, cache: str | None = None) -> DataFrame:
    """``requests`` (call_key, request: JSON) with http_status and body, as a table.

    ``concurrency`` tasks call at a time. ``cache``: a folder of answers that outlives
    this call; a table that was asked before is answered from it. None: one for this call alone.
    """
    cache = cache or new_path(requests.sparkSession, "answers")
    schema = T.StructType([*requests.schema.fields, T.StructField("http_status", T.IntegerType()), T.StructField("body", T.StringType())])
    # Written first: what is asked must not change between the attempts of a task.
    asked = write_table(requests, "requests").repartition(concurrency, "call_key")
    return write_table(asked.mapInArrow(partial(_ask, url=url, timeout=timeout, post=post, cache=cache), schema), "answered")
