"""Identifiers that are hashes of canonical JSON."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUALIFIERS = ("condition", "modality", "negated", "quantity", "temporality", "version")
#: The forms of ids (matched whole), and what a run's identity is made of, in the order of its canonical JSON.
RUN_ID, GRAPH_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}"), re.compile(r"fact_extraction_[A-Za-z0-9][A-Za-z0-9._-]*")
IDENTITY = ("contract_id", "prompt_hash", "provider_profile_id", "run_id", "schema_hash", "source_sha256")


def lower_escapes(json_text: Column) -> Column:
    """JSON text with its escapes of control characters in lower case, as Python writes them; text without any is not searched for them."""
    lower = json_text
    for c in "ABCDEF":
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00([01]){c}", rf"$1\\u00$2{c.lower()}")
    return F.when(F.contains(json_text, F.lit("\\u00")), lower).otherwise(json_text)


def json_string(text: Column) -> Column:
    """A string as JSON, quoted; control characters as lower-case escapes.

    Text of other characters only needs its quotes and backslashes escaped; that is
    done without a JSON writer. A null is written like one.
    """
    written = lower_escapes(F.regexp_replace(F.substring(F.to_json(F.array(text)), 2, 2_147_483_647), r"\]$", ""))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(~text.rlike(r"[\x00-\x1f\x{FFFD}]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(written)


def json_value(value: Column) -> Column:
    return F.coalesce(json_string(value), F.lit("null"))


def qualifiers_json(qualifiers: Column) -> Column:
    """Keys sorted, nulls kept, ``", "`` and ``": "`` between."""
    parts = [
        F.concat(F.lit(f'"{q}": '), F.when(qualifiers[q], "true").otherwise("false") if q == "negated" else json_value(qualifiers[q]))
        for q in QUALIFIERS
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def provenance_json(provenance: Column) -> Column:
    return F.concat(F.lit('{"prompt_id": '), json_value(provenance["prompt_id"]), F.lit(', "source": '), json_value(provenance["source"]), F.lit("}"))


def _written_qualifiers(qualifiers: Column) -> Column:
    """``qualifiers_json`` as a JSON string; where only the modality says something, the text is known but for that."""
    negated = F.when(qualifiers["negated"], "true").otherwise("false")
    plain = F.concat(
        F.lit(r'"{\"condition\": null, \"modality\": \"'), qualifiers["modality"], F.lit(r'\", \"negated\": '), negated,
        F.lit(r', \"quantity\": null, \"temporality\": null, \"version\": null}"'))
    none = F.coalesce(*(qualifiers[q] for q in QUALIFIERS if q not in ("modality", "negated"))).isNull()
    return F.when(none & F.coalesce(qualifiers["modality"].rlike(r"\A[A-Z_]++\z"), F.lit(False)), plain).otherwise(json_string(qualifiers_json(qualifiers)))


def edge_id(source: Column, raw: Column, target: Column, spans: Column, qualifiers: Column) -> Column:
    """``R_`` and 16 hex digits of the hash of what an edge states and where."""
    span_list = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(spans), json_string), ","), F.lit("]"))
    negated = F.when(qualifiers["negated"], "true").otherwise("false")
    body = F.concat_ws(
        ",", json_string(source), json_string(raw), json_string(target), span_list, _written_qualifiers(qualifiers),
        F.lit('"forward"'), negated, json_value(qualifiers["modality"]),
    )
    return F.concat(F.lit("R_"), F.substring(F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256), 1, 16))


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def new_run_id() -> str:
    return f"run_{uuid.uuid4().hex}"


def check_run_id(run_id: str) -> str:
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"bad run id {run_id!r}")
    return run_id


def graph_id(run_id: str, identity: dict) -> tuple[str, str]:
    """(manifest hash, graph id) of a run's identity: its id and the other fields of IDENTITY."""
    if set(identity) | {"run_id"} != set(IDENTITY):
        raise ValueError(f"an identity has the fields {IDENTITY}")
    digest = sha256_json(identity | {"run_id": check_run_id(run_id)})
    return digest, f"fact_extraction_{run_id}_{digest[:12]}"


def identity_columns(fields: dict[str, Column]) -> tuple[Column, Column]:
    """(manifest hash, graph id) like ``graph_id``, of a column for each field; null where one is."""
    body = F.concat(F.lit("{"), F.concat(*(x for i, k in enumerate(IDENTITY) for x in (F.lit(f'{"," if i else ""}"{k}":'), json_string(fields[k])))), F.lit("}"))
    digest = F.sha2(body, 256)
    return digest, F.concat(F.lit("fact_extraction_"), fields["run_id"], F.lit("_"), F.substring(digest, 1, 12))


def table_hash(df, key: str, columns: list[str]):
    """(key, hash): one hash for the rows of each key, whatever their order: of their canonical JSON rows, sorted.

    Rows are hashed where they lie, so only 64 digits of each are gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256).alias("hash"))


def _relation_hashes(lists: pd.Series) -> pd.Series:
    one = lambda raw: hashlib.sha256(" ".join(raw.casefold().split()).encode()).hexdigest()
    return lists.map(lambda raws: None if raws is None else [one(r) for r in raws])


def relation_hash(raws: Column) -> Column:
    """Hashes of an array of relations, each with full case folding and white space collapsed."""
    return F.pandas_udf(_relation_hashes, "array<string>")(raws)


def _vector_hashes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else sha256_json([float(x) for x in v]))


def vector_hash(vector: Column) -> Column:
    """The hash of a vector's canonical JSON; numbers as Python writes them."""
    return F.pandas_udf(_vector_hashes, "string")(vector.cast("array<double>"))
