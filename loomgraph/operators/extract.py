"""Extraction per span: a rule-based extractor, gates over replayed or remote responses, contract checks, enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import neutral_surface, numbered

#: Fixed values of the extraction contract.
RELATION_FAMILIES = (
    "COMPOSITION", "DATA_FLOW", "PROCESSING_SEQUENCE", "DEPENDENCY", "VALIDATION_QUALITY",
    "RESPONSIBILITY_OWNERSHIP", "LIFECYCLE_VERSION", "CONDITION_REQUIREMENT", "CAUSAL_RESULT", "ASSERTION_CONTEXT",
)
MODALITIES = ("ASSERTED", "REQUIRED", "POSSIBLE", "PLANNED", "HISTORICAL")
NO_FACT_REASONS = ("heading_or_fragment", "pure_context", "duplicate_statement", "no_binary_relation")
MAX_ENTITIES, MAX_RELATIONS, MAX_DESCRIPTION = 60, 40, 300
#: How a unit's call can end.
OUTCOMES = ("accepted", "transport_failed", "provider_response_rejected", "tool_contract_failed", "schema_failed", "evidence_failed")

EXTRACTION = (
    "struct<status:string,entities:array<struct<canonical_name:string,entity_type:string>>,"
    "relations:array<struct<source_entity_index:int,target_entity_index:int,relation_family:string,raw_relation:string,"
    "condition:string,modality:string,quantity:string,version:string,negated:boolean>>,"
    "temporal_bindings:array<struct<relation_index:int,surface:string>>,no_graph_fact_reason:string>"
)
_KEYS = ("status", "entities", "relations", "temporal_bindings", "no_graph_fact_reason")
TOOL = "record_facts"


def _ruled(spans: DataFrame) -> tuple[DataFrame, Column, Callable[[int], Column], Column, Column]:
    """``spans`` with _w and _n, their words; whether a span states a fact, its words by their place, family and relation."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = F.col("_n")
    word = lambda i: F.try_element_at("_w", F.lit(i))
    family = F.element_at(F.array(*map(F.lit, RELATION_FAMILIES)), F.pmod(n, F.lit(10)) + 1)
    relation = F.array_join(F.slice("_w", 2, F.greatest(F.lit(1), F.least(F.lit(2), n - 2))), " ")
    return spans.withColumn("_w", words).withColumn("_n", F.size("_w")), n >= 3, word, family, relation


def rule_extraction(spans: DataFrame) -> DataFrame:
    """``spans`` with ``extraction``: what ``rule_extract`` writes as JSON, for what needs no text in between."""
    worded, fact, word, family, relation = _ruled(spans)
    null = F.lit(None).cast("string")
    entity = lambda i: F.struct(word(i).alias("canonical_name"), F.lit("TERM").alias("entity_type"))
    said = F.struct(
        F.lit(0).alias("source_entity_index"), F.lit(1).alias("target_entity_index"), family.alias("relation_family"), relation.alias("raw_relation"),
        null.alias("condition"), null.alias("modality"), null.alias("quantity"), null.alias("version"), F.lit(False).alias("negated"))
    some = lambda *items: F.when(fact, F.array(*items)).otherwise(F.array())
    body = F.struct(
        F.when(fact, "facts_present").otherwise("no_graph_fact").alias("status"), some(entity(1), entity(-1)).alias("entities"), some(said).alias("relations"),
        F.array().cast("array<struct<relation_index:int,surface:string>>").alias("temporal_bindings"), F.when(~fact, "heading_or_fragment").alias("no_graph_fact_reason"))
    return worded.withColumn("extraction", body.cast(EXTRACTION)).drop("_w", "_n")


def rule_extract(spans: DataFrame) -> DataFrame:
    """``spans`` with ``arguments``: the JSON that an extractor would return.

    First and last word are the entities, up to two words after the first the
    relation; spans of fewer than three words state no fact.
    """
    worded, fact, word, family, relation = _ruled(spans)
    # Words are letters and digits, which JSON needs no escapes for: the text is put together without a writer.
    said = F.concat(
        F.lit('{"status":"facts_present","entities":[{"canonical_name":"'), word(1), F.lit('","entity_type":"TERM"},{"canonical_name":"'), word(-1),
        F.lit('","entity_type":"TERM"}],"relations":[{"source_entity_index":0,"target_entity_index":1,"relation_family":"'), family, F.lit('","raw_relation":"'), relation,
        F.lit('","condition":null,"modality":null,"quantity":null,"version":null,"negated":false}],"temporal_bindings":[],"no_graph_fact_reason":null}'))
    none = lambda reason: F.lit(f'{{"status":"no_graph_fact","entities":[],"relations":[],"temporal_bindings":[],"no_graph_fact_reason":{reason}}}')
    arguments = F.when(fact, said).when(~fact, none('"heading_or_fragment"')).otherwise(none("null"))
    return worded.withColumn("arguments", arguments).drop("_w", "_n")


def replay(spans: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with the ``arguments`` that were recorded for them; spans without a record get null."""
    return spans.join(recorded.select(*keys, "arguments"), keys, "left")


def contract_violations(extraction, arguments):
    """Array of the rules of the extraction contract that the parsed ``extraction`` breaks; the keys are looked up in the JSON itself."""
    e = extraction
    n = F.size(e["entities"])
    flag = lambda bad, rule: F.when(F.coalesce(bad, F.lit(True)), F.lit(rule))
    present, absent = e["status"] == "facts_present", e["status"] == "no_graph_fact"
    outside = lambda i: i.isNull() | (i < 0) | (i >= n)
    bindings = F.transform(e["temporal_bindings"], lambda b: b["relation_index"])
    keys = F.json_object_keys(arguments)
    return F.array_compact(F.array(
        flag(F.size(F.array_except(F.array(*map(F.lit, _KEYS)), keys)) > 0, "missing_key"),
        flag(F.size(F.array_except(keys, F.array(*map(F.lit, _KEYS)))) > 0, "unknown_key"),
        flag(~(present | absent), "status"),
        flag(present & ((n == 0) | (F.size(e["relations"]) == 0) | e["no_graph_fact_reason"].isNotNull()), "facts_incomplete"),
        flag(absent & ((n > 0) | (F.size(e["relations"]) > 0) | (F.size(e["temporal_bindings"]) > 0) | ~F.coalesce(e["no_graph_fact_reason"].isin(*NO_FACT_REASONS), F.lit(False))), "no_fact_inconsistent"),
        flag(F.exists(e["entities"], lambda x: F.coalesce(x["canonical_name"], F.lit("")).eqNullSafe("") | F.coalesce(x["entity_type"], F.lit("")).eqNullSafe("")), "empty_name"),
        flag(F.exists(e["relations"], lambda r: outside(r["source_entity_index"]) | outside(r["target_entity_index"])), "entity_index"),
        flag(F.exists(e["relations"], lambda r: ~F.coalesce(r["relation_family"].isin(*RELATION_FAMILIES), F.lit(False))), "relation_family"),
        flag(F.exists(e["relations"], lambda r: F.coalesce(r["raw_relation"], F.lit("")) == ""), "raw_relation"),
        flag(F.exists(e["relations"], lambda r: r["modality"].isNotNull() & ~r["modality"].isin(*MODALITIES)), "modality"),
        flag(F.exists(e["relations"], lambda r: r["negated"].isNull()), "negated"),
        flag(F.exists(bindings, lambda i: i.isNull() | (i < 0) | (i >= F.size(e["relations"]))), "binding_index"),
        flag(F.size(F.array_distinct(bindings)) != F.size(bindings), "binding_repeated"),
        flag((n > MAX_ENTITIES) | (F.size(e["relations"]) > MAX_RELATIONS), "too_many"),
    ))


def temporal_evidence_failed(extraction, span):
    """Whether some binding's surface isn't in the span (from neutral_surface), white space aside."""
    return F.exists(extraction["temporal_bindings"], lambda b: ~F.coalesce(span.contains(F.trim(F.regexp_replace(b["surface"], r"(?U)\s+", " "))), F.lit(False)))


_MESSAGE = (
    "struct<choices:array<struct<finish_reason:string,message:struct<content:string,reasoning:string,reasoning_content:string,"
    "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>>"
)


def gate_responses(responses: DataFrame, allow_reasoning: bool = False) -> DataFrame:
    """``responses`` (text, http_status, body) with arguments, extraction, terminal_outcome, terminal_subcategory and token counts.

    The checks run in order and the first that fails decides: transport, choices,
    finish reason, reasoning policy, tool call, arguments, contract, temporal
    evidence. A null http_status is a timeout.
    """
    parsed = responses.withColumn("_b", F.from_json("body", _MESSAGE))
    choice = F.get("_b.choices", F.lit(0))
    calls = choice["message"]["tool_calls"]
    function = F.get(calls, F.lit(0))["function"]
    out = parsed.withColumns({
        "_choice": choice, "_calls": F.coalesce(F.size(calls), F.lit(0)), "_name": function["name"], "arguments": function["arguments"],
    })
    out = out.withColumns({"extraction": F.from_json("arguments", EXTRACTION), "_span": neutral_surface(F.col("text"))})
    valid_json = F.coalesce(F.col("arguments").rlike(r"(?s)^\s*\{"), F.lit(False)) & F.json_object_keys("arguments").isNotNull()
    reasoning = F.coalesce(F.col("_choice.message.reasoning"), F.col("_choice.message.reasoning_content"))
    sub = (
        F.when(F.col("http_status").isNull(), "timeout").when(F.col("http_status") >= 400, "http_error")
        .when(F.col("_choice").isNull(), "missing_choices")
        .when(~F.coalesce(F.col("_choice.finish_reason").isin("tool_calls", "stop"), F.lit(False)), "invalid_finish_reason")
        .when(F.lit(not allow_reasoning) & (F.coalesce(reasoning, F.lit("")) != ""), "reasoning_policy_violation")
        .when(F.col("_calls") != 1, "tool_contract_violation").when(~F.col("_name").eqNullSafe(TOOL), "wrong_tool_name")
        .when(~valid_json, "malformed_arguments")
        .when(F.size(contract_violations(F.col("extraction"), F.col("arguments"))) > 0, "pydantic_validation_failed")
        .when(temporal_evidence_failed(F.col("extraction"), F.col("_span")), "temporal_evidence_failed")
        .otherwise("accepted")
    )
    out = out.withColumn("terminal_subcategory", sub)
    outcome = (
        F.when(F.col("terminal_subcategory").isin("timeout", "http_error"), OUTCOMES[1])
        .when(F.col("terminal_subcategory").isin("missing_choices", "invalid_finish_reason", "reasoning_policy_violation"), OUTCOMES[2])
        .when(F.col("terminal_subcategory").isin("tool_contract_violation", "wrong_tool_name", "malformed_arguments"), OUTCOMES[3])
        .when(F.col("terminal_subcategory") == "pydantic_validation_failed", OUTCOMES[4])
        .when(F.col("terminal_subcategory") == "temporal_evidence_failed", OUTCOMES[5]).otherwise(OUTCOMES[0])
    )
    usage = F.col("_b.usage")
    tokens = {k: F.coalesce(usage[k], F.lit(0)) for k in ("prompt_tokens", "completion_tokens")}
    return out.withColumns({
        "terminal_outcome": outcome, **tokens, "total_tokens": tokens["prompt_tokens"] + tokens["completion_tokens"], "reasoning_present": F.coalesce(reasoning, F.lit("")) != "",
    }).drop("_b", "_choice", "_calls", "_name", "_span")


def span_offsets(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``extracted`` with _e0 and _r0: how many entities and relations the spans before it have, by slim windows over spans."""
    before = W.partitionBy(key).orderBy("span_no").rowsBetween(W.unboundedPreceding, -1)
    size = lambda what: F.greatest(F.size(f"extraction.{what}"), F.lit(0))
    # Relations of a span without entities join nothing and aren't numbered.
    sizes = {"_e0": size("entities"), "_r0": F.when(size("entities") > 0, size("relations"))}
    return extracted.withColumns({name: F.coalesce(F.sum(n).over(before), F.lit(0)) for name, n in sizes.items()})


def _local_id(number: Column) -> Column:
    return numbered("M", number)


def local_entities(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, local_id, name, type, span_id, unit_id, span_no, index): the entities of all spans, numbered in source order.

    A span's first entity comes after those of the spans before it; with ``span_offsets`` of an earlier step nothing is shuffled.
    """
    if "_e0" not in extracted.columns:
        extracted = span_offsets(extracted, key)
    each = extracted.select(key, "span_no", "span_id", "unit_id", "_e0", F.posexplode("extraction.entities").alias("index", "_e"))
    return each.withColumn("ordinal", (F.col("_e0") + F.col("index") + 1).cast("int")).select(
        key, "ordinal", _local_id(F.col("ordinal")).alias("local_id"), F.col("_e.canonical_name").alias("name"),
        F.col("_e.entity_type").alias("type"), "span_id", "unit_id", "span_no", "index",
    )


def local_relations(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, source/target_local_id, raw_relation, relation_family, relation_description, span_id, unit_id, support_level, qualifiers).

    Local ids follow from the place of the relation's entities in their span, as in ``local_entities``; an index without an entity is null.
    """
    if "_e0" not in extracted.columns:
        extracted = span_offsets(extracted, key)
    each = extracted.select(key, "span_no", "span_id", "unit_id", "extraction", "_e0", "_r0", F.posexplode("extraction.relations").alias("index", "_r"))
    binding = F.get(F.transform(F.filter("extraction.temporal_bindings", lambda b: b["relation_index"] == F.col("index")), lambda b: b["surface"]), F.lit(0))
    q = F.struct(
        binding.alias("temporality"), F.col("_r.condition").alias("condition"), F.coalesce("_r.modality", F.lit("ASSERTED")).alias("modality"),
        F.col("_r.negated").alias("negated"), F.col("_r.quantity").alias("quantity"), F.col("_r.version").alias("version"),
    )
    local = lambda end: F.when(
        F.col(f"_r.{end}_entity_index").between(0, F.size("extraction.entities") - 1), _local_id((F.col("_e0") + F.col(f"_r.{end}_entity_index") + 1).cast("int")))
    return each.where(F.size("extraction.entities") > 0).select(
        key, (F.col("_r0") + F.col("index") + 1).cast("int").alias("ordinal"), local("source").alias("source_local_id"),
        local("target").alias("target_local_id"), F.col("_r.raw_relation").alias("raw_relation"),
        F.col("_r.relation_family").alias("relation_family"), F.col("_r.raw_relation").alias("relation_description"), "span_id", "unit_id",
        F.lit("EXPLICIT").alias("support_level"), q.alias("qualifiers"),
    )


def local_violations(entities: DataFrame, relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, unit_id, rule) of units whose local entities and relations don't fit each other or the limits.

    ``entities``: key, unit_id, local_id, span_id; ``relations``: key, unit_id,
    source/target_local_id, span_id, relation_description.
    """
    unit = [key, "unit_id"]
    ids = entities.select(*unit, "local_id").distinct()
    ends = relations.select(*unit, F.explode(F.array("source_local_id", "target_local_id")).alias("local_id"))
    of = lambda df, rule: df.select(*unit, F.lit(rule).alias("rule")).distinct()
    many = lambda df, n: df.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n)
    found = (
        of(entities.groupBy(*unit, "local_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "duplicate_local_id"),
        of(entities.where(~F.coalesce(F.col("local_id").rlike(r"\AM[0-9]{3,}\z"), F.lit(False))), "local_id_form"),
        of(ends.join(ids, [*unit, "local_id"], "left_anti"), "undeclared_endpoint"),
        of(many(entities, MAX_ENTITIES), "too_many_entities"), of(many(relations, MAX_RELATIONS), "too_many_relations"),
        of(relations.where(F.length("relation_description") > MAX_DESCRIPTION), "long_description"),
        of(entities.select(*unit, "span_id").unionByName(relations.select(*unit, "span_id")).where(F.coalesce("span_id", F.lit("")) == ""), "no_evidence"),
    )
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def single_span(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as one span, S001 of unit 1, for extraction of single texts with the operators for spans."""
    n = F.length(text)
    return texts.select(key, F.lit(1).alias("unit_no"), F.lit(1).alias("span_no"), F.lit("S001").alias("span_id"), F.lit("U001_S001").alias("unit_id"), F.col(text).alias("text"),
                        F.lit(0).alias("start_offset"), n.alias("end_offset"), F.lit(0).alias("document_start"), n.alias("document_end"))


def unknown_evidence(relations: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Relations whose span isn't one of their document's."""
    return relations.join(spans.select(key, "span_id"), [key, "span_id"], "left_anti")
