"""Whether a model service can be used: a table of its answers to plain, tool and production requests, judged by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import audit
from loomgraph.operators.extract import EXTRACTION, TOOL
from loomgraph.operators.report import compare_golden

PROBE_TOOL = "give_value"
#: Why a probe fails. Of a kind's rules, each a set of what is seen, the first that fits names the reason.
REASONS = (
    ("plain", "CHAT_TEMPLATE_KWARGS_IGNORED_OR_UNSUPPORTED", {"reasoning_allowed": False}),
    ("plain", "OUTPUT_BUDGET_EXHAUSTED", {"truncated": True}),
    ("plain", "PLAIN_CHAT_FAILED", {}),
    ("tool", "SERVER_TOOL_CHOICE_MODE_UNSUPPORTED", {"http_status": 500}),
    ("tool", "OUTPUT_BUDGET_EXHAUSTED", {"truncated": True}),
    ("tool", "THINKING_DISABLE_PARAMETER_IGNORED", {"reasoning_present": True}),
    ("tool", "SERVER_TOOL_PARSER_MISSING", {"tool_calls": 0, "call_mark_present": True}),
    ("tool", "MODEL_DID_NOT_CALL_TOOL", {"tool_calls": 0}),
    ("tool", "TOOL_PARSER_OR_MODEL_OUTPUT_INVALID", {}),
    ("production", "PRODUCTION_SCHEMA_QUALIFICATION_FAILED", {}),
)
#: What a golden contract's failed checks are called in a probe.
ASSERTIONS = {"required_relation": "MISSING_REQUIRED_RELATION", "forbidden_relation": "FORBIDDEN_CONTEXT_ENDPOINT", "required_qualifier": "QUALIFIER_RECALL_FAILURE"}


def _reason() -> Column:
    out = None
    for kind, reason, seen in REASONS:
        fits = F.col("kind") == kind
        for name, value in seen.items():
            fits = fits & F.col(name).eqNullSafe(F.lit(value))
        out = F.when(fits, reason) if out is None else out.when(fits, reason)
    return out


def judge_answers(answers: DataFrame, policy: str = "require_empty", finish_reasons: tuple[str, ...] = audit.FINISH_REASONS) -> DataFrame:
    """``answers`` (kind: plain, tool or production; text, http_status, body) with what each holds, result (PASS or FAIL) and classification.

    A plain chat passes with content or reasoning, a tool request with one call of the
    probe's tool whose arguments are an object, a production request as
    ``evaluate_responses`` has it. Reasoning must be as ``policy`` says, and nothing cut off.
    A passed answer has no classification.
    """
    tools = F.when(F.col("kind") == "production", TOOL).otherwise(PROBE_TOOL)
    seen = audit.evaluate_responses(answers, policy, finish_reasons, tools)
    content = F.coalesce(F.get_json_object("body", "$.choices[0].message.content"), F.lit(""))
    there, apart = F.col("reasoning_present"), F.col("reasoning_separated")
    seen = seen.withColumns({
        "content_present": content != "", "call_mark_present": content.contains(audit.SPECIAL_MARKS[-1]), "reasoning_absent": ~there,
        "reasoning_allowed": {"require_empty": ~there, "allow_nonempty": F.when(F.col("kind") == "plain", there).otherwise(apart), "any": F.lit(True)}[policy],
    })
    answered = (F.col("http_status") == 200) & F.col("reasoning_allowed")
    called = F.col("correct_function") & F.col("arguments_json_object") & ~F.col("special_marks_present") & F.col("finish_reason").isin(*finish_reasons)
    good = (
        F.when(F.col("kind") == "plain", answered & (F.col("content_present") | there) & ~F.col("truncated"))
        .when(F.col("kind") == "tool", answered & called).otherwise(F.col("result") == "PASS")
    )
    good = F.coalesce(good, F.lit(False))
    return seen.withColumns({"result": F.when(good, "PASS").otherwise("FAIL"), "classification": F.when(~good, _reason())}).drop("call_mark_present", "reasoning_allowed")


def answered_facts(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures) of production answers (g, body): what their only tool call states, as a graph; failures: g, failure."""
    call = "$.choices[0].message.tool_calls"
    parsed = answers.select("g", F.get_json_object("body", f"{call}[0].function.arguments").alias("a"), F.get_json_object("body", f"{call}[1]").alias("more"))
    parsed = parsed.withColumn("e", F.from_json("a", EXTRACTION))
    n = F.size("e.entities")
    sound = F.col("e.entities").isNotNull() & F.coalesce(F.forall("e.relations", lambda r: r["source_entity_index"].between(0, n - 1) & r["target_entity_index"].between(0, n - 1)), F.lit(False))
    failure = F.when(F.col("a").isNull() | F.col("more").isNotNull(), "NO_TOOL_CALL").when(~sound, "SCHEMA_INVALID_RESPONSE")
    parsed = parsed.withColumn("failure", failure)
    fine = parsed.where("failure is null")
    nodes = fine.select("g", F.posexplode("e.entities").alias("i", "x")).select("g", F.col("i").cast("string").alias("entity_id"), F.col("x.canonical_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    each = fine.select("g", "e", F.posexplode("e.relations").alias("ordinal", "r"))
    time = F.get(F.transform(F.filter("e.temporal_bindings", lambda b: b["relation_index"] == F.col("ordinal")), lambda b: b["surface"]), F.lit(0))
    said = F.struct(time.alias("temporality"), *(F.col(f"r.{k}").alias(k) for k in ("condition", "modality")), F.coalesce("r.negated", F.lit(False)).alias("negated"), *(F.col(f"r.{k}").alias(k) for k in ("quantity", "version")))
    edges = each.select("g", "ordinal", *(F.col(f"r.{e}_entity_index").cast("string").alias(f"{e}_entity_id") for e in ("source", "target")), F.col("r.raw_relation").alias("raw_relation"), said.alias("qualifiers"))
    return nodes, edges, parsed.where("failure is not null").select("g", "failure")


def semantic_failures(answers: DataFrame, required: DataFrame, forbidden: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """(g, failure): what each production answer (g, body) lacks of a golden contract, or states against it.

    ``required`` and ``forbidden``: source, raw_relation, target and negated;
    ``qualifiers``: source, raw_relation, field, value: what concerns the text that was asked about.
    """
    nodes, edges, failures = answered_facts(answers)
    none = required.sparkSession.createDataFrame([], "a string, b string")
    out = failures
    for g in [r["g"] for r in answers.select("g").distinct().collect()]:  # a probe's repeats
        own = [t.where(F.col("g") == g) for t in (nodes, edges, failures)]
        lost = compare_golden(own[0], own[1], required, forbidden, none, none, qualifiers=qualifiers)
        code = F.create_map(*(F.lit(x) for pair in ASSERTIONS.items() for x in pair))[F.col("check")]
        # An answer that can't be read lacks all, which its own failure says.
        lost = lost.where(code.isNotNull()).join(own[2].select(F.lit(True).alias("_unread")).limit(1), F.lit(True), "left_anti")
        out = out.unionByName(lost.select(F.lit(g).alias("g"), F.concat_ws(":", code, "detail").alias("failure")))
    return out
