"""Entity resolution: the decision cascade over similar pairs, components of the merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import collapsed, name_relation, numbered, relation_key
from loomgraph.operators.components import graph_components
from loomgraph.operators.neighbours import nearest, round6, saved_matrix_pairs, similar_pairs, similarity_matrix, unit_vectors  # noqa: F401
from loomgraph.sources.shared import write_table

#: Relations that state that two names denote the same thing.
EQUIVALENCE_RELATIONS = (
    "alias", "aliases", "also_called", "also_known_as", "denotes_same_as", "equivalent_to", "refers_to", "same_as", "synonymous_with",
)
CANDIDATE, MERGE, PAIRWISE_LIMIT, TOP_K = 0.76, 0.90, 500, 10
#: How candidates were found, in small and in large graphs.
METHODS = ("full_pairwise_cosine_matrix", "top_k_from_full_matrix")
#: First members that one task numbers at most.
NUMBERED = 65_536
DECISIONS = {
    "exact_name_cross_unit_merge": True, "case_only_name_merge": True, "semantic_conflict_blocks_merge": True,
    "require_context_for_semantic_alias_merge": True,
}


def check_thresholds(candidate: float, merge: float) -> None:
    if not 0 <= candidate <= merge <= 1:
        raise ValueError("thresholds must satisfy 0 <= candidate <= merge <= 1")


def top_neighbours(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(g, ord, neighbour, similarity, rank): each one's ``k`` nearest, ties to the larger ordinal."""
    both = pairs.select("g", F.col("l").alias("ord"), F.col("r").alias("neighbour"), "similarity").unionByName(
        pairs.select("g", F.col("r").alias("ord"), F.col("l").alias("neighbour"), "similarity"))
    rank = F.row_number().over(W.partitionBy("g", "ord").orderBy(F.desc("similarity"), F.desc("neighbour")))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(g, l, r, similarity), each pair once, of neighbours as ``nearest`` gives them; both ends' products may differ in the last digit."""
    return neighbours.groupBy("g", F.least("ord", "neighbour").alias("l"), F.greatest("ord", "neighbour").alias("r")).agg(F.max("similarity").alias("similarity"))


def incident_context(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(g, ord, families, descriptions, neighbour_types) from ``relations`` (g, l, r, family, and description if it is there) between known entities."""
    said = relations.withColumn("_d", F.col("description") if "description" in relations.columns else F.lit(None).cast("string"))
    ends = said.select("g", F.col("l").alias("ord"), F.col("r").alias("other"), "family", "_d").unionByName(
        said.select("g", F.col("r").alias("ord"), F.col("l").alias("other"), "family", "_d"))
    types = entities.select("g", F.col("ord").alias("other"), F.col("type").alias("other_type"))
    return ends.join(types, ["g", "other"]).groupBy("g", "ord").agg(
        F.collect_set("family").alias("families"), F.collect_set("_d").alias("descriptions"), F.collect_set("other_type").alias("neighbour_types"))


def relation_evidence(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with explicit equivalence and its evidence, pairs with another direct relation); relations need spans and two ends."""
    usable = relations.where((F.col("l") != F.col("r")) & (F.size("spans") > 0)).withColumns({
        "a": F.least("l", "r"), "b": F.greatest("l", "r"), "same": relation_key(F.col("raw_relation")).isin(*EQUIVALENCE_RELATIONS)})
    equal = usable.where("same").groupBy("g", "a", "b").agg(
        F.sort_array(F.collect_set("relation_id")).alias("equivalence_relation_ids"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("equivalence_span_ids"))
    return equal, usable.where("not same").select("g", "a", "b").distinct()


def decide(entities: DataFrame, relations: DataFrame, pairs: DataFrame, candidate: float = CANDIDATE, merge: float = MERGE, decisions: dict | None = None) -> DataFrame:
    """Each pair with what its decision rests on, ``decision`` and ``reason``; the first rule that fits decides.

    ``entities``: g, ord, name, type, unit and optionally stable_identifier,
    semantic_state, semantic_version, semantic_attributes (map). ``relations``: g, l,
    r, raw_relation, family, relation_id, spans. Pairs of ``pairs`` and all pairs with relation evidence are decided.
    """
    check_thresholds(candidate, merge)
    rules = DECISIONS | (decisions or {})
    typed = [c for c in ("stable_identifier", "semantic_state", "semantic_version") if c in entities.columns]
    attributes = "semantic_attributes" in entities.columns
    context = incident_context(entities, relations)
    full = entities.join(context, ["g", "ord"], "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("families", "neighbour_types")})
    columns = ["ord", "name", "type", "unit", "families", "neighbour_types", *typed, *(["semantic_attributes"] if attributes else [])]
    side = lambda p: full.select("g", *(F.col(c).alias(f"{p}_{c}") for c in columns))
    equal, distinct = relation_evidence(relations)
    out = (
        pairs.join(side("l").withColumnRenamed("l_ord", "l"), ["g", "l"]).join(side("r").withColumnRenamed("r_ord", "r"), ["g", "r"])
        .join(equal.withColumnRenamed("a", "l").withColumnRenamed("b", "r"), ["g", "l", "r"], "left")
        .join(distinct.select("g", F.col("a").alias("l"), F.col("b").alias("r"), F.lit(True).alias("_distinct")), ["g", "l", "r"], "left")
    )
    differ = [F.when(F.col(f"l_{c}").isNotNull() & F.col(f"r_{c}").isNotNull() & (F.col(f"l_{c}") != F.col(f"r_{c}")), F.lit(c)) for c in typed]
    if attributes:
        shared = F.array_intersect(F.map_keys("l_semantic_attributes"), F.map_keys("r_semantic_attributes"))
        clash = F.exists(shared, lambda k: F.element_at("l_semantic_attributes", k) != F.element_at("r_semantic_attributes", k))
        differ.append(F.when(F.coalesce(clash, F.lit(False)), F.lit("semantic_attributes")))
    conflict = F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>")
    out = out.withColumns({
        "name_relation": name_relation(F.col("l_name"), F.col("r_name")), "conflict_fields": conflict,
        "explicit_equivalence": F.col("equivalence_relation_ids").isNotNull(), "direct_distinct": F.coalesce("_distinct", F.lit(False)),
        "different_units": F.col("l_unit") != F.col("r_unit"), "type_match": F.col("l_type") == F.col("r_type"),
        "shared_families": F.sort_array(F.array_intersect("l_families", "r_families")),
        "shared_neighbour_types": F.sort_array(F.array_intersect("l_neighbour_types", "r_neighbour_types")),
    })
    by_name = F.col("different_units") & (
        ((F.col("name_relation") == "EXACT") & F.lit(rules["exact_name_cross_unit_merge"])) | ((F.col("name_relation") == "CASE_ONLY") & F.lit(rules["case_only_name_merge"])))
    out = out.withColumn("context_compatible", by_name | (F.size("shared_families") > 0) | (F.size("shared_neighbour_types") > 0))
    contained = F.col("name_relation") == "TOKEN_CONTAINMENT_EXPANSION"
    cascade = [
        ((F.size("conflict_fields") > 0) & F.lit(rules["semantic_conflict_blocks_merge"]), "KEEP_SEPARATE", "typed conflict"),
        (F.col("direct_distinct") & ~F.col("explicit_equivalence"), "KEEP_SEPARATE", "direct relation"),
        (F.col("explicit_equivalence"), "MERGE", "explicit equivalence"),
        (F.col("similarity") < candidate, "BELOW_CANDIDATE_THRESHOLD", "below candidate threshold"),
        (F.col("similarity") < merge, "UNRESOLVED", "below merge threshold"),
        (contained, "UNRESOLVED", "name expansion"),
        (F.lit(rules["require_context_for_semantic_alias_merge"]) & ~F.col("context_compatible"), "UNRESOLVED", "no context"),
        (F.lit(True), "MERGE", "similar with context"),
    ]
    decision = reason = None
    for when, what, why in cascade:
        decision = F.when(when, what) if decision is None else decision.when(when, what)
        reason = F.when(when, why) if reason is None else reason.when(when, why)
    return out.select(
        "g", "l", "r", "similarity", "type_match", "name_relation", "different_units", "explicit_equivalence", "equivalence_relation_ids", "equivalence_span_ids",
        "direct_distinct", "shared_families", "shared_neighbour_types", "context_compatible", "conflict_fields",
        decision.alias("decision"), reason.alias("reason"),
    ).withColumn("name_expansion_blocked", F.col("reason") == "name expansion")


def select_candidates(decided: DataFrame, neighbours: DataFrame | None) -> DataFrame:
    """Candidates at full matrix (None), or of large graphs only those among either end's nearest or with explicit equivalence."""
    if neighbours is None:
        return decided
    near = neighbours.select("g", F.least("ord", "neighbour").alias("l"), F.greatest("ord", "neighbour").alias("r"), F.lit(True).alias("_near")).distinct()
    return decided.join(near, ["g", "l", "r"], "left").where(F.col("_near") | F.col("explicit_equivalence")).drop("_near")


def entity_ids(entities: DataFrame, component: str) -> DataFrame:
    """``entities`` with entity_id: components of a graph numbered by their first member's ordinal.

    Only first members are numbered, in stretches of ordinals whose counts are summed
    up, so a graph of any size is numbered by many tasks.
    """
    firsts = entities.groupBy("g", component).agg(F.min("ord").alias("_first")).withColumn("_part", F.floor(F.col("_first") / NUMBERED))
    before = W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = firsts.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_n")).select("g", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("g", "_part").orderBy("_first")) + F.col("_before")
    named = firsts.join(parts, ["g", "_part"]).select("g", component, numbered("E", number).alias("entity_id"))
    return entities.join(named, ["g", component])


def resolve(entities: DataFrame, decided: DataFrame) -> DataFrame:
    """``entities`` with the entity_id of the component that the MERGE decisions make; a KEEP_SEPARATE pair may still meet over others."""
    groups = graph_components(decided.where("decision = 'MERGE'"), "g", "l", "r").select("g", F.col("node").alias("ord"), F.col("component").alias("_c"))
    joined = entities.join(groups, ["g", "ord"], "left").withColumn("_c", F.coalesce("_c", "ord"))
    return entity_ids(joined, "_c").drop("_c")


def resolve_by_name(entities: DataFrame) -> DataFrame:
    """``entities`` with the entity_id of all that share their name, case folded and with white space collapsed.

    Numbered as in ``entity_ids``, but by windows in a graph, as graphs come from
    documents whose sentences are numbered in one task as well.
    """
    named = entities.withColumn("_c", collapsed(F.col("name")))
    same = W.partitionBy("g", "_c")
    before = W.partitionBy("g").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = named.withColumn("_first", F.row_number().over(same.orderBy("ord")) == 1)
    counted = first.withColumn("_n", F.when(F.col("_first"), F.sum(F.col("_first").cast("int")).over(before)))
    out = counted.withColumn("entity_id", numbered("E", F.max("_n").over(same)))
    return out.where("g is not null and _c is not null").select(*entities.columns, "entity_id")


def decision_counts(decided: DataFrame) -> DataFrame:
    """(g, decision, pairs) over candidates."""
    return decided.where("decision <> 'BELOW_CANDIDATE_THRESHOLD'").groupBy("g", "decision").agg(F.count(F.lit(1)).alias("pairs"))


def count_decisions(entities: DataFrame, vectors: DataFrame, relations: DataFrame, candidate: float = CANDIDATE, merge: float = MERGE, decisions: dict | None = None) -> DataFrame:
    """``decision_counts`` of all pairs that reach ``candidate`` and of those with evidence, without a row for each.

    Between the thresholds a pair without evidence can only be unresolved: such pairs are
    counted where they are found. Entities of which something typed is known may
    conflict; their pairs are all decided.
    """
    typed = {"stable_identifier", "semantic_state", "semantic_version", "semantic_attributes"} & set(entities.columns)
    floor = candidate if typed else merge
    # One table of pairs for both: those from the floor on, and those that relations join, whatever their similarity.
    joined = relations.where("l <> r").select("g", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    joined = write_table(add_evidence_pairs(joined.limit(0).withColumn("similarity", F.lit(0.0)), vectors, joined), "evidence-pairs")
    near = similar_pairs(vectors, floor).where(F.col("similarity") >= floor).join(joined.select("g", "l", "r"), ["g", "l", "r"], "left_anti")
    counted = decision_counts(decide(entities, relations, near.unionByName(joined), candidate, merge, decisions))
    if typed:
        return counted
    between = (F.col("similarity") >= candidate) & (F.col("similarity") < merge)
    count = lambda pairs, sign: pairs.where(between).groupBy("g").agg((sign * F.count(F.lit(1))).alias("pairs")).select("g", F.lit("UNRESOLVED").alias("decision"), "pairs")
    rest = count(similar_pairs(vectors, candidate), 1).unionByName(count(joined, -1))
    return counted.unionByName(rest).groupBy("g", "decision").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def add_evidence_pairs(pairs: DataFrame, vectors: DataFrame, relations: DataFrame) -> DataFrame:
    """``pairs`` and, with their similarity, the pairs that some relation joins and ``pairs`` lacks."""
    joined = relations.where("l <> r").select("g", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct().join(pairs, ["g", "l", "r"], "left_anti")
    v = lambda e: vectors.select("g", F.col("ord").alias(e), F.col("vector").alias(f"v{e}"))
    more = joined.join(v("l"), ["g", "l"]).join(v("r"), ["g", "r"]).select("g", "l", "r", F.pandas_udf(_cosines, "double")("vl", "vr").alias("similarity"))
    return pairs.unionByName(more)


def _cosines(left: pd.Series, right: pd.Series) -> pd.Series:
    """Like the blocks' products: unit vectors first, rounded alike."""
    if not len(left):
        return pd.Series([], dtype="float64")
    a, b = (unit_vectors(pa.chunked_array([pa.array(x.tolist(), pa.list_(pa.float64()))])) for x in (left, right))
    return pd.Series(round6((a * b).sum(1)))


class Resolution:
    """What ``resolve_entities`` finds, each made when it is asked for and once: entities with entity_id, all decisions, the candidates among them, and a row for each graph on how.

    ``merging``: the decisions of the pairs that may merge; ``decided``: from a floor of similarity to the decisions of the pairs that reach it;
    ``looked_at``: from decisions to those that count; ``summed``: from candidates to the summary.
    """

    def __init__(self, named: DataFrame, candidate: float, merging: DataFrame, decided: Callable, looked_at: Callable, summed: Callable):
        self._named, self._candidate, self._merging, self._decided, self._looked_at, self._summed = named, candidate, merging, decided, looked_at, summed

    @cached_property
    def decisions(self) -> DataFrame:
        return write_table(self._decided(self._candidate), "decisions")

    @cached_property
    def candidates(self) -> DataFrame:
        return write_table(self._looked_at(self.decisions).where("decision <> 'BELOW_CANDIDATE_THRESHOLD'"), "candidates")

    @cached_property
    def entities(self) -> DataFrame:
        # Below the merge threshold only evidence merges, and pairs with evidence are decided in any case.
        known = "candidates" in self.__dict__
        return resolve(self._named, self.candidates if known else write_table(self._looked_at(self._merging).where("decision = 'MERGE'"), "merges"))

    @cached_property
    def summary(self) -> DataFrame:
        return self._summed(self.candidates)


def resolve_entities(
    entities: DataFrame, vectors: DataFrame, relations: DataFrame, candidate: float = CANDIDATE, merge: float = MERGE, decisions: dict | None = None,
    pairwise_limit: int = PAIRWISE_LIMIT, top_k: int = TOP_K,
) -> Resolution:
    """Embeddings to entity ids in one call, for all graphs of a table.

    ``vectors``: g, ord, vector of all ``entities``. All pairs of a graph are
    compared. Graphs of up to ``pairwise_limit`` entities look at every pair that
    reaches ``candidate``; larger ones only at those among either end's ``top_k``
    nearest, whatever their similarity, and at explicitly equivalent ones. Pairs that
    relations join are decided in any case. Merges are made transitive over what is looked at.

    The summary: g, entities, unique_pairs, retrieval_method, top_k (null for small
    graphs), candidate and merge threshold, vector_dimension, candidate_pairs, merged,
    keep_separate and unresolved pairs. A graph of several dimensions, or with an entity
    without a vector, is an error.
    """
    check_thresholds(candidate, merge)
    sizes = entities.groupBy("g").agg(F.count(F.lit(1)).alias("entities"))
    shapes = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("_v"), F.min(F.size("vector")).alias("vector_dimension"), F.max(F.size("vector")).alias("_most"))
    known = sizes.join(shapes, "g", "left")
    wrong = known.where(~F.coalesce((F.col("_v") == F.col("entities")) & (F.col("_most") == F.col("vector_dimension")), F.lit(False))).limit(1).collect()
    if wrong:
        raise ValueError(f"graph {wrong[0]['g']!r}: every entity needs one vector, all of one dimension")
    large = F.col("entities") > pairwise_limit
    # Each graph is compared in the way that it is looked at: no pair of a large graph is made but those among the nearest.
    own = lambda graphs: vectors.select("g", "ord", "vector").join(graphs.select("g"), "g", "left_semi")
    top = write_table(nearest(own(known.where(large)), top_k), "nearest")
    chosen = neighbour_pairs(top)
    small = known.where(~large).select("g", F.lit(True).alias("_small"))

    def decided(floor: float) -> DataFrame:
        pairs = similar_pairs(own(known.where(~large)), floor).where(F.col("similarity") >= floor)
        return decide(entities, relations, add_evidence_pairs(pairs.unionByName(chosen), vectors, relations), candidate, merge, decisions)

    def looked_at(made: DataFrame) -> DataFrame:
        kept = made.join(small, "g", "left").join(chosen.select("g", "l", "r", F.lit(True).alias("_near")), ["g", "l", "r"], "left")
        return kept.where(F.coalesce(F.col("_small"), F.lit(False)) | F.coalesce(F.col("_near"), F.lit(False)) | F.col("explicit_equivalence")).drop("_small", "_near")

    def summed(candidates: DataFrame) -> DataFrame:
        count = lambda d: F.coalesce(F.count_if(F.col("decision") == d), F.lit(0)).alias(d)
        counts = candidates.groupBy("g").agg(F.count(F.lit(1)).alias("_c"), *map(count, ("MERGE", "KEEP_SEPARATE", "UNRESOLVED")))
        zero = lambda c: F.coalesce(c, F.lit(0))
        return known.join(counts, "g", "left").select(
            "g", "entities", (F.col("entities") * (F.col("entities") - 1) / 2).cast("long").alias("unique_pairs"),
            F.when(large, METHODS[1]).otherwise(METHODS[0]).alias("retrieval_method"), F.when(large, F.lit(top_k)).alias("top_k"),
            F.lit(candidate).alias("candidate_threshold"), F.lit(merge).alias("merge_threshold"), "vector_dimension",
            zero("_c").alias("candidate_pairs"), zero("MERGE").alias("merged_pairs"), zero("KEEP_SEPARATE").alias("keep_separate_pairs"), zero("UNRESOLVED").alias("unresolved_pairs"),
        )

    return Resolution(entities, candidate, decided(merge), decided, looked_at, summed)
