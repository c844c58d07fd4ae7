"""From documents to graphs: all graphs of a table in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import document_spans
from loomgraph.operators import extract, graph, resolve
from loomgraph.sources.shared import write_table


@dataclass
class Graphs:
    spans: DataFrame
    extracted: DataFrame
    entities: DataFrame
    relations: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @property
    def units(self) -> DataFrame:
        return self.spans.select(F.col("doc_id").alias("g"), "unit_id", F.array("span_id").alias("span_ids"))

    def written(self) -> Graphs:
        """The same with nodes and edges as tables, for what reads them several times."""
        return replace(self, nodes=write_table(self.nodes, "nodes", "g"), edges=write_table(self.edges, "edges", "g"))


def build_graphs(docs: DataFrame, extractor=extract.rule_extraction, resolver=resolve.resolve_by_name, texts: bool = True) -> Graphs:
    """Graphs of all documents, one namespace each.

    ``extractor``: spans -> spans with ``extraction``, or with ``arguments`` (its JSON); ``resolver``: local
    entities -> the same with entity_id. What both return is written as a table in
    the shared folder: all that follows reads it several times, and an extractor or
    resolver must not run again for that. Without ``texts`` neither texts nor offsets of
    spans are kept: for what asks for a span's ids only. Tables lie in buckets by document,
    so that nodes, edges and what is asked of a graph are made without another exchange.
    """
    spans = document_spans(docs)
    extracted = extractor(spans)
    if "extraction" not in extracted.columns:
        extracted = extracted.withColumn("extraction", F.from_json("arguments", extract.EXTRACTION))
    left_out = () if texts else ("text", "start_offset", "end_offset", "document_start", "document_end")
    extracted = write_table(extract.span_offsets(extracted).drop(*left_out), "extracted", "doc_id")
    spans = extracted.select([c for c in spans.columns if c not in left_out])
    local = extract.local_entities(extracted)
    relations = extract.local_relations(extracted)
    named = resolver(local.select(
        F.col("doc_id").alias("g"), F.col("ordinal").alias("ord"), "local_id", "name", "type", "span_id", F.col("unit_id").alias("unit")))
    entities = write_table(named if resolver is resolve.resolve_by_name else named.repartition("g"), "entities", "g")
    edges, _ = graph.dedup_edges(graph.project_edges(relations.withColumnRenamed("doc_id", "g"), entities))
    return Graphs(spans, extracted, entities, relations, graph.consolidate_nodes(entities), edges)
