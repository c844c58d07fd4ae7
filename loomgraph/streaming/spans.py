"""Documents that arrive as a stream: each micro-batch is cut, extracted and added to the graph store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.project import edge_rows, vertex_rows
from loomgraph.operators.store import GraphStore
from loomgraph.plans.build import build_graphs
from loomgraph.sources.shared import write_table


def stream_graphs(docs: DataFrame, store: GraphStore, checkpoint: str, name: str = "documents", owner: str = "stream", **trigger) -> StreamingQuery:
    """Add each micro-batch's graphs to ``store``, one commit for a batch.

    The commit holds the batch's number under the stream's ``name``: a batch that is run
    again after a failure makes no second one. Namespaces are the doc_ids as text; a
    document that comes again replaces its graph.
    """

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        g = build_graphs(batch)
        rows = [write_table(t.withColumn("graph_id", F.col("graph_id").cast("string")), "arrived") for t in (vertex_rows(g.nodes), edge_rows(g.edges))]
        store.replace(*rows, owner, batch=(name, number))

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
