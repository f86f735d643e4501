"""Edges that follow a stream of references.

Each micro-batch is resolved by the batch operators and its edges are written to a folder of the batch's number, so a
batch that is run again after a failure replaces its own rows and nothing is counted twice. The edges so far are the
merge of all batches; they stay small, as each batch has an edge between two modules once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from modgraph.operators import graph, resolve


def follow(stream: DataFrame, modules: DataFrame, folder: str, package: str | None = None, **trigger) -> StreamingQuery:
    """Start to write the edges of a stream (source, prefix, segments); trigger as for ``DataStreamWriter.trigger``."""

    def write(batch: DataFrame, number: int) -> None:
        edges = graph.edges_of(resolve.targets(batch.distinct(), modules, package))
        edges.write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")

    writer = stream.select("source", "prefix", "segments").writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def edges_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target, apis) of all batches that have been written."""
    schema = "source string, target string, apis array<string>, batch long"
    return graph.merged([spark.read.schema(schema).parquet(f"{folder}/edges").drop("batch")])
