"""Extension: keep a layer store fresh from a stream of payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from territory.operators import network as N
from territory.operators.diagnostic import LayerStore


def refresh_network(spark: SparkSession, folder: str, store: LayerStore, checkpoint: str, ring=None) -> StreamingQuery:
    """Road payloads that arrive in a folder (``<code>.json``) replace the links and nodes layers of their code.

    A batch is written whole or again: each write is a new version of its layer, so repeats change nothing. Nodes keep their
    ids from payload to payload (``network.extend_ids``); new ends are numbered after them, and ends that are gone keep theirs.
    """
    from pyspark.sql import functions as F

    files = spark.readStream.format("text").option("wholetext", "true").load(folder).withColumn("code", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))

    def write(batch: DataFrame, _: int) -> None:
        for (code,) in batch.select("code").distinct().collect():  # the payloads of a batch, a few names
            known = store.read(f"osm_nodes_{code}") if store.versions(f"osm_nodes_{code}") else None
            links, nodes = N.build_network(N.parse_elements(batch.where(F.col("code") == code)), ring, known=known)
            store.write(f"osm_links_{code}", links)
            store.write(f"osm_nodes_{code}", nodes)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
