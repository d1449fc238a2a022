"""Streams of records: deduplicated arrivals, linkage by micro-batch, windowed counts of decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinledger.config import DEFAULTS, EngineConfig
from kinledger.functions.normalize import normalize_entity
from kinledger.operators.resolve import KINDS, block_keys, blocks, resolve_entities
from kinledger.sources.scratch import written


def first_arrivals(stream: DataFrame, time: str = "last_updated", late: str = "10 minutes", key: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Each key once within the watermark; state is dropped when it is past."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def link_batch(batch: DataFrame, known: DataFrame, config: EngineConfig = DEFAULTS, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Decisions for pairs of a batch's records with each other and with known ones.

    Of the known entities only those that share a block's key with the batch are paired, and none with another known one.
    ``kinds`` are the blocks that count: ("id",) gives the pairs of an equal primary identifier, and no others.
    """
    new = written(normalize_entity(batch.repartition("entity_id")), "arrived")
    others = known.join(new.select("entity_id"), "entity_id", "left_anti")
    touched = block_keys(others, kinds).join(block_keys(new, kinds).select("block").distinct(), "block", "left_semi").select("entity_id").distinct()
    near = others.join(touched, "entity_id", "left_semi")
    every = written(new.withColumn("asked", F.lit(True)).unionByName(near.withColumn("asked", F.lit(False)), allowMissingColumns=True), "batch")
    return resolve_entities(blocks(every, kinds=kinds, asked="asked"), every, config=config)


def link_stream(stream: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, config: EngineConfig = DEFAULTS, once: bool = True, kinds: tuple[str, ...] = KINDS) -> StreamingQuery:
    """Starts linkage of a stream of entities by blocks of ``kinds``; ``sink(decisions, batch)`` must bear a batch's repetition."""

    def each(batch: DataFrame, number: int) -> None:
        sink(link_batch(batch, known(), config, kinds), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows, closed when the watermark has passed."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
