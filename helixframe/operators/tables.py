"""Tables that cut long lineages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, which is the warehouse where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """frame, written once: what is read several times afterwards neither repeats its joins nor depends on the executors that made it."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def in_groups(frame: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What work makes of the rows of frame, given tables of whole groups of equal keys, in their order.

    Rows are dealt by key and sorted; a task holds a batch and the group that goes on in the next one, so that groups are to be bounded.
    Many small groups come in one table, which work can treat together.
    """
    sorted_rows = frame.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            ending = None  # where the last group of the batch begins
            for key in keys:
                last = batch.column(key)[len(batch) - 1]
                differs = pc.invert(pc.is_null(batch.column(key))) if not last.is_valid else pc.fill_null(pc.not_equal(batch.column(key), last), True)
                ending = differs if ending is None else pc.or_(ending, differs)
            other = pc.indices_nonzero(ending)
            at = other[-1].as_py() + 1 if len(other) else 0
            goes_on = bool(held) and all(held[-1].column(key)[len(held[-1]) - 1] == batch.column(key)[0] for key in keys)
            if at or (held and not goes_on):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, at)])).to_batches()
                held = []
            held.append(batch.slice(at))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return sorted_rows.mapInArrow(run, schema)
