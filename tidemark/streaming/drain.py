"""Running a stream over the input that is there, to its end."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.scratch import folder

from .resume import KeyedSink
from .stateful import keyed_state


def _read_all(q: StreamingQuery) -> bool:
    """Whether the last trigger found nothing new in any source."""
    last = q.lastProgress
    return last is not None and all(s.startOffset == s.endOffset for s in last.sources)


def drained(stream: DataFrame, mode: str, timers: bool = False) -> DataFrame:
    """All rows that ``stream`` emits for the input present, as a table; state is checkpointed in the shared folder.

    A batch that is run again after a failure writes its folder anew, so no row comes twice. A stream with ``timers`` never
    ends by itself, as a timer may always come; it is stopped when all input is read.
    """
    spark = stream.sparkSession
    path = folder(spark, "stream")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state")
    with keyed_state(spark):
        q = writer.start() if timers else writer.trigger(availableNow=True).start()
        if timers:
            while q.isActive and not _read_all(q):
                time.sleep(0.05)
            q.stop()
            if q.exception():
                raise q.exception()
        else:
            q.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        last = rows.agg({"epoch": "max"}).first()[0]
        rows = rows.where(rows["epoch"] == last)
    return rows.drop("epoch")


def in_pieces(rows: DataFrame, piece: str, pieces: int, key: str | None = None) -> DataFrame:
    """``rows`` as a stream of ``pieces`` triggers or some more, by the column ``piece`` (from 0), which goes.

    The pieces are written one after the other, and a file stream reads files in the order of their times. All rows that a
    ``key`` has in a piece lie in one of the piece's files, so they come in order wherever a trigger ends; as many tasks
    write and read a piece as its bytes ask for, and ``rows`` is computed once. Without a key, a piece is one file.
    """
    spark = rows.sparkSession
    path = folder(spark, "pieces")
    kept = rows.drop(piece).schema
    if key is not None:
        rows.write.parquet(f"{path}-all")
        rows = spark.read.schema(rows.schema).parquet(f"{path}-all")
    for k in range(pieces):
        part = rows.where(F.col(piece) == k).drop(piece)
        (part.coalesce(1) if key is None else part.repartition(key)).write.mode("append").parquet(path)
    files = len(spark.read.schema(kept).parquet(path).inputFiles())
    return spark.readStream.schema(kept).option("maxFilesPerTrigger", max(1, files // pieces)).parquet(path)


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str) -> None:
    """Runs an update-mode stream over the input present, from the checkpoint in ``state`` if there is one."""
    with keyed_state(stream.sparkSession):
        q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()


def latest(stream: DataFrame, keys: list[str], order: str, buckets: int = 16) -> DataFrame:
    """The row of the greatest ``order`` a key that ``stream`` emits for the input present."""
    path = folder(stream.sparkSession, "latest")
    sink = KeyedSink(f"{path}/sink", keys, order, buckets)
    run_to_end(stream, sink, f"{path}/state")
    return sink.read(stream.sparkSession, stream.schema)
