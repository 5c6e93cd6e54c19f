"""The batch operators as streams: index, chunk assembly, page cleaning and operation status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from docloom.functions import text
from docloom.operators import index
from docloom.sources import io, snapshots

#: Seconds after which an unfinished request is given up.
REQUEST_TIMEOUT = 1200
#: What is known of a request after each batch.
SHOWN = "conv_id long, turn long, text string, failed boolean, n_chunks long, given_up boolean"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    folder = any(f"/{name}.parquet/" in f for f in batch.inputFiles())
    reader = spark.readStream.schema(batch.schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def index_stream(log: DataFrame, out: str, *, key: str = "d", seq: str = "k", value: str = "entry", buckets: int = 64) -> DataFrame:
    """The keyed index of an endless log, as a versioned table: a batch rewrites the buckets of its keys and no others.

    What a batch writes follows the batch and the buckets it meets, not the index; a
    repeated batch changes nothing, and one without data makes no version.  Returns the
    present version after all data now available.
    """
    spark = log.sparkSession

    def combine(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = index.upsert(batch, key, seq, value)
        return new if old is None else index.merge(old, new, key, value)

    def merge(batch: DataFrame, batch_id: int) -> None:
        snapshots.change(batch, f"{out}/index", [key], combine, batch_id=batch_id, buckets=buckets)

    log.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    found = snapshots.read(spark, f"{out}/index")
    return spark.createDataFrame([], f"{key} {kinds[key]}, {value} {kinds[value]}, first_seen {kinds[seq]}, last_seen {kinds[seq]}") if found is None else found


def _newest(keys: list[str]):
    """The rows of a batch in place of those with the same keys."""

    def combine(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        if old is None:
            return batch
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        return old.alias("o").join(batch.select(*keys).alias("n"), cond, "left_anti").unionByName(batch)

    return combine


def latest_state(rows: DataFrame, out: str, keys: list[str], schema: str, mode: str = "update") -> DataFrame:
    """The last row that a stream has given for each of its keys, kept in a versioned table under ``out``; what is outdated goes with later batches."""
    spark = rows.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = io.stored(batch, "batch")  # its state is read once, however often the batch is
        snapshots.change(batch, f"{out}/state", keys, _newest(keys), batch_id=batch_id)

    rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = snapshots.read(spark, f"{out}/state")
    return spark.createDataFrame([], schema) if found is None else found


class Assembly(StatefulProcessor):
    """The chunks of one request: a number that is due, those that came too early, and what has been told of it.

    Each call of the state is a round trip, so there are few, whatever has come before: the pieces of a batch
    are one entry of a list, which is read only if the request is known, and early ones stand in a map by number until their turn.  A chunk that came
    already or comes after an error counts no more.  With ``timed`` a request without news for ``seconds`` is given up;
    what comes later then begins a new one.
    """

    def __init__(self, timed: bool = False, seconds: int = REQUEST_TIMEOUT) -> None:
        self.timed, self.wait = timed, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "due long, n long, error string, waiting long, deadline long")
        self.early = handle.getMapState("early", "seq long", "text string, error string")
        self.pieces = handle.getListState("pieces", "text string")

    def _shown(self, key: tuple, text: str, n: int, error: str | None, given_up: bool) -> pd.DataFrame:
        shown = f"request failed: {error}" if error is not None and not text else text
        values = (*key, shown, error is not None or given_up, n, given_up)
        return pd.DataFrame({c: [v] for c, v in zip(("conv_id", "turn", "text", "failed", "n_chunks", "given_up"), values, strict=True)})

    def _text(self) -> str:
        return "".join(p[0] for p in self.pieces.get())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.head.get()
        due, n, error, waiting, deadline = (0, 0, None, 0, None) if known is None else known
        told = self._text() if n else ""
        fresh: list[str] = []

        def take(piece: str | None, failure: str | None) -> None:
            nonlocal due, n, error
            due, error = due + 1, failure if isinstance(failure, str) else None
            if error is None and isinstance(piece, str) and piece:
                fresh.append(piece)
                n += 1

        for frame in rows:
            if not frame["seq"].is_monotonic_increasing:
                frame = frame.sort_values("seq", kind="stable")
            for seq, text, failure in zip(frame["seq"].tolist(), frame["text"].tolist(), frame["error"].tolist(), strict=True):
                if error is not None or seq < due:
                    continue
                if seq > due:
                    waiting += not self.early.containsKey((seq,))
                    self.early.updateValue((seq,), (text if isinstance(text, str) else None, failure if isinstance(failure, str) else None))
                    continue
                take(text, failure)
                while error is None and waiting and self.early.containsKey((due,)):
                    held = self.early.getValue((due,))
                    self.early.removeKey((due,))
                    waiting -= 1
                    take(*held)
        if fresh:
            self.pieces.appendValue(("".join(fresh),))
        if error is not None and waiting:
            self.early.clear()
            waiting = 0
        if self.timed:
            if deadline is not None:
                self.handle.deleteTimer(deadline)
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(deadline)
        self.head.update((due, n, error, waiting, deadline))
        yield self._shown(key, told + "".join(fresh), n, error, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.head.exists():
            _, n, error, _, deadline = self.head.get()
            if deadline == expiredTimerInfo.getExpiryTimeInMs():
                yield self._shown(key, self._text() if n else "", n, error, True)
                self.head.clear()
                self.early.clear()
                self.pieces.clear()

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, *, timed: bool, seconds: int = REQUEST_TIMEOUT) -> DataFrame:
    """Updates of each request as its chunks (conv_id, turn, seq, text, error) come, in whatever order.

    With ``timed`` a request without news for ``seconds`` is given up; this is for streams
    that keep running, as waiting for a timeout keeps a stream alive.  State lies in RocksDB.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return chunks.groupBy("conv_id", "turn").transformWithStateInPandas(Assembly(timed, seconds), SHOWN, "Update", "ProcessingTime" if timed else "None")


def chunk_stream(chunks: DataFrame, out: str) -> DataFrame:
    """The requests as far as all chunks now available bring them."""
    return latest_state(assembled(chunks, timed=False), out, ["conv_id", "turn"], SHOWN).select("conv_id", "turn", "text", "failed", "n_chunks")


def page_stream(pages: DataFrame, out: str) -> DataFrame:
    """New pages cleaned as they arrive; no state."""
    body = text.compact(text.absolute_links(text.body_of(F.col("html")), F.col("url")))
    rows = pages.select("page_id", text.truncate(body).alias("body"))
    rows.writeStream.format("parquet").option("path", f"{out}/pages").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return pages.sparkSession.read.schema(rows.schema).parquet(f"{out}/pages")


def status_stream(operations: DataFrame, out: str) -> DataFrame:
    """The latest status of each operation (op_id, ts, seq, done); one not done is pending."""
    latest = operations.groupBy("op_id").agg(F.max_by("done", F.struct("ts", "seq")).alias("done"))
    rows = latest_state(latest, out, ["op_id"], f"op_id {latest.schema['op_id'].dataType.simpleString()}, done boolean")
    return rows.select("op_id", F.when(F.col("done"), "done").otherwise("pending").alias("status"))
