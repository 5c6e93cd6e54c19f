"""Batch inference: request tables, a caller's backend run per partition, chains and resumption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.sources.io import exists, stored

#: A backend takes a request (prompt, model, temperature, json_mode) and returns its text.
Backend = Callable[[dict], str]


def requests(docs: DataFrame, key: str, prompt, *, model: str | None, default_model: str | None, temperature: float = 0.7, json_mode: bool = False) -> DataFrame:
    """One request per row; without any model its status is ``config_missing``."""
    chosen = F.coalesce(F.lit(model), F.lit(default_model))
    rows = docs.select(F.col(key).alias("request_id"), F.to_json(text.messages(prompt)).alias("messages"), chosen.alias("model"), F.lit(temperature).alias("temperature"), F.lit(json_mode).alias("json_mode"))
    return rows.withColumn("status", F.when(F.col("model").isNull(), "config_missing").otherwise("ready"))


def _asked(backend: Backend, request: dict) -> tuple[str | None, str, str | None]:
    """Response, status and error of one request; its own failure is its result."""
    try:
        answer = backend(request)
        return answer, "ok" if answer else "empty", None
    except Exception as error:
        return None, "error", f"{type(error).__name__}: {error}"


#: Errors that may pass: no answer, no connection, too many requests, a server's own failure.
PASSING = r"^(Timeout|Connection|ConnectionReset)\w*Error|HTTP (429|5\d\d)"
LEDGER = "request_key string, response string, status string, error string"


def ask_once(rows: DataFrame, open_backend: Callable[[], Backend], ledger: str, *, attempts: int = 3, part_rows: int = 1000, passing: str = PASSING) -> DataFrame:
    """``complete``, with every answer kept in the folder ``ledger``: what is in there is not asked again, by this run or a later one.

    Requests that are equal in model, settings and messages share a key and are asked
    once.  A task of ``part_rows`` requests adds its answers when it ends, whatever becomes of the
    others, so a job that dies is taken up where its last task ended, and a lost task asks its own
    requests again only.  Errors that match ``passing`` are asked up to ``attempts`` times in all,
    other errors and empty answers once.  One run works on a ledger at a time.
    """
    spark = rows.sparkSession
    settings = ("model", "temperature", "json_mode", "messages")
    keyed = rows.withColumn("request_key", F.when(F.col("status") == "ready", F.sha2(F.to_json(F.struct(*settings)), 256)))
    ready = stored(keyed.where("status = 'ready'").groupBy("request_key").agg(*[F.first(c).alias(c) for c in settings]), "requests")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = open_backend()
        for frame in frames:
            answers = [(r["request_key"], *_asked(backend, r)) for r in frame.to_dict("records")]
            yield pd.DataFrame(answers, columns=["request_key", "response", "status", "error"])

    def known() -> DataFrame:
        return spark.read.schema(LEDGER).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], LEDGER)

    for _ in range(attempts):
        tried = known().groupBy("request_key").agg(F.count("*").alias("n"), F.max((~((F.col("status") == "error") & F.coalesce(F.col("error").rlike(passing), F.lit(False)))).cast("int")).alias("settled"))
        waiting = stored(ready.join(tried.where((F.col("settled") == 1) | (F.col("n") >= attempts)), "request_key", "left_anti"), "waiting")
        n = waiting.count()
        if not n:
            break
        answers = waiting.repartition(-(-n // part_rows), "request_key").mapInPandas(run, LEDGER)
        # the second algorithm moves a task's file when the task ends, not when the job does
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    best = known().groupBy("request_key").agg(F.max_by(F.struct("response", "status", "error"), F.when(F.col("status") == "ok", 2).when(F.col("status") == "empty", 1).otherwise(0)).alias("a"))
    told = keyed.join(best, "request_key", "left")
    return told.select("request_id", F.col("a.response").alias("response"), F.coalesce("a.status", "status").alias("status"), F.col("a.error").alias("error"))


def complete(rows: DataFrame, open_backend: Callable[[], Backend]) -> DataFrame:
    """Run the ready requests: ``request_id``, ``response``, ``status``, ``error``.

    ``open_backend`` is called once per partition.  A failing request is a row, not a
    failed task.  Write the result before using it twice: a backend may answer differently.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = open_backend()
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                out.append((r["request_id"], *_asked(backend, r)))
            yield pd.DataFrame(out, columns=["request_id", "response", "status", "error"]).astype({"request_id": "int64"})

    done = rows.where("status = 'ready'").select("request_id", "messages", "model", "temperature", "json_mode").mapInPandas(run, "request_id long, response string, status string, error string")
    skipped = rows.where("status <> 'ready'").select("request_id", F.lit(None).cast("string").alias("response"), "status", F.lit(None).cast("string").alias("error"))
    return done.unionByName(skipped)


def digest_backend() -> Backend:
    """A deterministic stand-in: it answers with the length of the messages, and fails where that is a multiple of 50."""

    def answer(request: dict) -> str:
        code = len(request["messages"])
        if code % 50 == 0:
            raise TimeoutError("no answer")
        return f'{{"title":"T{code % 1000}","tags":["a","b"],"chars":{code}}}'

    return answer
