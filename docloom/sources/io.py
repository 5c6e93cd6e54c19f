"""Readers that tolerate absent and corrupt files, and writers that replace, append or switch snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docloom.functions.text import strip

INDEX = StructType([StructField("date", StringType()), StructField("title", StringType()), StructField("tags", ArrayType(StringType()))])


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        root = tempfile.mkdtemp(prefix="docloom-")
    root = root or spark.conf.get("spark.sql.warehouse.dir") + "/_docloom"
    return f"{root.rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut, safe from lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, folder: str, suffix: str = "") -> int | None:
    """The greatest number that names an entry of ``folder``, before ``suffix``; None if there is none."""
    if not exists(spark, folder):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName().removesuffix(suffix) for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def fetched(pages: DataFrame, status: str = "status") -> DataFrame:
    """``pages`` with ``failure``: null where the fetch succeeded (200 to 299), else why it did not; a null status is none."""
    reason = F.when(F.col(status).isNull(), "no response").when(~F.col(status).between(200, 299), F.concat(F.lit("HTTP "), F.col(status)))
    return pages.withColumn("failure", reason)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its base name and whole text; a missing path gives no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, text string")
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine) of a JSON index; every record is in one of them, those of the quarantine with ``record`` and ``reason``.

    A file holds one array of records, one record, or a record a line, however it is
    indented.  Reasons: ``malformed`` (a file that begins as an array or a record and does not end as one, or
    a line that is no JSON; an array beyond the size of a VARIANT too), ``not an object``, ``no date``.  Absent and
    empty files have no entry.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], INDEX), spark.createDataFrame([], "record string, reason string")
    files = spark.read.text(path, wholetext=True).select(strip(F.regexp_replace("value", "^\ufeff", "")).alias("text")).where("text <> ''")
    # the parser stops behind a first value, so what a file is shows in its ends: an array, lines, or one record over many lines
    array, first = F.col("text").startswith("["), strip(F.element_at(F.split("text", r"\r?\n"), 1))
    by_line = ~array & (F.try_parse_json(first).isNotNull() | ~F.col("text").startswith("{"))
    ends = F.when(array, F.col("text").endswith("]")).otherwise(F.col("text").endswith("}"))
    files = files.withColumn("by_line", by_line).withColumn("v", F.when(~F.col("by_line") & ends, F.try_parse_json("text")))
    lines = files.where("by_line").select(F.explode(F.split("text", r"\r?\n")).alias("record")).where(strip(F.col("record")) != "").select("record", F.try_parse_json("record").alias("v"))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    items = spark.sql("SELECT to_json(e.value) AS record, e.value AS v FROM {arrays}, LATERAL variant_explode(v) AS e", arrays=files.where(~F.col("by_line") & listed))
    rest = files.where(~F.col("by_line") & ~F.coalesce(listed, F.lit(False))).select(F.col("text").alias("record"), "v")
    get = lambda p, t: F.try_variant_get("v", p, t)
    rows = lines.unionByName(items).unionByName(rest)
    kind = F.schema_of_variant("v")
    reason = F.when(F.col("v").isNull(), "malformed").when(~kind.startswith("OBJECT"), "not an object").when(F.coalesce(get("$.date", "string"), F.lit("")) == "", "no date")
    rows = rows.select("record", reason.alias("reason"), F.when(kind.startswith("OBJECT"), F.struct(get("$.date", "string").alias("date"), get("$.title", "string").alias("title"), get("$.tags", "array<string>").alias("tags"))).alias("e"))
    return rows.where("reason IS NULL").select("e.*"), rows.where("reason IS NOT NULL").select("record", "reason")


def write_by_date(df: DataFrame, path: str, date: str = "report_date") -> None:
    """Replace the days that ``df`` holds and leave the others; one file a day, as rows of a day meet first."""
    df.repartition(F.col(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def append_run(df: DataFrame, path: str, run_ts: str) -> None:
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(path)


def write_stages(stages: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Each stage of a chain as a table of its own, for later inspection."""
    paths = {name: f"{root}/{name}" for name in stages}
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths
