"""Readers and writers of landed data: JSON snapshots, log lines and append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBMISSION = T.StructType([
    T.StructField("assignment_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("workflow_state", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()), T.StructField("late", T.BooleanType()), T.StructField("seconds_late", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("course_id", T.StringType())])
LOG_ROW = T.StructType([
    T.StructField("at", T.TimestampType()), T.StructField("area", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("course_id", T.StringType()), T.StructField("detail", T.StringType())])
_BAD = "_corrupt_record"


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = SUBMISSION, multiline: bool = False) -> DataFrame:
    """Landed JSON objects as a typed table; folder names ``course_id=`` become partition columns."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG_ROW) -> tuple[DataFrame, DataFrame]:
    """Log rows, and how many lines of each file were not rows.

    Bad lines are skipped, as a reader of an append-only log must, but they are counted.
    """
    marked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.input_file_name().alias("file"), parsed.alias("r")).select("file", "r.*")
    month = F.regexp_extract("file", r"(\d{4}-\d{2})[^/]*$", 1)
    good = rows.where(F.col(_BAD).isNull()).withColumn("month", month).drop(_BAD, "file")
    return good, rows.groupBy("file").agg(F.count_if(F.col(_BAD).isNotNull()).alias("bad_lines"), F.count(F.lit(1)).alias("lines"))


def append_log(rows: DataFrame, path: str, at: Column | str = "at") -> None:
    """Append log rows to a table partitioned by month."""
    at = F.col(at) if isinstance(at, str) else at
    rows.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def write_grade_sheet(sheet: DataFrame, path: str) -> None:
    """Wide grade sheets as CSV with a header, one folder per run; an assignment's rows together, by place where the sheet has places."""
    if "place" in sheet.columns:
        sheet = sheet.repartition("assignment_id").sortWithinPartitions("assignment_id", "place")
    sheet.write.option("header", True).csv(path)
