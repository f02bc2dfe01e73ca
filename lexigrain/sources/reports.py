"""Run summaries as JSON files, and measurement points as JSON and CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.storage import is_file, require_new_path, write_one_file

POINT_SCHEMA = (
    "vocab_size int, token_count bigint, bytes_per_token double, tokens_per_byte double, seconds double"
)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """One JSON document per file; an existing file is an error."""
    require_new_path(spark, path)
    document = json.dumps(summary, indent=2, ensure_ascii=False)
    write_one_file(spark.createDataFrame([(document,)], "value string"), path)


def read_json_file(spark: SparkSession, path: str) -> dict:
    if not is_file(spark, path):
        raise ValueError(f"not a file: {path}")
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The ``points`` list of a compression summary, one row per point."""
    df = spark.read.schema(f"points array<struct<{_struct_fields()}>>").json(path, multiLine=True)
    points = df.select(F.explode("points").alias("p")).select("p.*")
    if points.isEmpty():
        raise ValueError(f"there are no compression points in {path}")
    return points


def _struct_fields() -> str:
    return ", ".join(": ".join(part.split()) for part in POINT_SCHEMA.split(", "))


def write_points_csv(points: DataFrame, path: str) -> None:
    """Header and one line per point (a grid has tens of rows, so one file)."""
    require_new_path(points.sparkSession, path)
    points.coalesce(1).sortWithinPartitions("vocab_size").write.option("header", True).csv(path)
