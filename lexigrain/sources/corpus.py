"""Reading a text corpus with a definite row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

FORMATS = ("parquet", "json", "csv", "text", "orc")


def check_text_column(df: DataFrame, column: str) -> None:
    """The text column must exist and hold strings; checked on the schema, before any job."""
    if column not in df.columns:
        raise ValueError(f"text column {column!r} is missing; columns: {', '.join(df.columns)}")
    kind = df.schema[column].dataType
    if not isinstance(kind, StringType):
        raise ValueError(f"text column {column!r} must hold strings, it holds {kind.simpleString()}")


def read_corpus(
    spark: SparkSession,
    path: str,
    order_by: list[str] | None = None,
    text_column: str = "text",
    fmt: str = "parquet",
    config: str | None = None,
    split: str | None = None,
    **options: str,
) -> DataFrame:
    """``(order columns, text)`` of a corpus; only these columns reach the file scan.

    ``config`` and ``split`` select partition directories (``config=…/split=…``) or column values.
    A corpus without splits is its own ``train`` split. Without ``order_by``, rows are ordered as they stand in
    their files: parquet rows by file path and row index, those of other formats by file path, first byte of the
    block that a task reads, and place in the task, which rises along each block. The latter holds as long as the
    files and the session's ``spark.sql.files`` settings stay the same.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown corpus format {fmt!r}; formats: {', '.join(FORMATS)}")
    df = spark.read.format(fmt).options(**options).load(path)
    for column, wanted in (("config", config), ("split", split)):
        if wanted is not None:
            if column not in df.columns:
                if (column, wanted) == ("split", "train"):
                    continue
                raise ValueError(f"the corpus has no {column!r} column or directory level")
            df = df.where(F.col(column) == wanted)
    text = "value" if fmt == "text" and text_column not in df.columns else text_column
    check_text_column(df, text)
    if order_by is None:
        if fmt != "parquet":
            return df.select(
                F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_block_start").alias("block_start"),
                F.monotonically_increasing_id().alias("place"),
                F.col(text).alias(text_column),
            )
        return df.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.row_index").alias("row_index"),
            F.col(text).alias(text_column),
        )
    missing = [column for column in order_by if column not in df.columns]
    if missing:
        raise ValueError(f"order columns are missing: {', '.join(missing)}")
    return df.select(*order_by, F.col(text).alias(text_column))
