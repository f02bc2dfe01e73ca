"""Choosing tokenizers by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: White space of any kind at both ends.
EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def parse_tokenizer_spec(value: str) -> tuple[str, str]:
    """``"name=path"`` -> ``(name, path)``, split at the first equals sign."""
    name, found, path = value.partition("=")
    if not (found and name and path):
        raise ValueError(f"expected NAME=PATH, got {value!r}")
    return name, path


def parse_tokenizer_specs(values: list[str]) -> dict[str, str]:
    chosen = dict(parse_tokenizer_spec(value) for value in values)
    if len(chosen) != len(values):
        raise ValueError("each tokenizer name may be given once")
    return chosen


def requested_names(requests: DataFrame, column: str = "names") -> DataFrame:
    """``(name, times)`` from comma lists: names trimmed, blanks dropped."""
    return (
        requests.select(F.explode(F.split(column, ",")).alias("name"))
        .select(F.regexp_replace("name", EDGE_BLANKS, "").alias("name"))
        .where("name <> ''")
        .groupBy("name")
        .agg(F.count("*").alias("times"))
    )


def resolve_names(requests: DataFrame, registry: DataFrame, column: str = "names") -> DataFrame:
    """``(name, path, status)`` per requested name: ``selected``, ``unknown`` or ``duplicate``."""
    return (
        requested_names(requests, column)
        .join(registry, "name", "left")
        .select(
            "name",
            "path",
            F.when(F.col("path").isNull(), "unknown")
            .when(F.col("times") > 1, "duplicate")
            .otherwise("selected")
            .alias("status"),
        )
    )


def select_tokenizers(registry: DataFrame, names: str) -> dict[str, str]:
    """Names of a comma list with their paths, in the order asked for."""
    spark = registry.sparkSession
    rows = resolve_names(spark.createDataFrame([(names,)], "names string"), registry).collect()
    if not rows:
        raise ValueError("name at least one tokenizer")
    unknown = sorted(row["name"] for row in rows if row["status"] == "unknown")
    if unknown:
        raise ValueError(f"unknown tokenizer names: {', '.join(unknown)}")
    if any(row["status"] == "duplicate" for row in rows):
        raise ValueError("each tokenizer name may be given once")
    paths = {row["name"]: row["path"] for row in rows}
    return {name: paths[name] for name in (part.strip() for part in names.split(",")) if name}
