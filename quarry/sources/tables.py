"""Where tables come from and go to: Parquet by default, other formats by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that Spark reads and writes without further jars.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Reads any of ``FORMATS``; give ``schema`` for json and csv so that no inference pass over the data is needed."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON object, as an endpoint would send it."""
    return df.select(F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))
