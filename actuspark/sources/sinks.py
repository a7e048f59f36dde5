"""Evidence and scored-member sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actuspark.functions.columns import finite

GENERATED_NOTE = "GENERATED TEST SAMPLE - NOT REAL CLAIMS"
REAL_NOTE = "Public claims sample"


def json_ready(df: DataFrame) -> DataFrame:
    """Same table with infinities and NaN as NULL, so that every value has a JSON form."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(finite(c), F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(out)


def write_evidence(evidence: Mapping[str, DataFrame], root: str) -> None:
    """One JSON folder per evidence table."""
    for name, df in evidence.items():
        json_ready(df).write.mode("overwrite").option("ignoreNullFields", False).json(f"{root.rstrip('/')}/{name}")


def read_evidence(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """An evidence table as it was written, with the types it had."""
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/{name}")


def write_sources(sources: Mapping[str, DataFrame], root: str, files: Mapping[str, str]) -> None:
    """Raw tables as CSV with a header, one folder a source, under the names that the loader looks for."""
    for name, df in sources.items():
        df.write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{files[name]}")


def write_stage(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Replace a stored stage and continue from the stored table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def provenance(df: DataFrame, generated: bool) -> DataFrame:
    """Mark every row of an output with its origin, so test data is never taken for real data."""
    return df.withColumn("generated_data", F.lit(generated)).withColumn(
        "data_source", F.lit(GENERATED_NOTE if generated else REAL_NOTE))


def run_metadata(spark: SparkSession, generated: bool, **values: float | int | str) -> DataFrame:
    """One-row table with the origin and the scalars of a run."""
    row = {"generated_data": generated, "data_source": GENERATED_NOTE if generated else REAL_NOTE, **values}
    return spark.createDataFrame([tuple(row.values())], list(row)).withColumn("run_date", F.current_date())
