"""Raw text sources: required-file check, column-subset CSV scan, yearly stacking and loaded-row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actuspark import config as C

# Texts that count as missing in the raw files, besides the empty field.
MISSING_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class MissingSources(FileNotFoundError):
    """One or more required inputs are absent."""


@dataclass(frozen=True)
class RawTables:
    """The three staged tables of a run, all text but for FILE_YEAR."""

    members: DataFrame
    inpatient: DataFrame
    outpatient: DataFrame


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath))


def source_status(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Which sources are there: (source, found), one row a path."""
    rows = [(name, path_exists(spark, path)) for name, path in paths.items()]
    return spark.createDataFrame(rows, "source string, found boolean")


def require_sources(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Raise with the full list of missing inputs; pass silently when all are there."""
    missing = [p for p in paths.values() if not path_exists(spark, p)]
    if missing:
        raise MissingSources(f"missing sources: {missing}")


def scan_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV (or parquet) with every column as text; only ``columns`` are parsed. Missing texts become NULL."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        names = list(columns or df.columns)
        return df.select([F.col(c).cast("string").alias(c) for c in names])
    header = spark.read.option("header", True).csv(path).columns
    absent = [c for c in (columns or []) if c not in header]
    if absent:
        raise ValueError(f"columns {absent} not in {path}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    names = list(columns or header)
    return df.select([F.when(~F.col(c).isin(*MISSING_TEXTS, ""), F.col(c)).alias(c) for c in names])


def stack_tagged(parts: Mapping[int, DataFrame], tag: str = "FILE_YEAR") -> DataFrame:
    """Union of same-shaped parts, each row tagged with the part it came from."""
    tagged = [df.withColumn(tag, F.lit(int(value))) for value, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def source_counts(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per source, in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
              for name, df in sources.items()]
    return reduce(lambda a, b: a.unionAll(b), counts)


def source_paths(root: str, cfg: C.ClaimsConfig, files: Mapping[str, str]) -> dict[str, str]:
    return {name: f"{root.rstrip('/')}/{file}" for name, file in files.items()}


def default_files(cfg: C.ClaimsConfig) -> dict[str, str]:
    """File names of the public claims sample."""
    first, last = cfg.years[0], cfg.years[-1]
    files = {f"bene_{y}": f"DE1_0_{y}_Beneficiary_Summary_File_Sample_1.csv" for y in cfg.years}
    files["inpatient"] = f"DE1_0_{first}_to_{last}_Inpatient_Claims_Sample_1.csv"
    files["outpatient"] = f"DE1_0_{first}_to_{last}_Outpatient_Claims_Sample_1.csv"
    return files


def load_raw(spark: SparkSession, root: str, cfg: C.ClaimsConfig = C.ClaimsConfig(),
             files: Mapping[str, str] | None = None) -> tuple[RawTables, dict[str, DataFrame]]:
    """Staged tables of a raw folder, plus the separate sources for :func:`source_counts`."""
    paths = source_paths(root, cfg, files or default_files(cfg))
    require_sources(spark, paths)
    parts = {y: scan_text(spark, paths[f"bene_{y}"], C.MEMBER_COLUMNS) for y in cfg.years}
    ip = scan_text(spark, paths["inpatient"], C.INPATIENT_COLUMNS)
    op = scan_text(spark, paths["outpatient"], C.OUTPATIENT_COLUMNS)
    sources = {**{f"bene_{y}": df for y, df in parts.items()}, "inpatient": ip, "outpatient": op}
    return RawTables(stack_tagged(parts), ip, op), sources
