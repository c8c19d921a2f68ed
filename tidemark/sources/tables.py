"""Readers and writers of warehouse tables and result sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.sources.schemas import TABLES


def scan(spark: SparkSession, path: str, table: str, register: bool = True) -> DataFrame:
    """Read a warehouse table with its declared schema; registered as a view under its name."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; known: {sorted(TABLES)}")
    df = spark.read.schema(TABLES[table]).parquet(path)
    if register:
        df.createOrReplaceTempView(table)
    return df


def load_or_generate(spark: SparkSession, path: str | None, generate, file_format: str = "parquet") -> DataFrame:
    """Read a public dataset from ``path``; where it is absent or unreadable use ``generate(spark)``."""
    if path:
        try:
            return spark.read.format(file_format).load(path)
        except AnalysisException:
            pass
    return generate(spark)


def flatten_flags(df: DataFrame, struct_column: str = "category") -> DataFrame:
    """Lift the fields of a struct column to the top, as columns of their own."""
    return df.select(*[c for c in df.columns if c != struct_column], F.col(f"{struct_column}.*"))


def flag_columns(df: DataFrame, metadata: tuple[str, ...] = ("is_safe",)) -> list[str]:
    """The boolean columns that are no metadata; none at all is an error."""
    found = [f.name for f in df.schema if isinstance(f.dataType, BooleanType) and f.name not in metadata]
    if not found:
        raise ValueError("no harm columns found")
    return found


def write_processed(df: DataFrame, folder: str, dataset: str, category: str, n: int, date: str) -> str:
    """Write ``{dataset}_{category}_{n}_{date}.parquet`` below ``folder`` and return its path."""
    path = f"{folder.rstrip('/')}/{dataset}_{category}_{n}_{date}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def append_review_queue(frame: DataFrame, path: str) -> None:
    """Append a sampling frame to the review samples, one folder a week."""
    out = frame.withColumnRenamed("review_week", "week") if "week" not in frame.columns else frame
    out.write.mode("append").partitionBy("week").parquet(path)


def weeks(spark: SparkSession, first_monday: str, n: int) -> DataFrame:
    """``n`` Mondays from ``first_monday`` on, with their 0-based number."""
    days = F.sequence(F.to_date(F.lit(first_monday)), F.date_add(F.to_date(F.lit(first_monday)), 7 * (n - 1)), F.expr("INTERVAL 7 DAYS"))
    return spark.range(1).select(F.posexplode(days).alias("week_number", "week"))
