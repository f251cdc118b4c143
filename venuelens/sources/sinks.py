"""Table and file outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.lexicons import EXPORT_COLUMNS


def write_table(df: DataFrame, path: str, skip_if_exists: bool = False) -> None:
    """Parquet table; an existing one is replaced, or kept when ``skip_if_exists``."""
    df.write.mode("ignore" if skip_if_exists else "overwrite").parquet(path)


def export_columns(df: DataFrame, allowed: list[str] = EXPORT_COLUMNS) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def write_csv(df: DataFrame, path: str, allowed: list[str] = EXPORT_COLUMNS) -> None:
    """Allowed columns as UTF-8 CSV part files with a header each."""
    export_columns(df, allowed).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def discordance_export(df: DataFrame, columns: list[str], order: str = "discordance", tie: str = "locationId",
                       min_reviews: int = 30) -> DataFrame:
    """Venues with enough reviews, lowest discordance first, doubles rounded to 3 digits."""
    kept = df.filter(F.col(order).isNotNull() & (F.col("n_reviews_scored") >= min_reviews)).orderBy(order, tie)
    doubles = {n for n, t in kept.dtypes if t == "double"}
    return kept.select(*[F.round(c, 3).alias(c) if c in doubles else F.col(c) for c in columns])


def preview(df: DataFrame, order: str, n: int = 50, names: dict[str, str] | None = None) -> DataFrame:
    shown = df.orderBy(order).limit(n)
    return shown.withColumnsRenamed(names or {})
