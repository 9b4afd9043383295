"""Rows as lines of CSV and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """One unquoted CSV line for each row."""
    return rows.select(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("line"))


def _escaped(column: Column) -> Column:
    return F.replace(F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def quoted_csv_lines(rows: DataFrame, quoted: list[str], plain: list[str]) -> DataFrame:
    """CSV lines with quoted, backslash-escaped fields (commas too), then plain ones."""
    fields = [F.concat(F.lit('"'), F.replace(_escaped(F.col(c)), F.lit(","), F.lit("\\,")), F.lit('"')) for c in quoted]
    return rows.select(F.concat_ws(",", *fields, *(F.col(c).cast("string") for c in plain)).alias("line"))


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\\").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
