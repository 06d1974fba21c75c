"""Writers for cleaned tables and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F


def cleaned_name(file_name: str) -> str:
    """File name of the cleaned copy, with anything but letters, digits, _ and - replaced."""
    stem = file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return re.sub(r"[^A-Za-z0-9_-]", "_", stem) + "_cleaned.csv"


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV parts with a header, written in parallel."""
    df.write.options(header=True, escape='"').csv(folder)


def write_report_json(report: DataFrame, folder: str) -> None:
    report.write.json(folder)


def report_json(report: DataFrame) -> DataFrame:
    """Each report row as one JSON text."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))
