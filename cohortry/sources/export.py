"""Member lists as CSV or XML, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The CSV header and the XML tags of an exported member list.
CSV_HEADER = {
    "customer_id": "Customer ID",
    "email": "Email",
    "first_name": "First Name",
    "last_name": "Last Name",
    "created_at": "Created At",
}
XML_ROOT, XML_ROW = "customers", "customer"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
FORMULA_START = r"^[=+\-@]"


def _as_text(rows: DataFrame) -> list[Column]:
    """The exported columns in order, timestamps in their fixed format."""
    return [
        F.date_format(name, TIMESTAMP_FORMAT).alias(name) if name == "created_at" else F.col(name)
        for name in CSV_HEADER
    ]


def _defused(rows: DataFrame) -> DataFrame:
    """A quote in front of text a spreadsheet would run as a formula."""
    text = [name for name, kind in rows.dtypes if kind == "string"]
    guarded = {
        name: F.when(F.col(name).rlike(FORMULA_START), F.concat(F.lit("'"), name)).otherwise(F.col(name))
        for name in text
    }
    return rows.withColumns(guarded)


def write_members(rows: DataFrame, path: str, kind: str, safe_csv: bool = False) -> None:
    """Write exported members (see ``lookup.export_members``) below ``path``."""
    flat = rows.select(*_as_text(rows))
    if kind == "csv":
        if safe_csv:
            flat = _defused(flat)
        titled = flat.select(*[F.col(name).alias(title) for name, title in CSV_HEADER.items()])
        titled.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')
    elif kind == "xml":
        flat.write.mode("errorifexists").xml(path, rowTag=XML_ROW, rootTag=XML_ROOT)
    else:
        raise ValueError(f"unknown export format {kind!r}")
