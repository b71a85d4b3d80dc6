from __future__ import annotations

import csv
import datetime as dt
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest

from cohortry.session import small_table, work_dir
from cohortry.sources.export import write_members

ROWS = [
    (1, "test@example.com", 'John"Smith', "Doe, Jr.", dt.datetime(2023, 1, 15, 10)),
    (2, "=cmd@example.com", "<A> & B", "+1", dt.datetime(2023, 2, 1)),
]
SCHEMA = "customer_id bigint, email string, first_name string, last_name string, created_at timestamp_ntz"


def lines(path: str, pattern: str) -> str:
    return "".join(p.read_text() for p in sorted(Path(path).glob(pattern)))


@pytest.fixture
def members(spark):
    return small_table(spark, ROWS, SCHEMA).coalesce(1)


def test_csv(spark, members):
    path = work_dir(spark, "csv")
    write_members(members, path, "csv")
    text = lines(path, "part-*.csv")
    assert '"Doe, Jr."' in text and 'John""Smith' in text
    read = list(csv.reader(text.splitlines()))
    assert read[0] == ["Customer ID", "Email", "First Name", "Last Name", "Created At"]
    assert read[1] == ["1", "test@example.com", 'John"Smith', "Doe, Jr.", "2023-01-15 10:00:00"]
    assert read[2][1] == "=cmd@example.com"


def test_safe_csv(spark, members):
    path = work_dir(spark, "csv")
    write_members(members, path, "csv", safe_csv=True)
    read = list(csv.reader(lines(path, "part-*.csv").splitlines()))
    assert read[1][1] == "test@example.com" and read[2][1:4] == ["'=cmd@example.com", "<A> & B", "'+1"]


def test_xml(spark, members):
    path = work_dir(spark, "xml")
    write_members(members, path, "xml")
    root = ET.fromstring(lines(path, "part-*"))
    assert root.tag == "customers" and [c.tag for c in root] == ["customer"] * 2
    assert [e.tag for e in root[0]] == ["customer_id", "email", "first_name", "last_name", "created_at"]
    assert root[1].find("first_name").text == "<A> & B"
    assert root[0].find("created_at").text == "2023-01-15 10:00:00"


def test_unknown_format(spark, members):
    with pytest.raises(ValueError):
        write_members(members, work_dir(spark, "x"), "pdf")
