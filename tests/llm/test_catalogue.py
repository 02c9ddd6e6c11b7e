"""The queries of the subpackage in the catalogue."""

import sys

import pytest

import __spark_entry__ as entry


def test_names():
    assert {f"p{n}_found" for n in (1, 3, 5, 6, 8, 9)} | {"p7_ids"} <= set(entry.queries())


def test_failing_import_is_no_smaller_catalogue(monkeypatch):
    monkeypatch.setitem(sys.modules, "contextlake.llm.queries", None)
    with pytest.raises(ImportError):
        entry.queries()
