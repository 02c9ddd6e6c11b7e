"""The entry points."""

import __spark_entry__ as entry


def test_names(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"p2_found", "p4_found", "bm25_topk"} <= names


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["doc_id", "score"] and frame.count() == 10


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and not names & {"p1_found", "p6_found"}
