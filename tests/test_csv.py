"""Whole texts through CSV."""

from tallyloom.plans import catalogue, extras, fixtures

from .conftest import DATA


def test_whole_texts_come_back_from_csv(spark):
    docs = fixtures.document(spark, DATA)
    want = {r["document_id"]: r["text"] for r in docs.collect()}
    assert max(len(t) for t in want.values() if t) > 200 and any('"' in (t or "") or "\n" in (t or "") for t in want.values())
    assert {r["document_id"]: r["text"] for r in extras._through_csv(spark, DATA).collect()} == want
    assert "csv_round_trip_whole" in catalogue.SQL
