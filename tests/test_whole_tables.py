"""Queries that take part of a table are told by the rows they return."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_rehydrate_edits_takes_every_document(spark):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["rehydrate_edits"](spark, SF).collect()
    assert {r.doc_id for r in got} == ids and len(got) == len(ids)
