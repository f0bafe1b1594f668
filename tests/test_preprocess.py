import re

import pytest

from lectern.config import EngineConfig
from lectern.operators import pii, preprocess


def test_metadata_defaults_and_repairs(spark):
    rows = [(1, "/in/dir/Report.PDF", " PDF ", "3"), (2, None, None, "3.7"), (3, "", "html", " 5 "), (4, "a", "x", "1_000"), (5, "b", "y", "99999999999")]
    df = spark.createDataFrame(rows, "id int, source string, file_type string, page string")
    got = {r["id"]: r for r in preprocess.normalize_metadata(df, "now").collect()}
    assert [(got[i]["source"], got[i]["file_type"], got[i]["page"], got[i]["chunk_total"], got[i]["ingested_at"]) for i in range(1, 6)] == [
        ("Report.PDF", "pdf", 3, 0, "now"), ("unknown", "unknown", 0, 0, "now"), ("unknown", "html", 5, 0, "now"), ("a", "x", 0, 0, "now"), ("b", "y", 0, 0, "now"),
    ]


def test_ingested_at_is_kept_where_given(spark):
    df = spark.createDataFrame([("a", "2020"), ("b", None)], "source string, ingested_at string")
    rows = {r["source"]: r["ingested_at"] for r in preprocess.normalize_metadata(df).collect()}
    assert rows["a"] == "2020" and re.fullmatch(r"\d{4}-\d\d-\d\dT[\d:.]+\+00:00", rows["b"])


def test_gate_keeps_twenty_characters_and_strips(spark):
    df = spark.createDataFrame([(1, " " * 9 + "x" * 20 + "\n"), (2, "x" * 19), (3, None), (4, "")], "id int, page_content string")
    assert [tuple(r) for r in preprocess.schema_gate(df).collect()] == [(1, "x" * 20)]
    assert sorted(r["id"] for r in preprocess.schema_rejects(df).collect()) == [2, 3, 4]


def test_enrich_counts_and_density(spark):
    cases = ["", "a b", " ".join(["word"] * 10), "abc def ghi", "abcdefgh abcdefgh", "12", "123", "| --- |", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, page_content string")
    got = {r["id"]: r for r in preprocess.enrich(df).collect()}
    assert got[0]["content_density"] == got[1]["content_density"] == "sparse" and got[4]["content_density"] == "dense"
    assert got[2]["estimated_read_time_seconds"] == 2 and got[1]["estimated_read_time_seconds"] == 1
    assert not got[5]["has_numbers"] and got[6]["has_numbers"] and got[7]["has_tables"] and got[8]["word_count"] == 0


PII = [
    ("mail a.b@c.org now", "mail [EMAIL] now", ["EMAIL"], 1),
    ("https://u@e.com/x", "[URL]", ["EMAIL", "URL"], 2),
    ("id 12345-1234567-1", "id [CNIC]", ["CNIC"], 1),
    ("pk36scbl0000001123456702 x", "[IBAN] x", ["IBAN"], 1),
    ("4111 1111-1111 1111", "[CREDIT_CARD]", ["CREDIT_CARD"], 1),
    ("+923001234567 or 0300-1234567", "[PHONE] or [PHONE]", ["PHONE_PK"], 2),
    ("+49 (30) 123 4567", "[PHONE]", ["PHONE_INTL"], 1),
    ("at 10.0.0.255", "at [IP_ADDRESS]", ["IP_ADDRESS"], 1),
    ("DOB: 1/2/1990", "[DOB]", ["DATE_OF_BIRTH"], 1),
    ("nothing", "nothing", [], 0),
]


def test_redaction_of_every_label(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(PII)], "id int, page_content string")
    rows = pii.redact(df).orderBy("id").collect()
    assert [(r["page_content"], r["pii_entities"], r["pii_count"]) for r in rows] == [c[1:] for c in PII]
    again = pii.redact(pii.redact(df).select("id", "page_content")).orderBy("id").collect()
    assert [r["page_content"] for r in again] == [c[1] for c in PII]


def test_redaction_of_some_labels_and_of_null(spark):
    df = spark.createDataFrame([("a@b.org 10.0.0.1",), (None,)], "page_content string")
    rows = [tuple(r) for r in pii.redact(df, types=("IP_ADDRESS",)).select("page_content", "pii_count").collect()]
    assert rows == [("a@b.org [IP_ADDRESS]", 1), (None, 0)]


def test_whole_chain_on_an_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "page_content string, source string, page int, extra map<string,string>")
    assert preprocess.preprocess(empty).count() == 0
    df = spark.createDataFrame([("A text of more than twenty characters.", {"k": "v"})], "page_content string, extra map<string,string>")
    row = preprocess.preprocess(df, EngineConfig(pii_enabled=False), "now").head()
    assert row["extra"] == {"k": "v"} and row["source"] == "unknown" and "pii_redacted" not in row


@pytest.mark.parametrize(("raw", "value"), [("true", True), ("TRUE", True), ("1", False), ("yes", False)])
def test_settings_from_variables(raw, value):
    config = EngineConfig.from_variables({"PII_ENABLED": raw, "CHUNK_SIZE": "100", "PII_ENABLED_TYPES": "EMAIL, URL", "OTHER": "x"})
    assert config.pii_enabled is value and config.chunk_size == 100 and config.pii_types == ("EMAIL", "URL")


def test_unknown_store_type_is_refused():
    with pytest.raises(ValueError, match="unknown vector store"):
        EngineConfig.from_variables({"VECTOR_STORE_TYPE": "other"})
