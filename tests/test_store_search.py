import numpy as np
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.operators import search, store

SCHEMA = "vector_id string, source string, content string"


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_upserts_lookups_and_deletes(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, max_runs=2)
    assert rows_of(t) == []
    first = spark.createDataFrame([("a", "s", "1"), ("b", "s", "2"), ("a", "s", "3")], SCHEMA).coalesce(1)
    assert t.upsert(first) == 3 and rows_of(t) == [("a", "s", "3"), ("b", "s", "2")]
    assert t.upsert(spark.createDataFrame([("b", "s2", "4"), ("c", "s", "5")], SCHEMA)) == 2
    assert rows_of(t) == [("a", "s", "3"), ("b", "s2", "4"), ("c", "s", "5")]
    assert [r["content"] for r in t.get("b").collect()] == ["4"] and t.get("zz").count() == 0
    assert t.delete_by_source("s") == 2 and rows_of(t) == [("b", "s2", "4")] and t.delete_by_source("s") == 0
    assert t.upsert(spark.createDataFrame([("a", None, "6")], SCHEMA)) == 1  # more runs than allowed: merged
    assert len(t.runs()) == 1 and rows_of(t) == [("a", None, "6"), ("b", "s2", "4")]
    assert t.delete(F.col("source").eqNullSafe(None)) == 1
    again = store.KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert rows_of(again) == [("b", "s2", "4")] and t.upsert(spark.createDataFrame([], SCHEMA)) == 0


def test_a_lookup_reaches_the_scan(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    t.upsert(spark.createDataFrame([("a", "s", "1")], SCHEMA))
    plan = t.get("a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vector_id,a)" in plan


def test_vector_identities(spark):
    row = spark.range(1).select(V.vector_id(F.lit("f.pdf"), F.lit(3), F.lit(0)).alias("i")).withColumn("p", V.point_id(F.col("i"))).head()
    import hashlib

    want = hashlib.sha256(b"f.pdf::p3::c0").hexdigest()[:32]
    assert row["i"] == want and int(row["p"]) == int(want[:16], 16)


def test_top_k_and_batches_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = v[3]
    v[11] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(7)
    asked = df.filter("id % 20 = 3").select(F.col("id").alias("q"), "vector")
    got = search.batch_top_k(df, asked, 5, id_col="id", question_col="q", block=4).collect()
    size = np.linalg.norm(v, axis=1)
    for q in range(3, 300, 20):
        both = size * size[q]
        cos = np.where(both > 0, v @ v[q] / np.where(both > 0, both, 1), 0)
        want = sorted(range(300), key=lambda i: (-round(cos[i], 12), i))[:5]
        own = sorted((r["rank"], r["id"], r["score"]) for r in got if r["q"] == q)
        assert [x[1] for x in own] == want and np.allclose([x[2] for x in own], cos[want])
    one = search.top_k(df.filter("size(vector) = 8"), v[3].tolist(), None, "chroma", id_col="id").collect()
    assert [r["id"] for r in one][:2] == [3, 7] and len(one) == 5 and abs(one[0]["score"] - 1) < 1e-9
    assert search.batch_top_k(df, asked.limit(0), 5, id_col="id", question_col="q").count() == 0


def test_a_question_without_length_ties_with_all_and_keeps_k(spark):
    rows = [(i, [0.0, 1.0] if i % 2 else [1.0, 0.0]) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([("zero", [0.0, 0.0]), ("east", [2.0, 0.0]), ("null", None)], "q string, vector array<double>")
    got = search.batch_top_k(df, asked, 3, id_col="id", question_col="q").collect()
    assert sorted((r["q"], r["rank"], r["id"], r["score"]) for r in got) == [("east", 1, 0, 1.0), ("east", 2, 2, 1.0), ("east", 3, 4, 1.0), ("zero", 1, 0, 0.0), ("zero", 2, 1, 0.0), ("zero", 3, 2, 0.0)]


def test_rows_of_a_source_are_found_without_ordering_the_table(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), store.CHUNKS)
    row = lambda key, source, text: (key, source, 1, 0, text, "{}", "")
    t.upsert(spark.createDataFrame([row("a", "s", "1"), row("b", "s", "2"), row("c", "x", "3")], store.CHUNKS))
    t.upsert(spark.createDataFrame([row("b", "x", "4"), row("c", "s", "5")], store.CHUNKS))
    assert sorted((r["vector_id"], r["content"]) for r in t.by_source("s").collect()) == [("a", "1"), ("c", "5")]
    assert t.delete_by_source("s") == 2 and [r["vector_id"] for r in t.read().collect()] == ["b"]


def test_payload_defaults(spark):
    hit = search.with_payload(spark.createDataFrame([(None, None)], "text string, source string")).head()
    assert (hit["text"], hit["source"], hit["page"], hit["chunk_index"]) == ("", "unknown", 0, 0)
