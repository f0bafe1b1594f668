import random

import pytest
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.operators import chunk, embed


@pytest.mark.parametrize("size", [511, 512, 513])
def test_sizes_at_the_limit(size):
    text = "x" * size
    parts = chunk.recursive_split(text)
    assert "".join(parts)[:512] == text[:512] and all(len(p) <= 512 for p in parts) and len(parts) == (1 if size <= 512 else 2)


def test_chunks_cover_the_text_and_stay_within_the_size():
    rng = random.Random(1)
    for _ in range(200):
        pieces = [rng.choice(["w{} ", "longer-w{} ", "end{}. ", "{}\n", "{}\n\n", "y" * 30 + "{}"]).format(k) for k in range(rng.randint(0, 120))]
        text = "".join(pieces)
        parts = chunk.recursive_split(text, 80, 20)
        assert all(0 < len(p) <= 80 and p == p.strip() for p in parts)
        at = 0
        for p in parts:  # every chunk continues or overlaps the one before
            places = [k for k in range(max(0, at - 21), at + 40) if text.startswith(p, k) and (k <= at or not text[at:k].strip())]
            assert places
            found = places[-1]
            at = found + len(p)
        assert text[at:].strip() == ""


def test_strong_separators_come_first():
    text = "A" * 60 + "\n\n" + "B" * 60
    assert chunk.recursive_split(text, 100, 10) == ["A" * 60, "B" * 60]
    assert chunk.recursive_split("", 100, 10) == [] and chunk.recursive_split("  \n ", 100, 10) == []


def python_breaks(sims, threshold, least, most):
    out, size = [], 0
    for i, s in enumerate(sims):
        size += 1
        if (s < threshold and size >= least) or size >= most:
            out.append(i + 1)
            size = 0
    return out


def test_breakpoints_and_groups(spark):
    rng = random.Random(2)
    cases = [[rng.random() for _ in range(rng.randint(0, 40))] for _ in range(200)] + [[1.0] * 30, [0.0] * 9]
    df = spark.createDataFrame([(i, c, [f"s{k}" for k in range(len(c) + 1)]) for i, c in enumerate(cases)], "i int, s array<double>, t array<string>")
    rows = df.select("i", chunk.breakpoints(F.col("s")).alias("b"), chunk.grouped(F.col("t"), chunk.breakpoints(F.col("s"))).alias("g")).orderBy("i").collect()
    for row, sims in zip(rows, cases):
        assert row["b"] == python_breaks(sims, 0.75, 2, 15)
        groups = [g.split(" ") for g in row["g"]]
        assert sum(groups, []) == [f"s{k}" for k in range(len(sims) + 1)] and (len(groups) == 1 or len(groups[-1]) >= 2) and all(len(g) <= 16 for g in groups)


def test_routes_numbers_and_extra_columns(spark):
    docs = [(1, "html", "One thing. Another thing. A third one. And a fourth."), (2, "PDF ", "word " * 300), (3, None, None), (4, "json", "Short. Text."), (5, "pdf", " ")]
    df = spark.createDataFrame(docs, "id int, file_type string, page_content string").withColumn("chunk_index", F.lit(9))
    got = chunk.chunk_documents(df, embed.embed_similarities(), EngineConfig()).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {1, 2, 4} and by[4][0]["page_content"] == "Short. Text."
    for rows in by.values():
        assert sorted(r["chunk_index"] for r in rows) == list(range(len(rows))) and {r["chunk_total"] for r in rows} == {len(rows)}


def test_embedding_retries_wait_and_give_up():
    calls, waits = [], []

    def failing(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    assert embed.with_retries(failing, 3, waits.append)(["a"]) == [[1.0]] and waits == [1.0, 2.0]
    with pytest.raises(OSError, match="busy"):
        embed.with_retries(lambda t: (_ for _ in ()).throw(OSError("busy")), 2, waits.append)(["a"])
    with pytest.raises(RuntimeError):
        embed.with_retries(failing, 0)(["a"])


def test_embedding_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i int, t string")
    rows = {r["i"]: r["v"] for r in embed.embed_texts(df, "t", "v", config=EngineConfig(dimension=16)).collect()}
    assert rows[2] is None and len(rows[1]) == len(rows[3]) == 16 and any(rows[1]) and not any(rows[3])


def test_abbreviations_end_no_sentence():
    assert chunk.sentences("Mr. Smith came, e.g. by train. He met Dr. Jones! Was it z.B. late? Fig. 3 says so. ok") == ["Mr. Smith came, e.g. by train.", "He met Dr. Jones!", "Was it z.B. late?", "Fig. 3 says so.", "ok"]
    assert chunk.sentences("The firm. Next") == ["The firm.", "Next"] and chunk.sentences(" ") == []
