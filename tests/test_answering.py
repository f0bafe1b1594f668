import pytest

from lectern.config import NO_CONTEXT, EngineConfig
from lectern.engine import Engine
from lectern.operators import answer, evaluate, prompt

RESULT = "question_id int, rank int, text string, score double, source string, page int, chunk_index int"


def test_budget_ends_at_the_first_overflow(spark):
    rows = [(1, 1, "a" * 50, 0.9, "s", 1, 0), (1, 2, "b" * 500, 0.8, "s", 2, 0), (1, 3, "c", 0.7, "s", 3, 0), (2, 1, "d" * 900, 0.5, "s", 1, 0)]
    asked = spark.createDataFrame([(1, "why {context}?"), (2, "what?"), (3, "who?")], "question_id int, question string")
    config = EngineConfig(max_context_chars=300, system_prompt="SYS")
    got = {r["question_id"]: r for r in prompt.build_prompts(asked, spark.createDataFrame(rows, RESULT), config=config).collect()}
    assert got[1]["prompt"] == "SYS\n\nContext:\n[1] (Source: s, Page 1)\n" + "a" * 50 + "\n\nQuestion: why {context}?\n\nAnswer:"
    assert got[1]["context_chunks_used"] == 1 and got[1]["context_chars"] == 50 + len("[1] (Source: s, Page 1)\n") and got[1]["sources"][0]["score"] == 0.9
    assert NO_CONTEXT in got[2]["prompt"] and got[2]["sources"] == [] and got[3]["context_chunks_used"] == 0


def test_keywords_and_summary(spark):
    rows = [("The Hairbrush", ["hair", "comb"], [(0.5,)]), (None, ["x"], []), ("no", [], None)]
    df = spark.createDataFrame(rows, "answer string, expected_keywords array<string>, sources array<struct<score:double>>")
    scored = evaluate.with_top_score(evaluate.keyword_matches(df)).selectExpr("*", "2.0D as latency_seconds")
    got = scored.collect()
    assert [r["matched_keywords"] for r in got] == [["hair"], [], []] and [r["top_score"] for r in got] == [0.5, 0.0, 0.0]
    one = evaluate.summary(scored).head()
    assert (one["passed"], one["total"], round(one["percent"], 3), one["mean_latency_seconds"]) == (1, 3, 33.333, 2.0)
    none = evaluate.summary(scored.limit(0)).head()
    assert tuple(none) == (0, 0, 0.0, 0.0, 0.0)


def test_streamed_tokens():
    seen = []
    assert answer.stream("p", lambda p: iter([" a", "b "]), seen.append) == "ab" and seen == [" a", "b "]


@pytest.fixture
def engine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "story.html").write_text("<body><h1>Story</h1><p>Della had one dollar and eighty-seven cents at the start. She sold her hair to Madame Sofronie. Jim sold his gold watch to buy combs.</p></body>")
    (folder / "other.json").write_text('[{"note": "The boiler is inspected every winter by the landlord."}]')
    return Engine(spark, str(tmp_path / "data"), EngineConfig(dimension=128)), folder


def test_ingest_ask_evaluate_and_delete(engine, spark):
    e, folder = engine
    n = e.ingest(str(folder))
    assert n >= 2 and e.vectors.read().count() == e.chunks.read().count() == n
    assert e.ingest(str(folder)) == n and e.vectors.read().count() == n  # ids repeat: nothing is added
    got = e.ask_one("How much money did Della have at the start?", 2)
    assert "one dollar" in got["answer"] and got["sources"][0]["source"] == "story.html" and got["model"] == "extractive"
    seen = []
    streamed = e.ask_one("Who inspects the boiler?", tokens=lambda p: iter(["a ", "b"]), sink=seen.append)
    assert streamed["answer"] == "a b" and seen == ["a ", "b"]
    results = e.run_eval()
    assert results.count() == len(evaluate.DEFAULT_SUITE) and evaluate.summary(results).head()["passed"] >= 3
    assert evaluate.case_report(results).count() == 6
    hits, prompts = e.debug("boiler", 1)
    assert hits.count() == 1 and "Question: boiler" in prompts.head()["prompt"]
    assert e.with_parents(hits).head()["metadata_json"] is not None
    assert e.delete_source("other.json") >= 1 and e.chunks.by_source("other.json").count() == 0 and e.vectors.by_source("other.json").count() >= 1


def test_watching_a_folder(engine, spark, tmp_path):
    e, folder = engine
    (folder / "bad.json").write_text("{")
    (folder / "x.html.part").write_text("no")
    zone = e.watch(str(folder))
    zone.start(available_now=True).awaitTermination()
    assert not zone.is_running() and {r["source"] for r in e.chunks.read().select("source").distinct().collect()} == {"story.html", "other.json"}
    assert [r["error"][:8] for r in spark.read.parquet(zone.dead_letters).collect()] == ["JSONDeco"]
    before = e.chunks.read().count()
    (folder / "late.html").write_text("<p>A late arrival with enough characters to pass the gate.</p>")
    again = e.watch(str(folder))
    again.start(available_now=True).awaitTermination()
    assert e.chunks.read().count() == before + 1


def test_only_new_files(engine, spark):
    e, folder = engine
    zone = e.watch(str(folder), since="2100-01-01 00:00:00")
    zone.start(available_now=True).awaitTermination()
    assert e.chunks.read().count() == 0
