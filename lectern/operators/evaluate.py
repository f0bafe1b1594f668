"""Keyword evaluation of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The built-in suite (fixed values): question, keywords, notes.
DEFAULT_SUITE = [
    ("How much money did Della have at the start?", ["1.87", "one dollar", "eighty-seven"], "Opening fact — should be high confidence"),
    ("What did Della sell to get money?", ["hair", "brown hair"], "Core plot point"),
    ("What gift did Jim buy for Della?", ["comb", "combs", "hair comb", "watch chain", "chain"], "Ironic gift reveal — context may surface watch chain instead of combs"),
    ("What did Jim sell to buy Della's gift?", ["watch", "gold watch"], "Jim's sacrifice — tests retrieval of Jim-focused chunks"),
    ("Who cut Della's hair?", ["sofronie", "mrs. sofronie"], "Specific named character"),
    ("What is the theme of the story?", ["love", "sacrifice", "gift", "wise", "magi"], "Abstract question — tests generalization"),
]
SUITE = "question_id int, question string, expected_keywords array<string>, notes string"


def suite(spark: SparkSession, cases: list[tuple[str, list[str], str]] | None = None) -> DataFrame:
    """A suite as a DataFrame; without cases the built-in one."""
    return spark.createDataFrame([(i + 1, *c) for i, c in enumerate(cases or DEFAULT_SUITE)], SUITE)


def keyword_matches(answers: DataFrame) -> DataFrame:
    """``matched_keywords``, the expected ones that occur in the answer in any case as parts of words too, in order, and
    ``passed`` if there is one. Null answers and keywords match nothing."""
    answer = F.lower(F.coalesce("answer", F.lit("")))
    hits = F.filter(F.coalesce("expected_keywords", F.array().cast("array<string>")), lambda k: F.coalesce(F.contains(answer, F.lower(k)), F.lit(False)))
    return answers.withColumn("matched_keywords", hits).withColumn("passed", F.size("matched_keywords") > 0)


def with_top_score(answers: DataFrame) -> DataFrame:
    """The score of the first source used, 0 where none was."""
    return answers.withColumn("top_score", F.coalesce(F.get("sources", F.lit(0))["score"], F.lit(0.0)))


def summary(results: DataFrame) -> DataFrame:
    """One row: passed, total, percent, mean latency and mean top score; zeros for an empty suite."""
    total = F.count(F.lit(1))
    zero = F.lit(0.0)
    return results.agg(
        F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).alias("passed"),
        total.alias("total"),
        F.coalesce(100.0 * F.sum(F.col("passed").cast("int")) / F.nullif(total, F.lit(0)), zero).alias("percent"),
        F.coalesce(F.avg("latency_seconds"), zero).alias("mean_latency_seconds"),
        F.coalesce(F.avg("top_score"), zero).alias("mean_top_score"),
    )


def case_report(results: DataFrame) -> DataFrame:
    """A line for each case: status and the first 80 characters of the answer."""
    return results.select("question", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), F.substring("answer", 1, 80).alias("answer"), "matched_keywords", "latency_seconds")


def preview(results: DataFrame, chars: int = 200) -> DataFrame:
    """Ranked results with a preview of their text on one line."""
    return results.withColumn("preview", F.replace(F.substring("text", 1, chars), F.lit("\n"), F.lit(" ")))
