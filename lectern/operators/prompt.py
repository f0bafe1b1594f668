"""Prompts from ranked search results within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import NO_CONTEXT, EngineConfig


def used_results(results: DataFrame, key: str = "question_id", config: EngineConfig = EngineConfig()) -> DataFrame:
    """``results(key, rank, text, source, page)`` with ``part``, the formatted context, while the sum of their lengths
    stays within the budget: the first that exceeds it ends the context, whatever comes after."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (Source: "), F.col("source"), F.lit(", Page "), F.col("page").cast("string"), F.lit(")\n"), F.col("text"))
    so_far = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("part", part).withColumn("_sum", F.sum(F.length("part")).over(so_far))
    return rows.filter(F.col("_sum") <= config.max_context_chars).drop("_sum")


def build_prompts(questions: DataFrame, results: DataFrame, key: str = "question_id", config: EngineConfig = EngineConfig()) -> DataFrame:
    """``questions`` with ``prompt``, ``sources`` (the results used, by rank), ``context_chunks_used`` and
    ``context_chars``. A question without results, or whose first result exceeds the budget, has an empty context."""
    used = used_results(results, key, config)
    payload = F.struct("rank", "part", "text", "score", "source", "page", "chunk_index")
    context = used.groupBy(key).agg(F.array_sort(F.collect_list(payload)).alias("_used"))
    rows = questions.join(context, key, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<struct<rank:int,part:string,text:string,score:double,source:string,page:int,chunk_index:int>>")))
    text = F.when(F.size("_used") > 0, F.array_join(F.transform("_used", lambda u: u["part"]), "\n\n")).otherwise(NO_CONTEXT)
    # the question goes in last, so that nothing a context holds is taken for a place to fill
    pieces = config.prompt_template.replace("{system}", config.system_prompt).split("{context}")
    tail = pieces[1].split("{question}") if len(pieces) > 1 else [""]
    prompt = F.concat(F.lit(pieces[0]), text, F.lit(tail[0]), F.col("question"), F.lit(tail[1] if len(tail) > 1 else ""))
    return rows.withColumns(
        {
            "prompt": prompt,
            "sources": F.transform("_used", lambda u: F.struct(u["text"].alias("text"), u["score"].alias("score"), u["source"].alias("source"), u["page"].alias("page"), u["chunk_index"].alias("chunk_index"))),
            "context_chunks_used": F.size("_used"),
            "context_chars": F.aggregate("_used", F.lit(0), lambda a, u: a + F.length(u["part"])),
        }
    ).drop("_used")
