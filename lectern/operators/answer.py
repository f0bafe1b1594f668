"""Answers through a replaceable generator."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[str], str]


def extractive_answer(prompt: str) -> str:
    """A deterministic offline stand-in for a model: the sentence of the context that shares most words with the question,
    and its source number. It shows that the pieces fit; it does not reason."""
    if "Context:\n" not in prompt or "\n\nQuestion: " not in prompt:
        return ""
    context, _, rest = prompt.split("Context:\n", 1)[1].rpartition("\n\nQuestion: ")
    asked = set(re.findall(r"\w+", rest.split("\n\nAnswer:")[0].lower()))
    best = (0, "I don't have enough information to answer that.")
    for number, body in re.findall(r"^\[(\d+)\] \(Source: [^\n]*\)\n(.*?)(?=\n\n\[\d+\] \(Source: |\Z)", context, re.S | re.M):
        for sentence in re.split(r"(?<=[.!?])\s+", body):
            shared = len(asked & set(re.findall(r"\w+", sentence.lower())))
            if shared > best[0]:
                best = (shared, f"{sentence.strip()} [{number}]")
    return best[1]


def generate(prompts: DataFrame, generator: Generator = extractive_answer, model: str = "extractive") -> DataFrame:
    """``prompts`` with ``answer`` (stripped), ``model`` and ``latency_seconds``. Null prompts have a null answer."""

    @F.pandas_udf("struct<answer:string,latency_seconds:double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for prompt in s:
                began = time.perf_counter()
                rows.append((None if prompt is None else generator(prompt).strip(), time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["answer", "latency_seconds"])

    return prompts.withColumn("_made", call("prompt")).select(*prompts.columns, "_made.answer", "_made.latency_seconds", F.lit(model).alias("model"))


def stream(prompt: str, tokens: Callable[[str], Iterator[str]], sink: Callable[[str], None]) -> str:
    """Hand every token of one answer to ``sink`` as it comes; returns the whole, stripped. Runs in the driver."""
    out = []
    for token in tokens(prompt):
        sink(token)
        out.append(token)
    return "".join(out).strip()
