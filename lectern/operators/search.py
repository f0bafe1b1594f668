"""Exact similarity search over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.vectors import chroma_score, cosine

DEFAULT_K = 5
QUESTION_BLOCK = 4096
SUB_BLOCK = 1024  # questions and vectors of one product: 8 MB


def score(cos: Column, scale: str = "pinecone") -> Column:
    return chroma_score(cos) if scale == "chroma" else cos


def top_k(vectors: DataFrame, query: Sequence[float], k: int | None = None, scale: str = "pinecone", vector_col: str = "vector", id_col: str = "vector_id") -> DataFrame:
    """The ``k`` rows most like one query vector, best first, ties by id; 0 or none is the default of 5.

    The query is a literal: one scan without a join, each task keeps its own k best.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    ranked = vectors.withColumn("score", score(cosine(F.col(vector_col), literal), scale))
    return ranked.orderBy(F.desc("score"), id_col).limit(k or DEFAULT_K)


def with_payload(hits: DataFrame) -> DataFrame:
    """Missing payload gets its default."""
    defaults = {"text": F.lit(""), "source": F.lit("unknown"), "page": F.lit(0), "chunk_index": F.lit(0)}
    return hits.withColumns({c: F.coalesce(c, d) if c in hits.columns else d for c, d in defaults.items()})


def batch_top_k(vectors: DataFrame, questions: DataFrame, k: int = DEFAULT_K, scale: str = "pinecone", vector_col: str = "vector", id_col: str = "vector_id", question_col: str = "question_id", question_vector_col: str = "vector", block: int = QUESTION_BLOCK) -> DataFrame:
    """(question, id, score, rank): the ``k`` most similar vectors of every question, in one scan for each block.

    Questions go to the tasks in blocks of at most ``block`` (the bound of what is broadcast: 8 bytes times dimensions
    times ``block``); each task multiplies its vectors with the block and keeps k a question, and the partial bests are
    merged by question. Null vectors and vectors of another length than the question's have no score and are left out;
    a vector or question of length 0 (norm) scores as cosine 0.
    """
    spark = vectors.sparkSession
    scan = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).filter("_v is not null")
    kind = vectors.schema[id_col].dataType.simpleString()
    q_kind = questions.schema[question_col].dataType.simpleString()
    part = None

    def partial(ids: list, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            size = np.linalg.norm(q, axis=1)
            top = np.full((len(names), k), -np.inf)  # exactly k a question, better ones first, ties by id
            at = np.full((len(names), k), -1, dtype=np.int64)  # places in ``known``
            known = np.zeros(0, dtype=object)
            for whole in batches:
                for batch in (whole.slice(s, SUB_BLOCK) for s in range(0, whole.num_rows, SUB_BLOCK)):
                    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                    keep = np.flatnonzero(lengths == q.shape[1])
                    if not len(keep):
                        continue
                    v = batch.column(1).take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1)
                    found = np.array(batch.column(0).take(pa.array(keep)).to_pylist(), dtype=object)
                    order = np.argsort(found, kind="stable")  # rows by id, so that a stable sort breaks ties by it
                    v, found = v[order], found[order]
                    length = np.linalg.norm(v, axis=1)
                    names_of = np.concatenate([known, found])
                    rank = np.argsort(np.argsort(names_of, kind="stable"), kind="stable")
                    for s in range(0, len(names), SUB_BLOCK):
                        rows = slice(s, s + SUB_BLOCK)
                        both = np.outer(size[rows], length)
                        sims = np.where(both > 0, np.nan_to_num(q[rows] @ v.T) / np.where(both > 0, both, 1), 0.0).round(12)
                        if sims.shape[1] > k:
                            # beyond the k-th score nothing counts; of its ties the smallest ids, which stand first, are enough
                            floor = np.partition(sims, -k, axis=1)[:, -k][:, None]
                            tied = sims == floor
                            room = k - (sims > floor).sum(axis=1)[:, None]
                            take = (sims > floor) | (tied & (np.cumsum(tied, axis=1) <= room))
                            cols = np.nonzero(take)[1].reshape(len(sims), k)
                        else:
                            cols = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
                        scores = np.concatenate([top[rows], np.take_along_axis(sims, cols, 1)], axis=1)
                        places = np.concatenate([at[rows], len(known) + cols], axis=1)
                        pick = np.lexsort((np.where(places >= 0, rank[places], len(names_of)), -scores), axis=1)[:, :k]
                        top[rows], at[rows] = np.take_along_axis(scores, pick, 1), np.take_along_axis(places, pick, 1)
                    used = np.unique(at[at >= 0])  # ids that are still among the best of some question
                    at = np.where(at >= 0, np.searchsorted(used, at), -1)
                    known = names_of[used]
            row, column = np.nonzero(at >= 0)
            if len(row):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"q": np.array(names, dtype=object)[row], "id": known[at[row, column]], "cosine": top[row, column]}), schema=out_schema)

        out_schema = pa.schema([("q", pa.int64() if q_kind in ("bigint", "int") else pa.string()), ("id", pa.int64() if kind in ("bigint", "int") else pa.string()), ("cosine", pa.float64())])
        return scan.mapInArrow(best, f"q {'bigint' if q_kind in ('bigint', 'int') else 'string'}, id {'bigint' if kind in ('bigint', 'int') else 'string'}, cosine double")

    ids, rows = [], []
    for row in questions.select(question_col, F.col(question_vector_col).cast("array<double>").alias("v")).filter("v is not null").toLocalIterator():
        if rows and (len(rows) >= block or len(row["v"]) != len(rows[0])):
            more = partial(ids, np.array(rows))
            part = more if part is None else part.unionByName(more)
            ids, rows = [], []
        ids.append(row[0])
        rows.append(row["v"])
    if rows:
        more = partial(ids, np.array(rows))
        part = more if part is None else part.unionByName(more)
    if part is None:
        return spark.createDataFrame([], f"{question_col} {q_kind}, {id_col} {kind}, score double, rank int")
    best = part.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 12)).alias("far"), "id", "cosine"))), 1, k).alias("best"))
    out = best.select("q", F.posexplode("best").alias("rank", "b"))
    return out.select(F.col("q").alias(question_col), F.col("b.id").alias(id_col), score(F.col("b.cosine"), scale).alias("score"), (F.col("rank") + 1).alias("rank"))
