"""The whole engine: ingest files, ask questions, evaluate, debug, watch a folder."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions.vectors import vector_id
from lectern.operators import answer, chunk, embed, evaluate, preprocess, prompt, search, store
from lectern.session import ship, stage
from lectern.sources import files
from lectern.streaming.landing import LandingZone

log = logging.getLogger("lectern")


class Engine:
    """Everything is lazy but ``ingest*`` and ``prepare``. ``folder`` holds the vector and the chunk table; the provider of embeddings, the
    generator of answers, and the parsers of binary formats are replaceable."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig(), provider: embed.Provider | None = None, generator: answer.Generator = answer.extractive_answer, model: str = "extractive", parsers: files.Parsers | None = None):
        ship(spark)
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.provider, self.generator, self.model = provider or embed.hashing_provider(config.dimension), generator, model
        self.parsers = parsers or files.Parsers(docx_page_chars=config.docx_page_chars, ocr_language=config.ocr_language)

    @property
    def vectors(self) -> store.KeyedTable:
        return store.KeyedTable(self.spark, f"{self.folder}/vectors", store.VECTORS)

    @property
    def chunks(self) -> store.KeyedTable:
        return store.KeyedTable(self.spark, f"{self.folder}/chunks", store.CHUNKS)

    def prepare(self, documents: DataFrame) -> DataFrame:
        """Documents -> embedded chunks with their ids. The prepared documents are written once, for both chunkers."""
        clean = stage(preprocess.preprocess(documents, self.config), "prepared")
        made = chunk.chunk_documents(clean, embed.embed_similarities(self.provider, self.config), self.config)
        made = embed.embed_texts(made, "page_content", "vector", self.provider, self.config)
        return made.withColumn("vector_id", vector_id(F.col("source"), F.col("page"), F.col("chunk_index")))

    def ingest_documents(self, documents: DataFrame) -> int:
        """Upsert the chunks of ``documents`` into both tables; returns the number of chunks. They are computed once, as a
        written table, for both."""
        made = stage(self.prepare(documents), "chunks")
        n = self.vectors.upsert(store.vector_rows(made, F.col("vector_id")))
        if self.config.store_enabled:
            self.chunks.upsert(store.chunk_rows(made, F.col("vector_id")))
        log.info("ingested %d chunks", n)
        return n

    def ingest(self, path: str, strict: bool = False) -> int:
        """A file or a folder. Files that cannot be read are reported and left out, unless ``strict``."""
        found = files.load(self.spark, path, self.parsers, strict)
        return self.ingest_documents(found.filter("error is null").drop("error"))

    def ingest_files(self, arrived: DataFrame) -> DataFrame:
        """Files of a stream's batch; returns the rows of those that failed."""
        found = stage(files.parse_files(arrived.select("path", "content"), self.parsers), "arrived")
        self.ingest_documents(found.filter("error is null").drop("error"))
        return found.filter("error is not null").select("source_path", "file_type", "error")

    def retrieve(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """(question_id, rank, score, text, source, page, chunk_index) for ``questions(question_id, question)``."""
        asked = embed.embed_texts(questions.select("question_id", "question"), "question", "vector", self.provider, self.config)
        table = self.vectors.read()
        hits = search.batch_top_k(table, asked, top_k or self.config.top_k, self.config.score_scale)
        return search.with_payload(hits.join(table.drop("vector"), "vector_id"))

    def prompts(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        return prompt.build_prompts(questions, self.retrieve(questions, top_k), "question_id", self.config)

    def ask(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """``questions`` with prompt, sources, answer, model and latency."""
        return answer.generate(self.prompts(questions, top_k), self.generator, self.model)

    def ask_one(self, question: str, top_k: int | None = None, tokens: Callable[[str], Iterator[str]] | None = None, sink: Callable[[str], None] = print) -> dict:
        """One question; with ``tokens`` the answer is streamed to ``sink``."""
        one = self.spark.createDataFrame([(1, question)], "question_id int, question string")
        if tokens is None:
            return self.ask(one, top_k).head().asDict(recursive=True)
        row = self.prompts(one, top_k).head().asDict(recursive=True)
        return row | {"answer": answer.stream(row["prompt"], tokens, sink), "model": self.model}

    def run_eval(self, cases: DataFrame | None = None) -> DataFrame:
        """Results of a suite, the built-in one by default: one plan for all cases."""
        asked = cases if cases is not None else evaluate.suite(self.spark)
        return evaluate.with_top_score(evaluate.keyword_matches(self.ask(asked)))

    def debug(self, question: str, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
        """(ranked results with previews, the prompt), without an answer."""
        one = self.spark.createDataFrame([(1, question)], "question_id int, question string")
        return evaluate.preview(self.retrieve(one, top_k)).orderBy("rank"), self.prompts(one, top_k)

    def with_parents(self, hits: DataFrame) -> DataFrame:
        """Hits with their full chunk and metadata from the chunk table."""
        return hits.join(self.chunks.read().select("vector_id", "content", "metadata_json", "ingested_at"), "vector_id", "left")

    def delete_source(self, source: str, vectors_too: bool = False) -> int:
        """Remove a source's chunks; its vectors stay unless told."""
        n = self.chunks.delete_by_source(source)
        if vectors_too:
            self.vectors.delete_by_source(source)
        return n

    def watch(self, folder: str, recursive: bool = False, since: str | None = None) -> LandingZone:
        return LandingZone(self.spark, folder, self.ingest_files, f"{self.folder}/_watch/checkpoint", f"{self.folder}/_watch/dead_letters", recursive, since)
