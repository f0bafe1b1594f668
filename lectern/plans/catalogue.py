"""Every query of the engine over the test tables, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.config import NO_CONTEXT, EngineConfig
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import answer, chunk, embed, evaluate, pii, preprocess, prompt, search, store
from lectern.plans import dialect as D
from lectern.session import table, work_folder
from lectern.sources import files, html, json_docs
from lectern.streaming.landing import LandingZone

RUN_TIME = "2025-01-01T00:00:00+00:00"
CONFIG = EngineConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("text", "page_content")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their metadata as columns."""
    keys = ("source", "source_path", "page", "total_pages", "file_type", "section_title", "ocr_lang", "ingested_at")
    return table(spark, d, "loaded_pages").select("rec_id", "page_content", *[F.col("metadata")[k].alias(k) for k in keys])


# ------------------------------------------------------------------ text
@query(f"SELECT doc_id, {D.sanitize('text')} AS page_content FROM documents")
def sanitize_text(spark, d):
    return preprocess.sanitize_text(_documents(spark, d)).select("doc_id", "page_content")


@query(f"SELECT rec_id, {D.normalize(D.sanitize('page_content'))} AS page_content FROM loaded_pages")
def unicode_normalize(spark, d):
    return preprocess.normalize_unicode(preprocess.sanitize_text(_pages(spark, d))).select("rec_id", "page_content")


METADATA_SQL = f"""SELECT rec_id, {D.base_name("coalesce(metadata['source'], 'unknown')")} AS source,
  coalesce(metadata['source_path'], '') AS source_path, {D.whole("metadata['page']")} AS page, {D.whole("metadata['total_pages']")} AS total_pages,
  0 AS chunk_index, 0 AS chunk_total, lower({D.strip("coalesce(metadata['file_type'], 'unknown')")}) AS file_type,
  coalesce(metadata['ingested_at'], '{RUN_TIME}') AS ingested_at FROM loaded_pages"""


@query(METADATA_SQL)
def metadata_normalize(spark, d):
    return preprocess.normalize_metadata(_pages(spark, d), RUN_TIME).select("rec_id", "source", "source_path", "page", "total_pages", "chunk_index", "chunk_total", "file_type", "ingested_at")


@query(f"SELECT doc_id, {D.strip('text')} AS page_content FROM documents WHERE length({D.strip('text')}) >= 20")
def schema_gate(spark, d):
    return preprocess.schema_gate(_documents(spark, d)).select("doc_id", "page_content")


@query(f"""SELECT doc_id, CASE WHEN text IS NULL THEN 'content is no text' ELSE 'content has only ' || length({D.strip('text')}) || ' characters' END AS reject_reason
FROM documents WHERE text IS NULL OR length({D.strip('text')}) < 20""")
def schema_rejects(spark, d):
    return preprocess.schema_rejects(_documents(spark, d)).select("doc_id", "reject_reason")


ENRICHED = "word_count, char_count, estimated_read_time_seconds, has_numbers, has_tables, content_density"


@query(f"SELECT doc_id, {D.enriched(ENRICHED)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def enrich_metadata(spark, d):
    return preprocess.enrich(_documents(spark, d)).select("doc_id", *ENRICHED.split(", "))


# ------------------------------------------------------------------ personal data
PII_SQL = D.redacted("SELECT doc_id AS id, text AS t FROM documents", pii.PATTERNS)


@query(f"{PII_SQL} SELECT id AS doc_id, t AS page_content, pii_count, pii_count > 0 AS pii_redacted, pii_entities FROM redacted")
def pii_redact(spark, d):
    out = pii.redact(_documents(spark, d))
    return out.select("doc_id", "page_content", "pii_count", "pii_redacted", F.array_join("pii_entities", ",").alias("pii_entities"))


PII_CHUNKS = D.redacted("SELECT row_id AS id, content AS t FROM chunks", pii.PATTERNS)


@query(f"{PII_CHUNKS} SELECT entity, count(*) AS documents FROM (SELECT unnest(string_split(pii_entities, ',')) AS entity FROM redacted WHERE pii_entities <> '') GROUP BY entity")
def pii_entity_counts(spark, d):
    return pii.entity_counts(pii.redact(table(spark, d, "chunks"), "content"))


@query(f"""WITH meta AS ({METADATA_SQL}), clean AS (SELECT rec_id, {D.normalize(D.sanitize('page_content'))} AS t FROM loaded_pages),
gated AS (SELECT rec_id, {D.strip('t')} AS t FROM clean WHERE length({D.strip('t')}) >= 20),
rich AS (SELECT rec_id, t, {D.enriched(ENRICHED)} FROM gated), {D.redacted('SELECT rec_id AS id, t FROM gated', pii.PATTERNS)[5:]}
SELECT m.rec_id, m.source, m.page, m.file_type, r.t AS page_content, {ENRICHED}, r.pii_count > 0 AS pii_redacted, r.pii_entities
FROM meta m JOIN rich e ON e.rec_id = m.rec_id JOIN redacted r ON r.id = m.rec_id""")
def preprocess_pipeline(spark, d):
    out = preprocess.preprocess(_pages(spark, d), CONFIG, RUN_TIME)
    return out.select("rec_id", "source", "page", "file_type", "page_content", *ENRICHED.split(", "), "pii_redacted", F.array_join("pii_entities", ",").alias("pii_entities"))


# ------------------------------------------------------------------ chunking
@query(f"SELECT CASE WHEN lower({D.strip('file_type')}) IN ('html', 'json') THEN 'semantic' ELSE 'recursive' END AS route, count(*) AS documents FROM documents GROUP BY 1")
def route_documents(spark, d):
    return _documents(spark, d).groupBy(chunk.route(F.col("file_type")).alias("route")).agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id, {D.clean('text')} AS page_content FROM documents")
def clean_for_chunking(spark, d):
    return _documents(spark, d).select("doc_id", T.clean_for_chunking("page_content").alias("page_content"))


@query()
def chunk_recursive(spark, d):
    return chunk.recursive_chunks(_documents(spark, d)).select("doc_id", "chunk_index", "chunk_total", "page_content")


@query()
def chunk_semantic(spark, d):
    made = chunk.semantic_chunks(_documents(spark, d), embed.embed_similarities(config=CONFIG), CONFIG)
    return made.select("doc_id", "chunk_index", "chunk_total", "page_content")


@query()
def chunk_routed(spark, d):
    made = chunk.chunk_documents(_documents(spark, d), embed.embed_similarities(config=CONFIG), CONFIG)
    return made.select("doc_id", "file_type", "chunk_index", "chunk_total", "page_content")


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], n::DOUBLE[]), 6) AS similarity
FROM (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) AS n FROM embeddings) WHERE n IS NOT NULL""")
def semantic_adjacent_similarity(spark, d):
    order = Window.partitionBy(F.floor(F.col("vec_id") / 40)).orderBy("vec_id")
    rows = table(spark, d, "embeddings").withColumn("next", F.lead("embedding").over(order)).filter("next is not null")
    return rows.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


#: A lower threshold than the default, so that the vectors of the test table give groups of many sizes.
BREAKS = EngineConfig(similarity_threshold=0.1)


@query("""WITH RECURSIVE s AS (SELECT vec_id // 40 AS g, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) AS i,
  list_cosine_similarity(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY vec_id // 40 ORDER BY vec_id)::DOUBLE[]) AS v FROM embeddings),
w AS (SELECT g, i, CASE WHEN (v < 0.1 AND 1 >= 2) OR 1 >= 15 THEN 0 ELSE 1 END AS c, (v < 0.1 AND 1 >= 2) OR 1 >= 15 AS cut FROM s WHERE i = 1 AND v IS NOT NULL
  UNION ALL SELECT s.g, s.i, CASE WHEN (v < 0.1 AND w.c + 1 >= 2) OR w.c + 1 >= 15 THEN 0 ELSE w.c + 1 END, (v < 0.1 AND w.c + 1 >= 2) OR w.c + 1 >= 15
  FROM w JOIN s ON s.g = w.g AND s.i = w.i + 1 WHERE v IS NOT NULL)
SELECT g AS sequence, i::INTEGER AS break_after FROM w WHERE cut""")
def semantic_breakpoints(spark, d):
    group = F.floor(F.col("vec_id") / 40).cast("long")
    rows = table(spark, d, "embeddings").groupBy(group.alias("sequence")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    sims = chunk.adjacent_similarities(F.col("s.embedding"))
    return rows.select("sequence", F.explode(chunk.breakpoints(sims, BREAKS)).alias("break_after"))


# ------------------------------------------------------------------ identity and search
@query("""WITH v AS (SELECT row_id, substr(sha256(coalesce(source, 'unknown') || '::p' || page || '::c' || chunk_index), 1, 32) AS made, vector_id FROM chunks)
SELECT row_id, made, made = vector_id AS same, (('0x' || substr(made, 1, 16))::UBIGINT)::VARCHAR AS point_id FROM v""")
def vector_ids(spark, d):
    rows = table(spark, d, "chunks").withColumn("made", V.vector_id(F.coalesce("source", F.lit("unknown")), F.col("page"), F.col("chunk_index")))
    return rows.select("row_id", "made", (F.col("made") == F.col("vector_id")).alias("same"), V.point_id(F.col("made")).cast("string").alias("point_id"))


def _first_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").select(F.col("embedding").cast("array<double>").alias("v")).head()["v"]


TOP_SQL = "WITH q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round({score}, 6) AS score FROM embeddings, q ORDER BY {score} DESC, vec_id LIMIT 5"
COS = "list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])"


@query(TOP_SQL.format(score=COS))
def topk_cosine(spark, d):
    hits = search.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 5, vector_col="embedding", id_col="vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(TOP_SQL.format(score=f"greatest(0, 1 - (1 - {COS}) / 2)"))
def topk_chroma_score(spark, d):
    hits = search.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 0, "chroma", "embedding", "vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT question_id, vec_id, round(s, 6) AS score, r::INTEGER AS rank FROM (SELECT question_id, vec_id, s, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 12) DESC, vec_id) AS r
FROM (SELECT a.vec_id AS question_id, b.vec_id, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE r <= 5""")
def batch_topk(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    out = search.batch_top_k(rows, asked, 5, vector_col="embedding", id_col="vec_id")
    return out.select("question_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------ prompts and evaluation
@query(f"""WITH r AS (SELECT row_id % 40 AS question_id, row_number() OVER (PARTITION BY row_id % 40 ORDER BY row_id) AS rank, content, coalesce(source, 'unknown') AS source, page FROM chunks WHERE content IS NOT NULL AND content <> ''),
p AS (SELECT question_id, rank, '[' || rank || '] (Source: ' || source || ', Page ' || page || ')' || chr(10) || content AS part FROM r),
s AS (SELECT *, sum(length(part)) OVER (PARTITION BY question_id ORDER BY rank) AS so_far FROM p),
c AS (SELECT question_id, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INTEGER AS context_chunks_used, sum(length(part))::INTEGER AS context_chars FROM s WHERE so_far <= 6000 GROUP BY question_id)
SELECT e.case_id AS question_id, {D.quoted(CONFIG.system_prompt)} || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '{NO_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt,
coalesce(context_chunks_used, 0) AS context_chunks_used, coalesce(context_chars, 0) AS context_chars FROM eval_cases e LEFT JOIN c ON c.question_id = e.case_id""")
def prompt_context(spark, d):
    order = Window.partitionBy("question_id").orderBy("row_id")
    rows = table(spark, d, "chunks").filter("content is not null and content <> ''").withColumn("question_id", F.col("row_id") % 40)
    results = rows.select("question_id", F.row_number().over(order).alias("rank"), F.col("content").alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"), "page", "chunk_index", F.lit(1.0).alias("score"))
    asked = table(spark, d, "eval_cases").select(F.col("case_id").alias("question_id"), "question")
    return prompt.build_prompts(asked, results, config=CONFIG).select("question_id", "prompt", "context_chunks_used", "context_chars")


def _answers(spark, d) -> DataFrame:
    """Every document as the answer to one of the cases."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40 + 1).alias("case_id"), F.col("text").alias("answer"), (F.coalesce("n_chars", F.lit(0)) / 1000.0).alias("latency_seconds"))
    cases = table(spark, d, "eval_cases").select("case_id", "question", "expected_keywords")
    scores = F.array(F.struct((1 / (F.col("doc_id") + 1.0)).alias("score")))
    return docs.join(cases, "case_id").withColumn("sources", F.when(F.col("doc_id") % 2 == 0, scores).otherwise(F.slice(scores, 1, 0)))


MATCHES = "list_filter(coalesce(expected_keywords, []), lambda k: contains(lower(coalesce(text, '')), lower(k)))"


@query(f"SELECT doc_id, e.case_id, array_to_string({MATCHES}, '|') AS matched, len({MATCHES}) > 0 AS passed FROM documents d JOIN eval_cases e ON e.case_id = d.doc_id % 40 + 1")
def eval_keywords(spark, d):
    return evaluate.keyword_matches(_answers(spark, d)).select("doc_id", "case_id", F.array_join("matched_keywords", "|").alias("matched"), "passed")


@query(f"""SELECT sum(p)::BIGINT AS passed, count(*) AS total, round(100.0 * sum(p) / count(*), 6)::DOUBLE AS percent, round(avg(l), 6) AS mean_latency_seconds, round(avg(s), 6) AS mean_top_score
FROM (SELECT CASE WHEN len({MATCHES}) > 0 THEN 1 ELSE 0 END AS p, coalesce(n_chars, 0) / 1000.0::DOUBLE AS l, CASE WHEN doc_id % 2 = 0 THEN 1 / (doc_id + 1.0::DOUBLE) ELSE 0 END AS s FROM documents d JOIN eval_cases e ON e.case_id = d.doc_id % 40 + 1)""")
def eval_summary(spark, d):
    out = evaluate.summary(evaluate.with_top_score(evaluate.keyword_matches(_answers(spark, d))))
    return out.select("passed", "total", *[F.round(c, 6).alias(c) for c in ("percent", "mean_latency_seconds", "mean_top_score")])


# ------------------------------------------------------------------ stores
STORED = "SELECT vector_id, coalesce(source, 'unknown') AS source, page, chunk_index, content, metadata_json, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY row_id DESC) AS r FROM chunks WHERE {where}) WHERE r = 1"


def _rows(spark, d) -> DataFrame:
    return table(spark, d, "chunks").withColumn("source", F.coalesce("source", F.lit("unknown")))


def _in_order(rows: DataFrame, target: store.KeyedTable, order: str) -> None:
    """Upsert rows that carry their own order beside the table's columns."""
    last = store.last_of_each(rows, "vector_id", F.col(order))
    target.upsert(last)


def _stored(spark, d) -> store.KeyedTable:
    """All rows in two writes, the earlier batches first."""
    target, rows = store.KeyedTable(spark, work_folder(spark, "store")), _rows(spark, d)
    for part in ("batch_id <= 6", "batch_id > 6"):
        _in_order(rows.filter(part), target, "row_id")
    return target


@query(STORED.format(where="true"))
def store_upsert(spark, d):
    return _stored(spark, d).read()


@query(f"SELECT * FROM ({STORED.format(where='true')}) WHERE source = 'staff_handbook_master.pdf'")
def store_by_source(spark, d):
    return _stored(spark, d).by_source("staff_handbook_master.pdf")


@query(f"SELECT * FROM ({STORED.format(where='true')}) WHERE vector_id = (SELECT min(vector_id) FROM chunks)")
def store_lookup(spark, d):
    return _stored(spark, d).get(table(spark, d, "chunks").agg(F.min("vector_id")).head()[0])


@query(f"SELECT * FROM ({STORED.format(where='true')}) WHERE source <> 'staff_handbook_master.pdf'")
def store_delete(spark, d):
    target = _stored(spark, d)
    target.delete_by_source("staff_handbook_master.pdf")
    return target.read()


@query(STORED.format(where="true"))
def stream_upsert(spark, d):
    """The chunk table read as a stream into a keyed table; late batches replace earlier rows."""
    schema = table(spark, d, "chunks").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/chunks.parquet*").withColumn("source", F.coalesce("source", F.lit("unknown")))
    seen = store.KeyedTable(spark, work_folder(spark, "stream-store"), store.CHUNKS + ", row_id long")

    def batch(rows: DataFrame, number: int) -> None:
        # files of one batch come in any order: rows compete by their own number, also with what is stored
        keys = rows.select("vector_id").distinct()
        both = rows.select(*seen.schema.names).unionByName(seen.read().join(keys, "vector_id", "left_semi"))
        _in_order(both, seen, "row_id")

    run = stream.writeStream.foreachBatch(batch).option("checkpointLocation", work_folder(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return seen.read().drop("row_id")


@query("""WITH last AS (SELECT vector_id, content, page, row_number() OVER (PARTITION BY vector_id ORDER BY row_id DESC) AS r FROM chunks)
SELECT e.emb_id, e.vector_id, l.content, l.page FROM embedded_chunks e LEFT JOIN last l ON l.vector_id = e.vector_id AND l.r = 1""")
def parent_child(spark, d):
    parents = store.last_of_each(table(spark, d, "chunks"), "vector_id", F.col("row_id")).select("vector_id", "content", "page")
    return table(spark, d, "embedded_chunks").select("emb_id", "vector_id").join(parents, "vector_id", "left").select("emb_id", "vector_id", "content", "page")


# ------------------------------------------------------------------ sources
@query(f"""SELECT doc_id, 1 AS page, 1 AS total_pages, {D.strip("coalesce(source, 'page')")} AS section_title, {D.tidy('text')} AS text
FROM documents WHERE text IS NOT NULL AND {D.tidy('text')} <> ''""")
def html_sections(spark, d):
    """Documents written as pages and read back: the heading is the title, the text is the one section."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title, body = escape(F.coalesce("source", F.lit("page"))), escape(F.col("text"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><nav>menu</nav><h1>"), title, F.lit("</h1><div><p>"), body, F.lit("</div></body></html>"))
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(html.html_sections(page, F.lit("stem"))).alias("s"))
    return rows.select("doc_id", "s.page", "s.total_pages", "s.section_title", "s.text")


@query("SELECT event_id, 1 AS page, 1 AS total_pages, 'k: ' || json_extract_string(props, '$.k') AS text FROM events")
def json_flatten(spark, d):
    rows = table(spark, d, "events").select("event_id", F.explode(json_docs.json_documents(F.col("props"))).alias("j"))
    return rows.select("event_id", "j.page", "j.total_pages", "j.text")


def _lines(c: str, keys: list[str]) -> str:
    """``key: value`` lines of a flat JSON object in the given order; truth values and absent keys give none."""
    made = [f"CASE WHEN json_type({c}, '$.{k}') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN '{k}: ' || json_extract_string({c}, '$.{k}') END" for k in keys]
    return f"array_to_string(list_filter([{', '.join(made)}], lambda x: x IS NOT NULL), chr(10))"


META_KEYS = ["source", "page", "file_type", "section_title", "chunk_index", "chunk_total", "word_count", "char_count"]


@query(f"""WITH j AS (SELECT row_id, metadata_json AS m FROM chunks WHERE metadata_json IS NOT NULL AND json_valid(metadata_json)), t AS (SELECT row_id, CASE WHEN json_type(m) = 'NULL' THEN 'None' ELSE {_lines("m", META_KEYS)} END AS text FROM j)
SELECT row_id, 1 AS page, 1 AS total_pages, text FROM t WHERE text <> ''""")
def json_metadata(spark, d):
    """The metadata of all chunks as text documents; broken JSON gives none."""
    rows = table(spark, d, "chunks").select("row_id", F.explode(json_docs.json_documents(F.col("metadata_json"))).alias("j"))
    return rows.select("row_id", "j.page", "j.total_pages", "j.text")


@query()
def embed_chunks(spark, d):
    """Every chunk with an embedding of the offline provider; the length and the first numbers are shown."""
    made = embed.embed_texts(table(spark, d, "chunks").select("row_id", "content"), "content", "vector", config=CONFIG)
    return made.select("row_id", F.size("vector").alias("dimension"), F.slice("vector", 1, 4).alias("head"))


@query("""SELECT c_custkey, k AS page, 3 AS total_pages, CASE k WHEN 1 THEN 'name: ' || c_name || chr(10) || 'home.nation: ' || c_nationkey || chr(10) || 'home.tags: ' || c_mktsegment || chr(10) || 'home.tags.deep: ' || c_custkey || chr(10) || 'blank: ' || chr(10) || 'end: x' ELSE c_mktsegment END AS text
FROM customer, (SELECT unnest([1, 3]) AS k)""")
def json_arrays(spark, d):
    """Lists of an object with objects and lists inside, a number and a text: the number is no document but keeps its place."""
    part = lambda before, c: F.concat(F.lit(before), F.col(c).cast("string"))
    text = F.concat(
        part('[{"id": 1, "name": "', "c_name"), part('", "home": {"nation": ', "c_nationkey"), part(', "url": "left out", "tags": ["', "c_mktsegment"), part('", "", 7, {"deep": ', "c_custkey"),
        part('}]}, "kept": true, "none": null, "blank": "", "end": "x"}, 5, "', "c_mktsegment"), F.lit('"]'),
    )
    rows = table(spark, d, "customer").select("c_custkey", F.explode(json_docs.json_documents(text)).alias("j"))
    return rows.select("c_custkey", "j.page", "j.total_pages", "j.text")


@query("""SELECT r_regionkey, 'nations' AS section_title, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) AS text
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def html_tables(spark, d):
    """The nations of each region as a table of a page, read back as Markdown; a bar in a cell is escaped."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = F.array_join(F.transform("n", lambda n: F.concat(F.lit("<tr><td>"), n["n_nationkey"].cast("string"), F.lit("</td><td> <b>"), n["n_name"], F.lit("|x</b></td></tr><tr></tr>"))), "")
    page = F.concat(F.lit("<body><h2>nations</h2><table><tr><th>key</th><th>name</th></tr>"), rows, F.lit("</table><footer>end</footer></body>"))
    made = nations.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.explode(html.html_sections(page, F.lit("stem"))).alias("s"))
    return made.select("r_regionkey", "s.section_title", "s.text")


@query("""WITH p AS (SELECT doc_id, n, substr(text, (n - 1) * 700 + 1, 700) AS t FROM (SELECT doc_id, text, unnest(range(1, (length(text) - 1) // 700 + 2)) AS n FROM documents WHERE text <> '')),
b AS (SELECT doc_id, n, regexp_replace(regexp_replace(t, '[^a-z]+', '', 'g'), '^', 'x') AS t FROM p WHERE t <> ''), s AS (SELECT doc_id, n, length(t) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, t FROM b)
SELECT doc_id, ((i - 1) // 4 + 1)::INTEGER AS page, string_agg(rpad(t, 700, 'y'), chr(10) || chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id, (i - 1) // 4""")
def docx_pages(spark, d):
    """Documents as Word files of paragraphs of 700 letters, read back: four fill a page of 3,000 characters."""
    from lectern.sources import docx

    @F.pandas_udf("array<struct<page:int,total_pages:int,text:string>>")
    def read(blocks):
        import io
        import zipfile

        import pandas as pd

        def one(paragraphs):
            out = io.BytesIO()
            body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            return [dict(zip(("page", "total_pages", "text"), x)) for x in docx.pages(out.getvalue(), CONFIG.docx_page_chars)]

        return pd.Series([one(b) for b in blocks])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 700).cast("int")), lambda n: F.substring(F.col("text"), n * 700 + 1, F.lit(700)))
    blocks = F.transform(parts, lambda x: F.rpad(F.concat(F.lit("x"), F.regexp_replace(x, "[^a-z]+", "")), 700, "y"))
    rows = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.explode(read(blocks)).alias("w"))
    return rows.select("doc_id", "w.page", "w.text")


EXTENSION = "lower(regexp_extract(source_path, '[.][^./]+$'))"


@query(f"""SELECT file_id, CASE WHEN {EXTENSION} = '.pdf' THEN 'pdf' WHEN {EXTENSION} = '.docx' THEN 'docx' WHEN {EXTENSION} IN ('.html', '.htm') THEN 'html' WHEN {EXTENSION} = '.json' THEN 'json'
WHEN {EXTENSION} IN ('.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp', '.gif') THEN 'image' END AS kind,
regexp_matches(lower(source_path || CASE WHEN file_id % 3 = 0 THEN '.part' ELSE '' END), '(^|/)[.][^/]*$|[.](tmp|part|crdownload|download)$') AS unfinished FROM source_files""")
def file_kinds(spark, d):
    """The kind of every source file by its path, and whether it, or a copy on its way, is unfinished."""
    path = F.concat("source_path", F.when(F.col("file_id") % 3 == 0, ".part").otherwise(""))
    return table(spark, d, "source_files").select("file_id", files.file_kind(F.col("source_path")).alias("kind"), files.unfinished(path).alias("unfinished"))


@query("""SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.html' ELSE '.json' END AS source, 1 AS page, 1 AS total_pages, CASE WHEN n_nationkey % 2 = 0 THEN 'html' ELSE 'json' END AS file_type,
CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'name: ' || n_name END AS page_content, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey END AS section_title FROM nation""")
def load_folder(spark, d):
    """A folder with a file for every nation and two that are no sources, loaded."""
    folder = _written(spark, d, "load-folder")
    out = files.load(spark, folder)
    return out.select("source", "page", "total_pages", "file_type", "page_content", "section_title")


@query("""SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.html' ELSE '.json' END AS source, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'name: ' || n_name END AS page_content FROM nation
UNION ALL SELECT 'broken.json', NULL""")
def landing_folder(spark, d):
    """The same folder as a landing zone that is emptied once: documents, and the dead letter of a broken file."""
    folder, out = _written(spark, d, "landing", {"broken.json": "{", "later.html.part": "no"}), work_folder(spark, "landed")

    def ingest(arrived: DataFrame) -> DataFrame:
        found = files.parse_files(arrived.select("path", "content"))
        found.filter("error is null").select("source", "page_content").write.mode("append").parquet(out)
        return found.filter("error is not null").select("source_path", "file_type", "error")

    dead = work_folder(spark, "dead-letters")
    LandingZone(spark, folder, ingest, work_folder(spark, "landing-checkpoint"), dead).start(available_now=True).awaitTermination()
    letters = spark.read.schema("source_path string, file_type string, error string").parquet(dead)
    return spark.read.schema("source string, page_content string").parquet(out).unionByName(letters.select(F.regexp_extract("source_path", "[^/]+$", 0).alias("source"), F.lit(None).cast("string").alias("page_content")))


def _written(spark, d, label: str, more: dict[str, str] | None = None) -> str:
    """A folder of files, one for each of the nations, whose number is fixed."""
    folder = work_folder(spark, label)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    made = {"readme.txt": "no source", "data.csv": "a,b"} | (more or {})
    for row in table(spark, d, "nation").collect():
        n, name = row["n_nationkey"], row["n_name"]
        made |= {f"n{n}.html": f"<body>{name}</body>"} if n % 2 == 0 else {f"n{n}.json": f'{{"name": "{name}", "id": {n}}}'}
    for name, text in made.items():
        out = fs.create(path(f"{folder}/{name}"))
        out.writeBytes(text)
        out.close()
    return folder


# ------------------------------------------------------------------ personal data on built texts, gates, sentences, groups
BUILT = """'No. ' || lpad(c_custkey::VARCHAR, 5, '0') || '-' || lpad((c_custkey * 7)::VARCHAR, 7, '0') || '-' || c_custkey % 10 || ', PK36SCBL' || lpad(c_custkey::VARCHAR, 16, '0') || ', DOB: ' || c_custkey % 28 + 1 || '/0' || c_custkey % 9 + 1 || '/19' || 50 + c_custkey % 49 || ', card 4000-1234-5678-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ', 0300-' || lpad(c_custkey::VARCHAR, 7, '1')"""


def _built(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    pad = lambda c, n, fill="0": F.lpad(c.cast("string"), n, fill)
    text = F.concat(
        F.lit("No. "), pad(key, 5), F.lit("-"), pad(key * 7, 7), F.lit("-"), (key % 10).cast("string"), F.lit(", PK36SCBL"), pad(key, 16), F.lit(", DOB: "), (key % 28 + 1).cast("string"), F.lit("/0"), (key % 9 + 1).cast("string"),
        F.lit("/19"), (key % 49 + 50).cast("string"), F.lit(", card 4000-1234-5678-"), pad(key % 10000, 4), F.lit(", 0300-"), pad(key, 7, "1"),
    )
    return table(spark, d, "customer").select("c_custkey", text.alias("page_content"))


@query(f"{D.redacted(f'SELECT c_custkey AS id, {BUILT} AS t FROM customer', pii.PATTERNS)} SELECT id AS c_custkey, t AS page_content, pii_count, pii_entities FROM redacted")
def pii_numbers(spark, d):
    """Identity cards, account numbers, dates of birth, cards and mobile numbers in built texts."""
    return pii.redact(_built(spark, d)).select("c_custkey", "page_content", "pii_count", F.array_join("pii_entities", ",").alias("pii_entities"))


@query(f"{D.redacted(f'SELECT c_custkey AS id, {BUILT} AS t FROM customer', [p for p in pii.PATTERNS if p[0] in ('IBAN', 'DATE_OF_BIRTH')])} SELECT id AS c_custkey, t AS page_content, pii_count FROM redacted")
def pii_whitelist(spark, d):
    """The same with only two of the kinds wanted."""
    return pii.redact(_built(spark, d), types=("DATE_OF_BIRTH", "IBAN")).select("c_custkey", "page_content", "pii_count")


@query(f"""WITH c AS (SELECT doc_id, {D.clean('text')} AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, t FROM c WHERE t <> '')
SELECT doc_id, true AS within_limit, true AS numbered, true AS begins, true AS ends, true AS parts, true AS covers, CASE WHEN length(t) <= 512 THEN t END AS whole FROM k""")
def chunk_promises(spark, d):
    """What recursive chunks promise of every cleaned text: each of at most 512 characters, numbered from 0, the first one begins
    and the last one ends it, each is a part of it, together they are no shorter, and a short text is one chunk."""
    rows = _documents(spark, d).withColumn("clean", T.clean_for_chunking("page_content"))
    made = chunk.recursive_chunks(rows).groupBy("doc_id").agg(F.first("clean").alias("t"), F.max("chunk_total").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "page_content"))).alias("c"))
    texts, solid = F.col("c.page_content"), lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    return made.select(
        "doc_id", (F.array_max(F.transform(texts, F.length)) <= 512).alias("within_limit"), (F.transform("c", lambda x: x["chunk_index"]) == F.sequence(F.lit(0), F.col("n") - 1)).alias("numbered"),
        F.startswith("t", F.element_at(texts, 1)).alias("begins"), F.endswith("t", F.element_at(texts, -1)).alias("ends"), F.forall(texts, lambda x: F.contains(F.col("t"), x)).alias("parts"),
        (F.aggregate(texts, F.lit(0), lambda a, x: a + solid(x)) >= solid(F.col("t"))).alias("covers"), F.when(F.length("t") <= 512, F.element_at(texts, 1)).alias("whole"),
    )


_SHORT = "|".join(a.replace(".", "[.]") for a in chunk.ABBREVIATIONS)
_MARKED = rf"regexp_replace({D.strip('text')}, '\b({_SHORT})[.]([{D.SPACE}])', '\1' || chr(2) || '\2', 'g')"
SENTENCES = rf"list_transform(list_filter(string_split(regexp_replace({_MARKED}, '([.!?])[{D.SPACE}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: replace(x, chr(2), '.'))"


@query(f"SELECT doc_id, {SENTENCES} AS sentences FROM documents WHERE {D.strip('text')} <> ''")
def sentence_split(spark, d):
    split = F.pandas_udf(lambda s: s.map(chunk.sentences), "array<string>")
    rows = table(spark, d, "documents").filter(T.strip("text") != "")
    return rows.select("doc_id", split("text").alias("sentences"))


@query("""WITH RECURSIVE s AS (SELECT vec_id // 40 AS g, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) AS i, vec_id,
  list_cosine_similarity(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY vec_id // 40 ORDER BY vec_id)::DOUBLE[]) AS v FROM embeddings), n AS (SELECT g, count(*) AS n FROM s GROUP BY g),
w AS (SELECT g, i, CASE WHEN (v < 0.1 AND 1 >= 2) OR 1 >= 15 THEN 0 ELSE 1 END AS c, false AS cut FROM s WHERE i = 1 AND v IS NOT NULL
  UNION ALL SELECT s.g, s.i, CASE WHEN (v < 0.1 AND w.c + 1 >= 2) OR w.c + 1 >= 15 THEN 0 ELSE w.c + 1 END, (v < 0.1 AND w.c + 1 >= 2) OR w.c + 1 >= 15 FROM w JOIN s ON s.g = w.g AND s.i = w.i + 1 WHERE v IS NOT NULL),
b AS (SELECT w.g, w.i FROM w JOIN n USING (g) WHERE w.cut AND NOT (n.n - w.i < 2 AND w.i = (SELECT max(x.i) FROM w x WHERE x.g = w.g AND x.cut))),
m AS (SELECT s.g, s.i, 's' || s.vec_id AS t, (SELECT count(*) FROM b WHERE b.g = s.g AND b.i < s.i) AS part FROM s)
SELECT g AS sequence, part::INTEGER AS chunk_index, string_agg(t, ' ' ORDER BY i) AS text FROM m GROUP BY g, part""")
def semantic_groups(spark, d):
    """Sentences grouped between break points; a tail of one joins the group before it."""
    group = F.floor(F.col("vec_id") / 40).cast("long")
    rows = table(spark, d, "embeddings").groupBy(group.alias("sequence")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    names = F.transform("s", lambda x: F.concat(F.lit("s"), x["vec_id"].cast("string")))
    made = chunk.grouped(names, chunk.breakpoints(chunk.adjacent_similarities(F.col("s.embedding")), BREAKS), BREAKS.min_sentences)
    return rows.select("sequence", F.posexplode(made).alias("chunk_index", "text"))


@query(f"SELECT row_id, CASE WHEN content IS NOT NULL THEN 768 END AS dimension, CASE WHEN content IS NOT NULL THEN CASE WHEN {D.strip('content')} = '' THEN 0.0 ELSE 1.0 END END AS size, true AS same FROM chunks")
def embed_promises(spark, d):
    """Every text has a vector of the right length and of unit size, equal for the question of the same text; null has none."""
    rows = table(spark, d, "chunks").select("row_id", "content")
    made = embed.embed_texts(embed.embed_texts(rows, "content", "vector", config=CONFIG), "content", "again", config=CONFIG)
    size = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3)
    return made.select("row_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimension"), F.coalesce(size, F.when(F.col("vector").isNotNull(), F.lit(0.0))).alias("size"), F.col("vector").eqNullSafe(F.col("again")).alias("same"))


@query("SELECT row_id, coalesce(content, '') AS text, coalesce(source, 'unknown') AS source, coalesce(page, 0) AS page, 0 AS chunk_index FROM chunks")
def payload_defaults(spark, d):
    out = search.with_payload(table(spark, d, "chunks").select("row_id", F.col("content").alias("text"), "source", "page"))
    return out.select("row_id", "text", "source", "page", "chunk_index")


@query(f"SELECT doc_id, CASE WHEN len({MATCHES}) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, substr(text, 1, 80) AS answer, replace(substr(text, 1, 200), chr(10), ' ') AS preview FROM documents d JOIN eval_cases e ON e.case_id = d.doc_id % 40 + 1")
def eval_report(spark, d):
    """The line of each case, and its text as a debug preview."""
    made = evaluate.keyword_matches(_answers(spark, d))
    report = evaluate.case_report(made.withColumn("question", F.col("doc_id").cast("string"))).select(F.col("question").cast("long").alias("doc_id"), "status", "answer")
    return report.join(evaluate.preview(made.withColumn("text", F.col("answer"))).select("doc_id", "preview"), "doc_id")


@query("""SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'Nothing else. ' || question || ' [1]' ELSE 'I don''t have enough information to answer that.' END AS answer, 'extractive' AS model FROM eval_cases""".replace("'Nothing else. ' || question", "question"))
def generated_answers(spark, d):
    """Answers of the offline generator: half of the contexts hold the question's words, the others hold nothing."""
    body = F.when(F.col("case_id") % 2 == 0, F.concat(F.lit("[1] (Source: a.pdf, Page 1)\n"), "question")).otherwise(F.lit("[1] (Source: a.pdf, Page 1)\n---"))
    asked = table(spark, d, "eval_cases").withColumn("prompt", F.concat(F.lit("x\n\nContext:\n"), body, F.lit("\n\nQuestion: "), "question", F.lit("\n\nAnswer:")))
    return answer.generate(asked).select("case_id", "answer", "model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
