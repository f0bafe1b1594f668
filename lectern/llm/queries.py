"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boundary_split, encode, history_dedup, knn, mixing, ngram_join, ocr_repair, pii_spans, quality_rules, stuffing
from lectern.session import stage, table

#: Likeness of the test tables: three words, 0.7 or more, at least twenty words (TESTDATA.md).
LIKENESS = {"width": 3, "threshold": 0.7, "min_words": 20}


def _words(spark: SparkSession, d: str, name: str) -> list[str]:
    """One of the fixed word lists (about 250 words in all)."""
    rows = table(spark, d, "word_lists").filter(F.col("list_name") == name).select(F.lower("word").alias("word")).distinct().collect()
    return sorted(r["word"] for r in rows if r["word"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that repeat, exactly or nearly, content accepted from an earlier batch or row."""
    cases = history_dedup.repeated_rows(table(spark, d, "chunks"), "batch_id", "row_id", "content", **LIKENESS)
    return cases.select(F.col("row").alias("row_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The strongest kind of boundary that is sufficient for each oversized page."""
    pieces = p2_pieces(spark, d)
    return pieces.filter("chunk_index = 0 and boundary is not null").select("rec_id", "boundary")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all pages."""
    return boundary_split.split_at_boundaries(table(spark, d, "loaded_pages"), "rec_id", "page_content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of embedded chunks with cosine 0.9 or more where one is among the other's five most similar."""
    near, classes = knn.most_similar(table(spark, d, "embedded_chunks"), "emb_id", "vector", k=5, dim=64, least=0.9)
    return knn.similar_row_pairs(near, classes, k=5, least=0.9)


def _free_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "loaded_pages").select(F.lit("loaded_pages").alias("tab"), F.col("rec_id").alias("item"), F.col("page_content").alias("text"))
    return pages.unionByName(table(spark, d, "chunks").select(F.lit("chunks").alias("tab"), F.col("row_id").alias("item"), F.col("content").alias("text")))


def _given_names(spark: SparkSession, d: str) -> list[str]:
    return [w.title() for w in _words(spark, d, "given_name")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in pages and chunks."""
    found = pii_spans.find(_free_text(spark, d), _given_names(spark, d))
    return found.select("tab", F.col("item").alias("item_id"), "kind", F.col("start").alias("start_pos"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Pages and chunks with typed placeholders for personal data."""
    texts = _free_text(spark, d)
    return pii_spans.redacted(texts, pii_spans.find(texts, _given_names(spark, d)))


def _judged_pages(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "review_labels").filter("tab = 'loaded_pages'")
    pages = table(spark, d, "loaded_pages").select("rec_id", "page_content", "metadata")
    return quality_rules.classify(pages, "rec_id", "page_content", labels, _words(spark, d, "common"))[0].drop("page_content")


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page's metadata with its text statistics and kind."""
    return quality_rules.as_metadata(_judged_pages(spark, d)).select("rec_id", "metadata", "kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages most of whose text is not prose."""
    return _judged_pages(spark, d).filter("kind <> 'prose'").select("rec_id", "kind")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Faulty lines of scanned pages."""
    return ocr_repair.faults(table(spark, d, "loaded_pages"), "rec_id", "page_content", F.expr("metadata['ocr_lang'] is not null"))


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    """Repaired text of scanned pages."""
    return ocr_repair.repaired(table(spark, d, "loaded_pages"), "rec_id", "page_content", F.expr("metadata['ocr_lang'] is not null"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate chunks, copies included."""
    pairs, classes = ngram_join.similar_pairs(table(spark, d, "chunks"), "row_id", "content", **LIKENESS)
    return ngram_join.row_pairs(pairs, classes)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sizes = stage(mixing.distinct_texts(table(spark, d, "documents"), targets, "doc_id", "text", "source"), "mix-sizes")
    plan = mixing.plan_mix(sizes, targets)
    return mixing.training_order(sizes, plan), plan


def p9_order(spark: SparkSession, d: str) -> DataFrame:
    """Training order of the mixed corpus."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target weights and the shares reached."""
    return mixing.shares(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents written for search engines rather than readers."""
    return stuffing.stuffed_pages(table(spark, d, "documents"), "doc_id", "text", _words(spark, d, "common")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


#: Distinct runs of three words of every chunk of at least twenty words.
_SHINGLES = r"""w AS (SELECT row_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS l FROM chunks WHERE content IS NOT NULL),
s AS (SELECT row_id, list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS s FROM w WHERE len(l) >= 20),
t AS (SELECT row_id, len(s) AS n, unnest(s) AS g FROM s)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can say over whole tables; the others are held against brute force in the tests."""
    gap = r"[ \t\r\n]"
    trimmed = rf"regexp_replace(page_content, '^{gap}+|{gap}+$', '', 'g')"
    # no lookbehind: white space after a mark that ends a sentence becomes a line break
    sentences = rf"regexp_replace(t, '([.!?]){gap}+', '\1' || chr(10), 'g')"

    def fits(text: str, pattern: str) -> str:
        return rf"list_max(list_transform(regexp_split_to_array({text}, '{pattern}'), lambda x: length(regexp_replace(x, '^{gap}+|{gap}+$', '', 'g')))) <= 512"

    two, one = rf"[ \t\r]*\n[ \t\r]*\n{gap}*", rf"[ \t\r]*\n{gap}*"
    return {
        "p2_found": rf"""SELECT rec_id, CASE WHEN {fits("t", two)} THEN 'paragraph' WHEN {fits("t", one)} THEN 'line' WHEN {fits(sentences, one)} THEN 'sentence'
WHEN {fits("t", gap + "+")} THEN 'word' ELSE 'none' END AS boundary FROM (SELECT rec_id, {trimmed} AS t FROM loaded_pages) WHERE length(t) > 512""",
        "p3_found": """WITH v AS (SELECT emb_id, vector::DOUBLE[] AS v FROM embedded_chunks WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
p AS (SELECT a.emb_id AS a, b.emb_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.emb_id <> b.emb_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS emb_a, greatest(a, b) AS emb_b FROM r WHERE k <= 5 AND c >= 0.9""",
        "p7_found": f"""WITH {_SHINGLES}, o AS (SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT row_a, row_b FROM o WHERE n_both >= 0.7 * (na + nb - n_both) - 1e-9""",
    }
