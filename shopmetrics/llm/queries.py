"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm.bpe import decoded, encoded
from shopmetrics.llm.common import ship, table
from shopmetrics.llm.decontamination import contaminated
from shopmetrics.llm.fuzzy_lines import fuzzy_lines
from shopmetrics.llm.licenses import license_names
from shopmetrics.llm.mixing import mixed
from shopmetrics.llm.multi_index import nearest
from shopmetrics.llm.near_duplicates import near_duplicates
from shopmetrics.llm.quality import quality
from shopmetrics.llm.ranked_search import read_index, search, write_index
from shopmetrics.llm.spelling import Spelling, variants
from shopmetrics.llm.token_shards import Layout, materialise
from shopmetrics.llm.toxicity import toxicity
from shopmetrics.llm.warc import read_archives, write_archives


#: A vocabulary of many languages; the same path on all machines.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), Layout(TOKENIZER))[0]


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_names(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(*write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is a document's host, its language the path in it."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), spelling=Spelling(drops=199))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read_index(spark, write_index(table(spark, sf_dir, "documents")))
    return search(index, table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = decoded(encoded(table(spark, sf_dir, "documents"), BYTE_BPE), BYTE_BPE)
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    build.__name__: _query(build)
    for build in (
        op1_token_shards, op2_license_scan, op3_toxicity, op4_fuzzy_lines, op5_near_duplicates, op6_multi_index,
        op7_source_mix, op8_warc, op9_decontamination, op10_quality, op11_spelling_variants, op12_ranked_search,
        op13_byte_bpe,
    )
}

ORACLE: dict[str, str] = {
    "op8_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ),
        holders AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
                      ELSE page_id END AS holder
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN holder IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to
        FROM holders
    """,
    "op12_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM documents
        ),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM benchmark
        ),
        wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, corpus GROUP BY term, docs
        ),
        impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total)))) AS impact
            FROM postings JOIN lengths USING (doc_id) JOIN weights USING (term), corpus
        ),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
            FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id
        ),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
