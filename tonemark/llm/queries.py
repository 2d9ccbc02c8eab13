"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.llm import (
    byte_repeats,
    disclosure,
    exact_dedup,
    latent_retrieval,
    lexical_search,
    lsh_forest,
    neighbour_quality,
    output_codes,
    packing,
    sentence_spans,
    token_files,
    url_rules,
    whitening,
)
from tonemark.llm.common import table
from tonemark.sources.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_token_blocks")
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-blocks")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


@query("op2_byte_repeats")
def op2_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.clean(table(spark, sf_dir, "documents"), with_bytes=False)


@query("op3_sentence_spans")
def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.clean(table(spark, sf_dir, "documents"), with_text=False)


@query("op4_url_rules")
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op5_neighbour_quality")
def op5_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op8_lsh_forest")
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.join(table(spark, sf_dir, "documents")).select("doc_id", "copy_of", "class_id", "n_links")


@query("op9_output_codes")
def op9_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_codes.predict(table(spark, sf_dir, "documents"))


@query("op10_latent_retrieval")
def op10_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latent_retrieval.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    columns = (F.round(c, 6).alias(c) for c in ("cosine", "common", "answer"))
    return found.select("doc_id", "item_id", *columns, "short")


@query("op11_disclosure")
def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.clean(table(spark, sf_dir, "documents"), with_text=False)


@query("op12_spectrum_whitening")
def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.rows(table(spark, sf_dir, "embeddings"))


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


@query(
    "op13_lexical_search",
    f"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM}) AS terms
        FROM documents
    ),
    known AS (SELECT r, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
    size AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM known),
    counted AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM known) GROUP BY r, term
    ),
    items AS (
        SELECT row_number() OVER () AS k, item_id,
               list_distinct(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM})) AS terms
        FROM benchmark
    ),
    wanted AS (SELECT k, item_id, unnest(terms) AS term FROM items),
    weights AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM counted, size
        WHERE term IN (SELECT term FROM wanted)
        GROUP BY term, n_docs
    ),
    scored AS (
        SELECT k, item_id, r, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM wanted JOIN counted USING (term) JOIN weights USING (term) JOIN known USING (r), size
        GROUP BY k, item_id, r, doc_id
    ),
    ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
               doc_id, score
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
