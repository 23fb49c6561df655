"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup, jaccard_join, lexical_search, licenses, line_crf, mixing, nn_descent, packing, pii, runs, token_counts, token_files, warc
from marginalia.llm.shared import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(read(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_crf.scores(docs, line_crf.fit_on(docs, read(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: source, weight of its source, copies. No source is passed over more than twice, none less than once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mixing_plan(docs, repetition_limit=2.0)
    return mixing.with_copies(docs.drop("text"), plan).selectExpr("doc_id", "source", "_mix_weight AS weight", "_mix_copies AS copies")


def op11_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_digest(runs.with_planted_runs(read(spark, sf_dir, "documents")), least=12)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [
        op1_warc_index, op2_token_counts, op3_exact_dedup, op4_jaccard_join, op5_bootstrapped_pii, op6_nn_descent, op7_token_files, op8_line_crf_quality, op9_best_fit_packing,
        op10_temperature_mixing, op11_baier_runs, op12_lexical_search, op13_license_scan,
    ]
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_SEARCH_SQL = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS terms FROM documents),
    t AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
    q AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
    wanted AS (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY ALL),
    total AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS terms FROM d),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    df AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
    s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
          FROM wanted JOIN tf USING (term) JOIN df USING (term), total GROUP BY item_id, doc_id),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10"""


def _license_sql() -> str:
    notices = []
    for k, (label, text) in enumerate(licenses.NOTICES):
        words = text.split()
        own = sorted(set(words))
        notices += [f"({k}, '{label}', {len(words)}, {licenses.step_of(len(words))}, {len(own)}, '{w}')" for w in own]
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES)
    return f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    w AS (SELECT doc_id, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS word FROM d),
    p AS (SELECT string_split(c.phrase, ' ') AS phrase, c.label FROM (VALUES {phrases}) c(phrase, label)),
    base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
             FROM w JOIN p ON w.word = p.phrase[1] JOIN d USING (doc_id) WHERE d.words[i + 1 : i + len(p.phrase)] = p.phrase GROUP BY doc_id),
    n AS (SELECT * FROM (VALUES {", ".join(notices)}) v(notice, label, width, step, size, word)),
    hits AS (SELECT doc_id, notice, label, size, word, unnest(range(CASE WHEN i > width THEN (i - width) // step ELSE 0 END, i // step + 1)) AS block FROM w JOIN n USING (word)),
    blocks AS (SELECT doc_id, label, count(DISTINCT word) / size AS containment FROM hits GROUP BY doc_id, notice, label, size, block
               HAVING count(DISTINCT word) >= ceil({licenses.CONTAINMENT} * size - 1e-9)),
    own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS containment FROM blocks GROUP BY doc_id)
    SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(own.containment, 0) END::DOUBLE AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_lexical_search": _SEARCH_SQL,
        "op13_license_scan": _license_sql(),
        "op3_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.text) AS text_sha256
            FROM d JOIN g ON d.text = g.text""",
    }
