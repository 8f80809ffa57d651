"""The thin queries over the driver's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import quality, toxicity
from .bands import judge_documents
from .bpe import count_tokens, encode_digests
from .embeddings import near_duplicates
from .fingerprints import compare_edits
from .jaccard import join_components
from .lm import score_documents
from .mixing import mix_sources
from .search import search
from .sharding import shard_rows
from .variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_bpe, op3_jaccard, op4_token_counts, op5_quality, op6_embeddings, op7_sharding, op8_lm, op9_toxicity, op10_mixing, op11_search, op12_variants, op13_bands)
}


def _components(links: str) -> str:
    """The smallest node reachable from each node, as two further parts of a recursive WITH; links: a part with a, b both ways."""
    return f"reach AS (SELECT a AS node, b AS other FROM {links} UNION SELECT r.node, l.b FROM reach r JOIN {links} l ON r.other = l.a), lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node)"


ORACLES: dict[str, str] = {
    "op3_jaccard": rf"""
        WITH RECURSIVE spelled AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM spelled
        ), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
        ), links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
        ), {_components("links")}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN lowest ON node = doc_id""",
    "op6_embeddings": f"""
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95
        ), degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a
        ), {_components("links")}
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
        FROM embeddings LEFT JOIN degrees ON a = vec_id LEFT JOIN lowest ON node = vec_id""",
    "op11_search": r"""
        WITH terms AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2
        ), whole AS (SELECT count(*) AS docs, sum(len(t)) AS length FROM terms WHERE len(t) > 0
        ), tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM terms) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ), w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
        ), scores AS (
            SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (CAST(75 * n * docs AS BIGINT) // CAST(length AS BIGINT)))))) AS BIGINT) AS score FROM tf JOIN w USING (term) JOIN times USING (term), whole GROUP BY 1, 2, 3
        )
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
    "op12_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT id, run, count(*) AS times FROM (
                SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
            ) WHERE length(run) >= 5 GROUP BY 1, 2
        ), spelled AS (SELECT run, times, hex(encode(id || ':' || run)) AS x FROM runs
        ), hashed AS (
            SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda k: CAST('0x' || x[k:k + 1] AS BIGINT))), lambda c, b:
                list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295::BIGINT) AS h FROM spelled
        ), words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
        ), v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
        ), d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
        ), pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
            UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
        ), forms AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)
        ), walk AS (SELECT word, word AS stop, 0 AS step FROM forms UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON walk.stop = f.word AND f.form IS NOT NULL
        )
        SELECT word, form, arg_max(stop, step) AS root, n, n_near, form_n FROM walk JOIN forms USING (word) GROUP BY word, form, n, n_near, form_n""",
}
