"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import (
    centroids,
    exact,
    langid,
    maxent,
    mixing,
    pieces,
    private,
    ranked,
    simhash,
    tokens,
    topk,
    toxicity,
    urls,
)
from ledgerspark.llm.common import read
from ledgerspark.session import configure

COUNTER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.assign(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    times = F.size("_mix.shards")
    return mixed.select(
        "doc_id",
        "_mix.size",
        "_mix.source_size",
        "_mix.target",
        (F.col("_mix.size") * times).alias("taken"),
        F.col("_mix.shards").alias("shards"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(COUNTER))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op6_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(read(spark, sf_dir, "documents")).drop("text_key")


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_digests(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.col("_tox.low_quality").alias("p_low_quality"),
        F.col("_tox.toxic").alias("p_toxic"),
        F.col("_tox.rejected").alias("toxic"),
    )


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _configured(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(configure(spark), sf_dir)

    run.__name__ = make.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _configured(f)
    for f in (
        op1_mix_sources,
        op2_token_counts,
        op3_sentencepiece,
        op4_lm_scores,
        op5_url_filter,
        op6_exact_copies,
        op7_private_data,
        op8_toxicity,
        op9_simhash_groups,
        op10_top_vectors,
        op11_ranked_search,
        op12_languages,
        op13_centroids,
        pipeline,
    )
}


def _centroids_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and update written out one after the other."""

    def nearest(step: int) -> str:
        return f"""
        near{step} AS (
            SELECT vec_id, e, arg_min(c, (d, c)) AS c, min(d) AS d, row_id FROM (
                SELECT row_id, vec_id, e, c,
                    CAST(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
                FROM kept, mid{step}) GROUP BY row_id, vec_id, e)"""

    steps = [nearest(0)]
    for step in range(1, rounds + 1):
        before = step - 1
        steps.append(f"""
        mid{step} AS (
            SELECT m.c, coalesce(u.m, m.m) AS m FROM mid{before} m LEFT JOIN (
                SELECT c, list(v ORDER BY i) AS m FROM (
                    SELECT c, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS v
                    FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM near{before}) GROUP BY c, i)
                GROUP BY c) u ON m.c = u.c)""")
        steps.append(nearest(step))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, vec_id,
                list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        mid0 AS (
            SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS c, e AS m FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), e) <= {clusters}),{",".join(steps)}
        SELECT n.vec_id, n.c AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
        FROM near{rounds} n JOIN mid{rounds} m ON n.c = m.c
    """


ORACLE: dict[str, str] = {
    "op5_url_filter": r"""
        WITH cut AS (
            SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw_host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        named AS (
            SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM cut),
        rules(verdict, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fitting AS (
            SELECT n.page_id, rule_host || rule_path AS rule, r.verdict,
                row_number() OVER (PARTITION BY n.page_id ORDER BY length(rule_host || rule_path) DESC) AS place
            FROM named n JOIN rules r
                ON (n.host = rule_host OR ends_with(n.host, '.' || rule_host)) AND starts_with(n.path, rule_path))
        SELECT n.page_id, n.host, n.path, f.rule,
            coalesce(f.verdict, CASE WHEN regexp_matches(n.host, 'spam|casino|porn|xxx|adult|warez|viagra')
                THEN 'block' ELSE 'allow' END) AS verdict,
            regexp_matches(n.host, 'spam|casino|porn|xxx|adult|warez|viagra') AS listed
        FROM named n LEFT JOIN fitting f ON n.page_id = f.page_id AND f.place = 1
    """,
    "op6_exact_copies": r"""
        WITH bare AS (
            SELECT doc_id, coalesce(text, '') AS whole,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents),
        ranked AS (
            SELECT doc_id, t, row_number() OVER w AS place, first(doc_id) OVER w AS keep_id,
                count(*) OVER (PARTITION BY t) AS group_size
            FROM bare WINDOW w AS (PARTITION BY t ORDER BY length(whole) DESC, doc_id))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
    """,
    "op10_top_vectors": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM pairs WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    "op11_ranked_search": r"""
        WITH found AS (
            SELECT row_number() OVER () AS place, doc_id,
                regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
        terms AS (
            SELECT place, doc_id, len(terms) AS n,
                translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM found WHERE len(terms) > 0),
        totals AS (SELECT count(DISTINCT place) AS docs, count(*) AS length FROM terms),
        occurring AS (SELECT place, doc_id, n, term, count(*) AS tf FROM terms GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM occurring, totals GROUP BY term, docs),
        asked AS (
            SELECT DISTINCT item_id, term FROM (
                SELECT item_id, translate(unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
                FROM benchmark)),
        scored AS (
            SELECT a.item_id, o.place, o.doc_id,
                CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
            FROM asked a JOIN occurring o ON a.term = o.term JOIN weights w ON a.term = w.term, totals
            GROUP BY a.item_id, o.place, o.doc_id)
        SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op13_centroids": _centroids_sql(),
}
