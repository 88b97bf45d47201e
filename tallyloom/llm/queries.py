"""Queries over the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, kmeans, labelled, lines, mixing, near_dedup, packing, quality, sentencepieces, topk, toxicity, urls, warc, whitening
from .common import crc32_mod, stage, table

TOKENIZERS = os.environ.get("TALLYLOOM_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("at").alias("line_no"), F.col("first_doc").alias("first_doc_id"),
        F.col("first_at").alias("first_line_no"), F.expr(lines.KEPT).alias("kept"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled.sample(docs, labels, "toxic", crc32_mod("doc_id", 5) != 0, max_rows=8000, max_chars=20_000)
    classifier = toxicity.train(rows["text"], rows["label"].to_numpy())
    scored = toxicity.score(docs.select("doc_id", "text"), classifier)
    return scored.select(
        "doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality_network(docs, labels))
    return scored.select(
        "doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def quality_network(docs: DataFrame, labels: DataFrame) -> quality.Network:
    rows = labelled.sample(docs, labels, "quality", crc32_mod("doc_id", 4) != 2, max_rows=3000, max_chars=6000)
    return quality.train(rows["text"], rows["label"].to_numpy())


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sentencepieces.encode(docs, PIECES, verify="round_trip", keep=["doc_id"])
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "round_trip", "ids")


# Domains, and weights of domains and languages in the mix; sources weigh alike.
MIX = mixing.Mix(
    levels=["domain", "lang", "source"],
    weights={("web",): 4.0, ("books",): 3.0, ("forums",): 2.0, ("code",): 1.0}
    | {(d, lang): w for d in ("web", "books", "forums", "code") for lang, w in (("en", 6.0), ("de", 2.0), ("fr", 1.5), ("es", 1.0))},
    max_epochs=3,
    seed=11,
)


def domain(docs: DataFrame) -> DataFrame:
    """``docs`` with a domain for each source, by its number."""
    number = F.try_to_number(F.regexp_extract("source", r"(\d{1,9})$", 1), F.lit("999999999")).cast("int") % 4
    names = F.array(*(F.lit(x) for x in ("web", "books", "forums", "code")))
    return docs.withColumn("domain", F.get(names, number))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = domain(table(spark, sf_dir, "documents"))
    return mixing.select(docs, MIX, share=0.6).select("doc_id", "domain", "lang", "source", "copies")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


# For op7: pages whose id this picks lose their last character in the replica.
ROTTEN = "crc32(cast(page_id as string)) % 211 = 0"


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rotten = F.expr(f"if({ROTTEN}, concat(substring(html, 1, length(html) - 1), '#'), html)")
    original, replica = (stage(warc.layout(warc.records(p)), "layout") for p in (pages, pages.withColumn("html", rotten)))
    return warc.audit(original, replica)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=8192)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_pages(table(spark, sf_dir, "pages"), urls.rules(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.report(kmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10), spark)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def _rounds_sql(rounds: int) -> str:
    """Lloyd's rounds, one after the other: c0 the first centroids, a0 their clusters, c1 the next ones and so on."""
    parts = []
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
            SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT v.row, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{t} m)
            GROUP BY row)""")
        if t < rounds:
            parts.append(f"""s{t} AS (
                SELECT c, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS e, unnest(range(len(v.x))) AS i FROM a{t} a JOIN v USING (row)) GROUP BY c, i)""")
            parts.append(f"""c{t + 1} AS MATERIALIZED (
                SELECT c.c, coalesce(n.x, c.x) AS x FROM c{t} c LEFT JOIN (
                    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{t} GROUP BY c) n USING (c))""")
    return ", ".join(parts)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_source_mixing": op5_source_mixing,
    "op6_imatch_fingerprints": op6_imatch_fingerprints,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_token_packing": op9_token_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    # The rules alone: no page of the given tables links to another as its canonical url, and the tests hold what links do against brute force.
    "op11_url_filters": """
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
        FROM (SELECT *, row_number() OVER () AS row FROM u) LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY row, page_id, host, path""",
    "op12_centroid_clustering": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (
            SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 8)),
        {_rounds_sql(10)},
        t AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY c)
        SELECT vec_id, a.c AS cluster, a.d AS distance, t.cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a10) AS inertia,
               sha256(array_to_string(m.x, ',')) AS centroid_sha256
        FROM a10 a JOIN v USING (row) JOIN t USING (c) JOIN c10 m USING (c)""",
}
