"""The registered queries over the driver tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.cost_packing import REMEMBERED, pack
from attesta.llm.embedding_dedup import near_duplicate_vectors
from attesta.llm.hard_negatives import hard_negatives
from attesta.llm.kd_clusters import centroid_clusters
from attesta.llm.line_dedup import drop_boilerplate
from attesta.llm.merge_dropout import decode, encode_with_dropout
from attesta.llm.preference import format_preferences
from attesta.llm.prob_minhash import near_duplicate_documents
from attesta.llm.secret_scan import secret_spans
from attesta.llm.session import table
from attesta.llm.suffix_dedup import remove_repeats
from attesta.llm.token_counts import count_tokens
from attesta.llm.topk import exact_top_k, quantised
from attesta.llm.toxicity_chain import toxicity


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and the one kept of each, for every row of ``embeddings``."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 n and 2 n + 1 are pair n: the even one is preferred."""
    pairs = format_preferences(table(spark, sf_dir, "conversations"), F.shiftright("conv_id", 1), F.expr("pmod(conv_id, 2) = 0"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return pairs.select("pair_id", "paired", "n_common", *digests, spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with dropout and decoded again: digests of ids and of the text that comes back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    documents = table(spark, sf_dir, "documents")
    back = decode(encode_with_dropout(documents, model), model)
    return back.select("doc_id", "variant", "n_bytes", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def packed_digest(documents: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    pieces = pack(documents, public_tokenizers.path("word_bpe_49k.json"), remembered=remembered)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, in sequences of 4096 tokens."""
    return packed_digest(table(spark, sf_dir, "documents"), remembered=1_000_000)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicate_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every fiftieth vector against all others."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines, as a digest."""
    kept = drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict for every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of earlier ones, as a digest."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components after five rounds from 40 centroids."""
    return centroid_clusters(quantised(table(spark, sf_dir, "embeddings")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: how many of each base kind, a digest of their spans, and all spans."""
    found = secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    base = F.filter("spans", lambda x: x["kind"] != "random")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of five positives of every hundredth vector; every seventh label is moved on by one."""
    embeddings = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(embeddings, carry=[label.alias("label")]), F.col("vec_id") % 100 == 0)


def _kd_clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """One pair of steps (assignment, new centroids) for each round."""
    nearest = """a{r} AS (
            SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT vec_id, c, CAST(list_sum(list_transform(list_zip(q.q, z.z), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM q, z{r} AS z
            ) GROUP BY vec_id
        )"""
    moved = f"""z{{n}} AS (
            SELECT c, coalesce(m.z, z{{r}}.z) AS z FROM z{{r}} LEFT JOIN (
                SELECT c, list(CAST(floor_sum AS BIGINT) ORDER BY j) AS z FROM (
                    SELECT c, j, (s - ((s % n) + n) % n) // n AS floor_sum FROM (
                        SELECT c, j, CAST(sum(q.q[j]) AS BIGINT) AS s, count(*) AS n FROM a{{r}} JOIN q USING (vec_id), range(1, {dims + 1}) AS t(j) GROUP BY c, j
                    )
                ) GROUP BY c
            ) AS m USING (c)
        )"""
    steps = [x for r in range(rounds) for x in (nearest.format(r=r), moved.format(r=r, n=r + 1))] + [nearest.format(r=rounds)]
    return f"""
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND list_count(list_filter(embedding, lambda x: isfinite(x))) = {dims}
        ), z0 AS (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q AS z FROM q QUALIFY c < {k}
        ), {", ".join(steps)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
        FROM a{rounds} JOIN z{rounds} USING (c)"""


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_preference_format": op2_preference_format,
    "op3_merge_dropout": op3_merge_dropout,
    "op4_cost_packing": op4_cost_packing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_kd_clusters": op11_kd_clusters,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op2_preference_format": """
        WITH turns AS (
            SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), facing AS (
            SELECT pair_id, pos, coalesce(c.role = r.role AND c.text = r.text, false) AS same
            FROM (SELECT * FROM turns WHERE side = 0) AS c FULL JOIN (SELECT * FROM turns WHERE side = 1) AS r USING (pair_id, pos)
        ), common AS (
            SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, count(*)) AS n_common FROM facing GROUP BY pair_id
        ), rendered AS (
            SELECT t.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM turns AS t JOIN common USING (pair_id)
        ), placed AS (
            SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id, side, pos > n_common ORDER BY pos) AS stop FROM rendered
        )
        SELECT pair_id, count(DISTINCT side) = 2 AS paired, any_value(n_common) AS n_common,
            sha256(coalesce(string_agg(piece, '' ORDER BY pos) FILTER (side = 0 AND pos <= n_common), '')) AS prompt_sha256,
            sha256(coalesce(string_agg(piece, '' ORDER BY pos) FILTER (side = 0 AND pos > n_common), '')) AS chosen_sha256,
            sha256(coalesce(string_agg(piece, '' ORDER BY pos) FILTER (side = 1 AND pos > n_common), '')) AS rejected_sha256,
            coalesce(string_agg((stop - length(text) - 8) || '-' || stop, ',' ORDER BY pos) FILTER (side = 0 AND pos > n_common AND role = 'assistant'), '') AS chosen_mask,
            coalesce(string_agg((stop - length(text) - 8) || '-' || stop, ',' ORDER BY pos) FILTER (side = 1 AND pos > n_common AND role = 'assistant'), '') AS rejected_mask
        FROM placed GROUP BY pair_id""",
    "op7_exact_top_k": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
            FROM q AS a JOIN q AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op8_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
        ), pages AS (
            SELECT source, COUNT(*) AS total FROM documents GROUP BY source
        ), seen AS (
            SELECT source, line, COUNT(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line
        ), bad AS (
            SELECT seen.source, line FROM seen JOIN pages ON seen.source IS NOT DISTINCT FROM pages.source WHERE n >= 5 AND n / total > 0.02
        ), marked AS (
            SELECT doc_id, pos, lines.line, bad.line IS NOT NULL AS dropped
            FROM lines LEFT JOIN bad ON lines.source IS NOT DISTINCT FROM bad.source AND lines.line = bad.line
        )
        SELECT d.doc_id, COUNT(pos) AS n_lines, COUNT(pos) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(m.line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM documents AS d LEFT JOIN marked AS m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
    "op11_kd_clusters": _kd_clusters_sql(),
    "op13_hard_negatives": """
        WITH q AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
            FROM q AS a JOIN q AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}
