"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat_format, clustering, decontamination, exact_dedup, fingerprints, language_id, licenses, mixing, near_dedup, packing, pii, secrets

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path()).drop("copy")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(hard)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_documents(spark, sf_dir))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_documents(spark, sf_dir), tokenizer_path(), tokenizer_path(PIECES))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """k-means written out round by round, each distance anew from the components."""
    parts = ["""kept AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding] AS x FROM embeddings
             WHERE len(embedding) = 64 AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = 64)""",
             f"""c0 AS (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM kept) WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT rid, vec_id, v, c, d FROM (SELECT k.rid, k.vec_id, k.x AS v, c.c, CAST(list_sum([(k.x[i] - c.x[i]) * (k.x[i] - c.x[i]) FOR i IN range(1, 65)]) AS BIGINT) AS d FROM kept k, c{r} c)
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS t(i) GROUP BY c, i)""")
            parts.append(f"""m{r} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c)""")
            parts.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""


#: Every run of as many words as some window has, met with the windows.
_DECONTAMINATION_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, w[p : p + 9] AS win FROM i, unnest(range(1, len(w) - 8)) AS t(p) WHERE len(w) >= 10 UNION SELECT item_id, w FROM i WHERE len(w) BETWEEN 1 AND 9),
    runs AS (SELECT r, p, k, w[p : p + k - 1] AS win FROM d, (SELECT DISTINCT len(win) AS k FROM windows), unnest(range(1, len(w) - k + 2)) AS t(p)),
    met AS (SELECT r, p, k, item_id FROM runs JOIN windows USING (win)),
    hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM met, unnest(range(0, k)) AS t(o) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_best_fit_packing, op3_minhash_near_dedup, op4_chat_format, op5_language_id, op6_personal_data, op7_fingerprints, op8_secrets, op9_mixing, op10_license_scan, op11_token_alignment, op12_centroid_clustering, op13_decontamination)}

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_centroid_clustering": _clustering_sql(),
    "op13_decontamination": _DECONTAMINATION_SQL,
}
