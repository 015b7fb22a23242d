"""The canonical tables as views of the driver's tables; the same text runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"]

VIEWS = {
    "ratings_v": """SELECT e.event_id AS record_id, 'u' || CAST(e.user_id AS STRING) AS user_id, 'i' || CAST(e.event_id % 40 AS STRING) AS item_id,
 CAST(1 + (e.event_id * 7 + e.user_id) % 5 AS DOUBLE) AS rating, e.ts AS ts,
 CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE '10.0.' || CAST(e.user_id % 8 AS STRING) || '.' || CAST(e.event_id % 5 AS STRING) END AS ip_address,
 e.event_type AS geo_country, 'c' || CAST(e.user_id % 7 AS STRING) AS geo_city, coalesce(d.text, '') AS review_text,
 CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS is_fake
FROM (SELECT v.*, k.n FROM events v CROSS JOIN (SELECT max(doc_id) + 1 AS n FROM documents) k) e LEFT JOIN documents d ON d.doc_id = e.event_id % e.n""",
    "reviews_v": """SELECT d.source AS page_id, d.doc_id AS record_id, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE 'a' || CAST(d.doc_id % 97 AS STRING) END AS author,
 't' || CAST(d.doc_id % 29 AS STRING) AS title, CAST(1 + d.doc_id % 5 AS DOUBLE) AS rating,
 DATE '2024-01-01' + CAST(d.doc_id % 20 AS INT) AS review_date, 1704067200 + (d.doc_id % 500) * 3600 AS sec,
 d.text AS review_text, d.lang AS lang, d.source AS source,
 CASE d.doc_id % 6 WHEN 0 THEN 'amazon.com' WHEN 1 THEN 'wildberries.ru' WHEN 2 THEN 'ozon.ru' WHEN 3 THEN 'market.yandex.ru' WHEN 4 THEN 'aliexpress.com' ELSE 'example.com' END AS source_site,
 1 - l.quality AS label
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "photos_v": """SELECT d.source AS page_id, d.doc_id AS record_id, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE 'a' || CAST(d.doc_id % 97 AS STRING) END AS author, 1704067200 + (d.doc_id % 500) * 3600 AS sec, p.url AS url
FROM (SELECT v.*, k.n FROM documents v CROSS JOIN (SELECT max(page_id) + 1 AS n FROM pages) k) d JOIN pages p ON p.page_id = (d.doc_id * 3) % d.n
UNION ALL SELECT d.source, d.doc_id, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE 'a' || CAST(d.doc_id % 97 AS STRING) END, 1704067200 + (d.doc_id % 500) * 3600, p.url
FROM (SELECT v.*, k.n FROM documents v CROSS JOIN (SELECT max(page_id) + 1 AS n FROM pages) k) d JOIN pages p ON p.page_id = (d.doc_id * 5 + 1) % d.n""",
    "scored_v": """SELECT l.doc_id AS record_id, l.toxic AS label, CAST((l.doc_id * 37) % 101 AS DOUBLE) / 100 AS p, CAST((l.doc_id * 53) % 101 AS DOUBLE) / 100 AS pt, CAST((l.doc_id * 17) % 101 AS DOUBLE) / 100 AS rating_score, d.lang AS lang, d.source AS source, d.n_chars AS n_chars
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}

#: Tables dealt out by their key as they are read. A file of few row groups is read by as few tasks, which would then do all the work
#: on its texts; and what is grouped by record_id later is where it belongs. They keep the session's number of shuffle
#: partitions: by their bytes they would be joined to few, which take long over texts, and events, small before they meet their texts, to one.
SPREAD = {"documents": "doc_id", "events": "event_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD[name]) if name in SPREAD else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    df = spark.sql(sql, **{t: _table(spark, sf_dir, t) for t in used})
    return df.withColumn("ts", df["ts"].cast("timestamp")) if "ts" in df.columns else df


def with_view(*names: str, rest: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + rest
