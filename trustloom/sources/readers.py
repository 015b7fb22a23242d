"""Readers, normalization at load, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T

# Other names of the canonical rating columns, in order of preference.
RATING_ALIASES = {"user_id": ["userid", "user", "reviewer_id"], "item_id": ["itemid", "product_id", "asin"], "rating": ["score", "stars", "overall"], "ts": ["timestamp", "time", "date"], "ip_address": ["ip", "ip_addr"], "geo_country": ["country"], "geo_city": ["city"], "review_text": ["text", "review", "comment"]}
REQUIRED = ["user_id", "item_id", "rating", "ts"]


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV; the delimiter most frequent in the first line unless given."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        line = first[0][0] if first else ""
        sep = max(",;\t", key=line.count)
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, mode="DROPMALFORMED")


def read_records_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of records, or an object that holds it under a usual key."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    keys = ["$.records", "$.data.records", "$.data.items", "$.items", "$.results", "$"]
    lists = F.coalesce(*[F.try_variant_get("v", k, f"array<struct<{schema}>>") for k in keys])
    return whole.select(F.inline(lists))


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid, else CP1251 unless they hold 0x98, which it lacks, else Latin-1.

    A byte order mark stays a character, as plain UTF-8 comes first; null bytes give null.
    """
    latin = F.decode(content, "ISO-8859-1")
    upper = [bytes([i]) for i in range(128, 256) if i != 0x98]
    cyrillic = F.translate(latin, "".join(b.decode("latin-1") for b in upper), "".join(b.decode("cp1251") for b in upper))
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.when(~latin.contains("\x98"), cyrillic), latin)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file, decoded by decode_text; a file is one row, so files must fit in a task. Empty files give none."""
    return spark.read.format("binaryFile").load(path).select("path", decode_text(F.col("content")).alias("text"))


def rename_aliases(df: DataFrame, aliases: dict[str, list[str]] = RATING_ALIASES) -> DataFrame:
    """Canonical names; a canonical column that is there wins over its aliases."""
    low = {c.lower(): c for c in df.columns}
    names = {}
    for name, others in aliases.items():
        if name not in low:
            found = next((low[o] for o in others if o in low), None)
            if found:
                names[found] = name
    return df.withColumnsRenamed(names)


def match_columns(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Columns whose names match ignoring case and punctuation, else as a substring, under their new names."""
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in df.columns}
    out = []
    for name, wanted in candidates.items():
        keys = ["".join(ch for ch in w.lower() if ch.isalnum()) for w in wanted]
        found = next((plain[k] for k in keys if k in plain), None) or next((c for k in keys for p, c in plain.items() if k in p), None)
        if found:
            out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def infer_columns(df: DataFrame, sample_rows: int = 1000) -> dict[str, str]:
    """The column that looks most like each field, by shares of matching values in one aggregate over a sample."""
    rules = {"rating": r"^[0-5]([.,][0-9]+)?$", "ip_address": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "ts": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "review_text": r"^.{40,}"}
    share = lambda c, p: F.avg(F.col(f"`{c}`").cast("string").rlike(p).cast("double"))
    row = df.limit(sample_rows).agg(*[share(c, p).alias(f"{f}\t{c}") for f, p in rules.items() for c in df.columns]).first()
    out = {}
    for f in rules:
        score, column = max((row[f"{f}\t{c}"] or 0, c) for c in df.columns)
        if score >= 0.6:
            out[f] = column
    return out


def prepare_ratings(df: DataFrame) -> DataFrame:
    """The canonical rating table: typed, defaults filled, rows without rating or time dropped."""
    df = rename_aliases(df)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    have = lambda c, default=None: F.col(c) if c in df.columns else F.lit(default).cast("string")
    geo = F.split(have("geo_country", "unknown"), r"\|", 2)
    rows = df.select(
        have("record_id").try_cast("bigint").alias("record_id"), F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("item_id"),
        F.col("rating").try_cast("double").alias("rating"), F.col("ts").try_cast("timestamp").alias("ts"), T.normalize_ip(have("ip_address")).alias("ip_address"),
        F.coalesce(geo[0], F.lit("unknown")).alias("geo_country"), F.coalesce(have("geo_city"), F.get(geo, F.lit(1)), F.lit("unknown")).alias("geo_city"),
        F.coalesce(have("review_text"), F.lit("")).alias("review_text"), F.coalesce(have("is_fake").try_cast("int"), F.lit(-1)).alias("is_fake"),
    )
    return rows.withColumn("geo_key", F.concat_ws("|", "geo_country", "geo_city")).dropna(subset=["rating", "ts"])


def fill_flexible_defaults(df: DataFrame, source_name: str) -> DataFrame:
    return df.withColumns({
        "user_id": F.coalesce("user_id", F.concat(F.lit("imported_user_"), F.col("record_id"))), "item_id": F.coalesce("item_id", F.lit(source_name)),
        "geo_country": F.coalesce("geo_country", F.lit("unknown")), "geo_city": F.coalesce("geo_city", F.lit("unknown")),
    })


def import_report(df: DataFrame, fields: list[str]) -> DataFrame:
    empty = {c: F.col(c).isNull() | (F.col(c).cast("string") == "") for c in fields}
    some = F.greatest(*[e.cast("int") for e in empty.values()])
    return df.agg(F.count("*").alias("n_rows"), F.sum(some).alias("incomplete_rows"), *[F.count_if(e).alias(f"empty_{c}") for c, e in empty.items()])


def collection_summary(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("strategy", "status").agg(F.count("*").alias("attempts"), F.sum("found").alias("found"))


def is_blocked_page(html):
    return T.has_phrase(F.substring(html, 1, 12000), L.BLOCKED)


def filter_noise(df: DataFrame, text: str = "review_text") -> DataFrame:
    """Without handles, product variants, and stock or price fragments."""
    t = F.lower(T.norm_text(F.col(text)))
    noise = t.rlike(r"^@[a-z0-9_.]+$") | t.rlike(r"^(colou?r|size|цвет|размер)\s*[:=]") | t.rlike(r"^(in stock|out of stock|в наличии)") | t.rlike(r"^[$€₽]?\s*[0-9][0-9 .,]*\s*[$€₽]?$") | (F.length(t) < 15)
    return df.filter(~noise)


def extract_jsonld_reviews(pages: DataFrame) -> DataFrame:
    """Reviews in schema.org scripts of html: single objects, lists, and @graph."""
    script = F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1)))
    node = "struct<`@type`:string,reviewBody:string,name:string,datePublished:string,author:struct<name:string>,reviewRating:struct<ratingValue:string>>"
    v = pages.select("page_id", script.alias("s")).select("page_id", F.try_parse_json("s").alias("v"))
    lists = F.concat(*[F.coalesce(F.try_variant_get("v", p, f"array<{node}>"), F.array().cast(f"array<{node}>")) for p in ("$", "$.review", "$['@graph']", "$[0].review")])
    single = F.coalesce(F.array(F.try_variant_get("v", "$", node)), F.array().cast(f"array<{node}>"))
    rows = v.select("page_id", F.explode(F.array_distinct(F.concat(lists, single))).alias("r")).filter("r.reviewBody is not null")
    return rows.select("page_id", F.col("r.author.name").alias("author"), F.col("r.name").alias("title"), T.parse_rating(F.col("r.reviewRating.ratingValue")).alias("rating"), F.col("r.datePublished").alias("date"), T.norm_text(F.col("r.reviewBody")).alias("review_text"))


def extract_feedbacks(payloads: DataFrame) -> DataFrame:
    """Marketplace feedback payloads (column json) to reviews."""
    schema = "feedbacks array<struct<text:string,pros:string,cons:string,productValuation:double,createdDate:string,wbUserDetails:struct<name:string>,photos:array<struct<fullSize:string>>>>"
    rows = payloads.select("page_id", F.explode(F.from_json("json", schema)["feedbacks"]).alias("f"))
    body = F.concat_ws(". ", *[F.nullif(F.trim(F.col(f"f.{c}")), F.lit("")) for c in ("text", "pros", "cons")])
    return rows.select("page_id", F.col("f.wbUserDetails.name").alias("author"), F.col("f.productValuation").alias("rating"), F.col("f.createdDate").alias("date"), body.alias("review_text"), F.coalesce(F.transform("f.photos", lambda p: p["fullSize"]), F.array()).alias("image_urls"))


def serialize_predictions(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).drop("geo_key", "is_fake")


def save_report(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)


def list_reports(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "report_id").limit(min(max(limit, 1), 100))


def get_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("report_id") == report_id)


def export_reviews(df: DataFrame, path: str) -> None:
    df.write.json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(f"{path}/csv", header=True)
