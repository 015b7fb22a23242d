"""Column functions over text, ratings, times and URLs. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L

# Markers of an unknown address.
MISSING_IP = ["", "unknown", "none", "null", "nan", "n/a", "-", "0.0.0.0"]
# Marketplaces by host suffix.
MARKETS = {"amazon.com": "amazon", "amazon.de": "amazon", "amazon.co.uk": "amazon", "wildberries.ru": "wildberries", "wb.ru": "wildberries", "ozon.ru": "ozon", "market.yandex.ru": "yandex_market", "aliexpress.com": "aliexpress", "aliexpress.ru": "aliexpress", "ebay.com": "ebay", "walmart.com": "walmart", "etsy.com": "etsy", "mvideo.ru": "mvideo", "dns-shop.ru": "dns", "lamoda.ru": "lamoda", "bestbuy.com": "bestbuy", "target.com": "target", "yelp.com": "yelp", "tripadvisor.com": "tripadvisor"}
# Query keys that don't change an image.
NOISE_KEYS = ["w", "h", "width", "height", "size", "quality", "q", "format", "fm", "fit", "crop", "dpr", "v", "ver", "version", "cache", "ts", "ref", "token"]


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ramp(c: Column, start: float, width: float) -> Column:
    return clip((c - start) / width)


def once(c: Column, make: Callable[[Column], Column]) -> Column:
    """make(c) with c computed once a row, however often make uses it: branches, lambdas and chains of `when` would compute it each time."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def norm_text(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; single spaces, the most of them, are not rewritten."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def chars_of(c: Column, chars: str) -> Column:
    """How many characters of c are in the class: what is missing without them. regexp_count would make a string of each."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def tokens(c: Column) -> Column:
    """Words of letters, digits, underscore, apostrophe and hyphen, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))


def ngrams(tok: Column, n: int) -> Column:
    """n-grams of a column of tokens, joined by spaces; each word is read by its place, as slices of long arrays would be copied."""
    one = lambda i: F.concat_ws(" ", *[F.get(tok, i + k) for k in range(n)])
    return F.when(F.size(tok) >= n, F.transform(F.sequence(F.lit(0), F.size(tok) - n), one)).otherwise(F.array().cast("array<string>"))


def exploded(df: DataFrame, array: Column, name: str, keep: list[str]) -> DataFrame:
    """keep and one row per element. An outer explode, as the other's inferred size filter is pushed down and computes the array again inside its own lambdas."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out by record_id into the session's number of shuffle partitions, so that the terms of a record are counted where it lies.

    Texts are moved once instead of their terms, which are many times larger; the number is kept, as joined partitions would hold more terms than fit in memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record_id")


def word_count(c: Column) -> Column:
    return once(norm_text(c), lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " "))))


def unique_word_ratio(c: Column, empty: float = 1.0) -> Column:
    return once(tokens(c), lambda t: F.when(F.size(t) == 0, empty).otherwise(F.size(F.array_distinct(t)) / F.size(t)))


def _count(c: Column, chars: str) -> Column:
    return chars_of(F.coalesce(c, F.lit("")), chars)


def uppercase_ratio(c: Column) -> Column:
    return _count(c, r"\p{Lu}") / F.greatest(_count(c, r"\p{L}"), F.lit(1))


def digit_ratio(c: Column) -> Column:
    return _count(c, r"\p{Nd}") / F.greatest(F.length(F.coalesce(c, F.lit(""))), F.lit(1))


def punct_density(c: Column, ch: str) -> Column:
    return _count(c, ch) / F.greatest(F.length(F.coalesce(c, F.lit(""))), F.lit(1))


def has_phrase(c: Column, phrases: list[str]) -> Column:
    return once(F.lower(F.coalesce(c, F.lit(""))), lambda t: reduce(lambda a, b: a | b, [t.contains(p) for p in phrases]))


def held(t: Column, phrases: list[str]) -> Column:
    """How many of the phrases a lower-case text holds; those beyond ASCII are looked for only where the text has such characters."""
    count = lambda some: reduce(lambda a, b: a + b, [t.contains(p).cast("int") for p in some], F.lit(0))
    return count([p for p in phrases if p.isascii()]) + F.when(F.octet_length(t) > F.length(t), count([p for p in phrases if not p.isascii()])).otherwise(0)


def phrase_hits(c: Column, phrases: list[str]) -> Column:
    return once(F.lower(F.coalesce(c, F.lit(""))), lambda t: held(t, phrases))


def cyclic_time(ts: Column) -> dict[str, Column]:
    import math

    hour, day = F.hour(ts), F.weekday(ts)
    turn = lambda x, n: x * (2 * math.pi / n)
    return {"hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)), "day_sin": F.sin(turn(day, 7)), "day_cos": F.cos(turn(day, 7)), "is_weekend": (day >= 5).cast("int")}


def risk_level(c: Column, high: float, medium: float) -> Column:
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def language_profile(c: Column) -> Column:
    ru, en = c.rlike("[а-яёА-ЯЁ]"), c.rlike("[A-Za-z]")
    return F.when(ru & en, "mixed").when(ru, "ru").when(en, "en_or_latin").otherwise("other")


def length_bucket(words: Column) -> Column:
    return F.when(words <= 6, "very_short").when(words <= 18, "short").when(words <= 60, "medium").otherwise("long")


def rating_bucket(c: Column) -> Column:
    return F.when(c <= 1.5, "low").when(c <= 3.5, "middle").when(c <= 4.75, "high").otherwise("top")


def group_token(c: Column, default: str) -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(t == "", default).otherwise(t)


def split_group(c: Column) -> Column:
    """Lineage id of a text: equal for texts that are equal after normalizing."""
    return F.concat(F.lit("review::"), F.md5(F.lower(norm_text(c))))


def source_group(c: Column) -> Column:
    return group_token(F.split(c, ":")[0], "unspecified")


def product_family(text: Column, source: Column) -> Column:
    """The first family one of whose phrases the source's name holds, else the text, else general."""

    def family(c: Column, families: dict[str, list[str]]) -> Column:
        """The first family one of whose phrases c holds, else null."""
        return once(F.lower(norm_text(c)), lambda t: F.coalesce(*[F.when(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), name) for name, words in families.items()]))

    return F.coalesce(family(source, L.FAMILY_SOURCES), family(text, L.FAMILY_TEXTS), F.lit("general"))


def holdout_group(source: Column, family: Column, origin: Column | None = None) -> Column:
    own = [F.concat(F.lit("source::"), group_token(source, "unspecified")), F.concat(F.lit("product::"), group_token(family, "general"))]
    if origin is not None:
        own.append(F.concat(F.lit("origin::"), F.nullif(group_token(origin, ""), F.lit(""))))
    return F.concat_ws("::", *own)


def truncate_text(c: Column, most: int) -> Column:
    """At most that many characters, cut behind a whole word."""
    t = norm_text(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.trim(F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", "")), F.lit("...")))


def parse_rating(c: Column) -> Column:
    """First number of a text, decimal comma allowed; else the count of filled stars."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]+(?:[.,][0-9]+)?)", 1)
    number = F.regexp_replace(found, ",", ".").try_cast("double")
    stars = F.regexp_count(F.coalesce(c, F.lit("")), F.lit("★"))
    return F.coalesce(number, F.when(stars > 0, stars.cast("double")))


def normalize_ip(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(MISSING_IP), None).otherwise(F.trim(c))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def site_name(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(host_of(url), F.lit("unknown")), r"^www\.", "")


def marketplace_of(host: Column) -> Column:
    hit = None
    for suffix, name in MARKETS.items():
        cond = (host == suffix) | host.endswith(f".{suffix}")
        hit = F.when(cond, name) if hit is None else hit.when(cond, name)
    return hit.otherwise("other")


MAX_DATA_IMAGE_BYTES = 8 * 1024 * 1024


def is_safe_image_url(url: Column) -> Column:
    """http(s) with a public host: no private, reserved, loopback or link-local address, no .local, no localhost; or a base64 data image of bounded size."""
    url = F.trim(url)
    host = F.rtrim(host_of(url), F.lit("."))
    part = lambda i: F.get(F.split(host, r"\."), F.lit(i)).try_cast("int")
    pair = lambda a, *b: (part(0) == a) & part(1).isin(*b)
    is_ip = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = part(0).isin(0, 10, 127) | (part(0) >= 224) | pair(192, 168) | pair(169, 254) | pair(198, 18, 19) | ((part(0) == 172) & part(1).between(16, 31))
    private = private | (pair(192, 0) & part(2).isin(0, 2)) | (pair(198, 51) & (part(2) == 100)) | (pair(203, 0) & (part(2) == 113))
    inner = F.regexp_replace(host, r"[\[\]]", "")
    closed = host.startswith("[") & inner.rlike(r"^(::1?$|::ffff:|fe[89ab]|f[cdf]|2001:db8:)")
    bad_name = host.isin("localhost", "localhost.localdomain") | host.endswith(".localhost") | host.endswith(".local")
    public = F.lower(url).rlike("^https?://") & (host != "") & ~bad_name & ~(is_ip & F.coalesce(private, F.lit(False))) & ~closed
    data = F.lower(url).rlike(r"^data:image[^,]*;base64[^,]*,") & (F.floor((F.length(url) - F.locate(",", url)) * 3 / 4) <= MAX_DATA_IMAGE_BYTES)
    return F.coalesce(F.when(url.startswith("data:"), data).otherwise(public), F.lit(False))


def normalize_image_url(url: Column, base: Column) -> Column:
    """An image's whole address, relative ones made from the page's; null where it isn't safe."""
    u = F.trim(url)
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(root == "", None).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(root, folder, F.regexp_replace(u, r"^\./", "")))
    )
    return F.when((u != "") & ~u.startswith("#") & ~u.startswith("data:image/gif") & is_safe_image_url(whole), whole)


def canonical_url(url: Column) -> Column:
    """https, lower-case host, no trailing slash or fragment, noise keys dropped, query sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(NOISE_KEYS) & ~F.lower(p).startswith("utm_"))
    tail = F.array_join(F.array_sort(query), "&")
    return F.concat(F.lit("https://"), host, path, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))


def normalize_image_urls(c: Column) -> Column:
    """A JSON array, or a list divided by line ends, pipes or commas, to distinct URLs in order."""
    parsed = F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.split(F.coalesce(c, F.lit("")), r"[\n|,]"))
    return F.array_distinct(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != ""))


def item_id_from_url(url: Column) -> Column:
    query = F.regexp_extract(url, r"[?&](?:id|item|product_id|sku)=([A-Za-z0-9]+)", 1)
    path = F.regexp_extract(url, r"/(?:catalog|product|item)/(?:[^/?]*-)?([0-9]+)", 1)
    code = F.regexp_extract(url, r"/(?:dp|gp/product)/([A-Z0-9]{10})", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (query, path, code)])


def array_of(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda x: x.isNotNull())


# Texts that pages put around reviews.
BOILERPLATE = ["Brief content visible, double tap to read full content.", "Full content visible, double tap to read brief content.", "Brief content visible, double tap to read full content", "Full content visible, double tap to read brief content"]


def clean_boilerplate(c: Column) -> Column:
    out = norm_text(c)
    for phrase in BOILERPLATE:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    return norm_text(out)


def clean_title(title: Column, rating_text: Column) -> Column:
    """The title without a rating text that it begins with."""
    t, r = norm_text(title), norm_text(rating_text)
    rest = F.regexp_replace(F.substring(t, F.length(r) + 1, F.length(t)), r"^[ \-:|]+|[ \-:|]+$", "")
    return norm_text(F.when((r != "") & F.lower(t).startswith(F.lower(r)), rest).otherwise(t))


# Month names by their first letters, and units of relative dates in days.
MONTHS = {"jan": 1, "янв": 1, "feb": 2, "фев": 2, "mar": 3, "мар": 3, "apr": 4, "апр": 4, "may": 5, "мая": 5, "май": 5, "jun": 6, "июн": 6, "jul": 7, "июл": 7, "aug": 8, "авг": 8, "sep": 9, "сен": 9, "oct": 10, "окт": 10, "nov": 11, "ноя": 11, "dec": 12, "дек": 12}
DAYS_AGO = {"today": 0, "сегодня": 0, "yesterday": 1, "вчера": 1, "позавчера": 2}
UNIT_DAYS = {"day": 1, "дн": 1, "ден": 1, "week": 7, "недел": 7, "month": 30, "месяц": 30, "year": 365, "год": 365, "лет": 365}


def parse_human_date(c: Column, now: Column) -> Column:
    """Dates as people write them: ISO, day.month.year, day and month name in Russian or English (the year before now if it is missing), and relative days."""
    t = F.lower(norm_text(F.replace(c, F.lit("\u00a0"), F.lit(" "))))
    pick = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    date = lambda y, m, d: F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    iso = pick(r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")
    dotted = date(pick(r"([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", 3), pick(r"([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", 2), pick(r"([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", 1))
    names = "|".join(MONTHS)
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    first, second = rf"([0-9]{{1,2}}) ({names})\p{{L}}*\.?,?(?: ([0-9]{{4}}))?", rf"({names})\p{{L}}*\.? ([0-9]{{1,2}})(?:,? ([0-9]{{4}}))?(?:[^0-9]|$)"
    day, month, year = (F.coalesce(pick(first, a), pick(second, b)) for a, b in ((1, 2), (2, 1), (3, 3)))
    this = date(F.year(now).cast("string"), numbers[month], day)
    named = F.when(year.isNotNull(), date(year, numbers[month], day)).when(this > now.cast("date"), date((F.year(now) - 1).cast("string"), numbers[month], day)).otherwise(this)
    said = F.coalesce(*[F.when(t.contains(w), F.lit(k)) for w, k in sorted(DAYS_AGO.items(), key=lambda x: -len(x[0]))])
    amount, unit = pick(r"([0-9]+) (\p{L}+)(?: \p{L}+)? ?(?:ago|назад)", 1).try_cast("int"), pick(r"([0-9]+) (\p{L}+)(?: \p{L}+)? ?(?:ago|назад)", 2)
    back = F.coalesce(*[F.when(unit.startswith(w), amount * k) for w, k in UNIT_DAYS.items()])
    return F.coalesce(iso, dotted, F.date_sub(now.cast("date"), F.coalesce(said, back)), named)


def lexical_coverage(tok: Column, known: Column) -> Column:
    """Share of the tokens that are in an array of known words; 0 without tokens."""
    return F.when(F.size(tok) == 0, 0.0).otherwise(F.size(F.filter(tok, lambda x: F.array_contains(known, x))) / F.size(tok))


def text_numeric_features(text: Column, rating: Column) -> dict[str, Column]:
    """Ten scaled measures of a text and its rating."""
    t, tok = F.coalesce(text, F.lit("")), tokens(text)
    n, chars = F.size(tok), F.length(t)
    mean = F.when(n > 0, F.aggregate(tok, F.lit(0), lambda a, x: a + F.length(x)) / n).otherwise(0.0)
    unique = F.size(F.array_distinct(tok)) / F.greatest(n, F.lit(1))
    return {
        "rating_scaled": clip(F.coalesce(rating, F.lit(0.0)) / 5), "word_count_scaled": clip(n / 120), "character_count_scaled": clip(chars / 600), "unique_word_ratio": clip(unique), "repetition_ratio": clip(1 - unique), "average_word_length_scaled": clip(mean / 12),
        "exclamation_density_scaled": clip(25 * punct_density(t, "!")), "question_density_scaled": clip(25 * punct_density(t, "?")), "uppercase_ratio_scaled": clip(4 * uppercase_ratio(t)), "digit_ratio_scaled": clip(10 * digit_ratio(t)),
    }
