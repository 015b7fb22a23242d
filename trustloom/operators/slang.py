"""Slang and language profiles of reviews: hits, domain, detail, scores, labels, templates, learned lexicons.

Expects page_id, record_id, review_text; title and source_site are used where they are there. The page is a
key, so domain and template counts are aggregates per page that are joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustloom.functions import lexicons as L
from trustloom.functions import text as T
from trustloom.sources.tables import cut

WORD = r"[A-Za-z\x{0400}-\x{04FF}]+(?:['-][A-Za-z\x{0400}-\x{04FF}]+)?"
UNIT = r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)?\s?(?:cm|mm|kg|g|mg|ml|mah|gb|tb|inch|in|см|мм|кг|г|мг|мл|мач|дюйм)(?![\p{L}\p{N}_])"
DOMAINS = [*L.DOMAIN_KEYWORDS]
#: Words with a part of their own, which a learned lexicon leaves out.
RESERVED = sorted({t for part in (L.RU_SLANG, L.TRANSLIT_SLANG, L.EN_SLANG, L.DETAIL, *L.DOMAIN_KEYWORDS.values(), *L.DOMAIN_DETAIL.values(), *L.PACK_DETAIL.values(), *L.PACK_SLANG.values(), *L.PACK_AUTHENTIC.values()) for t in part})
RESERVED_PHRASES = sorted({*L.SLANG_PHRASES, *L.PROMO_PHRASES, *(p for phrases in L.PACK_PROMO.values() for p in phrases)})
#: The lists of a learned lexicon that meet a review, as columns of its row (with_lexicon).
LEXICON = ["lx_suspicious_terms", "lx_suspicious_phrases", "lx_authentic_terms", "lx_authentic_phrases", "lx_promo_phrases"]
# Parts of phrases that sell.
PROMO_MARKERS = ["buy", "grab", "must", "worth", "need", "cop", "берите", "надо", "брать", "советую", "топ"]


def word_tokens(c: Column) -> Column:
    """Lower-case words of Latin or Cyrillic letters with at most one joint."""
    return F.regexp_extract_all(F.lower(T.norm_text(c)), F.lit(WORD), F.lit(0))


def token_hits(tok: Column, terms: list[str]) -> Column:
    return F.filter(tok, lambda x: x.isin(*terms)) if terms else F.slice(tok, 1, 0)


def _distinct_hits(tok: Column, terms: list[str]) -> Column:
    return F.size(F.array_distinct(token_hits(tok, terms)))


def _phrases(t: Column, phrases: list[str]) -> Column:
    """The phrases that a lower-case text holds."""
    return T.array_of(*[(t.contains(p), p) for p in phrases]) if phrases else F.array().cast("array<string>")


def marketplace_pack(site: Column) -> Column:
    """The first pack one of whose aliases is in the site's token; generic for none."""
    of = lambda token: [F.when(reduce(lambda a, b: a | b, [token.contains(a) for a in aliases]), label) for label, aliases in L.PACK_ALIASES.items()]
    return T.once(T.group_token(site, ""), lambda token: F.coalesce(*of(token), F.lit("generic")))


def _of_pack(market: Column, lists: dict[str, list[str]], make) -> Column:
    """What make gives for the lists of the row's pack; only that branch is computed."""
    out = None
    for label, terms in lists.items():
        out = F.when(market == label, make(terms)) if out is None else out.when(market == label, make(terms))
    return out.otherwise(make([]))


def _top_domain(hits: list[Column]) -> tuple[Column, Column]:
    """Domain and confidence from keyword hits, which need 2 in one domain; the first of equal ones wins."""
    most, total = F.greatest(*hits), reduce(lambda a, b: a + b, hits)
    label = F.coalesce(*[F.when(h == most, d) for d, h in zip(DOMAINS, hits, strict=True)])
    return F.when(most < 2, "general").otherwise(label), F.when(most < 2, 0.0).otherwise(most / F.greatest(total, F.lit(1)))


def domain_hits(df: DataFrame) -> DataFrame:
    """df with the number of keywords of each domain in tok, the words of a review, and in its title."""
    words = F.concat("tok", token_hits(word_tokens(F.col("title")), RESERVED)) if "title" in df.columns else F.col("tok")
    rows = df.withColumn("__words", words)
    return rows.withColumns({f"__d_{d}": F.size(token_hits(F.col("__words"), L.DOMAIN_KEYWORDS[d])) for d in DOMAINS}).drop("__words")


def infer_domain(df: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """domain of each review, page_domain and page_confidence of its page (of all rows without keys); the review's own if it is sure enough.

    A row stands for `copies` reviews if it has that column.
    """
    names = [f"__d_{d}" for d in DOMAINS]
    rows = df if names[0] in df.columns else domain_hits(df)
    copies = F.col("copies") if "copies" in df.columns else F.lit(1)
    sums = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col(n) * copies), F.lit(0)).alias(n) for n in names])
    label, sure = _top_domain([F.col(n) for n in names])
    pages = sums.select(*keys, label.alias("page_domain"), sure.alias("page_confidence"))
    own = rows.withColumns({"__own": label, "__sure": sure})
    own = own.join(pages, [*keys]) if keys else own.join(F.broadcast(pages), F.lit(True))  # one row without keys
    mine = F.col("__sure") >= F.greatest(F.lit(0.45), F.col("page_confidence"))
    return own.withColumn("domain", F.when(mine, F.col("__own")).otherwise(F.col("page_domain"))).drop(*names, "__own", "__sure")


def slang_density(df: DataFrame) -> DataFrame:
    """From n_tokens and hits: hit count, density, diversity, repetition, sorted terms."""
    n, h = F.col("n_tokens"), F.size("hits")
    terms = F.array_sort(F.array_distinct("hits"))
    diversity = F.when(h > 0, F.size(terms) / h).otherwise(0.0)
    return df.withColumns({"n_hits": h, "density": h / F.greatest(n, F.lit(1)), "diversity": diversity, "repetition": F.when(h > 0, 1 - diversity).otherwise(0.0), "terms": terms})


def slang_measures(df: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """What a review's own words give, before its page's domain is known: the costly part, which later steps need not do again.

    All words are gone through once for those of any list (RESERVED); the lists then meet only these, mostly few or none.
    """
    df = df if lexicon is None else with_lexicon(df, lexicon)
    site = F.col("source_site") if "source_site" in df.columns else F.lit("")
    rows = df.withColumns({"__t": F.lower(T.norm_text(F.col("review_text"))), "market_pack": marketplace_pack(site)})
    rows = rows.withColumn("__all", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))).withColumn("tok", token_hits(F.col("__all"), RESERVED))
    lists = {c: F.col(c) if c in df.columns else None for c in LEXICON}
    held = lambda c: F.array().cast("array<string>") if lists[c] is None else F.filter(lists[c], lambda p: F.contains(F.col("__t"), p))
    met = lambda c: F.lit(0) if lists[c] is None else F.size(F.array_intersect(F.col("__all"), lists[c]))
    t, tok, words, market = F.col("__t"), F.col("tok"), F.col("__all"), F.col("market_pack")
    general = token_hits(tok, [*L.RU_SLANG, *L.TRANSLIT_SLANG, *L.EN_SLANG])
    own = _of_pack(market, L.PACK_SLANG, lambda terms: token_hits(tok, terms))
    # a word's characters are a to z, the joints, and Cyrillic ones of two bytes
    bytes_, joints = F.octet_length, lambda x: (F.contains(x, F.lit("'")) | F.contains(x, F.lit("-"))).cast("int")
    rows = domain_hits(rows).withColumns({
        "n_tokens": F.size(words), "__packed": F.size(own), "hits": F.concat(general, own, _phrases(t, L.SLANG_PHRASES)),
        "promo": F.concat(_phrases(t, L.PROMO_PHRASES), _of_pack(market, L.PACK_PROMO, lambda p: _phrases(t, p)), held("lx_promo_phrases")),
        "general_detail": F.size(token_hits(tok, L.DETAIL)), "units": F.regexp_count(t, F.lit(UNIT)),
        **{f"__w_{d}": F.size(_of_pack(market, L.PACK_DETAIL, lambda terms, own_=own_: token_hits(tok, [*own_, *terms]))) for d, own_ in (L.DOMAIN_DETAIL | {"general": L.DETAIL}).items()},
        "cyr": F.size(F.filter(words, lambda x: bytes_(x) > F.length(x))), "lat": F.size(F.filter(words, lambda x: 2 * F.length(x) - bytes_(x) > joints(x))),
        "learned_suspicious": met("lx_suspicious_terms") + F.size(held("lx_suspicious_phrases")),
        "learned_authentic": met("lx_authentic_terms") + F.size(held("lx_authentic_phrases")),
        "__authentic": _of_pack(market, L.PACK_AUTHENTIC, lambda terms: _distinct_hits(tok, terms)),
    })
    rows = slang_density(rows).withColumn("n_promo", F.size("promo"))
    return bilingual(rows).drop("__t", "__all", "tok", "hits", "promo", *LEXICON)


def _of_domain(df: DataFrame) -> DataFrame:
    """domain_detail and market_hits, once the domain is known."""
    of = [F.when(F.col("domain") == d, F.col(f"__w_{d}")) for d in (*DOMAINS, "general")]
    rows = df.withColumn("domain_detail", F.coalesce(*of))
    hits = F.col("__packed") + F.col("n_promo") + F.least(F.col("domain_detail"), F.lit(2)) + F.col("__authentic")
    return rows.withColumn("market_hits", hits).drop("__packed", "__authentic", *[f"__w_{d}" for d in (*DOMAINS, "general")])


def detail_support(df: DataFrame) -> DataFrame:
    """detail and grounding: words of detail and measured units, in general and of the domain."""
    c = F.col
    detail = F.least((c("general_detail") + c("domain_detail") + c("units")) / 3, F.lit(1.0))
    rows = df.withColumn("detail", detail)
    return rows.withColumn("grounding", F.when(c("domain") == "general", c("detail")).otherwise(F.least((c("domain_detail") + c("units")) / 2, F.lit(1.0))))


def bilingual(df: DataFrame) -> DataFrame:
    c, both = F.col, (F.col("cyr") > 0) & (F.col("lat") > 0)
    return df.withColumns({"mix": both.cast("int"), "balance": F.when(both, 1 - F.abs(c("cyr") - c("lat")) / (c("cyr") + c("lat"))).otherwise(0.0)})


def hype_flags(df: DataFrame) -> DataFrame:
    c, some = F.col, F.col("n_hits") > 0
    return df.withColumns({
        "hype": F.when(c("n_hits") + c("n_promo") > 0, c("n_promo") / (c("n_hits") + c("n_promo"))).otherwise(0.0),
        "low_detail": (some & (c("detail") < 0.34) & (c("n_tokens") <= 20)).cast("int"),
        "bi_hype": ((c("mix") == 1) & ((c("n_promo") > 0) | (c("density") >= 0.16)) & (c("detail") < 0.5)).cast("int"),
    })


def slang_scores(df: DataFrame) -> DataFrame:
    """Authenticity and manipulation; 0.5 and 0 where nothing was hit."""
    c = F.col
    moderate = F.when(c("n_hits") > 0, 1 - F.least(F.abs(c("density") - 0.10) / 0.10, F.lit(1.0))).otherwise(0.0)
    bonus = c("mix") * c("balance") * F.least(c("detail"), F.lit(0.9))
    market, suspicious, authentic = T.clip(c("market_hits") / 4), T.clip(c("learned_suspicious") / 3), T.clip(c("learned_authentic") / 3)
    a = (
        0.26 * moderate + 0.22 * c("detail") + 0.16 * c("grounding") + 0.08 * c("diversity") + 0.08 * F.least(c("n_tokens") / 18, F.lit(1.0)) + 0.10 * bonus + 0.12 * authentic + 0.05 * market * c("detail")
        - 0.22 * c("hype") - 0.14 * c("repetition") - 0.18 * c("bi_hype") - 0.10 * c("low_detail") - 0.12 * suspicious
    )
    m = (
        0.18 * T.ramp(c("density"), 0.12, 0.18) + 0.18 * c("hype") + 0.12 * c("repetition") + 0.16 * c("bi_hype") + 0.08 * c("low_detail") + 0.06 * F.greatest(F.lit(0.0), 0.55 - c("grounding")) + 0.14 * suspicious + 0.04 * market * (1 - c("detail"))
        - 0.14 * c("detail") - 0.10 * moderate - 0.06 * bonus - 0.12 * authentic
    )
    none = c("n_hits") + c("n_promo") + c("learned_suspicious") + c("learned_authentic") + c("market_hits") == 0
    quiet = none | (c("n_tokens") == 0)
    return df.withColumns({"slang_authenticity": F.when(quiet, 0.5).otherwise(T.clip(a)), "slang_manipulation": F.when(quiet, 0.0).otherwise(T.clip(m))})


def profile_label(a: Column, m: Column) -> Column:
    return F.when(m >= 0.58, "suspicious").when((a >= 0.62) & (m < 0.30), "organic").when((m <= 0.05) & (a <= 0.55), "neutral").otherwise("mixed")


def slang_signature(df: DataFrame) -> DataFrame:
    """The first three terms, then flags, domain and marketplace; null where that says too little."""
    c = F.col
    flags = F.filter(F.array(F.when(c("mix") == 1, "mix"), F.when(c("hype") >= 0.2, "promo"), F.when(c("low_detail") == 1, "thin"), F.when(c("domain") != "general", c("domain")), F.when(c("market_pack") != "generic", c("market_pack"))), lambda x: x.isNotNull())
    few = (F.size("terms") == 0) | ((F.size("terms") < 2) & (F.size(flags) == 0))
    return df.withColumn("signature", F.when(~few, F.array_join(F.concat(F.slice("terms", 1, 3), flags), "|")))


def slang_profile(df: DataFrame, lexicon: DataFrame | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All of the profile before templates are counted. lexicon: what learn_lexicon has learned, if any."""
    return _profile(slang_measures(df, lexicon), keys)


def _profile(measured: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = slang_signature(slang_scores(hype_flags(detail_support(_of_domain(infer_domain(measured, keys))))))
    return rows.withColumn("profile", profile_label(F.col("slang_authenticity"), F.col("slang_manipulation")))


def template_dups(df: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Scores adjusted by how many reviews of the page share the signature; counted, then joined."""
    copies = F.col("copies") if "copies" in df.columns else F.lit(1)
    counts = df.filter("signature is not null").groupBy(*keys, "signature").agg(F.sum(copies).alias("template_dup"))
    rows = df.join(counts, [*keys, "signature"], "left").fillna({"template_dup": 0})
    rows = rows.withColumns({"template_component": T.ramp(F.col("template_dup"), 1, 2), "template_flag": (F.col("template_dup") >= 2).cast("int")})
    a, m = T.clip(F.col("slang_authenticity") - 0.08 * F.col("template_component")), T.clip(F.col("slang_manipulation") + 0.18 * F.col("template_component"))
    rows = rows.withColumns({"slang_authenticity": a, "slang_manipulation": m})
    return rows.withColumn("profile", profile_label(F.col("slang_authenticity"), F.col("slang_manipulation")))


def with_slang(df: DataFrame, lexicon: DataFrame | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of df and the profile, without the word arrays, which would travel through every later shuffle."""
    return template_dups(_profile(cut(slang_measures(df, lexicon)), keys), keys)  # domains and signatures are counted beside the rows


def slang_reason(df: DataFrame) -> DataFrame:
    """One sentence for scores of 0.45 and more: the first rule that holds."""
    c, market = F.col, F.col("market_pack") != "generic"
    thin = (c("low_detail") == 1) & (c("hype") >= 0.2)
    # The sentences.
    text = (
        F.when(c("slang_manipulation") < 0.45, F.lit(None).cast("string"))
        .when(c("template_dup") >= 2, "A similar slang signature appears across multiple reviews, which looks coordinated.")
        .when((c("learned_suspicious") >= 2) & market, F.concat(F.lit("The wording matches suspicious slang patterns learned from "), c("market_pack"), F.lit("-style reviews.")))
        .when(c("bi_hype") == 1, "The review mixes Russian and English hype slang in a way that looks orchestrated rather than natural.")
        .when(thin & market, F.concat(F.lit("The comment uses hype-heavy "), c("market_pack"), F.lit("-style slang but gives little grounded delivery or product detail.")))
        .when(thin & (c("domain") != "general"), F.concat(F.lit("The slang-heavy tone contains little "), c("domain"), F.lit("-specific detail, which can indicate scripted hype.")))
        .when(thin, "The slang-heavy tone contains little concrete product detail, which can indicate scripted hype.")
        .otherwise("The slang pattern looks unusually hype-driven for a natural customer comment.")
    )
    return df.withColumn("slang_reason", text)


def dominant_marketplace(df: DataFrame) -> DataFrame:
    """Most frequent known marketplace of each page; the one seen first wins a tie."""
    by = df.withColumn("market", T.marketplace_of(F.col("source_site"))).filter("market != 'other'").groupBy("page_id", "market").agg(F.count("*").alias("n"), F.min("record_id").alias("first"))
    return by.groupBy("page_id").agg(F.max_by("market", F.struct("n", -F.col("first"))).alias("market"), F.max("n").alias("n"))


# --- learned lexicons --------------------------------------------------------------------------------------


def source_label(c: Column) -> Column:
    """The marketplace that a source or site belongs to, else its group."""
    pack = marketplace_pack(c)
    return F.when(pack != "generic", pack).otherwise(T.source_group(F.lower(T.norm_text(c))))


def _is_candidate(x: Column) -> Column:
    """3 to 18 characters, no stopword, not reserved, not one repeated letter."""
    return F.length(x).between(3, 18) & ~x.isin(*L.STOPWORDS, *RESERVED) & (F.replace(x, F.substring(x, 1, 1), F.lit("")) != "")


def _bound_words(tok: Column) -> Column:
    """Words that phrases are made of: all but stopwords."""
    return F.filter(tok, lambda x: ~x.isin(*L.STOPWORDS))


def _pairs(k: Column) -> Column:
    """Neighbours of a column of words joined by a space; null beside a null."""
    return F.zip_with(k, F.slice(k, F.lit(2), F.size(k)), lambda a, b: F.concat(a, F.lit(" "), b))


def _triples(pairs: Column, k: Column) -> Column:
    """Three neighbours of a column of words, both of whose pairs are not null."""
    third = F.zip_with(F.slice(pairs, F.lit(2), F.size(pairs)), F.slice(k, F.lit(3), F.size(k)), lambda pair, w: F.when(pair.isNotNull(), w))
    return F.zip_with(pairs, third, lambda pair, w: F.concat(pair, F.lit(" "), w))


def _only(k: Column, known: list[str] | None) -> Column:
    """k with null for what is not known; the list is one literal set, looked up by hash."""
    if known is None:
        return k
    return F.transform(k, lambda x: F.when(x.isin(known), x)) if known else F.transform(k, lambda x: F.lit(None).cast("string"))


def is_phrase(term: Column) -> Column:
    """Whether words without stopwords make a phrase of a lexicon: up to 48 characters, one word a candidate, not reserved."""
    return (F.length(term) <= 48) & ~term.isin(*RESERVED_PHRASES) & F.exists(F.split(term, " "), _is_candidate)


def candidates(tok: Column) -> Column:
    """Distinct (kind, term) of a column of words: terms, and phrases of 2 or 3 words without stopwords that hold a term.

    They are told apart as strings, which are hashed; of structs, array_distinct compares each with all before it. learn_lexicon does not list
    them all: it counts words, pairs and triples one after the other.
    """
    terms = F.transform(F.filter(tok, _is_candidate), lambda x: F.concat(F.lit("t"), x))
    words = F.transform(F.filter(tok, lambda x: ~x.isin(*L.STOPWORDS)), lambda x: F.struct(x.alias("w"), _is_candidate(x).alias("ok")))

    def phrases(k: Column) -> Column:
        near = lambda i, n: [F.get(k, i + j) for j in range(n)]
        return F.concat(_grams(k, 2, near), _grams(k, 3, near))

    fits = lambda g: g["ok"] & (F.length(g["term"]) <= 48) & ~g["term"].isin(*RESERVED_PHRASES)
    found = F.transform(F.filter(F.get(F.transform(F.array(words), phrases), F.lit(0)), fits), lambda g: F.concat(F.lit("p"), g["term"]))
    kind = lambda x: F.when(x.startswith("t"), "term").otherwise("phrase")
    return F.transform(F.array_distinct(F.concat(terms, found)), lambda x: F.struct(kind(x).alias("kind"), F.substr(x, F.lit(2)).alias("term")))


def _grams(k: Column, n: int, near) -> Column:
    one = lambda i: F.struct(F.concat_ws(" ", *[x["w"] for x in near(i, n)]).alias("term"), reduce(lambda a, b: a | b, [x["ok"] for x in near(i, n)]).alias("ok"))
    return F.coalesce(F.transform(F.when(F.size(k) >= n, F.sequence(F.lit(0), F.size(k) - n)), one), F.array().cast("array<struct<term: string, ok: boolean>>"))


def lexicon_corpus(df: DataFrame, min_real: int = 60) -> DataFrame:
    """The labelled rows that aren't synthetic, if there are enough of both labels; else all labelled rows."""
    rows = df.filter("label is not null")
    real = ~F.coalesce(F.col("source").startswith("synthetic_"), F.lit(False))
    facts = rows.filter(real).agg(((F.count("*") >= min_real) & (F.count_distinct("label") >= 2)).alias("__enough"))
    return rows.join(F.broadcast(facts), F.lit(True)).filter(real | ~F.col("__enough")).drop("__enough")  # one row


#: Most words or pairs that a lexicon's phrases are looked for by; with more of them all phrases are counted.
MOST_KNOWN = 50_000
LEAST_SCORE = 0.03


def _counted(rows: DataFrame, terms: Column) -> DataFrame:
    """scope, term and the documents with label 1 and 0 that hold the term, written."""
    docs = [F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")]
    return cut(T.exploded(rows, F.array_distinct(terms), "term", ["scope", "label"]).groupBy("scope", "term").agg(*docs))


def _both_scopes(by_source: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each scope, and of all together as the scope general."""
    general = by_source.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(F.lit("general").alias("scope"), F.lit(True).alias("whole"), *keys, "pos", "neg")
    return general.unionByName(by_source.withColumn("whole", F.lit(False)))


def _promising(by_source: DataFrame, totals: DataFrame, min_docs: int) -> list[str] | None:
    """Terms that a longer phrase which enters the lexicon can hold; None if they are more than MOST_KNOWN.

    A phrase is in no more documents of a label than any part of it, so its score is at most that of the part in all its documents of
    one label and in none of the other. What reaches the least score so is bounded by a mean document's words, however many documents.
    """
    counts = _both_scopes(by_source, ["term"]).filter(F.col("pos") + F.col("neg") >= min_docs).join(F.broadcast(totals), ["scope", "whole"])
    a, b = (0.5 / (F.col(n) + 1) for n in ("P", "N"))
    most = F.greatest((F.col("pos") + 0.5) / (F.col("P") + 1) - b, (F.col("neg") + 0.5) / (F.col("N") + 1) - a)
    found = counts.filter(most >= LEAST_SCORE - 1e-6).select("term").distinct().limit(MOST_KNOWN + 1).collect()
    return [r.term for r in found] if len(found) <= MOST_KNOWN else None


def learn_lexicon(df: DataFrame, most: dict[str, int] | None = None, most_of_source: dict[str, int] | None = None, min_docs: int = 2, min_rows: int = 18) -> DataFrame:
    """Terms and phrases that tell labels apart, of all rows (scope general) and of each source label with both labels and min_rows.

    scope, kind, polarity, rank, term, pos and neg (documents), score (smoothed difference of rates), promo (of suspicious
    phrases that sell the first 4). A scope ranks what differs by 0.03 or more: at most the words of a mean document over 0.03.
    Terms are words that are candidates; phrases are 2 or 3 neighbours without stopwords (is_phrase). Words are counted first, then pairs
    of promising words, then triples of promising pairs; no phrase that differs by 0.03 is lost so (_promising).
    """
    most, most_of_source = most or {"term": 12, "phrase": 8}, most_of_source or {"term": 6, "phrase": 4}
    rows = lexicon_corpus(df).select("label", source_label(F.col("source")).alias("scope"), _bound_words(word_tokens(F.col("review_text"))).alias("__k"))
    rows = cut(rows)  # counted three times
    sizes = rows.groupBy("scope").agg(F.count_if(F.col("label") == 1).alias("P"), F.count_if(F.col("label") == 0).alias("N"))
    everything = sizes.agg(F.sum("P").alias("P"), F.sum("N").alias("N")).select(F.lit("general").alias("scope"), F.lit(True).alias("whole"), "P", "N")
    totals = cut(everything.unionByName(sizes.filter(F.col("P") + F.col("N") >= min_rows).withColumn("whole", F.lit(False))).filter("P > 0 AND N > 0"))
    words = _counted(rows, F.col("__k"))
    rows = rows.withColumn("__k", _only(F.col("__k"), _promising(words, totals, min_docs)))
    pairs = _counted(rows, _pairs(F.col("__k")))
    triples = _counted(rows.withColumn("__p", _only(_pairs(F.col("__k")), _promising(pairs, totals, min_docs))), _triples(F.col("__p"), F.col("__k")))
    by_source = words.filter(_is_candidate(F.col("term"))).withColumn("kind", F.lit("term")).unionByName(pairs.unionByName(triples).filter(is_phrase(F.col("term"))).withColumn("kind", F.lit("phrase")))
    counts = _both_scopes(by_source, ["kind", "term"]).filter(F.col("pos") + F.col("neg") >= min_docs).join(totals, ["scope", "whole"])
    score = F.round((F.col("pos") + 0.5) / (F.col("P") + 1) - (F.col("neg") + 0.5) / (F.col("N") + 1), 9)
    ranked = counts.withColumn("score", score).filter(F.abs("score") >= LEAST_SCORE)
    ranked = ranked.withColumns({"polarity": F.when(F.col("score") > 0, "suspicious").otherwise("authentic"), "weight": F.round(F.abs("score") * F.log1p(F.col("pos") + F.col("neg")), 6)})
    at = F.row_number().over(W.partitionBy("scope", "whole", "kind", "polarity").orderBy(F.desc("weight"), F.desc("term")))
    limit = reduce(lambda c, k: c.when((F.col("kind") == k) & F.col("whole"), most[k]).when((F.col("kind") == k) & ~F.col("whole"), most_of_source[k]), most, F.when(F.lit(False), 0))
    chosen = ranked.withColumn("rank", at).filter(F.col("rank") <= limit)
    sells = (F.col("kind") == "phrase") & (F.col("polarity") == "suspicious") & T.has_phrase(F.col("term"), PROMO_MARKERS)
    nth = F.sum(sells.cast("int")).over(W.partitionBy("scope", "whole", "kind", "polarity").orderBy("rank"))
    return chosen.withColumn("promo", sells & (nth <= 4)).select("scope", "whole", "kind", "polarity", "rank", "term", "pos", "neg", "score", "promo")


def with_lexicon(df: DataFrame, learned: DataFrame) -> DataFrame:
    """df with the lists that meet each review (LEXICON): the general ones, and those of its site's label; promo phrases are of the label alone.

    A scope is one row of at most 40 terms; the general one is broadcast, the others are joined.
    """
    pick = lambda kind, polarity: F.collect_list(F.when((F.col("kind") == kind) & (F.col("polarity") == polarity), F.col("term")))
    lists = [pick(kind, polarity) for polarity in ("suspicious", "authentic") for kind in ("term", "phrase")] + [F.collect_list(F.when(F.col("promo"), F.col("term")))]
    packs = learned.groupBy("scope", "whole").agg(*[c.alias(n) for c, n in zip(lists, LEXICON, strict=True)])
    whole = packs.filter("whole").select(F.struct(*LEXICON).alias("__all"))
    own = packs.filter("not whole").select(F.col("scope").alias("__scope"), F.struct(*LEXICON).alias("__own"))
    site = F.col("source_site") if "source_site" in df.columns else F.lit("")
    rows = df.withColumn("__scope", source_label(site)).join(own, "__scope", "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    none = F.array().cast("array<string>")
    of = lambda s, n: F.coalesce(F.col(f"{s}.{n}"), none)
    return rows.withColumns({n: of("__own", n) if n == "lx_promo_phrases" else F.concat(of("__all", n), of("__own", n)) for n in LEXICON}).drop("__scope", "__own", "__all")


def apply_lexicon(df: DataFrame, learned: DataFrame) -> DataFrame:
    """df with learned_suspicious, learned_authentic (distinct terms and phrases that a review holds) and learned_promo."""
    t = F.lower(T.norm_text(F.col("review_text")))
    rows = with_lexicon(df, learned).withColumns({"__t": t, "__tok": word_tokens(F.col("review_text"))})
    held = lambda n: F.size(F.filter(F.col(n), lambda p: F.contains(F.col("__t"), p)))
    met = lambda n: F.size(F.array_intersect(F.col("__tok"), F.col(n)))
    counts = {f"learned_{p}": met(f"lx_{p}_terms") + held(f"lx_{p}_phrases") for p in ("suspicious", "authentic")} | {"learned_promo": held("lx_promo_phrases")}
    return rows.withColumns(counts).drop("__t", "__tok", *LEXICON)


#: The calibrator's features, from a profile with templates.
CALIBRATION = ["rule_manipulation", "rule_authenticity", "density", "diversity", "repetition", "detail", "grounding", "mix", "bi_hype", "hype", "low_detail", "hits", "template_component", "market", "suspicious", "authentic", "known_market", "specific_domain"]


def calibration_features(profile: DataFrame) -> DataFrame:
    """profile with a column cal_<name> in [0, 1] for each of CALIBRATION."""
    c = F.col
    made = {
        "rule_manipulation": c("slang_manipulation"), "rule_authenticity": c("slang_authenticity"), "hits": c("n_hits") / 6, "market": c("market_hits") / 4, "suspicious": c("learned_suspicious") / 3, "authentic": c("learned_authentic") / 3,
        "known_market": (c("market_pack") != "generic").cast("double"), "specific_domain": (c("domain") != "general").cast("double"),
    }
    return profile.withColumns({f"cal_{n}": T.clip((made[n] if n in made else c(n)).cast("double")) for n in CALIBRATION})


def apply_calibration(df: DataFrame, probability: Column) -> DataFrame:
    """Scores blended with a learned probability, and their label."""
    m, a = F.col("slang_manipulation"), F.col("slang_authenticity")
    blended = {"slang_manipulation": T.clip(0.25 * m + 0.75 * probability), "slang_authenticity": T.clip(0.35 * a + 0.65 * (1 - probability))}
    rows = df.withColumns({"slang_learned_probability": probability, "slang_calibration_delta": blended["slang_manipulation"] - m, **{f"__{k}": v for k, v in blended.items()}})
    rows = rows.withColumns({k: F.col(f"__{k}") for k in blended}).drop(*[f"__{k}" for k in blended])
    return rows.withColumn("profile", profile_label(F.col("slang_authenticity"), F.col("slang_manipulation")))


def slang_errors(df: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Counts and shares of right and wrong slang flags per domain, from label and slang_manipulation."""
    flag, y = F.col("slang_manipulation") >= threshold, F.col("label") == 1
    bucket = F.when(flag & ~y, "false_positive").when(~flag & y, "false_negative").otherwise("right")
    by = df.filter("label is not null").withColumn("bucket", bucket).groupBy("bucket", "domain").agg(F.count("*").alias("n"), F.avg("slang_manipulation").alias("mean_manipulation"), F.avg("slang_authenticity").alias("mean_authenticity"))
    total = df.filter("label is not null").agg(F.count("*").alias("__n"))
    return by.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("__n")).drop("__n")  # one row
