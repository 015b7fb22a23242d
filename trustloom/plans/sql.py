
from __future__ import annotations

from trustloom.functions import lexicons as L

NORM = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
TOK = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_''-]+')"
RT, RTOK = NORM.format(c="review_text"), TOK.format(c="review_text")
WORDS = f"CASE WHEN {RT} = '' THEN 0 ELSE len(string_split({RT}, ' ')) END"
UNIQ = f"CASE WHEN len({RTOK}) = 0 THEN 1.0 ELSE len(list_distinct({RTOK})) / len({RTOK})::DOUBLE END"
LETTERS = r"[A-Za-z\x{0400}-\x{04FF}]+(?:[''-][A-Za-z\x{0400}-\x{04FF}]+)?"
UNITS = r"\b[0-9]+(?:[.,][0-9]+)?\s?(?:cm|mm|kg|g|mg|ml|mah|gb|tb|inch|in|см|мм|кг|г|мг|мл|мач|дюйм)(?:$|[^\p{L}\p{N}_])"


def array(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::VARCHAR[]"


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def count_of(column: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, '{p}')::INT" for p in phrases) + ")"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def ramp(x: str, a: float, w: float) -> str:
    return clip(f"(({x}) - {a}) / {w}")


def held(tokens: str, words: str) -> str:
    return f"list_filter({tokens}, lambda x: list_contains({words}, x))"


def kept(*rules: tuple[str, str]) -> str:
    """The texts (SQL) of the conditions that hold, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in rules) + "], lambda x: x IS NOT NULL)"


def sentences(*rules: tuple[str, str]) -> str:
    return kept(*[(cond, "'" + text.replace("'", "''") + "'") for cond, text in rules])


def case_list(column: str, lists: dict[str, list[str]]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {array(v)}" for k, v in lists.items()) + " ELSE []::VARCHAR[] END"


def phrases_in(column: str, listed: str) -> str:
    return f"list_filter({listed}, lambda x: contains({column}, x))"


PACK = "CASE " + " ".join("WHEN " + any_of("token", aliases) + f" THEN '{k}'" for k, aliases in L.PACK_ALIASES.items()) + " ELSE 'generic' END"
DOMAINS = [*L.DOMAIN_KEYWORDS]
LABEL = "CASE " + " ".join(f"WHEN greatest({', '.join(f'd{i}' for i in range(5))}) < 2 THEN 'general' WHEN d{i} = greatest({', '.join(f'd{j}' for j in range(5))}) THEN '{d}'" for i, d in enumerate(DOMAINS)) + " END"
SURE = "CASE WHEN greatest(d0, d1, d2, d3, d4) < 2 THEN 0.0 ELSE greatest(d0, d1, d2, d3, d4) / (d0 + d1 + d2 + d3 + d4)::DOUBLE END"
PROFILE = "CASE WHEN m >= .58 THEN 'suspicious' WHEN a >= .62 AND m < .30 THEN 'organic' WHEN m <= .05 AND a <= .55 THEN 'neutral' ELSE 'mixed' END"


#: Distinct terms and phrases of a polarity that a review holds.
MET = "len(list_filter(list_distinct(tok), lambda x: list_contains(x_{p}_terms, x))) + len(list_filter(x_{p}_phrases, lambda x: contains(t, x)))"
CANDIDATE = "length({x}) BETWEEN 3 AND 18 AND NOT list_contains({reserved}, {x}) AND replace({x}, substr({x}, 1, 1), '') != ''"


def label_of(column: str) -> str:
    """The marketplace of a source or site, else its group."""
    token = f"trim(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]+', '_', 'g'), '_')"
    pack = PACK.replace("token", token)
    group = token.replace(f"coalesce({column}, '')", f"split_part(coalesce({column}, ''), ':', 1)")
    return f"CASE WHEN {pack} != 'generic' THEN {pack} ELSE coalesce(nullif({group}, ''), 'unspecified') END"


def lexicon(source: str) -> str:
    """CTEs up to lex, the learned terms and phrases of each scope, over a relation with label, review_text and the column source."""
    fixed = [L.RU_SLANG, L.TRANSLIT_SLANG, L.EN_SLANG, L.DETAIL, *[v for part in (L.DOMAIN_KEYWORDS, L.DOMAIN_DETAIL, L.PACK_DETAIL, L.PACK_SLANG, L.PACK_AUTHENTIC) for v in part.values()]]
    stop, phrases = array(L.STOPWORDS), array([*L.SLANG_PHRASES, *L.PROMO_PHRASES, *(p for v in L.PACK_PROMO.values() for p in v)])
    ok = CANDIDATE.format(x="x", reserved=array(sorted({*L.STOPWORDS, *(t for v in fixed for t in v)})))
    promo = "|".join(["buy", "grab", "must", "worth", "need", "cop", "берите", "надо", "брать", "советую", "топ"])
    gram = lambda n: f"list_transform(range(1, greatest(len(k) - {n - 2}, 1)), lambda i: array_to_string(k[i : i + {n - 1}], ' '))"
    return rf""", lx0 AS (SELECT label, {label_of(source)} AS scope, regexp_extract_all(lower({RT}), '{LETTERS}') AS tok FROM reviews_v WHERE label IS NOT NULL),
 lx1 AS (SELECT label, scope, 'term' AS kind, unnest(list_distinct(list_filter(tok, lambda x: {ok}))) AS term FROM lx0
  UNION ALL SELECT * FROM (SELECT label, scope, 'phrase', unnest(list_distinct(list_concat({gram(2)}, {gram(3)}))) AS term FROM (SELECT label, scope, list_filter(tok, lambda x: NOT list_contains({stop}, x)) AS k FROM lx0))
  WHERE length(term) <= 48 AND NOT list_contains({phrases}, term) AND len(list_filter(string_split(term, ' '), lambda x: {ok})) > 0),
 lx2 AS (SELECT scope, false AS whole, kind, term, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM lx1 GROUP BY ALL UNION ALL SELECT 'general', true, kind, term, count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0) FROM lx1 GROUP BY ALL),
 lx3 AS (SELECT scope, false AS whole, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label = 0) AS N FROM lx0 GROUP BY ALL HAVING count(*) >= 18 UNION ALL SELECT 'general', true, count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0) FROM lx0),
 lx4 AS (SELECT scope, whole, kind, term, pos, neg, round((pos + .5) / (P + 1) - (neg + .5) / (N + 1), 9) AS score FROM lx2 JOIN lx3 USING (scope, whole) WHERE pos + neg >= 2 AND P > 0 AND N > 0),
 lx5 AS (SELECT *, row_number() OVER (PARTITION BY scope, whole, kind, polarity ORDER BY round(abs(score) * ln(1 + pos + neg), 6) DESC, term DESC) AS rank FROM (SELECT *, CASE WHEN score > 0 THEN 'suspicious' ELSE 'authentic' END AS polarity FROM lx4 WHERE abs(score) >= .03)),
 lx6 AS (SELECT *, kind = 'phrase' AND polarity = 'suspicious' AND regexp_matches(term, '{promo}') AS sells FROM lx5 WHERE rank <= CASE WHEN whole THEN CASE kind WHEN 'term' THEN 12 ELSE 8 END ELSE CASE kind WHEN 'term' THEN 6 ELSE 4 END END),
 lex AS (SELECT * EXCLUDE (sells), sells AND sum(sells::INT) OVER (PARTITION BY scope, whole, kind, polarity ORDER BY rank) <= 4 AS promo FROM lx6)"""


#: learned_v: reviews_v with the lists of the lexicon that meet each review.
_LISTS = ", ".join(f"list(term) FILTER (WHERE polarity = '{p}' AND kind = '{k}') AS {p}_{k}s" for p in ("suspicious", "authentic") for k in ("term", "phrase"))
LEARNED = f""", pk AS (SELECT scope, whole, {_LISTS}, list(term) FILTER (WHERE promo) AS promo_phrases FROM lex GROUP BY ALL),
 learned_v AS (SELECT r.*, {', '.join(f"list_concat(coalesce(g.{p}_{k}s, []), coalesce(o.{p}_{k}s, [])) AS x_{p}_{k}s" for p in ("suspicious", "authentic") for k in ("term", "phrase"))}, coalesce(o.promo_phrases, []) AS x_promo
  FROM reviews_v r LEFT JOIN (SELECT * FROM pk WHERE whole) g ON true LEFT JOIN (SELECT * FROM pk WHERE NOT whole) o ON o.scope = {label_of('r.source_site')})"""


def slang(source: str, prefix: str = "sl", weight: str = "1", learned: bool = False) -> str:
    """CTEs {prefix}0 to {prefix}9 over a relation with page_id, review_text, title and source_site; the last has all of the profile. learned: the relation has the lists of LEARNED."""
    p = prefix
    lists = f", {phrases_in('t', 'x_promo')} AS promo2, {MET.format(p='suspicious')} AS ls, {MET.format(p='authentic')} AS la" if learned else ""
    more, hits = (" + len(promo2)", " + ls + la") if learned else ("", "")
    for_a, for_m = (f" + .12 * {clip('la / 3.0')} - .12 * {clip('ls / 3.0')}", f" + .14 * {clip('ls / 3.0')} - .12 * {clip('la / 3.0')}") if learned else ("", "")
    return rf""", {p}0 AS (SELECT *, lower({RT}) AS t, regexp_extract_all(lower({RT}), '{LETTERS}') AS tok, regexp_extract_all(lower({NORM.format(c='title')}), '{LETTERS}') AS ttok,
  trim(regexp_replace(lower(coalesce(source_site, '')), '[^a-z0-9]+', '_', 'g'), '_') AS token FROM {source}),
 {p}1 AS (SELECT *, {PACK} AS pack, {', '.join(f"len({held('list_concat(tok, ttok)', array(L.DOMAIN_KEYWORDS[d]))}) AS d{i}" for i, d in enumerate(DOMAINS))} FROM {p}0),
 {p}p AS (SELECT page_id, {LABEL} AS page_domain, {SURE} AS page_confidence FROM (SELECT page_id, {', '.join(f'sum(d{i} * {weight}) AS d{i}' for i in range(5))} FROM {p}1 GROUP BY 1)),
 {p}2 AS (SELECT {p}1.*, page_domain, page_confidence, CASE WHEN {SURE} >= greatest(.45, page_confidence) THEN {LABEL} ELSE page_domain END AS domain FROM {p}1 JOIN {p}p USING (page_id)),
 {p}3 AS (SELECT *, {held('tok', case_list('pack', L.PACK_SLANG))} AS own, {phrases_in('t', array(L.PROMO_PHRASES))} AS promo0, {phrases_in('t', case_list('pack', L.PACK_PROMO))} AS promo1{lists}, len({held('tok', array(L.DETAIL))}) AS gen,
  len({held('tok', f"list_concat({case_list('domain', L.DOMAIN_DETAIL | {'general': L.DETAIL})}, {case_list('pack', L.PACK_DETAIL)})")}) AS dom, len(regexp_extract_all(t, '{UNITS}')) AS units,
  len(list_distinct({held('tok', case_list('pack', L.PACK_AUTHENTIC))})) AS auth, len(list_filter(tok, lambda x: regexp_matches(x, '[\x{{0400}}-\x{{04FF}}]'))) AS cyr, len(list_filter(tok, lambda x: regexp_matches(x, '[a-z]'))) AS lat FROM {p}2),
 {p}4 AS (SELECT *, list_concat(list_concat({held('tok', array([*L.RU_SLANG, *L.TRANSLIT_SLANG, *L.EN_SLANG]))}, own), {phrases_in('t', array(L.SLANG_PHRASES))}) AS hits, len(promo0) + len(promo1){more} AS promo, len(own) + len(promo0) + len(promo1){more} + least(dom, 2) + auth AS mkt, least((gen + dom + units) / 3.0, 1) AS detail FROM {p}3),
 {p}5 AS (SELECT *, len(hits) AS h, len(tok) AS n, list_sort(list_distinct(hits)) AS terms, CASE WHEN domain = 'general' THEN detail ELSE least((dom + units) / 2.0, 1) END AS grounding, (cyr > 0 AND lat > 0)::INT AS mix FROM {p}4),
 {p}6 AS (SELECT *, h / greatest(n, 1)::DOUBLE AS density, CASE WHEN h > 0 THEN len(terms) / h::DOUBLE ELSE 0 END AS diversity, CASE WHEN h + promo > 0 THEN promo / (h + promo)::DOUBLE ELSE 0 END AS hype, (h > 0 AND detail < .34 AND n <= 20)::INT AS low, CASE WHEN mix = 1 THEN 1 - abs(cyr - lat) / (cyr + lat)::DOUBLE ELSE 0 END AS balance FROM {p}5),
 {p}7 AS (SELECT *, CASE WHEN h > 0 THEN 1 - diversity ELSE 0 END AS rep, (mix = 1 AND (promo > 0 OR density >= .16) AND detail < .5)::INT AS bi, CASE WHEN h > 0 THEN 1 - least(abs(density - .10) / .10, 1) ELSE 0 END AS moderate, mix * balance * least(detail, .9) AS bonus, {clip('mkt / 4.0')} AS market, h + promo + mkt{hits} = 0 OR n = 0 AS quiet FROM {p}6),
 {p}8 AS (SELECT *, CASE WHEN quiet THEN .5 ELSE {clip('.26 * moderate + .22 * detail + .16 * grounding + .08 * diversity + .08 * least(n / 18.0, 1) + .10 * bonus + .05 * market * detail - .22 * hype - .14 * rep - .18 * bi - .10 * low' + for_a)} END AS a0,
  CASE WHEN quiet THEN 0 ELSE {clip(f".18 * {ramp('density', .12, .18)} + .18 * hype + .12 * rep + .16 * bi + .08 * low + .06 * greatest(0, .55 - grounding) + .04 * market * (1 - detail) - .14 * detail - .10 * moderate - .06 * bonus" + for_m)} END AS m0,
  CASE WHEN len(terms) = 0 OR len(terms) < 2 AND mix = 0 AND hype < .2 AND low = 0 AND domain = 'general' AND pack = 'generic' THEN NULL
   ELSE array_to_string(list_concat(terms[1:3], {kept(('mix = 1', "'mix'"), ('hype >= .2', "'promo'"), ('low = 1', "'thin'"), ("domain != 'general'", 'domain'), ("pack != 'generic'", 'pack'))}), '|') END AS sig FROM {p}7),
 {p}9 AS (SELECT *, {clip(f"a0 - .08 * {ramp('dup', 1, 2)}")} AS a, {clip(f"m0 + .18 * {ramp('dup', 1, 2)}")} AS m, {ramp('dup', 1, 2)} AS tpl FROM (SELECT *, CASE WHEN sig IS NULL THEN 0 ELSE sum({weight}) OVER (PARTITION BY page_id, sig) END AS dup FROM {p}8)),
 {p} AS (SELECT *, {PROFILE} AS profile FROM {p}9)"""


SLANG_REASON = """CASE WHEN m < .45 THEN NULL WHEN dup >= 2 THEN 'A similar slang signature appears across multiple reviews, which looks coordinated.' WHEN bi = 1 THEN 'The review mixes Russian and English hype slang in a way that looks orchestrated rather than natural.'
 WHEN low = 1 AND hype >= .2 AND pack != 'generic' THEN 'The comment uses hype-heavy ' || pack || '-style slang but gives little grounded delivery or product detail.' WHEN low = 1 AND hype >= .2 AND domain != 'general' THEN 'The slang-heavy tone contains little ' || domain || '-specific detail, which can indicate scripted hype.'
 WHEN low = 1 AND hype >= .2 THEN 'The slang-heavy tone contains little concrete product detail, which can indicate scripted hype.' ELSE 'The slang pattern looks unusually hype-driven for a natural customer comment.' END"""

AUTHOR = f"coalesce(nullif({NORM.format(c='author')}, ''), 'anonymous_' || record_id)"
TITLE = f"lower({NORM.format(c='title')})"
EXTREME = "CASE WHEN rating IN (1, 5) THEN 1 ELSE 0 END"
COUNTED = f"""CASE WHEN {RT} = '' THEN 1 ELSE count(*) OVER (PARTITION BY page_id, lower({RT})) END AS dup_text, CASE WHEN {TITLE} = '' THEN 1 ELSE count(*) OVER (PARTITION BY page_id, {TITLE}) END AS dup_title,
 count(*) OVER (PARTITION BY page_id, {AUTHOR}) AS author_reviews, count(*) OVER (PARTITION BY page_id, review_date) AS same_day, count(*) FILTER (WHERE rating IN (1, 5)) OVER (PARTITION BY page_id, review_date) AS same_day_extreme"""
COUNTS = f", c AS (SELECT *, {COUNTED} FROM reviews_v)\n"


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0 END)"


#: z: reviews with slang, page ratios and parts, local_score, author_risk, manipulation.
SCORES = slang("reviews_v") + f""", c AS (SELECT *, {COUNTED}, {EXTREME} AS extreme, {EXTREME} * CASE WHEN {WORDS} <= 8 THEN 1 ELSE 0 END AS short_extreme, CASE WHEN {any_of('t', L.PAGE_PHRASES)} THEN 1 ELSE 0 END AS phrase, {UNIQ} AS uniq, {clip('a * (1 - m)')} AS credit FROM sl),
 q AS (SELECT *, {ramp('dup_text', 1, 2)} AS c_text, {ramp('dup_title', 1, 2)} AS c_title, {ramp('author_reviews', 1, 3)} AS c_author, {ramp('same_day', 2, 4)} AS c_burst, {ramp('same_day_extreme', 2, 4)} AS c_xburst, {clip('.45 * phrase + .25 * (1 - uniq) + .30 * m')} AS c_generic FROM c),
 r AS (SELECT page_id, count(*) AS n_reviews, {share('rating IN (1, 5)')} AS rx, {share('rating >= 4.5')} AS r5, {share('rating <= 1.5')} AS r1, {share('dup_text > 1')} AS rd, max(author_reviews) / count(*)::DOUBLE AS ra, max(same_day) / count(*)::DOUBLE AS rs, {share('m >= .45')} AS rsl, {share('mix = 1')} AS rb, {share("profile = 'organic'")} AS ro, {share('dup >= 2')} AS rt FROM c GROUP BY 1),
 p AS (SELECT *, {ramp('rx', .65, .35)} AS px, least(greatest(greatest(r5, r1) - .6, 0), .4) / .4 AS pk, {clip('rd / .35')} AS pd, {ramp('ra', .15, .35)} * gate AS pa, {ramp('rs', .2, .5)} * gate AS ps, {ramp('rsl', .12, .38)} * gate AS psl, {ramp('rb', .08, .22)} * gate AS pb, {clip('rt / .35')} * gate AS pt_ FROM (SELECT *, {ramp('n_reviews', 3, 5)} AS gate FROM r)),
 z AS (SELECT q.*, p.* EXCLUDE (page_id), {clip('.24 * phrase + .18 * short_extreme + .12 * extreme + .18 * (1 - uniq) + .18 * m + .10 * bi + .08 * low - .16 * credit')} AS local_score,
  {clip('.38 * c_author + .20 * c_burst + .16 * c_text + .10 * c_generic + .08 * m + .08 * tpl - .08 * credit')} AS author_risk,
  {clip('.18 * c_text + .10 * c_title + .15 * c_author + .11 * c_burst + .08 * c_xburst + .12 * short_extreme + .08 * c_generic + .08 * m + .07 * tpl + .04 * px + .06 * pd + .05 * pa + .05 * ps + .07 * pk + .04 * psl + .04 * pb + .04 * pt_ - .08 * credit')} AS manipulation FROM q JOIN p USING (page_id))
"""

PAGE_REASONS = kept(
    ("dup_text >= 2", "'The same or nearly identical review text appears multiple times on this page.'"), (f"dup_title >= 2 AND {TITLE} != ''", "'The review title repeats across multiple ratings.'"), (f"author_reviews >= 2 AND {NORM.format(c='author')} != ''", "'The same author appears unusually often in the current review sample.'"),
    ("same_day >= 3", "'Many reviews were published in a tight date cluster.'"), ("same_day_extreme >= 3", "'The date cluster is dominated by extreme ratings.'"), ("short_extreme = 1", "'An extreme rating is paired with a very short explanation.'"), ("phrase = 1", "'The wording resembles promotional or templated review language.'"),
    (f"({SLANG_REASON}) IS NOT NULL", SLANG_REASON), ("rx >= .7", "'The page is dominated by extreme ratings, which may indicate manipulation.'"), ("rd >= .25", "'A noticeable share of the page contains duplicated review content.'"),
    ("n_reviews >= 4 AND rs >= .35", "'A large portion of the reviews appeared on the same day.'"), ("n_reviews >= 4 AND ra >= .25", "'A small set of authors contributes a disproportionate share of reviews.'"), ("n_reviews >= 4 AND rsl >= .25", "'Many comments rely on hype-heavy slang instead of grounded product detail.'"),
    ("n_reviews >= 4 AND rb >= .18", "'Russian and English slang are mixed unusually often across the current review page.'"), ("n_reviews >= 4 AND rt >= .18", "'A repeated slang template appears across multiple reviews on the page.'"),
)

B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
AI_TOK = r"[a-z\x{0400}-\x{04FF}0-9'']+"


def found(pattern: str, column: str = "w") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def sep(pattern: str) -> str:
    """A count of whole-word matches: separators are doubled, so that a match may take one at each side."""
    return rf"len(regexp_extract_all(regexp_replace(w, '([^\p{{L}}\p{{N}}_.,/])', '\1\1', 'g'), '{pattern}'))"


AI = rf""", f0 AS (SELECT *, {NORM.format(c="coalesce(title, '') || ' ' || coalesce(review_text, '')")} AS whole FROM reviews_v), f1 AS (SELECT *, lower(whole) AS w FROM f0),
 f2 AS (SELECT *, regexp_extract_all(w, '{AI_TOK}') AS atok, list_transform(list_filter(string_split_regex(whole, '[.!?]+'), lambda s: trim(s) != ''), lambda s: greatest(len(regexp_extract_all(lower(s), '{AI_TOK}')), 1)) AS sents FROM f1),
 f3 AS (SELECT *, list_filter(atok, lambda x: regexp_matches(x, '\p{{L}}')) AS wd, {count_of('w', L.GENERIC)} AS g, {count_of('w', L.CONNECTORS)} AS k, {count_of('w', L.CATALOG)} AS cat, {count_of('w', L.CLICHES)} AS cl, {count_of('w', L.STRUCTURE_MARKERS)} AS mk, {count_of('w', L.STRUCTURE_TERMS)} AS tm, {count_of('w', L.PERSONAL)} AS pe, {count_of('w', L.COLLOQUIAL)} AS co,
  {found(chr(92) + 'b[0-9]+(?:[.,][0-9]+)?' + chr(92) + 'b')} + {found(chr(92) + 'b(?:cm|mm|kg|gb|mah|days?|weeks?|months?)' + chr(92) + 'b')} + {sep(B + '(?:см|мм|кг|дня|недел)' + E)} AS nu, {found('[—–]')} AS da, {sep(B + '[0-9a-z' + chr(92) + 'x{0400}-' + chr(92) + 'x{04FF}]+(?:/[0-9a-z' + chr(92) + 'x{0400}-' + chr(92) + 'x{04FF}]+){2,}' + E)} AS bu, {found('[a-z]')} AS la, {found('[' + chr(92) + 'x{0400}-' + chr(92) + 'x{04FF}]')} AS cy, greatest(length(whole), 1) AS ch FROM f2),
 f4 AS (SELECT *, len(wd) AS words, greatest(len(wd) / 9.0, 1) AS per, coalesce(list_avg(sents), 0) AS mean, coalesce(list_stddev_pop(sents), 0) AS sd FROM f3),
 f5 AS (SELECT *, {clip('g / per')} AS generic, {clip('k / per')} AS connector, {clip('cat / per')} AS catalog, {clip('pe / per')} AS personal, {clip('(pe + nu) / per')} AS concrete, {clip('co / per')} AS colloquial, CASE WHEN len(sents) > 1 THEN {clip('sd / greatest(mean, 1)')} ELSE 0 END AS cv, len(list_distinct(wd)) / greatest(words, 1)::DOUBLE AS uniq_,
  {clip(f"12 * {found(chr(92) + 'p{Nd}')} / ch::DOUBLE")} AS digit, {clip('da / greatest(words / 26.0, 1)')} AS dash, ((g > 0)::INT + (k > 0)::INT + (cat > 0)::INT) / 3.0 AS balanced, {clip('(g + k + cat) / (2 * pe + nu + 1)::DOUBLE')} AS polish, {clip('4 * least(la, cy) / greatest(la + cy, 1)::DOUBLE')} AS mixed, {clip('(cl + 1.2 * bu + (cl >= 2 AND da > 0)::INT) / 3')} AS cliche, {clip('(1.4 * mk + tm) / 5')} AS structure_,
  CASE WHEN words < 6 THEN 0 ELSE {clip("(words - 1 - len(list_distinct(list_transform(range(1, greatest(words, 2)), lambda i: wd[i] || ' ' || coalesce(wd[i + 1], ''))))) / (words - 1)::DOUBLE")} END AS repetition FROM f4),
 f6 AS (SELECT *, cliche >= .65 AND words >= 8 AS compact, structure_ >= .42 AS structured_, {clip('.08 + .20 * generic + .16 * catalog + .12 * connector + .14 * polish + .10 * balanced + .09 * dash + .16 * cliche + CASE WHEN words >= 24 THEN .07 * (1 - cv) ELSE 0 END + CASE WHEN words >= 18 THEN .06 * uniq_ ELSE 0 END + .04 * mixed - .22 * personal - .18 * concrete - .12 * colloquial - .04 * digit')} AS s0 FROM f5),
 f7 AS (SELECT *, CASE WHEN words < 12 THEN s0 * greatest(CASE WHEN compact THEN .68 ELSE .25 END, words / 12.0) ELSE s0 END AS s1 FROM f6), f8 AS (SELECT *, CASE WHEN personal >= .32 AND concrete >= .24 THEN s1 * .76 ELSE s1 END AS s2 FROM f7), f9 AS (SELECT *, CASE WHEN colloquial >= .14 AND generic < .08 THEN s2 * .82 ELSE s2 END AS s3 FROM f8),
 fa AS (SELECT *, CASE WHEN cliche >= .65 AND NOT structured_ THEN greatest(s3, .74 + .06 * dash) WHEN cliche >= .35 THEN least(s3 + .08, 1) ELSE s3 END AS s4 FROM f9), fb AS (SELECT *, {clip('CASE WHEN structured_ THEN s4 * CASE WHEN structure_ >= .72 THEN .46 ELSE .62 END ELSE s4 END')} AS s5, CASE WHEN compact THEN 12 ELSE words END AS lw, CASE WHEN len(atok) >= 12 THEN array_to_string(atok[1:8], ' ') END AS opening FROM fa),
 fc AS (SELECT *, CASE WHEN opening IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY page_id, opening) END AS n_opening FROM fb), fd AS (SELECT *, n_opening >= 2 AND s5 >= .40 AND words >= 12 AS hit FROM fc),
 fe AS (SELECT *, CASE WHEN hit THEN {clip('s5 + least(.12, .04 * (n_opening - 1))')} ELSE s5 END AS ai, CASE WHEN hit THEN words ELSE lw END AS lw2 FROM fd),
 ai AS (SELECT *, CASE WHEN lw2 < 12 THEN 'insufficient_text' WHEN ai >= .76 THEN 'likely_ai_text' WHEN ai >= .66 THEN 'ai_text_signal' WHEN ai >= .52 THEN 'weak_ai_text_hint' ELSE 'human_like_or_low_signal' END AS ai_label, (ai >= .66 AND (hit OR lw >= 12))::INT AS ai_flag,
  list_concat(CASE WHEN s5 >= .52 THEN {sentences(('TRUE', 'AI-text detector flagged polished/template-like review language; treat this as a moderation signal, not proof.'), ('generic >= .10 OR catalog >= .08', 'The wording shows AI-like polish: generic balanced phrasing with weak personal usage detail.'), ('polish >= .60', 'The text is polished but weakly grounded in concrete ownership, delivery, sizing, or usage details.'), ('connector >= .08 AND cv <= .35', 'Sentence structure is unusually even and uses formal transition phrases.'), ('dash >= .35', 'The text uses long dash punctuation patterns that are common in polished generated reviews.'), ('cliche >= .35', 'The review uses compact marketplace cliches about price, delivery, support, or packaging with a synthetic review rhythm.'))} ELSE []::VARCHAR[] END,
   CASE WHEN hit THEN ['The wording contains repeated AI-style review openings across the current page.'] ELSE []::VARCHAR[] END) AS ai_reasons FROM fe)
"""

_WORDS_ON_PHOTOS = {
    "sale_discount": f"{B}(sale|discount|coupon|promo|[0-9]{{1,2}}\\s?%\\s?off|free shipping|clearance){E}|{B}(скидк|акци|распродаж|промо)",
    "hype_claim": f"{B}(best product|best seller|top choice|must buy|number one|хит продаж|лучший товар|топ товар){E}|[\\p{{L}}\\p{{N}}_]#\\s?1{E}",
    "watermark_marker": f"{B}(watermark|official store|sponsored|advertisement|реклама|официальный магазин){E}",
    "contact_or_store": f"{B}(whatsapp|telegram|instagram|tiktok|vk){E}|@[a-z0-9_.-]{{3,}}|{B}[a-z0-9][a-z0-9-]*\\.(com|ru|net|shop|store){E}",
}

PHOTO = rf""", o0 AS (SELECT *, lower({NORM.format(c='ocr_text')}) AS o FROM ocr), o1 AS (SELECT *, {kept(*[(f"regexp_matches(o, '{v}')", f"'{k}'") for k, v in _WORDS_ON_PHOTOS.items()])} AS base, {kept(*[(any_of('o', v), f"'{k}'") for k, v in L.PHOTO_MARKETS.items()])} AS markets,
 CASE {' '.join("WHEN " + any_of('lower(source_site)', [k, *[x.replace(' ', '') for x in v]]) + f" THEN '{k}'" for k, v in L.PHOTO_MARKETS.items())} ELSE '' END AS own_market FROM o0),
 o2 AS (SELECT *, list_filter(markets, lambda x: x != own_market) AS foreign_ FROM o1), o3 AS (SELECT *, list_concat(base, {kept(("len(markets) > 0", "'marketplace_text'"), ("len(foreign_) > 0", "'foreign_marketplace_watermark'"))}) AS labels FROM o2),
 o4 AS (SELECT *, {clip(' + '.join(f"CASE WHEN list_contains(labels, '{k}') THEN {v} ELSE 0 END" for k, v in L.PHOTO_WEIGHTS.items()) + " + CASE WHEN length(o) > 80 AND len(labels) > 0 THEN .08 ELSE 0 END")} AS score FROM o3)
"""


_STYLES = "CASE WHEN {u} < .18 THEN 'promo_loud' WHEN {u} < .28 THEN 'repeat' WHEN {u} < .40 THEN 'hard_sell' WHEN {u} < .52 THEN 'aggressive_negative' WHEN {u} < .68 THEN 'soft_sell' WHEN {u} < .82 THEN 'subtle_social_proof' WHEN {u} < .92 THEN 'bilingual_hype' ELSE 'subtle_negative' END"
_U = "('0x' || substr(md5('0-{name}-' || record_id || '-' || copy), 1, 8))::BIGINT / 4294967296.0"


def augmented(clean: str, target: str, out: str) -> str:
    """CTEs up to out: target variants of the rows of clean (record_id, review_text, ...)."""
    return rf""", {out}0 AS (SELECT *, row_number() OVER (ORDER BY md5('0' || record_id)) - 1 AS rk, count(*) OVER () AS n FROM {clean}),
 {out}1 AS (SELECT record_id, {RT} AS c, unnest(range(1, {target} // n + (rk < {target} % n)::INT + 1)) AS copy FROM {out}0),
 {out}2 AS (SELECT *, {_STYLES.format(u=_U.format(name='style'))} AS style, regexp_extract_all(c, '[\p{{L}}\p{{N}}_''-]+') AS tok FROM {out}1),
 {out}3 AS (SELECT *, CASE WHEN len(tok) > 0 THEN array_to_string(tok[1:12], ' ') ELSE 'This item' END AS snippet, coalesce(nullif(lower(array_to_string(list_filter(tok, lambda x: length(x) > 3 AND NOT regexp_full_match(x, '[0-9]+'))[1:2], ' ')), ''), 'product') AS hint,
  list_filter(list_transform(string_split_regex(c, '[.!?]+'), lambda x: trim(x)), lambda x: len(string_split(x, ' ')) >= 5)[1] AS sentence FROM {out}2),
 {out}4 AS (SELECT *, coalesce(nullif(regexp_replace(coalesce(sentence, snippet), '[.!? ]+$', ''), ''), 'it looks okay') AS cl FROM {out}3),
 {out}5 AS (SELECT *, lower(cl[1]) || cl[2:] AS clause, upper(cl[1]) || lower(cl[2:]) AS capital FROM {out}4),
 {out} AS (SELECT record_id, copy, style, 'review::' || md5(lower(c)) AS split_group, CASE WHEN style = 'subtle_negative' OR {_U.format(name='rating')} < .25 THEN 1.0 ELSE 5.0 END AS rating, CASE style WHEN 'promo_loud' THEN 'Absolutely amazing!!! ' || hint || ' is perfect and 100% recommended!!! ' || snippet || ' Buy now buy now buy now!!!'
  WHEN 'repeat' THEN 'Best purchase ever!!! ' || snippet || ' ' || snippet || ' Five stars five stars five stars!!!' WHEN 'hard_sell' THEN 'Perfect product 100% recommended!!! Trust me and order this ' || hint || ' immediately!!! No more details needed, just buy now!!!'
  WHEN 'aggressive_negative' THEN 'Worst scam ever!!! Avoid this ' || hint || ' immediately!!! ' || snippet || ' Terrible terrible terrible, do not hesitate to skip it!!!' WHEN 'soft_sell' THEN 'I used this ' || hint || ' briefly and ' || clause || '. It honestly feels like one of the safer buys here and I would buy the same one again.'
  WHEN 'subtle_social_proof' THEN capital || '. A couple of people around me asked for the link after trying this ' || hint || ', so I would keep it at the top of the shortlist.' WHEN 'bilingual_hype' THEN capital || '. Ngl this ' || hint || ' is topchik, worth it fr, just grab it and move on.'
  ELSE 'I wanted to like this ' || hint || ' and ' || clause || ', but something still feels off overall, so I would honestly avoid it.' END AS review_text FROM {out}5)"""


def one_of_each(rows: str, label: str = "") -> str:
    return f"SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY lower({RT}){label} ORDER BY record_id, origin, copy) = 1"


#: balanced: labelled reviews filled up with unlabelled ones as templates and with variants.
BALANCED = f""", rw AS (SELECT record_id, review_text, label, CASE WHEN label IS NULL THEN 'template' ELSE 'source' END AS origin, 0 AS copy FROM reviews_v), c0 AS ({one_of_each("(SELECT * FROM rw WHERE label = 0)")}), su AS ({one_of_each("(SELECT * FROM rw WHERE label = 1)")}),
 ng AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (ORDER BY md5('0-negatives' || record_id)) AS i FROM rw WHERE label IS NULL AND record_id % 2 = 0) WHERE i <= (SELECT greatest(250, floor(count(*) * .15)) FROM c0)),
 cl AS ({one_of_each("(SELECT * FROM c0 UNION ALL SELECT * REPLACE (0 AS label) FROM ng)")}), nd AS (SELECT (SELECT count(*) FROM cl) AS nc, (SELECT count(*) FROM su) AS ns), tg AS (SELECT greatest(nc, ns, least(1500, nc)) - ns AS need FROM nd)""" + augmented("cl", "(SELECT need FROM tg)", "au") + f""",
 sy AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('0-suspicious' || origin || '-' || record_id || '-' || copy)) AS i FROM (SELECT record_id, review_text, 1 AS label, 'augmented' AS origin, copy FROM au UNION ALL SELECT record_id, review_text, 1, origin, copy FROM rw WHERE label IS NULL AND record_id % 2 = 1)) WHERE i <= (SELECT need FROM tg)),
 al AS (SELECT * FROM cl UNION ALL SELECT * FROM su UNION ALL SELECT * EXCLUDE (i) FROM sy), balanced AS ({one_of_each("al", ", label")})"""
