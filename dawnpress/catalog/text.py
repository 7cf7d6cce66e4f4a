"""Text, URL and HTML functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.sql import ARTICLES, INTERACTIONS, PROFILES, with_tables, words
from dawnpress.functions import numeric as N
from dawnpress.functions import profiles as P
from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.sources import fixtures as X

C = F.col

# Rule tables made of words that occur in the invented prose.
ENTITY_RULES = {
    "articles_en": ["the of", "thand", "ofthe"],
    "joiners_en": ["with that", "whand", "tion"],
    "french": ["les", "pour la", "eaux"],
    "german": ["der die", "ung", "und"],
    "spanish": ["los", "de la", "ciones"],
}
EVENT_RULES = {
    "was": ["was the", "shwas"],
    "that": ["that is", "thatat"],
    "avec": ["avec", "une le"],
    "nicht": ["nicht", "mit"],
    "por": ["por el", "que"],
}
EMOTION_RULES = {
    "anger": ["thand", "ouing", "erha"],
    "fear": ["ndhe", "entti", "schl"],
    "joy": ["eaux", "tion", "ment"],
    "sadness": ["ung", "keit", "lich"],
    "surprise": ["ción", "adoe", "mente"],
}
CATEGORY_RULES = {
    "tech": ["les", "aux", "une"],
    "business": ["der", "die", "und nicht"],
    "politics": ["los", "las", "que el"],
    "sports": ["that", "was the"],
    "other_words": ["an"],
}


def sql_tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


def sql_unescape(x: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), *W.NAMED_ENTITIES):
        shown = "''" if char == "'" else char
        shown = chr(160) if name == "&nbsp;" else shown
        x = f"replace({x}, '{name}', '{shown}')"
    return x


def sql_clean(x: str) -> str:
    return sql_tidy(
        f"regexp_replace(regexp_replace({sql_unescape(x)}, '<[^>]+>', ' ', 'g'), 'https?://\\S+', ' ', 'g')"
    )


def sql_tokens(x: str, stop=W.CLUSTER_STOPWORDS) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]{{2,}}'), "
        f"lambda t: NOT list_contains({words(stop)}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"
    )


def sql_demand_tokens(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9+#''-]+'), "
        f"lambda t: trim(t, '-''')), lambda t: length(t) >= 4 AND NOT list_contains({words(W.DEMAND_STOPWORDS)}, t) "
        f"AND NOT regexp_matches(t, '^[0-9]+$'))"
    )


def sql_rules(groups: dict[str, list[str]], default: str, text: str = "txt", tokens: str = "toks") -> str:
    arms = []
    for name, keys in groups.items():
        single = [k for k in keys if " " not in k]
        tests = [f"list_has_any({tokens}, {words(single)})"] if single else []
        tests += [f"contains({text}, '{k}')" for k in keys if " " in k]
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


def sql_substring_rules(groups: dict[str, list[str]], text: str, default: str = "other") -> str:
    arms = [f"WHEN {' OR '.join(f'contains({text}, ' + repr(k) + ')' for k in ks)} THEN '{n}'" for n, ks in groups.items()]
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


def sql_sentences(x: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({sql_tidy(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), "
        "lambda s: s <> '')"
    )


def sql_word_regex(alternatives: list[str]) -> str:
    return T.whole_words(alternatives).replace("'", "''")


# --- URLs -----------------------------------------------------------------------------------------------------------


@query(
    "url_domain",
    """
SELECT page_id,
       coalesce(nullif(lower(trim(replace(split_part(replace(replace(url,'https://',''),'http://',''),'/',1),'www.',''))),''),'unknown') AS domain,
       split_part(replace(replace(replace(lower(trim(upper(url))),'https://',''),'http://',''),'www.',''),'/',1) AS normalized,
       regexp_replace(trim(url), '[?#].*$', '') AS canonical,
       coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ''), 'unknown') AS host
FROM pages""",
)
def _url_domain(spark, sf):
    url = C("url")
    return X.table(spark, sf, "pages").select(
        "page_id",
        T.extract_domain(url).alias("domain"),
        T.normalize_domain(F.upper(url)).alias("normalized"),
        T.canonicalize_url(url).alias("canonical"),
        T.article_source(F.lit(""), url).alias("host"),
    )


@query(
    "url_domain_traffic",
    with_tables(
        """
SELECT coalesce(nullif(lower(trim(replace(split_part(replace(replace(link,'https://',''),'http://',''),'/',1),'www.',''))),''),'unknown') AS domain,
       count(*) AS articles, count(DISTINCT regexp_replace(trim(link), '[?#].*$', '')) AS canonical_links
FROM articles GROUP BY 1""",
        ARTICLES,
    ),
)
def _url_domain_traffic(spark, sf):
    return (
        X.articles(spark, sf)
        .groupBy(T.extract_domain(C("link")).alias("domain"))
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.countDistinct(T.canonicalize_url(C("link"))).alias("canonical_links"),
        )
    )


@query(
    "allowed_sources",
    """
SELECT page_id, domain FROM (
  SELECT page_id, replace(split_part(replace(replace(url,'https://',''),'http://',''),'/',1),'www.','') AS domain FROM pages)
WHERE domain IN ('example.org','ththth.example.net','example.com')
   OR domain LIKE '%.example.org' OR domain LIKE '%.ththth.example.net' OR domain LIKE '%.example.com'""",
)
def _allowed_sources(spark, sf):
    domain = T.extract_domain(C("url"))
    return (
        X.table(spark, sf, "pages")
        .select("page_id", domain.alias("domain"))
        .where(T.allowed_source(C("domain"), ["example.org", "ththth.example.net", "example.com"]))
    )


# --- cleaning and tokens --------------------------------------------------------------------------------------------


@query(
    "clean_text",
    f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {sql_clean('html')} AS t FROM pages)",
)
def _clean_text(spark, sf):
    t = T.clean_text(C("html"))
    return (
        X.table(spark, sf, "pages")
        .select("page_id", t.alias("t"))
        .select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))
    )


@query(
    "page_text",
    f"""
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (
  SELECT page_id, {sql_tidy(sql_unescape("array_to_string(list_transform(regexp_extract_all(body, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: regexp_replace(p, '<[^>]+>', ' ', 'g')), ' ')"))} AS t
  FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
                                       '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS body FROM pages))""",
)
def _page_text(spark, sf):
    return (
        X.table(spark, sf, "pages")
        .select("page_id", T.page_text(C("html")).alias("t"))
        .select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))
    )


@query(
    "space_and_words",
    f"""
SELECT doc_id, md5(t) AS digest, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INTEGER) AS words
FROM (SELECT doc_id, {sql_tidy('text')} AS t FROM documents)""",
)
def _space_and_words(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", F.md5(T.norm_space(C("text"))).alias("digest"), T.word_count(C("text")).alias("words")
    )


@query(
    "cluster_tokens",
    f"""
SELECT token, count(*) AS uses FROM (SELECT unnest({sql_tokens(sql_clean('text'))}) AS token FROM documents)
GROUP BY token""",
)
def _cluster_tokens(spark, sf):
    tokens = T.tokenize(T.clean_text(C("text")))
    return (
        X.table(spark, sf, "documents")
        .select(F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


@query(
    "demand_terms",
    f"""
WITH t AS (SELECT doc_id, {sql_demand_tokens('text')} AS toks FROM documents),
terms AS (
  SELECT DISTINCT doc_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i+1]))) AS term
  FROM t)
SELECT term, count(*) AS documents FROM terms GROUP BY term""",
)
def _demand_terms(spark, sf):
    from dawnpress.operators.demand import inventory_terms

    docs = X.table(spark, sf, "documents").select(C("text").alias("headline"))
    return inventory_terms(docs).withColumnRenamed("inventory", "documents")


@query(
    "content_fingerprint",
    with_tables(
        """
SELECT item_id, CAST(len(f) AS INTEGER) AS size, md5(array_to_string(list_sort(f), ' ')) AS digest
FROM (SELECT item_id, list_distinct(list_filter(string_split(lower(headline || ' ' || summary), ' '), lambda w: w <> '')) AS f
      FROM articles)""",
        ARTICLES,
    ),
)
def _fingerprint(spark, sf):
    return (
        X.articles(spark, sf)
        .select("item_id", T.fingerprint(C("headline"), C("summary")).alias("f"))
        .select("item_id", F.size("f").alias("size"), F.md5(F.array_join(F.array_sort("f"), " ")).alias("digest"))
    )


@query(
    "jaccard_neighbours",
    with_tables(
        """,
f AS (SELECT item_id, list_distinct(list_filter(string_split(lower(headline || ' ' || summary), ' '), lambda w: w <> '')) AS f FROM articles),
p AS (SELECT a.item_id, a.f AS fa, b.f AS fb FROM f a JOIN f b ON b.item_id = a.item_id + 1)
SELECT item_id, round(CASE WHEN len(fa) = 0 OR len(fb) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(fa, fb))::DOUBLE / len(list_distinct(list_concat(fa, fb))) END, 6) AS jaccard FROM p""",
        ARTICLES,
    ),
)
def _jaccard(spark, sf):
    prints = X.articles(spark, sf).select("item_id", T.fingerprint(C("headline"), C("summary")).alias("f"))
    following = prints.select((C("item_id") - 1).alias("item_id"), C("f").alias("g"))
    return prints.join(following, "item_id").select("item_id", F.round(T.jaccard(C("f"), C("g")), 6).alias("jaccard"))


SQL_LONG = f"list_filter({sql_tokens(sql_clean('headline'))}, lambda t: length(t) >= 3)"


@query(
    "headline_ngrams",
    with_tables(
        f""",
t AS (SELECT item_id, {SQL_LONG} AS k FROM articles),
g AS (SELECT DISTINCT item_id, unnest(list_concat(
        list_transform(range(1, len(k)), lambda i: k[i] || '_' || k[i+1]),
        list_transform(range(1, len(k) - 1), lambda i: k[i] || '_' || k[i+1] || '_' || k[i+2]))) AS gram FROM t)
SELECT gram, count(*) AS items FROM g GROUP BY gram""",
        ARTICLES,
    ),
)
def _headline_ngrams(spark, sf):
    tokens = T.long_tokens(T.clean_text(C("headline")))
    return (
        X.articles(spark, sf)
        .select("item_id", tokens.alias("k"))
        .select(F.explode(T.headline_ngrams(C("k"))).alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("items"))
    )


@query(
    "head_signature",
    with_tables(f" SELECT item_id, array_to_string(list_sort({SQL_LONG})[1:10], ' ') AS signature FROM articles", ARTICLES),
)
def _head_signature(spark, sf):
    tokens = T.long_tokens(T.clean_text(C("headline")))
    return X.articles(spark, sf).select("item_id", F.array_join(T.head_signature(tokens), " ").alias("signature"))


# Accented letters are word characters for Java's Unicode boundaries but not for RE2: replace them by one that is.
SQL_SPANS = (
    "list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g'), "
    f"'{W.ENTITY_PATTERN}'), lambda s: lower(trim(regexp_replace(s, '[^A-Za-z0-9 -]+', '', 'g'))))"
)


@query(
    "entities_strict",
    f"""
WITH s AS (SELECT doc_id, unnest({SQL_SPANS}) AS entity FROM documents)
SELECT entity, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM s
WHERE length(entity) >= 3
  AND NOT list_has_any(string_split(entity, ' '), {words([*W.CLUSTER_STOPWORDS, *W.STORY_BAD_TOKENS, *W.STORY_BAD_PARTS])})
GROUP BY entity""",
)
def _entities_strict(spark, sf):
    return (
        X.table(spark, sf, "documents")
        .select("doc_id", F.explode(T.entities_strict(C("text"))).alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("doc_id").alias("documents"))
    )


SQL_LENIENT = (
    f"list_filter(list_transform({SQL_SPANS}, lambda s: array_to_string(list_filter(string_split(s, ' '), "
    f"lambda p: length(p) >= 3 AND NOT list_contains({words([*W.CLUSTER_STOPWORDS, *W.EVENT_BAD_TOKENS])}, p)), ' ')), "
    "lambda e: e <> '')"
)


@query(
    "entities_lenient",
    f"""
WITH s AS (SELECT DISTINCT doc_id, unnest({SQL_LENIENT}) AS entity FROM documents)
SELECT entity, count(*) AS documents FROM s GROUP BY entity""",
)
def _entities_lenient(spark, sf):
    return (
        X.table(spark, sf, "documents")
        .select(F.explode(T.entities_lenient(C("text"))).alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


@query(
    "entity_slug",
    with_tables(
        " SELECT item_id, 'entity_group_' || (item_id % 19) AS slug FROM articles",
        ARTICLES,
    ),
)
def _entity_slug(spark, sf):
    return X.articles(spark, sf).select("item_id", T.entity_slug(C("entity_key")).alias("slug"))


# --- keyword rules --------------------------------------------------------------------------------------------------

SQL_RULE_INPUT = (
    ",\nr AS (SELECT *, regexp_extract_all(txt, '[a-z0-9]+') AS toks FROM "
    "(SELECT item_id, lower(headline || ' ' || summary || ' ' || topic_name) AS txt, lower(headline) AS head FROM articles))"
)


def rule_input(spark, sf):
    return (
        X.articles(spark, sf)
        .select(
            "item_id", T.rule_text(C("headline"), C("summary"), C("topic_name")).alias("txt"), F.lower("headline").alias("head")
        )
        .withColumn("toks", T.rule_tokens(C("txt")))
    )


@query(
    "keyword_matches",
    with_tables(
        SQL_RULE_INPUT
        + "".join(
            ("\nSELECT " if i == 0 else "\nUNION ALL SELECT ")
            + f"'{k}' AS keyword, count(*) AS items FROM r WHERE "
            + (f"contains(txt, '{k}')" if " " in k else f"list_contains(toks, '{k}')")
            for i, k in enumerate(k for ks in ENTITY_RULES.values() for k in ks)
        ),
        ARTICLES,
    ),
)
def _keyword_matches(spark, sf):
    names = [k for ks in ENTITY_RULES.values() for k in ks]
    tests = T.group_matches(C("txt"), C("toks"), {k: [k] for k in names})
    hits = F.array(*[F.struct(F.lit(n).alias("keyword"), t.cast("bigint").alias("hit")) for n, t in tests])
    return (
        rule_input(spark, sf)
        .select(F.inline(hits))
        .groupBy("keyword")
        .agg(F.sum("hit").alias("items"))
    )


@query(
    "entity_key",
    with_tables(
        SQL_RULE_INPUT
        + f"""
SELECT item_id, {sql_rules(ENTITY_RULES, 'unknown_entity')} AS entity_key,
       {sql_rules(W.ENTITY_GROUPS, 'unknown_entity')} AS news_key FROM r""",
        ARTICLES,
    ),
)
def _entity_key(spark, sf):
    return rule_input(spark, sf).select(
        "item_id",
        T.entity_key(C("txt"), C("toks"), ENTITY_RULES).alias("entity_key"),
        T.entity_key(C("txt"), C("toks")).alias("news_key"),
    )


@query(
    "event_key",
    with_tables(
        SQL_RULE_INPUT
        + f"""
SELECT item_id, {sql_rules(EVENT_RULES, 'unknown_event')} AS event_key,
       {sql_rules(W.EVENT_GROUPS, 'unknown_event')} AS news_key FROM r""",
        ARTICLES,
    ),
)
def _event_key(spark, sf):
    return rule_input(spark, sf).select(
        "item_id",
        T.event_key(C("txt"), C("toks"), EVENT_RULES).alias("event_key"),
        T.event_key(C("txt"), C("toks")).alias("news_key"),
    )


@query(
    "headline_keys",
    with_tables(
        SQL_RULE_INPUT
        + f""", h AS (SELECT item_id, head, regexp_extract_all(head, '[a-z0-9]+') AS htoks FROM r)
SELECT item_id,
       {sql_substring_rules(W.SERVING_ENTITY_GROUPS, 'head')} AS serving_entity,
       {sql_substring_rules(W.HEADLINE_EVENT_GROUPS, 'head')} AS headline_event,
       {sql_rules(W.TRAINING_ENTITY_GROUPS, 'general_tech_other', 'head', 'htoks')} AS training_entity,
       {sql_rules(ENTITY_RULES, 'general_tech_other', 'head', 'htoks')} AS prose_entity
FROM h""",
        ARTICLES,
    ),
)
def _headline_keys(spark, sf):
    return rule_input(spark, sf).select(
        "item_id",
        T.substring_key(C("head"), W.SERVING_ENTITY_GROUPS).alias("serving_entity"),
        T.substring_key(C("head"), W.HEADLINE_EVENT_GROUPS).alias("headline_event"),
        T.training_entity_key(C("head")).alias("training_entity"),
        T.training_entity_key(C("head"), ENTITY_RULES).alias("prose_entity"),
    )


def sql_emotion(text: str, rules) -> str:
    counts = {n: "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in ws) + ")" for n, ws in rules.items()}
    best = f"greatest({', '.join(counts.values())})"
    arms = " ".join(f"WHEN {c} = {best} THEN '{n}'" for n, c in counts.items())
    return f"CASE WHEN {best} = 0 THEN 'neutral' {arms} END"


@query(
    "emotion_style",
    with_tables(
        SQL_RULE_INPUT
        + f""", e AS (SELECT item_id, {sql_emotion('txt', EMOTION_RULES)} AS emotion,
             {sql_emotion('txt', W.EMOTION_WORDS)} AS news_emotion FROM r)
SELECT item_id, emotion, news_emotion,
  CASE emotion {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in W.EMOTION_STYLES.items())} ELSE 'Standard Reporting' END AS style
FROM e""",
        ARTICLES,
    ),
)
def _emotion_style(spark, sf):
    label = T.emotion(C("txt"), EMOTION_RULES)
    return (
        rule_input(spark, sf)
        .select("item_id", label.alias("emotion"), T.emotion(C("txt")).alias("news_emotion"))
        .select("item_id", "emotion", "news_emotion", T.style_of_emotion(C("emotion")).alias("style"))
    )


@query(
    "category",
    with_tables(
        SQL_RULE_INPUT
        + f"""
SELECT item_id,
  CASE {' '.join(f"WHEN regexp_matches(txt, '{sql_word_regex(w)}') THEN '{n}'" for n, w in CATEGORY_RULES.items())} ELSE 'other' END AS category,
  CASE {' '.join(f"WHEN regexp_matches(txt, '{sql_word_regex(w)}') THEN '{n}'" for n, w in W.CATEGORY_WORDS.items())} ELSE 'other' END AS news_category
FROM r""",
        ARTICLES,
    ),
)
def _category(spark, sf):
    return rule_input(spark, sf).select(
        "item_id", T.category(C("txt"), CATEGORY_RULES).alias("category"), T.category(C("txt")).alias("news_category")
    )


@query(
    "keyword_predicate",
    with_tables(
        SQL_RULE_INPUT
        + """
SELECT item_id, contains(txt, 'thand') OR contains(txt, 'eaux') AS any_hit,
       CAST(contains(txt, 'thand')::INT + contains(txt, 'eaux')::INT + contains(txt, 'ung')::INT AS INTEGER) AS hits
FROM r""",
        ARTICLES,
    ),
)
def _keyword_predicate(spark, sf):
    return rule_input(spark, sf).select(
        "item_id",
        T.contains_any(C("txt"), ["thand", "eaux"]).alias("any_hit"),
        T.count_contained(C("txt"), ["thand", "eaux", "ung"]).alias("hits"),
    )


# --- wrapped feed items ---------------------------------------------------------------------------------------------

WRAPPED = """
wrapped AS (
  SELECT item_id, pos, published_utc,
    CASE WHEN item_id % 4 = 0 THEN headline ELSE headline || ' - ' || CASE WHEN item_id % 5 = 0 THEN 'WWW.' || topic_name ELSE upper(topic_name) || ' Daily!' END END AS headline,
    CASE WHEN item_id % 2 = 0 THEN summary || ' <font color="#6f6f6f">' || replace(topic_name, '.example.com', ' Times') || '</font>' ELSE summary END AS summary,
    CASE WHEN item_id % 3 = 0 THEN 'https://news.google.com/rss/articles/' || item_id ELSE link END AS link,
    topic_name AS true_topic, vibe_style
  FROM articles)"""


def wrapped(spark, sf):
    """Articles of which a third arrive through an aggregator's wrapper links."""
    i, t = C("item_id"), C("topic_name")
    suffix = F.when(i % 5 == 0, F.concat(F.lit("WWW."), t)).otherwise(F.concat(F.upper(t), F.lit(" Daily!")))
    font = F.concat(
        "summary", F.lit(' <font color="#6f6f6f">'), F.replace(t, F.lit(".example.com"), F.lit(" Times")), F.lit("</font>")
    )
    return X.articles(spark, sf).select(
        "item_id",
        "pos",
        "published_utc",
        F.when(i % 4 == 0, C("headline")).otherwise(F.concat("headline", F.lit(" - "), suffix)).alias("headline"),
        F.when(i % 2 == 0, font).otherwise(C("summary")).alias("summary"),
        F.when(i % 3 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), i.cast("string")))
        .otherwise(C("link"))
        .alias("link"),
        t.alias("true_topic"),
        "vibe_style",
    )


SQL_LABEL = (
    "CASE WHEN len(regexp_extract_all(summary, '(?i)<font[^>]*>([^<]+)</font>', 1)) > 0 "
    "THEN trim(regexp_extract_all(summary, '(?i)<font[^>]*>([^<]+)</font>', 1)[-1]) "
    "WHEN contains(headline, ' - ') THEN trim(string_split(headline, ' - ')[-1]) ELSE '' END"
)
SQL_TOPIC_OF_LABEL = (
    "CASE WHEN low = '' THEN '' WHEN contains(low, '.') AND NOT contains(low, ' ') THEN replace(low, 'www.', '') "
    "WHEN trim(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), '_') <> '' "
    "THEN 'source_' || trim(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), '_') ELSE '' END"
)
SQL_DOMAIN = (
    "coalesce(nullif(lower(trim(replace(split_part(replace(replace(link,'https://',''),'http://',''),'/',1),'www.',''))),''),'unknown')"
)
WRAPPED_TOPIC = f"""
labelled AS (SELECT *, {SQL_LABEL} AS label, lower({SQL_LABEL}) AS low, {SQL_DOMAIN} AS domain FROM wrapped),
topiced AS (SELECT *, CASE WHEN domain <> 'news.google.com' THEN domain ELSE coalesce(nullif({SQL_TOPIC_OF_LABEL}, ''), domain) END AS topic
            FROM labelled)"""


@query(
    "wrapped_sources",
    with_tables(" SELECT item_id, label, topic FROM topiced", ARTICLES, WRAPPED, WRAPPED_TOPIC),
)
def _wrapped_sources(spark, sf):
    return wrapped(spark, sf).select(
        "item_id",
        T.wrapped_source_label(C("summary"), C("headline")).alias("label"),
        T.topic_name(C("link"), C("headline"), C("summary")).alias("topic"),
    )


SQL_QUALITY = (
    "(trim(headline) <> '' AND trim(link) <> '' AND length(trim(headline)) >= 25 "
    "AND len(regexp_extract_all(trim(headline), '[a-z0-9]+')) >= 5 "
    "AND NOT regexp_matches(trim(headline), '(?i)^\\s*(live updates?|watch live|breaking:?)\\s*$') "
    "AND NOT contains(lower(headline), 'photo gallery') AND NOT contains(lower(headline), 'podcast') "
    f"AND (length(trim(summary)) >= 40 OR {SQL_DOMAIN} = 'news.google.com'))"
)


@query(
    "quality_items",
    with_tables(f" SELECT item_id, {SQL_QUALITY} AS good FROM wrapped", ARTICLES, WRAPPED),
)
def _quality_items(spark, sf):
    return wrapped(spark, sf).select("item_id", T.quality_item(C("headline"), C("summary"), C("link")).alias("good"))


SQL_TITLED = (
    "array_to_string(list_transform(string_split(bare, ' '), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) "
    "AND length(w) <= 6 THEN w ELSE replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || lower(substr(w, 2)) END), ' ')"
)


@query(
    "event_labels",
    with_tables(
        f""",
b AS (SELECT item_id, {sql_clean('headline')} AS tidy FROM articles),
c AS (SELECT *, {sql_tidy("regexp_replace(tidy, '[^\\p{L}\\p{N}_\\s&/-]+', '', 'g')")} AS bare FROM b),
d AS (SELECT *, {SQL_TITLED} AS titled FROM c)
SELECT item_id, CASE
  WHEN lower(tidy) IN ('', 'general', 'generic', 'misc', 'miscellaneous', 'other') OR titled = '' THEN 'General'
  WHEN length(titled) <= 60 THEN titled
  WHEN contains(substr(titled, 1, 60), ' ') THEN trim(regexp_extract(substr(titled, 1, 60), '^(.*) [^ ]*$', 1))
  ELSE substr(titled, 1, 60) END AS label FROM d""",
        ARTICLES,
    ),
)
def _event_labels(spark, sf):
    return X.articles(spark, sf).select("item_id", T.event_label(C("headline")).alias("label"))


# --- sentences ------------------------------------------------------------------------------------------------------


@query(
    "sentence_split",
    f"""
SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, md5(array_to_string(s, '|')) AS digest
FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)""",
)
def _sentence_split(spark, sf):
    return (
        X.table(spark, sf, "documents")
        .select("doc_id", T.sentences(C("text")).alias("s"))
        .select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))
    )


@query(
    "sentence_dedupe",
    f"""
WITH s AS (SELECT doc_id, {sql_tidy('text')} AS t, unnest({sql_sentences('text')}) AS s, unnest(range(1, len({sql_sentences('text')}) + 1)) AS i FROM documents),
k AS (SELECT *, regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') AS k FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM k WHERE k <> ''),
o AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM f WHERE rn = 1 GROUP BY doc_id)
SELECT d.doc_id, length(coalesce(o.t, {sql_tidy('d.text')})) AS chars, md5(coalesce(o.t, {sql_tidy('d.text')})) AS digest
FROM documents d LEFT JOIN o USING (doc_id)""",
)
def _sentence_dedupe(spark, sf):
    return (
        X.table(spark, sf, "documents")
        .select("doc_id", T.dedupe_sentences(C("text")).alias("t"))
        .select("doc_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))
    )


@query(
    "script_clamp",
    f"""
WITH t AS (SELECT doc_id, {sql_tidy('text')} AS t FROM documents),
w AS (SELECT *, string_split(t, ' ') AS ws FROM t),
a AS (SELECT *, CASE WHEN len(ws) > 65 THEN rtrim(array_to_string(ws[1:65], ' '), ' ,;:') END AS cut FROM w),
b AS (SELECT *, CASE WHEN cut IS NULL THEN t WHEN cut = '' OR right(cut, 1) IN ('.','!','?') THEN cut ELSE cut || '.' END AS s FROM a),
c AS (SELECT *, CASE WHEN length(s) > 320 THEN rtrim(substr(s, 1, 320), ' ,;:') END AS cut2 FROM b)
SELECT doc_id, {sql_tidy("CASE WHEN cut2 IS NULL THEN s WHEN cut2 = '' OR right(cut2, 1) IN ('.','!','?') THEN cut2 ELSE cut2 || '.' END")} AS script FROM c""",
)
def _script_clamp(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", T.clamp_script(T.norm_space(C("text")), 65, 320).alias("script")
    )


@query(
    "four_sentences",
    f"""
WITH s AS (SELECT conv_id, turn, {sql_sentences('text')} AS p FROM conversations),
c AS (SELECT *, list_filter(string_split(replace(p[1], ';', ','), ', '), lambda x: trim(x) <> '') AS cl FROM s),
d AS (SELECT *, CASE WHEN len(p) = 1 AND len(cl) >= 2 THEN list_transform(cl, lambda x: trim(x)) ELSE p END AS q FROM c)
SELECT conv_id, turn, array_to_string(list_concat(q, [coalesce(q[-1], ''), coalesce(q[-1], ''), coalesce(q[-1], ''), coalesce(q[-1], '')])[1:4], '|') AS parts FROM d""",
)
def _four_sentences(spark, sf):
    return X.conversations(spark, sf).select(
        "conv_id", "turn", F.array_join(T.four_sentences(C("text")), "|").alias("parts")
    )


@query(
    "plain_sentences",
    f"""
WITH s AS (SELECT conv_id, turn, {sql_sentences('text')} AS p FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(p[1:4], lambda x: CASE WHEN right(x, 1) IN ('.','!','?') THEN x ELSE x || '.' END), '|') AS parts
FROM s""",
)
def _plain_sentences(spark, sf):
    """Answers wrapped as ``{"sentences": [" ... "]}`` for every third turn."""
    body = T.norm_space(C("text"))
    raw = F.when(C("turn") % 3 == 0, F.concat(F.lit('{ "sentences": ["'), body, F.lit('"] }'))).otherwise(body)
    return X.conversations(spark, sf).select(
        "conv_id", "turn", F.array_join(T.plain_sentences(raw), "|").alias("parts")
    )


@query(
    "recovered_sentences",
    f"""
SELECT conv_id, turn, array_to_string({sql_sentences('text')}, '|') AS parts FROM conversations""",
)
def _recovered_sentences(spark, sf):
    """Stored model responses: clean JSON, JSON in chatter, and a list whose object was cut off."""
    listed = F.to_json(T.sentences(C("text")))
    payload = (
        F.when(C("turn") % 3 == 0, F.concat(F.lit('{"sentences": '), listed, F.lit("}")))
        .when(C("turn") % 3 == 1, F.concat(F.lit('Sure: {"sentences": '), listed, F.lit("} Enjoy.")))
        .otherwise(F.concat(F.lit('{"sentences": '), listed))
    )
    response = F.when(
        C("turn") % 2 == 0, F.to_json(F.struct(payload.alias("output_text")))
    ).otherwise(
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.array(F.struct(F.lit("output_text").alias("type"), payload.alias("text"))).alias("content"))
                ).alias("output")
            )
        )
    )
    return (
        X.conversations(spark, sf)
        .select("conv_id", "turn", T.answer_text(response).alias("raw"))
        .select("conv_id", "turn", F.array_join(T.recovered_sentences(C("raw")), "|").alias("parts"))
    )


# --- ids, tokens, profiles ------------------------------------------------------------------------------------------


@query("text_id", "SELECT doc_id, substr(sha256(text), 1, 16) AS id FROM documents")
def _text_id(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.text_id(C("text")).alias("id"))


SQL_DWELL_BUCKET = "CASE WHEN dwell/10 < 0.2 THEN 0 WHEN dwell/10 < 0.5 THEN 1 WHEN dwell/10 < 0.8 THEN 2 ELSE 3 END"


@query(
    "event_tokens",
    with_tables(
        f"""
SELECT event_id,
  CAST(1 + ('0x' || substr(md5('i' || item_id || '|t' || topic_id || '|v' || vibe_id || '|dw' || {SQL_DWELL_BUCKET} || '|sx' || least(9, step // 10)), 1, 8))::BIGINT % 4095 AS INTEGER) AS token,
  CAST(1 + ('0x' || substr(md5('i' || item_id || '|t' || topic_id || '|v' || vibe_id || '|dw' || {SQL_DWELL_BUCKET}
     || '|fs' || (interest <= 0.2)::INT || '|rw' || (interest >= 0.9)::INT || '|sh' || (interest >= 0.95)::INT || '|lk' || (interest >= 0.85)::INT
     || '|cm0|tod' || (step % 4) || '|sx' || least(9, step // 10) || '|uid' || user_type || '|dev0|geo0'), 1, 8))::BIGINT % 4095 AS INTEGER) AS training_token
FROM interactions""",
        INTERACTIONS,
    ),
)
def _event_tokens(spark, sf):
    ratio = C("interest")
    flags = {
        "fast_skip": ratio <= 0.2,
        "rewinded": ratio >= 0.9,
        "shared": ratio >= 0.95,
        "liked": ratio >= 0.85,
        "commented": F.lit(False),
    }
    return X.interactions(spark, sf).select(
        "event_id",
        N.event_token(C("item_id"), C("topic_id"), C("vibe_id"), C("dwell"), C("step")).alias("token"),
        N.training_event_token(
            C("item_id"), C("topic_id"), C("vibe_id"), C("dwell"), F.lit(10.0), flags, C("step"), C("user_type")
        ).alias("training_token"),
    )


SQL_INTERESTS = "[seg, nat]"
SQL_COMMUTE = "CASE CAST(uid AS BIGINT) % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN '' ELSE 'train' END"


@query(
    "profile_signals",
    with_tables(
        f"""
SELECT uid, array_to_string({SQL_INTERESTS}, '|') AS interests,
       {SQL_COMMUTE} AS commute,
       array_to_string(list_transform({SQL_INTERESTS}, lambda s: lower(s)), '|') AS phrases,
       array_to_string(list_sort(list_distinct(flatten(list_transform({SQL_INTERESTS}, lambda s: list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda t: length(t) >= 3))))), '|') AS tokens
FROM profiles""",
        PROFILES,
    ),
)
def _profile_signals(spark, sf):
    doc = F.try_parse_json("document")
    return (
        X.profiles(spark, sf)
        .select("uid", doc.alias("doc"))
        .select("uid", P.profile_interests(C("doc")).alias("i"), P.profile_commute(C("doc")).alias("commute"))
        .select("uid", "i", "commute", P.interest_phrases(C("i")).alias("p"))
        .select(
            "uid",
            F.array_join("i", "|").alias("interests"),
            "commute",
            F.array_join("p", "|").alias("phrases"),
            F.array_join(F.array_sort(P.interest_tokens(C("p"))), "|").alias("tokens"),
        )
    )


@query(
    "seed_context",
    with_tables(
        f"""
SELECT u.session_id, array_to_string(CASE WHEN p.uid IS NULL THEN ['Morning Brief'] ELSE list_concat(['Morning Brief'], {SQL_INTERESTS}) END, '|') AS interests,
       CASE WHEN CAST(u.session_id AS BIGINT) % 5 = 0 THEN 'quick' ELSE coalesce({SQL_COMMUTE}, '') END AS commute
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events) u LEFT JOIN profiles p ON p.uid = u.session_id""",
        PROFILES,
    ),
)
def _seed_context(spark, sf):
    from dawnpress.sources.profiles import seed_context

    sessions = (
        X.table(spark, sf, "events")
        .select(C("user_id").cast("string").alias("session_id"))
        .distinct()
        .select(
            "session_id",
            F.array(F.lit("Morning  Brief")).alias("warm_interests"),
            F.when(C("session_id").cast("bigint") % 5 == 0, " quick ").otherwise("").alias("warm_commute"),
        )
    )
    merged = seed_context(sessions, X.profiles(spark, sf))
    return merged.select("session_id", F.array_join("interests", "|").alias("interests"), "commute")


@query(
    "synthesis_context",
    with_tables(
        """
SELECT item_id, md5('Headline: ' || headline || chr(10) || 'Summary: ' || summary || chr(10) || 'Source: ' || topic_name || chr(10) || 'Published: '
    || strftime(published_utc, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || 'Full text:' || chr(10) || trim(headline || ' ' || summary)) AS context,
  '- b' || chr(10) || '- c' || chr(10) || '- d' || chr(10) || '- e' || chr(10) || '- ' || topic_name AS liked, 'None yet.' AS avoided
FROM articles""",
        ARTICLES,
    ),
)
def _synthesis_context(spark, sf):
    memory = F.array(*[F.lit(x) for x in "abcde"], C("topic_name"))
    full, liked, avoided = T.context_block(
        C("headline"),
        C("summary"),
        C("topic_name"),
        F.date_format("published_utc", "yyyy-MM-dd HH:mm:ss"),
        F.trim(F.concat("headline", F.lit(" "), "summary")),
        memory,
        F.array(F.lit(" ")),
    )
    return X.articles(spark, sf).select(
        "item_id", F.md5(full).alias("context"), liked.alias("liked"), avoided.alias("avoided")
    )


@query(
    "lenient_timestamps",
    """
SELECT event_id, CASE event_id % 7
   WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
   WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 WHEN 3 THEN epoch_us(date_trunc('second', ts))
   WHEN 4 THEN epoch_us(date_trunc('day', ts)) WHEN 5 THEN epoch_us(date_trunc('second', ts)) - 19800000000 END AS micros
FROM events""",
)
def _lenient_timestamps(spark, sf):
    ts = C("ts").cast("timestamp")
    kind = C("event_id") % 7
    written = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(kind == 3, F.concat(F.date_format(ts, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 5, F.concat(F.date_format(ts, "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0530")))
        .otherwise(F.concat(F.lit("soon "), F.date_format(ts, "yyyy")))
    )
    return X.table(spark, sf, "events").select(
        "event_id", F.unix_micros(T.lenient_timestamp(written)).alias("micros")
    )


@query(
    "display_text",
    with_tables(
        """
SELECT item_id, lower(trim(vibe_style)) AS cluster,
  md5(CASE WHEN summary = '' OR contains(headline, summary) THEN headline ELSE headline || ' ' || summary END) AS shown
FROM articles""",
        ARTICLES,
    ),
)
def _display_text(spark, sf):
    return X.articles(spark, sf).select(
        "item_id",
        T.cluster_id(F.concat(F.lit(" "), "vibe_style", F.lit(" "))).alias("cluster"),
        F.md5(T.display_text(C("headline"), C("summary"))).alias("shown"),
    )
