"""Column functions over text, URLs and HTML. Everything here stays in the JVM except ``unescape_html``."""

from __future__ import annotations

import html
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dawnpress.functions import wordlists as W

BLANKS = " \t\n\r\x0b\x0c"
UNICODE_BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Runs of blanks other than a single space: replacing these by a space gives the same text, without a replacement per word.
#: Most characters are told from a blank by one range at the start.
UNTIDY_BLANK = f"(?![!-~])(?: {UNICODE_BLANK[:-1]}|{UNICODE_BLANK[:-2]}&&[^ ]]){UNICODE_BLANK[:-1]}*"
LETTERS_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def rstrip(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def words_in(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def drop_all(c: Column, *parts: str) -> Column:
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


# --- URLs -----------------------------------------------------------------------------------------------------------


def extract_domain(url: Column) -> Column:
    host = F.split_part(drop_all(text_or_empty(url), "https://", "http://"), F.lit("/"), F.lit(1))
    return F.coalesce(blank_to_null(F.lower(strip(drop_all(host, "www.")))), F.lit("unknown"))


def normalize_domain(value: Column) -> Column:
    cleaned = drop_all(F.lower(strip(text_or_empty(value))), "https://", "http://", "www.")
    return F.split_part(cleaned, F.lit("/"), F.lit(1))


def canonicalize_url(url: Column) -> Column:
    """Scheme, host and path only; the scheme is lower-cased."""
    bare = F.regexp_replace(strip(text_or_empty(url)), r"(?s)[?#].*$", "")
    scheme = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    return F.concat(F.lower(scheme), F.substr(bare, F.length(scheme) + 1))


def url_host(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(text_or_empty(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def article_source(topic_name: Column, link: Column) -> Column:
    return F.coalesce(blank_to_null(text_or_empty(topic_name)), url_host(link), F.lit("unknown"))


def allowed_source(domain: Column, suffixes: Sequence[str] = tuple(W.ALLOWED_SOURCES)) -> Column:
    d = F.lower(strip(text_or_empty(domain)))
    dotted = F.concat(F.lit("."), d)
    return F.exists(words_in([f".{s}" for s in suffixes]), lambda s: F.endswith(dotted, s)) & (d != "")


# --- cleaning -------------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape_html(c: Column, full: bool = True) -> Column:
    """HTML entities to characters. Only texts that contain ``&`` travel to Python; ``full=False`` stays in the JVM."""
    if full:
        return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)
    for name, char in W.NAMED_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def norm_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), UNTIDY_BLANK, " "))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words of a text with the blanks between them."""
    word = f"[^{UNICODE_BLANK[1:-2]}]+"
    return F.regexp_extract(text_or_empty(c), f"^{UNICODE_BLANK[:-1]}*((?:{word}{UNICODE_BLANK}){{0,{n - 1}}}{word})", 1)


def word_count(c: Column) -> Column:
    return bound(norm_space(c), lambda tidy: F.when(tidy == "", 0).otherwise(F.size(F.split(tidy, " "))))


def clean_text(c: Column, full_entities: bool = True, drop_urls: bool = True) -> Column:
    out = F.regexp_replace(unescape_html(text_or_empty(c), full_entities), W.TAG_PATTERN, " ")
    if drop_urls:
        out = F.regexp_replace(out, W.URL_PATTERN, " ")
    return norm_space(out)


def page_text(page: Column, max_chars: int | None = None, full_entities: bool = True) -> Column:
    """Readable text of a web page: paragraph contents without script, style and tags."""
    body = F.regexp_replace(text_or_empty(page), W.SCRIPT_STYLE_PATTERN, " ")
    paragraphs = F.regexp_extract_all(body, F.lit(W.PARAGRAPH_PATTERN), F.lit(1))
    joined = F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(p, W.TAG_PATTERN, " ")), " ")
    out = norm_space(unescape_html(joined, full_entities))
    return F.substring(out, 1, max_chars) if max_chars else out


# --- tokens ---------------------------------------------------------------------------------------------------------


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def shifted_pairs(tokens: Column, separator: str) -> Column:
    """Adjacent pairs of an array, joined."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.zip_with(tokens, following, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(separator), b)))
    return F.filter(pairs, lambda p: p.isNotNull())


def tokenize(cleaned: Column, stopwords: Sequence[str] = tuple(W.CLUSTER_STOPWORDS)) -> Column:
    stop = words_in(stopwords)
    return F.filter(
        all_matches(F.lower(cleaned), W.CLUSTER_TOKEN_PATTERN),
        lambda t: ~F.array_contains(stop, t) & ~F.rlike(t, F.lit("^[0-9]+$")),
    )


def demand_tokens(headline: Column, stopwords: Sequence[str] = tuple(W.DEMAND_STOPWORDS)) -> Column:
    stop = words_in(stopwords)
    raw = F.transform(
        all_matches(F.lower(text_or_empty(headline)), W.DEMAND_TOKEN_PATTERN), lambda t: F.trim(t, F.lit("-'"))
    )
    return F.filter(
        raw, lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t) & ~F.rlike(t, F.lit("^[0-9]+$"))
    )


def demand_terms(tokens: Column) -> Column:
    """Distinct tokens and adjacent pairs of the kept tokens."""
    return F.array_distinct(F.concat(tokens, shifted_pairs(tokens, " ")))


def fingerprint(title: Column, description: Column) -> Column:
    text = norm_space(F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(description))))
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / total)


def long_tokens(cleaned_headline: Column) -> Column:
    return F.filter(tokenize(cleaned_headline), lambda t: F.length(t) >= 3)


def headline_ngrams(tokens: Column) -> Column:
    """Distinct two- and three-token grams of ``long_tokens``."""
    pairs = shifted_pairs(tokens, "_")
    third = F.slice(tokens, F.lit(3), F.greatest(F.size(tokens), F.lit(1)))
    triples = F.filter(
        F.zip_with(pairs, third, lambda p, t: F.when(p.isNotNull() & t.isNotNull(), F.concat(p, F.lit("_"), t))),
        lambda g: g.isNotNull(),
    )
    return F.array_distinct(F.concat(pairs, triples))


def head_signature(tokens: Column, size: int = 10) -> Column:
    return F.slice(F.array_sort(tokens), 1, size)


def capitalised_spans(raw: Column) -> Column:
    """Capitalised phrases of at most three words, acronyms and brand words; word boundaries are Unicode-aware."""
    text = F.regexp_replace(text_or_empty(raw), W.TAG_PATTERN, " ")
    spans = all_matches(text, "(?U)" + W.ENTITY_PATTERN)
    return F.transform(spans, lambda s: F.lower(strip(F.regexp_replace(s, r"[^A-Za-z0-9 \-]+", ""))))


def entities_strict(raw: Column, bad: Sequence[str] | None = None) -> Column:
    """Spans without any stop or bad word; duplicates stay."""
    banned = words_in(bad if bad is not None else [*W.CLUSTER_STOPWORDS, *W.STORY_BAD_TOKENS, *W.STORY_BAD_PARTS])
    return F.filter(
        capitalised_spans(raw), lambda s: (F.length(s) >= 3) & ~F.arrays_overlap(F.split(s, " +"), banned)
    )


def entities_lenient(raw: Column, bad: Sequence[str] | None = None) -> Column:
    """The informative words of each span, as a set."""
    banned = words_in(bad if bad is not None else [*W.CLUSTER_STOPWORDS, *W.EVENT_BAD_TOKENS])

    def informative(span: Column) -> Column:
        kept = F.filter(F.split(span, " +"), lambda p: (F.length(p) >= 3) & ~F.array_contains(banned, p))
        return F.array_join(kept, " ")

    return F.array_distinct(F.filter(F.transform(capitalised_spans(raw), informative), lambda e: e != ""))


def entity_slug(entity_key: Column) -> Column:
    """Slug of the inventory's entity column; null when unknown or too short."""
    key = F.lower(strip(text_or_empty(entity_key)))
    slug = F.trim(F.regexp_replace(F.regexp_replace(key, r"[^a-z0-9_\\-]+", "_"), "_+", "_"), F.lit("_"))
    return F.when(~key.isin("", "unknown_entity", "unknown") & (F.length(slug) >= 3), slug)


# --- keyword rules --------------------------------------------------------------------------------------------------


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords], F.lit(False))


def count_contained(text: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in keywords], F.lit(0))


def group_matches(
    text: Column, tokens: Column, groups: Mapping[str, Sequence[str]], hyphen_phrases: bool = False
) -> list[tuple[str, Column]]:
    """(group, matched?) per keyword group: a keyword with a space is a substring, any other one a whole token.

    A hyphenated keyword can never equal a token; ``hyphen_phrases`` treats it as a phrase instead.
    """

    def is_phrase(word: str) -> bool:
        return " " in word or (hyphen_phrases and "-" in word)

    singles = [w for words in groups.values() for w in words if not is_phrase(w)]
    hits = F.array_intersect(tokens, words_in(list(dict.fromkeys(singles))))
    out = []
    for name, words in groups.items():
        single = [w for w in words if not is_phrase(w)]
        phrase = [w for w in words if is_phrase(w)]
        test = F.arrays_overlap(hits, words_in(single)) if single else F.lit(False)
        if phrase:
            test = test | contains_any(text, phrase)
        out.append((name, test))
    return out


def first_group(matches: Sequence[tuple[str, Column]], default: str) -> Column:
    chain = F.when(matches[0][1], matches[0][0])
    for name, test in matches[1:]:
        chain = chain.when(test, name)
    return chain.otherwise(default)


def rule_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[text_or_empty(p) for p in parts]))


def rule_tokens(text: Column) -> Column:
    return F.array_distinct(all_matches(text, W.WORD_PATTERN))


def entity_key(text: Column, tokens: Column, groups: Mapping[str, Sequence[str]] | None = None, **options) -> Column:
    return first_group(group_matches(text, tokens, groups or W.ENTITY_GROUPS, **options), "unknown_entity")


def event_key(text: Column, tokens: Column, groups: Mapping[str, Sequence[str]] | None = None, **options) -> Column:
    return first_group(group_matches(text, tokens, groups or W.EVENT_GROUPS, **options), "unknown_event")


def training_entity_key(headline: Column, groups: Mapping[str, Sequence[str]] | None = None) -> Column:
    text = F.lower(text_or_empty(headline))
    matches = group_matches(text, rule_tokens(text), groups or W.TRAINING_ENTITY_GROUPS)
    return first_group(matches, "general_tech_other")


def substring_key(headline: Column, groups: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    text = F.lower(text_or_empty(headline))
    return first_group([(name, contains_any(text, words)) for name, words in groups.items()], default)


def emotion(text: Column, rules: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Label with the most rule words in the text; the earlier rule wins ties, none gives ``neutral``."""
    rules = rules or W.EMOTION_WORDS
    lowered = F.lower(text_or_empty(text))
    counts = {label: count_contained(lowered, words) for label, words in rules.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    chain = F.when(best == 0, "neutral")
    for label, n in counts.items():
        chain = chain.when(n == best, label)
    return chain


def style_of_emotion(label: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, style in W.EMOTION_STYLES.items():
        chain = chain.when(label == name, style)
    return chain.otherwise(W.DEFAULT_STYLE)


def whole_words(alternatives: Sequence[str]) -> str:
    """Pattern for any of the words or phrases on Unicode word boundaries, written without look-around."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(alternatives)})(?:$|[^\p{{L}}\p{{N}}_])"


def category(text: Column, words: Mapping[str, Sequence[str]] | None = None) -> Column:
    """First group with a whole word or phrase in the text, else ``other``.

    The text is split once and cut to the words that occur in any group; only phrases search the text itself.
    """
    lowered = F.lower(text)
    words = words or W.CATEGORY_WORDS
    single = {name: [w for w in group if w.isalnum()] for name, group in words.items()}
    phrases = {name: [w for w in group if not w.isalnum()] for name, group in words.items()}
    known = F.array(*[F.lit(w) for w in sorted({w for group in single.values() for w in group})])
    met = F.array_intersect(F.split(lowered, r"[^\p{L}\p{N}_]+"), known)

    def named(found: Column) -> Column:
        tests = []
        for name in words:
            test = F.arrays_overlap(found, F.array(*[F.lit(w) for w in single[name]])) if single[name] else F.lit(False)
            tests.append((name, test | F.rlike(lowered, F.lit(whole_words(phrases[name]))) if phrases[name] else test))
        return first_group(tests, "other")

    return F.element_at(F.transform(F.array(met), named), 1)


def quality_item(headline: Column, summary: Column, link: Column, wrapper: str = W.WRAPPER_DOMAIN) -> Column:
    """Good enough for a feed? The three texts are evaluated once, also where this is a filter."""

    def good(x: Column) -> Column:
        h, s, u = x["h"], x["s"], x["u"]
        lowered = F.lower(h)
        return (
            (h != "")
            & (u != "")
            & (F.length(h) >= 25)
            & (F.regexp_count(h, F.lit(W.WORD_PATTERN)) >= 5)
            & ~F.rlike(h, F.lit(W.EMPTY_HEADLINE_PATTERN))
            & ~F.contains(lowered, F.lit("photo gallery"))
            & ~F.contains(lowered, F.lit("podcast"))
            & ((F.length(s) >= 40) | (extract_domain(u) == wrapper))
        )

    texts = {"h": headline, "s": summary, "u": link}
    return bound(F.struct(*[strip(text_or_empty(c)).alias(name) for name, c in texts.items()]), good)


# --- sources and labels ---------------------------------------------------------------------------------------------


def wrapped_source_label(summary: Column, headline: Column) -> Column:
    """Source named in the last <font> of the summary, else after the last `` - `` of the headline."""
    fonts = F.regexp_extract_all(text_or_empty(summary), F.lit(W.SOURCE_FONT_PATTERN), F.lit(1))
    head = text_or_empty(headline)
    tail = F.when(F.contains(head, F.lit(" - ")), strip(F.substring_index(head, " - ", -1))).otherwise("")
    return F.when(F.size(fonts) > 0, strip(F.element_at(fonts, -1))).otherwise(tail)


def label_topic(label: Column) -> Column:
    low = F.lower(strip(text_or_empty(label)))
    slug = F.trim(F.regexp_replace(low, "[^a-z0-9]+", "_"), F.lit("_"))
    domain_like = F.contains(low, F.lit(".")) & ~F.contains(low, F.lit(" "))
    return (
        F.when(low == "", "")
        .when(domain_like, drop_all(low, "www."))
        .when(slug != "", F.concat(F.lit("source_"), slug))
        .otherwise("")
    )


def topic_name(link: Column, headline: Column, summary: Column, wrapper: str = W.WRAPPER_DOMAIN) -> Column:
    domain = extract_domain(link)
    routed = F.coalesce(blank_to_null(label_topic(wrapped_source_label(summary, headline))), domain)
    return F.when(domain != wrapper, domain).otherwise(routed)


def event_label(label: Column, limit: int = 60, full_entities: bool = True) -> Column:
    """Readable event label: punctuation dropped, words capitalised, cut on a word boundary."""
    tidy = clean_text(label, full_entities)
    generic = F.lower(tidy).isin("", "general", "generic", "misc", "miscellaneous", "other")
    bare = norm_space(F.regexp_replace(tidy, r"(?U)[^\w\s&/\-]+", ""))
    acronym = lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) <= 6)
    titled = F.array_join(
        F.transform(
            F.split(bare, " "),
            lambda w: F.when(acronym(w), w).otherwise(
                F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
            ),
        ),
        " ",
    )
    head = F.substring(titled, 1, limit)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"^(.*) [^ ]*$", 1)).otherwise(head)
    out = F.when(F.length(titled) > limit, F.trim(cut)).otherwise(titled)
    return F.when(generic | (out == ""), "General").otherwise(out)


def cluster_id(value: Column) -> Column:
    return F.coalesce(blank_to_null(F.lower(strip(text_or_empty(value)))), F.lit("unknown"))


def display_text(headline: Column, summary: Column) -> Column:
    """Headline, with the summary added unless it is already part of it."""
    h, s = text_or_empty(headline), text_or_empty(summary)
    return F.when((s == "") | F.contains(h, s), h).otherwise(strip(F.concat_ws(" ", h, s)))


def text_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


# --- sentences ------------------------------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    """Split after ., ! or ? followed by blanks; empty for blank text."""
    return _tidy_sentences(norm_space(c))


def _tidy_sentences(tidy: Column) -> Column:
    return F.filter(F.split(tidy, W.SENTENCE_END_PATTERN), lambda s: s != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when a lambda inside ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_spellings(keyed: Column) -> Column:
    """First ``s`` of every non-empty ``k`` of an array of (k, i, s), in order of ``i``; sort-based, not pairwise."""
    ordered = F.array_sort(F.filter(keyed, lambda x: x["k"] != ""))
    firsts = bound(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (x["k"] != F.get(o, i - 1)["k"])))
    kept = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.transform(kept, lambda x: x["s"])


def letter_keys(parts: Column) -> Column:
    """Letters and digits of every text, lower-cased; ``parts`` hold no line break.

    The texts are lower-cased and cut as one: what is no letter or digit is found by a first ``translate`` and dropped by a second.
    """

    def cut(lowered: Column) -> Column:
        others = F.call_function("translate", lowered, F.lit(LETTERS_DIGITS + "\n"), F.lit(""))
        return F.call_function("translate", lowered, others, F.lit(""))

    return F.split(bound(F.lower(F.array_join(parts, "\n")), cut), "\n")


def dedupe_sentences(c: Column) -> Column:
    """Drop later sentences whose letters and digits repeat an earlier one. Every step is evaluated once."""

    def keyed(parts: Column) -> Column:
        at = lambda keys: lambda s, i: F.struct(F.get(keys, i).alias("k"), i.alias("i"), s.alias("s"))
        return bound(letter_keys(parts), lambda keys: F.transform(parts, at(keys)))

    def deduped(tidy: Column) -> Column:
        joined = bound(_tidy_sentences(tidy), lambda parts: F.array_join(first_spellings(keyed(parts)), " "))
        return bound(joined, lambda kept: F.when(kept == "", tidy).otherwise(kept))

    return bound(norm_space(c), deduped)


def _terminated(c: Column) -> Column:
    return F.when((c == "") | F.substring(c, -1, 1).isin(".", "!", "?"), c).otherwise(F.concat(c, F.lit(".")))


def clamp_script(deduped: Column, max_words: int, max_chars: int) -> Column:
    """Limit words, then characters; a cut text loses trailing punctuation and ends with a full stop."""
    tail = " ,;:"
    tokens = F.split(norm_space(deduped), " ")
    by_words = deduped
    if max_words > 0:
        cut = rstrip(F.array_join(F.slice(tokens, 1, max_words), " "), tail)
        by_words = F.when(F.size(tokens) > max_words, _terminated(cut)).otherwise(deduped)
    if max_chars > 0:
        cut = rstrip(F.substring(by_words, 1, max_chars), tail)
        by_words = F.when(F.length(by_words) > max_chars, _terminated(cut)).otherwise(by_words)
    return norm_space(by_words)


def four_sentences(c: Column) -> Column:
    """Exactly four parts: a single sentence is split on commas or semicolons, then the last part repeats."""
    parts = sentences(c)
    clauses = F.filter(F.split(F.get(parts, F.lit(0)), r"[;,]\s+"), lambda p: strip(p) != "")
    chosen = F.when((F.size(parts) == 1) & (F.size(clauses) >= 2), F.transform(clauses, strip)).otherwise(parts)
    last = F.coalesce(F.get(chosen, F.size(chosen) - 1), F.lit(""))
    return F.slice(F.concat(chosen, F.array_repeat(last, 4)), 1, 4)


def plain_sentences(c: Column, limit: int = 4) -> Column:
    """At most ``limit`` terminated sentences of a plain or JSON-wrapped answer."""
    s = norm_space(c)
    s = F.regexp_replace(s, r'(?i)^\s*\{\s*"sentences"\s*:\s*\[\s*', "")
    s = F.regexp_replace(s, r"\s*\]\s*\}\s*$", "")
    s = F.replace(strip(F.trim(strip(s), F.lit('"'))), F.lit('\\"'), F.lit('"'))
    return F.slice(F.transform(sentences(s), _terminated), 1, limit)


def recovered_sentences(raw: Column) -> Column:
    """Sentences of a JSON-like answer: the object, else the bracket list, else the quoted strings after the key."""
    s = strip(text_or_empty(raw))
    marker = F.locate('"sentences"', F.lower(s))
    start = F.greatest(marker - 40, F.lit(1))
    open_at = F.locate("{", F.substr(s, start)) + start - 1
    close_at = F.length(s) - F.locate("}", F.reverse(s)) + 1
    body = F.when(F.contains(s, F.lit("}")), F.substr(s, open_at, F.greatest(close_at - open_at + 1, F.lit(0))))
    clean = lambda xs: F.filter(F.transform(xs, norm_space), lambda x: x != "")
    filled = lambda xs: F.when(F.size(xs) > 0, xs)
    from_object = filled(clean(F.from_json(body, "sentences array<string>")["sentences"]))
    tail = F.substr(s, F.greatest(marker, F.lit(1)))
    bracket = blank_to_null(F.regexp_extract(tail, r"(?s)(\[[^\]]*\])", 1))
    from_bracket = filled(clean(F.from_json(bracket, "array<string>")))
    quoted = F.regexp_extract_all(tail, F.lit(r'"((?:\\.|[^"\\])*)"'), F.lit(1))
    from_quotes = F.filter(
        clean(F.transform(quoted, lambda q: F.replace(q, F.lit('\\"'), F.lit('"')))), lambda q: F.lower(q) != "sentences"
    )
    return F.when(marker > 0, F.coalesce(from_object, from_bracket, from_quotes)).otherwise(
        F.array().cast("array<string>")
    )


def answer_text(response: Column) -> Column:
    """Text of a stored model response: ``output_text``, else the text parts of ``output[*].content[*]``."""
    parsed = F.from_json(
        response,
        "output_text string, output array<struct<content:array<struct<type:string,text:string,json:string>>>>",
    )
    contents = F.flatten(F.transform(F.coalesce(parsed["output"], F.array()), lambda o: F.coalesce(o["content"], F.array())))
    parts = F.transform(
        contents,
        lambda c: F.coalesce(blank_to_null(strip(c["text"])), F.when(c["type"] == "json", c["json"]), F.lit("")),
    )
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    direct = parsed["output_text"]
    return F.when(strip(direct) != "", direct).otherwise(strip(joined))


def context_block(
    headline: Column,
    summary: Column,
    source: Column,
    published: Column,
    article: Column,
    liked: Column,
    avoided: Column,
    max_chars: int | None = None,
) -> tuple[Column, Column, Column]:
    """(article text with its facts, liked bullets, avoided bullets) of one synthesis request."""
    lines = [("Headline", headline), ("Summary", summary), ("Source", source), ("Published", published)]
    facts = strip(F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), text_or_empty(c)) for n, c in lines]))
    full = F.when(text_or_empty(article) == "", facts).otherwise(
        strip(F.concat(facts, F.lit("\n\nFull text:\n"), article))
    )
    if max_chars:
        full = F.substring(full, 1, max_chars)

    def bullets(memory: Column) -> Column:
        kept = F.filter(F.transform(F.coalesce(memory, F.array()), strip), lambda s: s != "")
        last = F.slice(kept, F.greatest(F.size(kept) - 4, F.lit(1)), F.lit(5))
        listed = F.array_join(F.transform(last, lambda s: F.concat(F.lit("- "), s)), "\n")
        return F.when(listed == "", "None yet.").otherwise(listed)

    return full, bullets(liked), bullets(avoided)


# --- time -----------------------------------------------------------------------------------------------------------


def lenient_timestamp(c: Column) -> Column:
    """UTC timestamp of an ISO or mail-style date; naive means UTC; null when unreadable."""
    s = strip(text_or_empty(c))
    bare = F.regexp_replace(s, r"^[A-Za-z]{3}, ", "")
    iso = F.when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(s))
    mail = [
        F.try_to_timestamp(bare, F.lit(pattern))
        for pattern in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")
    ]
    return F.coalesce(iso, *[F.when(F.rlike(bare, F.lit(r"^\d{1,2} [A-Za-z]{3} ")), m) for m in mail])
