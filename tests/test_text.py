"""Text functions on hand-written English news."""

from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_urls(spark):
    c = F.col("u")
    assert one(spark, T.extract_domain(c), u="https://www.Site.com:80/a?b") == "site.com:80"
    assert one(spark, T.extract_domain(c), u="") == "unknown"
    assert one(spark, T.normalize_domain(c), u=" ") == ""
    assert one(spark, T.canonicalize_url(c), u=" HTTPS://A.com/p/q?x=1#f ") == "https://A.com/p/q"
    assert one(spark, T.url_host(c), u="https://A.com:8/p") == "A.com:8"


def test_cleaning(spark):
    c = F.col("t")
    assert one(spark, T.clean_text(c), t="<b>Caf&eacute;</b> &amp; tea https://x.y/z now") == "Café & tea now"
    assert one(spark, T.page_text(c), t="<script>var p='<p>no</p>'</script><p>One&nbsp;<i>two</i></p>x<p>three</p>") == "One two three"
    assert one(spark, T.tokenize(c), t="The AI of 2024 beats go_players") == ["ai", "beats", "go_players"]
    assert sorted(one(spark, T.demand_terms(T.demand_tokens(c)), t="Nvidia's -chips- update beats rivals")) == sorted(
        ["nvidia's", "chips", "beats", "rivals", "nvidia's chips", "chips beats", "beats rivals"]
    )


def test_entities(spark):
    c = F.col("t")
    text = "Tim Cook and the New York Times met OpenAI at NASA Deep Dive"
    assert one(spark, T.entities_strict(c), t=text) == ["tim cook", "openai", "nasa"]
    assert sorted(one(spark, T.entities_lenient(c), t=text)) == sorted(["tim cook", "new york", "openai", "nasa", "deep dive"])


def test_rules(spark):
    def keys(head, **options):
        df = spark.createDataFrame([(head,)], "h string").withColumn("x", T.rule_text(F.col("h"))).withColumn("k", T.rule_tokens(F.col("x")))
        row = df.select(T.entity_key(F.col("x"), F.col("k"), **options).alias("e"), T.event_key(F.col("x"), F.col("k"), **options).alias("v")).first()
        return row.e, row.v

    assert keys("North Korea tests missile") == ("geopolitics_conflict", "unknown_event")
    assert keys("Apple iPhone launch leak") == ("apple", "product_drop")
    assert keys("gpt-5 zero-day") == ("unknown_entity", "unknown_event")
    assert keys("gpt-5 zero-day", hyphen_phrases=True) == ("openai", "cyber_threat")
    assert one(spark, T.training_entity_key(F.col("h")), h="Court rules on toxic formula") == "structural_governance"
    assert one(spark, T.emotion(F.col("h")), h="They warn of risk: panic grows") == "fear"
    # "rage" is found inside "outrage" too, and the earlier label wins the tie.
    assert one(spark, T.emotion(F.col("h")), h="Outrage and risk: panic grows") == "anger"
    assert one(spark, T.emotion(F.col("h")), h="A fury of risk") == "anger"
    assert one(spark, T.category(F.col("h")), h="Prime Minister visits chip plant") == "tech"
    assert one(spark, T.category(F.col("h")), h="The prime minister") == "politics"


def test_labels_and_sentences(spark):
    c = F.col("t")
    assert one(spark, T.event_label(c), t="misc") == "General"
    assert one(spark, T.event_label(c), t="NASA's moon-landing plan (2026)!") == "Nasas Moon-landing Plan 2026"
    assert one(spark, T.four_sentences(c), t="a, b; c") == ["a", "b", "c", "c"]
    assert one(spark, T.four_sentences(c), t="") == [""] * 4
    assert one(spark, T.dedupe_sentences(c), t="Hi there. HI, there! Bye.") == "Hi there. Bye."
    assert one(spark, T.clamp_script(c, 3, 0), t="one two three, four") == "one two three."
    assert one(spark, T.recovered_sentences(c), t='{"sentences": ["a b", "c"], oops') == ["a b", "c"]
    assert one(spark, T.recovered_sentences(c), t='"sentences": "left", "right \\"x\\""') == ["left", 'right "x"']
    assert one(spark, T.recovered_sentences(c), t="nothing") == []
    assert one(spark, T.plain_sentences(c), t='{ "sentences": ["One. Two"] }') == ["One.", "Two."]


def test_topics(spark):
    topic = T.topic_name(F.col("u"), F.col("h"), F.col("s"))
    base = {"u": "https://news.google.com/1", "h": "Big news - The Daily", "s": ""}
    assert one(spark, topic, **base) == "source_the_daily"
    assert one(spark, topic, **{**base, "s": '<font c="1">www.site.com</font>'}) == "site.com"
    assert one(spark, topic, **{**base, "h": "plain"}) == "news.google.com"


def test_boundaries(spark):
    bucket = lambda h: one(spark, N.recency_bucket(F.lit(h)))
    assert [bucket(h) for h in (-5.0, 1.0, 1.1, 6.0, 24.0, 72.0, 72.1)] == [0, 0, 1, 1, 2, 3, 4]
    assert one(spark, N.watch_reward(F.lit(12.0))) == 10.0 and one(spark, N.watch_reward(F.lit(-1.0))) == -10.0
    assert one(spark, N.reward_norm(F.lit(-10.0))) == 0.05 and one(spark, N.reward_norm(F.lit(10.0))) == 0.95
    few = one(spark, N.skip_reward(F.lit(5.0), F.lit(11), F.lit(2.0), F.lit(1.0)))
    many = one(spark, N.skip_reward(F.lit(5.0), F.lit(12), F.lit(2.0), F.lit(0.1)))
    assert few == 0.0 and many > 5


def test_sentences_are_deduplicated_in_one_pass(spark):
    c = F.col("t")
    text = "One  two.\u00a0ONE, two! \n Three?  İΣ one two. ... é! Three ?\t3."
    assert one(spark, T.dedupe_sentences(c), t=text) == "One two. Three? İΣ one two. 3."
    assert one(spark, T.dedupe_sentences(c), t=" é! \n ... ") == "é! ..." and one(spark, T.dedupe_sentences(c), t=None) == ""
    once = spark.range(1).select(F.col("id").cast("string").alias("t")).select(T.dedupe_sentences(c).alias("x"))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("array_join(") == 2


def test_untidy_blanks_equal_all_blanks(spark):
    texts = ["a b", " a  b ", "a\tb", "a \nb", "\u00a0 a\u2003\u2003b\x1c", "\n", " ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.trim(F.regexp_replace("t", T.UNICODE_BLANK, " "))
    assert all(r.a == r.b for r in rows.select(every.alias("a"), T.norm_space(F.col("t")).alias("b")).collect())


def test_quality_evaluates_a_text_once(spark):
    raw = spark.createDataFrame([("sdrow xis tsael ta fo enildaeh a", "x" * 40, "http://a/b"), (None, None, None)], "h string, s string, u string")
    rows = raw.select(F.reverse("h").alias("h"), "s", "u")
    test = T.quality_item(F.col("h"), F.col("s"), F.col("u"))
    assert rows.where(test).count() == 1
    planned = spark.range(1).select(F.reverse(F.col("id").cast("string")).alias("h"), F.lit("s").alias("s"), F.lit("u").alias("u"))
    assert planned.where(test)._jdf.queryExecution().optimizedPlan().toString().count("reverse(") <= 2  # filter and output


def test_first_words_and_headlines_need_no_whole_text(spark):
    from dawnpress.sources import fixtures as X

    rows = ["", "  ", "one", " a\tb  c ", " x　y z\n", " ".join(f"w{i}" for i in range(30)), "\t" + "  \n".join(f"w{i}" for i in range(14)) + " "]
    df = spark.createDataFrame([(i, f"src{i}", "en", t) for i, t in enumerate(rows)], "doc_id bigint, source string, lang string, text string")
    for n in (1, 3, 55):
        got = df.orderBy("doc_id").select(T.norm_space(T.first_words(F.col("text"), n))).collect()
        assert [r[0] for r in got] == [" ".join(t.split()[:n]) for t in rows]
    split = lambda t: [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", t) if w]
    heads = X.articles_of(df).select("headline", "summary").orderBy("item_id").collect()
    assert [(r[0], r[1]) for r in heads] == [(" ".join(split(t)[:12]), " ".join(split(t)[12:])) for t in rows]
