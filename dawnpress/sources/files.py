"""File edges: feeds, inventories, logs, caches, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.operators.features import edge_columns, reconcile

_LINK = StructType([StructField("_VALUE", StringType()), StructField("_href", StringType())])
RSS_ITEM = StructType([StructField(n, StringType()) for n in ("title", "description", "link", "pubDate")])
ATOM_ENTRY = StructType(
    [StructField(n, StringType()) for n in ("title", "summary", "published", "updated")] + [StructField("link", _LINK)]
)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed RSS and Atom files as (feed, headline, summary, link, published)."""
    blank = lambda name: T.text_or_empty(F.col(name))
    feed = F.col("_metadata.file_path").alias("feed")

    def scan(tag: str, schema: StructType) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)

    rss = scan("item", RSS_ITEM).select(
        feed, blank("title").alias("headline"), blank("description").alias("summary"), blank("link").alias("link"), blank("pubDate").alias("published")
    )
    published = F.coalesce(T.blank_to_null(F.col("published")), T.blank_to_null(F.col("updated")), F.lit(""))
    atom = scan("entry", ATOM_ENTRY).select(
        feed, blank("title").alias("headline"), blank("summary").alias("summary"),
        F.coalesce(F.col("link._href"), F.col("link._VALUE"), F.lit("")).alias("link"), published.alias("published"),
    )
    return rss.unionByName(atom)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory CSV with quoted line breaks; all columns as text in file order."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def canonical_inventory(raw: DataFrame) -> DataFrame:
    return reconcile(raw).withColumn("published_utc", T.lenient_timestamp(F.col("published")))


def inventory_for_demand(raw: DataFrame) -> DataFrame:
    """Headlines of an inventory; nothing when it has no such column."""
    if "Headline" not in raw.columns:
        return raw.sparkSession.createDataFrame([], "headline string")
    return raw.select(T.text_or_empty(F.col("Headline")).alias("headline"))


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows = edge_columns(features)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def interaction_rows(rows: DataFrame) -> DataFrame:
    """The fixed log columns in order; a missing one is null."""
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in W.INTERACTION_COLUMNS])


def append_interactions(rows: DataFrame, path: str, day: Column | None = None) -> None:
    logged = interaction_rows(rows)
    logged.withColumn("day", day if day is not None else F.to_date("timestamp_utc")).write.mode("append").partitionBy("day").parquet(path)


def read_label_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, event) of a JSON-lines cache: unreadable lines are skipped, the last line of a key wins.

    Old files hold all records on one line, separated by a literal backslash-n.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"), "value"
    )
    records = lines.select("_f", "_b", "_n", F.posexplode(F.split("value", r"(?<=\})\\n")).alias("_i", "record"))
    parsed = records.select("_f", "_b", "_n", "_i", F.from_json("record", "key string, event string").alias("r"))
    clean = parsed.select("_f", "_b", "_n", "_i", T.strip(F.col("r.key")).alias("key"), T.strip(F.col("r.event")).alias("event"))
    good = clean.where("key <> '' and event <> ''")
    return good.groupBy("key").agg(F.max_by("event", F.struct("_f", "_b", "_n", "_i")).alias("event"))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_wishlist(spark: SparkSession, path: str) -> DataFrame:
    """Stored wishlist documents with each list stripped, without blanks and repeats."""
    lists = ["queries", "preferred_domains", "extra_feed_urls"]
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.try_parse_json("value").alias("doc"))

    def tidy(name: str) -> Column:
        values = F.try_variant_get("doc", f"$.{name}", "array<string>")
        kept = F.array_distinct(F.filter(F.transform(values, T.strip), lambda s: s != ""))
        return F.coalesce(kept, F.array().cast("array<string>")).alias(name)

    return parsed.select(*[tidy(n) for n in lists])


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON document per row."""
    rows.write.mode("overwrite").json(path)


STATE_SCHEMA = (
    "event_seq array<int>, recent_seen array<bigint>, skip_dwells array<double>, step double, impressions double, avg_reward double, "
    "user_delta array<double>, audio_positives array<string>, audio_negatives array<string>, "
    "pending_audio struct<content_id:string,item_id:bigint,sentences:array<string>,created_at:double,consumed:boolean>, updated_at double"
)


def session_states(raw: DataFrame, dim: int = 64) -> DataFrame:
    """Validated states of (session_id, state JSON): histories trimmed to their windows, sequences padded, dwell clamped."""
    s = raw.select("session_id", F.from_json("state", STATE_SCHEMA).alias("s"))
    none = lambda kind: F.array().cast(f"array<{kind}>")

    def last(name: str, size: int, kind: str) -> Column:
        values = F.filter(F.coalesce(F.col(f"s.{name}"), none(kind)), lambda x: x.isNotNull())
        return F.slice(values, F.greatest(F.size(values) - size + 1, F.lit(1)), F.lit(size))

    def texts(name: str) -> Column:
        values = F.filter(F.transform(F.coalesce(F.col(f"s.{name}"), none("string")), T.strip), lambda x: x != "")
        return F.slice(values, F.greatest(F.size(values) - 4, F.lit(1)), F.lit(5))

    seq, delta = last("event_seq", 30, "int"), F.slice(F.coalesce(F.col("s.user_delta"), none("double")), 1, dim)
    whole = lambda name: F.greatest(F.coalesce(F.col(f"s.{name}"), F.lit(0.0)), F.lit(0.0)).cast("bigint")
    return s.select(
        "session_id",
        F.concat(F.array_repeat(F.lit(0), F.lit(30) - F.size(seq)), seq).alias("event_seq"),
        last("recent_seen", 60, "bigint").alias("recent_seen"),
        F.transform(last("skip_dwells", 240, "double"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))).alias("skip_dwells"),
        whole("step").alias("step"),
        whole("impressions").alias("impressions"),
        F.coalesce(F.col("s.avg_reward"), F.lit(0.0)).alias("avg_reward"),
        F.concat(delta, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(delta))).alias("user_delta"),
        texts("audio_positives").alias("audio_positives"),
        texts("audio_negatives").alias("audio_negatives"),
        F.col("s.pending_audio").alias("pending_audio"),
        F.coalesce(F.col("s.updated_at"), F.lit(0.0)).alias("updated_at"),
    )


def markdown_report(selected: DataFrame, title: str, meta: Mapping[str, object]) -> DataFrame:
    """Report lines (place, line) of the selected clusters, best first; ``selected`` is bounded by its quotas."""
    from pyspark.sql import Window

    head = [f"# {title}", "", *[f"- {k}: {meta[k]}" for k in sorted(meta)], ""]
    lines = F.concat(
        F.array(
            F.concat(F.lit("## "), F.col("_n").cast("string"), F.lit(". "), F.coalesce("neutral_core_summary.headline", F.lit("(no headline)"))),
            F.format_string("- story_id: `%s`", "story_id"),
            F.format_string("- bucket: `%s` (category: `%s`)", "bucket", "topic_category"),
            F.format_string("- size: %d, cohesion: %.3f, src_div: %d, age_days: %.2f", "size", "cohesion", "source_diversity", "age_days"),
        ),
        F.when(F.size("entities") > 0, F.array(F.concat(F.lit("- entities: "), F.array_join(F.transform(F.slice("entities", 1, 10), lambda e: e["entity"]), ", "))))
        .otherwise(F.array()),
        F.when(F.size("key_facts") > 0, F.concat(F.array(F.lit("- key_facts:")), F.transform(F.slice("key_facts", 1, 5), lambda f: F.concat(F.lit("  - "), f))))
        .otherwise(F.array()),
        F.array(F.lit("- supporting_articles:")),
        F.transform(F.slice("supporting_articles", 1, 5), lambda a: F.concat(F.lit("  - "), a["headline"], F.lit(" ("), a["source"], F.lit(")"))),
        F.array(F.lit("")),
    )
    numbered = selected.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("confidence_score"), "story_id")))
    body = numbered.select("_n", F.posexplode(lines).alias("_i", "line")).select((F.col("_n") * 1000 + F.col("_i")).alias("place"), "line")
    top = selected.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "place int, line string")
    return top.unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """One text file: a report has at most a few thousand lines."""
    lines.orderBy("place").coalesce(1).select("line").write.mode("overwrite").text(path)


def evaluation_report(personas: DataFrame, overall: DataFrame) -> DataFrame:
    """One JSON document: conditions -> overall and personas -> metrics (bounded by the number of segments)."""
    metrics = [c for c in personas.columns if c not in ("condition", "persona")]
    per = personas.groupBy("condition").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("persona", F.struct(*metrics).alias("m"))))).alias("personas")
    )
    means = [c for c in overall.columns if c != "condition"]
    joined = per.join(overall, "condition").select("condition", F.struct(F.struct(*means).alias("overall"), "personas").alias("c"))
    return joined.agg(F.map_from_entries(F.collect_list(F.struct("condition", "c"))).alias("conditions")).select(
        F.to_json(F.struct("conditions")).alias("value")
    )
