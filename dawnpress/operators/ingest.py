"""Candidate selection, deduplication and domain caps of a crawl.

"Keep the first" always follows an explicit ``pos`` column. Caps in feed order use two-level positions, so no step
sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.operators.frames import first_per_key, global_position, top_per_key
from dawnpress.session import cut_lineage

CHUNK_ROWS = 65_536


def first_rows(df: DataFrame, limit: int, pos: str = "pos") -> DataFrame:
    """The ``limit`` rows of lowest ``pos``, found by chunk counts.

    A row that ``limit`` rows of its own chunk precede is out, so ``df`` is evaluated once, for the first ``limit`` rows of every chunk;
    these are stored and placed.
    """
    tagged = df.withColumn("_part", F.floor(F.col(pos) / CHUNK_ROWS))
    short = cut_lineage(top_per_key(tagged, ["_part"], [pos], limit, "_nth").drop("_nth"))
    placed = global_position(short, [pos], F.col("_part"), "_place")
    return placed.where(F.col("_place") < limit).drop("_place", "_part")


def is_wrapped(link: Column, wrapper: str = W.WRAPPER_DOMAIN) -> Column:
    return T.extract_domain(link) == wrapper


def candidates(entries: DataFrame, target: int | None, wrapper_cap: int | None) -> DataFrame:
    """Feed entries worth keeping, in feed order: quality filter, first per key, caps.

    The wrapper cap counts wrapper entries as they are seen, before quality and duplicates. An entry that fails the
    quality test never claims its key.
    """
    h, s, u = F.col("headline"), F.col("summary"), F.col("link")
    tagged = entries.withColumn("_wrapped", is_wrapped(u))
    if wrapper_cap is not None:
        seen = first_rows(tagged.where("_wrapped"), wrapper_cap)
        tagged = tagged.where(~F.col("_wrapped")).unionByName(seen)
    place = F.when(F.col("_wrapped"), T.topic_name(u, h, s)).otherwise(F.lower(T.strip(u)))
    good = (
        tagged.where(T.quality_item(h, s, u))
        .withColumn("_k1", place)
        .withColumn("_k2", F.lower(T.strip(h)))
    )
    kept = first_per_key(good, ["_k1", "_k2"], ["pos"]).drop("_wrapped", "_k1", "_k2")
    return kept if target is None else first_rows(kept, target)


def merge_new_first(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Union in which a new row replaces an existing one with the same link; ``pos`` is renumbered new-first.

    Rows without a link count as the same link.
    """
    both = new.withColumn("_old", F.lit(0)).unionByName(existing.withColumn("_old", F.lit(1)), allowMissingColumns=True)
    kept = first_per_key(both, ["link"], ["_old", "pos"])
    order = F.struct("_old", F.floor(F.col("pos") / CHUNK_ROWS))
    return global_position(kept, ["_old", "pos"], order, "_pos").drop("_old", "pos").withColumnRenamed("_pos", "pos")


def headline_dedupe(df: DataFrame, per_topic: bool = False) -> DataFrame:
    """First row per tidied headline, or per (headline, topic) in diversity mode."""
    tidy = T.strip(F.regexp_replace(F.lower(T.text_or_empty(F.col("headline"))), T.UNICODE_BLANK, " "))
    out = df.withColumn("_headline", tidy)
    keys = ["_headline"]
    if per_topic:
        out = out.withColumn("_topic", T.topic_name(F.col("link"), F.col("headline"), F.col("summary")))
        keys.append("_topic")
    return first_per_key(out, keys, ["pos"]).drop("_headline", "_topic")


def without_wrappers(df: DataFrame) -> DataFrame:
    return df.where(~is_wrapped(F.col("link")))


def domain_mix(
    df: DataFrame, target: int, wrapper_items: int, now: Column, topic_share: float = 0.12, topic_limit: int | None = None
) -> DataFrame:
    """Newest rows under a cap per topic, a cap on wrapper rows and a total cap.

    A wrapper row refused by its cap does not use up its topic's cap, so topics are ranked twice: once to find the
    wrapper rows that fit, once over what remains. A topic may fill ``topic_share`` of the target, and no more than
    ``topic_limit`` rows if that is given.
    """
    topic_cap = max(1, int(target * topic_share))
    if topic_limit is not None:
        topic_cap = min(topic_cap, topic_limit)
    wrapper_cap = min(wrapper_items, target)
    ts = F.coalesce(F.col("published_utc"), now)
    base = (
        df.withColumn("_ts", F.unix_micros(ts))
        .withColumn("_topic", T.topic_name(F.col("link"), F.col("headline"), F.col("summary")))
        .withColumn("_wrapped", is_wrapped(F.col("link")))
    )
    newest = [F.desc("_ts"), F.asc("pos")]
    hour = -F.floor(F.col("_ts") / F.lit(3_600_000_000))
    picked = top_per_key(base, ["_topic"], newest, topic_cap, "_rank").where("_wrapped").drop("_rank")
    fitting = global_position(picked, newest, hour, "_place").where(F.col("_place") < wrapper_cap).drop("_place")
    rest = base.where(~F.col("_wrapped")).unionByName(fitting)
    capped = top_per_key(rest, ["_topic"], newest, topic_cap, "_rank").drop("_rank")
    placed = global_position(capped, newest, hour, "mix_pos").where(F.col("mix_pos") < target)
    return placed.drop("_ts", "_topic", "_wrapped")


def clean_items(raw: DataFrame, dedupe_url: bool = True) -> DataFrame:
    """Articles ready for clustering: cleaned texts, canonical link, first row per link.

    A row whose raw headline holds an anchor tag is dropped before links are compared; a row without any text is
    dropped after, so it still claims its link.
    """
    stripped = raw.withColumn("raw_headline", T.strip(T.text_or_empty(F.col("headline")))).withColumn(
        "raw_summary", T.strip(T.text_or_empty(F.col("summary")))
    )
    cleaned = (
        stripped.where(~F.contains(F.lower("raw_headline"), F.lit("<a ")))
        .withColumn("headline", T.clean_text(F.col("raw_headline")))
        .withColumn("summary", T.clean_text(F.col("raw_summary")))
        .withColumn("link", T.canonicalize_url(F.col("link")))
    )
    if dedupe_url:
        linked = first_per_key(cleaned.where("link <> ''"), ["link"], ["pos"])
        cleaned = linked.unionByName(cleaned.where("link = ''"))
    return cleaned.where("headline <> '' OR summary <> ''")


def recent_portion(items: DataFrame, overfetch: int, seed: int | None = None) -> DataFrame:
    """The ``overfetch`` newest items (undated ones by row number), or a seeded shuffle of that size."""
    micros = F.coalesce(F.unix_micros("published_utc") / F.lit(1e6), F.col("pos").cast("double"))
    if seed is None:
        ordered = items.withColumn("_ts", micros).orderBy(F.desc("_ts"), F.desc("pos"))
        return ordered.limit(overfetch).drop("_ts")
    return items.orderBy(F.xxhash64(F.col("item_id"), F.lit(seed)), "item_id").limit(overfetch)


def shuffled(items: DataFrame, seed: int, name: str = "shuffle_pos") -> DataFrame:
    """Reproducible random order: position by the md5 of seed and id."""
    keyed = items.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string"))))
    return global_position(keyed, ["_h", "item_id"], F.substring("_h", 1, 3), name).drop("_h")


def title_dedupe(items: DataFrame, threshold: float = 0.92, one_per_event: bool = False) -> DataFrame:
    """Drop titles that repeat the first kept title with the same head signature.

    With ``one_per_event`` a known event key admits one row only, which makes keeping a row depend on what was kept
    before it; that is solved in rounds over all groups at once.
    """
    tokens = items.withColumn("_tokens", T.tokenize(T.clean_text(F.col("headline")))).withColumn(
        "_sig",
        T.blank_to_null(
            F.array_join(T.head_signature(F.filter("_tokens", lambda t: F.length(t) >= 3)), " ")
        ),
    )
    if not one_per_event:
        firsts = (
            tokens.where(F.col("_sig").isNotNull())
            .groupBy("_sig")
            .agg(F.min("pos").alias("_first"), F.min_by("_tokens", "pos").alias("_first_tokens"))
        )
        joined = tokens.join(firsts, "_sig", "left")
        repeat = (F.col("pos") > F.col("_first")) & (T.jaccard(F.col("_tokens"), F.col("_first_tokens")) >= threshold)
        return joined.where(~F.coalesce(repeat, F.lit(False))).drop("_tokens", "_sig", "_first", "_first_tokens")
    event = F.lower(T.strip(T.text_or_empty(F.col("event_key"))))
    open_rows = cut_lineage(
        tokens.select(
            "item_id",
            "pos",
            F.array_distinct("_tokens").alias("_tokens"),
            "_sig",
            F.when(~event.isin("", "unknown_event"), event).alias("_event"),
        )
    )
    kept = None
    while True:
        kept_now, open_rows = _greedy_round(open_rows, kept, threshold)
        kept = kept_now if kept is None else kept.unionByName(kept_now)
        kept = cut_lineage(kept)
        if open_rows.isEmpty():
            break
    return items.join(kept.select("item_id"), "item_id", "left_semi")


def _greedy_round(open_rows: DataFrame, kept: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round: keep rows that nothing earlier can stop, drop rows stopped by a kept one."""
    waiting = open_rows.groupBy("_event").agg(F.min("pos").alias("_event_first"))
    waiting_sig = open_rows.groupBy("_sig").agg(F.min("pos").alias("_sig_first"))
    state = open_rows.join(waiting, "_event", "left").join(waiting_sig, "_sig", "left")
    if kept is not None:
        leaders = (
            kept.where("_sig is not null")
            .groupBy("_sig")
            .agg(F.min("pos").alias("_lead"), F.min_by("_tokens", "pos").alias("_lead_tokens"))
        )
        taken = kept.where("_event is not null").select("_event").distinct().withColumn("_taken", F.lit(True))
        state = state.join(leaders, "_sig", "left").join(taken, "_event", "left")
    else:
        state = state.withColumns(
            {
                "_lead": F.lit(None).cast("bigint"),
                "_lead_tokens": F.lit(None).cast("array<string>"),
                "_taken": F.lit(None).cast("boolean"),
            }
        )
    # A kept row leads its signature only once no earlier row of that signature is undecided.
    leads = F.col("_lead").isNotNull() & (F.col("_lead") < F.col("_sig_first"))
    similar = T.jaccard(F.col("_tokens"), F.col("_lead_tokens")) >= threshold
    stopped = F.coalesce(F.col("_taken"), F.lit(False)) | F.coalesce(leads & similar, F.lit(False))
    event_free = F.col("_event").isNull() | (F.col("_event_first") == F.col("pos"))
    sig_free = F.col("_sig").isNull() | F.when(leads, ~similar).otherwise(F.col("_sig_first") == F.col("pos"))
    judged = cut_lineage(
        state.select(
            "item_id", "pos", "_tokens", "_sig", "_event",
            F.when(stopped, "drop").when(event_free & sig_free, "keep").otherwise("open").alias("_state"),
        )
    )
    return (
        judged.where("_state = 'keep'").drop("_state"),
        judged.where("_state = 'open'").drop("_state"),
    )
