"""Crawl plan: which feed URLs to fetch next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.functions import wordlists as W
from dawnpress.operators.frames import first_per_key


def niche_queries(niches: DataFrame, templates: Sequence[str] = tuple(W.NICHE_TEMPLATES)) -> DataFrame:
    """(pos, niche) x templates -> (pos, query), first of equal queries kept."""
    filled = [F.replace(F.lit(t), F.lit("{niche}"), F.col("niche")) for t in templates]
    expanded = niches.select("pos", F.posexplode(F.array(*filled)).alias("_i", "query"))
    numbered = expanded.select((F.col("pos") * len(templates) + F.col("_i")).alias("pos"), "query")
    return first_per_key(numbered, ["query"], ["pos"])


def query_variants(queries: DataFrame, suffixes: Sequence[str] = ("", " when:7d", " when:30d")) -> DataFrame:
    """Each query as it is and limited to recent periods."""
    forms = F.array(*[F.concat("query", F.lit(s)) for s in suffixes])
    expanded = queries.select("pos", F.posexplode(forms).alias("_i", "query"))
    numbered = expanded.select((F.col("pos") * len(suffixes) + F.col("_i")).alias("pos"), "query")
    return first_per_key(numbered, ["query"], ["pos"])


def time_slices(queries: DataFrame, now: Column, slice_hours: int, lookback_hours: int) -> DataFrame:
    """Each query once per time slice, slice by slice; without slices the distinct queries."""
    if slice_hours <= 0:
        return first_per_key(queries, ["query"], ["pos"])
    lookback = max(slice_hours, lookback_hours)
    count = -(-lookback // slice_hours)
    start = F.unix_seconds(now) - lookback * 3600
    slices = queries.select("pos", "query", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_s"))
    t0 = F.timestamp_seconds(start + F.col("_s") * slice_hours * 3600)
    t1 = F.timestamp_seconds(F.least(start + (F.col("_s") + 1) * slice_hours * 3600, F.unix_seconds(now)))
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    ranged = F.concat(
        "query", F.lit(" after:"), F.date_format(t0, pattern), F.lit(" before:"), F.date_format(t1, pattern)
    )
    # Slice by slice order: all queries of the first slice come first.
    return slices.select(F.struct("_s", "pos").alias("pos"), ranged.alias("query"))


def quote_plus(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_urls(queries: DataFrame, locales: Sequence[tuple[str, str, str]] = tuple(W.LOCALES)) -> DataFrame:
    """One aggregator search feed per query and locale."""
    rows = F.array(
        *[F.struct(F.lit(g).alias("gl"), F.lit(h).alias("hl"), F.lit(c).alias("ceid")) for g, h, c in locales]
    )
    spread = queries.select("pos", "query", F.posexplode(rows).alias("_l", "loc"))
    url = F.concat(
        F.lit(W.SEARCH_URL.split("{query}")[0]),
        quote_plus(F.col("query")),
        F.lit("&hl="),
        F.col("loc.hl"),
        F.lit("&gl="),
        F.col("loc.gl"),
        F.lit("&ceid="),
        F.col("loc.ceid"),
    )
    return spread.select((F.col("pos") * len(locales) + F.col("_l")).alias("pos"), url.alias("url"))


def crawl_plan(
    wishlist: DataFrame,
    base: DataFrame,
    niches: DataFrame,
    feeds: DataFrame,
    now: Column,
    max_queries: int = 1200,
    diversity: bool = True,
    slice_hours: int = 0,
    slice_lookback_hours: int = 48,
) -> DataFrame:
    """Feed URLs in fetch order: wished-for queries, then the base ones, then niches; direct feeds last.

    Inputs are (pos, query), (pos, query), (pos, niche) and (pos, url). ``max_queries`` bounds everything after the
    query selection.
    """
    stages = [wishlist.select("pos", "query"), base.select("pos", "query")]
    if diversity:
        stages.append(niche_queries(niches))
    tagged = [s.select(F.lit(i).alias("_stage"), "pos", "query") for i, s in enumerate(stages)]
    pool = tagged[0]
    for more in tagged[1:]:
        pool = pool.unionByName(more)
    distinct = first_per_key(pool, ["query"], ["_stage", "pos"])
    suffixes = ("", " when:7d", " when:30d") if diversity else ("",)
    # Positions are only comparable inside a stage: lift them above each other before expanding.
    lifted = distinct.select((F.col("_stage") * F.lit(1 << 40) + F.col("pos")).alias("pos"), "query")
    sliced = time_slices(query_variants(lifted, suffixes), now, slice_hours, slice_lookback_hours)
    chosen = sliced.orderBy("pos").limit(max_queries)
    place = F.row_number().over(Window.orderBy("pos")) - 1
    ranked = chosen.select(place.cast("bigint").alias("pos"), "query")
    searches = search_urls(ranked).select(F.lit(0).alias("_part"), "pos", "url")
    direct = feeds.select(F.lit(1).alias("_part"), F.col("pos").cast("bigint").alias("pos"), "url")
    return first_per_key(searches.unionByName(direct), ["url"], ["_part", "pos"]).select(
        F.col("_part").alias("direct"), "pos", "url"
    )

