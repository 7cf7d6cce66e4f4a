"""Set-based ingest steps equal the sequential procedure."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dawnpress.operators import ingest, pools
from dawnpress.operators.features import popularity

NOW = dt.datetime(2024, 2, 1)


def feed(rng, n):
    out = []
    for i in range(n):
        wrapped = rng.random() < 0.4
        topic = rng.choice(["a.com", "b.com", "c.com"])
        link = f"https://news.google.com/x/{rng.randint(0, 30)}" if wrapped else f"https://{topic}/{rng.randint(0, 20)}"
        head = f"headline number {rng.randint(0, 12)} with several more words" if rng.random() < 0.9 else "short"
        head += f" - {topic}" if wrapped else ""
        out.append((i, head, "s" * rng.choice([10, 60]), link, NOW - dt.timedelta(minutes=rng.randint(0, 200))))
    return out


SCHEMA = "pos bigint, headline string, summary string, link string, published_utc timestamp"


def is_wrapped(row):
    return "news.google.com" in row[3]


def topic_of(row):
    return row[1].rsplit(" - ", 1)[-1] if is_wrapped(row) and " - " in row[1] else row[3].split("/")[2]


@pytest.mark.parametrize("seed", range(3))
def test_candidates(spark, seed):
    data = feed(random.Random(seed), 150)
    seen, kept, wrappers = set(), [], 0
    for row in data:
        if len(kept) >= 25:
            break
        key = (row[3].lower(), row[1].lower())
        if is_wrapped(row):
            if wrappers >= 40:
                continue
            wrappers += 1
            key = (topic_of(row), row[1].lower())
        if key in seen or len(row[1]) < 25 or (len(row[2]) < 40 and not is_wrapped(row)):
            continue
        seen.add(key)
        kept.append(row[0])
    got = ingest.candidates(spark.createDataFrame(data, SCHEMA), 25, 40)
    assert sorted(r.pos for r in got.collect()) == kept


@pytest.mark.parametrize("seed", range(4))
def test_domain_mix(spark, seed):
    data = feed(random.Random(seed), 200)
    target, wrapper_items = 40, 9
    cap, wrapper_cap = max(1, int(target * 0.12)), min(wrapper_items, target)
    counts, wrappers, picked = {}, 0, []
    for row in sorted(data, key=lambda r: (-r[4].timestamp(), r[0])):
        topic = topic_of(row)
        if is_wrapped(row) and wrappers >= wrapper_cap or counts.get(topic, 0) >= cap:
            continue
        picked.append(row[0])
        counts[topic] = counts.get(topic, 0) + 1
        wrappers += is_wrapped(row)
        if len(picked) >= target:
            break
    got = ingest.domain_mix(spark.createDataFrame(data, SCHEMA), target, wrapper_items, F.lit(NOW))
    assert [r.pos for r in got.orderBy("mix_pos").collect()] == picked


def test_title_dedupe_one_per_event(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "carbon", "delta"]
    data = []
    for i in range(120):
        head = " ".join(rng.sample(words, 3)) + rng.choice(["", " of", " x1"])
        data.append((i, i, head, rng.choice(["e1", "e2", "e3", "unknown_event", "unknown_event", "unknown_event"])))
    stop, kept, lead, events = {"of"}, [], {}, set()
    for _, i, head, event in data:
        tokens = [t for t in head.split() if t not in stop]
        sig = tuple(sorted(t for t in tokens if len(t) >= 3)[:10])
        if event != "unknown_event" and event in events:
            continue
        if sig in lead:
            a, b = set(tokens), lead[sig]
            if len(a & b) / len(a | b) >= 0.92:
                continue
        if event != "unknown_event":
            events.add(event)
        lead.setdefault(sig, set(tokens))
        kept.append(i)
    df = spark.createDataFrame(data, "pos bigint, item_id bigint, headline string, event_key string")
    got = ingest.title_dedupe(df, one_per_event=True)
    assert sorted(r.item_id for r in got.collect()) == kept


def test_popularity_matches_quantile_cut(spark):
    import pandas as pd

    rng = random.Random(3)
    topics = [rng.choice("aaabbcdefg") for _ in range(97)]
    df = spark.createDataFrame(list(enumerate(topics)), "pos bigint, topic_name string")
    series = pd.Series(topics)
    want = pd.qcut(series.map(series.value_counts()).rank(method="first"), 4, labels=False).tolist()
    assert [r.popularity_bucket for r in popularity(df).orderBy("pos").collect()] == want


def test_pool_refresh_limits(spark):
    inventory = spark.createDataFrame(
        [(i, f"l{i}", "Big.com" if i % 5 else "small.com", i % 5) for i in range(600)],
        "item_id bigint, link string, topic_name string, recency_bucket int",
    )
    first = pools.bootstrap_pools(inventory)
    sizes = {r.cluster_id: r["count"] for r in first.groupBy("cluster_id").count().collect()}
    assert sizes == {"big.com": 140, "small.com": 120}
    same_day = pools.refresh_pools(first, inventory, day_changed=False)
    assert {(r.cluster_id, r.link) for r in same_day.collect()} == {(r.cluster_id, r.link) for r in first.collect()}
    next_day = pools.refresh_pools(first, inventory, day_changed=True)
    new = next_day.join(first.select("cluster_id", "link"), ["cluster_id", "link"], "left_anti")
    assert new.count() == 20 and next_day.where("cluster_id = 'big.com'").count() == 140
    # The links queued first leave first.
    gone = first.join(next_day.select("cluster_id", "link"), ["cluster_id", "link"], "left_anti")
    assert {r.queue_pos for r in gone.collect()} == set(range(1, 21))


def test_pools_in_micro_batches(spark, tmp_path):
    from dawnpress.sources.snapshots import latest_snapshot
    from dawnpress.streaming.sinks import refresh_pools_on_batch

    refresh = refresh_pools_on_batch(str(tmp_path / "pools"))
    schema = "item_id bigint, link string, topic_name string, recency_bucket int, day_utc string"
    for batch, day in enumerate(["2024-01-01", "2024-01-01", "2024-01-02"]):
        rows = [(i, f"l{i}", "t", i % 5, day) for i in range(300 + 10 * batch)]
        refresh(spark.createDataFrame(rows, schema), batch)
    last = latest_snapshot(spark, str(tmp_path / "pools"))
    assert last.count() == 140 and last.select("new_added_today").first()[0] == 20
    assert latest_snapshot(spark, str(tmp_path / "pools"), before=1).select("day_utc").first()[0] == "2024-01-01"


def test_first_rows_evaluate_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(pos):
        seen.add(1)
        return pos

    rows = spark.createDataFrame([(p * 40_000,) for p in range(50)] + [(0,), (None,)], "pos bigint")
    marked = rows.withColumn("mark", F.udf(mark, "bigint")("pos"))
    kept = sorted(r.mark for r in ingest.first_rows(marked, 7).collect())
    assert kept == [0, 0, 40_000, 80_000, 120_000, 160_000]  # a row without a position is none, but takes a place
    assert seen.value == 52
