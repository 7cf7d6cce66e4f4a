"""File edges, stream results against their batch twins, registry and plans."""

import json

import numpy as np
from pyspark.sql import functions as F

from dawnpress.catalog import load
from dawnpress.sources import files
from dawnpress.streaming import sessions as S


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><item><title>One</title><link>http://x/1</link><description>d</description>"
        "<pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Two</title></item></channel></rss>"
    )
    (tmp_path / "b.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><link href="http://x/3"/>'
        "<updated>2024-01-02T00:00:00Z</updated></entry></feed>"
    )
    rows = {r.headline: r for r in files.read_feeds(spark, str(tmp_path)).collect()}
    assert rows["One"].link == "http://x/1" and rows["One"].published.startswith("Mon")
    assert rows["Two"].summary == "" and rows["Three"].link == "http://x/3" and rows["Three"].published == "2024-01-02T00:00:00Z"
    assert rows["Three"].feed.endswith("b.xml")


def test_inventory_round_trip(spark, tmp_path):
    data = [(1, 'Quote "x", and\nline', "s", "l", "2024-01-01T00:00:00Z")]
    df = spark.createDataFrame(data, "Item_ID int, Headline string, Summary string, Link string, Published_UTC string")
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "inv"))
    raw = files.read_inventory(spark, str(tmp_path / "inv"))
    row = files.canonical_inventory(raw).first()
    assert row.headline == 'Quote "x", and\nline' and row.published_utc.year == 2024 and row.vibe_style
    assert files.inventory_for_demand(raw).count() == 1
    assert files.inventory_for_demand(raw.drop("Headline")).count() == 0


def test_interaction_log(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 01:00:00' as timestamp_utc, 's' as session_id, 1L as step")
    files.append_interactions(rows, str(tmp_path / "log"))
    files.append_interactions(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and len(back.columns) == 28


def test_label_cache(spark, tmp_path):
    good = lambda k, e: json.dumps({"key": k, "event": e})
    (tmp_path / "new.jsonl").write_text("\n".join([good("a", "One"), "broken", good("a", "Two"), good("b", " "), good("c", "C")]))
    assert {r.key: r.event for r in files.read_label_cache(spark, str(tmp_path / "new.jsonl")).collect()} == {"a": "Two", "c": "C"}
    (tmp_path / "old.jsonl").write_text("\\n".join([good("a", "One"), good("b", "B"), good("a", "Three")]) + "\\n")
    assert {r.key: r.event for r in files.read_label_cache(spark, str(tmp_path / "old.jsonl")).collect()} == {"a": "Three", "b": "B"}


def test_wishlist(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"queries": [" a", "b", "a", ""], "preferred_domains": "x"}, indent=2))
    row = files.read_wishlist(spark, str(tmp_path / "w.json")).first()
    assert row.queries == ["a", "b"] and row.preferred_domains == [] and row.extra_feed_urls == []


def test_report(spark, sf, tmp_path):
    from dawnpress.catalog.clustering import cores_of

    lines = files.markdown_report(cores_of(spark, sf), "Story Clusters", {"k": 3})
    files.write_report(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert text[0] == "# Story Clusters" and "- k: 3" in text and any(t.startswith("## 1. ") for t in text)


def test_preference_gradient():
    rng = np.random.default_rng(0)
    delta, base, item = rng.normal(size=5) * 0.1, rng.normal(size=5), rng.normal(size=5) * 0.3
    heads = rng.normal(size=(6, 2))
    ratio, reward = 0.7, 3.0

    def loss(d):
        z = (base + d) @ item
        p = 1 / (1 + np.exp(-(heads[:, 0] * z + heads[:, 1])))
        y = np.array([ratio >= 0.95, ratio >= 0.85, ratio >= 0.95, ratio >= 0.9, ratio <= 0.2], float)
        c = np.array([0.8, 0.5, 0.4, 0.4, 0.6])
        bce = -(c * (y * np.log(p[:5]) + (1 - y) * np.log(1 - p[:5]))).sum()
        s = 1 / (1 + np.exp(-(np.array([1.2, 1.0, 1.2, 1.1, -0.8, 1.1]) @ p)))
        return bce + 1.5 * (p[5] - ratio) ** 2 + (s - (reward + 10) / 20) ** 2

    eps = 1e-6
    numeric = np.array([(loss(delta + eps * e) - loss(delta - eps * e)) / (2 * eps) for e in np.eye(5)])
    moved = S.preference_step(delta, base, item, ratio, reward, heads)
    assert np.allclose((delta - moved) / 0.03, numeric, atol=1e-5)
    far = S.preference_step(np.ones(5) * 3, base, item, ratio, reward, heads)
    assert abs(np.linalg.norm(far) - 4.0) < 1e-6


def test_audio_memory_of_stream_and_batch(spark, sf):
    from dawnpress.catalog.streaming import audio_messages, streamed
    from dawnpress.sources import fixtures as X
    from dawnpress.streaming.sinks import drained

    batch = S.audio_memory(S.audio_batch(audio_messages(X.conversations(spark, sf))))
    want = {(r.session_id, r.position, r.kind): r.memory for r in batch.collect()}
    live = drained(S.audio_stream(audio_messages(streamed(spark, sf, "conversations")))).where("status = 'ok'").collect()
    got = {(r.session_id, r["at"]): r for r in live}
    assert want
    for (session, at, kind), memory in want.items():
        assert got[(session, at)][kind] == memory


def test_reader_stream_matches_batch(spark, sf):
    queries, _ = load()
    batch = {r.session_id: (r.pos_anchor, r.neg_anchor) for r in queries["reader_anchors"](spark, sf).collect()}
    rows = queries["reader_sessions_stream"](spark, sf)
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("pos_anchor", "neg_anchor"), "position").alias("s"))
    assert {r.session_id: (r.s.pos_anchor, r.s.neg_anchor) for r in last.collect()} == batch


def test_registry():
    queries, oracles = load()
    assert set(oracles) <= set(queries) and len(queries) > 120


def test_plans_stay_distributed(spark, sf):
    """No cartesian product and no window over a whole fact table in one partition."""
    queries, _ = load()
    for name in ("adaptive_rewards", "rolling_rewards", "popularity_quartile", "row_ids", "domain_demand", "term_demand", "shared_entity_pairs"):
        plan = queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BatchEvalPython" not in plan, name


def test_scan_is_pruned(spark, sf):
    queries, _ = load()
    plan = queries["cohort_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_an_event_counts_again_after_its_time_to_live(spark):
    days = [0, 1, 13, 14, 15, 27, 28, 60]
    rows = [("u", "s", "e", d) for d in days] + [("u", "s", "", d) for d in (0, 0)] + [("u", "s", "f", d) for d in (0, 15)]
    events = spark.createDataFrame(rows, "uid string, session_id string, event_id string, day int")
    events = events.withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(day, 0, 0, 0)"))
    got = S.dedupe_batch(events).collect()
    assert sorted(r.day for r in got if r.event_id == "e") == [0, 14, 28, 60]
    assert sorted(r.day for r in got if r.event_id == "f") == [0, 15] and sum(r.event_id == "" for r in got) == 2


def test_profiles_of_a_small_file_are_dealt_to_all_tasks(spark, sf):
    from dawnpress.sources import fixtures as X

    assert X.table(spark, sf, "customer").rdd.getNumPartitions() == 1
    assert X.profiles(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_session_step_equals_vector_formula():
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(6, 2))
    for _ in range(50):
        delta, base, item = rng.normal(size=(3, 8)) * rng.choice([0.3, 3.0])
        ratio, reward, history = rng.random(), rng.uniform(-10, 10), list(rng.random(rng.integers(0, 30)) * 10)
        p = 1 / (1 + np.exp(-(heads[:, 0] * ((base + delta) @ item) + heads[:, 1])))
        target = np.array([ratio >= 0.95, ratio >= 0.85, ratio >= 0.95, ratio >= 0.9, ratio <= 0.2, ratio])
        slope, loss, weight = p * (1 - p) * heads[:, 0], np.array([S.LOSS[h] for h in S.HEADS]), np.array(S.SIGNED_WEIGHTS)
        r = 1 / (1 + np.exp(-(weight @ p)))
        wanted = np.clip((reward + 10) / 20, 0.05, 0.95)
        pull = (loss[:5] * (p - target)[:5] * heads[:5, 0]).sum() + loss[5] * 2 * (p[5] - ratio) * slope[5]
        pull += S.LOSS["rank"] * 2 * (r - wanted) * r * (1 - r) * (weight @ slope)
        step = pull * item * min(1, S.GRADIENT_CLIP / (np.linalg.norm(pull * item) + 1e-8))
        moved = delta - S.LEARNING_RATE * step
        moved = moved * min(1, S.DELTA_NORM / (np.linalg.norm(moved) + 1e-8))
        assert np.allclose(S.preference_step(delta, base, item, ratio, reward, heads), moved, atol=1e-6)
        if len(history) >= 12:
            z = (ratio * 10 - np.mean(history)) / max(0.35, np.std(history))
            mixed = 6.75 * np.tanh(z / 1.35) + 0.25 * (1.6 * ratio * 10 - 8)
            assert np.isclose(S.skip_reward_of(ratio * 10, history), np.clip(mixed, -10, 10))
