import random

import pytest
import xxhash
from pyspark.sql import functions as F

from dawnpress.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                ids[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def texts():
    draw = random.Random(5)
    words = [f"wörd{i}" if i % 7 == 0 else f"Word{i}" for i in range(50)]
    rows = []
    for i in range(150):
        if i % 4 or not rows:
            rows.append(" ".join(draw.choice(words) for _ in range(draw.randrange(0, 120))))
        else:
            copy = rows[draw.randrange(len(rows))].split(" ")
            copy[draw.randrange(len(copy))] = "changed"
            rows.append("\n".join(copy))
    return rows + [None, "", " \t", "one", "ONE", "one two", "É é", "\x1c a\x0bb"]


def test_fingerprints():
    assert all(simhash.simhash(t.encode()) % (1 << 64) == brute_print(t) for t in texts() if t)
    assert simhash.simhash(None) == simhash.simhash(b"") == 0


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500)).encode()
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "CHUNK", 17)
    assert simhash.simhash(text) == whole


def test_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("fp", F.lit("x"))
    prints = [brute_print(t) for t in rows]
    roots = brute_components(prints)
    first = {r: min(i for i, x in enumerate(roots) if x == r) for r in set(roots)}
    want = {i: (f"{p:016x}", first[r]) for i, (p, r) in enumerate(zip(prints, roots, strict=True))}
    found = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id")
    assert {r.doc_id: (r.f, r.component_id) for r in found.collect()} == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_all_near_fingerprints_are_linked(spark, radius):
    draw = random.Random(radius)
    base = [draw.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << k for k in draw.sample(range(64), n)) for b in base[:6] for n in (1, 2, 3, 4, 5)]
    values += [0, 1, 3, 1 << 63, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius).collect()
    unsigned = [v % (1 << 64) for v in signed]
    joined = brute_components(unsigned, radius)
    assert all(((a.src ^ a.dst) % (1 << 64)).bit_count() <= radius for a in links)
    place = {v: i for i, v in enumerate(signed)}
    linked = list(range(len(signed)))
    for a in links:
        x, y = linked[place[a.src]], linked[place[a.dst]]
        linked = [x if c == y else c for c in linked]
    assert len(set(zip(joined, linked, strict=True))) == len(set(joined)) == len(set(linked))


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.ball_links(spark.range(1).withColumnRenamed("id", "fp"), 3)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A B C D"), (None, "a b c d"), (None, "alone in the world"), (9, None), (8, "")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 3), (3, 3), (7, 3), (7, 3), (8, 8), (9, 8)]
    kept = simhash.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 3, 8]


def edited(text, rate, draw):
    return " ".join("new%d" % draw.randrange(10**6) if draw.random() < rate else w for w in text.split())


def plain_jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_planted_edits_are_near_copies(spark):
    draw = random.Random(11)
    pairs = []
    for i in range(240):
        text = " ".join(f"w{draw.randrange(3000)}" for _ in range(draw.choice([40, 150, 600, 2500])))
        pairs.append((text, edited(text, (0.005, 0.01, 0.02, 0.04)[i % 4], draw)))
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect()}
    alike = [plain_jaccard(*p) >= 0.8 for p in pairs]
    found = [2 * i + 1 not in kept for i in range(len(pairs))]
    assert not any(f and not a for f, a in zip(found, alike, strict=True))  # verified pairs only
    assert 100 < sum(alike) < len(pairs) and sum(found) >= 0.98 * sum(alike)
    assert all(2 * i in kept for i in range(len(pairs)))


def test_a_large_group_of_near_copies_leaves_its_first(spark):
    draw = random.Random(12)
    text = " ".join(f"w{draw.randrange(3000)}" for _ in range(400))
    rows = [(i, text if i == 0 else edited(text, 0.01, draw)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alike = [plain_jaccard(text, t) >= 0.8 for _, t in rows]
    assert simhash.keep_first(docs, similarity=0.8).count() <= 1 + (len(rows) - sum(alike))


def test_stage_setting_edges(spark):
    schema = "doc_id long, text string"
    assert simhash.keep_first(spark.createDataFrame([], schema), similarity=0.8).collect() == []
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A B  C D"), (None, "a b c d"), (None, None), (9, None), (8, ""), (5, "a b c e")]
    kept = simhash.keep_first(spark.createDataFrame(rows, schema), similarity=0.8).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 3, 5, 8]
