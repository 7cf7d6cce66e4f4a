import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnpress.llm import suffix_dedup


def brute(rows, length):
    """Removed byte positions of each row: windows that also start at a smaller (doc_id, start)."""
    first = {}
    texts = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for d, t in texts:
        gone = set()
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (d, s):
                gone.update(range(s, s + length))
        out.append((len(t), sorted(gone), bytes(b for i, b in enumerate(t) if i not in gone)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = [draw.choice(["the", "an", "é", "rose", "of", "x"]) + draw.choice(["", "a", "ü", "st"]) for _ in range(40)]
    passage = " ".join(draw.choice(words) for _ in range(12))
    line = "common line of everyone"
    rows = []
    for i in range(120):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(0, 25)))
        if i % 3 == 0:
            text = text + line + draw.choice(words) + draw.choice(words)
        if i % 5 == 0:
            text += passage + text[:20]
        if i % 11 == 0 and rows:
            text = rows[draw.randrange(len(rows))][1] or ""
        rows.append((draw.randrange(1000) if i % 17 else i, text))
    rows += [(5000, "a" * 90), (5001, "ab" * 60), (None, passage), (None, None), (5002, ""), (5003, None), (5004, "b" * 8)]
    rows += [rows[3], rows[3], (rows[4][0], rows[6][1])]
    return rows


@pytest.mark.parametrize("length, gram, seed", [(8, 3, 1), (16, 5, 2), (30, 12, 3)])
def test_equals_brute_force(spark, length, gram, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(5)
    got = suffix_dedup.remove_repeats(docs, length, gram).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got)
    want = sorted((d is not None, d or 0, n, len(gone), kept) for (d, _), (n, gone, kept) in zip(rows, brute(rows, length), strict=True))
    assert found == want


def test_segments_end_to_end():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog" * 3, np.uint8)
    windows = len(data) - 12 + 1
    *_, start, n = suffix_dedup.stretches(data, np.array([0]), np.array([windows]), 12, 5)
    assert n.sum() == windows and (np.diff(start) == n[:-1]).all()


def test_window_minimum():
    values = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 61):
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert suffix_dedup.window_minimum(values, width).tolist() == want


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
