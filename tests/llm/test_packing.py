import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dawnpress.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello, World! it's DON'T i'LL 's", "a <|endoftext|> B<|startoftext|>c", "  ", "", "é É é Σ ΑΣ ß İ", "x" * 300, "日本語 テキスト　b",
    "tab\tnew\nline\x0bv\x0cf\rr", "a\x1cb \x1d c\x85d\xa0e f", "12 3.5 +1 (988) 555-2485", "***bad%%% word$$$", "naïve,co-op", "﻿bom", "'" * 5,
]


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(monkeypatch):
    want = [np.array(plain_ids(t), "<u4").tobytes() for t in ODD]
    assert list(packing.encode([*ODD, None], PATH)) == [*want, b""]
    monkeypatch.setattr(packing, "CACHED", 3)
    monkeypatch.setattr(packing, "GROUP", 8)
    assert list(packing.encode(ODD * 2, PATH)) == want * 2


def test_nnls_finds_the_optimum():
    draw = np.random.default_rng(3)
    for _ in range(10):
        a, b = draw.random((6, 9)), draw.normal(size=6)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-7).all() and abs(slope[x > 0]).max(initial=0) < 1e-7


def test_patterns():
    assert sorted(packing.patterns(5, 3)) == [(2, 2, 1), (3, 1, 1), (3, 2), (4, 1), (5,)]


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([draw.randrange(1, 33), 1, 32, draw.randrange(8, 20)]) for _ in range(draw.choice([0, 1, 40, 700]))]
    histogram = {n: sizes.count(n) for n in set(sizes)}
    runs, count = packing.plan(histogram, capacity=32, grid=4)
    fill = {}
    for length, first, number, sequence, offset in runs.tolist():
        for i in range(number):
            fill.setdefault(sequence + i, []).append((offset, length))
    assert sorted(n for x in fill.values() for _, n in x) == sorted(sizes)
    for parts in fill.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 32
    assert set(fill) == set(range(count))
    for n in histogram:
        ranks = sorted((f, f + k) for length, f, k, *_ in runs.tolist() if length == n)
        assert ranks[0][0] == 0 and ranks[-1][1] == histogram[n] and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))
    alone = packing.Packer(histogram, 32)
    alone.best_fit()
    assert count <= alone.sequences * 1.02 + 1


def check_packing(rows, found, capacity):
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids = [*plain_ids(text or ""), 1]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), capacity))
        for r in pieces:
            part = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    fill = {}
    for r in found:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity


def test_equals_the_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("sequence_id", F.lit("x"))
    found = packing.pack_documents(docs, capacity=512).collect()
    check_packing([(r.doc_id, r.text) for r in docs.collect()], found, 512)
    low = -(-sum(r.length for r in found) // 512)
    assert len({r.sequence_id for r in found}) <= 1.02 * low


def test_edges(spark):
    schema = "doc_id long, text string"
    assert packing.pack_documents(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None), (2, ""), (3, "a b " * 40), (4, "same"), (5, "same")]
    check_packing(rows, packing.pack_documents(spark.createDataFrame(rows, schema), capacity=16).collect(), 16)
    twice = packing.pack_documents(spark.createDataFrame([(4, "same")] * 5 + [(None, "x")] * 2, schema)).collect()
    assert len(twice) == 7 and len({(r.sequence_id, r.offset) for r in twice}) == 7
