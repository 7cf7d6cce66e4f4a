import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dawnpress.llm import token_attribution as attribution


def brute(token_ends, section_ends, rule):
    counts, crossing, start = [0.0] * len(section_ends), [0] * len(section_ends), 0
    bounds = list(zip([0, *section_ends[:-1]], section_ends, strict=True))
    for end in token_ends:
        parts = [max(0, min(end, b) - max(start, a)) for a, b in bounds]
        met = [i for i, p in enumerate(parts) if p]
        if len(met) > 1:
            for i in met:
                crossing[i] += 1
        if rule == "share":
            for i in met:
                counts[i] += parts[i] / (end - start)
        else:
            counts[met[0] if rule == "first" else max(met, key=lambda i: (parts[i], -i))] += 1
        start = end
    return counts, crossing


@pytest.mark.parametrize("rule", attribution.RULES)
def test_allocation(rule):
    draw = np.random.default_rng(4)
    for _ in range(200):
        n = int(draw.integers(1, 30))
        tokens = np.unique(np.r_[draw.integers(1, n + 1, 6), n])
        sections = np.sort(np.r_[draw.integers(0, n + 1, 4), n])
        counts, crossing = attribution.allocate(tokens, sections, rule)
        want = brute(tokens.tolist(), sections.tolist(), rule)
        assert np.allclose(counts, want[0]) and crossing.tolist() == want[1]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_add_up_to_whole_documents(spark, sf, rule):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("section", F.lit("x"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(coder.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    found = attribution.count_tokens(docs, rule)
    sums = {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert {k: round(v, 6) for k, v in sums.items()} == want
    lengths = found.groupBy("doc_id").agg(F.max("end").alias("end")).join(docs, "doc_id").where("end <> length(text)")
    assert lengths.count() == 0


def test_edges(spark):
    schema = "doc_id long, text string"
    assert attribution.count_tokens(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (None, "é\nü"), (5, "<|endoftext|>"), (5, "<|endoftext|>"), (6, "no end\r\nx\n")]
    found = attribution.count_tokens(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.section, r.start, r.end) for r in found) == [
        (0, 0, 0, 2), (0, 1, 2, 3), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 1), (3, 1, 1, 2), (3, 2, 2, 3), (5, 0, 0, 13), (5, 0, 0, 13), (6, 0, 0, 8), (6, 1, 8, 10),
    ]
    with pytest.raises(ValueError):
        attribution.count_tokens(spark.createDataFrame(rows, schema), "none")
