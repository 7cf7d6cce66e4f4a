"""Quality rules by compression bands.

zstandard ratios (plain bytes over compressed bytes) of the whole text and of fixed chunks are held against limits that
depend on the length: a short text has no room to repeat itself and pays for the frame, a long one compresses better. A
text is rejected if its whole ratio leaves the band of its length, or if more than a set share of its bytes lies in chunks that
leave the band of their length; the last chunk may be shorter. Limits are fixed values, wide enough to leave ordinary prose alone;
the lower ones from 256 bytes on lie above base64 (1.26 below 1,024 bytes, 1.33 above) and below prose of test table sf0.1 (1.34 and 1.69).

Base rules: at least ten words, and at most a fifth of the words in five-word windows that occur twice or more.

Edges: a null text counts as empty; it has no words and fails the base rule; its ratio is 1. Repeated rows are judged
alike, one row each. Texts of any length are read whole, chunk by chunk. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import map_batches

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Upper limit of the bytes of a text, lowest and highest ratio allowed below it. The lowest follow the ratio of base64
#: with line breaks (1.06 at 256 bytes, 1.19 at 512, 1.26 at 1,024, 1.29 at 2,048, 1.31 at 4,096) closely from above.
BANDS = (
    (256, 0.60, 3.0),
    (320, 1.12, 4.0),
    (448, 1.17, 4.0),
    (640, 1.22, 4.0),
    (1024, 1.27, 4.0),
    (2048, 1.30, 5.0),
    (4096, 1.33, 5.0),
    (16384, 1.35, 6.0),
    (65536, 1.40, 7.0),
    (float("inf"), 1.40, 8.0),
)
#: The same for texts of at least ``WIDE`` bytes a character, so of scripts other than Latin: short prose of thousands of signs hardly
#: repeats, and encodings such as base64 are not of this kind.
WIDE = 1.5
WIDE_BANDS = ((1024, 0.60, 4.0), (4096, 1.05, 5.0), (16384, 1.15, 6.0), (65536, 1.25, 7.0), (float("inf"), 1.25, 8.0))
#: Bytes of UTF-8 that begin no character.
CONTINUED = bytes(range(0x80, 0xC0))
CHUNK = 4096
#: Share of the bytes in chunks outside their band above which a text is rejected.
CHUNK_SHARE = 0.25
LEVEL = 3
WINDOW = 5
#: Below this number of words windows are counted as tuples, above as sorted arrays; both are exact.
TUPLES = 100_000


def repeated_window_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n <= TUPLES:
        windows = list(zip(*(islice(words, k, None) for k in range(window))))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        known: dict = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        key = ids[:n]
        for k in range(1, window):  # ranks of pairs stay below the number of words, so the product is exact
            key = np.unique(key * len(known) + ids[k : k + n], return_inverse=True)[1]
        twice = np.bincount(key)[key] > 1
    edges = np.zeros(n + window, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def base_counts(text: str | None, raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def ratio(raw: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(raw) / len(packer.compress(raw)) if raw else 1.0


def in_band(raw: bytes, value: float, most: int) -> bool:
    """Whether a ratio is allowed for bytes of this script, at their length or just below ``most``."""
    bands = WIDE_BANDS if len(raw) >= WIDE * len(raw.translate(None, CONTINUED)) and raw else BANDS
    low, high = next((low, high) for end, low, high in bands if min(len(raw), most) < end)
    return low <= value <= high


def verdict(raw: bytes | None, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of the bytes in chunks outside their band, and whether the text passes."""
    raw = raw or b""
    whole = ratio(raw, packer)
    chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
    outside = sum(len(x) for x in chunks if not in_band(x, ratio(x, packer), CHUNK - 1)) / len(raw) if raw else 0.0
    return whole, outside, in_band(raw, whole, len(raw)) and outside <= CHUNK_SHARE


def score(docs: DataFrame) -> DataFrame:
    """Base counts, ratios and verdicts for every row of ``docs``."""

    def run(batch):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        rows = [(base_counts(r and r.decode(), r), verdict(r, packer)) for r in batch.column(1).to_pylist()]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {"doc_id": batch.column(0)} | {k: [b[i] for b, _ in rows] for i, k in enumerate(names)}
        return out | {k: [v[i] for _, v in rows] for i, k in enumerate(("whole_ratio", "chunks_outside", "passes"))}

    scored = map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "whole_ratio double, chunks_outside double, passes boolean",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("passes")).drop("passes")
