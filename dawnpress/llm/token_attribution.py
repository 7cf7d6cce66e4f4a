"""Token counts of sections by offset-mapped attribution.

A document is encoded once and whole, so tokens are those that a model will see, not those of its sections. A byte-level
vocabulary gives the length of every token, their running sum its place. Sections are the lines of the text, each with its
line feed. Tokens meet sections in an interval join on sorted edges; a
token inside one section counts for it, a token across an edge by the rule: ``first`` to the section of its first
byte, ``most`` to the one with most of its bytes (the earlier one if equal), ``share`` to all by their part of its bytes.

Nulls and edges: a null or empty text is one empty section with no token; offsets are code points, end excluded; an edge
inside a character cannot occur, since sections hold whole characters; rows that repeat an id give a row each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import map_batches

RULES = ("first", "most", "share")


class Encoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(k) for k in ranks]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.sizes[self.encode(text, disallowed_special=())])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens cross an edge of it.

    Both arrays are ascending ends in bytes from 0. Empty sections get nothing.
    """
    counts, crossing = np.zeros(len(section_ends)), np.zeros(len(section_ends), np.int64)
    if not len(token_ends):
        return counts, crossing
    starts = np.r_[0, token_ends[:-1]]
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    single = first == last
    counts += np.bincount(first[single], minlength=len(counts))
    for k in np.flatnonzero(~single):  # only tokens across an edge
        a, b = int(first[k]), int(last[k])
        edges = np.r_[starts[k], section_ends[a:b], token_ends[k]]
        part = np.diff(edges)
        crossing[a : b + 1] += part > 0
        if rule == "first":
            counts[a] += 1
        elif rule == "most":
            counts[a + int(part.argmax())] += 1
        else:
            counts[a : b + 1] += part / part.sum()
    return counts, crossing


def line_sections(text: str) -> list[str]:
    """Lines with their line feed; one empty section for an empty text."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + (parts[-1:] if parts[-1] or len(parts) == 1 else [])


def count_tokens(docs: DataFrame, rule: str = "most", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing`` for every section of every row of ``docs``."""
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batch):
        coder, columns = encoder(path, pattern), [[] for _ in range(6)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = line_sections(text or "")
            chars = np.cumsum([len(p) for p in parts])
            ends = chars if (text or "").isascii() else np.cumsum([len(p.encode()) for p in parts])
            counts, crossing = allocate(coder.ends(text) if text else np.zeros(0, np.int64), ends, rule)
            n = len(parts)
            rows = ([doc_id] * n, range(n), [0, *chars[:-1].tolist()], chars.tolist(), counts.tolist(), crossing.tolist())
            for column, values in zip(columns, rows, strict=True):
                column.extend(values)
        return dict(zip(("doc_id", "section", "start", "end", "n_tokens", "n_crossing"), columns, strict=True))

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, section int, start long, end long, n_tokens double, n_crossing long",
    )
