"""Best-fit packing: patterns of few pieces by non-negative least squares, residuals by best fit.

Documents are encoded whole, closed with an end id and cut into pieces only above the capacity. Only the histogram of
piece lengths (at most ``capacity`` numbers) reaches the driver. There all patterns of up to three lengths that fill a
sequence on a coarse grid are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and pieces are dealt to all places of the patterns but the last; the closing pieces and all
residuals are packed by best fit, longest first, which takes up what rounding to the grid left over. The plan is a list of runs: so many pieces of one length
go to so many consecutive sequences at one offset. Pieces are numbered within their length in bounded chunks, and each finds its
run by its number.

Nulls and edges: a null or empty text is one piece, the end id alone; rows that repeat an id are packed each for itself;
rows with a null id too; texts of any length are cut into pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import map_batches, stored
from dawnpress.operators.frames import sequence_number

CAPACITY = 4096
END_ID = 1
GRID = 16
PATTERN_PIECES = 3
#: Cached chunks and words per Python worker; beyond that the later half goes, as frequent ones come early. Longer ones are
#: not cached.
CACHED, CACHED_LENGTH = 600_000, 48
#: Characters of text whose unknown chunks are looked up together.
GROUP = 1 << 18
#: Pieces of one length that are numbered in one task.
RANKED_ROWS = 200_000


class ChunkIds:
    """Ids of runs of text between white space, as little-endian bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks in order.
    A chunk of Latin letters followed by ASCII punctuation is two words to it, of which case does not matter; unknown words are
    encoded together, one space apart, and told apart again by the mark that ends a word's last id.
    """

    PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
    #: White space to Python's split() but not to the tokenizer.
    CONTROLS = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}  # chunks, and the words that they consist of

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > CACHED:
            self.known = dict(islice(self.known.items(), CACHED // 2 + 1))
        known = self.known
        split = {c: (m[1].lower(), m[2]) for c in chunks if len(c) <= CACHED_LENGTH and (m := self.PARTS.fullmatch(c))}
        new = list({w for pair in split.values() for w in pair if w not in known})
        if new:
            ids = self.ids(" ".join(new))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(new):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))
            else:
                known.update((w, self.ids(w).tobytes()) for w in new)
        for chunk, (word, tail) in split.items():
            if chunk not in known:
                known[chunk] = known[word] + known[tail] if tail else known[word]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") if any(c in t for c in self.CONTROLS) else t.split() for t in texts]
        found = [list(map(self.known.get, p)) for p in parts]
        unknown = {c for p, f in zip(parts, found, strict=True) if None in f for c, x in zip(p, f, strict=True) if x is None}
        if unknown:
            self.learn(unknown)
            fresh = {c: self.known[c] if c in self.known else self.ids(c).tobytes() for c in unknown}
            for p, f in zip(parts, found, strict=True):
                if None in f:
                    f[:] = [fresh[c] if x is None else x for c, x in zip(p, f, strict=True)]
        return [b"".join(f) for f in found]


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def encode(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of whole texts, unsigned 32-bit little-endian; a null text has none."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP:
            yield from chunk_ids(path).encode(group)
            group, size = [], 0
    if group:
        yield from chunk_ids(path).encode(group)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batch):
        ids, rows = batch.column(0).to_pylist(), []
        for doc_id, coded in zip(ids, encode(batch.column(1).to_pylist(), path), strict=True):
            coded += end
            for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                part = coded[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), strict=True))

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def nnls(matrix: np.ndarray, wanted: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets: x >= 0 with the smallest ``|matrix x - wanted|``."""
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(wanted).max(initial=0.0)))
    for _ in range(rounds):
        gain = matrix.T @ (wanted - matrix @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance or active.sum() >= matrix.shape[0]:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            fit = np.linalg.lstsq(matrix[:, at], wanted, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[at] = fit
                break
            low = fit <= 0
            step = (x[at][low] / (x[at][low] - fit[low] + 1e-300)).min()
            x[at] += step * (fit - x[at])
            active[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(parts: int, most: int = PATTERN_PIECES) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``most`` positive numbers that add up to ``parts``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < most:
            for k in range(min(left, head[-1] if head else left), 0, -1):
                if k * (most - len(head)) < left:
                    break
                extend((*head, k), left - k)

    extend((), parts)
    return found


class Packer:
    """Sequences as runs of equal fill: ``open[room]`` holds (first sequence, number of sequences)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(histogram)
        self.used = dict.fromkeys(histogram, 0)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset

    def new(self, count: int) -> tuple[int, int]:
        self.sequences += count
        return self.sequences - count, count

    def place(self, length: int, run: tuple[int, int], room: int) -> int:
        """Put pieces of ``length`` into the sequences of ``run``, one each, as far as they go; the number put."""
        first, count = run
        put = min(count, self.left[length])
        self.runs.append((length, self.used[length], put, first, self.capacity - room))
        self.used[length] += put
        self.left[length] -= put
        self.open[room - length].append((first, put))
        if put < count:
            self.open[room].append((first + put, count - put))
        return put

    def deal(self, lengths: list[int], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """One piece from ``lengths`` to each sequence of ``runs`` (first, count, room); the runs with their new room."""
        out, at = [], 0
        for first, count, room in runs:
            while count:
                while not self.left[lengths[at]]:
                    at += 1
                put = self.place(lengths[at], (first, count), room)
                self.open[room - lengths[at]].pop(-1)
                if put < count:
                    self.open[room].pop(-1)
                out.append((first, put, room - lengths[at]))
                first, count = first + put, count - put
        return out

    def fill(self, shapes: list[tuple[int, ...]], repeats: np.ndarray, bins: dict[int, list[int]]) -> None:
        """Open so many sequences of each pattern and deal pieces to all its places but the last."""
        for j in np.flatnonzero(repeats).tolist():
            shape = shapes[j]
            supply = min(sum(self.left[n] for n in bins[k]) // shape.count(k) for k in set(shape))
            count = min(int(repeats[j]), supply)
            if count:
                runs = [(*self.new(count), self.capacity)]
                for i, k in enumerate(shape[:-1]):
                    runs = self.deal(bins[k] if i % 2 == 0 else bins[k][::-1], runs)
                for first, number, room in runs:
                    self.open[room].append((first, number))

    def best_fit(self) -> None:
        for length in sorted((n for n, k in self.left.items() if k), reverse=True):
            while self.left[length]:
                room = next((r for r in range(length, self.capacity + 1) if self.open[r]), 0)
                if room:
                    self.place(length, self.open[room].pop(), room)
                else:
                    each = self.capacity // length
                    full, rest = divmod(self.left[length], each)
                    self.open[self.capacity].append(self.new(full or rest and 1))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece, and the number of sequences.

    Repeat counts are rounded down from the fit; as a fit can promise more closing pieces than there are, half the counts and none
    are tried too, and the plan with the fewest sequences is taken.
    """
    parts = capacity // grid
    bins: dict[int, list[int]] = {}
    for length in sorted(histogram, reverse=True):
        bins.setdefault(-(-length // grid), []).append(length)
    wanted = np.array([sum(histogram[n] for n in bins.get(k, ())) for k in range(1, parts + 1)], float)
    shapes = sorted((p for p in patterns(parts) if all(k in bins for k in p)), reverse=True)
    repeats = np.zeros(len(shapes))
    if shapes:
        matrix = np.zeros((parts, len(shapes)))
        for j, shape in enumerate(shapes):
            np.add.at(matrix[:, j], np.array(shape) - 1, 1)
        repeats = nnls(matrix, wanted)
    tried = []
    for part in (1.0, 0.5, 0.0):
        packer = Packer(histogram, capacity)
        packer.fill(shapes, np.floor(part * repeats + 1e-6).astype(int), bins)
        packer.best_fit()
        tried.append(packer)
    best = min(tried, key=lambda p: p.sequences)
    return np.array(best.runs, np.int64).reshape(-1, 5), best.sequences


def pack(cut: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """``cut`` (pieces with ``length``) with ``sequence_id`` and ``offset``.

    The plan is bounded by the capacity, not by the data: its runs end where a length, a pattern or a room is used up.
    """
    cut = stored(cut)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity, grid)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    starts = (runs[:, 0] << 48) | runs[:, 1]
    chunks = -(-max(counts.values(), default=1) // RANKED_ROWS)
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks))
    ranked = sequence_number(cut, ["length"], ["doc_id", "piece", "ids_crc32"], chunk, "_rank")

    names = cut.columns

    def run(batch):
        columns = {n: batch.column(n) for n in names}
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy() - 1
        found = runs[np.searchsorted(starts, (length << 48) | rank, side="right") - 1]
        return columns | {"sequence_id": found[:, 3] + rank - found[:, 1], "offset": found[:, 4]}

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return map_batches(ranked.select(*names, "_rank"), run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece."""
    return pack(pieces(docs, path, capacity), capacity)
