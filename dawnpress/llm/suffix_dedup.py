"""Removal of repeated byte strings by longest previous factors.

The longest previous factor of a text position is the longest string there that also starts earlier. Every byte in a
string of ``LENGTH`` bytes with an earlier start goes, the first occurrence stays. In suffix order, positions with the
same first ``LENGTH`` bytes are neighbours; with ties ordered by position, the previous smaller position of a suffix is an
earlier one of its run, the next smaller one never is, and the factor reaches ``LENGTH`` wherever the run has an earlier
member. So each task needs only whole runs, and runs are found without sorting all suffixes of the corpus:

1. *Stretches.* Every window of ``LENGTH`` bytes is owned by the smallest-hashed gram of ``GRAM`` bytes in it. Consecutive
   windows with the same owner form a stretch of about forty windows; equal windows have equal owners at equal places.
   Only one row per stretch is shuffled: hash of the owner, hash of the stretch, place.
2. *Equal stretches.* Suffix order of whole stretches: all but the first of a run have their windows found. Owners that occur with
   one stretch only need no more work; that is nearly all of a corpus.
3. *Windows.* Where an owner occurs in different stretches (at the ends of repeats), the first stretch of each kind is
   fetched from its text and its suffixes are ordered one by one.
4. The windows found are merged into spans and cut from the texts.

Hot strings: map tasks send one row per stretch and batch, and at most ``SENT`` stretches of one owner; an owner with more is
marked, and its windows travel one by one under their own hash, again one per batch. So a string in a third of all
documents costs some rows per batch, not per document. Suffixes are compared by 64-bit polynomial hashes under the hash of
their owner, together 128 bits.

Nulls and edges: null and empty texts have nothing to remove; rows with a null ``doc_id`` come before all others, in the order of a hash of
their texts; strings at the same place of different texts that repeat a ``doc_id`` are not earlier than one another (texts of one id are told apart
by 31 bits of a hash); identical rows get identical results; texts of any length are read in
segments; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.llm.common import as_batch, map_batches, partitions_for, stored, to_arrow

LENGTH = 100
GRAM = 28
#: Different stretches of one owner that a batch sends on; an owner with more is marked. Two would do, more save windows.
SENT = 16
SEGMENT = 1 << 18
BUFFER = 1 << 20
#: Bits of a place that tell texts with the same id apart; the others hold a start below 4 GB.
TAG = 31
#: Rows without an id are told apart by 62 bits of their hash from here on.
NULL_ID = -(1 << 63)
#: Bytes of fetched stretches, and rows of stretches, for one task.
TASK_BYTES, TASK_ROWS = 8 << 20, 1_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Rolling:
    """Polynomial hashes of any range of some bytes."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling.powers) <= n:
            size = max(n + 1, BUFFER + 2 * SEGMENT)
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * self.powers[:n], out=self.sums[1:])

    def grams(self, length: int) -> np.ndarray:
        last = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:last]) * self.inverses[:last])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - width + reach], values[width - reach :]) if width > reach else values


def stretches(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, length: int, gram: int):
    """Stretches of segments laid end to end: begin of a segment in ``data`` and its number of windows.

    Returns owner hash, stretch hash, segment, first window in ``data`` and number of windows.
    """
    rolling = Rolling(data)
    order = rolling.grams(gram)
    bits = np.uint64(len(data).bit_length())
    keyed = (order >> bits << bits) | np.arange(len(order), dtype=np.uint64)
    owner = (window_minimum(keyed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(len(owner) + 1, bool)
    edge[1:-1] = owner[1:] != owner[:-1]
    edge[begins] = True
    edge[begins + counts] = True
    edge[-1] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    segment = np.searchsorted(begins, start, side="right") - 1
    inside = start < begins[segment] + counts[segment]
    start, end, segment = start[inside], end[inside], segment[inside]
    whole = mix(rolling.ranges(start, end + length - 1) + (end - start).astype(np.uint64))
    return order[owner[start]].view(np.int64), whole.view(np.int64), segment, start, end - start


def _places(batch: pa.RecordBatch):
    """Of a batch ``_doc, _tag, text``: ids, tags, bytes and offsets, without copying texts."""
    text = batch.column("text")
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    return batch.column("_doc").to_numpy(), batch.column("_tag").to_numpy(), data, offsets


def batch_stretches(batch: pa.RecordBatch, length: int, gram: int):
    """All stretches of a batch: owner, hash, doc, place (first window and tag) and number of windows."""
    docs, tags, data, offsets = _places(batch)
    found, group, size = [], [], 0

    def flush():
        if group:
            begins = np.cumsum([0] + [n + length - 1 for *_, n in group[:-1]])
            counts = np.array([n for *_, n in group])
            joined = np.concatenate([data[offsets[i] + s : offsets[i] + s + n + length - 1] for i, s, n in group])
            owner, whole, segment, start, n = stretches(joined, begins, counts, length, gram)
            row = np.array([i for i, *_ in group])[segment]
            first = np.array([s for _, s, _ in group])[segment] + start - begins[segment]
            found.append((owner, whole, docs[row], (first << TAG) | tags[row], n))
            group.clear()

    for i in range(len(docs)):
        windows = int(offsets[i + 1] - offsets[i]) - length + 1
        for s in range(0, windows, SEGMENT):
            n = min(SEGMENT, windows - s)
            group.append((i, s, n))
            size += n + length
            if size >= BUFFER:
                flush()
                size = 0
    flush()
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def run_firsts(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, the index of the first row with the same keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def join_windows(doc: np.ndarray, place: np.ndarray, n: np.ndarray):
    """Windows in a row joined: adjacent or overlapping ones of a document become one entry."""
    if not len(n):
        return doc, place, n
    order = np.lexsort((place >> TAG, place & ((1 << TAG) - 1), doc))
    doc, place, n = doc[order], place[order], n[order]
    start = place >> TAG
    text = run_firsts(doc, place & ((1 << TAG) - 1))
    shift = np.cumsum(np.r_[0, np.diff(text) != 0]).astype(np.int64) << 40  # texts apart from each other
    end = np.maximum.accumulate(shift + start + n) - shift
    at = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] > end[:-1])])
    return doc[at], place[at], end[np.r_[at[1:] - 1, len(n) - 1]] - start[at]


STRETCH, MANY, FOUND, FETCH = range(4)  # kinds of rows: MANY is a stretch of an owner that has many


def find_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows ``owner, whole, _doc, place, n`` with the kind in the lowest bits of ``n``: stretches to compare, windows found,
    stretches to fetch.

    A batch compares its own stretches first: repeats are found at once, and of an owner with more than ``SENT`` different
    stretches so many are sent on as ``MANY`` and the others are to be fetched.
    """

    def run(batch):
        owner, whole, doc, place, n = batch_stretches(batch, length, gram)
        order = np.lexsort((place, doc, whole, owner))
        owner, whole, doc, place, n = (x[order] for x in (owner, whole, doc, place, n))
        first = run_firsts(owner, whole)
        later = (doc != doc[first]) | (place >> TAG != place[first] >> TAG)
        lead = first == np.arange(len(first))
        group = run_firsts(owner)
        kinds = np.cumsum(lead)
        nth = kinds - kinds[group]
        many = np.zeros(len(owner), bool)
        many[group[nth >= SENT]] = True
        many = many[group]
        fetch = ~later & (nth >= SENT)
        kind = np.where(later, FOUND, np.where(fetch, FETCH, np.where(many, MANY, STRETCH)))
        same = ~lead & ~later & (doc == np.r_[doc[:1], doc[:-1]]) & (place == np.r_[place[:1], place[:-1]])  # repeated rows
        send = ~later & ~same
        f_doc, f_place, f_n = join_windows(doc[later], place[later], n[later])
        spread = mix((f_doc * 31 + f_place).view(np.uint64)).view(np.int64)
        owners = np.where(kind == FETCH, mix((doc * 31 + place).view(np.uint64)).view(np.int64), owner)
        return {
            "owner": np.r_[owners[send], spread],
            "whole": np.r_[whole[send], np.zeros(len(f_doc), np.int64)],
            "_doc": np.r_[doc[send], f_doc],
            "place": np.r_[place[send], f_place],
            "n": np.r_[n[send] << 2 | kind[send], f_n << 2 | FOUND],
        }

    return map_batches(docs.select("_doc", "_tag", "text"), run, "owner long, whole long, _doc long, place long, n long", None)


def compare_stretches(rows: DataFrame, partitions: int) -> DataFrame:
    """One row per text with windows found, ``found`` (place, n), and stretches to fetch, ``fetch`` (place, n, owner)."""
    rows = rows.repartition(partitions, "owner")
    in_run = Window.partitionBy("owner", "whole").orderBy("_doc", "place")
    of_owner = Window.partitionBy("owner")
    kind = F.col("n").bitwiseAND(3)
    plain = kind <= MANY
    start = F.struct("_doc", F.shiftright("place", TAG).alias("s"))
    judged = (
        rows.withColumn("first", F.first(start).over(in_run))
        .withColumn("low", F.min(F.when(plain, F.col("whole"))).over(of_owner))
        .withColumn("high", F.max(F.when(plain, F.col("whole"))).over(of_owner))
        .withColumn("many", F.max(kind == MANY).over(of_owner))
    )
    later = (kind == FOUND) | (plain & (start > F.col("first")))
    fetch = (kind == FETCH) | (plain & ~later & (F.col("low") < F.col("high")))
    alone = F.when((kind == FETCH) | F.col("many"), F.lit(None)).otherwise(F.col("owner"))
    size = F.shiftright("n", 2).cast("int")
    return (
        judged.where(later | fetch)
        .select(
            "_doc",
            F.col("place").bitwiseAND((1 << TAG) - 1).alias("_tag"),
            F.when(later, F.struct("place", size.alias("n"))).alias("f"),
            F.when(~later, F.struct("place", size.alias("n"), alone.alias("owner"))).alias("g"),
        )
        .groupBy("_doc", "_tag")
        .agg(F.collect_list("f").alias("found"), F.collect_list("g").alias("fetch"))
    )


def fetch_stretches(marked: DataFrame, length: int) -> DataFrame:
    """``key, _doc, place, data`` of the stretches in ``fetch``; those of marked owners window by window.

    Of equal single windows of a batch only the first travels; for the others ``key`` and ``data`` are null: they are found.
    """

    def run(batch):
        docs, tags, data, offsets = _places(batch)
        lists = batch.column("fetch")
        item = lists.flatten()
        row = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
        place, n = item.field("place").to_numpy(), item.field("n").to_numpy()
        single = item.field("owner").is_null().to_numpy(zero_copy_only=False)
        owner = item.field("owner").fill_null(0).to_numpy()
        begin = offsets[row] + (place >> TAG)
        rows = [
            (o, d, p, data[b : b + k + length - 1].tobytes())
            for o, d, p, b, k in zip(*(x[~single].tolist() for x in (owner, docs[row], place, begin, n)), strict=True)
        ]
        if single.any():
            b, k = begin[single], n[single].astype(np.int64)
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            at, doc, place = np.repeat(b, k) + step, np.repeat(docs[row][single], k), np.repeat(place[single], k) + (step << TAG)
            key = np.concatenate([Rolling(data[x : x + y + length - 1]).grams(length) for x, y in zip(b, k, strict=True)]).view(np.int64)
            order = np.lexsort((place, doc, key))
            at, doc, place, key = at[order], doc[order], place[order], key[order]
            first = run_firsts(key)
            later = (doc != doc[first]) | (place >> TAG != place[first] >> TAG)
            rows += [
                (None, d, p, None) if skip else (o, d, p, data[x : x + length].tobytes())
                for o, d, p, x, skip in zip(*(x.tolist() for x in (key, doc, place, at, later)), strict=True)
            ]
        return dict(zip(("key", "_doc", "place", "data"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True))

    return map_batches(marked, run, "key long, _doc long, place long, data binary", None)


def order_suffixes(rows: DataFrame, length: int, partitions: int) -> DataFrame:
    """``_doc, place, n``: windows with an earlier equal window, from rows of ``fetch_stretches``.

    A task holds all suffixes of its keys, a bounded share of the bytes: long runs were cut to a row per batch before.
    """
    spread = F.coalesce("key", F.xxhash64("_doc", "place"))
    kinds = to_arrow("_doc long, place long, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, known = [], [], [], []
        for batch in batches:
            sent = batch.column("data").is_valid().to_numpy(zero_copy_only=False)
            doc, place = batch.column("_doc").to_numpy(), batch.column("place").to_numpy()
            known.append((doc[~sent], place[~sent], np.ones((~sent).sum(), np.int64)))
            raw = [x for x in batch.column("data").to_pylist() if x is not None]
            for a in range(0, len(raw), 4096):
                part = raw[a : a + 4096]
                sizes = np.array([len(x) for x in part])
                begins = np.cumsum(sizes) - sizes
                grams = Rolling(np.frombuffer(b"".join(part), np.uint8)).grams(length)
                n = sizes - length + 1
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keys.append(grams[np.repeat(begins, n) + step])
                docs.append(np.repeat(doc[sent][a : a + 4096], n))
                places.append(np.repeat(place[sent][a : a + 4096], n) + (step << TAG))
        if keys:
            key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            keys, docs, places = [], [], []
            order = np.lexsort((place, doc, key))  # suffix order, ties by position
            key, doc, place = key[order], doc[order], place[order]
            first = run_firsts(key)
            later = (doc != doc[first]) | (place >> TAG != place[first] >> TAG)
            known.append((doc[later], place[later], np.ones(later.sum(), np.int64)))
        if known:
            doc, place, n = join_windows(*(np.concatenate(x) for x in zip(*known, strict=True)))
            yield as_batch({"_doc": doc, "place": place, "n": n}, kinds)

    return rows.repartition(partitions, spread).mapInArrow(run, "_doc long, place long, n int")


def cut(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed spans (start, end) and the bytes that stay."""

    def run(batch):
        lists = batch.column("found")
        item = lists.flatten()
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        starts, sizes = item.field("place").to_numpy() >> TAG, item.field("n").to_numpy()
        spans, kept, n_bytes = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            n_bytes.append(len(text))
            if edges[i] == edges[i + 1]:
                spans.append([])
                kept.append(text)
                continue
            start = starts[edges[i] : edges[i + 1]]
            order = np.argsort(start, kind="stable")
            start = start[order]
            end = np.maximum.accumulate(start + sizes[edges[i] : edges[i + 1]][order] + length - 1)
            at = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            begin, stop = start[at].tolist(), end[np.r_[at[1:] - 1, len(end) - 1]].tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(begin, stop, strict=True)])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *stop], [*begin, len(text)], strict=True)))
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "spans": spans, "kept": kept}

    joined = docs.join(found, ["_doc", "_tag"], "left").select("doc_id", "text", F.coalesce("found", F.array()).alias("found"))
    return map_batches(joined, run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs`` (``doc_id, text``)."""
    if not 0 < gram < length:
        raise ValueError("grams must be shorter than the strings sought")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id, hashed = F.col("doc_id").cast("long"), F.xxhash64(text.cast("binary"))
    tag, unnamed = hashed.bitwiseAND((1 << TAG) - 1), F.lit(NULL_ID) + hashed.bitwiseAND((1 << 62) - 1)
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, unnamed).alias("_doc"), tag.alias("_tag"), text.cast("binary").alias("text")
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    compared = compare_stretches(find_stretches(rows, length, gram), partitions_for(docs, size // 30, TASK_ROWS))
    marks = stored(compared)
    wanted = marks.where(F.size("fetch") > 0)
    bulk = F.aggregate("fetch", F.lit(0).cast("long"), lambda a, x: a + (F.when(x["owner"].isNull(), x["n"] * length).otherwise(x["n"] + length)))
    amount = wanted.agg(F.sum(bulk)).first()[0] or 0
    # the join here and the one in cut() read the same columns of the texts, so Spark shuffles them once for both
    fetched = fetch_stretches(rows.join(wanted.select("_doc", "_tag", "fetch"), ["_doc", "_tag"]), length)
    more = order_suffixes(fetched, length, partitions_for(docs, amount, TASK_BYTES))
    entry, tag = F.struct("place", "n"), F.col("place").bitwiseAND((1 << TAG) - 1).alias("_tag")
    found = (
        more.select("_doc", tag, F.array(entry).alias("found"))
        .unionByName(marks.where(F.size("found") > 0).select("_doc", "_tag", "found"))
        .groupBy("_doc", "_tag")
        .agg(F.flatten(F.collect_list("found")).alias("found"))
    )
    return cut(rows, found, length)
