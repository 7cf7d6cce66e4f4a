"""Spelling variants by reduced-alphabet generation.

The letters of every word are hashed to a few symbols. Words that differ by one inserted, deleted or replaced letter have reduced
words that differ by one such edit or not at all, so each distinct reduced word generates its full one-edit neighbourhood
over the few symbols, as 64-bit polynomial hashes that one pass over the word gives from the hashes of its prefixes (an inserted
letter is the other word's deleted letter, so only the longer of two words generates). Most of a neighbourhood occurs nowhere: a
bitmap of fixed size (16 MB, broadcast) rules out hashes that no reduced word has before anything is shuffled; a larger vocabulary
fills it, which costs time and no result. What is left is joined with the vocabulary of reduced words, and the words behind
reduced words that meet are verified by their own edit distance, so neither equal symbols nor equal hashes make two words
near. Words are counted before anything else is shuffled, so a frequent word is one row; no list of a word's neighbours is kept.

Nulls and edges: null and empty texts have no words; a null ``doc_id`` counts as empty text in the hash of a run; rows that repeat an
id count each; a run of any length is one word, at cost linear in its length; of near words of equal count the
smallest in code-point order is the form; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import as_batch, map_batches, stored, to_arrow

#: Letters: A-Z, which are lower-cased, and U+00C0 to U+00FF.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Least code points and occurrences of a word; a run is damaged if this divides its hash; how much more frequent a form is.
LENGTH, OCCURRENCES, DAMAGE, RATIO = 7, 2, 31, 10
SYMBOLS = 8
SEED = 42
#: A form has ``RATIO`` times the count, so no chain of forms of 64-bit counts is longer than two to this power.
DOUBLINGS = 5
#: Places of a word that are changed at once, hashes generated at once, and bits of the number of a slot of the bitmap.
CHUNK, EMITTED, SLOT_BITS = 1 << 12, 1 << 18, 27


def occurrences(docs: DataFrame, length: int = LENGTH, damage: int = DAMAGE) -> DataFrame:
    """``word`` of every run of at least ``length`` letters, one letter deleted where ``damage`` divides the run's hash."""
    lowered = F.translate("text", UPPER, LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{length},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.explode(runs).alias("run"))
    hashed = named.withColumn("h", F.crc32(F.concat_ws(":", "name", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= length)


def vocabulary(found: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """``word, n`` of the words that occur at least so often."""
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with each letter hashed to one of so many symbols."""
    dealt = np.random.default_rng(SEED).integers(0, symbols, len(LETTERS))
    return F.translate(word, LETTERS, "".join(LOWER[s] for s in dealt))


def powers(n: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Neighbourhood:
    """Polynomial hashes, modulo two to the 64, of words over the symbols and of all their one-edit neighbours.

    Of two words the neighbourhood of the longer holds the shorter, so words one letter longer are not generated.
    """

    def __init__(self, symbols: int = SYMBOLS):
        draw = np.random.default_rng(SEED + symbols)
        odd = lambda n: draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.values, self.base = odd(symbols), odd(1)[0]
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))

    def prefixes(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For words of one length at a time: their places in the list, the values of their symbols, the hashes of their prefixes
        and the powers of the base."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            same, most = np.flatnonzero(lengths == n), max(1, EMITTED // (len(self.values) * max(1, n)))
            power = powers(n, self.base)
            for at in np.split(same, range(most, len(same), most)):
                text = "".join([words[i] for i in at]).encode("ascii")
                values = self.values[np.frombuffer(text, np.uint8).reshape(len(at), n) - np.uint8(ord("a"))]
                before = np.zeros((len(at), n + 1), np.uint64)
                np.cumsum(values * power[:-1], axis=1, out=before[:, 1:])
                yield at, values, before, power

    def own(self, words: list[str]) -> np.ndarray:
        found = np.zeros(len(words), np.uint64)
        for at, _, before, _ in self.prefixes(words):
            found[at] = before[:, -1]
        return found

    def hashes(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of words and of those within one edit that are not longer, itself included, a bounded number at a time."""
        for _, values, before, power in self.prefixes(words):
            own = before[:, -1:]
            yield own, own
            for a in range(0, values.shape[1], CHUNK):
                places = slice(a, min(a + CHUNK, values.shape[1]))
                deleted = before[:, places] + (own - before[:, 1:][:, places]) * self.inverse
                replaced = own[:, :, None] + (self.values[:, None] - values[:, None, places]) * power[places]
                yield own, np.concatenate([deleted, replaced.reshape(len(own), -1)], axis=1)


def slots(hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in a bitmap of ``1 << SLOT_BITS`` bits."""
    return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)


def coded_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, code, own, slot``: the words with their reduced word, its hash and the place of that in the bitmap."""
    around = Neighbourhood(symbols)

    def run(batch):
        own = around.own(batch.column(2).to_pylist())
        return {"word": batch.column(0), "n": batch.column(1), "code": batch.column(2), "own": own.view(np.int64), "slot": slots(own).view(np.int64)}

    coded = words.select("word", "n", reduced(F.col("word"), symbols).alias("code"))
    return map_batches(coded, run, "word string, n long, code string, own long, slot long", rows=None)


def bitmap(coded: DataFrame) -> np.ndarray:
    """Which slots have a reduced word: a table of fixed size, whatever the vocabulary."""
    bits = coded.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("bits")).toArrow()
    held = np.zeros(1 << SLOT_BITS - 6, np.uint64)
    held[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return held


def neighbourhoods(coded: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``from, to``: hashes of all reduced words and of those in their neighbourhood that a bitmap of the vocabulary does not rule out."""
    around, kinds = Neighbourhood(symbols), to_arrow("from long, to long")
    known = coded.sparkSession.sparkContext.broadcast(bitmap(coded))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in batches:
            for own, near in around.hashes(batch.column(0).to_pylist()):
                at = slots(near)
                met = (held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool) & ((near != own) | (near.shape[1] == 1))
                row, column = np.nonzero(met)
                yield as_batch({"from": own[row, 0].view(np.int64), "to": near[row, column].view(np.int64)}, kinds)

    return coded.select("code").distinct().mapInArrow(run, "from long, to long")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, other, other_n`` for every ordered pair of ``words`` (``word, n``) that are one edit apart."""
    coded = stored(coded_words(words, symbols))
    met = neighbourhoods(coded, symbols).join(coded.select(F.col("own").alias("to")).distinct(), "to").distinct()
    one = coded.select(F.col("own").alias("from"), "word", "n")
    others = coded.select(F.col("own").alias("to"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    longer = F.length("word") - F.length("other")
    pairs = one.join(met, "from").join(others, "to").where((F.col("word") != F.col("other")) & longer.isin(0, 1))
    near = pairs.where(F.levenshtein("word", "other", 1) == 1)
    pair = lambda *names: F.struct(*[F.col(c).alias(n) for c, n in zip(names, ("word", "n", "other", "other_n"), strict=True)])
    there, back = pair("word", "n", "other", "other_n"), pair("other", "other_n", "word", "n")
    return near.select(F.explode(F.when(longer == 0, F.array(there)).otherwise(F.array(there, back))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the last word that forms lead to, by pointer doubling."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return at


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``, words distinct)."""
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best")
    seen = near_words(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(seen, "word", "left")
    enough = -F.col("best.n") >= ratio * F.col("n")
    found = stored(
        joined.select(
            "word",
            F.when(enough, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, -F.col("best.n")).alias("form_n"),
        )
    )
    ends = roots(found.where("form IS NOT NULL"))
    named = found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return named.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """Variants of the words of all documents."""
    return variants(stored(vocabulary(occurrences(docs, damage=damage))))
