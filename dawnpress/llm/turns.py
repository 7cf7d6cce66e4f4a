"""Conversation structure repair by the auction algorithm for shortest paths.

The turns of a conversation are the layers of a lattice whose four states say which role was written last: none, system, user or
assistant. Arcs keep, rerole or delete a turn or insert an empty one, at whole costs, and a repaired conversation is a cheapest path to
a state in which it may end. The auction keeps a price on every node, never more than the cost of an arc plus the
price at its head. A path from an origin is extended over an arc that reaches this bound; where none does, the price rises to the
bound and the path contracts. Origins are taken from the last layer on and a path stops at a node whose price has converged, so
paths stay short. Converged prices are distances to the end: exactly the arcs whose cost is the fall in price are on cheapest paths,
and following the first of them in letter order gives the cheapest edits that come first in the alphabet.

A conversation may hold a third of all rows, so nothing but its last hash sees it as a group. Rows are ordered by a range-partitioned sort
and cut into blocks of at most ``BLOCK`` turns. A block gives its distances between entry and exit states (four auctions); from these
one task per conversation finds the prices at all block ends, a second auction inside every block gives the edits for each entry state,
and a second walk over the blocks picks among these. The audit of a conversation is one string with a letter per turn, which bounds
its turns to two to the 31 and its blocks to 2^19 rows of some hundred bytes. A sha256 of one text cannot be split: its rows stream through one
task in order, a batch at a time.

Nulls and edges: a null role or text is one space, a null ``turn`` sorts first and a null ``conv_id`` is a conversation; turns of one number
are ordered by role and text; an empty role is of no kind; repeated rows are duplicates; a conversation of which no row is left has zeros,
an empty audit and the hash of the empty text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import as_batch, map_batches, stored, to_arrow

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: What the next user or assistant turn leads to, and the cost of ending in a state with the letters that it takes.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDING = (0, 2 * INSERT, INSERT, 0)
ENDED = ("", "II", "I", "")
NEVER = 1 << 60
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Kinds of roles by their initial (any other: o) and states of a turn; a turn's code is one letter for both.
KINDS, FAULTS = "suao", ("whole", "truncated", "blank", "duplicate")
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Columns of white space: \x20 and \x09 to \x0D.
INK, CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def code_of(kind: str, fault: str) -> str:
    return chr(ord("A") + FAULTS.index(fault) * len(KINDS) + KINDS.index(kind))


def arcs_of(kind: str, fault: str) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs (letter, layers ahead, state, cost) of a turn in letter order."""
    found = []
    for state in STATES:
        arcs = [("D", 1, state, DELETE), ("I", 0, NEXT[state], INSERT)]
        if fault in ("whole", "truncated"):
            more = TRUNCATED if fault == "truncated" else 0
            kept = {"s": SYSTEM if state == START else None, "u": USER, "a": ASSISTANT}.get(kind)
            if kept is not None and (kept == SYSTEM or kept == NEXT[state]):
                arcs.append(("K", 1, kept, more))
            arcs.append(("R", 1, NEXT[state], REROLE + more))
        found.append(arcs)
    return found


ARCS = {code_of(kind, fault): arcs_of(kind, fault) for kind in KINDS for fault in FAULTS}


def auction(codes: str, ends: tuple[int, ...], states: tuple[int, ...] = STATES) -> list[list[int]]:
    """Converged prices of every layer and state: the cost of the cheapest way to the exit states with prices ``ends``.

    Only ``states`` are used; they must be those that can reach an exit of finite price, or have no way out but to layers ahead.
    """
    prices = [[NEVER] * 4 for _ in codes] + [list(ends)]
    settled = [[state not in states for state in STATES] for _ in codes] + [[True] * 4]
    for layer in range(len(codes) - 1, -1, -1):
        lowest = min(prices[layer + 1])  # no arc is below this, so prices may start here
        for state in states:
            prices[layer][state] = lowest
        for origin in states:
            path = [] if settled[layer][origin] else [(layer, origin)]
            while path:
                i, q = path[-1]
                bound, to = NEVER, None
                for _, ahead, head, cost in ARCS[codes[i]][q]:
                    through = cost + prices[i + ahead][head]
                    if through < bound:
                        bound, to = through, (i + ahead, head)
                if prices[i][q] < bound:  # raise the price and contract
                    prices[i][q] = bound
                    if to is None:
                        settled[i][q] = True
                    if len(path) > 1 or to is None:
                        path.pop()
                elif to is None or settled[to[0]][to[1]]:
                    for i, q in path:
                        settled[i][q] = True
                    break
                else:
                    path.append(to)
    return prices


def trace(codes: str, prices: list[list[int]], entry: int) -> tuple[str, int]:
    """Letters of the tight arcs from an entry state, the first in letter order at every node, and the exit state."""
    letters, i, q = [], 0, entry
    while i < len(codes):
        letter, i, q = next((a, i + ahead, head) for a, ahead, head, cost in ARCS[codes[i]][q] if prices[i][q] == cost + prices[i + ahead][head])
        letters.append(letter)
    return "".join(letters), q


@lru_cache(1 << 14)
def distances(codes: str) -> tuple[int, ...]:
    """Cost from each entry state to each exit state of a block, row by row."""
    found = [[NEVER] * 4 for _ in STATES]
    for exit, states in ((START, (START,)), (SYSTEM, (START, SYSTEM)), (USER, STATES), (ASSISTANT, STATES)):
        ends = tuple(0 if state == exit else NEVER for state in STATES)
        for entry in states:
            found[entry][exit] = auction(codes, ends, states)[0][entry] if codes else ends[entry]
    return tuple(min(x, NEVER) for row in found for x in row)


@lru_cache(1 << 14)
def edits(codes: str, ends: tuple[int, ...]) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """For each entry state the letters of a block whose exit states have the prices ``ends``, and its exit state."""
    prices = auction(codes, ends)
    found = [trace(codes, prices, entry) for entry in STATES]
    return tuple(letters for letters, _ in found), tuple(state for _, state in found)


def block_ends(blocks: list[tuple[int, ...]]) -> tuple[int, list[tuple[int, ...]]]:
    """Cost of the cheapest repair and, for the distances of each block in order, the prices at its exit, the least of them made 0."""
    ends, found, total = ENDING, [], 0
    for distance in reversed(blocks):
        least = min(ends)
        total, ends = total + least, tuple(e - least for e in ends)
        found.append(ends)
        ends = tuple(min(distance[4 * entry + exit] + ends[exit] for exit in STATES) for entry in STATES)
    return total + ends[START], found[::-1]


def illegal(kinds: str) -> int:
    """Adjacent roles other than system user, user assistant and assistant user."""
    return sum(kinds[i : i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1))


def kinds_of(codes: str) -> str:
    return "".join(KINDS[(ord(c) - ord("A")) % len(KINDS)] for c in codes)


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, kind, fault, key`` of all turns; ``place`` grows along each conversation without gaps but between tasks."""
    filled = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    spread = filled.withColumn("_nth", F.monotonically_increasing_id())  # so that equal rows can go to several tasks
    kind = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(INK), "blank").when(~F.col("text").rlike(CLOSED), "truncated").otherwise("whole")
    return spread.sort("conv_id", "turn", "role", "text", "_nth").select(
        "conv_id",
        F.monotonically_increasing_id().alias("place"),
        "turn",
        "role",
        "text",
        F.when(kind.isin("s", "u", "a"), kind).otherwise("o").alias("kind"),
        fault.alias("fault"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key"),
    )


def coded_blocks(rows: DataFrame) -> DataFrame:
    """``conv_id, start, codes``: blocks of consecutive turns by the place of their first."""
    firsts = rows.groupBy("conv_id", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = rows.select("conv_id", "place", "kind", "fault").join(firsts, "place", "left")
    fault = F.when(F.col("first").isNull() & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault"))
    number = sum((F.when(fault == name, i * len(KINDS)).otherwise(0) for i, name in enumerate(FAULTS)), F.instr(F.lit(KINDS), F.col("kind")) - 1)
    coded = marked.select("conv_id", "place", F.char(number + ord("A")).alias("code"))
    held = F.sort_array(F.collect_list(F.struct("place", "code")))
    return coded.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("_block")).agg(held.alias("held")).select(
        "conv_id", F.col("held")[0]["place"].alias("start"), F.array_join(F.col("held")["code"], "").alias("codes")
    )


def summaries(blocks: DataFrame) -> DataFrame:
    """``conv_id, start`` of each block with its distances, fault counts, illegal pairs and outer kinds."""

    def run(batch):
        codes = batch.column(2).to_pylist()
        kinds = [kinds_of(c) for c in codes]
        count = lambda fault: [sum(c in some for c in text) for text in codes for some in [{code_of(k, fault) for k in KINDS}]]
        return {
            "conv_id": batch.column(0),
            "start": batch.column(1),
            "distances": [list(distances(c)) for c in codes],
            "counts": [list(x) for x in zip(count("blank"), count("duplicate"), count("truncated"), map(illegal, kinds), strict=True)],
            "outer": [k[0] + k[-1] for k in kinds],
        }

    conv = blocks.schema["conv_id"].dataType.simpleString()
    return map_batches(blocks, run, f"conv_id {conv}, start long, distances array<long>, counts array<long>, outer string")


def planned(summed: DataFrame) -> DataFrame:
    """``conv_id``, its ``cost`` and fault counts, and ``ends``: for each block its start and the prices at its exit."""
    grouped = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "distances", "counts", "outer"))).alias("blocks"))

    def run(batch):
        found = {name: [] for name in ("cost", "blank", "duplicate", "truncated", "illegal", "ends")}
        for blocks in batch.column(1).to_pylist():
            cost, ends = block_ends([tuple(b["distances"]) for b in blocks])
            between = sum(illegal(a["outer"][1] + b["outer"][0]) for a, b in zip(blocks, blocks[1:], strict=False))
            sums = [sum(b["counts"][k] for b in blocks) for k in range(4)]
            for name, value in zip(("blank", "duplicate", "truncated", "illegal"), (*sums[:3], sums[3] + between), strict=True):
                found[name].append(value)
            found["cost"].append(cost)
            found["ends"].append([{"start": b["start"], "prices": list(e)} for b, e in zip(blocks, ends, strict=True)])
        return {"conv_id": batch.column(0), **found}

    conv = summed.schema["conv_id"].dataType.simpleString()
    sums = "cost long, blank long, duplicate long, truncated long, illegal long"
    return map_batches(grouped, run, f"conv_id {conv}, {sums}, ends array<struct<start: long, prices: array<long>>>", rows=64)


def audited(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, audit, parts``: the edits of each conversation and, for each block, its start, entry state and letters."""
    ends = plan.select(F.explode("ends").alias("e")).select("e.start", "e.prices")
    conv = blocks.schema["conv_id"].dataType.simpleString()

    def each(batch):
        found = [edits(c, tuple(p)) for c, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return {"conv_id": batch.column(0), "start": batch.column(1), "letters": [list(x) for x, _ in found], "exits": [list(x) for _, x in found]}

    both = blocks.join(ends, "start").select("conv_id", "start", "codes", "prices")
    traced = map_batches(both, each, f"conv_id {conv}, start long, letters array<string>, exits array<int>")
    grouped = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "letters", "exits"))).alias("blocks"))

    def walk(batch):
        audits, parts = [], []
        for blocks in batch.column(1).to_pylist():
            state, some = START, []
            for b in blocks:
                some.append({"start": b["start"], "entry": state, "letters": b["letters"][state]})
                state = b["exits"][state]
            some[-1]["letters"] += ENDED[state]
            parts.append(some)
            audits.append("".join(part["letters"] for part in some))
        return {"conv_id": batch.column(0), "audit": audits, "parts": parts}

    schema = f"conv_id {conv}, audit string, parts array<struct<start: long, entry: int, letters: string>>"
    return map_batches(grouped, walk, schema, rows=64)


class Repaired:
    """Lines ``role:text`` of one conversation, given its blocks and rows in order."""

    def __init__(self):
        self.letters, self.state = iter(""), START

    def block(self, entry: int, letters: str) -> Iterator[str]:
        yield from self.rest()
        self.letters, self.state = iter(letters), entry

    def row(self, role: str, text: str) -> Iterator[str]:
        for letter in self.letters:
            if letter == "D":
                return
            if letter == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield f"{role}:{text}"
                return
            self.state = NEXT[self.state]
            yield f"{NAMES[self.state]}:{text if letter == 'R' else ''}"
            if letter == "R":
                return

    def rest(self) -> Iterator[str]:
        """Turns inserted after the last row."""
        for _ in self.letters:
            self.state = NEXT[self.state]
            yield f"{NAMES[self.state]}:"


def in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, entry, letters, role, text``: a conversation's rows in one task in order, each block's edits before its first row."""
    parts = audits.select("conv_id", F.explode("parts").alias("p")).select("conv_id", F.col("p.start").alias("place"), "p.entry", "p.letters")
    both = parts.unionByName(rows.select("conv_id", "place", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.col("letters").isNull())


def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, int, Iterator[str]]]:
    """``conv_id``, the conversation's number in this task and the next repaired lines, from rows as ``in_order`` gives them."""
    at, number, lines = None, -1, Repaired()
    for batch in batches:
        for conv, _, entry, letters, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if number < 0 or conv != at:
                if number >= 0:
                    yield at, number, lines.rest()
                at, number, lines = conv, number + 1, Repaired()
            yield conv, number, lines.row(role, text) if letters is None else lines.block(entry, letters)
    if number >= 0:
        yield at, number, lines.rest()


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the hash of the repaired turns, joined by line ends."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    kinds = to_arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, digest, some = [], None, None, False
        for conv, number, lines in streamed(batches):
            if number != now:
                if digest:
                    done.append((before, digest.hexdigest()))
                now, before, digest, some = number, conv, hashlib.sha256(), False
            for line in lines:
                digest.update(f"\n{line}".encode() if some else line.encode())
                some = True
            if len(done) >= 4096:
                yield as_batch({"conv_id": [c for c, _ in done], "repaired_sha256": [h for _, h in done]}, kinds)
                done = []
        if digest:
            done.append((before, digest.hexdigest()))
        yield as_batch({"conv_id": [c for c, _ in done], "repaired_sha256": [h for _, h in done]}, kinds)

    return in_order(rows, audits).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the repaired conversations, turns numbered from 0."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn long, role string, text string"
    kinds = to_arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, turn = [], None, 0
        for conv, number, lines in streamed(batches):
            now, turn = number, turn if number == now else 0
            for line in lines:
                out.append((conv, turn, *line.split(":", 1)))
                turn += 1
            if len(out) >= 512:
                yield as_batch(dict(zip(kinds.names, zip(*out, strict=True), strict=True)), kinds)
                out = []
        if out:
            yield as_batch(dict(zip(kinds.names, zip(*out, strict=True), strict=True)), kinds)

    return in_order(rows, audits).mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that the crc32 of ``conv_id:turn`` modulo 20 names: dropped, emptied, unpunctuated, repeated, of role user."""
    filled = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hashed = filled.withColumn("h", F.crc32(name.cast("binary")) % 20).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hashed.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


class Repair:
    """Audits and outputs of the repair of ``turns`` (``conv_id, turn, role, text``)."""

    def __init__(self, turns: DataFrame):
        self.rows = stored(ordered(turns))
        blocks = stored(coded_blocks(self.rows))
        self.plan = stored(planned(summaries(blocks)))
        self.audits = stored(audited(blocks, self.plan))

    def turns(self) -> DataFrame:
        return repaired_turns(self.rows, self.audits)

    def report(self, ids: DataFrame) -> DataFrame:
        """One row for every ``conv_id`` of ``ids``: faults, cost, audit and the hash of the repaired turns."""
        turn = F.col("turn").cast("long")
        span = (F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps")
        gaps = self.rows.groupBy("conv_id").agg(span)
        parts = [gaps, self.plan.drop("ends"), self.audits.select("conv_id", "audit"), repaired_hashes(self.rows, self.audits)]
        united = ids.select("conv_id").distinct()
        for part in parts:
            united = united.unionByName(part, allowMissingColumns=True)
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        joined = united.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*counts, "audit", "repaired_sha256"]])
        nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in nothing.items()])


def repair_damaged(turns: DataFrame) -> DataFrame:
    """The report on ``turns`` after damage, for all their conversations."""
    return Repair(damaged(turns)).report(turns)
