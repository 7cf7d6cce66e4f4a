"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and telephone numbers; what they find stays. The field labels the remaining tokens with
digits or an ``@``: chain edges join neighbours, skip edges join a token to the previous one in its
document that is repeated or similar (same last digits, same address), however far away, so that a number written once with its
country code is also found without. Numbers written in groups are compared by the last digits of the joined groups, and skip edges
join the groups that share digits. Potentials are fitted by pseudo-likelihood to what the patterns label, counted over all documents;
only counts of distinct feature combinations reach the driver: all of them, or if they are more than ``COMBINATIONS`` an unbiased sample
of about that many, drawn by hash with a chance proportional to the weight and weighted by its inverse. Labels are inferred
by loopy belief propagation over all documents of a batch at once; a token is added if its label is surer than ``SURE``.

Nulls and edges: null and empty texts have no spans; offsets are code points, end excluded; patterns take time linear in the text;
repeated rows give a row each; ids may be null; other columns are kept by ``redact`` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import column, map_batches, stored

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
PLACES = 2048
COMBINATIONS = 5_000
SURE = 0.8
ROUNDS, DAMPING = 12, 0.3
STEPS, RATE, PENALTY = 300, 0.5, 1e-3
#: Agreement across skip edges that the fit starts from and is drawn to.
AGREE = 2.0

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
NOT_DIGIT = re.compile(r"[^0-9]")
#: A group of a number, and one that ends it.
GROUP = re.compile(r"[0-9+()./-]*[0-9)][,;:.!?]*")
STOP = re.compile(r"[,;:.!?]$")
DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}")
#: Digits by which numbers are compared, and the most that are joined.
TAIL, LONGEST = 7, 19
DRAWS = 1 << 40


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each ``@`` looks back over its own run only, so time is linear."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Kind, start and end of what the patterns find, by kind, then start."""
    if not text:
        return []
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for m in ADDRESS.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


def shape(token: str) -> str:
    """Digits as 9, letters as a, runs of one class once."""
    return re.sub(r"([9a])\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token)))


def token_features(token: str, before: str, after: str) -> tuple[int, ...]:
    """Places of the active features of a token."""
    digits = NOT_DIGIT.sub("", token)
    parts = token.strip(".,;:").split(".")
    valid = (
        ("@" in token and bool(DOMAIN.search(token))) * 1
        + (len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)) * 2
        + (16 <= len(digits) <= 19 and luhn(digits)) * 4
    )
    own = shape(token.rstrip(".,;:"))
    names = (f"s{own}", f"n{min(len(digits), 20)}", f"v{valid}", f"b{shape(before)[:4]}|{own[:6]}", f"a{shape(after)[:4]}|{own[:6]}", f"vs{valid}{own}")
    return tuple(crc32(n.encode()) % PLACES for n in names)


def similar_key(token: str) -> str | None:
    """Tokens with the same key are joined by a skip edge."""
    if "@" in token:
        return token.lower().strip(".,;:<>()\"'")
    digits = NOT_DIGIT.sub("", token)
    if len(digits) >= TAIL:
        return digits[-TAIL:]
    dotted = DOTTED.search(token)
    return dotted[0] if dotted else None


class Graph:
    """Candidate tokens of some documents with their features, edges and pattern labels."""

    def __init__(self):
        self.places: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[tuple[int, ...]] = []
        self.known: list[int] = []  # label by the patterns, or 0
        self.chain: list[tuple[int, int]] = []
        self.joined: set[int] = set()  # nodes with an edge to the one before
        self.skip: list[tuple[int, int]] = []

    def extend_back(self, text: str, earlier: int, node: int, first: int) -> None:
        """Skip edges for the tokens before two similar ones, as far as they repeat too."""
        while earlier > first and node > earlier + 1 and earlier in self.joined and node in self.joined:
            earlier, node = earlier - 1, node - 1
            (_, a, b), (_, c, d) = self.places[earlier], self.places[node]
            if text[a:b] != text[c:d] or (earlier, node) in self.skip[-8:]:
                break
            self.skip.append((earlier, node))

    def join_groups(self, earlier: int, node: int, digits: dict[int, str], runs: dict[int, int]) -> None:
        """Skip edges between the groups of two numbers from their last ones back, as far as their digits agree."""
        a, b, left, right, total = earlier, node, digits[earlier], digits[node], 0
        while a < b and b > earlier + 1 and total < LONGEST:
            n = min(len(left), len(right))
            if left[-n:] != right[-n:]:
                break
            if (a, b) not in self.skip[-2 * LONGEST :]:
                self.skip.append((a, b))
            left, right, total = left[:-n], right[:-n], total + n
            if not left:
                a -= 1
                if a < runs[earlier]:
                    break
                left = digits[a]
            if not right:
                b -= 1
                if b < runs[node]:
                    break
                right = digits[b]

    def add(self, document: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        if "@" not in text and not DIGIT.search(text):
            return
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        marks, at = sorted((a, b, k) for k, a, b in spans), 0
        seen: dict[str, int] = {}
        digits: dict[int, str] = {}  # of groups
        runs: dict[int, int] = {}  # first group of the run of neighbours that a group is in
        open_run, tail = -1, ""
        first, last = len(self.places), -2
        for i, (a, b) in enumerate(tokens):
            token = text[a:b]
            if "@" not in token and not DIGIT.search(token):
                continue
            node = len(self.places)
            while at < len(marks) and marks[at][1] <= a:
                at += 1
            label = next((k + 1 for s, e, k in marks[at : at + 4] if s < b and e > a), 0)
            before = text[slice(*tokens[i - 1])] if i else ""
            after = text[slice(*tokens[i + 1])] if i + 1 < len(tokens) else ""
            self.places.append((document, a, b))
            self.features.append(token_features(token, before, after))
            self.known.append(label)
            if last == i - 1:
                self.chain.append((node - 1, node))
                self.joined.add(node)
            key = similar_key(token)
            whole = key is not None
            if GROUP.fullmatch(token):
                if last != i - 1 or open_run < 0:
                    open_run, tail = node, ""
                digits[node], runs[node] = NOT_DIGIT.sub("", token), open_run
                tail = (tail + digits[node])[-TAIL:]
                if not whole and len(tail) == TAIL and len(digits[node]) < TAIL:
                    key = tail
                if STOP.search(token):
                    open_run = -1
            else:
                open_run = -1
            if key is not None:
                if key in seen:
                    earlier = seen[key]
                    if whole and (earlier not in digits or len(digits[earlier]) >= TAIL or node not in digits):
                        self.skip.append((earlier, node))
                        self.extend_back(text, earlier, node, first)
                    elif earlier in digits:
                        self.join_groups(earlier, node, digits, runs)
                seen[key] = node
            last = i


def combinations(docs: DataFrame) -> list:
    """Distinct (features, label before, label after, label across a skip edge, label) and their weight, most frequent first.

    A combination weighs the square root of its count, so that rare ones keep a say. If there are more than ``COMBINATIONS``, each is
    taken with a chance in proportion to that, and its weight divided by its chance: on average sums over them are those over all.
    """

    def run(batch):
        graph, counts = Graph(), Counter()
        for i, text in enumerate(batch.column("text").to_pylist()):
            graph.add(i, text or "", base_spans(text))
        before, after, across = {}, {}, {}
        for a, b in graph.chain:
            before[b], after[a] = graph.known[a], graph.known[b]
        for a, b in graph.skip:
            across[a], across[b] = graph.known[b], graph.known[a]
        for i, (features, label) in enumerate(zip(graph.features, graph.known, strict=True)):
            if not label and across.get(i, 0) > 0:
                continue  # what the patterns miss of a similar token is unknown, not other
            counts[(*features, before.get(i, -1), after.get(i, -1), across.get(i, -1), label)] += 1
        return {"combination": [list(k) for k in counts], "n": list(counts.values())}

    counted = map_batches(docs.select("text"), run, "combination array<int>, n long", None).groupBy("combination").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    number, total = counted.select(F.count("*"), F.sum(F.sqrt("n"))).first()
    chance = F.lit(1.0)
    if number > COMBINATIONS:
        chance = F.least(F.lit(1.0), F.sqrt("n") * F.lit(COMBINATIONS / total))
    drawn = counted.withColumn("chance", chance).where(F.pmod(F.xxhash64("combination"), F.lit(DRAWS)) < F.col("chance") * F.lit(float(DRAWS)))
    weighted = drawn.select("combination", "n", (F.sqrt("n") / F.col("chance")).alias("weight"))
    return weighted.orderBy(F.col("n").desc(), "combination").collect()  # about ``COMBINATIONS`` rows at most


class Field:
    """Potentials: ``unary`` by feature and label, ``chain`` by labels of neighbours, ``agree`` across skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, agree: float):
        self.unary, self.chain, self.agree = unary, chain, agree

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy belief propagation with the pattern labels held fixed."""
        k, n = len(LABELS), len(graph.places)
        node = self.unary[np.array(graph.features)].sum(axis=1)
        known = np.array(graph.known)
        node[known > 0] = -50.0
        node[known > 0, known[known > 0]] = 50.0
        ends = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        pairs = np.concatenate(
            [np.broadcast_to(self.chain, (len(graph.chain), k, k)), np.broadcast_to(self.agree * np.eye(k), (len(graph.skip), k, k))]
        )
        source, target = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]]
        pairs = np.concatenate([pairs, pairs.transpose(0, 2, 1)])
        back = np.r_[len(ends) : 2 * len(ends), : len(ends)].astype(np.int64)
        sent = np.zeros((len(source), k))
        for _ in range(ROUNDS if len(ends) else 0):
            belief = node.copy()
            np.add.at(belief, target, sent)
            out = (belief[source] - sent[back])[:, :, None] + pairs
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            sent = DAMPING * sent + (1 - DAMPING) * new
        belief = node.copy()
        np.add.at(belief, target, sent)
        odds = np.exp(belief - belief.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True) if n else odds

    def added(self, graph: Graph) -> list[tuple[int, int, int, int]]:
        """Document, kind, start and end of tokens that the patterns left; neighbours of one kind become one span."""
        if not graph.places:
            return []
        sure = self.marginals(graph)
        label = np.where(sure.max(axis=1) >= SURE, sure.argmax(axis=1), 0)
        found: list = []
        for i in np.flatnonzero((label > 0) & (np.array(graph.known) == 0)).tolist():
            document, start, end = graph.places[i]
            if found and i in graph.joined and found[-1][4] == i - 1 and found[-1][1] == label[i] - 1:
                found[-1] = (document, found[-1][1], found[-1][2], end, i)
            else:
                found.append((document, int(label[i]) - 1, start, end, i))
        return [f[:4] for f in found]


def train(docs: DataFrame) -> Field:
    """Fit the potentials by pseudo-likelihood; a corpus without candidates gives a field that adds nothing."""
    k, rows = len(LABELS), combinations(docs)
    unary, chain, agree = np.zeros((PLACES, k)), np.zeros((k, k)), AGREE
    if not rows:
        return Field(unary, chain, agree)
    table = np.array([r["combination"] for r in rows])
    weight = np.array([r["weight"] for r in rows])
    weight = weight / weight.sum()
    features, (before, after, across, label) = table[:, :-4], table[:, -4:].T
    truth = np.eye(k)[label]
    one = lambda x: np.where(x[:, None] >= 0, np.eye(k)[np.maximum(x, 0)], 0.0)
    was, will, twin = one(before), one(after), one(across)
    moments = [np.zeros_like(unary), np.zeros_like(chain), 0.0]
    for _ in range(STEPS):
        logits = unary[features].sum(axis=1) + was @ chain + will @ chain.T + agree * twin
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (truth - odds / odds.sum(axis=1, keepdims=True)) * weight[:, None]
        step = np.zeros_like(unary)
        for j in range(features.shape[1]):
            np.add.at(step, features[:, j], error)
        slopes = [step - PENALTY * unary, was.T @ error + error.T @ will - PENALTY * chain, float((twin * error).sum()) - PENALTY * (agree - AGREE)]
        moments = [m + g * g for m, g in zip(moments, slopes, strict=True)]
        unary += RATE * slopes[0] / np.sqrt(moments[0] + 1e-9)
        chain += RATE * slopes[1] / np.sqrt(moments[1] + 1e-9)
        agree = max(0.0, agree + RATE * slopes[2] / np.sqrt(moments[2] + 1e-9))
    return Field(unary, chain, float(agree))


def all_spans(texts: list[str | None], field: Field) -> tuple[list[list[dict]], list[list[dict]]]:
    """Of each text the spans of the patterns, and these with the ones that the field adds."""
    graph, base = Graph(), []
    for i, text in enumerate(texts):
        base.append(base_spans(text))
        graph.add(i, text or "", base[-1])
    more: dict[int, list] = {}
    for document, kind, start, end in field.added(graph):
        more.setdefault(document, []).append((kind, start, end))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
    return [named(b) for b in base], [named(sorted(b + more[i]) if i in more else b) for i, b in enumerate(base)]


def find(docs: DataFrame, field: Field, *keep: str) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (kind, start, end) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kinds, columns = dict(docs.dtypes), list(keep)

    def run(batch):
        base, spans = all_spans(batch.column("text").to_pylist(), shared.value)
        return {c: batch.column(c) for c in columns} | {"base": base, "spans": spans}

    span = "array<struct<kind: string, start: long, end: long>>"
    schema = "".join(f"`{c}` {kinds[c]}, " for c in columns) + f"base {span}, spans {span}"
    return map_batches(docs.select(*dict.fromkeys([*columns, "text"])), run, schema)


def count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: str):
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, spans: list[dict]) -> str:
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > last:
            out += [text[last : max(last, s["start"])], f"[{s['kind'].upper()}]" if s["start"] >= last else ""]
            last = s["end"]
    return "".join(out) + text[last:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars`` counted anew where it is a column."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batch):
        texts = column(batch, "row.text").to_pylist()
        spans = all_spans(texts, shared.value)[1]
        return {"row": batch.column("row"), "text": [masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]}

    cleaned = map_batches(packed, run, f"row {packed.dtypes[0][1]}, text string")
    new = {"text": F.col("text")} | ({"n_chars": F.when(F.col("text").isNotNull(), F.length("text"))} if "n_chars" in names else {})
    typed = {n: c.cast(dict(docs.dtypes)[n]) for n, c in new.items()}
    return cleaned.select(*[typed[n].alias(n) if n in typed else F.col("row")[n].alias(n) for n in names])
