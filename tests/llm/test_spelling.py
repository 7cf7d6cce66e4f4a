import binascii
import random
import re
from collections import Counter

import pytest

from dawnpress.llm import spelling

DOCS = "doc_id long, text string"


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = binascii.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def brute(rows):
    counts = brute_words(rows)
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def edited(word, draw, letters="abcdéÿzx"):
    i, kind = draw.randrange(len(word)), draw.randrange(3)
    return word[:i] + ("" if kind == 0 else draw.choice(letters)) + word[i + (kind < 2) :]


def rows_of(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdéèÿzÀ") for _ in range(draw.randrange(6, 12))) for _ in range(25)]
    texts = []
    for _ in range(300):
        words = [draw.choice(base[: draw.choice([2, 25])]) for _ in range(30)]
        words = [edited(w, draw) if draw.random() < 0.15 else w for w in words]
        words = [edited(w, draw) if draw.random() < 0.03 else w.upper() if draw.random() < 0.1 else w for w in words]
        texts.append(draw.choice([" ", ", ", "7", "\n"]).join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20
    assert {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, DOCS)).collect()} == want


@pytest.mark.parametrize("symbols", [2, 5, 8])
def test_neighbourhoods_hold_every_edit(symbols, monkeypatch):
    draw = random.Random(symbols)
    around = spelling.Neighbourhood(symbols)
    letters = spelling.LOWER[:symbols]
    words = ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 12))) for _ in range(60)]
    for n, some in enumerate((words[:50], words[50:])):
        monkeypatch.setattr(spelling, "CHUNK", 3 if n % 2 else 4096)
        found = {}
        for own, near in around.hashes(some):
            for o, hashes in zip(own[:, 0].tolist(), near.tolist(), strict=True):
                found.setdefault(o, set()).update(hashes)
        for word in some:
            others = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
            others |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
            assert found[int(around.own([word])[0])] == {int(h) for h in around.own(list(others))}
    assert around.own([]).size == 0


def test_chain_of_forms_leads_to_one_root(spark):
    words = [("abcdefg", 5), ("abcdefgh", 50), ("abcdefghi", 500), ("abcdefghij", 10**6), ("zzzzzzz", 3), ("zzzzzzy", 29)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r.root for w, r in found.items() if w < "z"} == {"abcdefghij"}
    assert found["zzzzzzz"].form is None and found["zzzzzzz"].n_near == 1 and found["zzzzzzz"].root == "zzzzzzz"


def test_edges(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    long = "qwertzuiopü" * 20000
    rows = [(None, "Wörterbuch"), (None, "wörterbuch"), (1, None), (2, ""), (3, long), (4, long), (5, long[:-1] + "x"), (6, long[:-1] + "x")]
    rows += [(7, "wörterbüch"), (7, "wörterbüch"), (8, "short sevenxx"), (9, "×÷×÷×÷×"), (10, "×÷×÷×÷×")]
    docs = spark.createDataFrame([(*r, "w") for r in rows], DOCS + ", word string")
    assert {tuple(r) for r in spelling.spelling_variants(docs).collect()} == brute(rows)
