import base64
import random
import string

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dawnpress.llm import compression_bands as bands


def brute_repeats(words, window=5):
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(window)}
    return len(inside)


@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_windows(words):
    assert bands.repeated_window_words(words) == brute_repeats(words)


def test_both_ways_of_counting_agree(monkeypatch):
    draw = random.Random(1)
    words = [draw.choice("abcd") for _ in range(3000)]
    few = bands.repeated_window_words(words)
    monkeypatch.setattr(bands, "TUPLES", 0)
    assert bands.repeated_window_words(words) == few > 0


def prose(n, seed=0):
    draw = random.Random(seed)
    parts = ["the", "on", "er", "ing", "tion", "an", "re", "st", "ea", "wh", "ou", "ble"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def test_verdicts():
    packer = zstandard.ZstdCompressor(level=3)
    noise = "".join(random.Random(2).choice(string.printable) for _ in range(6000)).encode()
    assert all(bands.verdict(prose(n).encode(), packer)[2] for n in (12, 60, 300, 2000, 20_000))
    assert not bands.verdict(b"all work and no play " * 300, packer)[2]
    assert not bands.verdict(noise, packer)[2]
    assert not bands.verdict(prose(100).encode() + b"x y " * 9000, packer)[2]


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y\nx y\n \nz#$"), (4, prose(50)), (4, prose(50)), (5, "a\n" * 20), (6, "é è  ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r.doc_id: r for r in bands.score(docs).collect()}
    assert bands.score(docs).count() == 7
    r = got[None]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (5, 7, 2, 1, 0, True, False)
    assert (got[6].n_words, got[6].word_chars) == (3, 3)
    assert (got[5].n_dup_lines, got[5].n_repeat_words, got[5].kept) == (19, 20, False)
    assert got[4].kept and not got[1].kept and got[1].n_words == got[2].n_words == 0
    assert bands.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n, low_fails, high_fails", [(2000, 1.0, 9.0), (200_000, 1.2, 20.0)])
def test_bands_follow_length(n, low_fails, high_fails):
    raw = b"a" * n
    assert not bands.in_band(raw, low_fails, n) and not bands.in_band(raw, high_fails, n) and bands.in_band(raw, 2.2, n)


def base64_lines(n, line=76, seed=4):
    coded = base64.b64encode(random.Random(seed).randbytes(n)).decode()
    return "\n".join(coded[i : i + line] for i in range(0, n, line))[:n]


@pytest.mark.parametrize("n", [500, 600, 1000, 1500, 4000, 4096, 8190, 20_000, 100_000])
@pytest.mark.parametrize("line", [20, 40, 76])
def test_base64_is_rejected(n, line):
    assert not bands.verdict(base64_lines(n, line).encode(), zstandard.ZstdCompressor(level=3))[2]


@pytest.mark.parametrize("n", [3000, 8190, 20_000, 100_000])
def test_base64_mixed_with_prose_is_rejected(n):
    packer = zstandard.ZstdCompressor(level=3)
    words = prose(n // 4)
    for share in (0.5, 0.6, 0.9):
        coded, plain = base64_lines(int(n * share)), words[: n - int(n * share)]
        if n > 4096 or share > 0.8:
            assert not bands.verdict((plain + "\n" + coded).encode(), packer)[2]
            assert not bands.verdict((coded + "\n" + plain).encode(), packer)[2]
    assert bands.verdict(words[:n].encode(), packer)[2]


def test_the_last_chunk_is_judged():
    packer = zstandard.ZstdCompressor(level=3)
    text = prose(2000)[:4096] + base64_lines(4000)
    assert abs(bands.verdict(text.encode(), packer)[1] - 4000 / 8096) < 1e-9


#: Plain prose of seven scripts.
PROSE = [
    "春天来了，山上的雪慢慢化开，小河又有了水声。村里的人一早就下地干活，孩子们背着书包走过石桥去学校。老人坐在门前晒太阳，说起从前的事情："
    "那时没有公路，买盐要走一整天。如今卡车每周来两次，带来布匹、书信和城里的消息。到了晚上，家家点起灯，饭菜的香味飘满小巷，大家围坐一起，谈论收成和天气，"
    "直到月亮升上屋顶。第二天清晨，雾还没有散去，渔夫已经把船推下水，远处传来寺里的钟声。",
    "Весной снег на склонах тает, и ручьи снова шумят под мостом. Утром люди выходят в поле, дети с сумками идут в школу, а старики сидят у дверей и "
    "вспоминают прежние годы. Тогда дороги не было, и за солью шли целый день. Теперь дважды в неделю приезжает грузовик с письмами, тканью и новостями из города. "
    "Вечером в домах зажигают лампы, и соседи долго говорят о погоде и урожае.",
    "في الربيع يذوب الثلج على سفوح الجبال وتعود المياه إلى النهر الصغير قرب القرية. يخرج الناس باكرا إلى الحقول ويمشي الأطفال إلى المدرسة فوق الجسر القديم، "
    "بينما يجلس الشيوخ أمام البيوت ويتذكرون الأيام التي لم يكن فيها طريق ولا سيارة، وكان شراء الملح يستغرق يوما كاملا من السير بين التلال.",
    "वसंत में पहाड़ों की बर्फ पिघलती है और छोटी नदी में फिर पानी बहने लगता है। सुबह लोग खेतों में काम करने जाते हैं, बच्चे पुराने पुल से होकर स्कूल पहुँचते हैं और बूढ़े "
    "दरवाज़े पर बैठकर बीते दिनों की बातें करते हैं, जब नमक लाने के लिए पूरा दिन चलना पड़ता था।",
    "Στην άνοιξη το χιόνι λιώνει στις πλαγιές και το ρυάκι κάτω από τη γέφυρα ακούγεται ξανά. Οι άνθρωποι πηγαίνουν νωρίς στα χωράφια, τα παιδιά περπατούν ως το σχολείο "
    "και οι γέροντες κάθονται μπροστά στις πόρτες και θυμούνται τα παλιά χρόνια, όταν δεν υπήρχε δρόμος.",
    "In spring the snow melts on the slopes and the brook below the bridge is heard again. People leave early for the fields, children walk to school with their bags, and "
    "old men sit by their doors and recall the years when there was no road and a trip for salt took a whole day. Twice a week a truck now brings cloth, letters and news.",
    "Im Frühjahr schmilzt der Schnee an den Hängen, und man hört wieder den Bach unter der Brücke. Früh gehen die Leute auf die Felder, Kinder laufen mit ihren Taschen zur "
    "Schule, und Alte sitzen vor den Türen und erzählen, wie es früher war, als noch keine Straße ins Dorf führte und man für Salz einen Tag lang wandern musste.",
]


@pytest.mark.parametrize("prose", PROSE)
def test_prose_of_any_script_passes(prose):
    packer, raw = zstandard.ZstdCompressor(level=bands.LEVEL), prose.encode()
    assert all(bands.verdict(raw[:n], packer)[2] for n in range(200, len(raw) + 1))


@pytest.mark.parametrize("size", [256, 300, 450, 640, 1000, 2000, 4000, 4500, 20000])
def test_base64_does_not(size):
    import base64
    import random

    packer = zstandard.ZstdCompressor(level=bands.LEVEL)
    for seed, width in enumerate((20, 60, 76)):
        code = base64.b64encode(random.Random(seed).randbytes(size))
        text = b"\n".join(code[i : i + width] for i in range(0, len(code), width))[:size]
        assert not bands.verdict(text, packer)[2]
