import numpy as np
import pytest

from riwaya.llm import mojibake as m

CLEAN = ["قال الرجل إن الحساب عند القاضي وقد رأى الناس ذلك بعد صلاة الصبح فسأل عنه الشيخ ثم دخل السوق", "حدثنا سامر بن هاني عن قصي بن زاهر قال سمعت طلال بن غالب يقول ما كان في البيت إلا الخبز والملح", "وكان في القافلة من الطعام والشراب ما يكفي أهل القرية كلها حتى رجع التاجر بالمال والقمح والزيت"]


def garble(text, written, shown):
    return text.encode(written).decode(shown, "replace") if shown != "cp1252" else "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(written))


@pytest.mark.parametrize("shown", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_utf8_is_restored(shown):
    text = CLEAN[0] + " — «كذا»"
    assert m.from_utf8(garble(text, "utf-8", shown))[0] == text
    assert m.from_utf8(garble("été à Orléans", "utf-8", shown))[0] == "été à Orléans"


def test_utf8_twice():
    once = garble("déjà vu", "utf-8", "cp1252")
    assert m.from_utf8(garble(once, "utf-8", "cp1252"))[0] == "déjà vu"
    assert m.from_utf8(garble(garble("we’ll", "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == "we’ll"


@pytest.mark.parametrize("text", ["SÃO e MANHÃ", "CAFÉ»", "Ù Ú Ã © £ ¥ €", "حفظ، خط» كلاظ؛", "Ørsund på Ålø", "¿Quién? ¡oh!", "x² y³ z½ §12 ±3", *CLEAN, "Старая копия", "全角 文字 🙂", "Äußerung: Übung"])
def test_sound_text_stays(text):
    assert m.from_utf8(text) == (text, 0)


@pytest.fixture(scope="module")
def repaired(spark):
    rows, k = [], 0
    for _ in range(20):
        for c in CLEAN:
            rows.append((k, c, "clean"))
            k += 1
    for i, (written, shown) in enumerate([("cp1256", "latin-1"), ("cp1256", "cp1252"), ("iso8859_6", "latin-1"), ("cp1256", "cp1251"), ("iso8859_6", "cp1256")]):
        for j, c in enumerate(CLEAN):
            rows.append((1000 + 10 * i + j, garble(c, written, shown), f"s{i}"))
        rows.append((1000 + 10 * i + 5, CLEAN[0] + " " + garble("رأى الناس ذلك عند السوق", written, shown) + " " + CLEAN[1], None))
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "R�cit du ma�tre", "x"), (2003, "Старая копия " + CLEAN[0], "x"), (2004, "Ù Ú Ã © £ " + CLEAN[0], "x"), (2005, garble("été", "utf-8", "cp1252") * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("page", __import__("pyspark").sql.functions.lit(1))
    return {r.id: r for r in m.repair(df).collect()}


@pytest.mark.parametrize("i", range(5))
def test_single_byte_swaps_are_found_and_restored(repaired, i):
    for j in (0, 1, 2, 5):
        assert repaired[1000 + 10 * i + j].found
    for j, c in enumerate(CLEAN):
        same = np.mean([a == b for a, b in zip(repaired[1000 + 10 * i + j].restored, c, strict=False)])
        assert same > 0.97


def test_what_is_sound_is_not_found(repaired):
    assert not [k for k, r in repaired.items() if k < 1000 and r.found]
    for k in (2000, 2001, 2003, 2004):
        assert k not in repaired or not repaired[k].found


def test_latin_letters_in_a_single_byte_swap(spark):
    words = "récit français été rivière d’après père mère garçon naïve café kâtip ölçü için".split()
    clean = [(k, " ".join(words[(k + i * 3) % len(words)] for i in range(12)), "s") for k in range(150)]
    decoys = [(500, "Ørsund på Ålø, SÃO e MANHÃ " + clean[0][1], "s"), (501, "x² y³ z½ café", "s"), (502, "žlutá Šárka ñandú ÑU Þing Ðalur", "s")]
    bad = [(600, garble(clean[3][1], "cp1252", "cp850"), "s"), (601, clean[4][1] + " " + garble("récit d’après", "cp1252", "cp850"), "s"), (602, garble(clean[5][1], "cp1252", "mac_roman"), None)]
    got = {r.id: r for r in m.repair(spark.createDataFrame(clean + decoys + bad, "doc_id long, text string, source string")).collect() if r.found}
    assert set(got) == {600, 601, 602}
    assert got[600].restored == clean[3][1] and got[601].restored == clean[4][1] + " récit d’après" and got[602].restored == clean[5][1]


def test_lost_and_long(repaired):
    assert repaired[2002].found and not repaired[2002].whole
    assert repaired[2005].restored == "été" * 30_000


def test_learning_from_a_wrong_start():
    """Letters that a start has swapped come right by the bigrams."""
    model = np.full((m.N, m.N), 0.5)
    text = " ".join(CLEAN * 30)
    num = np.array([max(m.LETTERS.find(c), 0) for c in text])
    np.add.at(model, (num[:-1], num[1:]), 1)
    model /= model.sum()
    true = m.written_tables()["cp1256"]
    a, b = true.index("ن"), true.index("ل")
    wrong = list(true)
    wrong[a], wrong[b] = wrong[b], wrong[a]
    raw = np.frombuffer(text.encode("cp1256"), np.uint8)
    n = np.where(raw >= 128, raw.astype(np.int64) - 127, 0)
    pairs = np.bincount(n[:-1] * 129 + n[1:], minlength=129 * 129).reshape(129, 129).astype(float)
    pairs[0, 0] = 0
    learnt, _ = m.learn(pairs, "".join(wrong), model, rounds=60)
    assert learnt[a] == true[a] and learnt[b] == true[b]


def test_swaps_that_no_listed_pair_explains(spark):
    """Pages outside SHOWN, and a swap of no page at all, reach the learning; sound text in other letters stays."""
    own = " ".join(CLEAN).split()
    words = sorted({a[:2] + b[2:] for a in own for b in own if len(a) > 2 < len(b)})
    texts = [" ".join(words[(i * 25 + k) * 101 % len(words)] for k in range(25)) for i in range(60)]
    swap = dict(zip(m.LETTERS[1:], "югртйавёбшэнзжщсцеиукмплыодьхъфячѐђѓєѕіїј", strict=False))
    rows = [(k, t, "clean") for k, t in enumerate(texts)]
    for i, (written, shown) in enumerate([("cp1256", "koi8_r"), ("cp1256", "iso8859_5"), ("iso8859_6", "koi8_r"), ("iso8859_6", "iso8859_5")]):
        rows += [(1000 + 10 * i + k, garble(texts[k], written, shown), f"s{i}") for k in range(3)]
    rows += [(2000 + k, "".join(swap.get(c, c) for c in t), "swap") for k, t in enumerate(texts)]
    russian = "Старая копия рукописи хранится в библиотеке города и была описана впервые в прошлом веке. В ней сохранились рассказы о путешествиях купцов по Волге"
    rows += [(3000, russian, "ru"), *[(4000 + k, texts[k] + " Старая копия", None) for k in range(30)], (3002, russian + " " + texts[0], "s0")]
    got = {r.id: r for r in m.repair(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.found}
    assert set(got) == {1000 + 10 * i + k for i in range(4) for k in range(3)} | {2000 + k for k in range(60)}
    for i in range(4):
        for k in range(3):
            assert got[1000 + 10 * i + k].restored == texts[k]
    assert np.mean([a == b for k, t in enumerate(texts) for a, b in zip(got[2000 + k].restored, t, strict=True)]) > 0.9


def test_one_garbled_word(spark):
    """A word that stands alone counts if it reads as Arabic by a margin."""
    rows = [(k, c, "clean") for k, c in enumerate(CLEAN * 20)]
    pages = [("cp1256", "latin-1"), ("iso8859_6", "cp1251"), ("iso8859_6", "cp1256")]
    for i, (written, shown) in enumerate(pages):
        rows += [(1000 + i, f"{CLEAN[0]} {garble('والشراب', written, shown)} {CLEAN[1]}", f"s{i}")]
    rows += [(2000, "Копия " + CLEAN[0], "s1"), (2001, CLEAN[0] + " ÈÉÊ ÃÂ " + CLEAN[1], "s0"), (2002, CLEAN[0] + " چگونه " + CLEAN[1], "s2")]
    got = {r.id: r.restored for r in m.repair(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.found}
    assert got == {1000 + i: f"{CLEAN[0]} والشراب {CLEAN[1]}" for i in range(len(pages))}


def test_empty(spark):
    assert m.repair(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("shown", ["cp1252", "cp1251"])
def test_an_invented_swap_of_all_upper_bytes_is_learnt_from_no_page(spark, shown):
    """A permutation of the 128 upper bytes that is no page at all: nothing but the bigrams can tell its letters."""
    import random

    rnd = random.Random(3)
    order = list(range(128, 256))
    rnd.shuffle(order)
    show = lambda b: bytes([b]).decode(shown) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x98, 0x9D) else chr(b)
    own = " ".join(CLEAN).split()
    words = sorted({a[:2] + b[2:] for a in own for b in own if len(a) > 2 < len(b)})
    texts = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(80)]
    swapped = ["".join(show(order[b - 128]) if b > 127 else chr(b) for b in t.encode("cp1256")) for t in texts[:40]]
    rows = [(k, t, "clean") for k, t in enumerate(texts)] + [(1000 + k, t, "odd") for k, t in enumerate(swapped)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = m.bigram_models(df, "text").arabic
    base = float((model * np.log(model))[1:, 1:].sum() / model[1:, 1:].sum())
    assert not any(m._best(t, model, base) for t in swapped), "no listed page explains them"
    got = {r.id: r for r in m.repair(df).collect() if r.found}
    assert set(got) == {1000 + k for k in range(40)}
    assert np.mean([a == b for k in range(40) for a, b in zip(got[1000 + k].restored, texts[k], strict=True)]) > 0.9


def test_letters_are_learnt_from_random_starts():
    text = " ".join(CLEAN * 30)
    num = np.array([max(m.MARKED.find(c), 0) for c in text])
    model = np.full((m.K, m.K), 0.5)
    np.add.at(model, (num[:-1], num[1:]), 1)
    order = np.random.default_rng(5).permutation(m.K - 1) + 1
    symbol = np.where(num > 0, order[num - 1], 0)
    pairs = np.bincount(symbol[:-1] * 129 + symbol[1:], minlength=129 * 129).reshape(129, 129).astype(float)
    pairs[0, 0] = 0
    letter = m.learn_freely(pairs, model / model.sum())
    assert np.mean(letter[symbol[num > 0]] == num[num > 0]) > 0.8
