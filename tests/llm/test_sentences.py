"""Problem 9: sentences of many scripts, given as texts with bars at the boundaries."""

import time
import unicodedata

import pytest

from candlery.llm.sentences import sentences, split_documents

CASES = [
    "Mr. Smith paid $3.50 at 5 p.m. on Monday.| He left at 6 p.m.| Then it rained?!| Yes.",
    "By 5:26 UTC, the U.S. unit cut fees, e.g. in St. Fenovar.| On Friday, J. E. Doe added: “It works. It does!”| Fine.",
    "“Will it hold?” the note asks.| “No,” said Q. A. Orvond.| (It fell 2.4%.)| Inc. names such as Hulekka Inc. stay.",
    "As of v0.19.1. the rest … and more.| Next one...| Last",
    "Am 17. Oktober hat Fr. Orvimm rd. 46,5 Mio. Euro gemeldet, d. h. viel.| Zum 34. Mal!| »So ruhig?«, heißt es.| „Alles ruhig.“| Am 1. Mai.",
    "Selon M. Velador, ça monte !| Mme Pell précise : « Rien ne va. »| La sté. Vel (cf. p. 25)…| Fin",
    "El núm. 7 subió.| ¡Sigue abierta!| «¡Cae!», dijo Sra. Rud.| —¿Y eso? —preguntó Ana.| Wex S.A. subió, etc.| ¿Qué?",
    "Згідно з п. 50 звіту, О. К. Бексад діє.| У 2020 р. ТОВ «Вел» росте порівняно з 2019 р.| Біржа зупинила на 23 год.| «Падає!» — сказав п. Люмар.| — Чому? — питає він.",
    "做市商下调至3.77%，引发关注！？|截至9:30，基金会筹集了约0.80亿元。|“储备翻了一倍。”奥德拉说。|尔沃表示：“好。”|“某钱包支撑。”塔尼斯说。|上涨了……|结束",
    "財団は10枚を移動した…|「倍増した！」ウルヴォ氏はそう書いた。|氏は「v1.2を公開した。」と語った。|終わり",
    "डॉ. तारनिस ने 1.4 करोड़ रु. जुटाए।।| “BrinChain ठुकराया।” फेंडा ने कहा।| फेंडा ने लिखा: “दोगुना किया।”| सुबह 2:11 बजे?",
    "في عام 2023 م. أعلنت بورصة 0.82 مليون.| «هل راجع؟» سأل أ. أولفو.| وكتب د. فيلمورا: «أكد الفريق.»| نعم؟",
    "ทีมพัฒนาได้เพิ่มเงิน| ล่าสุด 24 ชั่วโมง| แม้ตลาดซบเซา 5.44% แล้ว| จบ",
]


@pytest.mark.parametrize("marked", CASES)
def test_boundaries(marked):
    text = marked.replace("|", "")
    assert [text[a:b] for a, b in sentences(text)] == [s.strip() for s in marked.split("|")]


def test_spans_are_judged_as_a_whole():
    """The same doubtful end closes a sentence or not, as the span before it is long enough to be one."""
    cases = [
        "У 2023 р. ТОВ «Пел» зросла.| Вона зросла порівняно з 2019 р.| ТОВ «Пел» зупинила вивід.",
        "У 2023 \u200b р. біржа зросла.| У 2021 р. Ульвенко знизив комісію.",
        "Según Sr. Nymippa, el precio sube.",
    ]
    for marked in cases:
        text = marked.replace("|", "")
        assert [text[a:b] for a, b in sentences(text)] == [x.strip() for x in marked.split("|")]


def test_quotations_hold_a_few_sentences_but_stray_marks_hold_none():
    text = "He said: “It works. It does! It will.” Then “ it rained. It poured all day. Nobody came here. They all left. It was late. The end came.” Done."
    found = [text[a:b] for a, b in sentences(text)]
    assert found[0] == "He said: “It works. It does! It will.”"
    assert "It poured all day." in found and "They all left." in found


def test_decomposed_letters_and_lost_spaces():
    text = unicodedata.normalize("NFD", "Le 24 avril, la sté. Syluvia publie. Pese a todo, el núm. 14 sube.")
    assert [text[a:b] for a, b in sentences(text)] == [unicodedata.normalize("NFD", x) for x in ("Le 24 avril, la sté. Syluvia publie.", "Pese a todo, el núm. 14 sube.")]
    text = "Traders sold rigs at 5 p.m.In a note, Mr.Fenn is how they put it.On Thursday it fell."
    assert [text[a:b] for a, b in sentences(text)] == ["Traders sold rigs at 5 p.m.", "In a note, Mr.Fenn is how they put it.", "On Thursday it fell."]


def test_carriage_returns_wrap_lines():
    text = "Key levels:\r\n1. first\r\n2. second\r\n\r\nA line that\r\ngoes on. Next one\r\nhere."
    assert [text[a:b] for a, b in sentences(text)] == ["Key levels:", "first", "second", "A line that\r\ngoes on.", "Next one\r\nhere."]


def test_blocks_and_items():
    text = "\tTitle here\n\nWrapped line\ngoes on. Next.\r\n \r\nKey levels:\n1. first, approx. 2.5\n2. second. Third\n• dot\n* star\n\nam\n17. Oktober ging es.\n"
    assert [text[a:b] for a, b in sentences(text)] == ["Title here", "Wrapped line\ngoes on.", "Next.", "Key levels:", "first, approx. 2.5", "second.", "Third", "dot", "star", "am\n17. Oktober ging es."]


def test_code_points_and_nothing():
    text = "😀 One. 😀 Two."
    assert [text[a:b] for a, b in sentences(text)] == ["😀 One.", "😀 Two."]
    assert sentences(None) == sentences("") == sentences(" \n\t ") == []


def test_long_texts_stay_linear():
    for text in ("Word one. " * 20_000, "“" * 20_000, "no end " * 50_000, "a.b" * 50_000, "\n" * 50_000, "“A.” " * 10_000):
        began = time.time()
        found = sentences(text)
        assert time.time() - began < 20
        assert all(0 <= a < b <= len(text) for a, b in found)


def test_documents(spark):
    rows = [(1, "One. Two.", 9), (2, None, 9), (3, "", 9), (1, "One. Two.", 9)]
    out = split_documents(spark.createDataFrame(rows, "doc_id long, text string, start_char int")).collect()
    assert sorted(map(tuple, out)) == sorted([(1, 0, 4), (1, 5, 9)] * 2)
