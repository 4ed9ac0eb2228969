import pytest

from lexweave.llm import canonical as C

CHANGED = {
    "ｗｉｄｅ": "wide", "𝐜𝐨𝐫𝐝": "cord", "oﬃce": "office", "café": "café", "so­ft": "soft", "a b": "a b", "a b": "a b",
    "соре": "cope", "trаffiс": "traffic", "weslοn": "weslon", "empirıcal": "empirical", "ɡirl": "girl", "Τhe": "The",
    "one ‎‏toy": "one toy", "x⁠y": "xy", "﻿start": "start", "it’s а cat": "it’s a cat", "ТҺЕ mаp": "THE map",
}
CHANGED |= {"tag\U000e0041ged": "tagged", "va\ufe0friation": "variation"}
KEPT = ["\U0001f3f4\U000e0067\U000e0062\U000e007f", "❤\ufe0f", "", "plain", "é ñ ß", "x̄", "дружба", "«Край земли» and", "λόγος", "π", "می‌خواهم", "👩‍🏫🎉", "“q” — …", "½ x² № ™", "a\tb\nc",
        "Он и она дружба", "/ɡɑːdən/", "Diyarbakır ve İzmir", "angle α", "µm", "А у нас дома тихо", "А у нас дома тихо. А у вас?", "Он сказал: «а». А.", "The film «а у нас» ran", "漢字とかな", "ქართული"]
CHANGED |= {"Cat а у dog": "Cat a y dog", "Дом. The сор ran": "Дом. The cop ran"}


@pytest.mark.parametrize("text", CHANGED)
def test_changed(text):
    assert C.canonical(text) == CHANGED[text]
    assert C.canonical(CHANGED[text]) == CHANGED[text]


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert C.canonical(text) == text


def test_frames(spark):
    long = "word " * 200_000 + "mаp"
    rows = [(1, "plain", 7), (2, None, 7), (3, "", 7), (4, "mаp", 7), (4, "mаp", 7), (5, long, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_clean int")
    assert sorted(r.doc_id for r in C.changed_texts(df.drop("text_clean"), "doc_id", "text").collect()) == [4, 4, 5]
    clean = C.clean_texts(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert {r.text for r in clean.filter("doc_id = 4").collect()} == {"map"}
    assert C.clean_texts(df.limit(0)).count() == 0
    lex = spark.createDataFrame([(1, None, None), (2, "соре", ["cope", None]), (3, "a", []), (4, "b", ["ｂ"])], "entry_id long, form string, heads array<string>")
    got = {r.entry_id: (r.form, r.heads, r.changed) for r in C.clean_lexicon(lex).collect()}
    merged = spark.createDataFrame([(1, "соре", ["x", "y"]), (2, "cope", ["y", "ｚ", None]), (3, None, ["q"]), (4, "a", []), (5, "a", None)], "entry_id long, form string, heads array<string>")
    assert {r.form: (r.heads, r.n_entries) for r in C.form_to_heads(C.clean_lexicon(merged)).collect()} == {"cope": (["x", "y", "z"], 2), "a": ([], 2)}
    assert got == {1: (None, None, False), 2: ("cope", ["cope", None], True), 3: ("a", [], False), 4: ("b", ["b"], True)}
