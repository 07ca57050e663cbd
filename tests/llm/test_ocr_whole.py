import json

import pytest
from test_ocr import SENT, texts

from corpuslake.llm import ocr as O


@pytest.fixture(scope="module")
def editor():
    return O.fit(texts())


@pytest.mark.parametrize("bad,good", [("1a", "la"), ("d3", "de"), ("de1", "del"), ("1os", "los")])
def test_short_tokens(editor, bad, good):
    editor.words.setdefault("de", 120)
    assert editor._settled(bad) is False
    assert editor.correct(bad) in (good, None) and (bad != "1a" or editor.correct(bad) == good)


def test_long_token_and_many_edits():
    word = "desproporcionalizadamentecontrainterrogatorio"
    model = O.fit(texts() + [f"Ley {i} de 1990\nEl {word} del expediente." for i in range(40)])
    bad = word.replace("tr", "fr", 1).replace("in", "1n").replace("o", "0")
    assert len(bad) > 30 and model.correct(word.replace("contra", "c0ntra")) == word
    assert model.correct(bad) in (word, None)


def test_line_of_any_length_may_be_furniture(editor):
    head = "12 | " + "Boletín oficial del consejo municipal de la república y de los demás órganos del departamento, edición ordinaria"
    assert len(head) > 90
    text = f"Ley 7 de 1990\n{SENT.format(i=7)}\n{head}\nsalvo que el depósito sea anterior."
    feats = O.line_features(text.split("\n"), 2, "Ley 7 de 1990", O.repeats(text.split("\n")))
    assert feats[0] != "none" and isinstance(editor.is_furniture(text.split("\n"), 2, "Ley 7 de 1990", O.repeats(text.split("\n"))), bool)


def test_mark_after_a_long_word():
    assert O._broken("x " + "a" * 200 + "-")[1] == "a" * 200


def test_codes_of_clean_records_are_kept():
    model = O.fit(texts() + [f"Ley {i} de 1990\nEl lote d{i % 9} del expediente." for i in range(60)])
    assert model.codes["d9"] == 60 and model.correct("d3") is None
    assert model.repair("Ley 1 de 1990\nPortal v15.8 del expediente")[1]["letra"] == 0


def test_lexicon_over_all_records(spark):
    rows = [(f"c{i}", json.dumps({"texto": f"Ley {i} de 1990\nEl tesorero del fondo rara{'z' * (i % 2)}"})) for i in range(40)] + [("x", json.dumps({"texto": "roto-\nfin"})), ("n", None)]
    df = spark.createDataFrame(rows, "chunk_id string, datos string")
    got = {r.w: r.n for r in O.word_counts(df).collect()}
    assert got[""] == 40 and got["tesorero"] == 40 and got["raraz"] == 20 and "roto" not in got
    assert {"tesorero", "rara"} <= set(O.fit_model(df).words)
