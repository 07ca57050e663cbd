import pytest
from test_ocr import SENT, texts

from corpuslake.llm import ocr as O


@pytest.fixture(scope="module")
def editor():
    return O.fit(texts())


def test_keep_can_veto(editor):
    before = editor.chars.w
    editor.chars.w = {"0" + c: {"K": 50.0} for c in "abcdefghijklmnopqrstuvwxyzáéíóúñ0123456789@"}
    try:
        assert editor._correct("expcdiente") is None
    finally:
        editor.chars.w = before
    assert editor._correct("expcdiente") == "expediente"


def test_operation_outside_the_pairs(editor):
    assert not any(seen == "x" for _, seen in O.CONFUSIONS)
    assert editor._correct("municipxal") == "municipal"


def test_repeated_header_of_another_shape():
    head = "Boletín oficial del consejo"
    assert not any(p.fullmatch(head) for p in O.FURNITURE)
    pages = [f"Ley {i} de 1990\n{SENT.format(i=i)}\nHoja No. 3 de 9\nsalvo que el depósito sea anterior.\n{SENT.format(i=i)}\nHoja No. 4 de 9\nsalvo que el depósito sea anterior." for i in range(60)]
    model = O.fit(texts() + pages)
    lines = f"Ley 7 de 1990\n{SENT.format(i=7)}\n{head}\nsalvo que el depósito sea anterior.\n{SENT.format(i=8)}\n{head}\nsalvo que el depósito sea anterior."
    assert model.repair(lines)[1]["linea"] == 2
    once = f"Ley 7 de 1990\n{SENT.format(i=7)}\n{head}\nsalvo que el depósito sea anterior."
    assert model.repair(once)[1]["linea"] == 0
