import json

import pytest

from corpuslake.llm import mojibake as M

WORDS = "ley artículo resolución término días pensión está será ningún según año señal cláusula título capítulo está podrá omitió declaración petición ocasión".split()


def clean(n=400):
    out = []
    for i in range(n):
        ws = [WORDS[(i * 7 + k * (1 + i % 5)) % len(WORDS)] for k in range(30)]
        out.append(json.dumps({"texto": f"Ley {i} › TÍTULO I\n" + " ".join(ws) + ". ¿Procede la devolución? Sí.", "n": i, "areas": ["Señal"]}))
    return out


@pytest.fixture(scope="module")
def model():
    return M.fit(clean())


@pytest.mark.parametrize("true,wrong", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp437")])
def test_round_trip(model, true, wrong):
    text = "según la declaración está en término"
    bad = "".join(bytes([b]).decode("latin-1") if wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(wrong) for b in text.encode(true))
    fixed, chains = model.repair(bad)
    assert chains and fixed == text


def test_twice(model):
    once = "declaración".encode().decode("cp1252")
    fixed, chains = model.repair(once.encode().decode("cp1252"))
    assert fixed == "declaración" and chains


def test_margin_is_validated_on_garbled_tokens(model):
    assert model.recall > 0.95 and M.fit([]).recall == 0.0
    assert M.garble("año", "utf-8", "cp1252") == "aÃ±o" and M.garble("ano", "utf-8", "cp1252") is None


def test_question_far_from_its_opening(model):
    text = "¿Procede " + "la declaración " * 100 + "? Sí."
    assert model.repair(text) == (text, set())


def test_lost_letters(model):
    assert model.repair("la pensi�n")[1] == {"lost"}
    assert model.repair("la declaraci?n est? en t?rmino")[1] == {"lost"}


@pytest.mark.parametrize("text", ["Conceição Ãnthão de São Brás", "«Лира»", "├── Anexo", "√(a + b) ≥ 1", "¿Procede la devolución? Sí", "4 °C ± 1 °C", "", "plain ascii"])
def test_alike(model, text):
    assert model.repair(text) == (text, set())


def test_no_model_finds_only_replacement():
    empty = M.fit([])
    assert empty.repair("declaraciÃ³n") == ("declaraciÃ³n", set())
    assert empty.repair("�")[1] == {"lost"}


def test_table(spark):
    long = "término " * 20_000
    rows = [(f"c{i}", d, "x") for i, d in enumerate(clean(60))] * 2
    rows += [("bad", json.dumps({"texto": "la declaraciÃ³n", "ruta": [{"a": "pensiÃ³n"}]}), "x")] * 2
    rows += [("null", None, "x"), (None, "{}", "x"), ("broken", "{", "x"), ("long", json.dumps({"texto": long + "�"}), "x"), ("empty", '{"texto": ""}', "x")]
    df = spark.createDataFrame(rows, "chunk_id string, datos string, reparado string")
    got = M.repair_chunks(df).collect()
    assert {(r.chunk_id, r.campo) for r in got} == {("bad", "texto"), ("bad", "ruta[0].a"), ("long", "texto")}
    assert {r.reparado for r in got if r.campo == "ruta[0].a"} == {"pensión"}
    assert {r.recuperable for r in got if r.chunk_id == "long"} == {False}
    assert sorted(r.chunk_id for r in M.found(df).collect()) == ["bad", "long"]
    assert M.found(df.limit(0)).count() == 0
