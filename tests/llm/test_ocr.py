import json

import pytest

from corpuslake.llm import ocr as O

SENT = "La prenda municipal del expediente podrá autorizar con cargo al presupuesto una declaración de la garantía mensual en los términos del artículo {i} por valor de {i} unidades"


def texts():
    out = []
    for i in range(60):
        out.append(f"Ley {i} de 1990\n" + SENT.format(i=i) + " salvo que el depósito sea anterior.")
        out.append(f"Ley {i} de 1990\n{SENT.format(i=i)}\n{i + 3}\nHoja No. 3 de 9\nsalvo que el depósito sea anterior.\nR E P Ú B L I C A – A R C H I V O\nfin del expediente {i}")
    return out


@pytest.fixture(scope="module")
def editor():
    return O.fit(texts())


@pytest.mark.parametrize("bad,good", [("dec1aración", "declaración"), ("garantfa", "garantía"), ("expcdiente", "expediente"), ("térrninos", "términos"), ("rnensual", "mensual"), ("depósifo", "depósito"), ("@utorizar", "autorizar"), ("presupiiesto", "presupuesto")])
def test_letters(editor, bad, good):
    assert editor.correct(bad) == good


def test_known_and_codes(editor):
    text = "Ley 1 de 1990\nLos códigos B8-510 y 5S-01l identifican el lote.\nEl régimen político-administrativo del artículo 3."
    assert editor.repair(text)[1] == {"linea": 0, "corte": 0, "letra": 0}


@pytest.mark.parametrize("mark", list("-–¬\xad"))
def test_joined_words(editor, mark):
    got, n = editor.repair(f"Ley 1 de 1990\nLa prenda municipal podrá autorizar una decla{mark}\nración de la garantía.")
    assert "declaración" in got and n["corte"] == 1


def test_furniture_between(editor):
    got, n = editor.repair("Ley 1 de 1990\nLa prenda municipal podrá autorizar una decla-\n17\nHoja No. 3 de 9\nración de la garantía.")
    assert "declaración de la garantía." in got and n["linea"] == 2 and n["corte"] == 1


def test_hard_ends_alone(editor):
    got, n = editor.repair("Ley 1 de 1990\nLa prenda municipal del expediente podrá autorizar\nuna declaración de la garantía.")
    assert sum(n.values()) == 0 and got.split("\n")[1] == "La prenda municipal del expediente podrá autorizar una declaración de la garantía."


def test_ops_round_trip():
    for true, seen in O.CONFUSIONS:
        assert "".join(O.apply_op(c, op) for c, op in zip(seen, O._ops(true, seen))) == true


def test_perceptron_learns():
    p = O.Perceptron()
    p.fit([(["a"], "X"), (["b"], "Y")] * 20, ["X", "Y"])
    assert p.scores(["b"])["Y"] > p.scores(["b"])["X"]


def test_table(spark, editor):
    rows = [(f"c{i}", json.dumps({"texto": t})) for i, t in enumerate(texts())] * 2
    rows += [("n", None), (None, "{}"), ("e", '{"texto": ""}'), ("b", "{"), ("long", json.dumps({"texto": "Ley 1\n" + (SENT.format(i=1) + ".\n") * 2000 + "la dec1aración"}))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, datos string, lineas int")
    got = {r.chunk_id for r in O.found(df).collect()}
    assert got == {f"c{i}" for i in range(1, 120, 2)} | {"long"}
    assert O.found(df.limit(0)).count() == 0
