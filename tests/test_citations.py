import pytest

from corpuslake.operators import citations as C

L = ("ley", "1563", "2012")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Art. 41 de la Ley 1563 de 2012", {(*L, "41")}),
        ("los artículos 13, 15 y 42 de la ley 1563 de 2012", {(*L, "13"), (*L, "15"), (*L, "42")}),
        ("Ley 1563 de 2012. Art. 23.", {(*L, "23")}),
        ("Artículo 5. Según la Ley 1563 de 2012", {(*L, None)}),
        ("Ley 1563 de 2012, que reformó el artículo 9", {(*L, None)}),
        ("artículo 404 del Código Penal", {("codigo_penal", None, None, "404")}),
        ("la Ley 599 de 2000", {("codigo_penal", None, None, None)}),
        ("la ley 906, art. 7", {("codigo_procedimiento_penal", None, None, "7")}),
        ("Decreto Legislativo No. 12 del 1999", {("decreto", "12", "1999", None)}),
        ("Sentencia C-0355/06 y T 25 de 2004", {("jurisprudencia", "C-355", "2006", None), ("jurisprudencia", "T-25", "2004", None)}),
        ("art. 2 C.P. y la Constitución Política", {("constitucion", None, None, None)}),
        ("", set()), ("nada", set()),
    ],
)
def test_extract(text, want):
    assert C.extract(text) == want


def test_table_and_score(spark):
    df = spark.createDataFrame([(1, "art. 1 de la Ley 5 de 1990", 0), (1, "art. 1 de la Ley 5 de 1990", 0), (2, None, 0), (None, "Ley 5 de 1990", 0), (3, "", 0)], "qid long, t string, cuerpo int")
    assert [tuple(r) for r in C.citations(df, "qid", "t").collect()] == [(1, "ley", "5", "1990", "1")]
    assert C.citations(df.limit(0), "qid", "t").count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "qid long, cuerpo string, numero string, anio string")
    ids = spark.createDataFrame([(1,), (2,)], "qid long")
    a = rows((1, "ley", "5", "1990"), (1, "ley", "6", "1990"), (1, "cpaca", None, None))
    got = C.score(a, rows((1, "ley", "5", "1990"), (2, "cpaca", None, None)), rows((1, "cpaca", None, None)), ids)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 3, 1, 0, 1, 1), (2, 1, 0, 0, 0, 0, 0)}
    assert C.points(got).first().puntos == 0.0
