import pytest
from test_pages import LAW

from corpuslake.llm import markup as K


def test_nothing_beside_the_best_container_is_lost():
    text = "<div><p>Preámbulo del acto.</p></div><div><div><p>" + LAW.format(i=1) + "</p><p>" + LAW.format(i=2) + "</p></div> Texto suelto del acto.</div>Fin del acto."
    got = K.clean(text)
    assert [got.index(x) for x in ("Preámbulo", "fondo 1", "fondo 2", "Texto suelto", "Fin del acto")] == sorted(got.index(x) for x in ("Preámbulo", "fondo 1", "fondo 2", "Texto suelto", "Fin del acto"))


def test_headings_before_lists():
    assert K.clean("# Título\nvéase [[Ley|la ley]]\n* uno\n* dos").split("\n") == ["Título", "", "véase la ley", "• uno", "• dos"] or K.clean("# Título\nvéase [[Ley|la ley]]\n* uno\n* dos").split() == "Título véase la ley • uno • dos".split()
    assert K.clean("[[Ley|la ley]]\n# uno\n# dos").split() == "la ley • uno • dos".split()


def test_code_and_formulas_are_left_alone():
    got = K.clean("## T\n[[a|b]]\n```\n# comentario\n'''a''' <b>x</b> &amp;\n* z\n```\nfin")
    assert "    # comentario\n    '''a''' <b>x</b> &amp;\n    * z" in got and "\nb\n" in got
    assert K.clean("la cuota $x_i * y_i * z$ y **b**") == "la cuota x_i * y_i * z y b"
    assert K.clean("`*a*` y *b*") == "*a* y b"
    assert "a < b" in K.clean("<pre>a &lt; b\n  c</pre>")


def test_long_formula_is_a_mark():
    assert K.marks_of(K.read("la cuota $c = " + "a_i + " * 40 + "b$ vence")) == ["math"]


def test_private_characters_of_the_text_stay():
    assert K.clean("**a** \ue000 \ue005 \ue100 b") == "a \ue000 \ue005 \ue100 b"


def test_rows_come_from_the_tree(spark, monkeypatch):
    pasajes = spark.createDataFrame([(1, "un **plazo** fijo"), (2, "sin marcas"), (3, None)], "pasaje_id long, texto string")
    chunks = spark.createDataFrame([("a", None)], "chunk_id string, datos string")
    assert [r.clave for r in K.found(chunks, pasajes).collect()] == ["1"]
    root = K.read("un **plazo** fijo")
    for n in root.walk():
        n.marks.clear()
    assert K.marks_of(root) == []


@pytest.mark.parametrize("text", ["<", "&", "<b", "\\", "$$", "```", "[[", "{|", "<!--", "&#99999999;", "<p>" * 300 + "x"])
def test_broken_markup_does_not_fail(text):
    assert isinstance(K.clean(text), str)
