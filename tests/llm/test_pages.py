import json

import pytest

from corpuslake.llm import boilerplate as B
from corpuslake.llm import markup as K

LAW = "Artículo {i}. Toda prenda del fondo {i} podrá autorizar con cargo al presupuesto un depósito de la entidad en los términos del artículo {i}; cada cuota habrá de conservar dicha garantía mensual y el informe del comité."


def page(i):
    return (
        f"Inicio | PQRS | Agenda | Boletines\nLey {i} de 1990 › TÍTULO I\nLea también:\n• Decreto 7 de 1999\nLey {i + 1} de 2001\nCada cuota del fondo...\n\n"
        + LAW.format(i=i)
        + "\nEl prestador publicará en su página de inicio un aviso de cookies y la política de tratamiento de datos.\nVolver arriba ↑\nVisitas: 7"
    )


SITE = [0, 2, 3, 4, 5, 9, 10]


@pytest.fixture(scope="module")
def crf():
    plain = [f"Ley {i} de 1991\n" + LAW.format(i=i) + "\n\nQuedan reservados los derechos sobre la versión para imprimir." for i in range(80)]
    return B.fit([page(i) for i in range(80)] + plain)


def test_lines(crf):
    assert crf.site_lines(page(900)) == SITE
    assert crf.site_lines("Ley 3 de 1991\n" + LAW.format(i=3)) == []
    assert crf.site_lines("") == []


def test_garbled_wording(crf):
    assert crf.site_lines(page(900).replace("é", "Ã©").replace("ó", "Ã³").replace("í", "Ã\xad")) == SITE


def test_main_text(crf):
    body = crf.main_text(page(900))
    assert body.startswith("Ley 900 de 1990 › TÍTULO I") and body.rstrip().endswith("datos.")


def test_tables(spark, crf):
    chunks = spark.createDataFrame([("a", json.dumps({"texto": page(1)}), 1), ("a", json.dumps({"texto": page(1)}), 2), ("n", None, 1), (None, "{}", 1), ("b", "[]", 1)], "chunk_id string, datos string, linea int")
    pasajes = spark.createDataFrame([(5, page(2)), (6, None), (None, page(3)), (7, "")], "pasaje_id long, texto string")
    got = {tuple(r) for r in B.site_lines(chunks, pasajes, crf).distinct().collect()}
    assert got == {("chunks", "a", i) for i in SITE} | {("pasajes", "5", i) for i in SITE}
    assert B.found(chunks.limit(0), pasajes.limit(0)).count() == 0
    assert K.found(chunks, pasajes).count() == 0 and K.found(chunks.limit(0), pasajes.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,kind",
    [
        ("<p>Uno</p>", "html"), ("pensi&oacute;n", "entity"), ("## Título", "heading"), ("un **plazo** fijo", "bold"), ("un *plazo* fijo", "italic"),
        ("un ~~plazo~~", "strike"), ("`x`", "code"), ("[a](https://x.example)", "link"), ("|---|---:|", "rule"), ("> cita", "quote"), ("- uno\n- dos", "list"),
        ("== Título ==", "wiki heading"), ("el '''plazo'''", "wiki quote"), ("[[Ley|la]]", "wiki link"), ("{| class=x\n|-\n|}", "wiki table"),
        ("\\section{Uno}", "latex"), ("t\\'{e}rmino", "latex accent"), ("la $c_i$ cuota", "math"),
    ],
)
def test_marks(text, kind):
    assert kind in K.kinds(text)


@pytest.mark.parametrize("text", ["a < b y b > 3 con 2 * 3 = 6 (*).", "$ 1.000 y no $2.000, folio # 3", "nota *** al pie ~ aproximada", "ley_1_2/art_3: [...] [sic]", "C:\\archivo\\tomo_2 & anexos {A-1}", "1. Primera.\na) Literal.", "fondo | 3 | cuota", "", "- 12 -"])
def test_no_marks(text):
    assert K.kinds(text) == [] and K.clean(text) == text


def test_clean():
    assert K.clean("Ley 1\n<h2>Ley 1</h2><p>La <b>pensi&oacute;n</b> vigente del fondo, en su término.</p><ul><li>uno</li><li>dos</li></ul><pre>a = 1\nb</pre>").split() == "Ley 1 Ley 1 La pensión vigente del fondo, en su término. • uno • dos a = 1 b".split()
    assert K.clean("{| class=x\n|-\n| a || 1\n|}") == "a | 1"
    assert K.clean("\\begin{tabular}{lr}\na & 1 \\\\\nb & 2\n\\end{tabular}").split("\n")[0] == "a | 1"
    assert K.clean("t\\'{e}rmino, art\\'{\\i}culo, a\\~no") == "término, artículo, año"
    assert K.clean("```\nx = <y>\n```").strip() == "x = <y>"
    assert K.clean("a & b < c **d**") == "a & b < c d"


def test_tree_scoring_drops_link_lists():
    nav = "<nav><ul>" + "".join(f'<li><a href="/{i}">una entrada del menú del sitio {i}</a></li>' for i in range(8)) + "</ul></nav>"
    body = "<div><p>" + "Una cuota, un plazo, y una prenda del fondo. " * 5 + "</p><p>" + "Otra cuota, otro plazo. " * 8 + "</p></div>"
    got = K.clean(nav + body)
    assert "entrada" not in got and "Otra cuota" in got


def test_long_text():
    assert K.clean("palabra, " * 50_000 + "**x**").endswith("x")
