from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.operators import chunker as C

META = {"doc_id": "ley_5_1990", "nombre_citable": "Ley 5 de 1990", "vigencia": "vigente"}
NORM = """# Ley 5 de 1990

Preámbulo de la ley.

## Título I

### Capítulo 2

###### Artículo 1. Objeto

Primer inciso.

> **Notas de Vigencia:** corta

> **Concordancias:** Ley 6

###### Artículo 2.

~~Todo tachado.~~

## Anexos

Una tabla.
"""


def test_norm():
    got = C.chunks_of(META, NORM)
    assert [(c.chunk_id, c.kind) for c in got] == [
        ("ley_5_1990/preambulo#1", "preambulo"), ("ley_5_1990/art_1", "articulo"), ("ley_5_1990/art_1/notas", "notas"),
        ("ley_5_1990/art_2", "articulo"), ("ley_5_1990/anexo#1", "anexo"),
    ]
    one, two = got[1], got[3]
    assert one.text == "Ley 5 de 1990 › Título I › Capítulo 2 [vigencia: vigente]\nArtículo 1. Objeto\nPrimer inciso.\n\nNotas de Vigencia: corta"
    assert one.path_ids == {"titulo": "ley_5_1990/título_i", "capitulo": "ley_5_1990/título_i/capítulo_2"}
    assert not one.struck and two.struck and got[4].path == ["Anexos"]
    assert all(NORM[p.start : p.end].endswith(p.text[-6:]) for c in got for p in c.body)


def test_repeated_and_long_articles():
    long = "\n\n".join(f"Inciso {i}. " + "palabra " * 60 for i in range(12))
    got = C.norm_chunks(META, f"###### Artículo 1.\n\n{long}\n\n###### Artículo 1.\n\nOtro.")
    parts = [c for c in got if c.kind == "parte_articulo"]
    assert [c.part for c in parts] == list(range(1, len(parts) + 1)) and all(c.parts == len(parts) for c in parts)
    assert f"(parte 1 de {len(parts)})" in parts[0].text and got[-1].chunk_id == "ley_5_1990/art_1~2"


def test_long_box():
    box = "> **Jurisprudencia Vigencia:** " + "letra " * 200
    got = C.norm_chunks(META, f"###### Artículo 1.\n\n{box}")
    assert got[0].body[0].text.endswith("…(sigue en notas)") and len(got[0].body[0].text) < 830 and got[1].kind == "notas"


def test_ruling():
    meta = {"doc_id": "jurisprudencia_c-1_1999", "tipo_documento": "sentencia", "nombre_citable": "Sentencia C-1 de 1999", "organo_emisor": "Corte Constitucional"}
    text = "# Sentencia\n\nResumen.\n\n## Antecedentes\n\n" + "\n\n".join(f"Hecho {i}. " + "texto " * 100 for i in range(9)) + "\n\n## RESUELVE\nPrimero.\n\nSegundo."
    got = C.chunks_of(meta, text)
    assert got[0].kind == "ficha" and got[0].text == "Corte Constitucional, Sentencia C-1 de 1999 › Ficha\nResumen.\n\nRESUELVE:\n\nPrimero.\n\nSegundo."
    sections = [c for c in got if c.section == "Antecedentes"]
    assert sections[0].head.endswith(f"Antecedentes (1/{len(sections)})") and sections[1].body[0] == sections[0].body[-1]
    assert {c.section_id for c in sections} == {"jurisprudencia_c-1_1999/antecedentes"}


def brute(pieces, limit, overlap):
    """The packing rule, one piece at a time, from its definition."""
    groups, cur = [], []
    for p in C.pieces_within(pieces, limit):
        total = sum(len(x.text) for x in cur) + len(p.text)
        if cur and total > limit:
            groups.append(cur)
            cur = [cur[-1]] if overlap and 2 * len(cur[-1].text) < limit - limit % 2 else []
        cur = cur + [p]
    if cur and groups and not overlap and sum(len(x.text) for x in cur) < C.SHORT:
        groups[-1] = groups[-1] + cur
    elif cur:
        groups.append(cur)
    return groups


@given(st.lists(st.text(alphabet="ab .;\n", min_size=1, max_size=90), max_size=14), st.integers(5, 80), st.booleans())
@settings(max_examples=150, deadline=None)
def test_windows(texts, limit, overlap):
    doc = "\n\n".join(t.replace("\n\n", "\n") for t in texts)
    pieces = list(C.blocks(doc))
    assert all(doc[p.start : p.end] == p.text for p in pieces)
    cut = list(C.pieces_within(pieces, limit))
    assert all(len(p.text) <= limit + 1 and (len(p.text) <= limit or p.text[-1] in ".;:") and p.text.strip() in doc[p.start : p.end + 1] for p in cut)
    got = C.windows(pieces, limit, overlap)
    assert got == brute(pieces, limit, overlap)
    flat = [p for k, g in enumerate(got) for p in (g[1:] if k and overlap and g[0] == got[k - 1][-1] else g)]
    assert flat == cut


def test_table(spark):
    df = spark.createDataFrame([(1, "LEY 5\nARTÍCULO 1º. Uno.\nARTÍCULO 2º. Dos.", "ley", 0), (2, None, "ley", 0), (3, "", None, 0), (None, "x", "ley", 0)], "doc_id long, text string, tipo_documento string, md int")
    got = C.chunk_documents(C.markdown_documents(df)).collect()
    assert [(r.doc_id, r.chunk_id, r.texto.split("\n")[-1]) for r in got] == [("1", "1/art_1", "Uno."), ("1", "1/art_2", "Dos.")]
    assert C.chunk_documents(C.markdown_documents(df.limit(0))).count() == 0
