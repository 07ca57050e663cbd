from corpuslake.llm import boilerplate as B

from test_pages import LAW, page

OTHER = [
    "Home / Noticias / Contacto",
    "Acceso a usuarios — Mi cuenta — Salir",
    "Ley 5 de 1990 › TÍTULO I",
    LAW.format(i=5),
    "Aceptar todas | Rechazar | Configurar",
    "Webmaster: sitio@ejemplo.example",
]


def test_site_of_other_wording():
    assert not any(B._sure(B.kind(x)) for x in OTHER)
    plain = [f"Ley {i} de 1991\n" + LAW.format(i=i) + "\n\nQuedan reservados los derechos sobre la versión para imprimir." for i in range(80)]
    found = B.fit([page(i) for i in range(80)] + plain).site_lines("\n".join(OTHER))
    assert {0, 1, 4} <= set(found) and not {2, 3} & set(found)
