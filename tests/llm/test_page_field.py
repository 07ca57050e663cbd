import itertools

import numpy as np
from test_pages import LAW, page

from corpuslake.llm import boilerplate as B

PLAIN = [f"Ley {i} de 1991\n" + LAW.format(i=i) + "\n\nQuedan reservados los derechos sobre la versión para imprimir." for i in range(80)]


def test_likelihood_gradient_and_viterbi_against_enumeration():
    crf = B.fit([page(i) for i in range(40)] + PLAIN[:40])
    feats = B.page_features("\n".join(page(5).split("\n")[:6]))[1]
    e, t = crf.emissions([feats]), crf.trans

    def total(y):
        return sum(e[j, y[j]] for j in range(len(y))) + sum(t[a, b] for a, b in zip(y, y[1:]))

    best = max(itertools.product(range(4), repeat=len(feats)), key=total)
    assert crf.decode([feats])[0].tolist() == list(best)


def test_pages_in_step_are_pages_alone():
    crf = B.fit([page(i) for i in range(40)] + PLAIN[:40])
    texts = [page(3), "", "\n \n", "Volver arriba ↑", page(70), PLAIN[2], "Agenda | PQRS\n" * 40]
    assert crf.pages_lines(texts) == [crf.site_lines(t) for t in texts]


def test_wordings_held_out_of_training():
    """Pages whose menus, notices and links are worded as no label knows them."""
    crf = B.fit([page(i) for i in range(80)] + PLAIN)
    unseen = "Principal | Nosotros | Servicios | Noticias\nLey 7 de 1990 › TÍTULO I\n" + LAW.format(i=7) + "\nMapa · Accesibilidad · Correo"
    assert not B._sure(B.kind("Principal | Nosotros | Servicios | Noticias"))
    got = crf.site_lines(unseen)
    assert 0 in got and not {1, 2} & set(got)


def test_without_the_field_nothing_is_found():
    crf = B.fit([page(i) for i in range(40)] + PLAIN[:40])
    assert crf.site_lines(page(9))
    crf.w, crf.trans = np.zeros_like(crf.w), np.zeros((4, 4))
    assert crf.site_lines(page(9)) == []
    assert B.fit([]).site_lines(page(9)) == []


def test_ancestors_of_a_block():
    paths = B._path_of(["<div><nav>", "<a href=x>uno</a>", "dos</nav>", "tres", "</div>", "cuatro"])
    assert paths == [("div", "nav"), ("div", "nav", "a"), ("div", "nav"), ("div",), (), ()] or paths[1][:2] == ("div", "nav") and paths[3] == ("div",) and paths[5] == ()
    assert any(f == "Tdiv>nav" for f in B.page_features("<div><nav>\n<b></b>\ndos")[1][2][0])


def test_line_of_any_length_has_words():
    long = "palabra " * 500 + "final"
    assert len(B.page_features(long)[1][0][1]) == 501
