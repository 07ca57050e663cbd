import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.functions.stem import stem
from corpuslake.functions.tokens import tokens

# Words and stems of the sample that the algorithm's page publishes.
PAIRS = (
    "chicharrones:chicharron chicha:chich chico:chic chicos:chic chihuahua:chihuahu china:chin chinas:chin chinito:chinit "
    "chino:chin chiquitita:chiquitit chiapas:chiap torá:tor tórax:torax toreado:tor toreados:tor toreándolo:tor torear:tor "
    "toreara:tor torearlo:tor toreó:tore torero:torer toreros:torer torio:tori tormenta:torment tormentas:torment "
    "tornado:torn tornar:torn tornen:torn torneo:torne tornillo:tornill torniquete:torniquet toro:tor toronto:toront "
    "torpedearon:torped torpeza:torpez torralba:torralb torre:torr torrencial:torrencial torrente:torrent torreón:torreon "
    "torres:torr torrescano:torrescan"
).split()


@pytest.mark.parametrize("pair", PAIRS)
def test_published_stems(pair):
    word, want = pair.split(":")
    assert stem(word) == want


@pytest.mark.parametrize("word,want", [("rápidamente", "rapid"), ("posibilidad", "posibil"), ("tecnologías", "tecnolog"), ("distribuyendo", "distribu"), ("consecuencia", "consecuent"), ("declaraciones", "declar")])
def test_endings(word, want):
    assert stem(word) == want


@given(st.text(alphabet="abcdeilmnorstuyáéíóúñ", max_size=18))
@settings(max_examples=300, deadline=None)
def test_stems_only_shorten(word):
    assert len(stem(word)) <= len(word) + 3 and not set(stem(word)) & set("áéíóú")


def test_identifiers():
    got = tokens("Sentencia C-355 de 2006, T-025/04 y SU-070-13; arts. 240-1 y 1.2.1.2.1 por 1.564.000 ñandú", stems=True)
    assert got == ["sentenci", "c_355", "2006", "t_25", "2004", "y", "su_70", "2013", "arts", "240_1", "y", "1_2_1_2_1", "por", "1564000", "nandu"]
    assert tokens("") == [] and tokens("C-1") == ["c_1"] and tokens("ley 57 de 1887") == ["ley", "57", "de", "1887"]
