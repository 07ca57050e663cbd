import pytest
from test_algorithms import legal, texts  # noqa: F401

from corpuslake.llm import residue as R


@pytest.fixture(scope="module")
def model(texts):  # noqa: F811
    return R.fit(texts)


@pytest.mark.parametrize(
    "slot", ["{{" + "numero de cedula " * 5 + "}}", "[INSERTAR " + "el nombre del apoderado " * 4 + "]", "[NOMBRE DEL REPRESENTANTE LEGAL DE LA ENTIDAD CONTRATANTE]", "[FECHA]", "«cedula»"]
)
def test_slot_of_any_length(model, slot):
    assert [span for span, _, _ in R.spots(f"el señor {slot} pagará")] == [slot]
    assert model.judge(legal(3).replace("mensual", slot, 1))[0] == 1


def test_model_decides(texts):  # noqa: F811
    blank = R.Residue()
    assert all(blank.judge(t) == (0, 0.0) for t in texts)


def test_round_brackets_are_judged_by_what_they_hold():
    names = ("cedula", "ciudad", "cuantia", "apoderado")
    base = [legal(i).replace("mensual", "{{%s}}" % names[i % 4], 1) for i in range(400)] + [legal(i) + " (folio 31)." for i in range(600)]
    base += [legal(i).replace("mensual", f"(escriba {names[i % 4]})", 1) for i in range(4)]
    model = R.fit(base)
    assert model.judge(legal(1).replace("mensual", "(escriba cedula)", 1))[0] == 1
    assert model.judge(legal(1) + " (folio 77).")[0] == 0
