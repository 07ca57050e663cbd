import json

import pytest
from test_mojibake import clean

from corpuslake.llm import mojibake as M


def record(text):
    return json.dumps({"texto": text})


def test_model_counts_all_records_once(spark):
    """More records than any sample held; a record sent again, null, broken and garbled ones change nothing."""
    rows = [(f"c{i}", record(f"término señal x{i} qué")) for i in range(6_600)] + [("pagaré", record("el PAGARÉ")), ("puntos", record("indemnizar… y pagar"))]
    odd = [("null", None), (None, record("nadie")), ("broken", "{"), ("bad", record("pensiÃ³n"))]
    df = spark.createDataFrame(rows + odd + rows[:900], "chunk_id string, datos string")
    model, local = M.fit_model(df), M.fit([r for _, r in rows])
    assert model.c3["rmi"] == model.c3["señ"] == 6_600 and all(model.c3[t] for t in ("zar", "r… "))
    assert (model.c3, model.n, model.margin) == (local.c3, local.n, local.margin) and model.margin > M.MIN_MARGIN
    again = M.fit_model(df.repartition(7))
    assert (again.c3, again.margin) == (model.c3, model.margin)


@pytest.mark.parametrize("at", range(5))
def test_every_clean_token_can_set_the_margin(at):
    values = clean() + [record("el PAGARÉ")] * 10
    values.insert(at, record("la ley dispuso indemnizar… y además"))
    assert M.fit(values).margin > M.MIN_MARGIN


@pytest.mark.parametrize("at", range(5))
def test_garbled_token_among_clean_ones_sets_no_margin(at):
    values = clean()
    values.insert(at, record("la entidad podr· apelar"))
    model = M.fit(values)
    assert model.margin == M.fit(clean()).margin and model.repair("ningún año podr·")[0] == "ningún año podrá"


def test_recall_over_all_words(spark):
    df = spark.createDataFrame([(f"c{i}", d) for i, d in enumerate(clean(40))], "chunk_id string, datos string")
    assert M.recall(df) == pytest.approx(M.fit(clean(40)).recall) and M.recall(df.limit(0)) == 0.0
