import json
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import arms as A
from corpuslake.operators import search as S
from corpuslake.plans.retrieval import arm_metrics

NORMS = "coalesce(tipo_documento, '') <> 'sentencia'"
ARMS = {"palabras": A.Arm(), "raices": A.Arm(stems=True), "normas": A.Arm(where=NORMS)}


def _chunks(spark):
    r = random.Random(5)
    words = "el la de plazo plazos cuota cuotas fondo garantía garantías juez jueces norma normas 1.564 C-355 de 2006".split()
    rows = []
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        kind = [{}, {"tipo_documento": "sentencia"}, {"tipo_documento": "ley"}, {"tipo_documento": 7}][i % 4]
        rows.append((f"c{i:03}", json.dumps({"texto": text} | kind)))
    rows += [rows[3], rows[4], ("roto", "{"), ("lista", "[]"), ("vacío", '{"texto": null}'), (None, '{"texto": "plazo"}'), ("sin", None)]
    return spark.createDataFrame(rows, "id string, text string").repartition(5)


def _asked(spark):
    rows = [(1, "el plazo de la cuota"), (2, "plazos, plazos y garantías del juez"), (3, "sentencia C-355 de 2006"), (4, "nada más"), (5, None), (None, "plazo"), (2, "fondo")]
    return spark.createDataFrame(rows, "qid long, text string")


@pytest.mark.parametrize("small", [False, True])
def test_arms_give_the_lists_of_single_searches(spark, monkeypatch, small):
    if small:  # many blocks in a task, many groups of questions
        monkeypatch.setattr(A, "CELLS", 12)
        monkeypatch.setattr(S, "ONLY_TERMS", 3)
    rows = _chunks(spark)
    got = {tuple(x) for x in A.search(_asked(spark), S.Corpus(rows, fields=("tipo_documento",)), ARMS, 7).select("arm", "qid", "id", "score", "rank").collect()}
    norms = rows.where(F.coalesce(F.get_json_object("text", "$.tipo_documento"), F.lit("")) != "sentencia")
    monkeypatch.undo()
    for name, corpus in (("palabras", S.Corpus(rows, fields=())), ("raices", S.Corpus(rows, stems=True, fields=())), ("normas", S.Corpus(norms, fields=()))):
        want = {(name, *x) for x in S.bm25(_asked(spark), corpus, 7).select("qid", "id", "score", "rank").collect()}
        assert len(want) > 14 and {x for x in got if x[0] == name} == want


def test_arms_without_questions_or_texts(spark):
    rows, none = _chunks(spark), _asked(spark).where("qid > 9")
    assert A.search(none, S.Corpus(rows, fields=("tipo_documento",)), ARMS, 7).collect() == []
    assert A.search(_asked(spark), S.Corpus(rows.where("id = '-'"), fields=("tipo_documento",)), ARMS, 7).collect() == []


def test_no_score_of_every_question_and_text_is_shuffled(spark, tmp_path):
    questions, texts = 60, 500
    datos = [json.dumps({"texto": f"el plazo de la norma {i % 50}", "articulo": str(i % 60), "titulo": "Ley"}) for i in range(texts)]
    rows = [(f"d/{i:03}", "d", f"d/art_{i % 60}", None, "articulo", x) for i, x in enumerate(datos)]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, articulo_id string, seccion_id string, tipo_chunk string, datos string").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [(i, f"el plazo de la norma {i}", f"Ley, artículo {i}") for i in range(questions)]
    spark.createDataFrame(asked, "id long, pregunta string, legal_basis string").write.parquet(f"{tmp_path}/preguntas.parquet")
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    got = arm_metrics(spark, str(tmp_path)).collect()
    assert [(r.brazo, r.preguntas) for r in got] == [("bm25", 60), ("bm25_raices", 60), ("bm25_normas", 60)]
    assert max(n for s, n in written().items() if s not in before) < questions * texts / 3
