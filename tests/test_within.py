from pyspark.sql import functions as F

from corpuslake.operators import search as S


def test_crowded_document_hides_no_other(spark):
    rows = [(f"grande/{i:03}", "plazo plazo") for i in range(130)]
    rows += [("otro/a", "plazo de la cuota del fondo"), ("otro/b", "plazo de la cuota del fondo municipal"), ("otro/c", "plazo de la cuota del fondo municipal y de su garantía"), ("ajeno/a", "garantía")]
    docs = S.documents(spark.createDataFrame(rows, "chunk_id string, texto string"))
    asked = spark.createDataFrame([(1, "plazo")], "qid long, text string")
    assert not [r for r in S.bm25(asked, docs, 100).collect() if r.id.startswith("otro/")]
    got = S.bm25_within(asked, docs, F.substring_index("id", "/", 1), 2).collect()
    assert sorted((r.doc_id, r.id, r.n) for r in got) == [("grande", "grande/000", 1), ("grande", "grande/001", 2), ("otro", "otro/a", 1), ("otro", "otro/b", 2)]
