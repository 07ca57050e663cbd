import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.llm import leakage as L
from corpuslake.llm import neardup as N
from corpuslake.llm import packing as P
from corpuslake.llm import residue as R
from corpuslake.llm import splitter as S
from corpuslake.llm import topn as T

# -- splitting


@given(st.text(alphabet="ab ,.\n;A", max_size=400), st.integers(1, 60), st.integers(0, 80))
@settings(max_examples=150, deadline=None)
def test_split_properties(text, limit, overlap):
    parts = S.split(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in parts) == text
    assert all(e - a <= limit for a, _, e in parts)
    used = min(overlap, limit - 1)
    if len(text) > limit:
        assert all(s - a == min(used, s) for a, s, _ in parts[1:])


def test_split_prefers_paragraphs():
    text = "Ley 1\n" + "Uno dos tres. " * 5 + "\n\n" + "Cuatro cinco. " * 5
    assert [text[s:e] for _, s, e in S.split(text, 90)] == [text[: text.index("Cuatro")], text[text.index("Cuatro") :]]


def test_pieces_table(spark):
    rows = [("a", "x", "seccion", json.dumps({"texto": "ñ. " * 50})), ("b", None, "seccion", json.dumps({"texto": "ñ" * 10})), ("c", None, None, json.dumps({"texto": "z" * 99})), ("d", None, "otro", json.dumps({"texto": "z" * 99})), ("n", None, "seccion", None), ("w", None, "seccion", json.dumps({"texto": "😀" * 11}))]
    chunks = spark.createDataFrame([(*r, 7) for r in rows * 2], "chunk_id string, articulo_id string, tipo_chunk string, datos string, parte int")
    limites = spark.createDataFrame([("seccion", 10, 2), (None, 3, 1), ("nada", None, 1)], "tipo_chunk string, max_chars int, traslape_chars int")
    got = S.distinct_pieces(chunks, limites).collect()
    assert {r.chunk_id for r in got} == {"a", "w"} == {r.chunk_id for r in S.found(chunks, limites).collect()}
    for key, text in (("a", "ñ. " * 50), ("w", "😀" * 11)):
        parts = sorted((r for r in got if r.chunk_id == key), key=lambda r: r.parte)
        assert "".join(r.texto[r.traslape :] for r in parts) == text and max(len(r.texto) for r in parts) <= 10
    assert S.found(chunks.limit(0), limites).count() == 0 and S.found(chunks, limites.limit(0)).count() == 0


# -- near duplicates


def test_second_permutation_is_a_bijection():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65521)
    y = x * N._A
    assert len(np.unique((y ^ (y >> N._SHIFT)) * N._B)) == len(np.unique(x)) and int(N._A) % 2 and int(N._B) % 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (N.signature(a, 2000) == N.signature(b, 2000)).mean()
    assert abs(same - 300 / 500) < 0.05


def jaccard(a, b, k=3):
    sh = lambda t: {tuple(w[i : i + k]) for w in [N._WORD.findall(t.lower())] for i in range(len(w) - k + 1)}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(0, 14)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
    texts += [texts[0]] * 30 + ["", "uno dos", "Uno, DOS tres", "uno dos TRES"]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], 1, 2), (999, None, 1, 2), (None, "x y z", 1, 2)]
    df = spark.createDataFrame(rows, "pasaje_id long, texto string, a int, clase int")
    got = {tuple(r) for r in N.found(df).collect()}
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2) if jaccard(x, y) >= 0.6}
    assert not got - want and len(want - got) <= 0.01 * len(want)
    assert N.found(df.limit(0)).count() == 0


def test_groups(spark):
    base = " ".join(f"p{i}" for i in range(200))
    rows = [(i, base.replace(f"p{50 + 20 * i}", "z"), f"d{i}/1") for i in range(6)] + [(9, "otro texto muy distinto", None)]
    df = spark.createDataFrame(rows, "pasaje_id long, texto string, id string")
    got = {r.pasaje_id: (r.grupo, r.enlaces, r.doc_id) for r in N.groups(df).collect()}
    assert got == {i: (0, 5, f"d{i}") for i in range(6)} | {9: (9, 0, None)}


# -- top N


def test_top_n_against_sorting(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        doc = "big" if i % 3 == 0 else f"d{rng.randrange(300)}" if i % 50 else None
        rows.append((f"{doc}/{rng.randrange(5)}" if doc else None, i, rng.choice([None, float("nan"), math.inf, -1.0, 0.1, 0.2, 0.3]), "x"))
    rows += rows[:500]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, "id string, pasaje_id long, score double, __salt string")
        got = {tuple(r) for r in T.found(df).collect()}
        wide = T.top_n(df.select("id", "pasaje_id", "score", "__salt"), ["id"], "score", ["pasaje_id"], 1)
        assert wide.columns == ["id", "pasaje_id", "score", "__salt", "rank"] and wide.count() == len({r[0] for r in rows if r[0] and r[2] is not None and r[2] == r[2]})
        assert T.found(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    groups = {}
    for key, pid, score, _ in set((a, b, "nan" if c != c else c, d) for a, b, c, d in rows):
        if key and score is not None and score != "nan":
            groups.setdefault(key.split("/")[0], []).append((-score, key, pid))
    for doc, items in groups.items():
        want |= {(doc, k, x[2]) for k, x in enumerate(sorted(items)[:3], 1)}
    assert got == want


# -- packing


@given(st.lists(st.integers(0, 50), max_size=120), st.integers(50, 90))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing(sizes, cap):
    sizes = sorted(sizes, reverse=True)
    bins = P.best_fit_decreasing(sizes, cap)
    rooms = []
    for size, b in zip(sizes, bins):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= size]
        if not fits:
            assert b == len(rooms)
            rooms.append(cap)
        else:
            assert rooms[b] == min(fits)[0]
        rooms[b] -= size


def test_bins_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, "palabra de ley " * (1 + i * 7 % 90), 1) for i in range(80)] + [(500, "ñandú " * 3000, 1), (501, None, 1), (502, "  \n", 1), (None, "x", 1), (3, "palabra de ley " * 22, 1)], "doc_id long, text string, tokens int")
    kinds = spark.createDataFrame([(1, 64), (2, 512), (3, 0), (None, 9)], "contenedor_id int, capacidad_tokens int")
    got = P.bins(docs, kinds).toPandas()
    counts = {r.doc_id: r.tokens for r in P.token_counts(docs).collect()}
    assert set(counts) == {*range(80), 500}
    for (cid, cap), part in got.groupby(["contenedor_id", "capacidad_tokens"]):
        assert part.groupby("doc_id").tokens.sum().to_dict() == counts
        fill = part.groupby(["bloque", "recipiente"]).tokens.sum()
        assert fill.max() <= cap and fill.sum() > 0.9 * cap * (len(fill) - 1)
        split = part.groupby("doc_id").size()
        assert all(counts[d] > cap for d in split[split > 1].index)
    assert P.bins(docs.limit(0), kinds).count() == 0 and P.bins(docs, kinds.limit(0)).count() == 0


# -- leaks

ITEM = "En Villaseca, el 3 de mayo de 1990, un apicultor jubilado olvidó asegurar 40 colmenas pobladas aunque existía una reserva de dominio"


def test_myers_against_table():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert L.myers(p, t, 1000) == min(row)


def test_leak_search():
    index = L.Index([(1, "pregunta", ITEM), (2, "pregunta", "muy corta")])
    words = L.words(ITEM)
    exact = "x " + " ".join(words[4:17]).upper() + " y"
    assert [(h[0], h[2], h[3]) for h in index.search(exact)] == [(1, 13, 0)]
    assert all(h[2] < 13 for h in index.search("x " + " ".join(words[4:16]) + " y"))
    assert [h[3] for h in index.search("x " + " ".join(words[:16]).replace("apicultor", "apicultar"))] == [1]
    assert index.search("") == []
    near = " ".join(words[:12]) + " otra cosa " + " ".join(words[13:18])
    assert all(h[2] < 13 for h in index.search(near))


def test_leak_table(spark):
    words = ITEM.split()
    docs = spark.createDataFrame([(1, "Ley. " + ITEM.replace(" ", "\n"), 1), (1, "Ley. " + ITEM, 1), (2, None, 1), (3, "", 1), (4, " ".join(words[:12]), 1), (5, "relleno " * 30_000 + ITEM.lower(), 1), (None, ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, None), (8, None, ITEM), (9, None, None), (None, ITEM, ITEM)], "id long, pregunta string, respuesta_esperada string")
    want = {(d, i) for d in (1, 5) for i in (7, 8)}
    assert {tuple(r) for r in L.found(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in L.leaks(docs, items, block=1).collect() if r.palabras >= 13} == want
    assert L.found(docs.limit(0), items).count() == 0 and L.found(docs, items.limit(0)).count() == 0


# -- residue


def legal(i):
    return f"Ley {i} de 1990\n" + " ".join(f"El fondo {i + k} podrá autorizar con cargo al presupuesto la garantía mensual del comité en los términos del artículo {k}." for k in range(9))


@pytest.fixture(scope="module")
def texts():
    out = [legal(i) for i in range(150)]
    out += [legal(i).replace("mensual", slot, 1) for i, slot in enumerate(["{{cedula}}", "${fecha}", "@@apoderado@@", "<<cedula>>", "__fecha__", "{cedula}", "[FECHA]", "%APODERADO%", "«cedula»"] * 5)]
    out += [f"HTTP 404 – Not Found\nThe requested resource /doc/{i} could not be found on this server." for i in range(8)]
    out += ["Lorem ipsum dolor sit amet. Magna aliqua lorem ipsum enim veniam.", "Este sitio requiere JavaScript. Habilítelo en su navegador."] * 6
    out += [legal(i) + " La plantilla del contrato contenía el campo «nombre del demandante», que fue diligenciado por el notario." for i in range(12)]
    out += [legal(i) + " La Sala observa que el portal mostró el mensaje «Error 404» y ello no exonera a la entidad." for i in range(12)]
    return out


def test_residue(spark, texts):
    rows = [(i, t, 1) for i, t in enumerate(texts)] * 2 + [(900, None, 1), (901, "  ", 1), (902, "", 1), (None, "{{x}}", 1), (903, legal(3) * 60 + " ${fecha}", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ranuras int")
    got = {r.doc_id for r in R.found(df).collect()}
    want = {i for i, t in enumerate(texts) if 150 <= i < 195 + 8 + 12} | {903}
    assert got == want
    assert R.found(df.limit(0)).count() == 0


def test_bayes_without_trusted():
    model = R.PuBayes()
    model.fit([["a"], ["b"]], [False, False], [False, False])
    assert model.score(["a"]) == -math.inf


def test_rebuilt_and_room(spark):
    rows = [("a", "x", "seccion", json.dumps({"texto": "ñ. " * 50})), ("w", None, "seccion", json.dumps({"texto": "😀" * 11}))]
    chunks = spark.createDataFrame(rows * 2, "chunk_id string, articulo_id string, tipo_chunk string, datos string")
    limites = spark.createDataFrame([("seccion", 10, 7)], "tipo_chunk string, max_chars int, traslape_chars int")
    got = {r.chunk_id: r for r in S.rebuilt(chunks, limites).collect()}
    assert (got["a"].letras, got["w"].letras) == (150, 11) and got["a"].bajo_limite and got["w"].bajo_limite
    docs = spark.createDataFrame([(i, "palabra de ley " * (1 + i * 7 % 90)) for i in range(300)], "doc_id long, text string")
    kinds = spark.createDataFrame([(1, 512)], "contenedor_id int, capacidad_tokens int")
    row = P.room(docs, kinds).first()
    assert row.documentos == 300 and 0 <= row.libre < 0.02
