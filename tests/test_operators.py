import math

import pytest
from pyspark.sql import functions as F

from tomar.operators import classify as C
from tomar.operators import extract as X
from tomar.operators import mask as K
from tomar.operators import metrics as M
from tomar.operators import naive_bayes as N
from tomar.operators import register as G
from tomar.operators import relations as R
from tomar.operators import retrieval as V
from tomar.operators import summary as S
from tomar.operators.components import connected_components


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "sulama kanalı onarım"), (2, "yol onarım"), (3, None), (4, "")], "id long, text string")
    ix = V.index(docs)
    once, twice = (V.bm25(V.query_terms(spark.createDataFrame([(9, q)], "qid long, text string")), ix).where("id = 1").first().score for q in ("sulama", "sulama sulama"))
    assert twice == pytest.approx(2 * once) and once > 0
    size = ix.size.first()
    assert (size.n, size.avgdl) == (4, 1.25)


def test_rrf_of_one_list_keeps_its_order(spark):
    lists = spark.createDataFrame([(1, "a", i, i) for i in range(1, 6)], "qid long, list string, id long, rank int")
    assert [r.id for r in V.top(V.rrf(lists), 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_convex_passes_a_list_alone(spark):
    a = spark.createDataFrame([(1, 5, 2.0), (1, 6, 1.0)], "qid long, id long, score double")
    none = a.limit(0)
    assert sorted((r.id, r.score) for r in V.convex(a, none).collect()) == [(5, 1.0), (6, 0.5)]


def test_precedents_leave_out_the_own_record(spark):
    rows = [(1, "a.txt", "sulama kanalı onarım işi"), (2, "a.txt", "sulama kanalı onarım"), (3, "b.txt", "sulama kanalı bakım"), (4, "", "sulama kanalı yenileme"), (5, None, "park")]
    register = spark.createDataFrame(rows, "id long, source string, text string")
    query = register.where("id = 1").select(F.col("id").alias("qid"), "source", "text")
    assert {r.id for r in V.precedents(query, register).collect()} == {3, 4}


def test_naive_bayes_learns_and_falls_back_to_the_prior(spark):
    rows = [(1, "dilekçe arz ederim", "d"), (2, "dilekçe başvuru", "d"), (3, "rapor inceleme sonucu", "r"), (4, None, "r"), (5, "metin", None)]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    model = N.train(docs)
    asked = spark.createDataFrame([(1, "başvuru dilekçe"), (2, "inceleme rapor"), (3, "qqq www"), (4, "")], "id long, text string")
    found = {r.id: r for r in N.decided(N.predict(model, asked)).collect()}
    assert (found[1]["class"], found[2]["class"]) == ("d", "r")
    assert found[3].probability == pytest.approx(2 / 3) == found[4].probability


def test_conformal_threshold_index(spark):
    scores = spark.createDataFrame([(i / 10,) for i in range(1, 10)], "score double")
    assert M.conformal_threshold(scores, 0.1).first().threshold == 0.9
    assert M.conformal_threshold(scores.limit(3), 0.1).first().threshold == 1.0
    assert M.conformal_threshold(scores.limit(0), 0.1).first().threshold == 1.0


def test_softmax_keeps_the_order_at_any_temperature(spark):
    row = spark.range(1).select(F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(1.0)).alias("m"))
    for t in (0.25, 1.0, 5.0):
        m = row.select(M.softmax("m", t).alias("p")).first().p
        assert m["a"] > m["b"] and sum(m.values()) == pytest.approx(1)


def test_risk_coverage_ties_and_ranges(spark):
    rows = spark.createDataFrame([(1, 0.9, True), (2, 0.9, False), (3, 0.1, True), (4, 1.0, True)], "id long, conf double, ok boolean")
    got = {r["rank"]: round(r.risk, 4) for r in M.risk_coverage(rows).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.3333, 4: 0.25}


def test_averages_of_nothing_are_null(spark):
    none = spark.createDataFrame([], "truth string, predicted string, conf double, ok boolean, id long")
    assert M.accuracy(none).first().accuracy is None and M.brier(none).first().brier is None and M.aurc(none).first().aurc is None


def test_mcnemar_and_wilson(spark):
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True)], "a boolean, b boolean")
    r = M.mcnemar(pairs)
    assert r["chi2"] == pytest.approx(4.0) and r["p"] == pytest.approx(math.erfc(math.sqrt(2)))
    w = spark.range(1).select(M.wilson(F.lit(8), F.lit(10)).alias("w")).first().w
    assert (round(w.low, 3), round(w.high, 3)) == (0.49, 0.943)


def test_components_are_safe_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (7, 7), (None, 4), (10, 6), (1, 2)], "src long, dst long")
    got = {(r.node, r.component) for r in connected_components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (10, 5)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert connected_components(chain).select("component").distinct().count() == 1
    assert connected_components(edges.limit(0)).count() == 0


def test_register_queries(spark):
    row = dict.fromkeys(G.COLUMNS)
    rows = [tuple((row | {"id": i, "tur": "dilekce" if i % 2 else "rapor", "ozet_ilk_200": "yüzde 50% %" if i == 3 else "x", "insan_onayi": i % 2}).values()) for i in range(1, 8)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in G.COLUMNS.items()))
    assert [r.id for r in G.query(frame, tur="dilekce", limit=2).collect()] == [7, 5]
    assert [r.id for r in G.query(frame, text="50%").collect()] == [3]
    assert (G.clamped(0), G.clamped(10_000), G.clamped("x"), G.clamped(None)) == (1, 500, 50, 50)
    assert {(r.alan, r.deger, r.n) for r in G.distribution(frame, "tur", "birim").collect()} == {("tur", "dilekce", 4), ("tur", "rapor", 3)}


def test_register_takes_broken_records(spark, tmp_path):
    broken = spark.createDataFrame([("a",), ("b",)], "hepsi string")
    assert G.flattened(broken).count() == 2
    path = str(tmp_path / "register")
    G.append(G.flattened(broken), path)
    G.append(G.flattened(broken), path)
    ids = [r.id for r in spark.read.parquet(path).collect()]
    assert len(ids) == len(set(ids)) == 4


def test_relation_chains(spark):
    rows = [
        (1, "E-123-456", [], "yol bakım işi", ["Akçova Belediye Başkanlığı"]), (2, "E-999-1", ["05.01.2024 tarihli ve E-123-456 sayılı yazı"], "başka", ["X Kurumu"]),
        (3, None, None, "yol bakım işi", ["Akçova Belediye Başkanlığına"]), (4, "2024", None, None, None), (5, "E-777-1", ["2024"], "tek", []),
    ]
    docs = spark.createDataFrame(rows, "id long, number string, refs array<string>, subject string, parties array<string>")
    assert {(r.src, r.dst) for r in R.references(docs).collect()} == {(1, 2)}
    assert {(r.id, r.chain, r.kind) for r in R.chains(docs).collect()} == {(1, 1, "ilgi_referansi"), (2, 1, "ilgi_referansi"), (3, 1, "ilgi_referansi")}
    assert {r.id for r in R.unlinked(docs, R.chains(docs)).collect()} >= {4, 5}


def test_extraction_and_masks(spark):
    text = "Sayı : E-12345678-100.01-55\nKonu : Yol bakımı\nTarih : 05.03.2024\n\nÖrnek a.b@kurum.example ve TR33 0006 1005 1978 6457 8413 26, kimlik 10000000146, tel 0555 123 45 67, 1.500,00 TL."
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    f = row.select(X.fields("t").alias("f"), K.masked("t").alias("m"), K.audit(K.masked("t")).alias("a")).collect()
    assert f[0].f.evrak_sayisi == "E-12345678-100.01-55" and f[0].f.konu == "Yol bakımı" and str(f[0].f.evrak_tarihi) == "2024-03-05"
    assert f[0].f.kimlik_numaralari == ["10000000146"] and f[0].f.tutarlar == ["1.500,00 TL"]
    assert "a***@kurum.example" in f[0].m and "10000000146" not in f[0].m and sum(f[0].a[k] for k in ("iban", "telefon", "on_bir_hane")) == 0
    assert f[1].m is None and f[1].f.konu is None and f[2].m == ""


def test_line_fields(spark):
    text = "T.C.\nAkçova Belediyesi\n\nMetin burada.\n\nAyşe Yılmaz\nMüdür\n\nDAĞITIM:\nPark Müdürlüğü\nFen İşleri, Zabıta\n"
    assert X.bodies_of(text) == ["Akçova Belediyesi", "Park Müdürlüğü"] and X.signers_of(text) == ["Ayşe Yılmaz"]
    assert X.distribution_of(text) == ["Park Müdürlüğü", "Fen İşleri", "Zabıta"]


def test_summaries_keep_order_and_facts(spark):
    text = "Toplantı 12.03.2024 tarihinde belediye binasında yapılmıştır. Hava güzeldi ve herkes memnundu doğrusu. Kurul 3.500,00 TL ödeneğin yol bakımına ayrılmasına karar vermiştir. Katılanlara teşekkür edilmiştir bugün burada."
    docs = spark.createDataFrame([(1, text, "yol bakım"), (2, "", None), (3, None, None)], "id long, text string, subject string")
    got = {r.id: r.summary for r in S.summaries(docs).collect()}
    parts = [text.index(x) for x in got[1].rstrip(".").split(". ")]
    assert len(parts) == 2 and parts == sorted(parts) and parts[0] == 0 and got[2] == "" == got[3]


def test_rules_and_nearest(spark):
    row = spark.createDataFrame([("Dilekçe arz ederim",), ("hiç",)], "t string").select(C.keyword_scores("t", {"a": {"dilekçe": 2.0}, "b": {"rapor": 1.0}}).alias("m"))
    assert [(r.d["class"], r.d.confidence) for r in row.select(C.decided("m", "diger").alias("d")).collect()] == [("a", 0.731), ("diger", 0.1)]
    q = spark.createDataFrame([("acbd",), ("zzzz",)], "q string")
    c = spark.createDataFrame([("abcd",), ("xyzt",)], "c string")
    assert [(r.q, r.candidate, r.similarity) for r in C.nearest(q, c).collect()] == [("acbd", "abcd", 0.75)]


def test_nearest_units_compares_all_spellings_whatever_their_counts(spark, tmp_path):
    from tomar.functions.sequential import osa_similarity
    from tomar.plans.documents import QUERIES

    counts = {"Fen İşleri": 40, "Fen İşler": 15, "Fen İşlri": 12, "Yazı İşleri": 1, "Park": 30, "": 5}
    spark.createDataFrame([(u,) for u, n in counts.items() for _ in range(n)], "birim string").write.parquet(f"{tmp_path}/islemler.parquet")
    got = {(r.q, r.candidate, r.similarity) for r in QUERIES["nearest_units"](spark, str(tmp_path)).collect()}
    units = [u for u in counts if u]
    pairs = spark.createDataFrame([(q, c) for q in units for c in units if q != c], "q string, c string").select("q", "c", osa_similarity("q", "c").alias("s")).where("s >= 0.75").collect()
    best = {q: min((-r.s, r.c) for r in pairs if r.q == q) for q in {r.q for r in pairs}}
    assert got == {(q, c, round(-s, 6)) for q, (s, c) in best.items()} and len(got) >= 3


def test_naive_bayes_over_all_documents_against_brute_force(spark, tmp_path):
    from collections import Counter

    from tomar.functions.text import features
    from tomar.plans.documents import QUERIES

    rows = [(1, "dilekçe arz ederim", "d", "tr"), (2, "dilekçe başvuru", "d", None), (3, "rapor inceleme", "r", "az"), (4, "inceleme arz", "r", "Türkçe"), (5, "başvuru arz", None, "tr"), (6, None, "d", "tr"), (7, "", "r", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, evrak_turu string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet").where("text <> ''").select("doc_id", features(F.col("text")).alias("f"))
    tf = {r.doc_id: Counter(r.f) for r in table.collect()}
    labels = {i: c for i, t, c, _ in rows if t and c}
    df = Counter(f for i in labels for f in tf[i])
    idf = {f: math.log((len(labels) + 1) / (n + 1)) + 1 for f, n in df.items()}
    weigh = lambda i: {f: (1 + math.log(n)) * idf[f] for f, n in tf.get(i, {}).items() if f in idf}
    model = {}
    for c in ("d", "r"):
        w = Counter()
        for i in labels:
            if labels[i] == c:
                w.update(weigh(i))
        below = sum(w.values()) + len(idf)
        model[c] = (math.log(sum(x == c for x in labels.values()) / len(labels)), math.log(1 / below), lambda f, w=w, b=below: math.log((w[f] + 1) / b))
    want = {}
    for i, *_ in rows:
        own = weigh(i)
        score = {c: p + (N.EVIDENCE * sum(x * ll(f) for f, x in own.items()) / sum(own.values()) if own else 0) for c, (p, _, ll) in model.items()}
        below = sum(math.exp(x) for x in score.values())
        want |= {(i, c): math.exp(x) / below for c, x in score.items()}
    got = {(r.id, r["class"]): r.probability for r in QUERIES["nb_predict_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    prior = {r["class"]: (r.log_prior, r.unseen) for r in QUERIES["nb_prior_all"](spark, str(tmp_path)).collect()}
    assert prior == {c: pytest.approx((p, u), abs=1e-6) for c, (p, u, _) in model.items()}


def test_order_components_of_all_line_items_against_brute_force(spark, tmp_path):
    import random

    from tomar.plans.documents import QUERIES

    rng = random.Random(7)
    items = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 51))) for _ in range(70)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    group = {}
    for o, p, _ in items:
        a, b = group.get(o * 2, {o * 2}), group.get(p * 2 + 1, {p * 2 + 1})
        group |= dict.fromkeys(a | b, a | b)
    want = {(min(g), len(g)) for g in group.values()}
    assert {(r.component, r.n) for r in QUERIES["order_components_all"](spark, str(tmp_path)).collect()} == want and len(want) > 2


def test_precedents_are_those_of_all_pairs_in_any_number_of_blocks(spark):
    import random

    draw = random.Random(7)
    words = [f"kelime{i}" for i in range(40)]
    rows = [(i, draw.choice(["", "a", "b", "c", "d", "e", None]), " ".join(draw.choices(words, weights=range(1, 41), k=draw.randint(0, 9))) or None) for i in range(300)]
    register = spark.createDataFrame(rows, "id long, source string, text string").repartition(3)
    queries = register.where("id % 7 = 0").select(F.col("id").alias("qid"), "source", "text")
    ix, terms = V.index(register, idf=V.idf_precedent), V.query_terms(queries)
    pairs = V.saturated(V.bm25(terms, ix), terms, ix, F.ln(1 + (F.col("n") + 1) / 0.5)).where(F.col("similarity") >= V.LEAST_SIMILARITY)
    text = {i: (s, t) for i, s, t in rows}
    best: dict = {}
    for r in pairs.collect():
        (s, t), (qs, qt) = text[r.id], text[r.qid]
        if t != qt and not (s and s == qs):
            own = best.setdefault(r.qid, {})
            own[s or f"#{r.id}"] = min(own.get(s or f"#{r.id}", (0, 0)), (-r.similarity, r.id))
    expected = {(q, i) for q, own in best.items() for _, i in sorted(own.values())[:3]}
    for block in (5, 1000):
        found = V.precedents(queries, register, block=block)
        assert {(r.qid, r.id) for r in found.collect()} == expected


def test_naive_bayes_shuffles_no_row_of_a_document_and_a_feature(spark):
    texts = ["sulama kanalı bakım bedeli", "yol yapım işi ihale ihale", "park bakım işi", "sulama kanalı ihale yol"]
    docs = spark.createDataFrame([(i % 30, f"{texts[i % 4]} sayı{i}", "abc"[i % 3]) for i in range(40)], "id long, text string, label string").repartition(3)
    model = N.train(docs)
    whole = {(r.id, r["class"]): r.probability for r in N.predict(model, docs, hot=10**6).collect()}
    split = {(r.id, r["class"]): r.probability for r in N.predict(model, docs, hot=20).collect()}
    none = {(r.id, r["class"]): r.probability for r in N.predict(model, docs, hot=0).collect()}
    assert len(whole) == 90 and whole == pytest.approx(split) and whole == pytest.approx(none)


def _related(spark):
    import random

    draw = random.Random(3)
    subjects = ["fidan dikim sahası taşıma işi", "fidan dikim sahası kabul işi", "fidan dikim sahası ihale", "yol yapım işi", "yol yapım kabul", "park"]
    parties = ["Kumlu Devlet Hastanesi", "Taşlı Devlet Hastanesi", "Kumlu Tapu Müdürlüğü", "Öğretmenevi", "Kumlu Öğretmenevi", "Taşlı Ticaret Odası", "Derebel Ticaret Borsası"]
    rows = [(i, None, [], draw.choice([*subjects, None]), draw.sample(parties, draw.randint(0, 2))) for i in range(120)]
    return spark.createDataFrame(rows, "id long, number string, refs array<string>, subject string, parties array<string>").repartition(3), rows


def test_subject_counts_are_those_of_all_pairs_in_cells_of_any_size(spark):
    from collections import Counter

    docs, rows = _related(spark)
    split = lambda t: tuple(sorted({w for w in (t or "").translate(str.maketrans("İI", "iı")).lower().split() if w != "de"}))
    heads: dict = {}
    expected: Counter = Counter()
    for i, _, _, s, p in rows:
        if split(s) and p:
            head = heads.setdefault((split(s), frozenset(map(split, p))), i)
            expected[head] += head != i
    share = lambda a, b: len({*a} & {*b})
    for (s, p), i in heads.items():
        for (t, q), j in heads.items():
            if i < j and share(s, t) / len({*s, *t}) >= 0.5 and any(share(u, v) / min(len(u), len(v)) >= 0.6 for u in p for v in q):
                expected[i] += 1
    expected = {k: n for k, n in expected.items() if n}
    for block in (3, 4000):
        assert {r.src: r.n for r in R.similar_counts(docs, block=block).collect()} == expected
    assert Counter(r.src for r in R.similar_subjects(docs, block=3).collect()) == expected


def test_links_hold_the_components_of_all_pairs_with_fewer_rows(spark):
    docs, _ = _related(spark)
    parts = lambda df: {(r.node, r.component) for r in connected_components(df).collect()}
    pairs, links = R.similar_subjects(docs), R.similar_links(docs)
    assert parts(pairs) == parts(links) and links.count() < pairs.count()


def test_documents_without_links_are_those_of_no_pair(spark):
    docs, _ = _related(spark)
    linked = {x for r in R.similar_subjects(docs).collect() for x in (r.src, r.dst)}
    chains = R.chains(docs)
    assert not [r for r in chains.collect() if r.id not in linked]
    assert {r.id for r in R.unlinked(docs, chains).collect()} == set(range(120)) - linked
    assert R.similar_links(docs, block=3).count() < R.similar_subjects(docs, block=3).count()


def test_naive_bayes_predicts_for_documents_beyond_the_training_rows(spark):
    docs = spark.createDataFrame([(1, "dilekçe arz ederim", "d"), (2, "rapor inceleme", "r"), (3, "rapor sonucu", "r"), (4, "yeni bilinmeyen rapor", None), (5, None, None), (6, "", "d")], "id long, text string, label string")
    found = {(r.id, r["class"]): r.probability for r in N.predict(N.train(docs.where("text <> '' and label is not null")), docs, hot=2).collect()}
    assert len(found) == 12 and found[4, "r"] > found[4, "d"]
    assert found[5, "r"] == found[6, "r"] == pytest.approx(2 / 3)


def test_naive_bayes_tokenises_in_the_batch_as_the_column_does(spark):
    import pyarrow as pa

    from tomar.functions.text import STOP_WORDS, tokens
    from tomar.operators import featured

    texts = ["İHALE Işık IĞDIR ÇÖÜŞĞ 12.05.2024 a b2 ve Ve", "bir ve bu", "", "\u212aumlu çay\u0131 g\u0308 e\u0301 İ\u0307z ΑΣ x", None, "BİR ŞU o İLE kâğıt-kalem"]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i").select(tokens(F.coalesce("s", F.lit(""))).alias("t")).collect()]
    assert [[t for t in featured.tokenised(s or "") if t not in STOP_WORDS] for s in texts] == want
    assert not list(featured._counts(pa.array(["bir ve bu", None, ""]), featured.Numbered()))


def test_the_pipeline_searches_and_summarises_where_the_text_is(spark):
    from tomar.operators import summary as S
    from tomar.plans import pipeline as P

    laws = spark.createDataFrame([(1, "A", "sulama kanalı bakım bedeli"), (2, "A", "sulama birliği"), (3, "B", "sulama kanalı bakım bedeli"), (4, "C", "yol yapım"), (5, None, "park bakım işi")], "id long, doc_id string, text string")
    texts = ["Konu: sulama kanalı\nBakım bedeli İSTENDİ. Sulama kanalı 12.05.2024 günü temizlendi (tutanak). Ayrıca, 3 park bakım işi yapıldı; yol yapım sürüyor. Liste şudur:", "hiçbir şey bilinmeyen bir metin burada durur, noktasız", "kısa", "", None, "Yol yapım ve yol yapım işi. " * 7]
    docs = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "id long, source string, text string")
    ready = P.extracted(P.gated(P.capped(docs)))
    found = {r.id: r.matches for r in P.cited(laws)(ready).collect()}
    assert found == {r.id: r.matches for r in P.cited(laws, most=0)(ready).collect()} and [m.doc_id for m in found[0]][:2] == ["A", "B"] and found[3] is None
    rows = {r.id: r.summary for r in P.summarised(ready).collect()}
    want = S.summaries(ready.where("readable").select("id", "text", F.col("fields.konu").alias("subject")))
    assert {i: s for i, s in rows.items() if s is not None} == {r.id: r.summary for r in want.collect()} and rows[1] and rows[2] is None
    plan = P.pipeline([P.capped, P.gated, P.classified({"d": {"yol": 1.0}}), P.extracted, P.cited(laws), P.summarised, P.anonymised, P.registered])(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
