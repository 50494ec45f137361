import json

from pyspark.sql import functions as F

from tomar.sources import readers, writers
from tomar.streaming import streams


def test_text_and_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Birinci metin", encoding="utf-8")
    (tmp_path / "etiketler.json").write_text(json.dumps({"a.txt": {"tur": "dilekce", "eksik_alanlar": []}, "b.txt": {"birim_kodu": "x"}}), encoding="utf-8")
    rows = readers.training_pairs(spark, str(tmp_path)).collect()
    assert [(r.file, r.text, r.tur) for r in rows] == [("a.txt", "Birinci metin", "dilekce")]
    try:
        readers.training_pairs(spark, "x/heldout")
        raise AssertionError
    except ValueError:
        pass


def test_json_lines_skip_what_is_no_object(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"dosya": "a", "tahmin_tur": "x", "dogru_tur": "y"}\nbozuk\n[1]\n{"dosya": "b"}\n{bad}\n', encoding="utf-8")
    assert sorted(r.dosya for r in readers.json_lines(spark, str(tmp_path / "f.jsonl")).collect()) == ["a", "b"]


def test_legislation_files(spark, tmp_path):
    (tmp_path / "yol.txt").write_text("# Başlık: Yol Tüzüğü\n# Kaynak: Örnek\n# Anahtar kelimeler: yol, bakım\n\n## Amaç\nMadde 1 uygulanır.\n## Kapsam\nMadde 2 ve madde 3.\n", encoding="utf-8")
    rows = readers.legislation(readers.text_folder(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.doc_id, r.title, r.section, r.articles, r.keywords) for r in rows] == [("yol", "Yol Tüzüğü", "Amaç", ["1"], ["yol", "bakım"]), ("yol", "Yol Tüzüğü", "Kapsam", ["2", "3"], ["yol", "bakım"])]


def test_seal_is_free_of_order(spark):
    rows = [("a", "x"), ("b", None), ("c", "y")]
    seals = {writers.seal(spark.createDataFrame(r, "file string, text string")).first().seal for r in (rows, rows[::-1])}
    assert len(seals) == 1 and seals != {writers.seal(spark.createDataFrame([("a", "z"), *rows[1:]], "file string, text string")).first().seal}


def test_html_and_xml_are_escaped(spark):
    row = spark.createDataFrame([("<b>&'\"", "metin")], "t string, s string")
    page = row.select(writers.html_report("t", {"Özet": F.col("s"), "Boş": F.lit("")}).alias("h")).first().h
    assert "&lt;b&gt;&amp;&#x27;&quot;" in page and "<h2>Boş</h2>" not in page
    xml = row.select(writers.metadata_xml(writers.metadata({"konu": F.col("t")})).alias("x")).first().x
    assert "&lt;b" in xml


def test_feedback_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"dosya": str(i), "tahmin_tur": "x", "dogru_tur": "y"}) for i in range(3)) + "\nbozuk\n", encoding="utf-8")
    streams.run_once(streams.feedback_counts(streams.json_stream(spark, str(folder))), "geri_bildirim_akisi")
    assert [(r.predicted, r.true, r.n, r.evidence) for r in spark.table("geri_bildirim_akisi").collect()] == [("x", "y", 3, "guclu")]
