"""Gates over hand-made texts with the expected decision, reason and terms."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import text_gates as G
from newsloom.operators.related import related

AGENCY = [
    ("Measles in Türkiye", None, (True, "turkiye", ["türkiye"])), ("Ankara and Gaza", "", (True, "turkiye", ["ankara"])), ("Aid reaches Gaza", "Palestinian families in GAZA", (True, "muslim_geography", ["gaza", "palestinian"])), ("Gazan stories", "", (False, "no_audience_fit", [])),
    ("New guidelines on salt and Sugar", None, (True, "public_health_rules", ["guidelines", "salt", "sugar"])), ("Outbreak of cholera", "landmark, historic, worldwide", (True, "world_wow", ["landmark", "historic", "worldwide"])), ("Global alert", "An outbreak", (False, "no_audience_fit", [])),
    (None, None, (False, "no_audience_fit", [])), ("saltwater", "sugary", (False, "no_audience_fit", [])), ("Cox's Bazar camp", None, (True, "muslim_geography", ["cox's bazar"])), ("First-ever vaccine", None, (True, "world_wow", ["first-ever"])),
]
TIERS = [
    ("", "", ("out", "empty", [])), (None, None, ("out", "empty", [])), ("2026-YDUS sonuçları", "staj", ("out", "ydus_title", ["ydus"])), ("Uzmanlık Dalı Değişikliği", "", ("out", "specialty_change_title", ["uzmanlik dali degisikligi"])), ("STS Tıp Doktorluğu kılavuzu", "TUS", ("C", "foreign_licensure_title", ["sts tip doktorlugu"])),
    ("Asistan  Nakil ilanı", "TUS", ("out", "assistant_title", ["asistan nakil"])), ("USMLE Step 1", "dates", ("C", "foreign_licensure", ["usmle"])), ("USMLE and TUS", "", ("A", "student_agenda", ["tus"])), ("Öğretim Üyesi Alımı", "", ("out", "non_student_cadre", ["ogretim uyesi alim"])), ("Öğretim Üyesi Alım ve staj", "", ("A", "student_agenda", ["staj"])),
    ("Mecburi hizmet kurası", "", ("B", "intern_context", ["mecburi hizmet"])), ("İntörn ücretleri", "", ("B", "intern_context", ["intorn ucret"])), ("Akademik Takvim", "", ("A", "student_agenda", ["akademik takvim"])), ("TÜSEB çağrısı", "", ("out", "no_student_signal", [])), ("Burs duyurusu", "", ("A", "student_agenda", ["burs"])), ("Bursa Uludağ", "", ("out", "no_student_signal", [])),
    ("Tıpta Uzmanlık Sınavı", "", ("A", "student_agenda", ["tipta uzmanlik sinavi"])), ("İhale duyurusu", "personel alımı", ("out", "admin_noise", ["ihale", "personel alimi"])), ("Haber", "bir şey", ("out", "no_student_signal", [])),
]
RELEVANT = [("Sağlık Bakanlığı", "", ["saglik"]), ("New drug", "for patients", ["drug", "patient"]), ("Weather", "and the whom", []), ("The WHO says", None, ["who"]), ("SaÄŸlÄ±k haberleri", None, ["saglik"]), (None, None, []), ("Hémodiálisis clínica", None, ["clinic"])]


def test_agency_families(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(AGENCY)], "i int, t string, s string")
    got = df.select("i", G.family_fit(F.concat_ws(" ", "t", "s")).alias("x")).orderBy("i").select("x.*").collect()
    assert [tuple(r) for r in got] == [e for *_, e in AGENCY]


def test_student_tiers(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(TIERS)], "i int, t string, s string")
    got = df.select("i", G.student_tier(F.col("t"), F.col("s")).alias("x")).orderBy("i").select("x.*").collect()
    assert [tuple(r) for r in got] == [e for *_, e in TIERS]


def test_tier_of_a_whole_text(spark, tmp_path):
    """The end of a title and the beginning of its own text make no marker together."""
    from newsloom.plans.registry import QUERIES

    texts = ["der haus und.\nMehr", "der haus und der.\nMehr", "", "wast.", "wast que. la"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["student_tiers"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [("out", "no_student_signal"), ("A", "student_agenda"), ("out", "empty"), ("out", "non_student_cadre"), ("out", "non_student_cadre")]
    assert spark.range(1).select(G.student_tier(F.lit("akademik"), F.lit("takvim")).alias("x")).first()["x"]["reason"] == "student_agenda"


def test_relevance(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(RELEVANT)], "i int, t string, s string")
    got = df.select("i", G.relevant(F.col("t"), F.col("s")).alias("x")).orderBy("i").select("x.*").collect()
    assert [(r["relevant"], sorted(r["terms"])) for r in got] == [(bool(e), e) for *_, e in RELEVANT]


@pytest.mark.parametrize("title, cycle", [("2026-TUS 1. Dönem kılavuzu", "2026-tus 1. donem"), ("2026 – TUS  1. dönem sonuçları", "2026 – tus 1. donem"), ("2025-YÖKDİL", "2025-yokdil"), ("2026-STS Tıp Doktorluğu", "2026-sts tip doktorlugu"), ("TUS 2026", None), (None, None)])
def test_exam_cycles(spark, title, cycle):
    assert spark.createDataFrame([(title,)], "t string").select(G.exam_cycle(F.col("t")).alias("c")).first()["c"] == cycle


def test_related_by_printed_cycle(spark):
    rows = [(1, "a", "2026-TUS 1. Dönem başvuru kılavuzu yayımlandı"), (2, "a", "2026-TUS 1. Dönem: sınava giriş belgeleri"), (3, "b", "2026-TUS 2. Dönem yerleştirme"), (4, "b", "something of another kind altogether")]
    df = spark.createDataFrame(rows, "item_id long, source_id string, title string").withColumn("cycle", G.exam_cycle(F.col("title")))
    assert {(r["item_id"], r["other_id"], r["by"]) for r in related(df, cycle_col="cycle").collect()} == {(1, 2, "cycle"), (2, 1, "cycle")}
