"""Gates that read text: which words are in a title and summary decides, and the words found are given with the decision.

The standing tables are fixed values; callers may pass tables of their own. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import repaired
from ..functions.unicode import nfkd_fold

Families = Sequence[tuple[str, Sequence[str]]]

#: Whom a health agency's item addresses; families in order, each word or shape between word borders.
AGENCY_FAMILIES: Families = (
    ("turkiye", ("turkey", "t[uü]rkiye", "turkish", "ankara", "istanbul", "izmir")),
    ("muslim_geography", (
        "gaza", r"palestin\w*", "west bank", "occupied palestinian", r"syria\w*", r"yemen\w*", r"sudan\w*", "afghanistan", r"afghan\w*", r"iraq\w*", "lebanon", "lebanese", r"iran\w*",
        r"pakistan\w*", r"bangladesh\w*", r"somalia\w*", r"libya\w*", r"jordan\w*", r"egypt\w*", r"saudi\w*", r"indonesia\w*", "rohingya", "cox.s bazar", r"azerbaijan\w*", "kosovo",
        r"bosnia\w*", r"albania\w*", "uzbekistan", "kazakhstan", r"kyrgyz\w*", "tajikistan", "turkmenistan", "hajj", "umrah", "ramadan", r"muslim\w*", "islamic", "mecca", "medina", "oic", "eastern mediterranean",
    )),
    ("public_health_rules", (
        r"guideline\w*", "guidance", r"recommend\w*", "new standards?", "international health regulations", "pandemic agreement", "framework convention", "tobacco", "air pollution", "ultra-processed",
        "sugar", "trans fat", "salt", "antimicrobial resistance", "vaccine safety", "immunization schedule",
    )),
    ("world_wow", ("first-ever", "first ever", "landmark", "historic", "worldwide", "global report", "global estimates?", "global status report", "world health statistics", "all countries", "every country", r"eradicat\w*", "declared free")),
)

#: Beginnings of words, folded, that make an item one of health.
HEALTH_WORDS = (
    "health", "medic", "clinic", "patient", "hospital", "physician", "doctor", "nurse", "surgery", "surgical", "disease", "diagnos", "therapy", "therapeutic", "treatment", "vaccin", "drug", "pharma", "biotech", "oncolog", "cancer", "cardio", "diabet", "infection", "epidemic",
    "pandemic", "outbreak", "public health", "device", "devices", "medtech", "digital health", "telehealth", "genom", "clinical trial", "regulatory approval", "fda", r"ema\b", r"who\b", r"cdc\b", r"nice\b", r"mdr\b", r"ivdr\b", r"samd\b", "obesity", "obamacare", "medicare",
    "medicaid", "health insurance", "measles", "outbreak", "immuniz", "antibiotic", "antimicrob", "wellness", "mental health", "radiolog", "imaging", "diagnostic", "biopharma", "gene therapy", "telemedicine", "reimbursement", "nutrition", "aging", "ageing", "longevity", "senescence",
    "geroscience", "supplement", "vitamin", "nutraceutical", "integrative", "complementary", "dietetic", "gerontol", "frailty", "efsa", "tainted",
    "saglik", "hasta", "tibb", r"tip\b", "ilac", "cihaz", "hekim", "doktor", "hemsire", r"asi\b", "tedavi", "hastane", "klinik", "cerrah", "kanser", "diyabet", "salgin", "bulasici", "enfeksiyon", "sigorta", "obezite", "kizamik", "bagisiklik", "antibiyotik", "beslenme", "biyoteknoloji",
    "ruh sagligi", "goruntuleme", r"tani\b", "cerrahi",
)


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def family_fit(text: Column, families: Families = AGENCY_FAMILIES, otherwise: str = "no_audience_fit") -> Column:
    """(ok, reason, terms): the first family with a word in the text, and all of its words that stand there, lower-cased, in order of appearance."""
    text = _empty(text)
    out = F.struct(F.lit(False).alias("ok"), F.lit(otherwise).alias("reason"), F.array().cast("array<string>").alias("terms"))
    for name, words in reversed(families):
        shape = rf"(?iu)(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])"
        found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(shape), 1), F.lower))
        out = F.when(text.rlike(shape), F.struct(F.lit(True).alias("ok"), F.lit(name).alias("reason"), found.alias("terms"))).otherwise(out)
    return out


def ascii_fold(c: Column) -> Column:
    """Marks off, dotless i as i; broken encodings are repaired first. Case stays."""
    return F.translate(nfkd_fold(repaired(_empty(c))), "ıİ", "ii")


def relevant(title: Column, summary: Column, words: Sequence[str] = HEALTH_WORDS) -> Column:
    """(relevant, terms): whether a folded title and summary hold one of the words, and which."""
    text = F.lower(ascii_fold(F.concat_ws(" ", _empty(title), _empty(summary))))
    shape = "|".join(words).replace(r"\b", "(?![a-z0-9_])")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({shape})"), 1))
    return F.struct((F.size(found) > 0).alias("relevant"), found.alias("terms"))


#: Letters of Turkish and the plain ones that stand for them.
TURKISH, PLAIN = "ıİIşŞğĞüÜöÖçÇ", "iiissgguuoocc"


def normalized(c: Column) -> Column:
    """Lower case in plain letters with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(_empty(c), TURKISH, PLAIN)), r"\s+", " "))


@dataclass(frozen=True)
class TierWords:
    """Words of the student gate: titles first, then whole texts. Markers are parts of a normalised text; shapes are regular expressions over it."""

    title: tuple[tuple[str, str, tuple[str, ...]], ...]  # (tier, reason, markers)
    licensure: tuple[str, ...]
    exam: str  # a shape that keeps a text from being about licences elsewhere
    excluded: tuple[str, ...]
    student: tuple[str, ...]
    shapes: tuple[str, ...]  # that make a text one for students too
    context: tuple[str, ...]
    noise: tuple[str, ...]


#: The student gate's words.
_EXAM = r"(?<![a-z0-9])tus(?![a-z0-9])|tipta uzmanlik sinavi"
STUDENT_WORDS = TierWords(
    title=(("out", "ydus_title", ("ydus",)), ("out", "specialty_change_title", ("uzmanlik dali degisikligi",)), ("C", "foreign_licensure_title", ("sts tip doktorlugu", "sts-tip")), ("out", "assistant_title", ("asistan nakil", "asistan rotasyon"))),
    licensure=("sts tip doktorlugu", "sts-tip", "denklik sinavi", "usmle", "ecfmg", "plab", "general medical council", "fachsprachprufung", "kenntnisprufung", "approbation", "mccqe", "medical council of canada", "australian medical council"),
    exam=_EXAM,
    excluded=("ydus", "yan dal", "yandal", "uzmanlik dali degisikligi", "asistan nakil", "asistan rotasyon", "arastirma gorevlisi alim", "ogretim uyesi alim", "ogretim gorevlisi ilan", "doktor ogretim uyesi", "sahu", "pratisyen hekim"),
    student=(
        "akademik takvim", "yatay gecis", "ek madde", "kurul sinav", "ders kurulu", "staj", "intorn", "donem gecme", "donem i ", "donem 1", "donem 2", "donem 3", "donem 4", "donem 5", "donem 6", "mezuniyet oncesi", "ogrenci isleri", "harc", "2209-a", "2209-b",
        "oryantasyon", "ders program", "sinav takvim", "sinav program", "sinav tarih", "ders kurulu sinav", "kurul sinavi", "staj sinav", "mazeret sinav", "butunleme", "ogrenci duyuru", "kayit takvim",
    ),
    shapes=(_EXAM, r"(?<![a-z])burs(?!a)"),
    context=("mecburi hizmet", "intorn ucret", "intorn hekim ucret", "devlet hizmeti yukumlulugu", "devlet hizmeti yukumlugu"),
    noise=("ihale", "mal alimi", "satinalma", "kadro ilani", "personel alimi"),
)


def student_tier(title: Column, body: Column, words: TierWords = STUDENT_WORDS) -> Column:
    """(tier, reason, terms): for whom an item is among students, and the markers that decided it; the whole text is title and body."""
    return text_tier(title, F.concat_ws(" ", _empty(title), _empty(body)), words)


def text_tier(title: Column, whole: Column, words: TierWords = STUDENT_WORDS) -> Column:
    """(tier, reason, terms) of a whole text that has its title in it: no marker is made by putting the two together.

    Rules are tried in order: titles, licences elsewhere (unless the exam is named), what is not for students alone, the intern's context, the
    student's agenda, noise of administration.
    """
    head, text = normalized(title), normalized(whole)
    of = lambda where, markers: F.filter(F.array(*map(F.lit, markers)).cast("array<string>"), lambda m: F.contains(where, m))
    shaped = F.concat(F.array().cast("array<string>"), *(F.slice(F.regexp_extract_all(text, F.lit(f"({s})"), 1), 1, 1) for s in words.shapes))
    student = F.concat(of(text, words.student), shaped)
    decided = lambda tier, reason, terms: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"), terms.alias("terms"))
    none = F.array().cast("array<string>")
    some = lambda terms: F.size(terms) > 0
    rules = [(text == "", decided("out", "empty", none))]
    rules += [(some(of(head, markers)), decided(tier, reason, of(head, markers))) for tier, reason, markers in words.title]
    rules += [
        (some(of(text, words.licensure)) & ~text.rlike(words.exam), decided("C", "foreign_licensure", of(text, words.licensure))),
        (some(of(text, words.excluded)) & ~some(student), decided("out", "non_student_cadre", of(text, words.excluded))),
        (some(of(text, words.context)), decided("B", "intern_context", of(text, words.context))),
        (some(student), decided("A", "student_agenda", student)),
        (some(of(text, words.noise)), decided("out", "admin_noise", of(text, words.noise))),
    ]
    return F.coalesce(*(F.when(c, x) for c, x in rules), decided("out", "no_student_signal", none))


#: Fixed value: a year, an exam and, where it is printed, its term.
CYCLE = r"(?i)(\d{4}\s*[-–]\s*(?:TUS|YDUS|STS(?:\s+T[iı]p\s+Doktorlu[gğ]u)?|Y[OÖ]KD[İI]L|YDS|ALES|KPSS)(?:\s*\d\s*\.\s*D[oö]nem)?)"


def exam_cycle(title: Column) -> Column:
    """The exam and term that a title names, in one spelling; null if none."""
    found = F.regexp_extract(_empty(title), CYCLE, 1)
    return F.when(found != "", normalized(found))
