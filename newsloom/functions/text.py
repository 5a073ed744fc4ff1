"""Text, identity and URL expressions; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and the plain ones that stand for them.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿğışşİ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyygissi"
STOP_WORDS = ("the", "and", "for", "with", "that", "from", "this", "are", "was", "were", "has", "have", "not", "but")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.translate(c, "İ", "i")), ACCENTED, PLAIN)


def tokens(c: Column, least: int = 3, most: int = 24) -> Column:
    """Folded words of 3 to 24 characters that are no stop words and not only digits."""
    return F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: F.length(w).between(least, most) & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$"))


#: Fixed values of the light stemmer: what a word looks like, characters that go, and what comes instead; the first that fits counts.
ENDINGS = (("^.{2,}ies$", 3, "y"), ("^.{3,}ing$", 3, ""), ("^.{3,}ed$", 2, ""), ("^(?=.{5}).*(ss|sh|ch|x|z)es$", 2, ""), ("^.{2,}[^sui]s$", 1, ""))
#: Fixed value: doubled last consonants that become one; l, s, z and f stay doubled.
DOUBLED = r"^(.{2,})([bcdghjkmnpqrtvwxy])\2$"


def stem(w: Column) -> Column:
    """A light stemmer by a table of endings."""
    cut = F.coalesce(*(F.when(w.rlike(shape), F.concat(F.left(w, F.length(w) - n), F.lit(put))) for shape, n, put in ENDINGS), w)
    return F.regexp_replace(cut, DOUBLED, "$1$2")


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by an underscore."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), F.coalesce(b, F.lit(""))))).otherwise(F.array().cast("array<string>"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code points, as a non-negative long."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    prime, mask = F.lit(16_777_619).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    return F.aggregate(letters, F.lit(2_166_136_261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * prime).bitwiseAND(mask))


def url_key(c: Column) -> Column:
    """Canonical key of a URL: no scheme, www, fragment, tracking parameters or last slash; parameters sorted."""
    bare = F.regexp_replace(F.lower(c), "#.*$", "")
    bare = F.regexp_replace(bare, r"^https?://(www\.)?", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_|fbclid|gclid)")))
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def redirect_target(c: Column) -> Column:
    """The ``url`` parameter of a redirecting link where there is one, else the link."""
    inner = F.regexp_extract(c, r"[?&]url=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(c)


def doi(c: Column) -> Column:
    """The first DOI in a text, lower case, without closing signs; null if none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(c, r"(10\.[0-9]{4,9}/[^\s\"'<>]+)", 1)), r"[.,;)]+$", "")
    return F.when(found != "", found)


def pmid(c: Column) -> Column:
    """The identifier after ``PMID`` or in a literature URL; null if none."""
    found = F.regexp_extract(F.lower(c), r"(?:pmid:?\s*|pubmed[^0-9\s]{1,24})([0-9]{5,9})", 1)
    return F.when(found != "", found)


def article_doi(url: Column) -> Column:
    """The DOI that an article's address names or, at one publisher, implies; null if none."""
    # fixed value: the forms of that publisher's article identifiers; the running number has no upper bound
    own = F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?nature\.com/articles/(s[0-9]{5}-[0-9]{3}-[0-9]{4,}-[0-9a-z]|d[0-9]{5}-[0-9]{3}-[0-9]{5}-[0-9])(?:[/?#]|$)", 1)
    return F.coalesce(doi(F.coalesce(F.try_url_decode(url), url)), F.when(own != "", F.concat(F.lit("10.1038/"), own)))


#: Names of metadata that identify a work, words that announce its identifier, hosts that resolve it or hold its record.
WORK_METADATA = ("citation_doi", "dc.identifier")
WORK_LABELS = ("doi", "journal reference", "journal information")
RESOLVER = r"^https?://(dx\.)?doi\.org/"
RECORD = r"^https?://pubmed\.ncbi\.nlm\.nih\.gov/[0-9]{1,9}/?$"
#: Characters after a label in which its identifier is looked for.
LABEL_REACH = 100


def attribute(tag: Column, name: str) -> Column:
    """The quoted value of an attribute in a start tag's text; empty if it has none."""
    return F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*(["'])(.*?)\1""", 2)


def original_study(html: Column) -> Column:
    """(doi, link) of the study that a page reports on.

    Candidates come in four kinds, each in the order of the page: metadata, identifiers soon after a label in the page's text, links to
    the resolver, links to a record of the literature service; the first kind that has one decides.
    """
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\s[^>]*>)"), 1)
    named = lambda t: F.lower(attribute(t, "name")).isin(*WORK_METADATA) | F.lower(attribute(t, "property")).isin(*WORK_METADATA)
    first = lambda found: F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " ")
    after = F.slice(F.split(plain, rf"(?i)\b({'|'.join(WORK_LABELS)})\b"), 2, 1_000_000)
    links = F.transform(tags("a"), lambda t: F.trim(attribute(t, "href")))
    kinds = (
        F.transform(F.filter(tags("meta"), named), lambda t: doi(attribute(t, "content"))),
        F.transform(after, lambda piece: doi(F.left(piece, F.lit(LABEL_REACH)))),
        F.transform(F.filter(links, lambda u: u.rlike(RESOLVER)), doi),
    )
    found = F.coalesce(*map(first, kinds))
    record = F.get(F.filter(links, lambda u: u.rlike(RECORD)), F.lit(0))
    return F.struct(found.alias("doi"), F.coalesce(F.concat(F.lit("https://doi.org/"), found), record).alias("link"))


def work_key(doi_: Column, pmid_: Column, title: Column) -> Column:
    """One key a work: its DOI, else its PMID, else its folded title."""
    return F.coalesce(F.concat(F.lit("doi:"), doi_), F.concat(F.lit("pmid:"), pmid_), F.concat(F.lit("title:"), F.regexp_replace(fold(title), "[^a-z0-9]+", " ")))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts' text, missing ones marked, joined by a separator that no part holds."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256)


def sentences(c: Column) -> Column:
    """Number of sentence ends."""
    return F.regexp_count(c, F.lit(r"[.!?]+(\s|$)"))


#: The characters that Windows-1252 puts in the places 80 to 9F, and those places; five are empty.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
C1 = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))


def repaired(c: Column) -> Column:
    """UTF-8 text that was read as Windows-1252 or Latin-1, read again: only if it shows the usual traces and the bytes make sense."""
    raw = F.translate(c, CP1252, C1)
    traces = raw.rlike("[\u00c2-\u00c5\u00e2][\u0080-\u00bf]") & ~raw.rlike("[^\u0000-\u00ff]")
    again = F.try_validate_utf8(F.encode(raw, "ISO-8859-1").cast("string"))
    return F.when(traces, F.coalesce(again, c)).otherwise(c)
