"""Column helpers: functions Column -> Column, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# -- identifiers ------------------------------------------------------------------------------------------


def content_id(content: Column | str) -> Column:
    """First 12 hex digits of the MD5 of a document's bytes."""
    return F.substring(F.md5(_c(content)), 1, 12)


def point_id(chunk_id: Column | str) -> Column:
    """First 15 hex digits of the MD5 of a chunk id, as a number."""
    return F.conv(F.substring(F.md5(_c(chunk_id)), 1, 15), 16, 10).cast("bigint")


def chunk_id(doc_id: Column | str, idx: Column | str, text: Column | str) -> Column:
    """16 hex digits from document, chunk number and the text's first 50 characters."""
    return F.substring(F.md5(F.concat_ws(":", _c(doc_id).cast("string"), _c(idx).cast("string"), F.substring(_c(text), 1, 50))), 1, 16)


def author_id(name: Column | str) -> Column:
    """Lower case, blanks to underscores, dots dropped."""
    return F.replace(F.replace(F.lower(_c(name)), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def location_id(name: Column | str, region: Column | str) -> Column:
    return F.replace(F.lower(F.concat_ws("_", _c(name), F.coalesce(_c(region), F.lit("unknown")))), F.lit(" "), F.lit("_"))


def measurement_id(doc: Column, parameter: Column, value: Column, species: Column) -> Column:
    """12 hex digits from document, parameter, value and species; value as the caller formats it."""
    return F.substring(F.md5(F.concat_ws("_", doc.cast("string"), parameter, value.cast("string"), species.cast("string"))), 1, 12)


# -- sizes ------------------------------------------------------------------------------------------------


def estimated_tokens(text: Column | str) -> Column:
    """Characters div 4, and a tenth of that but at least 10 more; 0 for no text."""
    n = F.floor(F.length(_c(text)) / 4).cast("bigint")
    return F.when(F.coalesce(F.length(_c(text)), F.lit(0)) == 0, F.lit(0)).otherwise(n + F.greatest(F.lit(10), F.floor(n * F.lit(0.1)))).cast("bigint")


def source_ref(doc_id: Column, chunk_id: Column, page: Column, section: Column, snippet: Column, confidence: float = 1.0) -> Column:
    """struct that says where an extracted item comes from."""
    return F.struct(doc_id.alias("doc_id"), chunk_id.alias("chunk_id"), page.alias("page"), section.alias("section"), snippet.alias("text_snippet"), F.lit(confidence).alias("confidence"), F.lit(False).alias("is_inferred"))


def date_parts(parts: Column) -> Column:
    """struct(year, month) of the first of several date lists [[year, month, day], ...]."""
    first = F.get(parts, 0)
    return F.struct(F.get(first, 0).cast("int").alias("year"), F.get(first, 1).cast("int").alias("month"))


def chunk_entities(species: Column, locations: Column, methods: Column) -> Column:
    """struct of a chunk's entity lists, missing ones empty."""
    empty = F.array().cast("array<string>")
    return F.struct(F.coalesce(species, empty).alias("species"), F.coalesce(locations, empty).alias("locations"), F.coalesce(methods, empty).alias("methods"))


def fits_in_context(text: Column | str, system: Column | str = "", max_output: int = 500, window: int = 2048) -> Column:
    system = F.lit(system) if isinstance(system, str) else system
    return estimated_tokens(text) + estimated_tokens(system) + max_output <= window


def word_count(text: Column | str) -> Column:
    """Number of runs without white space."""
    return F.size(F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")


def entity_count(*lists: Column) -> Column:
    """Total size of several arrays, null counting as empty."""
    total = F.lit(0)
    for x in lists:
        total = total + F.coalesce(F.size(x), F.lit(0))
    return total.cast("bigint")


# -- flags ------------------------------------------------------------------------------------------------


#: The patterns of table and figure mentions.
TABLE_MENTION, FIGURE_MENTION = r"table\s*\d+", r"fig(ure)?\s*\.?\s*\d+"


def mentions_table(text: Column | str) -> Column:
    return F.lower(_c(text)).rlike(TABLE_MENTION)


def mentions_figure(text: Column | str) -> Column:
    return F.lower(_c(text)).rlike(FIGURE_MENTION)


def bad_title(title: Column | str) -> Column:
    t = _c(title)
    return t.isNull() | (t == "Untitled") | t.startswith("<!--") | (F.length(t) < 5)


def bad_abstract(abstract: Column | str) -> Column:
    """Missing, shorter than 30 characters, starting with the word "abstract" or with its style name inside."""
    a = _c(abstract)
    return a.isNull() | (F.length(a) < 30) | a.startswith("abstract") | a.contains("abstractCls")


def is_threatened(category: Column | str) -> Column:
    return _c(category).isin("CR", "EN", "VU")


# -- text -------------------------------------------------------------------------------------------------


def snippet(text: Column | str, n: int = 200) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def truncated(text: Column | str, n: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def label(code: Column | str) -> Column:
    """Underscores to blanks, every word capitalised."""
    return F.initcap(F.translate(_c(code), "_", " "))


def paragraphs(text: Column | str) -> Column:
    """Pieces between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_c(text), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def clean_doi(doi: Column | str) -> Column:
    """Resolver prefixes off; null unless a slash remains."""
    d = F.regexp_replace(F.trim(_c(doi)), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(d.contains("/"), d)


def clean_species_name(name: Column | str) -> Column:
    """Bracketed parts off, white space folded; null unless two words remain."""
    n = F.trim(F.regexp_replace(F.regexp_replace(_c(name), r"\([^)]*\)|\[[^\]]*\]", " "), r"\s+", " "))
    return F.when(F.size(F.split(n, " ")) >= 2, n)


def genus_epithet(name: Column | str) -> Column:
    """struct(genus, epithet) with the usual case."""
    parts = F.split(F.trim(_c(name)), r"\s+")
    return F.struct(F.initcap(F.get(parts, 0)).alias("genus"), F.lower(F.get(parts, 1)).alias("epithet"))


def hierarchy(*ranks: Column) -> Column:
    return F.concat_ws(" > ", *ranks)


#: Conservation categories and their names.
CATEGORY_NAMES = {"EX": "Extinct", "EW": "Extinct in the Wild", "CR": "Critically Endangered", "EN": "Endangered", "VU": "Vulnerable", "NT": "Near Threatened", "LC": "Least Concern", "DD": "Data Deficient", "NE": "Not Evaluated"}


def category_name(code: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv]), _c(code))


def last_name(author: Column | str) -> Column:
    return F.element_at(F.split(F.trim(_c(author)), r"\s+"), -1)


def stem(name: Column | str) -> Column:
    """Last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(_c(name), r"([^/]*)/*$", 1), r"^(.+)\.[^.]+$", "$1")


def title_from_filename(name: Column | str, whole: bool = False) -> Column:
    """What stands before the first _YYYY_ of a file's name: dashes of three, two and one letter-spaced as such, upper case first.

    A last single letter, what is left of a cut name, goes; not if ``whole``.  Null if nothing is left.
    """
    n = F.regexp_replace(stem(name), r"(?s)_\d{4}_.*$", "")
    n = F.replace(F.regexp_replace(n, "-{3,}", " — "), F.lit("--"), F.lit(" – "))
    n = F.trim(F.regexp_replace(n, r"[-_\s]+", " "))
    n = F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1_000_000))
    n = n if whole else F.regexp_replace(n, r"\s+\w$", "")
    return F.when(n != "", n)


def year_of_filename(name: Column | str) -> Column:
    """The year in _YYYY_ of a file's name."""
    return F.regexp_extract(stem(name), r"_(\d{4})_", 1).try_cast("int")


def year_in(text: Column | str, head: int = 500) -> Column:
    """First year of 1980–2029 in the first characters."""
    return F.regexp_extract(F.substring(_c(text), 1, head), r"\b(19[89]\d|20[0-2]\d)\b", 1).try_cast("int")


def published_year(text: Column | str) -> Column:
    """First of (YYYY), © YYYY, Published: YYYY, any 20YY that lies in 1990–2030."""
    t = _c(text)
    found = [F.regexp_extract(t, p, 1).try_cast("int") for p in (r"\((\d{4})\)", r"©\s*(\d{4})", r"[Pp]ublished[:\s]+(\d{4})", r"\b(20\d\d)\b")]
    return F.coalesce(*[bound(y, lambda v: F.when(v.between(1990, 2030), v)) for y in found])


#: Headings that are no titles, marks that begin no title line, what ends an abstract, what shows that one
#: ran into the references, and where those begin.
NO_TITLE = ("abstract", "introduction", "methods", "results", "discussion", "references", "acknowledgments", "supplementary", "table of contents", "contents")
NO_TITLE_LINE = ("abstract", "introduction")
NO_LINE_START = ("!", "|", "```", "---")
ABSTRACT_END = r"Keywords?|Introduction|[Rr]eferences?|[Bb]ibliography|[Aa]cknowledg|1[.\s]"
RAN_ON = ("References", "REFERENCES", "Bibliography", "BIBLIOGRAPHY", "- ", "• ", "et al.,", ". doi:", "http://dx.doi", "Retrieved from", "Downloaded from")
REFERENCES_AT = "References|REFERENCES|Bibliography|Acknowledgment"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_of(text: Column | str, filename: Column | str | None = None) -> Column:
    """The first heading of level 1 if it is a title, else a plausible one of the first ten lines, else the file name."""
    t = _c(text)
    heading = stripped(F.regexp_extract(t, r"(?md)^#\s+(.+)$", 1))
    heading = bound(heading, lambda h: F.when((F.length(h) > 5) & ~F.lower(h).isin(*NO_TITLE), h))
    lines = F.transform(F.slice(F.split(stripped(t), "\n"), 1, 10), lambda x: stripped(F.regexp_replace(stripped(x), "^#+", "")))
    fit = lambda x: F.length(x).between(11, 299) & ~F.lower(x).isin(*NO_TITLE_LINE) & ~F.regexp_like(x, F.lit("^(?:" + "|".join(rf"\Q{m}\E" for m in NO_LINE_START) + ")"))
    plain = F.filter(F.transform(F.filter(lines, fit), lambda x: stripped(F.regexp_replace(x, "[*_]{1,3}", ""))), lambda x: x != "")
    out = F.coalesce(heading, F.get(plain, 0))
    return out if filename is None else F.coalesce(out, title_from_filename(filename, whole=True))


def abstract_of(text: Column | str) -> Column:
    """Abstract under a heading; else, in the first third, under a line "Abstract" or behind that word, up to what ends one.

    Folded to single blanks.  Under 20 words it is null; over 800 it is cut where it ran into the references, and if then
    over 500 to 400 words.
    """
    t = _c(text)
    third = F.substring(t, F.lit(1), F.floor(F.length(t) / 3).cast("int"))
    found = [
        F.regexp_extract(t, r"(?msd)^#{1,3}\s+[Aa]bstract\s*\n(.*?)(?:\n#{1,3}\s|\z)", 1),
        F.regexp_extract(third, rf"(?s)(?:^|\n)\s*[Aa]bstract[:.\s]*\n(.*?)(?:\n\s*(?:{ABSTRACT_END}|#{{1,3}}\s)|\z)", 1),
        F.regexp_extract(third, rf"(?s)[Aa]bstract[:.\s—–-]*\s*(.{{50,}}?)(?:\n\s*(?:{ABSTRACT_END})|\n\n\n)", 1),
    ]
    raw = F.coalesce(*[bound(x, lambda v: F.when(stripped(v) != "", v)) for x in found])
    ran_on = "|".join(rf"\Q{m}\E" for m in RAN_ON)
    before = lambda a: F.when(F.regexp_like(a, F.lit(ran_on)), F.trim(F.regexp_replace(a, f"(?s)(?:{REFERENCES_AT}).*$", ""))).otherwise(a)
    first = lambda w: F.when(F.size(w) > 500, F.concat(F.array_join(F.slice(w, 1, 400), " "), F.lit("..."))).otherwise(F.array_join(w, " "))
    short = lambda a: F.when(word_count(a) > 800, bound(F.split(before(a), " "), first)).otherwise(a)
    kept = lambda a: F.when(word_count(a) >= 20, bound(short(a), lambda out: F.when(word_count(out) >= 20, out)))
    return bound(F.trim(F.regexp_replace(raw, r"\s+", " ")), kept)


def sentence_end(text: Column | str, end: Column, reach: int = 100) -> Column:
    """Position after the last sentence mark and its blank within ``reach`` around ``end`` (0-based); else end + reach.

    A mark at the very start of the window does not count.
    """
    t = _c(text)
    lo = F.greatest(F.lit(0), end - reach)
    window = F.substring(t, (lo + 1).cast("int"), (end + reach - lo).cast("int"))
    marks = [". ", ".\n", "? ", "?\n", "! ", "!\n"]
    back = [F.locate(m[::-1], F.reverse(window)) for m in marks]
    at = F.length(window) - 1 - F.least(*[F.when(b > 0, b) for b in back])
    return F.when(at > 0, lo + at + 2).otherwise(end + reach).cast("bigint")


def salvaged_json(text: Column | str, kind: str = "object") -> Column:
    """The outermost JSON object (or array) of a model's answer: think tags and code fences off."""
    a, b = ("{", "}") if kind == "object" else ("[", "]")
    t = F.regexp_replace(F.regexp_replace(_c(text), r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(t, rf"(?s)\{a}.*\{b}", 0), F.lit(""))  # the text named once, so it is made once


def highlighted(text: Column | str, *entities: Column, mark: str = "**") -> Column:
    """Every entity of the arrays, in order, set between marks; literal and case-insensitive."""
    out = _c(text)
    for e in entities:
        out = F.aggregate(F.coalesce(e, F.array().cast("array<string>")), out, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"(?i)(\Q"), x, F.lit(r"\E)")), F.lit(f"{mark}$1{mark}")))
    return out


def normal_relation(kind: Column | str, known: tuple[str, ...]) -> Column:
    """Known relation types in lower case, all others "associated"."""
    k = F.lower(F.trim(_c(kind)))
    return F.when(k.isin(*known), k).otherwise(F.lit("associated"))


#: Words that are no concepts.
STOP = tuple(
    """
    a an the of in for and or to on
    with by from as at its is are was
    were be been being this that it not
    but if do does did has have had
    using based new novel study analysis
    approach method data model results case
    between through during after before under
    over into about than more most other
    how what which each can may could
    will would should two three vs via
    """.split()
)


def concepts(title: Column, keywords: Column, domains: Column) -> Column:
    """Title words of more than 3 letters off the stop list, marks at their ends off; keywords of more than 2; domains with blanks."""
    marks = r"""[.,;:!?()\[\]"'\-–—]+"""
    words = F.filter(F.transform(F.split(F.lower(title), r"\s+"), lambda w: F.regexp_replace(w, f"^{marks}|{marks}$", "")), lambda w: (F.length(w) > 3) & ~w.isin(*STOP))
    keys = F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: F.length(k) > 2)
    doms = F.transform(domains, lambda d: F.replace(d, F.lit("_"), F.lit(" ")))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(words, empty), F.coalesce(keys, empty), F.coalesce(doms, empty)))


def significant_domains(domains: Column, least: float = 0.1, primary: Column | None = None) -> Column:
    """Array of struct(domain, score) with score >= least, best first; the primary domain alone if none is."""
    kept = F.map_filter(domains, lambda k, v: v >= least)
    ordered = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("domain"))))
    out = F.transform(ordered, lambda e: F.struct(e["domain"].alias("domain"), (-e["n"]).alias("score")))
    if primary is not None:
        out = F.when((F.size(out) > 0) | primary.isNull(), out).otherwise(F.array(F.struct(primary.alias("domain"), F.lit(1.0).alias("score"))))
    return out


def affinity_label(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.8, "strong").when(s >= 0.5, "moderate").otherwise("weak")


# -- geography --------------------------------------------------------------------------------------------

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


# -- vectors ----------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
