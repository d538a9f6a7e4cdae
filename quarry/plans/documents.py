"""Queries over chunks of whole documents, their metadata, and typed rows of model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import graph as G, text as X
from quarry.operators.tables import cut, spread
from quarry.plans.tables import q
from quarry.plans.text import FIRST_YEAR, HEADED, PUBLISHED, SECTIONS, TITLE, headed

# -- chunks -----------------------------------------------------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


#: Packing of ``sec`` (doc_id, part, text) into ``packed`` (doc_id, part, idx, chunk), one paragraph a round.
PACK = f"""
para AS (SELECT doc_id, part, x, row_number() OVER (PARTITION BY doc_id, part ORDER BY i) AS n FROM (SELECT doc_id, part, {strip('x')} AS x, i FROM (SELECT doc_id, part, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS x, unnest(range(len(regexp_split_to_array(text, '\\n\\s*\\n')))) AS i FROM sec WHERE length(text) > 1000) a) b WHERE x <> ''),
pk AS (SELECT doc_id, part, 0::BIGINT AS n, '' AS cur, NULL::VARCHAR AS out FROM sec WHERE length(text) > 1000
  UNION ALL SELECT pk.doc_id, pk.part, para.n, CASE WHEN cur <> '' AND length(cur) + length(x) > 1000 THEN CASE WHEN length(cur) > 200 THEN substr(cur, length(cur) - 199) ELSE '' END ELSE cur END || x || chr(10) || chr(10), CASE WHEN cur <> '' AND length(cur) + length(x) > 1000 THEN {strip('cur')} END FROM pk JOIN para ON para.doc_id = pk.doc_id AND para.part = pk.part AND para.n = pk.n + 1),
packed AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY n) - 1 AS idx, chunk FROM (
  SELECT doc_id, part, n, out AS chunk FROM pk WHERE out IS NOT NULL
  UNION ALL SELECT doc_id, part, 1e9, {strip('max_by(cur, n)')} FROM pk GROUP BY doc_id, part HAVING length({strip('max_by(cur, n)')}) >= 100
  UNION ALL SELECT doc_id, part, 0, text FROM sec WHERE length(text) <= 1000 AND {strip('text')} <> '') t)
"""
MARKS = [". ", "? ", "! ", ".\n", "?\n", "!\n"]


def found(mark: str) -> str:
    """Place of a mark's last occurrence in the window w, from 0; -1 if there is none."""
    back = "'" + mark[::-1].replace("\n", "' || chr(10) || '") + "'"
    return f"CASE WHEN contains(w, reverse({back})) THEN length(w) - 1 - strpos(reverse(w), {back}) ELSE -1 END"


def sliding(first: bool) -> str:
    """``slid`` (doc_id, idx, s, chunk) of ``tx`` (doc_id, text), one piece a round."""
    if first:
        end = "CASE WHEN s + 1000 < l THEN coalesce(" + ", ".join(f"CASE WHEN {found(m)} > 0 THEN lo + {found(m)} + 2 END" for m in MARKS) + ", s + 1000) ELSE l END"
        step = "CASE WHEN e - 200 > s THEN e - 200 ELSE s + 800 END"
    else:
        end = "CASE WHEN s + 1000 < l THEN CASE WHEN greatest(" + ", ".join(map(found, MARKS)) + ") > 0 THEN lo + greatest(" + ", ".join(map(found, MARKS)) + ") + 2 ELSE s + 1100 END ELSE s + 1000 END"
        step = "e - 200"
    ends = f"SELECT doc_id, s, l, {end} AS e FROM (SELECT b.doc_id, s, s + 900 AS lo, length(text) AS l, substr(text, s + 901, 200) AS w FROM b JOIN tx ON tx.doc_id = b.doc_id) w"
    return f"b AS (SELECT doc_id, 0::BIGINT AS s FROM tx WHERE {strip('text')} <> '' UNION ALL SELECT doc_id, {step} FROM ({ends}) y WHERE {step} < l), slid AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, s, chunk FROM (SELECT t.doc_id, s, {strip('substr(text, s + 1, e - s)')} AS chunk FROM ({ends}) t JOIN tx ON tx.doc_id = t.doc_id) c WHERE length(chunk) >= 100)"


@q("chunk_sections", f"WITH RECURSIVE sec AS (SELECT doc_id, 0 AS part, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), {PACK} SELECT doc_id, idx::INT AS chunk_idx, chunk FROM packed")
def _(c):
    return X.chunk_sections(c.documents.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), ["doc_id"])


@q("chunk_sliding", f"WITH RECURSIVE tx AS (SELECT doc_id, text FROM documents), {sliding(False)} SELECT doc_id, idx::INT AS chunk_idx, s::INT AS \"offset\", chunk FROM slid")
def _(c):
    return X.chunk_sliding(c.documents)


@q("chunk_stream", f"WITH RECURSIVE tx AS (SELECT doc_id, text FROM documents), {sliding(False)} SELECT doc_id, idx::INT AS chunk_idx, s::INT AS \"offset\", chunk FROM slid")
def _(c):
    return X.chunk_stream(c.documents)


GUESS = "list_filter(list_transform(list_slice(string_split(chunk, chr(10)), 1, 3), lambda x: trim(x)), lambda x: length(x) < 80 AND regexp_matches(x, '^\\p{Lu}') AND NOT ends_with(x, '.'))[1]"


@q("chunk_pages", f"WITH RECURSIVE pg AS (SELECT doc_id, i AS page, line AS text, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS top FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) l), tx AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), {sliding(True)} SELECT doc_id, substr(md5(concat_ws(':', doc_id, idx, substr(chunk, 1, 50))), 1, 16) AS chunk_id, idx::INT AS chunk_idx, chunk, {GUESS} AS section, (SELECT min(page) FROM pg WHERE pg.doc_id = slid.doc_id AND top >= s)::INT AS page, len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda w: w <> '')) AS word_count FROM slid")
def _(c):
    return X.chunk_pages(c.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")))


#: Documents with all parts that a parser finds; a third has a table, every other one an abstract.
DOCS = f"hd AS ({HEADED}), dx AS (SELECT d.doc_id, hd.text, d.source AS title, d.lang AS author, 1990 + d.doc_id % 30 AS year, CASE WHEN d.doc_id % 2 = 0 THEN substr(d.text, 1, 100) END AS abstract, CASE WHEN d.doc_id % 3 = 0 THEN '|n|' || d.n_chars || '|' END AS markdown FROM documents d JOIN hd ON hd.doc_id = d.doc_id), sx AS ({SECTIONS[SECTIONS.index('SELECT doc_id, CAST(n - 1'):]})"
DOCS = DOCS.replace("sx AS (", "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM hd), s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l), sx AS (")


def documents(c):
    h = headed(c)
    sections = X.split_sections(h).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section_idx", "title", "level", "text"))), lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), s["text"].alias("text"))).alias("sections"))
    table = F.struct(F.lit("1").alias("table_id"), F.lit(1).alias("page"), F.lit("sizes").alias("caption"), F.concat(F.lit("|n|"), F.col("n_chars").cast("string"), F.lit("|")).alias("markdown"))
    i = F.col("doc_id")
    d = c.documents.select("doc_id", F.col("source").alias("title"), F.array("lang").alias("authors"), (1990 + i % 30).alias("year"), F.when(i % 2 == 0, F.substring("text", 1, 100)).alias("abstract"), F.when(i % 3 == 0, F.array(table)).otherwise(F.array(F.struct(F.lit("2").alias("table_id"), F.lit(2).alias("page"), F.lit("").alias("caption"), F.lit("").alias("markdown")))).alias("tables"))
    d = d.join(h.hint("merge"), "doc_id").join(sections.hint("merge"), "doc_id", "left")
    kind = d.schema["sections"].dataType
    return d.withColumn("sections", F.coalesce("sections", F.array().cast(kind)))


BODY = f"{DOCS}, sec AS (SELECT doc_id, section_idx AS part, text FROM sx), {PACK}, tx AS (SELECT doc_id, text FROM dx WHERE doc_id NOT IN (SELECT doc_id FROM sx)), {sliding(False)}, body AS (SELECT p.doc_id, p.part, p.idx, p.chunk, sx.title AS section, sx.level AS section_level FROM packed p JOIN sx ON sx.doc_id = p.doc_id AND sx.section_idx = p.part UNION ALL SELECT doc_id, 0, idx, chunk, NULL, NULL FROM slid)"


@q("document_chunks", f"WITH RECURSIVE {BODY}, al AS (SELECT *, false AS tb FROM body UNION ALL SELECT doc_id, 1000000, 0, 'Table 1: sizes' || chr(10) || chr(10) || markdown, NULL, NULL, true FROM dx WHERE markdown IS NOT NULL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, idx) - 1)::INT AS chunk_idx, section, section_level, chunk, tb OR regexp_matches(lower(chunk), 'table\\s*\\d+') AS has_table FROM al")
def _(c):
    return X.chunk_documents(documents(c))


@q("child_chunks", f"WITH RECURSIVE {BODY}, k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY part, idx) - 1)::INT AS chunk_idx FROM body) SELECT substr(md5(concat_ws(':', doc_id, chunk_idx, substr(chunk, 1, 50))), 1, 16) AS chunk_id, doc_id, chunk_idx, section, chunk, substr(md5(doc_id || ':parent'), 1, 16) AS parent_id, false AS is_parent FROM k")
def _(c):
    return X.parent_child(documents(c))[1]


RULE = "chr(10) || '{0}' || chr(10)"
PARENT = f"'TITLE: ' || title || chr(10) || 'AUTHORS: ' || author || chr(10) || 'YEAR: ' || year || chr(10) || {RULE.format('=' * 80)} || chr(10) || CASE WHEN coalesce(abstract, '') <> '' THEN 'ABSTRACT' || chr(10) || chr(10) || abstract || chr(10) || {RULE.format('-' * 80)} || chr(10) ELSE '' END || coalesce(parts, text) || chr(10) || {RULE.format('=' * 80 + chr(10) + 'TABLES')} || CASE WHEN markdown IS NOT NULL THEN chr(10) || chr(10) || 'Table 1' || chr(10) || ': sizes' || chr(10) || chr(10) || markdown || chr(10) ELSE '' END"


@q("parent_chunks", f"WITH {DOCS}, ps AS (SELECT doc_id, string_agg(chr(10) || repeat('#', level) || ' ' || title || chr(10) || chr(10) || text, chr(10) ORDER BY section_idx) AS parts FROM sx GROUP BY 1) SELECT substr(md5(dx.doc_id || ':parent'), 1, 16) AS chunk_id, dx.doc_id, {PARENT} AS chunk, true AS is_parent FROM dx LEFT JOIN ps ON ps.doc_id = dx.doc_id")
def _(c):
    return X.parent_child(documents(c))[0]


@q("classification_texts", f"WITH {DOCS}, ps AS (SELECT doc_id, string_agg(title || ': ' || substr(text, 1, 500), chr(10) || chr(10) ORDER BY section_idx) AS parts FROM sx WHERE section_idx < 3 GROUP BY 1) SELECT dx.doc_id, concat_ws(chr(10) || chr(10), 'Title: ' || title, CASE WHEN coalesce(abstract, '') <> '' THEN 'Abstract: ' || abstract END, parts) AS text FROM dx LEFT JOIN ps ON ps.doc_id = dx.doc_id")
def _(c):
    return X.classification_text(documents(c))


# -- metadata ---------------------------------------------------------------------------------------------

#: Texts with titles and abstracts in every place where the rules look for one, or where they must not; names with and without year.
MX = """d AS (SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN '# A title of it' || chr(10) || '## Abstract' || chr(10) || text || chr(10) || '# Next'
  WHEN 1 THEN 'Abstract:' || chr(10) || text || chr(10) || '  Keywords: none' || chr(10) || text || text
  WHEN 2 THEN '**A bold title line** of it' || chr(10) || 'Abstract— ' || text || chr(10) || chr(10) || chr(10) || text || text || text
  WHEN 3 THEN text || ' (' || (1985 + doc_id % 50) || ')'
  WHEN 4 THEN '## Results of the study' || chr(10) || text || ' Published: ' || (1980 + doc_id % 60)
  WHEN 5 THEN '# Contents' || chr(10) || '| a table row of it' || chr(10) || text
  WHEN 6 THEN '# Abstract' || chr(10) || text || ' ' || text || ' References ' || text
  ELSE 'short' || chr(10) || text END AS text,
  CASE WHEN doc_id % 3 = 0 THEN 'deep_sea-' || source || '_b.pdf' ELSE 'papers/' || source || '-of--study---b_' || (1990 + doc_id % 30) || '_Journal-x.pdf' END AS name FROM documents)"""


def described(c):
    i, n = F.col("doc_id"), F.lit("\n")
    year = lambda low, mod: (low + i % mod).cast("string")
    forms = [
        F.concat(F.lit("# A title of it\n## Abstract\n"), "text", F.lit("\n# Next")),
        F.concat(F.lit("Abstract:\n"), "text", F.lit("\n  Keywords: none\n"), "text", "text"),
        F.concat(F.lit("**A bold title line** of it\nAbstract— "), "text", F.lit("\n\n\n"), "text", "text", "text"),
        F.concat("text", F.lit(" ("), year(1985, 50), F.lit(")")),
        F.concat(F.lit("## Results of the study\n"), "text", F.lit(" Published: "), year(1980, 60)),
        F.concat(F.lit("# Contents\n| a table row of it\n"), "text"),
        F.concat(F.lit("# Abstract\n"), "text", F.lit(" "), "text", F.lit(" References "), "text"),
        F.concat(F.lit("short"), n, "text"),
    ]
    text = F.coalesce(*[F.when(i % 8 == k, form) for k, form in enumerate(forms)])  # one form a row is made
    name = F.when(i % 3 == 0, F.concat(F.lit("deep_sea-"), "source", F.lit("_b.pdf"))).otherwise(F.concat(F.lit("papers/"), "source", F.lit("-of--study---b_"), year(1990, 30), F.lit("_Journal-x.pdf")))
    d = spread(c.documents.select("doc_id", "text", "source"), "doc_id")  # a file of one row group would be one task's
    return d.select("doc_id", text.alias("text"), name.alias("name"))


STEM = r"regexp_replace(regexp_extract(name, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1')"
WHOLE_NAME = rf"trim(regexp_replace(replace(regexp_replace(regexp_replace({STEM}, '(?s)_\d{{4}}_.*$', ''), '-{{3,}}', ' — ', 'g'), '--', ' – '), '[-_\s]+', ' ', 'g'))"
WHOLE_NAME = f"upper(substr({WHOLE_NAME}, 1, 1)) || substr({WHOLE_NAME}, 2)"
NAME = rf"regexp_replace({WHOLE_NAME}, '\s+\w$', '')"
STOPS = r"Keywords?|Introduction|[Rr]eferences?|[Bb]ibliography|[Aa]cknowledg|1[.\s]"
THIRD = "substr(d.text, 1, CAST(floor(length(d.text) / 3) AS INT))"
FOUND = [
    r"regexp_extract(d.text, '(?ms)^#{1,3}\s+[Aa]bstract\s*\n(.*?)(?:\n#{1,3}\s|\z)', 1)",
    rf"regexp_extract({THIRD}, '(?s)(?:^|\n)\s*[Aa]bstract[:.\s]*\n(.*?)(?:\n\s*(?:{STOPS}|#{{1,3}}\s)|\z)', 1)",
    rf"regexp_extract({THIRD}, '(?s)[Aa]bstract[:.\s—–-]*\s*(.{{50,}}?)(?:\n\s*(?:{STOPS})|\n\n\n)', 1)",
]
ABSTRACT = "coalesce(" + ", ".join(f"CASE WHEN trim({e}, chr(10) || chr(9) || chr(13) || ' ') <> '' THEN {e} END" for e in FOUND) + ")"
RAN_ON = " OR ".join(f"contains(a, '{m}')" for m in ("References", "REFERENCES", "Bibliography", "BIBLIOGRAPHY", "- ", "• ", "et al.,", ". doi:", "http://dx.doi", "Retrieved from", "Downloaded from"))
METADATA = f"a AS (SELECT doc_id, trim(regexp_replace({ABSTRACT}, '\\s+', ' ', 'g')) AS a FROM d), n AS (SELECT *, len(string_split(a, ' ')) AS n, CASE WHEN {RAN_ON} THEN trim(regexp_replace(a, '(?s)(?:References|REFERENCES|Bibliography|Acknowledgment).*$', '')) ELSE a END AS b FROM a), w AS (SELECT *, string_split(b, ' ') AS w FROM n), f AS (SELECT doc_id, CASE WHEN n < 20 OR n > 800 AND (len(w) < 20 OR b = '') THEN NULL WHEN n <= 800 THEN a WHEN len(w) > 500 THEN array_to_string(list_slice(w, 1, 400), ' ') || '...' ELSE b END AS abstract FROM w)"
WINDOW = "substr(text, 401, 200)"
SENTENCE = "CASE WHEN greatest(" + ", ".join(found(m) for m in MARKS) + ") > 0 THEN 402 + greatest(" + ", ".join(found(m) for m in MARKS) + ") ELSE 600 END"


@q("text_metadata", f"WITH {MX}, {METADATA}, e AS (SELECT doc_id, {SENTENCE} AS sentence_end FROM (SELECT doc_id, {WINDOW} AS w FROM d) x) SELECT d.doc_id, coalesce({TITLE}, {WHOLE_NAME}) AS title, {NAME} AS file_title, try_cast(regexp_extract({STEM}, '_(\\d{{4}})_', 1) AS INT) AS file_year, {FIRST_YEAR} AS year, {PUBLISHED} AS published, abstract, sentence_end::BIGINT AS sentence_end FROM d JOIN f ON f.doc_id = d.doc_id JOIN e ON e.doc_id = d.doc_id")
def _(c):
    return described(c).select("doc_id", C.title_of("text", "name").alias("title"), C.title_from_filename("name").alias("file_title"), C.year_of_filename("name").alias("file_year"), C.year_in("text").alias("year"), C.published_year("text").alias("published"), C.abstract_of("text").alias("abstract"), C.sentence_end("text", F.lit(500)).alias("sentence_end"))


@q("chunk_entities", "SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE '' END AS species, lang AS locations, 0 AS methods FROM documents")
def _(c):
    e = C.chunk_entities(F.when(F.col("lang") == "en", F.array("source")), F.array("lang"), F.lit(None).cast("array<string>"))
    d = c.documents.select("doc_id", e.alias("e"))
    return d.select("doc_id", F.array_join("e.species", ",").alias("species"), F.array_join("e.locations", ",").alias("locations"), F.size("e.methods").alias("methods"))


# -- model answers, made of the words and lines of each text ----------------------------------------------

LINE = "ln AS (SELECT doc_id, i, line, string_split(line, ' ')[1] AS a, string_split(line, ' ')[-1] AS z, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE lang <> 'fr') t)"


def answers(c):
    """Answers in JSON behind a thought and in a code fence; none for French texts.  Stored, as a model's answers would be."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.get(F.split(x, " "), 0).alias("a"), F.element_at(F.split(x, " "), -1).alias("z"), F.length(x).alias("n")))
    each = lambda f: F.transform(lines, lambda x: F.struct(*[v.alias(k) for k, v in f(x).items()]))
    content = F.to_json(
        F.struct(
            F.transform(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{13,})"), F.lit(1)), lambda w: F.struct(w.alias("original_name"), F.col("lang").alias("common_name"), w.alias("text_snippet"))).alias("species"),
            each(lambda x: {"parameter": x["a"], "value": F.when(x["n"] % 4 == 0, "n/a").otherwise((x["n"] % 5).cast("string")), "unit": F.lit("cm"), "value_min": F.lit(1)}).alias("measurements"),
            each(lambda x: {"name": x["z"], "latitude": (x["n"] % 3).cast("string"), "longitude": x["n"], "region": F.col("lang")}).alias("locations"),
            each(lambda x: {"season": x["a"], "description": x["z"]}).alias("temporal"),
            each(lambda x: {"subject": x["a"], "object": x["z"], "relation_type": F.when(x["n"] % 3 == 0, "predation").when(x["n"] % 3 == 1, "mutualism")}).alias("relations"),
            each(lambda x: {"species": x["a"], "trait_name": x["z"], "trait_value": F.when(x["n"] % 2 == 0, x["n"].cast("string"))}).alias("traits"),
            each(lambda x: {"name": x["a"], "type": F.lit("word")}).alias("key_entities"),
            each(lambda x: {"name": x["z"]}).alias("methods"),
            each(lambda x: {"name": x["a"], "size": x["n"].cast("string")}).alias("datasets"),
            each(lambda x: {"title": x["a"], "year": (1990 + x["n"] % 30).cast("string"), "authors": F.array(x["z"]), "doi": F.concat(F.lit("https://doi.org/10.1/"), x["n"].cast("string"))}).alias("citations"),
        )
    )
    answer = F.concat(F.lit("<think>{not this}</think>```json\n"), content, F.lit("\n```"))
    d = spread(c.documents, "doc_id")  # a file of one row group would be one task's
    return cut(d.select("doc_id", F.lit("c").alias("chunk_id"), F.lit(2).alias("page"), F.col("source").alias("section"), F.when(F.col("lang") != "fr", answer).otherwise(F.lit("no answer")).alias("content")))


@q("parsed_species", "SELECT doc_id, w AS original_name, lang AS common_name, 'c' AS chunk_id, source AS section, 2 AS page, w AS snippet, 1.0::DOUBLE AS confidence FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z]{13,}')) AS w FROM documents WHERE lang <> 'fr') t")
def _(c):
    s = X.parse_extractions(answers(c))["species"]
    return s.select("doc_id", "original_name", "common_name", "source.chunk_id", "source.section", "source.page", F.col("source.text_snippet").alias("snippet"), "source.confidence")


@q("parsed_measurements", f"WITH {LINE} SELECT doc_id, a AS parameter, (n % 5)::DOUBLE AS value, 'cm' AS unit, 1.0::DOUBLE AS value_min FROM ln WHERE a <> '' AND n % 4 <> 0 AND n % 5 <> 0")
def _(c):
    return X.parse_extractions(answers(c))["measurements"].select("doc_id", "parameter", "value", "unit", "value_min")


@q("parsed_places", f"WITH {LINE} SELECT doc_id, z AS name, CASE WHEN n % 3 <> 0 AND n <> 0 THEN n % 3 END::DOUBLE AS latitude, CASE WHEN n % 3 <> 0 AND n <> 0 THEN n END::DOUBLE AS longitude FROM ln WHERE z <> ''")
def _(c):
    return X.parse_extractions(answers(c))["locations"].select("doc_id", "name", "latitude", "longitude")


@q("parsed_relations", f"WITH {LINE} SELECT doc_id, a AS subject, z AS object, CASE WHEN n % 3 = 0 THEN 'predation' ELSE 'associated' END AS type FROM ln WHERE a <> '' AND z <> ''")
def _(c):
    return X.parse_extractions(answers(c))["relations"].select("doc_id", "subject", "object", "type")


@q("parsed_lists", f"WITH {LINE} SELECT 'temporal' AS list, a AS x, z AS y, count(*) AS n FROM ln GROUP BY ALL UNION ALL SELECT 'traits', a, z || n, count(*) FROM ln WHERE a <> '' AND z <> '' AND n % 2 = 0 GROUP BY ALL UNION ALL SELECT 'key_entities', a, 'word', count(*) FROM ln WHERE a <> '' GROUP BY ALL UNION ALL SELECT 'methods', z, NULL, count(*) FROM ln WHERE z <> '' GROUP BY ALL UNION ALL SELECT 'datasets', a, cast(n AS varchar), count(*) FROM ln WHERE a <> '' GROUP BY ALL UNION ALL SELECT 'citations', a, (1990 + n % 30) || z || '10.1/' || n, count(*) FROM ln WHERE a <> '' GROUP BY ALL")
def _(c):
    out = X.parse_extractions(answers(c), stored=True)
    y = {"temporal": ("season", F.col("description")), "traits": ("species", F.concat("trait_name", "trait_value")), "key_entities": ("name", F.col("type")), "methods": ("name", F.lit(None).cast("string")), "datasets": ("name", F.col("size").cast("string")), "citations": ("title", F.concat(F.col("year").cast("string"), F.array_join("authors", ""), "doi"))}
    parts = [out[k].select(F.lit(k).alias("list"), F.col(a).alias("x"), b.alias("y")).groupBy("list", "x", "y").agg(F.count("*").alias("n")) for k, (a, b) in y.items()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@q("rejected_answers", "SELECT doc_id, 'no answer' AS content FROM documents WHERE lang = 'fr'")
def _(c):
    return X.parse_extractions(answers(c))["rejects"].select("doc_id", "content")


@q("entity_counts", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]{13,}')) + 2 * len(string_split(text, chr(10))) AS entities FROM documents")
def _(c):
    lines = F.split("text", "\n")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{13,})"), F.lit(1))
    nothing = F.lit(None).cast("array<string>")
    return c.documents.select("doc_id", C.entity_count(words, lines, lines, nothing).alias("entities"))


@q("parsed_citations", f"WITH {LINE} SELECT doc_id, CASE WHEN n % 2 = 0 THEN a ELSE 'Unknown' END AS title, 1990 + n % 30 AS year, z AS authors, 'References' AS section, 0.9::DOUBLE AS confidence FROM ln")
def _(c):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.length(x) % 2 == 0, F.get(F.split(x, " "), 0)).alias("title"), (1990 + F.length(x) % 30).alias("year"), F.array(F.element_at(F.split(x, " "), -1)).alias("authors")))
    a = c.documents.where("lang <> 'fr'").select("doc_id", F.concat(F.lit("Here: "), F.to_json(lines)).alias("content"))
    return X.parse_citations(a).select("doc_id", "title", F.col("year").cast("long").alias("year"), F.array_join("authors", ",").alias("authors"), "source.section", "source.confidence")


@q("parsed_hypotheses", "SELECT substr(md5(doc_id || ':' || coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '')), 1, 12) AS hypothesis_id, doc_id AS link_id, CASE doc_id % 3 WHEN 0 THEN 'knowledge_gap' ELSE 'ecological_effect' END AS type, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'exploratory' ELSE 'medium' END AS level, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE (doc_id % 10) / 10 END::DOUBLE AS score, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') AS statement, substr(text, 1, 40) AS rationale, 1 AS evidence FROM documents")
def _(c):
    i = F.col("doc_id")
    answer = F.struct(F.when(i % 3 > 0, F.col("source")).alias("statement"), F.substring("text", 1, 40).alias("rationale"), F.when(i % 3 == 0, "knowledge_gap").when(i % 3 == 1, "miracle").alias("hypothesis_type"), F.when(i % 4 == 0, "high").when(i % 4 == 1, "exploratory").when(i % 4 == 2, "sure").alias("confidence"), F.when(i % 5 != 0, (i % 10) / 10).alias("confidence_score"), F.array("lang").alias("supporting_evidence"))
    h = X.parse_hypotheses(c.documents.select(i.alias("link_id"), F.concat(F.lit("<think>no</think>"), F.to_json(answer)).alias("content")))
    return h.withColumn("evidence", F.size("evidence"))


@q("parsed_works", "SELECT p.doc_id AS key, '10.1/' || p.doc_id AS doi, p.title, CASE WHEN p.doc_id % 2 = 0 THEN 'Journal' END AS journal, p.year, CASE WHEN p.doc_id % 3 > 0 THEN p.doc_id % 12 + 1 END::INT AS month, a.name AS authors, 'article' AS type, CASE WHEN p.doc_id % 2 = 0 THEN p.doc_id % 50 ELSE 0 END::INT AS n_references, 0 AS n_cited FROM papers p JOIN authors a ON a.author_id = p.author_id")
def _(c):
    i, p = F.col("doc_id"), c.papers.join(c.authors, "author_id")
    parts = F.struct(F.array(F.when(i % 3 > 0, F.array("year", (i % 12 + 1).cast("int"))).otherwise(F.array("year"))).alias("date-parts"))
    work = F.struct(F.concat(F.lit("10.1/"), i.cast("string")).alias("DOI"), F.array("title").alias("title"), F.when(i % 2 == 0, F.array(F.lit("Journal"))).alias("container-title"), F.when(i % 2 == 0, parts).alias("published-print"), parts.alias("published-online"), F.array(F.struct(F.col("name").alias("family"))).alias("author"), F.lit("article").alias("type"), F.when(i % 2 == 0, (i % 50).cast("int")).alias("references-count"))
    return X.parse_works(p.select(i.alias("key"), F.to_json(work).alias("content"))).withColumn("authors", F.array_join("authors", ","))


# -- graph tables from extractions --------------------------------------------------------------------------


def built(c):
    """The graph of the typed rows of all answers."""
    items = lambda name, item: F.transform(X.good_items(name), item).alias(name)
    nothing = F.lit(None).cast("string")
    return G.build_graph(
        X.parsed_answers(answers(c)).select(
            "doc_id",
            "chunk_id",
            items("species", lambda e: F.struct(nothing.alias("scientific_name"), e["original_name"].alias("original_name"), e["common_name"].alias("family"), F.lit(1.0).alias("confidence"))),
            items("locations", lambda e: F.struct(e["name"].alias("name"), e["region"].alias("region"))),
            items("measurements", lambda e: F.struct(e["parameter"].alias("parameter"), e["value"].try_cast("double").alias("value"), e["unit"].alias("unit"), e["parameter"].alias("species"))),
            items("relations", lambda e: F.struct(e["subject"].alias("subject"), e["object"].alias("object"), C.normal_relation(e["relation_type"], X.RELATIONS).alias("type"), e["description"].alias("description"))),
        )
    )


WORDS = "wd AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{13,}')) AS w FROM documents WHERE lang <> 'fr')"
ENDS = "rl AS (SELECT DISTINCT a AS subject, z AS object, CASE WHEN n % 3 = 0 THEN 'predation' ELSE 'associated' END AS type FROM ln WHERE a <> '' AND z <> '')"


@q("graph_relations", f"WITH {LINE}, {ENDS} SELECT subject, object, type, NULL::VARCHAR AS description FROM rl")
def _(c):
    return built(c)["relations"]


@q("graph_species", f"WITH {LINE}, {ENDS}, {WORDS}, sp AS (SELECT w AS name, max(lang) AS family FROM wd GROUP BY 1), en AS (SELECT subject AS name FROM rl UNION SELECT object FROM rl) SELECT coalesce(sp.name, en.name) AS name, family FROM sp FULL JOIN en ON sp.name = en.name")
def _(c):
    return built(c)["species"]


@q("graph_measurements_of_species", f"WITH {LINE}, {ENDS}, {WORDS}, sp AS (SELECT w AS name FROM wd UNION SELECT subject FROM rl UNION SELECT object FROM rl) SELECT DISTINCT a AS species, substr(md5(concat_ws('_', cast(doc_id AS varchar), a, cast(cast(n % 5 AS DOUBLE) AS varchar), a)), 1, 12) AS measurement_id FROM ln WHERE a <> '' AND n % 4 <> 0 AND n % 5 <> 0 AND a IN (SELECT name FROM sp)")
def _(c):
    return built(c)["has_measurement"]


@q("graph_places", f"WITH {LINE} SELECT DISTINCT ln.doc_id, replace(lower(z || '_' || lang), ' ', '_') AS location_id FROM ln JOIN documents d ON d.doc_id = ln.doc_id WHERE z <> ''")
def _(c):
    return built(c)["references_location"].select("doc_id", "location_id").distinct()
