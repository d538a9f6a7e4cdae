"""Queries over sections, chunks, lexicon scores and parsed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import text as X
from quarry.operators.tables import first_n
from quarry.plans.tables import q

#: A test lexicon of function words; language as domain, one fallback domain.
LEX = [("en", "the", False), ("en", "and", False), ("en", "of the", False), ("fr", "les", False), ("fr", "que", False), ("de", "der", False), ("de", "und", False), ("es", "los", False), ("es", "de la", False), ("any", "en", True), ("any", "on", True)]
LEXV = "lex AS (SELECT *, 1 + 0.5::DOUBLE * (len(string_split(keyword, ' ')) - 1) AS weight, sum(1 + 0.5::DOUBLE * (len(string_split(keyword, ' ')) - 1)) OVER (PARTITION BY domain) AS total FROM (VALUES " + ", ".join(f"('{d}', '{k}', {str(b).lower()})" for d, k, b in LEX) + ") v(domain, keyword, fb))"
RAW = f"{LEXV}, raw AS (SELECT doc_id, domain, sum(weight / total) AS score, bool_or(fb) AS fb FROM documents JOIN lex ON contains(lower(text), keyword) GROUP BY 1, 2), sc AS (SELECT doc_id, domain, round(CASE WHEN fb AND max(CASE WHEN NOT fb THEN score END) OVER (PARTITION BY doc_id) > 0.05 THEN score * 0.3::DOUBLE ELSE score END, 6) AS score FROM raw)"
STUDY = [("field", "eren"), ("field", "ment"), ("lab", "tion"), ("lab", "keit"), ("model", "que"), ("model", "ing"), ("model", "ung")]


def lexicon(c):
    return c.spark.createDataFrame(LEX, "domain string, keyword string, is_fallback boolean")


def scores(c):
    return X.score_domains(c.documents, lexicon(c))


#: Headings before every seventh line, as both engines write them.
HEADED = "SELECT doc_id, string_agg(CASE WHEN i % 7 = 3 THEN '## Part ' || i || chr(10) || line ELSE line END, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) t GROUP BY doc_id"


def headed(c):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return c.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


SECTIONS = f"WITH hd AS ({HEADED}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM hd), s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l) SELECT doc_id, CAST(n - 1 AS INT) AS section_idx, trim(ltrim(min(line) FILTER (WHERE starts_with(line, '#')), '#')) AS title, CAST(2 AS INT) AS level, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT starts_with(line, '#')), '')) AS text FROM s WHERE n > 0 GROUP BY doc_id, n"


@q("split_sections", SECTIONS)
def _(c):
    return X.split_sections(headed(c))


@q("chunk_fixed", "WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 800)) AS s FROM documents), k AS (SELECT doc_id, s, substr(text, CAST(s + 1 AS INT), 1000) AS chunk FROM p) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_idx, chunk FROM k WHERE length(chunk) >= 100")
def _(c):
    return X.chunk_fixed(c.documents, ["doc_id"])


@q("domain_scores", f"WITH {RAW} SELECT doc_id, domain, score FROM sc")
def _(c):
    return scores(c)


@q("domain_scores_wide", "WITH w AS (SELECT doc_id, source, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), ' '), lambda x: length(x) > 7)) AS keyword FROM documents), lex AS (SELECT DISTINCT source AS domain, keyword FROM (SELECT source, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY length(keyword) DESC, keyword) AS n FROM w) x WHERE n <= 2), tot AS (SELECT domain, count(*) AS n FROM lex GROUP BY 1) SELECT doc_id, lex.domain, round(sum(1.0::DOUBLE / n), 6) AS score FROM documents d JOIN lex ON contains(lower(d.text), keyword) JOIN tot ON tot.domain = lex.domain GROUP BY 1, 2")
def _(c):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.length(w) > 7)
    w = c.documents.select("doc_id", "source", F.explode(words).alias("keyword"))
    lex = first_n(w, ["doc_id"], [F.desc(F.length("keyword")), F.asc("keyword")], 2).select(F.col("source").alias("domain"), "keyword").distinct()
    return X.score_domains(c.documents, lex)


@q("domain_scores_by_word", f"WITH {LEXV}, w AS (SELECT doc_id, unnest(list_distinct(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '))) AS word FROM documents) SELECT doc_id, domain, round(sum(weight / total), 6) AS score FROM w JOIN lex ON lex.keyword = w.word GROUP BY 1, 2")
def _(c):
    return X.score_domains_by_word(c.documents, lexicon(c))


@q("classification", f"WITH {RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS n FROM sc), t AS (SELECT doc_id, max(CASE WHEN n = 1 THEN domain END) AS d, max(CASE WHEN n = 1 THEN score END) AS s, string_agg(domain, ',' ORDER BY n) FILTER (WHERE n IN (2, 3)) AS sec FROM r GROUP BY 1) SELECT o.doc_id, coalesce(d, 'unknown') AS primary_domain, round(coalesce(CASE WHEN s >= 0.15 THEN least(1.0::DOUBLE, s * 1.2::DOUBLE) ELSE s END, 0), 6) AS confidence, coalesce(sec, '') AS secondary, CASE WHEN d IS NULL THEN 'none' ELSE 'keyword' END AS method FROM documents o LEFT JOIN t ON t.doc_id = o.doc_id")
def _(c):
    out = X.classify(c.documents, scores(c)).drop("domains")
    return out.withColumn("secondary", F.coalesce(F.array_join("secondary", ","), F.lit("")))


@q("classification_summary", f"WITH {RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS n FROM sc) SELECT coalesce(r.domain, 'unknown') AS primary_domain, count(*) AS n FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.n = 1 GROUP BY 1")
def _(c):
    return X.classify(c.documents, scores(c)).groupBy("primary_domain").agg(F.count("*").alias("n"))


@q("merged_labels", f"WITH {RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS n FROM sc), k AS (SELECT doc_id, domain AS k, round(CASE WHEN score >= 0.15 THEN least(1.0::DOUBLE, score * 1.2::DOUBLE) ELSE score END, 6) AS kc FROM r WHERE n = 1) SELECT d.doc_id, d.lang AS primary_domain, round(CASE WHEN d.lang = k THEN least(1.0::DOUBLE, (0.8::DOUBLE + kc) / 1.5::DOUBLE) ELSE 0.8::DOUBLE * 0.9::DOUBLE END, 6) AS confidence, CASE WHEN d.lang <> k THEN k END AS secondary FROM documents d JOIN k ON k.doc_id = d.doc_id")
def _(c):
    kw = X.classify(c.documents, scores(c)).where("method = 'keyword'")
    return X.merge_labels(c.documents.select("doc_id", F.col("lang").alias("primary_domain"), F.lit(0.8).alias("confidence")), kw)


STUDYV = "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in STUDY) + ") v(y, w)), sh AS (SELECT doc_id, y, avg(CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END) AS s FROM documents, st GROUP BY 1, 2), b AS (SELECT doc_id, y, s, max(s) OVER (PARTITION BY doc_id) AS best FROM sh WHERE s > 0), g AS (SELECT doc_id, max(best) AS best, count(*) FILTER (WHERE s >= 0.7::DOUBLE * best) AS close, min(y) FILTER (WHERE s = best) AS y FROM b GROUP BY 1)"


@q("study_types", f"WITH {STUDYV} SELECT d.doc_id, CASE WHEN best IS NULL THEN 'unknown' WHEN close >= 2 THEN 'mixed' ELSE y END AS study_type, round(CASE WHEN best IS NULL THEN 0.0::DOUBLE WHEN close >= 2 THEN 0.8::DOUBLE * best ELSE least(1.0::DOUBLE, 1.5::DOUBLE * best) END, 6) AS confidence FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id")
def _(c):
    return X.study_types(c.documents, c.spark.createDataFrame(STUDY, "study_type string, keyword string"))


CH = "ch AS (SELECT doc_id, i AS chunk_idx, line AS text, CASE WHEN i = 4 THEN 'References' WHEN i = 9 THEN 'Appendix A' WHEN i % 3 = 0 THEN NULL ELSE 'Body' END AS section FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) t)"
TOK = "CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + greatest(10, CAST(floor((length(text) // 4) * 0.1::DOUBLE) AS BIGINT)) END"


def chunks(c):
    i = F.col("chunk_idx")
    d = c.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_idx", "text")).withColumn("chunk_idx", i.cast("bigint"))
    return d.withColumn("section", F.when(i == 4, "References").when(i == 9, "Appendix A").when(i % 3 == 0, None).otherwise("Body"))


@q("reference_rows", f"WITH {CH} SELECT doc_id, chunk_idx FROM ch WHERE chunk_idx BETWEEN 4 AND 8")
def _(c):
    return X.reference_rows(chunks(c)).select("doc_id", "chunk_idx")


@q("reference_text", f"WITH {CH} SELECT doc_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx), 1, 8000) AS text FROM ch WHERE chunk_idx BETWEEN 4 AND 8 GROUP BY 1")
def _(c):
    return X.reference_text(X.reference_rows(chunks(c)))


BATCH = f"{CH}, cum AS (SELECT *, sum({TOK} + 50) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS c, sum({TOK} + 50) OVER (PARTITION BY doc_id) AS t FROM ch), sb AS (SELECT doc_id, greatest(1, count(*) FILTER (WHERE c <= 900)) AS batch_size FROM cum GROUP BY 1)"


@q("safe_batch_sizes", f"WITH {BATCH} SELECT doc_id, batch_size FROM sb")
def _(c):
    return X.safe_batches(chunks(c), 900)


@q("batch_plan", f"WITH {BATCH} SELECT cum.doc_id, chunk_idx, CASE WHEN t <= 900 THEN 0 ELSE chunk_idx // batch_size END AS batch_no FROM cum JOIN sb ON sb.doc_id = cum.doc_id")
def _(c):
    return X.batch_plan(chunks(c), 900).select("doc_id", "chunk_idx", "batch_no")


@q("prompt_texts", f"WITH {CH} SELECT doc_id, string_agg('[Chunk ' || chunk_idx || ' | ' || coalesce(section, 'General') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) AS prompt FROM ch GROUP BY 1")
def _(c):
    return X.prompt_text(chunks(c))


@q("chunks_by_section", f"WITH {CH} SELECT doc_id, coalesce(section, 'General') AS section, string_agg(cast(chunk_idx AS varchar), ',' ORDER BY chunk_idx) AS chunks FROM ch GROUP BY 1, 2")
def _(c):
    return X.by_section(chunks(c))


@q("chunk_counts", f"WITH {CH} SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM ch GROUP BY 1")
def _(c):
    return chunks(c).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


PD = "pd AS (SELECT doc_id, domain, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS score FROM paper_domains)"


def paper_scores(c):
    from pyspark.sql import Window

    return c.paper_domains.select("doc_id", "domain", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")), 6).alias("score"))


@q("domain_overlap", f"WITH {PD}, need AS (SELECT author_id, count(*) AS n FROM papers GROUP BY 1), g AS (SELECT author_id, domain, count(*) AS h, avg(score) AS m FROM pd JOIN papers ON papers.doc_id = pd.doc_id WHERE score >= 0.1 GROUP BY 1, 2) SELECT g.author_id, domain, round(m, 6) AS mean, count(*) OVER (PARTITION BY g.author_id) BETWEEN 2 AND 3 AS valid FROM g JOIN need ON need.author_id = g.author_id AND n = h")
def _(c):
    return X.domain_overlaps(paper_scores(c), c.papers, "author_id")


@q("combined_domain_vector", f"WITH {PD} SELECT domain, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS variance FROM pd GROUP BY 1 ORDER BY mean DESC, domain LIMIT 10")
def _(c):
    return X.combined_vector(paper_scores(c))


@q("domain_clusters", f"WITH {PD} SELECT domain, count(DISTINCT doc_id) AS degree FROM pd WHERE score >= 0.25 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def _(c):
    return X.domain_clusters(paper_scores(c), 0.25, 2)


@q("significant_domains", f"WITH {PD}, s AS (SELECT doc_id, string_agg(domain, ',' ORDER BY score DESC, domain) FILTER (WHERE score >= 0.3) AS domains FROM pd GROUP BY 1) SELECT doc_id, coalesce(domains, '') AS domains FROM s")
def _(c):
    m = paper_scores(c).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("domain", "score"))).alias("m"))
    return m.select("doc_id", F.array_join(F.transform(C.significant_domains(F.col("m"), 0.3), lambda e: e["domain"]), ",").alias("domains"))


@q("highlighted_text", "WITH d AS (SELECT doc_id, text, regexp_extract(lower(text), '[a-z]{4,}') AS w FROM documents), h AS (SELECT *, regexp_replace(text, '(the)', '**\\1**', 'gi') AS t FROM d) SELECT doc_id, CASE WHEN w = '' THEN t ELSE regexp_replace(t, '(' || w || ')', '**\\1**', 'gi') END AS text FROM h")
def _(c):
    word = F.regexp_extract(F.lower("text"), "[a-z]{4,}", 0)
    return c.documents.select("doc_id", C.highlighted("text", F.array(F.lit("the")), F.filter(F.array(word), lambda w: w != "")).alias("text"))


@q("merged_extractions", "SELECT l_orderkey AS doc_id, count(*)::INT AS items, round(avg(l_discount), 6) AS confidence FROM lineitem GROUP BY 1")
def _(c):
    r = c.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.array("l_partkey").alias("species"), F.col("l_discount").alias("confidence"))
    return X.merge_extractions(r, ["species"]).select("doc_id", F.size("species").alias("items"), "confidence")


@q("preferred_results", "WITH a AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS doc_id, sum(l_linenumber)::BIGINT AS g FROM lineitem GROUP BY 1) SELECT a.doc_id, CASE WHEN n < 5 AND coalesce(g, 0) > n THEN 'generic' ELSE 'own' END AS source, CASE WHEN n < 5 AND coalesce(g, 0) > n THEN g ELSE n END AS entities FROM a LEFT JOIN b ON a.doc_id = b.doc_id")
def _(c):
    li = c.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"))
    return X.prefer_generic(li.agg(F.count("*").alias("entities")), li.agg(F.sum("l_linenumber").alias("entities")))


# -- conversations ----------------------------------------------------------------------------------------

from quarry.operators import dialogue as D  # noqa: E402


@q("history_window", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) t WHERE n <= 10")
def _(c):
    return D.history_window(c.conversations).select("conv_id", "turn")


@q("intent_tags", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'graph') OR contains(lower(text), 'and the') THEN 'graph' WHEN contains(lower(text), 'license') THEN 'search' WHEN contains(text, '?') AND len(string_split(trim(text), ' ')) >= 5 THEN 'question' ELSE 'undecided' END AS intent FROM conversations WHERE role = 'user'")
def _(c):
    return D.tag_intents(c.conversations.where("role = 'user'"), [("graph", ["graph", "and the"]), ("search", ["license"])]).select("conv_id", "turn", "intent")


STRATEGIES = [("graph", ["and the", "network"]), ("keyword", ["license"])]


@q("strategies", "WITH t AS (SELECT conv_id, turn, lower(text) AS l, CASE WHEN contains(lower(text), 'graph') THEN 'graph' WHEN contains(text, '?') AND len(string_split(trim(text), ' ')) >= 5 THEN 'question' ELSE 'undecided' END AS intent FROM conversations) SELECT conv_id, turn, intent, CASE WHEN intent <> 'question' THEN NULL WHEN contains(l, 'and the') OR contains(l, 'network') THEN 'graph' WHEN contains(l, 'license') THEN 'keyword' ELSE 'hybrid' END AS strategy FROM t")
def _(c):
    return D.routed(D.tag_intents(c.conversations, [("graph", ["graph"])]), STRATEGIES).select("conv_id", "turn", "intent", "strategy")


def with_tools(c):
    return c.conversations.withColumn("tools", F.when(F.col("role") != "user", F.array("role", F.lit("search"))))


USED = "CASE WHEN role <> 'user' THEN chr(10) || '{head}' || role || ', search' || chr(10) ELSE '' END"


@q("conversation_export", f"SELECT conv_id, string_agg('### **' || upper(substr(role, 1, 1)) || substr(role, 2) || '**' || chr(10) || chr(10) || text || chr(10) || {USED.format(head='**Tools used:** ')}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(c):
    return D.exported(with_tools(c))


@q("conversation_text", f"SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text || chr(10) || {USED.format(head='[TOOLS] ')}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(c):
    return D.exported(with_tools(c), "txt")


@q("bibtex_export", "SELECT p.doc_id, '@article{' || regexp_extract(trim(a.name), '(\\S+)$', 1) || p.year || '_' || (row_number() OVER (ORDER BY p.doc_id) - 1) || ',' || chr(10) || '  title = {' || p.title || '},' || chr(10) || '  author = {' || a.name || '},' || chr(10) || '  year = {' || p.year || '},' || chr(10) || CASE WHEN coalesce(d.text, '') <> '' THEN '  abstract = {' || replace(replace(replace(d.text, chr(10), ' '), '{', ''), '}', '') || '},' || chr(10) ELSE '' END || '}' || chr(10) AS bibtex FROM papers p JOIN authors a ON a.author_id = p.author_id LEFT JOIN documents d ON d.doc_id = p.doc_id")
def _(c):
    from quarry.sources.exports import bibtex

    p = c.papers.join(c.authors, "author_id").join(c.documents.select("doc_id", F.col("text").alias("abstract")).hint("merge"), "doc_id", "left")
    return bibtex(p.select("doc_id", "title", "year", "abstract", F.array("name").alias("authors")))


# -- selections and entities ------------------------------------------------------------------------------


@q("overlapping_set", f"WITH {PD}, pr AS (SELECT doc_id, domain AS primary_domain FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS n FROM pd) t WHERE n = 1), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_domain ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY primary_domain) AS c FROM pr) t WHERE n <= 2 AND c >= 2), sh AS (SELECT primary_domain, domain FROM few JOIN pd ON pd.doc_id = few.doc_id WHERE score >= 0.05 GROUP BY 1, 2 HAVING count(DISTINCT few.doc_id) = 2), v AS (SELECT primary_domain FROM sh GROUP BY 1 HAVING count(*) BETWEEN 1 AND 3) SELECT primary_domain, doc_id FROM few WHERE primary_domain = (SELECT min(primary_domain) FROM v)")
def _(c):
    from pyspark.sql import Window

    s = paper_scores(c)
    primary = s.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "domain"))).where("n = 1").select("doc_id", F.col("domain").alias("primary_domain"))
    return X.overlapping_set(s, primary, 2, 0.05, 1, 3)


@q("keyword_species", "SELECT keyword, count(DISTINCT doc_id) AS papers FROM (SELECT m.doc_id, upper(substr(s.common_name, 1, 1)) || substr(s.common_name, 2) AS keyword FROM mentions m JOIN species s ON s.species_id = m.species_id) t GROUP BY 1 ORDER BY papers DESC, keyword LIMIT 50")
def _(c):
    k = c.mentions.join(c.species, "species_id").select("doc_id", F.concat(F.upper(F.substring("common_name", 1, 1)), F.substring("common_name", 2, 100)).alias("keyword"))
    return X.keyword_species(k)


@q("keyword_species_links", "WITH k AS (SELECT DISTINCT m.doc_id, upper(substr(s.common_name, 1, 1)) || substr(s.common_name, 2) AS keyword FROM mentions m JOIN species s ON s.species_id = m.species_id), t AS (SELECT keyword, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, keyword LIMIT 50), o AS (SELECT k.* FROM k JOIN t ON t.keyword = k.keyword) SELECT x.keyword AS a, y.keyword AS b, count(*) AS papers FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.keyword < y.keyword GROUP BY 1, 2")
def _(c):
    k = c.mentions.join(c.species, "species_id").select("doc_id", F.concat(F.upper(F.substring("common_name", 1, 1)), F.substring("common_name", 2, 100)).alias("keyword"))
    return X.keyword_links(k)


@q("entities_of_heads", f"WITH {CH}, e AS (SELECT doc_id, chunk_idx, coalesce(section, 'General') AS section, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) > 12))) AS name FROM ch WHERE chunk_idx < 3) SELECT doc_id, name, arg_min(section, chunk_idx) AS section, count(DISTINCT chunk_idx) AS chunks FROM e GROUP BY 1, 2")
def _(c):
    names = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) > 12))
    return X.entities_of_heads(chunks(c).select("doc_id", "chunk_idx", "section", F.explode(names).alias("name")))


#: Title and year of a text, by the rules of the literature parser: the first heading of level 1, then a line of the first ten.
def strip_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


HEADING = strip_sql(r"regexp_extract(d.text, '(?m)^#\s+(.+)$', 1)")
LINES = f"list_transform(list_slice(string_split({strip_sql('d.text')}, chr(10)), 1, 10), lambda x: {strip_sql(f'ltrim({strip_sql(chr(120))}, {chr(39)}#{chr(39)})')})"
PLAIN_TITLE = f"list_filter(list_transform(list_filter({LINES}, lambda x: length(x) > 10 AND length(x) < 300 AND NOT starts_with(x, '!') AND NOT starts_with(x, '|') AND NOT starts_with(x, '```') AND NOT starts_with(x, '---') AND lower(x) NOT IN ('abstract', 'introduction')), lambda x: {strip_sql(f'regexp_replace(x, {chr(39)}[*_]{{1,3}}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}), lambda x: x <> '')[1]"
TITLE = f"coalesce(CASE WHEN length({HEADING}) > 5 AND lower({HEADING}) NOT IN ('abstract', 'introduction', 'methods', 'results', 'discussion', 'references', 'acknowledgments', 'supplementary', 'table of contents', 'contents') THEN {HEADING} END, {PLAIN_TITLE})"
FIRST_YEAR = "try_cast(regexp_extract(substr(d.text, 1, 500), '\\b(20[0-2]\\d|19[89]\\d)\\b', 1) AS INT)"
PUBLISHED = "coalesce(" + ", ".join(f"CASE WHEN try_cast(regexp_extract(d.text, '{p}', 1) AS INT) BETWEEN 1990 AND 2030 THEN try_cast(regexp_extract(d.text, '{p}', 1) AS INT) END" for p in (r"\((\d{4})\)", r"©\s*(\d{4})", r"[Pp]ublished[:\s]+(\d{4})", r"\b(20\d{2})\b")) + ")"


@q("indexed_papers", f"WITH {RAW}, {STUDYV}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS n FROM sc) SELECT d.doc_id, coalesce({TITLE}, 'Untitled') AS title, {FIRST_YEAR} AS year, coalesce(r.domain, 'unknown') AS primary_domain, round(coalesce(CASE WHEN score >= 0.15 THEN least(1.0::DOUBLE, score * 1.2::DOUBLE) ELSE score END, 0), 6) AS confidence, CASE WHEN best IS NULL THEN 'unknown' WHEN close >= 2 THEN 'mixed' ELSE y END AS study_type FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.n = 1 LEFT JOIN g ON g.doc_id = d.doc_id")
def _(c):
    studies = X.study_types(c.documents, c.spark.createDataFrame(STUDY, "study_type string, keyword string"))
    return X.indexed_papers(c.documents, X.classify(c.documents, scores(c)), studies)
