"""Document pipeline: sections, chunks, lexicon scores, study types, references, parsed model answers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.tables import cut, first_n, sized

# -- sections and chunks ----------------------------------------------------------------------------------


def split_sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_idx, title, level, text): a line that starts with # opens a section of that level.

    Text before the first heading is dropped.  The lines of a document are folded inside its row.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.startswith("#").alias("h")))
    d = df.where(F.col(text).isNotNull()).select(F.col(key), lines.alias("l"))
    d = d.withColumn("at", F.transform(F.filter("l", lambda s: s["h"]), lambda s: s["i"])).where("size(at) > 0")
    d = d.select(key, "l", F.posexplode(F.arrays_zip("at", F.concat(F.slice("at", 2, 1 << 30), F.array(F.size("l"))).alias("to"))).alias("section_idx", "p"))
    head = F.get(F.col("l"), F.col("p.at"))["x"]
    body = F.transform(F.slice(F.col("l"), F.col("p.at") + 2, F.greatest(F.lit(0), F.col("p.to") - F.col("p.at") - 1)), lambda s: s["x"])
    return d.select(key, "section_idx", F.trim(F.regexp_replace(head, "^#+", "")).alias("title"), F.length(F.regexp_extract(head, "^(#+)", 1)).alias("level"), F.trim(F.array_join(body, "\n")).alias("text"))


def chunk_sections(df: DataFrame, keys: list[str], text: str = "text", size: int = 1000, overlap: int = 200, min_size: int = 100) -> DataFrame:
    """(keys, chunk_idx, chunk): sections up to ``size`` stay whole; longer ones pack paragraphs.

    What is packed ends in a blank line after every paragraph, which counts.  A paragraph that would pass ``size``
    flushes it; if it is longer than ``overlap``, its last ``overlap`` characters are carried before the next
    paragraph.  Chunks are trimmed; the rest is kept if it has ``min_size`` characters; a paragraph longer than
    ``size`` stays whole.
    """
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    gap = F.lit("\n\n")

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur) > 0) & (F.length(cur) + F.length(p) > size)
        carried = F.when(F.length(cur) > overlap, F.substring(cur, F.length(cur) - overlap + 1, F.lit(overlap))).otherwise("")
        return F.struct(F.when(full, F.concat(carried, p, gap)).otherwise(F.concat(cur, p, gap)).alias("cur"), F.when(full, F.concat(acc["out"], F.array(strip(cur)))).otherwise(acc["out"]).alias("out"))

    last = lambda acc: F.when(F.length(strip(acc["cur"])) >= min_size, F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])
    packed = F.aggregate(C.paragraphs(text), start, step, last)
    whole = F.when(F.length(text) <= size, F.filter(F.array(F.col(text)), lambda x: strip(x) != "")).otherwise(packed)
    return df.select(*keys, F.posexplode(whole).alias("chunk_idx", "chunk"))


def chunk_fixed(df: DataFrame, keys: list[str], text: str = "text", size: int = 1000, overlap: int = 200, min_size: int = 100) -> DataFrame:
    """(keys, chunk_idx, chunk): windows of a fixed size and step; a last piece below ``min_size`` is dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size - overlap))
    pieces = F.filter(F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size))), lambda x: F.length(x) >= min_size)
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(pieces).alias("chunk_idx", "chunk"))


MARKS = (". ", "? ", "! ", ".\n", "?\n", "!\n")


def pieces(text: str, size: int, overlap: int, min_size: int, reach: int = 100, boundary: str = "last") -> Iterator[tuple[int, str]]:
    """(offset, piece) with ends moved behind a sentence mark and its blank within ``reach`` of the size.

    boundary "last": the last of all marks, else ``reach`` beyond the size; "first": the last place of the first kind
    of mark that occurs, else the plain size.  A mark at the start of the window does not count.  The pieces go on
    until a start lies beyond the text, so the last one may repeat the end of the one before.
    """
    start = 0
    while start < len(text) and not text.isspace():
        end = start + size
        if end < len(text):
            lo = max(start, end - reach) if boundary == "first" else end - reach
            at = [text.rfind(m, lo, end + reach) - lo for m in MARKS]
            if boundary == "last":
                end = lo + max(at) + 2 if max(at) > 0 else end + reach
            else:
                end = next((lo + p + 2 for p in at if p > 0), end)
        piece = text[start:end].strip()
        if len(piece) >= min_size:
            yield start, piece
        if boundary == "first":
            end = min(end, len(text))
            start = end - overlap if end - overlap > start else start + max(size - overlap, 1)
        else:
            start = end - overlap


def sliding_pieces(text: str, size: int, overlap: int, min_size: int, reach: int = 100, boundary: str = "last") -> list[tuple[int, str]]:
    return list(pieces(text, size, overlap, min_size, reach, boundary))


def chunk_sliding(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200, min_size: int = 100, boundary: str = "last") -> DataFrame:
    """(key, chunk_idx, offset, chunk): sequential inside a document, parallel across documents."""
    if size <= overlap + 100:
        raise ValueError("size must exceed overlap by more than 100")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, o, p) for k, t in zip(pdf["k"], pdf["t"], strict=True) if t for i, (o, p) in enumerate(pieces(t, size, overlap, min_size, boundary=boundary))]
            yield pd.DataFrame(rows, columns=["k", "chunk_idx", "offset", "chunk"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_idx int, offset int, chunk string")
    return out.withColumnRenamed("k", key)


def chunk_stream(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200, min_size: int = 100, boundary: str = "last", block: int = 1000) -> DataFrame:
    """chunk_sliding as a table function over Arrow batches: chunks leave in blocks, so a very long text is never one output batch."""
    if size <= overlap + 100:
        raise ValueError("size must exceed overlap by more than 100")
    kind = df.schema[key].dataType.simpleString()

    @F.arrow_udtf(returnType=f"k {kind}, chunk_idx int, offset int, chunk string")
    class Pieces:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, texts = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                found = enumerate(pieces(texts[row].as_py() or "", size, overlap, min_size, boundary=boundary))
                while part := list(itertools.islice(found, block)):
                    yield pa.table({"k": pa.array([keys[row].as_py()] * len(part), keys.type), "chunk_idx": pa.array([i for i, _ in part], pa.int32()), "offset": pa.array([p[0] for _, p in part], pa.int32()), "chunk": [p[1] for _, p in part]})

    return Pieces(df.select(F.col(key).alias("k"), F.col(text).alias("t")).asTable()).withColumnRenamed("k", key)


def pages_of_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks with the first page that reaches their offset; pages is (doc_id, page, text), joined by blank lines."""
    by = Window.partitionBy("doc_id").orderBy("page")
    ends = F.sum(F.length("text") + 2).over(by.rowsBetween(Window.unboundedPreceding, 0))
    p = pages.select("doc_id", "page", ends.alias("to")).withColumn("from", F.coalesce(F.lag("to").over(by), F.lit(-1)))
    c = chunks.alias("c").join(p.alias("p").hint("merge"), (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("offset") > F.col("from")) & (F.col("offset") <= F.col("to")))
    return c.select("c.*", "page")


def guessed_section(chunk: Column | str) -> Column:
    """The first of a chunk's first three lines that looks like a heading: a capital first, short, no full stop."""
    c = F.col(chunk) if isinstance(chunk, str) else chunk
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 3), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: (F.length(x) < 80) & x.rlike(r"^\p{Lu}") & ~x.endswith(".")), 0)


def chunk_pages(pages: DataFrame, size: int = 1000, overlap: int = 200, min_size: int = 100) -> DataFrame:
    """(doc_id, chunk_id, chunk_idx, chunk, section, page, word_count) of documents given as pages (doc_id, page, text)."""
    texts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    c = pages_of_chunks(chunk_sliding(texts, size=size, overlap=overlap, min_size=min_size, boundary="first"), pages)
    return c.select("doc_id", C.chunk_id("doc_id", "chunk_idx", "chunk").alias("chunk_id"), "chunk_idx", "chunk", guessed_section("chunk").alias("section"), "page", C.word_count("chunk").alias("word_count"))


def text_chunks(df: DataFrame, **sizes) -> DataFrame:
    """(doc_id, part, idx, section, section_level, chunk): sections if there are any, else the text, in order.

    df is (doc_id, text, sections array<struct<title, level, text>>).
    """
    cut = df.select("doc_id", F.posexplode("sections").alias("part", "s")).select("doc_id", "part", F.col("s.title").alias("section"), F.col("s.level").alias("section_level"), F.col("s.text").alias("text"))
    by_section = chunk_sections(cut, ["doc_id", "part", "section", "section_level"], **sizes)
    plain = chunk_sliding(df.where(F.coalesce(F.size("sections"), F.lit(0)) <= 0), **sizes)
    nothing = [F.lit(0).alias("part"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("section_level")]
    names = ["doc_id", "part", "chunk_idx", "section", "section_level", "chunk"]
    return by_section.select(*names).unionByName(plain.select("doc_id", *nothing, "chunk_idx", "chunk").select(*names)).withColumnRenamed("chunk_idx", "idx")


def chunk_documents(df: DataFrame, **sizes) -> DataFrame:
    """(doc_id, chunk_idx, section, section_level, chunk, has_table): chunks of the text, then one for each table."""
    body = text_chunks(df, **sizes).withColumns({"is_table": F.lit(False)})
    tables = table_chunks(df).select("doc_id", F.lit(1 << 30).alias("part"), F.col("place").alias("idx"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("section_level"), "chunk", F.lit(True).alias("is_table"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "idx")) - 1
    out = body.unionByName(tables).withColumn("chunk_idx", place)
    return out.select("doc_id", "chunk_idx", "section", "section_level", "chunk", (F.col("is_table") | C.mentions_table("chunk")).alias("has_table"))


def parent_id(doc_id: Column | str) -> Column:
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.substring(F.md5(F.concat(d.cast("string"), F.lit(":parent"))), 1, 16)


def parent_child(df: DataFrame, **sizes) -> tuple[DataFrame, DataFrame]:
    """(parents, children): one parent per document with its assembled text; children are chunks of the text, no tables."""
    parents = parent_text(df).select(parent_id("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("chunk"), F.lit(True).alias("is_parent"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "idx")) - 1
    children = text_chunks(df, **sizes).withColumn("chunk_idx", place)
    return parents, children.select(C.chunk_id("doc_id", "chunk_idx", "chunk").alias("chunk_id"), "doc_id", "chunk_idx", "section", "chunk", parent_id("doc_id").alias("parent_id"), F.lit(False).alias("is_parent"))


def table_chunks(df: DataFrame) -> DataFrame:
    """(doc_id, place, table_id, chunk) from tables[struct(table_id, page, caption, markdown)]; tables without content are passed over."""
    t = df.select("doc_id", F.posexplode("tables").alias("place", "t")).where(F.coalesce("t.markdown", F.lit("")) != "")
    caption = F.when(F.coalesce("t.caption", F.lit("")) != "", F.concat(F.lit(": "), F.col("t.caption"))).otherwise("")
    return t.select("doc_id", "place", "t.table_id", F.concat(F.lit("Table "), F.col("t.table_id"), caption, F.lit("\n\n"), F.col("t.markdown")).alias("chunk"))


# -- lexicon ----------------------------------------------------------------------------------------------


def weighted(lexicon: DataFrame) -> DataFrame:
    """A lexicon (domain, keyword[, is_fallback]) with weight 1 + 0.5 per further word and its domain's total."""
    lex = lexicon if "is_fallback" in lexicon.columns else lexicon.withColumn("is_fallback", F.lit(False))
    lex = lex.withColumn("weight", 1 + 0.5 * (F.size(F.split("keyword", " ")) - 1))
    return lex.withColumn("total", F.sum("weight").over(Window.partitionBy("domain")))


#: Keywords that are looked for one by one inside the engine, and those that one automaton may hold: about 100 MB in every worker.
FEW_KEYWORDS, MOST_KEYWORDS = 64, 1_000_000


def found_keywords(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word): the different keywords of ``lexicon`` (keyword), in lower case, that stand in the text, as substrings, case ignored.

    More than ``FEW_KEYWORDS`` are looked for in one pass over a text, by an automaton that each Python worker builds
    once; the result is the same.  More than ``MOST_KEYWORDS`` are an error: score_domains_by_word joins lexicons of any size.
    """
    words = [r.w for r in lexicon.select(F.lower("keyword").alias("w")).where("w is not null").distinct().limit(MOST_KEYWORDS + 1).collect()]
    if len(words) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords; use score_domains_by_word")
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    if len(words) <= FEW_KEYWORDS:
        listed = F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")
        return df.select(key, lower.alias("__t")).select(key, F.explode(F.filter(listed, lambda w: F.contains("__t", w))).alias("word"))
    held = df.sparkSession.sparkContext.broadcast(sorted(words))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in held.value:
            if w:
                automaton.add_word(w, w)
        automaton.make_automaton()
        always = [w for w in held.value if not w]
        for texts in batches:
            found = ({w for _, w in automaton.iter(t)} if t and len(automaton) else () for t in texts)
            yield pd.Series([always + sorted(f) for f in found], dtype=object)

    return df.select(key, F.explode(run(lower)).alias("word"))


def score_domains(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", dampen: float = 0.3, specific: float = 0.05) -> DataFrame:
    """(key, domain, score): share of a domain's keyword weight found in the text, as substrings, case ignored.

    Fallback domains are damped where a specific one scores above ``specific``.
    """
    weights = weighted(lexicon).select(F.lower("keyword").alias("word"), "domain", "weight", "total", "is_fallback")
    hits = found_keywords(df, lexicon, key, text).join(sized(weights, MOST_KEYWORDS), "word")
    scores = hits.groupBy(key, "domain").agg(F.sum(F.col("weight") / F.col("total")).alias("score"), F.max("is_fallback").alias("fb"))
    best = F.max(F.when(~F.col("fb"), F.col("score"))).over(Window.partitionBy(key))
    damped = F.when(F.col("fb") & (best > specific), F.col("score") * dampen).otherwise(F.col("score"))
    return scores.withColumn("score", damped).select(key, "domain", F.round("score", 6).alias("score"))


def score_domains_by_word(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As score_domains for whole words: an equi join of distinct words with a lexicon of any size."""
    lex = weighted(lexicon).withColumn("word", F.lower("keyword"))
    words = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("word"))
    return words.join(lex.hint("merge"), "word").groupBy(key, "domain").agg(F.round(F.sum(F.col("weight") / F.col("total")), 6).alias("score"))


def classify(df: DataFrame, scores: DataFrame, key: str = "doc_id", boost_from: float = 0.15, boost: float = 1.2) -> DataFrame:
    """(key, primary_domain, confidence, domains, secondary, method): "unknown" where nothing matched."""
    ranked = scores.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "domain")))
    g = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "domain", "score"))).alias("r"))
    top = F.get("r", 0)
    conf = F.when(top["score"] >= boost_from, F.least(F.lit(1.0), top["score"] * boost)).otherwise(top["score"])
    out = df.select(key).join(g, key, "left")
    return out.select(
        key,
        F.coalesce(top["domain"], F.lit("unknown")).alias("primary_domain"),
        F.round(F.coalesce(conf, F.lit(0.0)), 6).alias("confidence"),
        F.map_from_entries(F.transform("r", lambda s: F.struct(s["domain"], s["score"]))).alias("domains"),
        F.transform(F.slice("r", 2, 2), lambda s: s["domain"]).alias("secondary"),
        F.when(F.col("r").isNull(), "none").otherwise("keyword").alias("method"),
    )


def merge_labels(model: DataFrame, keyword: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, primary_domain, confidence, secondary): agreement adds up, disagreement lowers the model's label."""
    m = model.select(key, F.col("primary_domain").alias("m"), F.col("confidence").alias("mc"))
    k = keyword.select(key, F.col("primary_domain").alias("k"), F.col("confidence").alias("kc"))
    same = F.col("m") == F.col("k")
    c = F.when(same, F.least(F.lit(1.0), (F.col("mc") + F.col("kc")) / 1.5)).otherwise(F.col("mc") * 0.9)
    return m.join(k, key).select(key, F.col("m").alias("primary_domain"), F.round(c, 6).alias("confidence"), F.when(~same, F.col("k")).alias("secondary"))


def study_types(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, study_type, confidence) from (study_type, keyword): shares of found keywords; near ties are "mixed".

    Keys are the documents'; of a repeated key all texts count together.
    """
    sizes = lexicon.groupBy("study_type").agg(F.count("*").alias("of"))
    words = sized(lexicon.select("study_type", F.lower("keyword").alias("word")).join(sizes.hint("merge"), "study_type"), MOST_KEYWORDS)
    hits = found_keywords(df, lexicon, key, text).distinct().join(words, "word").groupBy(key, "study_type", "of").agg(F.count("*").alias("n"))
    shares = hits.groupBy(key).agg(F.collect_list(F.struct((F.col("n") / F.col("of")).alias("s"), F.col("study_type").alias("y"))).alias("x"))  # one entry a type
    d = df.select(key).join(shares.hint("merge"), key, "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<s:double,y:string>>")))
    best = F.array_max(F.transform("x", lambda x: x["s"]))
    close = F.filter("x", lambda x: x["s"] >= F.lit(0.7) * best)
    first = F.get(F.array_sort(F.transform(F.filter("x", lambda x: x["s"] == best), lambda x: x["y"])), 0)
    kind = F.when(best.isNull(), "unknown").when(F.size(close) >= 2, "mixed").otherwise(first)
    conf = F.when(best.isNull(), 0.0).when(F.size(close) >= 2, 0.8 * best).otherwise(F.least(F.lit(1.0), 1.5 * best))
    return d.select(key, kind.alias("study_type"), F.round(conf, 6).alias("confidence"))


def classification_text(df: DataFrame, sections: int = 3, width: int = 500) -> DataFrame:
    """(doc_id, text): title, abstract and the heads of the first sections, each with its label; missing parts are left out."""
    label = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    parts = F.transform(F.slice("sections", 1, sections), lambda s: F.concat(s["title"], F.lit(": "), F.substring(s["text"], 1, width)))
    every = F.concat(F.array(label("Title: ", F.col("title")), label("Abstract: ", F.col("abstract"))), F.coalesce(parts, F.array().cast("array<string>")))
    return df.select("doc_id", F.array_join(F.array_compact(every), "\n\n").alias("text"))


# -- references, budgets, batches -------------------------------------------------------------------------


def reference_rows(chunks: DataFrame, heading: str = "(?i)^(references|bibliography|literature cited)", end: str = "(?i)^(appendix|supplement)") -> DataFrame:
    """Chunks from the references heading of their document up to an end section."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    on = F.max(F.col("section").rlike(heading).cast("int")).over(w)
    d = chunks.withColumn("on", on)
    d = d.withColumn("off", F.max((F.col("section").rlike(end) & (F.col("on") == 1)).cast("int")).over(w))
    return d.where("on = 1 and coalesce(off, 0) = 0").drop("on", "off")


def reference_text(rows: DataFrame, limit: int = 8000) -> DataFrame:
    """(doc_id, text): reference chunks in order, joined by blank lines, cut."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "text"))), lambda s: s["text"])
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, limit).alias("text"))


def safe_batches(chunks: DataFrame, budget: int, extra: int = 50) -> DataFrame:
    """(doc_id, batch_size): leading chunks whose tokens fit the budget, at least 1."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(C.estimated_tokens("text") + extra).over(w)
    return chunks.withColumn("cum", cum).groupBy("doc_id").agg(F.greatest(F.lit(1), F.count_if(F.col("cum") <= budget)).cast("bigint").alias("batch_size"))


def batch_plan(chunks: DataFrame, budget: int, extra: int = 50) -> DataFrame:
    """Chunks with batch_no: a document that fits is one batch, others go in groups of their safe size."""
    total = F.sum(C.estimated_tokens("text") + extra).over(Window.partitionBy("doc_id"))
    j = chunks.withColumn("total", total).join(safe_batches(chunks, budget, extra), "doc_id")
    return j.withColumn("batch_no", F.when(F.col("total") <= budget, 0).otherwise(F.floor(F.col("chunk_idx") / F.col("batch_size"))).cast("bigint")).drop("total")


def prompt_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, prompt): a document's chunks with a header each, in order."""
    block = F.concat(F.lit("[Chunk "), F.col("chunk_idx").cast("string"), F.lit(" | "), F.coalesce("section", F.lit("General")), F.lit("]\n"), F.col("text"))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("prompt"))


# -- model answers ----------------------------------------------------------------------------------------

#: What each list of an answer holds; numbers come as text, since models write them either way.
LISTS = {
    "species": "original_name:string,common_name:string",
    "measurements": "parameter:string,value:string,unit:string,value_min:string,value_max:string,species:string,life_stage:string",
    "locations": "name:string,latitude:string,longitude:string,region:string,country:string,habitat_type:string",
    "temporal": "start_date:string,end_date:string,season:string,description:string",
    "relations": "relation_type:string,subject:string,object:string,description:string",
    "traits": "species:string,trait_name:string,trait_value:string",
    "key_entities": "name:string,type:string,description:string",
    "methods": "name:string,description:string",
    "datasets": "name:string,size:string,description:string",
    "citations": "title:string,year:string,authors:array<string>,journal:string,doi:string",
}
ANSWER = "struct<" + ",".join(f"{k}:array<struct<{v},text_snippet:string>>" for k, v in LISTS.items()) + ">"
#: Relation types that are kept as they are.
RELATIONS = ("predation", "parasitism", "competition", "symbiosis", "habitat_use", "associated")


#: What an item of a list needs to count.
NEEDED = {"species": ("original_name",), "measurements": ("parameter",), "locations": ("name",), "temporal": (), "relations": ("subject", "object"), "traits": ("species", "trait_name", "trait_value"), "key_entities": ("name",), "methods": ("name",), "datasets": ("name",), "citations": ("title",)}


def parsed_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (doc_id, chunk_id, content[, page, section]) with ``j``, all lists of the answer, null without JSON.

    An answer is parsed once, in one pass over all of them: where filters and other columns could take the parser along
    it would run again for each.
    """
    page, section = (F.col(c) if c in answers.columns else F.lit(None).cast(t) for c, t in (("page", "int"), ("section", "string")))
    return answers.withColumns({"__page": page, "__section": section, "j": F.from_json(C.salvaged_json("content"), ANSWER, {"mode": "PERMISSIVE"})}).withColumn("__any", F.col("j").isNotNull())


def good_items(name: str, lists: str = "j") -> Column:
    """The items of a list of ``parsed_answers`` that have all they need."""

    def good(e: Column) -> Column:
        test = e.isNotNull()
        for c in NEEDED[name]:
            test = test & (F.coalesce(e[c], F.lit("")) != "")
        return test & F.coalesce(e["value"].try_cast("double") != 0, F.lit(False)) if name == "measurements" else test

    return F.filter(f"{lists}.{name}", good)


def parse_extractions(answers: DataFrame, stored: bool = False) -> dict[str, DataFrame]:
    """Typed rows of the ten lists from model answers (doc_id, chunk_id, content); "rejects" holds answers without JSON.

    Bad items are passed over one by one: species, places, entities, methods and datasets need a name, measurements a
    parameter and a number other than 0, relations both ends, traits all three parts; coordinates need two numbers
    other than 0.  Every row carries its source; page and section are taken from ``answers`` where it has them.
    ``stored`` writes what was parsed to the shared folder, for uses of several lists, which else parse each for itself.
    """
    base = ["doc_id", "chunk_id"]
    d = parsed_answers(answers)
    d = cut(d.withColumn("content", F.when(F.col("j").isNull(), F.col("content")))) if stored else d
    number = lambda c: F.col(c).try_cast("double")

    def rows(name: str, *columns: str | Column) -> DataFrame:
        item = d.select(*base, "__page", "__section", F.explode(good_items(name)).alias("e"))
        source = C.source_ref(F.col("doc_id"), F.col("chunk_id"), F.col("__page"), F.col("__section"), F.col("e.text_snippet"))
        return item.select(*base, *columns, source.alias("source"))

    value = number("e.value")
    both = (number("e.latitude") != 0) & (number("e.longitude") != 0)
    return {
        "species": rows("species", "e.original_name", "e.common_name"),
        "measurements": rows("measurements", "e.parameter", value.alias("value"), "e.unit", number("e.value_min").alias("value_min"), number("e.value_max").alias("value_max"), "e.species", "e.life_stage"),
        "locations": rows("locations", "e.name", "e.region", "e.country", "e.habitat_type", F.when(both, number("e.latitude")).alias("latitude"), F.when(both, number("e.longitude")).alias("longitude")),
        "temporal": rows("temporal", "e.start_date", "e.end_date", "e.season", "e.description"),
        "relations": rows("relations", "e.subject", "e.object", C.normal_relation("e.relation_type", RELATIONS).alias("type"), "e.description"),
        "traits": rows("traits", "e.species", "e.trait_name", "e.trait_value"),
        "key_entities": rows("key_entities", "e.name", "e.type", "e.description"),
        "methods": rows("methods", "e.name", "e.description"),
        "datasets": rows("datasets", "e.name", F.col("e.size").try_cast("int").alias("size"), "e.description"),
        "citations": rows("citations", "e.title", F.col("e.year").try_cast("int").alias("year"), F.coalesce("e.authors", F.array().cast("array<string>")).alias("authors"), "e.journal", C.clean_doi("e.doi").alias("doi")),
        "rejects": d.where("not __any").select(*base, "content"),
    }


def parse_citations(answers: DataFrame) -> DataFrame:
    """(doc_id, title, year, authors, journal, doi, source) rows from answers (doc_id, content) that are JSON arrays of citations."""
    kind = "array<struct<title:string,year:string,authors:array<string>,journal:string,doi:string>>"
    d = answers.select("doc_id", F.explode(F.from_json(C.salvaged_json("content", "array"), kind)).alias("e"))
    nothing = F.lit(None).cast("string")
    source = C.source_ref(F.col("doc_id"), nothing, F.lit(None).cast("int"), F.lit("References"), nothing, 0.9)
    return d.select("doc_id", F.coalesce("e.title", F.lit("Unknown")).alias("title"), F.col("e.year").try_cast("int").alias("year"), F.coalesce("e.authors", F.array().cast("array<string>")).alias("authors"), "e.journal", "e.doi", source.alias("source"))


#: Types and levels of hypotheses.
HYPOTHESIS_TYPES = ("ecological_effect", "conservation_implication", "methodological_transfer", "knowledge_gap", "data_synthesis", "novel_interaction")
HYPOTHESIS_LEVELS = ("high", "medium", "low", "exploratory")


def parse_hypotheses(answers: DataFrame) -> DataFrame:
    """(hypothesis_id, link_id, type, level, score, statement, rationale, evidence) from answers (link_id, content).

    Unknown types become the first, unknown levels "medium", a missing score 0.5.
    """
    kind = "struct<statement:string,rationale:string,hypothesis_type:string,confidence:string,confidence_score:string,supporting_evidence:array<string>>"
    d = answers.select("link_id", F.from_json(C.salvaged_json("content"), kind).alias("e")).where("e is not null")
    text = F.coalesce("e.statement", F.lit(""))
    return d.select(
        F.substring(F.md5(F.concat_ws(":", F.col("link_id").cast("string"), text)), 1, 12).alias("hypothesis_id"),
        "link_id",
        F.when(F.col("e.hypothesis_type").isin(*HYPOTHESIS_TYPES), F.col("e.hypothesis_type")).otherwise(HYPOTHESIS_TYPES[0]).alias("type"),
        F.when(F.col("e.confidence").isin(*HYPOTHESIS_LEVELS), F.col("e.confidence")).otherwise("medium").alias("level"),
        F.coalesce(F.col("e.confidence_score").try_cast("double"), F.lit(0.5)).alias("score"),
        text.alias("statement"),
        F.coalesce("e.rationale", F.lit("")).alias("rationale"),
        F.coalesce("e.supporting_evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def parse_works(answers: DataFrame) -> DataFrame:
    """Works from nested records (key, content): title, journal, year and month of print, else online, authors' family names, counts."""
    kind = "struct<DOI:string,title:array<string>,`container-title`:array<string>,publisher:string,type:string,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>,`references-count`:int,`is-referenced-by-count`:int>"
    d = answers.select("key", F.from_json("content", kind).alias("w")).where("w is not null")
    when = C.date_parts(F.coalesce(F.col("w.published-print.date-parts"), F.col("w.published-online.date-parts")))
    d = d.withColumn("d", when)
    return d.select("key", F.col("w.DOI").alias("doi"), F.get("w.title", 0).alias("title"), F.get("w.container-title", 0).alias("journal"), "d.year", "d.month", F.transform("w.author", lambda x: x["family"]).alias("authors"), F.col("w.type").alias("type"), F.coalesce("w.references-count", F.lit(0)).alias("n_references"), F.coalesce("w.is-referenced-by-count", F.lit(0)).alias("n_cited"))


def merge_extractions(results: DataFrame, lists: list[str]) -> DataFrame:
    """One row per document: every list concatenated, confidence averaged."""
    return results.groupBy("doc_id").agg(*[F.flatten(F.collect_list(x)).alias(x) for x in lists], F.round(F.avg("confidence"), 6).alias("confidence"))


def prefer_generic(own: DataFrame, generic: DataFrame, few: int = 5) -> DataFrame:
    """Per document the generic result where the own one has fewer than ``few`` entities and the generic more."""
    a = own.select("doc_id", F.col("entities").alias("n"))
    b = generic.select("doc_id", F.col("entities").alias("g"))
    j = a.join(b, "doc_id", "left")
    use = (F.col("n") < few) & (F.coalesce("g", F.lit(0)) > F.col("n"))
    return j.select("doc_id", F.when(use, "generic").otherwise("own").alias("source"), F.when(use, F.col("g")).otherwise(F.col("n")).alias("entities"))


def by_section(chunks: DataFrame) -> DataFrame:
    """(doc_id, section, chunks): chunk numbers of each section, null sections as "General"."""
    return chunks.groupBy("doc_id", F.coalesce("section", F.lit("General")).alias("section")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("chunk_idx")), lambda x: x.cast("string")), ",").alias("chunks"))


def run_model(prompts: DataFrame, model, key: str = "doc_id", prompt: str = "prompt") -> DataFrame:
    """(key, content): a user's function list[str] -> list[str] over batches of prompts."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": model(list(pdf[prompt]))})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, content string")


def embed(df: DataFrame, model, text: str = "text", name: str = "embedding") -> DataFrame:
    """``df`` with vectors from a user's function list[str] -> list[vector]; the function travels with the job."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in model(list(s))], dtype=object)

    return df.withColumn(name, run(F.col(text)))


# -- corpus summaries of domains --------------------------------------------------------------------------


def domain_overlap(scores: DataFrame, papers: DataFrame, least: float = 0.1, low: int = 2, high: int = 3) -> DataFrame:
    """(domain, mean, valid): domains significant in all given papers; valid if their number is within bounds."""
    chosen = papers.select("doc_id").distinct()
    n = chosen.agg(F.count("*").alias("need"))  # one row
    g = scores.where(F.col("score") >= least).join(chosen, "doc_id", "left_semi").groupBy("domain").agg(F.count_distinct("doc_id").alias("have"), F.avg("score").alias("mean"))
    all_of = g.join(F.broadcast(n)).where("have = need").select("domain", F.round("mean", 6).alias("mean"))
    size = all_of.agg(F.count("*").alias("k"))  # one row
    return all_of.join(F.broadcast(size)).select("domain", "mean", F.col("k").between(low, high).alias("valid"))


def domain_overlaps(scores: DataFrame, groups: DataFrame, group: str, least: float = 0.1, low: int = 2, high: int = 3) -> DataFrame:
    """(group, domain, mean, valid) of every group of papers (group, doc_id): the domains significant in all of its papers."""
    g = groups.select(group, "doc_id").distinct()
    need = g.groupBy(group).agg(F.count("*").alias("need"))
    have = g.join(scores.where(F.col("score") >= least).hint("merge"), "doc_id").groupBy(group, "domain").agg(F.count("*").alias("have"), F.avg("score").alias("mean"))
    shared = have.join(need.hint("merge"), group).where("have = need")
    return shared.select(group, "domain", F.round("mean", 6).alias("mean"), F.count("*").over(Window.partitionBy(group)).between(low, high).alias("valid"))


def combined_vector(scores: DataFrame, k: int = 10) -> DataFrame:
    """(domain, mean, variance): population variance over papers, best first."""
    return scores.groupBy("domain").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.var_pop("score"), 6).alias("variance")).orderBy(F.desc("mean"), "domain").limit(k)


def domain_clusters(scores: DataFrame, least: float = 0.1, papers: int = 1) -> DataFrame:
    """(domain, degree): papers whose score reaches ``least``, for domains with enough of them."""
    return scores.where(F.col("score") >= least).groupBy("domain").agg(F.count_distinct("doc_id").alias("degree")).where(F.col("degree") >= papers)


def overlapping_set(scores: DataFrame, primary: DataFrame, n: int = 5, least: float = 0.1, low: int = 2, high: int = 3) -> DataFrame:
    """(primary_domain, doc_id): the first n papers of the first primary domain whose overlap is valid.

    primary is (doc_id, primary_domain).  All primary domains with n papers are judged in one job.
    """
    few = first_n(primary, ["primary_domain"], [F.asc("doc_id")], n)
    enough = few.groupBy("primary_domain").agg(F.count("*").alias("have")).where(F.col("have") == n).select("primary_domain")
    few = few.join(enough, "primary_domain", "left_semi")
    shared = scores.where(F.col("score") >= least).join(few, "doc_id").groupBy("primary_domain", "domain").agg(F.count_distinct("doc_id").alias("m")).where(F.col("m") == n)
    valid = shared.groupBy("primary_domain").agg(F.count("*").alias("k")).where(F.col("k").between(low, high))
    first = valid.agg(F.min("primary_domain").alias("primary_domain"))  # one row
    return few.join(F.broadcast(first), "primary_domain").select("primary_domain", "doc_id")


def keyword_species(keywords: DataFrame, k: int = 50) -> DataFrame:
    """(keyword, papers): keywords of two words or more that start with a capital, by papers; from (doc_id, keyword)."""
    named = keywords.where((F.size(F.split("keyword", " ")) >= 2) & F.col("keyword").rlike(r"^\p{Lu}"))
    return named.groupBy("keyword").agg(F.count_distinct("doc_id").alias("papers")).orderBy(F.desc("papers"), "keyword").limit(k)


def keyword_links(keywords: DataFrame, k: int = 50) -> DataFrame:
    """(a, b, papers): pairs of the ``k`` most frequent keyword species by the papers they share."""
    top = keyword_species(keywords, k).select("keyword")
    of = keywords.select("doc_id", "keyword").distinct().join(F.broadcast(top), "keyword")  # k rows
    pairs = of.withColumnRenamed("keyword", "a").join(of.withColumnRenamed("keyword", "b").hint("merge"), "doc_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("papers"))


def entities_of_heads(entities: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, name, section, chunks): entities of a document's first n chunks, with the section first seen in.

    entities is (doc_id, chunk_idx, section, name).
    """
    head = entities.where(F.col("chunk_idx") < n)
    return head.groupBy("doc_id", "name").agg(F.min_by(F.coalesce("section", F.lit("General")), "chunk_idx").alias("section"), F.count_distinct("chunk_idx").alias("chunks"))


def parent_text(df: DataFrame) -> DataFrame:
    """(doc_id, text): header lines, abstract, sections with their headings (else the text), tables, in one text.

    df is (doc_id, title, authors[], year, abstract, text, sections[], tables[]).
    """
    line = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.array(F.concat(F.lit(name), c.cast("string")))).otherwise(F.array().cast("array<string>"))
    rule = lambda mark: F.lit(f"\n{mark * 80}\n")
    sections = F.flatten(F.transform("sections", lambda s: F.array(F.concat(F.lit("\n"), F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["title"], F.lit("\n")), s["text"])))
    caption = lambda t: F.when(F.coalesce(t["caption"], F.lit("")) != "", F.array(F.concat(F.lit(": "), t["caption"]))).otherwise(F.array().cast("array<string>"))
    filled = F.filter("tables", lambda t: F.coalesce(t["markdown"], F.lit("")) != "")
    tables = F.flatten(F.transform(filled, lambda t: F.concat(F.array(F.concat(F.lit("\nTable "), t["table_id"])), caption(t), F.array(F.concat(F.lit("\n"), t["markdown"], F.lit("\n"))))))
    nothing = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit("")))),
        line("AUTHORS: ", F.array_join("authors", ", ")),
        line("YEAR: ", F.col("year")),
        F.array(rule("=")),
        F.when(F.coalesce("abstract", F.lit("")) != "", F.array(F.lit("ABSTRACT\n"), F.col("abstract"), rule("-"))).otherwise(nothing),
        F.when(F.size("sections") > 0, sections).otherwise(F.array(F.coalesce("text", F.lit("")))),
        F.when(F.size("tables") > 0, F.concat(F.array(F.lit("\n" + "=" * 80 + "\nTABLES\n")), tables)).otherwise(nothing),
    )
    return df.select("doc_id", F.array_join(parts, "\n").alias("text"))


def indexed_papers(df: DataFrame, classes: DataFrame, studies: DataFrame) -> DataFrame:
    """(doc_id, title, year, primary_domain, confidence, study_type): what the paper table holds of a document.

    ``df`` may have a column name, the file's: where the text has no title, title and year are the name's, and only
    where that has no year the text's.
    """
    title, year = C.title_of("text"), C.year_in("text")
    if "name" in df.columns:
        year = F.coalesce(F.when(title.isNull(), C.year_of_filename("name")), year)
        title = F.coalesce(title, C.title_from_filename("name"))
    base = df.select("doc_id", F.coalesce(title, F.lit("Untitled")).alias("title"), year.alias("year"))
    return base.join(classes.select("doc_id", "primary_domain", "confidence").hint("merge"), "doc_id", "left").join(studies.select("doc_id", "study_type").hint("merge"), "doc_id", "left")
