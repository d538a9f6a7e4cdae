"""Cross-domain links, cascades, hypotheses and knowledge gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.tables import cut, first_n

DEFAULT_AFFINITY = 0.3
TEMPLATES = {
    "shared_entity": "%s is studied in %s and in %s; findings may carry over.",
    "semantic_bridge": "%s connects passages of %s and %s with similar content.",
    "cascade": "Effects on %s may pass through relations from %s to %s.",
}


def affinity(pairs: DataFrame, table: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with their affinity: 1 on equal domains, the table's score in either order, else the default.

    The table (a, b, score) is configuration: a few dozen rows.
    """
    both = table.select("a", "b", "score").unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    both = both.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.max("score").alias("__s"))
    j = pairs.join(both.hint("merge"), (pairs[a] == both["__a"]) & (pairs[b] == both["__b"]), "left")
    score = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce("__s", F.lit(DEFAULT_AFFINITY)))
    return j.withColumn("affinity", score).drop("__a", "__b", "__s")


def link_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def shared_links(studied: DataFrame, table: DataFrame, min_domains: int = 2) -> DataFrame:
    """Links of entities studied in several domains: every pair of domains, with their papers counted.

    studied is (entity, domain, doc_id).
    """
    g = studied.groupBy("entity", "domain").agg(F.count_distinct("doc_id").alias("papers"))
    n = g.withColumn("domains", F.count("*").over(Window.partitionBy("entity"))).where(F.col("domains") >= min_domains)
    x = n.select("entity", F.col("domain").alias("a"), F.col("papers").alias("source_papers"))
    y = n.select("entity", F.col("domain").alias("b"), F.col("papers").alias("target_papers"))
    pairs = affinity(x.join(y, "entity").where("a < b"), table)
    return pairs.withColumns({"link_type": F.lit("shared_entity"), "link_id": link_id(F.lit("shared_entity"), F.col("entity").cast("string"), F.col("a"), F.col("b"))})


def multi_domain(studied: DataFrame, k: int = 20, least: int = 2) -> DataFrame:
    return studied.groupBy("entity").agg(F.count_distinct("domain").alias("domains")).where(F.col("domains") >= least).orderBy(F.desc("domains"), "entity").limit(k)


def semantic_bridges(source: DataFrame, target: DataFrame, chunks: int = 10, least: float = 0.7, k: int = 5) -> DataFrame:
    """(chunk_id, doc_id, other_chunk, other_doc, score): nearest target chunk of the first source chunks, one per pair of papers."""
    few = source.orderBy("chunk_id").limit(chunks).select(F.col("chunk_id").alias("c"), F.col("doc_id").alias("d"), F.col("embedding").alias("q"))
    pairs = target.join(F.broadcast(few), how="cross").where("doc_id <> d").withColumn("score", F.round(C.cosine(F.col("embedding"), F.col("q")), 6)).where(F.col("score") >= least)
    best = first_n(pairs.select("c", "d", "chunk_id", "doc_id", "score"), ["c"], [F.desc("score"), F.asc("chunk_id")], 1)
    once = first_n(best, ["d", "doc_id"], [F.desc("score"), F.asc("c")], 1)
    return once.orderBy(F.desc("score"), "c").limit(k).select(F.col("c").alias("chunk_id"), F.col("d").alias("doc_id"), F.col("chunk_id").alias("other_chunk"), F.col("doc_id").alias("other_doc"), "score")


def breadth(studied: DataFrame) -> DataFrame:
    """(entity, domains, papers): in how many different domains and papers each entity is studied."""
    return studied.groupBy("entity").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("doc_id").alias("papers"))


def cascades(relations: DataFrame, studied: DataFrame, start: int, max_depth: int = 3, least: int = 2, limit: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(path, depth, domains, papers): chains of 1 to max_depth relations, in either direction, from an entity to one of several domains.

    No relation occurs twice in a chain; parallel relations between the same entities give one chain.  ``limit`` is
    the size of a report: the shortest chains, then by path; longer ones are then not made once there are enough.
    ``known`` is the breadth of ``studied`` where that is stored.
    """
    e = relations.select("subject", "object", "type").distinct().withColumn("edge", F.xxhash64("subject", "object", "type"))
    both = e.select(F.col("subject").alias("at"), F.col("object").alias("to"), "edge").unionByName(e.where("subject <> object").select(F.col("object").alias("at"), F.col("subject").alias("to"), "edge"))
    spread = (breadth(studied) if known is None else known).where(F.col("domains") >= least)
    paths = both.where(F.col("at") == start).select(F.array("at", "to").alias("path"), F.array("edge").alias("edges"))
    found = None
    for depth in range(1, max_depth + 1):
        if depth > 1:
            step = paths.withColumn("at", F.element_at("path", -1)).join(both.hint("merge"), "at").where(~F.array_contains("edges", F.col("edge")))
            paths = step.select(F.concat("path", F.array("to")).alias("path"), F.concat("edges", F.array("edge")).alias("edges"))
        ends = paths.select("path").distinct().withColumn("entity", F.element_at("path", -1)).join(spread.hint("merge"), "entity")
        ends = ends.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.lit(depth).alias("depth"), "domains", "papers")
        found = ends if found is None else found.unionByName(ends)
        if limit and depth < max_depth and found.limit(limit).count() == limit:
            break
    return found.orderBy("depth", "path").limit(limit) if limit else found


def hypotheses(links: DataFrame) -> DataFrame:
    """Rule-based statements of links (link_id, link_type, entity, a, b, affinity): score = the link's affinity."""
    text = F.lit(None).cast("string")
    for kind, template in TEMPLATES.items():
        text = F.when(F.col("link_type") == kind, F.format_string(template, F.col("entity").cast("string"), "a", "b")).otherwise(text)
    return links.select(F.substring(F.md5(F.concat(F.lit("h:"), F.col("link_id"))), 1, 12).alias("hypothesis_id"), F.col("link_type").alias("type"), text.alias("statement"), F.lit("medium").alias("level"), F.col("affinity").alias("score"))


def hypothesis_batch(links: DataFrame, n: int = 10) -> DataFrame:
    return hypotheses(links.orderBy("link_id").limit(n)).orderBy(F.desc("score"), "hypothesis_id")


def hypothesis_markdown(h: DataFrame) -> DataFrame:
    line = F.concat_ws("\n", F.concat(F.lit("### "), F.col("type")), "statement", F.format_string("Confidence: %.2f (%s)", "score", "level"))
    return h.select("hypothesis_id", line.alias("markdown"))


def hypothesis_report(h: DataFrame) -> DataFrame:
    """(type, n, statement): every statement with the number of its type; write it partitioned by type, sorted inside."""
    n = h.groupBy("type").agg(F.count("*").alias("n"))  # one row for each type of link
    return h.select("type", "statement").join(F.broadcast(n), "type").select("type", "n", "statement")


def knowledge_gaps(entities: DataFrame, domains: DataFrame, studied: DataFrame) -> DataFrame:
    """(entity, covered, missing): in how many of the domains an entity is studied and in how many it is not.

    The grid of entities and domains is not made: what is missing is all that ``studied`` (entity, domain) does not list.
    """
    wanted = domains.select("domain").distinct()
    total = wanted.agg(F.count("*").alias("total"))  # one row
    have = studied.select("entity", "domain").distinct().join(wanted.hint("merge"), "domain").groupBy("entity").agg(F.count("*").alias("covered"))
    out = entities.select("entity").distinct().join(have.hint("merge"), "entity", "left").join(F.broadcast(total))
    covered = F.coalesce("covered", F.lit(0)).cast("long")
    return out.select("entity", covered.alias("covered"), (F.col("total") - covered).alias("missing")).where("missing > 0")


def gaps_of_kinds(entities: DataFrame, **kinds: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, entity, covered, missing): knowledge_gaps of several kinds, each given as (what there is, what is known).

    For instance domains, types of measurement and places: kind=(names (domain), known (entity, domain)).
    """
    parts = [knowledge_gaps(entities, names, known).select(F.lit(kind).alias("kind"), "entity", "covered", "missing") for kind, (names, known) in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def bounded(df: DataFrame, most: int = 1_000) -> DataFrame:
    """``df``, checked to be a list of configuration: more than ``most`` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a list of at most {most} rows is expected")
    return df


def domain_pairs(domains: DataFrame) -> DataFrame:
    """(a, b): all ordered pairs of a bounded list of domains, also of equal ones."""
    d = bounded(domains.select("domain").distinct())
    return d.select(F.col("domain").alias("a")).join(F.broadcast(d.select(F.col("domain").alias("b"))), how="cross")


def topic_links(domains: DataFrame, table: DataFrame) -> DataFrame:
    """All pairs of a bounded list of domains with affinity and its label."""
    return affinity(domain_pairs(domains).where("a < b"), table).withColumn("strength", C.affinity_label("affinity"))


def capped(links: DataFrame, n: int) -> DataFrame:
    """The n strongest links of every type: a report's limit."""
    return first_n(links, ["link_type"], [F.desc("affinity"), F.asc("link_id")], n)


def discover(studied: DataFrame, table: DataFrame, relations: DataFrame | None = None, entities: int = 20, started: int = 5, per_type: int = 10) -> DataFrame:
    """(link_type, link_id, affinity): links of the entities in most domains, strongest first per type.

    Shared-entity links of the first ``entities``; with relations, also the cascades of the first ``started``.
    """
    if relations is None:
        widest = lambda k: multi_domain(studied, k)
    else:  # stored, since every chain asks for both
        known, relations = cut(breadth(studied)), cut(relations.select("subject", "object", "type").distinct())
        widest = lambda k: known.where("domains >= 2").orderBy(F.desc("domains"), "entity").limit(k)
    top = widest(entities).select("entity")
    out = shared_links(studied.join(F.broadcast(top), "entity", "left_semi"), table).select("link_type", "link_id", "affinity")
    if relations is not None:
        for r in widest(started).select("entity").collect():  # a report's few entities
            chains = cascades(relations, studied, r["entity"], limit=per_type, known=known)
            out = out.unionByName(chains.select(F.lit("cascade").alias("link_type"), link_id(F.lit("cascade"), F.col("path")).alias("link_id"), F.lit(0.5).alias("affinity")))
    return capped(out, per_type)
