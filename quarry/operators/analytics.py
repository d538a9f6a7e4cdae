"""Graph analytics: similarity and co-occurrence graphs, centralities, hops, components, communities.

Iterative operators keep two id columns and a number, cut their lineage through checkpoints in the shared
folder every round or few, and bring one scalar per round to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.operators import packed as P
from quarry.operators.packed import added
from quarry.operators.tables import cut, first_n, place_of, released, sized


def paper_similarity(domains: DataFrame, keywords: DataFrame | None = None, least: float = 0.55, bonus: float = 0.1, paper: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): Jaccard of the domain sets plus ``bonus`` per shared keyword, at least ``least``.

    domains is (doc_id, domain), keywords (doc_id, keyword).  Papers are grouped by their whole domain set
    first, so papers of one set are compared as a set, and set pairs meet on a shared domain; pairs that share
    no domain reach ``least`` by keywords only if keywords are given.  ``paper`` restricts the left side.
    """
    d = domains.select("doc_id", "domain").distinct()
    sets = d.groupBy("doc_id").agg(F.sort_array(F.collect_set("domain")).alias("s"))
    kinds = sets.groupBy("s").agg(F.count("*").alias("n")).select("s")
    a = kinds.withColumn("domain", F.explode("s"))
    pairs = a.withColumnRenamed("s", "sa").join(a.withColumnRenamed("s", "sb").hint("merge"), "domain").select("sa", "sb").distinct()
    jac = pairs.withColumn("j", F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb")))
    left = sets if paper is None else sets.join(paper.select("doc_id"), "doc_id", "left_semi")
    if keywords is None:
        jac = jac.where(F.col("j") >= least)
    rows = left.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")).join(jac.hint("merge"), "sa").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")).hint("merge"), "sb")
    rows = rows.where("a < b" if paper is None else "a <> b").select("a", "b", "j")
    if keywords is not None:
        shared = shared_keywords(keywords, paper).where("a < b" if paper is None else "a <> b")
        rows = rows.join(shared.hint("merge"), ["a", "b"], "full_outer").withColumn("j", F.coalesce("j", F.lit(0.0)) + F.lit(bonus) * F.coalesce("k", F.lit(0)))
    return rows.where(F.col("j") >= least).select("a", "b", F.round("j", 6).alias("similarity"))


def shared_keywords(keywords: DataFrame, paper: DataFrame | None = None) -> DataFrame:
    """(a, b, k): papers by the keywords they share; ``paper`` restricts a before anything is paired."""
    k = keywords.select("doc_id", "keyword").distinct()
    own = k if paper is None else k.join(paper.select("doc_id").hint("merge"), "doc_id", "left_semi")
    pairs = own.withColumnRenamed("doc_id", "a").join(k.withColumnRenamed("doc_id", "b").hint("merge"), "keyword").where("a <> b" if paper is not None else "a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("k"))


def lifted_pairs(domains: DataFrame, keywords: DataFrame, least: float = 0.55, bonus: float = 0.1) -> DataFrame:
    """(a, b, similarity): paper pairs that reach ``least`` by shared keywords alone or on top of their domains.

    With similarity_classes, which holds all pairs that reach it by domains, this is the whole similarity graph.
    Papers meet on a keyword with all their keywords and domains at hand, so a pair is settled where it meets: the first
    keyword that both have gives it, and nothing but the result is stored or counted per pair.
    """
    d = domains.select("doc_id", "domain").where("domain is not null").distinct()
    names = cut(d.select("domain").distinct().select("domain", F.monotonically_increasing_id().alias("d")))  # short names
    bits = lambda c: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int")))
    sets = d.join(sized(names), "domain").groupBy("doc_id").agg(F.collect_set("d").alias("s"), bits("d").alias("sbits"))
    own = keywords.select("doc_id", "keyword").where("keyword is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("keyword")).alias("k"), bits("keyword").alias("kbits"))
    papers = own.join(sets.hint("merge"), "doc_id", "left").select("doc_id", "k", "kbits", F.coalesce("s", F.array().cast("array<bigint>")).alias("s"), F.coalesce("sbits", F.lit(0)).alias("sbits"))
    rows = papers.select("doc_id", "k", "kbits", "s", "sbits", F.posexplode("k").alias("place", "keyword"))
    a, b = (rows.select("keyword", *[F.col(c).alias(c + x) for c in rows.columns if c != "keyword"]) for x in "ab")
    pairs = a.join(b.hint("merge"), "keyword").where("doc_ida < doc_idb")
    jac = lambda n: F.coalesce(F.try_divide(n, F.size("sa") + F.size("sb") - n), F.lit(0.0))
    whole = lambda j, k: F.round(j + F.lit(bonus) * k, 6)
    # a bit that one has alone is at least one member that the other lacks; before the first shared keyword they share none
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    common = lambda c: F.least(F.size(f"{c}a") - lacks(f"{c}bitsa", f"{c}bitsb"), F.size(f"{c}b") - lacks(f"{c}bitsb", f"{c}bitsa"))
    most = F.least(common("k"), F.size("ka") - F.col("placea"), F.size("kb") - F.col("placeb"))
    j, both = jac(F.size(F.array_intersect("sa", "sb"))), F.array_intersect("ka", "kb")
    pairs = pairs.where(jac(common("s")) + F.lit(bonus) * most >= least - 1e-6).where((j < least) & (j + F.lit(bonus) * most >= least - 1e-6))
    pairs = pairs.where((F.get(both, 0) == F.col("keyword")) & (whole(j, F.size(both)) >= least))
    return pairs.select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b"), whole(j, F.size(both)).alias("similarity"))


def similarity_classes(domains: DataFrame, least: float = 0.55) -> DataFrame:
    """(class_a, class_b, papers_a, papers_b, similarity): the similarity graph over classes of equal domain sets.

    All papers of class_a are similar to all of class_b (within a class with similarity 1), so this holds every
    edge of the paper graph in rows that grow with the number of distinct sets, not with the pairs of papers.
    """
    sets = domains.select("doc_id", "domain").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("domain")).alias("s"))
    kinds = sets.groupBy("s").agg(F.count("*").alias("papers"))
    rows = kinds.select("s", "papers", F.explode("s").alias("domain"))
    n = rows.groupBy("domain").agg(F.count("*").alias("n"))
    rare = rows.join(n.hint("merge"), "domain").groupBy("s", "papers").agg(F.sort_array(F.collect_list(F.struct("n", "domain"))).alias("r"))
    # sets as similar as that share one of their rarest domains: all but ceil(least * size) and one more
    x = rare.select("s", "papers", F.explode(F.slice("r", 1, (F.size("s") - F.ceil(F.size("s") * least - 1e-9) + 1).cast("int"))).alias("e")).select("s", "papers", "e.domain")
    a, b = (x.withColumnsRenamed({"s": f"s{i}", "papers": f"papers_{i}"}) for i in "ab")
    near = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * (least - 1e-9)
    pairs = a.join(b.hint("merge"), "domain").where(near).drop("domain").distinct()
    name = {i: F.array_join(f"s{i}", ",") for i in "ab"}
    j = F.round(F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb")), 6)
    return pairs.select(name["a"].alias("class_a"), name["b"].alias("class_b"), "papers_a", "papers_b", j.alias("similarity")).where("class_a <= class_b").where(F.col("similarity") >= least)


def concept_graph(concepts: DataFrame, least: int = 2, samples: int = 5) -> DataFrame:
    """(a, b, papers, sample): concept pairs of one paper with enough papers, the smallest ids as a sample."""
    d = concepts.select("doc_id", "concept").distinct()
    pairs = d.withColumnRenamed("concept", "a").join(d.withColumnRenamed("concept", "b"), "doc_id").where("a < b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("papers")).where(F.col("papers") >= least)
    few = pairs.join(counts.select("a", "b").hint("merge"), ["a", "b"], "left_semi")
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("doc_id"))).where(F.col("n") <= samples)
    few = few.groupBy("a", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return counts.join(few.hint("merge"), ["a", "b"])


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (a, b[, w]) without loops and repeats; weights of repeats add up."""
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    both = e.select("a", "b", "w").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b")
    return both.groupBy("a", "b").agg(F.sum("w").alias("w")) if "w" in edges.columns else both.distinct()


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): neighbours over n - 1; isolated nodes have 0."""
    deg = undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    n = nodes.agg((F.count("*") - 1).alias("others"))  # one row
    out = nodes.select("node").join(deg, "node", "left").na.fill(0, ["degree"]).join(F.broadcast(n))
    return out.select("node", "degree", F.round(F.when(F.col("others") > 0, F.col("degree") / F.col("others")).otherwise(0.0), 9).alias("centrality"))


def k_hop_edges(relations: DataFrame, start: int, k: int = 2) -> DataFrame:
    """Relations on undirected paths of at most k edges from a node: those with an end at distance < k."""
    near = relations.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"))
    for _ in range(k - 1):
        out = relations.join(near, relations["subject"] == near["node"]).select(F.col("object").alias("node"))
        back = relations.join(near, relations["object"] == near["node"]).select(F.col("subject").alias("node"))
        near = near.unionByName(out).unionByName(back).distinct()
    hit = relations.join(near.withColumnRenamed("node", "subject"), "subject", "left_semi").unionByName(relations.join(near.withColumnRenamed("node", "object"), "object", "left_semi").select(*relations.columns))
    return hit.select("subject", "object", "type").distinct()


def k_hop_edges_of(relations: DataFrame, starts: DataFrame, k: int = 2) -> DataFrame:
    """(start, subject, object, type): k_hop_edges of every node of ``starts`` (node), all starts advancing together."""
    near = distances(relations.select(F.col("subject").alias("a"), F.col("object").alias("b")), starts.select("node").distinct(), k - 1).select(F.col("source").alias("start"), "node")
    ends = relations.select("subject", "object", "type").distinct().select("*", F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"))
    return ends.join(near.hint("merge"), "node").select("start", "subject", "object", "type").distinct()


def distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, d) for all nodes within ``hops`` of each source over undirected edges (a, b)."""
    e = undirected(edges).select("a", "b")
    seen = sources.select(F.col("node").alias("source"), "node").withColumn("d", F.lit(0))
    front = seen
    for d in range(1, hops + 1):
        step = front.join(e, front["node"] == e["a"]).select("source", F.col("b").alias("node")).distinct()
        front = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("d", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def ego_network(edges: DataFrame, node: str, hops: int) -> DataFrame:
    """(a, b, type) edges among the nodes within ``hops`` of one node of a typed graph."""
    near = distances(edges, edges.sparkSession.createDataFrame([(node,)], "node string"), hops).select("node").distinct()
    return edges.join(near.withColumnRenamed("node", "a"), "a", "left_semi").join(near.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "type").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node of each connected component, by contraction.

    In a round every node joins that of its neighbours and itself which comes first by a hash of the round, and edges
    between what has joined are edges of the next round.  A constant share of the nodes goes in each round whatever their
    ids, so all rounds together read and store a small multiple of the edges.  Names then go back from the last round on.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not e.isEmpty():
        order = lambda x: F.xxhash64(F.lit(len(rounds)), x)
        first = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        to = cut(first.select(F.col("a").alias("node"), F.when(order("a") < order("b"), F.col("a")).otherwise(F.col("b")).alias("to")))
        rounds.append(to)
        ends = [sized(to.select(F.col("node").alias(x), F.col("to").alias(f"to{x}"))) for x in "ab"]
        met = e.join(ends[0], "a").join(ends[1], "b").where("toa <> tob")
        last, e = e, cut(met.select(F.least("toa", "tob").alias("a"), F.greatest("toa", "tob").alias("b")).distinct())
        released(last)
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("a").alias("component"))
    names = rounds.pop()
    while rounds:
        to, last = rounds.pop(), names
        names = cut(to.join(sized(last.select(F.col("node").alias("to"), F.col("to").alias("end"))), "to", "left").select("node", F.coalesce("end", "to").alias("to")))
        released(to, last)
    return names.join(names.groupBy("to").agg(F.min("node").alias("component")).hint("merge"), "to").select("node", "component")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) over directed edges (a, b[, w]); ranks sum to 1, dangling mass is spread evenly.

    Ends when a round moves less than ``tolerance`` in all.  A round moves ``damping`` times what the last one moved
    at most, which bounds their number; a tolerance below the rounding of doubles is met by none and is an error.
    """
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    e = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = cut(e.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("a"))).select("a", "b", "share"), "a")
    nodes = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    n = nodes.count()
    dangling = nodes.join(e.select(F.col("a").alias("node")), "node", "left_anti").withColumn("open", F.lit(True))
    nodes = cut(nodes.join(dangling, "node", "left").select("node", F.coalesce("open", F.lit(False)).alias("open")))
    ranks, old = nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), []
    for _ in range(math.ceil(math.log(tolerance / 2, damping)) + 3):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("open"), F.col("rank"))), F.lit(0.0)).alias("lost"))  # one row
        sent = e.join(ranks.select(F.col("node").alias("a"), "rank"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        new = cut(ranks.select("node", "open", F.col("rank").alias("last")).join(sent, "node", "left").join(F.broadcast(lost)).select("node", "open", rank.alias("rank"), "last"))
        released(*old)
        old, ranks = [new], new.select("node", "open", "rank")
        if (new.agg(F.sum(F.abs(F.col("rank") - F.col("last")))).first()[0] or 0.0) < tolerance:
            return ranks.select("node", "rank")
    raise RuntimeError("ranks still move by more than the tolerance")


def label_propagation(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, community): a node takes the label of largest summed weight around it, ties to its own, then the smallest.

    In a round only nodes of one parity of a hash change, so that neighbours do not swap for ever; it ends when a
    round of either parity changes nothing.  Labels that still move after ``rounds`` rounds are an error.
    """
    pairs = pairs_of(edges)
    if isinstance(pairs.schema["a"].dataType, LongType):
        return _packed_labels(pairs, rounds)
    return _joined_labels(pairs, rounds)


def _packed_labels(pairs: DataFrame, rounds: int) -> DataFrame:
    """(node, community) by the rounds of label_propagation over packed rows, which no round shuffles."""
    g = P.graph(pairs, cut, place_of)
    ids, n = g.ids, g.n

    def votes(now: list[str], r: int):
        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label, nodes = P.followed(now, n), P.ids_of(ids)
            for _, x, y, w in P.each(batches):
                node, to, v = added(x, label[y], w, n)
                if not len(node):
                    continue
                best = largest_of(node, v)  # all of equal weight, by node and label
                node, to = node[best], to[best]
                first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                stays = np.add.reduceat((to == label[node]).astype(int), first) > 0
                node, to = node[first], to[first]
                goes = ~stays & (xxhash64(nodes[node], r // 2) % 2 == r % 2)
                new = np.where(goes, to, label[node])
                off = new != node
                yield P.row(node=P.put(node[off]), to=P.put(new[off]), moved=int(goes.sum()))

        return vote

    still, now, last = 0, [], None
    for r in range(rounds):
        new = cut(g.rows.mapInArrow(votes(now, r), "node binary, to binary, moved long"))
        now = [place_of(new)]
        still = 0 if new.agg(F.sum("moved")).first()[0] else still + 1
        if last is not None:
            released(last)
        last = new
        if still >= 2 and r % 2:  # both parities of one dealing
            return P.named(g, pairs.sparkSession, now)
    raise RuntimeError(f"labels still move after {rounds} rounds")


def _joined_labels(pairs: DataFrame, rounds: int) -> DataFrame:
    """(node, community) by the rounds of label_propagation, through joins."""
    e = cut(pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "b")
    labels = cut(e.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    still, old = 0, [labels]
    for r in range(rounds):
        votes = e.join(labels.withColumnsRenamed({"node": "b"}).hint("merge"), "b").groupBy("a", "label").agg(F.sum("w").alias("v"))
        mine = votes.join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")).hint("merge"), "a")
        order = F.struct(-F.col("v"), F.col("label") != F.col("own"), "label")
        best = mine.groupBy(F.col("a").alias("node")).agg(F.min_by("label", order).alias("to"))
        moves = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        new = cut(labels.join(best.hint("merge"), "node").select("node", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label"), (moves & (F.col("to") != F.col("label"))).alias("moved")))
        released(*old)
        old, labels = [new], new.select("node", "label")
        still = still + 1 if new.where("moved").isEmpty() else 0
        if still >= 2 and r % 2:  # both parities of one dealing
            return labels.select("node", F.min("node").over(Window.partitionBy("label")).alias("community"))
    raise RuntimeError(f"labels still move after {rounds} rounds")


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Newman modularity of a partition (node, community)."""
    e = undirected(edges)
    c = communities.select(F.col("node"), F.col("community"))
    j = e.join(c.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    total = e.agg(F.sum("w")).first()[0] or 1.0
    inside = j.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = j.groupBy("ca").agg(F.sum("w").alias("d")).agg(F.sum((F.col("d") / total) ** 2)).first()[0] or 0.0
    return inside / total - squares


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b, w) between the groups (node, c) of their ends; weights add up, what lies within a group is its loop."""
    ends = [groups.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")).hint("merge") for x in "ab"]
    return edges.join(ends[0], "a").join(ends[1], "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))


def local_moves(level: DataFrame, labels: DataFrame, total: float, least: float = 1e-4, smallest: int = 8) -> DataFrame:
    """(node, c): communities after rounds of moves from ``labels`` (node, c) on; level is (a, b, w) in both directions.

    In a round every node computes the gain of joining each neighbouring community; of those that gain one in two by hash
    moves.  A round that raises modularity by less than ``least`` is taken back; then only moves go that are the best of
    both communities they touch, whose gains add up exactly, and after them half as many as before by hash, at last
    (one in ``smallest``) none.  It ends when no node gains or the exact moves raise less than ``least``, so every round
    that counts raises modularity and the rounds end by themselves.
    """
    now = cut(level.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(labels.hint("merge"), "node").select("node", "k", "c"))
    best, reached, part, exact = None, 0.0, 2, False
    for r in itertools.count():
        ends = now.select(F.col("node").alias("b"), "c").hint("merge")
        near = level.where("a <> b").join(ends, "b").select(F.col("a").alias("node"), "c", "w").unionByName(now.select("node", "c", F.lit(0.0).alias("w")))
        near = near.groupBy("node", "c").agg(F.sum("w").alias("kin")).join(now.groupBy("c").agg(F.sum("k").alias("tot")).hint("merge"), "c")
        near = near.join(now.select("node", "k", F.col("c").alias("own")).hint("merge"), "node")
        at = F.col("c") == F.col("own")
        near = near.withColumn("gain", F.col("kin") - F.col("k") * (F.col("tot") - F.when(at, F.col("k")).otherwise(0.0)) / total)
        step = near.groupBy("node", "k", F.col("own").alias("c")).agg(F.max_by("c", F.struct("gain", "c")).alias("to"), F.max("gain").alias("top"), F.max(F.when(at, F.col("gain"))).alias("stay"), F.max(F.when(at, F.col("kin"))).alias("kin"))
        step = cut(step.select("node", "k", "c", F.when(F.col("top") > F.col("stay") + 1e-9, F.col("to")).alias("to"), (F.col("top") - F.col("stay")).alias("up"), "kin"))
        within, waiting = step.agg(F.sum("kin"), F.count("to")).first()
        squares = step.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
        height = within / total - squares / total**2
        if best is None or height >= reached + least:
            released(now if best is None else best)
            best, reached, exact = step, height, part > smallest
            if not waiting:
                return best.select("node", "c")
        else:
            released(step)
            if exact:
                return best.select("node", "c")
            exact, part = True, part * 2
        wish = best.where("to is not null")
        if exact:
            touched = wish.select("node", "up", F.explode(F.array("c", "to")).alias("g")).groupBy("g").agg(F.max_by("node", F.struct("up", "node")).alias("node"))
            wish = wish.join(touched.groupBy("node").count().where("count = 2").hint("merge"), "node", "left_semi")
        else:
            wish = wish.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(part)) == 0)
        now = best.select("node", "k", "c").join(wish.select("node", "to").hint("merge"), "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"))


def merged(level: DataFrame, total: float, within: DataFrame | None = None) -> DataFrame:
    """(node, c): nodes of (a, b, w), in both directions, merged with neighbours while modularity rises.

    A group's best partner is the neighbour whose merger gains most.  In a round half of the groups by hash stay, the
    others join their best partner if that one stays; of those that ask one group, in the order of gain, each joins
    that still gains once all before it have joined.  Mergers of a round that share no group add up exactly, so every
    one raises modularity, and a hub takes in many in one round.  Only neighbours merge, hence groups are connected.
    It ends when no two neighbours gain.  With ``within`` (node, c) only nodes of one community merge.
    """
    size = cut(level.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    inner = level.where("a <> b")
    if within is not None:
        ends = [within.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")).hint("merge") for x in "ab"]
        inner = inner.join(ends[0], "a").join(ends[1], "b").where("ca = cb").select("a", "b", "w")
    inner = cut(inner)
    member = cut(size.select("node", F.col("node").alias("c")))
    for r in itertools.count():
        k = [size.select(F.col("node").alias(x), F.col("k").alias(f"k{x}")).hint("merge") for x in "ab"]
        pairs = inner.join(k[0], "a").join(k[1], "b").withColumn("gain", F.col("w") - F.col("ka") * F.col("kb") / total).where("gain > 1e-9")
        order = F.struct("gain", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), "b")
        best = cut(pairs.groupBy(F.col("a").alias("node"), F.col("ka").alias("k")).agg(F.max_by(F.struct(F.col("b").alias("to"), F.col("kb").alias("host"), "w", "gain"), order).alias("p")).select("node", "k", "p.*"))
        if best.isEmpty():
            released(best, size, inner)
            return member
        stays = lambda x: F.pmod(F.xxhash64(x, F.lit(r)), F.lit(2)) == 0
        before = F.coalesce(F.sum("k").over(Window.partitionBy("to").orderBy(F.desc("gain"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        joins = best.where(~stays("node") & stays("to")).withColumn("rest", F.col("w") - F.col("k") * (F.col("host") + before) / total).where("rest > 1e-9").select("node", "to")
        groups = cut(size.select("node", "k").join(joins.hint("merge"), "node", "left").select("node", "k", F.coalesce("to", "node").alias("c")))
        old = (size, inner, member, best, groups)
        size = cut(groups.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")))
        inner = cut(contracted(inner, groups).where("a <> b"))
        member = cut(member.join(groups.select(F.col("node").alias("c"), F.col("c").alias("to")).hint("merge"), "c").select("node", F.col("to").alias("c")))
        released(*old)


def by_smallest(labels: DataFrame) -> DataFrame:
    """(node, community): the groups (node, c) called by their smallest member."""
    return labels.select("node", F.min("node").over(Window.partitionBy("c")).alias("community"))


def xxhash64(*values: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of longs, the arrays, and ints, the numbers; the first is an array."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.uint64(42)
    for v in values:
        if isinstance(v, int):
            h = turned((h + p5 + np.uint64(4)) ^ np.uint64(v * int(p1) % 2**64), 23) * p2 + p3
        else:
            h = turned((h + p5 + np.uint64(8)) ^ (turned(v.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def largest_of(x: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Places of the entries of largest gain for each x, all of equal ones; x is in order."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(np.r_[first, len(x)])))


def last_of(x: np.ndarray) -> np.ndarray:
    """Places of the last entry for each x; x is in order."""
    return np.flatnonzero(np.r_[x[1:] != x[:-1], True])


def better_places(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, k: np.ndarray, tot: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, community) of the nodes x that gain by a move from ``c``, each with the best; edges (x, y, w) are without loops."""
    n = len(c)
    node, to, kin = added(x, c[y], w, n)
    own = to == c[node]
    now = np.zeros(n)
    each = node[np.flatnonzero(np.r_[True, node[1:] != node[:-1]])] if len(node) else node
    now[each] = -k[each] * (tot[c[each]] - k[each]) / total
    at = node[own]
    now[at] = kin[own] - k[at] * (tot[c[at]] - k[at]) / total
    node, to, kin = node[~own], to[~own], kin[~own]
    if not len(node):
        return node, to
    gain = kin - k[node] * tot[to] / total
    best = largest_of(node, gain)
    best = best[last_of(node[best])]
    best = best[gain[best] > now[node[best]] + 1e-9]
    return node[best], to[best]


def moves_in_parts(nodes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, total: float, rounds: int, levels: int) -> np.ndarray:
    """The communities of louvain for parts of a graph that no other edge meets, as places in ``nodes``; x, y are places too."""
    n = len(nodes)
    member = np.arange(n)
    for _ in range(levels):
        k, c = np.bincount(x, w, n), np.arange(n)
        out = x != y
        if not out.any():
            break
        x1, y1, w1 = x[out], y[out], w[out]
        for r in range(rounds):
            node, to = better_places(x1, y1, w1, c, k, np.bincount(c, k, n), total)
            if not len(node):
                break
            goes = xxhash64(nodes[node], r) % (2 + r // 4) == 0
            c[node[goes]] = to[goes]
        if (c == np.arange(n)).all():
            break
        member = c[member]
        x, y, w = added(c[x], c[y], w, n)
    return member


def asked_mergers(nodes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, total: float, r: int) -> tuple[int, np.ndarray]:
    """How many of the edges (x, y, w), in order, gain by a merger, and the places of those by which x asks y to take it in."""
    gain = w - k[x] * k[y] / total
    near = np.flatnonzero(gain > 1e-9)
    if not len(near):
        return 0, near
    best = near[largest_of(x[near], gain[near])]
    tie = xxhash64(nodes[np.minimum(x[best], y[best])], nodes[np.maximum(x[best], y[best])])
    best = best[np.lexsort((y[best], tie, x[best]))]
    best = best[last_of(x[best])]
    stays = lambda i: xxhash64(nodes[i], r) % 2 == 0
    return len(near), best[~stays(x[best]) & stays(y[best])]


def granted(a: np.ndarray, b: np.ndarray, w: np.ndarray, ka: np.ndarray, kb: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of those that join, of all that ask the same b: in the order of gain, while it gains after all before."""
    order = np.lexsort((a, -(w - ka * kb / total), b))
    a, b, w, ka, kb = (v[order] for v in (a, b, w, ka, kb))
    if not len(a):
        return a, b
    before = np.cumsum(ka) - ka
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    before -= np.repeat(before[first], np.diff(np.r_[first, len(b)]))
    joins = w - ka * (kb + before) / total > 1e-9
    return a[joins], b[joins]


def mergers_in_parts(nodes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, total: float, k: np.ndarray | None = None, begin: int = 0) -> np.ndarray:
    """The groups of ``merged`` for parts of a graph that no other edge meets, as places in ``nodes``; x, y are places too.

    With ``k``, the weights of groups, it goes on from round ``begin``.
    """
    n = len(nodes)
    k, member = np.bincount(x, w, n) if k is None else k, np.arange(n)
    x, y, w = added(x, y, w, n)
    for r in itertools.count(begin):
        near, ask = asked_mergers(nodes, x, y, w, k, total, r)
        if not near:
            return member
        a, b = granted(x[ask], y[ask], w[ask], k[x[ask]], k[y[ask]], total)
        if not len(a):
            continue
        c = np.arange(n)
        c[a] = b
        k, member = np.bincount(c, k, n), c[member]
        x, y = c[x], c[y]
        out = x != y
        x, y, w = added(x[out], y[out], w[out], n)


def pairs_of(edges: DataFrame) -> DataFrame:
    """The different pairs (a, b, w), a < b, of a graph (a, b[, w]), stored; weights of repeats add up."""
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(["w"] if "w" in edges.columns else []))
    return cut(pairs.groupBy("a", "b").agg(F.sum("w").alias("w")) if "w" in edges.columns else pairs.distinct().withColumn("w", F.lit(1.0)))


def in_parts(edges: DataFrame, whole: Callable[..., np.ndarray], rounds: Callable[[DataFrame, float], DataFrame], joined: Callable[[DataFrame, float], DataFrame], largest: int) -> DataFrame:
    """(node, community), the smallest node of each group of an undirected graph (a, b[, w]) whose edges' ends alone decide.

    A graph of at most ``largest`` edges goes to a task whole, where ``whole`` gives groups from (nodes, x, y, w, total); a
    larger one goes by ``rounds`` over packed rows from (a, b, w) and the total weight to (node, community); nodes that
    are not longs go by ``joined`` from (a, b, w) in both directions and the total weight to (node, c).
    """
    pairs = pairs_of(edges)
    n, weight = pairs.agg(F.count("*"), F.sum("w")).first()
    total = 2 * (weight or 0.0)
    if not total:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node"))
    if not isinstance(pairs.schema["a"].dataType, LongType):
        return by_smallest(joined(cut(pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))), total))
    if n > largest:
        return rounds(pairs, total)

    def solved(t: pa.Table) -> pa.Table:
        a, b, w = (t[c].to_numpy() for c in "abw")
        nodes, place = np.unique(np.r_[a, b], return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        c = whole(nodes, np.r_[x, y], np.r_[y, x], np.r_[w, w], total)
        least = np.full(len(nodes), len(nodes))
        np.minimum.at(least, c, np.arange(len(nodes)))
        return pa.table({"node": nodes, "community": nodes[least[c]]})

    return pairs.groupBy(F.lit(0).alias("all")).applyInArrow(solved, "node long, community long")


def _weights_of(g: P.Graph) -> DataFrame:
    """(node, k) in packed rows: the summed weights of every node's edges."""
    n = g.n

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, _, w in P.each(batches):
            k, node = np.bincount(x, w, n), np.unique(x)
            yield P.row(node=P.put(node), k=P.put(k[node]))

    return cut(g.rows.mapInArrow(weigh, "node binary, k binary"))


def _last_whole(g: P.Graph, rows: DataFrame, whole: Callable[..., np.ndarray]) -> DataFrame:
    """(node, to) in packed rows: the groups that ``whole`` finds from (nodes, x, y, w) in one task."""
    ids = g.ids

    def last(t: pa.Table) -> pa.Table:
        c = whole(P.ids_of(ids), P.ints(t["x"]), P.ints(t["y"]), P.doubles(t["w"]))
        node = np.flatnonzero(c != np.arange(len(c)))
        return pa.table({"node": [P.put(node)], "to": [P.put(c[node])]})

    return cut(rows.groupBy(F.lit(0).alias("all")).applyInArrow(last, "node binary, to binary"))


def _packed_moves(pairs: DataFrame, total: float, rounds: int, levels: int, largest: int) -> DataFrame:
    """(node, community) by the rounds and levels of louvain over packed rows; a level of at most ``largest`` edges goes to a task."""
    g = P.graph(pairs, cut, place_of)
    weights, n, ids = _weights_of(g), g.n, g.ids
    strength, done, e = place_of(weights), [], g.rows

    def moves(before: list[str], now: list[str], r: int):
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k, c, nodes = np.bincount(P.followed(before, n), P.values(strength, n, "k"), n), P.followed(now, n), P.ids_of(ids)
            tot = np.bincount(c, k, n)
            for _, x, y, w in P.each(batches):
                own, out = np.unique(x), x != y
                node, to = better_places(x[out], y[out], w[out], c, k, tot, total)
                goes = xxhash64(nodes[node], r) % (2 + r // 4) == 0
                new = c[own]
                new[np.searchsorted(own, node[goes])] = to[goes]
                off = new != own
                yield P.row(node=P.put(own[off]), to=P.put(new[off]), wants=len(node), moved=int(off.sum()))

        return move

    for level in range(levels):
        if level and P.size(e) <= 2 * largest:
            done.append(place_of(_last_whole(g, e, lambda nodes, x, y, w, m=levels - level: moves_in_parts(nodes, x, y, w, total, rounds, m))))
            break
        now, moved = [], 0
        for r in range(rounds):
            step = cut(e.mapInArrow(moves(done, now, r), "node binary, to binary, wants long, moved long"))
            wants, off = step.agg(F.sum("wants"), F.sum("moved")).first()
            if not wants:
                break
            now, moved = [place_of(step)], off
        if not moved:
            break
        done += now
        last, e = e, cut(P.renamed(g, e, now[0], True))
        released(last)
    return P.named(g, pairs.sparkSession, done)


def _packed_mergers(pairs: DataFrame, total: float, largest: int, kept: int = 6) -> DataFrame:
    """(node, community) by the rounds of ``merged`` over packed rows; what is left of at most ``largest`` edges goes to a task.

    Every ``kept`` rounds the groups so far are stored as one step.
    """
    g = P.graph(pairs, cut, place_of)
    weights, n, ids, parts = _weights_of(g), g.n, g.ids, g.parts
    strength, done, e = place_of(weights), [], g.rows

    def asks(before: list[str], r: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k, nodes = np.bincount(P.followed(before, n), P.values(strength, n, "k"), n), P.ids_of(ids)
            for part, x, y, w in P.each(batches):
                near, i = asked_mergers(nodes, x, y, w, k, total, r)
                out = P.dealt(y[i] % parts, ["a", "b", "w", "ka", "kb"], x[i], y[i], w[i], k[x[i]], k[y[i]])
                yield out.append_column("near", pa.array([0] * out.num_rows, pa.int64()))
                yield pa.record_batch([pa.array([part], pa.int32()), *[pa.array([b""], pa.binary())] * 5, pa.array([near], pa.int64())], out.schema.names + ["near"])

        return ask

    def grant(t: pa.Table) -> pa.Table:
        a, b = granted(P.ints(t["a"]), P.ints(t["b"]), *(P.doubles(t[c]) for c in ("w", "ka", "kb")), total)
        return pa.table({"node": [P.put(a)], "to": [P.put(b)], "near": [sum(t["near"].to_pylist())], "joined": [len(a)]})

    def together(paths: list[str]):
        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = P.followed(paths, n)
            for b in batches:
                for part in b["part"].to_pylist():
                    own = np.arange(part, n, parts)
                    yield P.row(node=P.put(own), to=P.put(m[own]))

        return follow

    spark = pairs.sparkSession
    for r in itertools.count():
        if P.size(e) <= 2 * largest:
            before = list(done)

            def last(nodes, x, y, w, begin=r):
                return mergers_in_parts(nodes, x, y, w, total, np.bincount(P.followed(before, n), P.values(strength, n, "k"), n), begin)

            return P.named(g, spark, [*done, place_of(_last_whole(g, e, last))])
        step = e.mapInArrow(asks(list(done), r), "part int, a binary, b binary, w binary, ka binary, kb binary, near long")
        step = cut(step.groupBy("part").applyInArrow(grant, "node binary, to binary, near long, joined long"))
        near, joined = step.agg(F.sum("near"), F.sum("joined")).first()
        if not near:
            return P.named(g, spark, done)
        if joined:
            done.append(place_of(step))
            last_rows, e = e, cut(P.renamed(g, e, done[-1], False))
            released(last_rows)
            if len(done) > kept:
                done = [place_of(cut(spark.range(parts).select(F.col("id").alias("part")).mapInArrow(together(list(done)), "node binary, to binary")))]


def greedy_communities(edges: DataFrame, largest: int = 2_000_000) -> DataFrame:
    """(node, community) by greedy merging of neighbours over the modularity gain, from single nodes on.

    Every community is connected and no two neighbouring ones gain by a merger.  Compare partitions by modularity,
    not by label.  Loops count for nothing; an empty graph gives no rows.  A graph of at most ``largest`` edges goes
    to a task whole, a larger one merges in rounds over packed rows, by the same rules.
    """
    return in_parts(edges, mergers_in_parts, lambda pairs, total: _packed_mergers(pairs, total, largest), merged, largest)


def louvain(edges: DataFrame, rounds: int = 8, levels: int = 10, largest: int = 2_000_000) -> DataFrame:
    """(node, community) by parallel local moves and aggregation.

    In a round every node computes the gain of joining each neighbouring community; of those that gain a part by hash
    moves, one in two at first and fewer later, so that neighbours do not swap for ever.  When no node gains by a
    move (after ``rounds`` at the latest) communities become nodes, until a level joins nothing.  The labels are the
    smallest members; compare partitions by modularity, not by label.  A graph of at most ``largest`` edges goes to a
    task whole, a larger one moves in rounds over packed rows, by the same rules.
    """
    def whole(*part) -> np.ndarray:
        return moves_in_parts(*part, rounds, levels)

    return in_parts(edges, whole, lambda pairs, total: _packed_moves(pairs, total, rounds, levels, largest), lambda e, total: _joined_moves(e, total, rounds, levels), largest)


def _joined_moves(level: DataFrame, total: float, rounds: int, levels: int) -> DataFrame:
    """(node, c) by the rounds and levels of louvain; level is (a, b, w) in both directions."""
    member = level.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node"))
    for _ in range(levels):
        strength = level.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        labels = cut(strength.withColumn("c", F.col("node")))
        for r in range(rounds):
            sums = labels.groupBy("c").agg(F.sum("k").alias("tot"))
            near = level.where("a <> b").join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("kin"))
            own = labels.withColumnsRenamed({"c": "own"})
            cand = near.join(own, "node").join(sums, "c").where("c <> own").withColumn("gain", F.col("kin") - F.col("k") * F.col("tot") / total)
            stay = own.join(near.withColumnRenamed("c", "own"), ["node", "own"], "left").join(sums.withColumnRenamed("c", "own"), "own").select("node", (F.coalesce("kin", F.lit(0.0)) - F.col("k") * (F.col("tot") - F.col("k")) / total).alias("now"))
            best = cand.groupBy("node").agg(F.max_by("c", F.struct("gain", "c")).alias("to"), F.max("gain").alias("gain"))
            wants = best.join(stay, "node").where(F.col("gain") > F.col("now") + 1e-9).select("node", "to")
            goes = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2 + r // 4)) == 0
            new = cut(labels.join(wants, "node", "left").select("node", "k", F.when(goes, F.coalesce("to", "c")).otherwise(F.col("c")).alias("c"), F.col("to").isNotNull().alias("wants")))
            labels = new.drop("wants")
            if new.where("wants").isEmpty():
                break
        if labels.where("c <> node").isEmpty():
            break
        member = cut(member.join(labels.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")))
        names = labels.select("node", "c")
        level = level.join(names.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(names.withColumnsRenamed({"node": "b", "c": "cb"}), "b")
        level = cut(level.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return member


def well_connected(edges: DataFrame) -> DataFrame:
    """(node, community) by local moves with a refinement between moving and aggregating; every community is connected.

    After the moves of a level the nodes of each community merge anew, neighbours only (``merged``).  These parts are the
    nodes of the next level, which starts from the communities that the moves had found, so that a part may still leave a
    community that it is badly tied to.  It ends when the refinement merges nothing.  A community that is in
    several pieces at the end becomes several, which never lowers modularity.
    """
    level = cut(undirected(edges).select("a", "b", "w"))
    total = level.agg(F.sum("w")).first()[0]
    nodes = level.select(F.col("a").alias("node"), F.col("a").alias("c")).distinct()
    if not total:
        return by_smallest(nodes)
    whole, member, labels = level, nodes, nodes
    while True:
        moved = local_moves(level, labels, total)
        parts = merged(level, total, moved)
        if parts.where("c <> node").isEmpty():
            break
        labels = cut(parts.join(moved.withColumnRenamed("c", "to").hint("merge"), "node").groupBy(F.col("c").alias("node")).agg(F.min("to").alias("c")))
        member = cut(member.join(parts.select(F.col("node").alias("c"), F.col("c").alias("to")).hint("merge"), "c").select("node", F.col("to").alias("c")))
        level = cut(contracted(level, parts))
    member = cut(member.join(moved.select(F.col("node").alias("c"), F.col("c").alias("to")).hint("merge"), "c").select("node", F.col("to").alias("c")))
    ends = [member.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")).hint("merge") for x in "ab"]
    pieces = components(whole.join(ends[0], "a").join(ends[1], "b").where("ca = cb").select("a", "b"))
    return member.join(pieces.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def dependencies(a: np.ndarray, b: np.ndarray, asked: np.ndarray, part: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(node, dependency sum over the asked sources) in the graph of edges a, b, both directions, of connected parts.

    ``asked`` and ``part`` go with the edges: whether a is a source, and its part.  Sources advance together, in batches
    of about ``most`` edges to follow, and hold a number for each node of their own part.
    """
    nodes, at = np.unique(a, return_index=True)
    part = np.unique(part[at], return_inverse=True)[1]
    order = np.lexsort((nodes, part))  # a part's nodes lie together
    nodes, at, part = nodes[order], at[order], part[order]
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    known = nodes[np.argsort(nodes)]
    x, y = (place[np.searchsorted(known, v)] for v in (a, b))
    size, first = np.bincount(part), np.searchsorted(part, np.arange(part.max() + 1))
    y = y[np.argsort(x, kind="stable")]
    degree = np.bincount(x, minlength=len(nodes))
    begin = np.cumsum(degree) - degree
    total, sources = np.zeros(len(nodes)), np.flatnonzero(asked[at])
    batch = np.cumsum(np.bincount(part, weights=degree)[part[sources]] + size[part[sources]]) // most
    for s in np.split(sources, np.flatnonzero(np.diff(batch)) + 1) if len(sources) else []:
        off = np.cumsum(size[part[s]]) - size[part[s]] - first[part[s]]  # state of (source, node): off + node
        d, paths = np.full(size[part[s]].sum(), -1), np.zeros(size[part[s]].sum())
        last = np.empty(len(d), int)
        who, front, steps = np.arange(len(s)), s, []
        d[off + s], paths[off + s] = 0, 1
        while len(front):
            n = degree[front]
            i = np.repeat(np.arange(len(front)), n)
            to = y[np.repeat(begin[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            src, dst = off[who[i]] + front[i], off[who[i]] + to
            new = d[dst] < 0
            src, dst, i, to = src[new], dst[new], i[new], to[new]
            d[dst] = len(steps) + 1
            np.add.at(paths, dst, paths[src])
            steps.append((src, dst))
            last[dst] = np.arange(len(dst))
            one = last[dst] == np.arange(len(dst))
            who, front = who[i[one]], to[one]
        dep = np.zeros(len(d))
        for src, dst in reversed(steps):
            np.add.at(dep, src, paths[src] / paths[dst] * (1 + dep[dst]))
        dep[off + s] = 0.0
        np.add.at(total, np.arange(len(d)) - np.repeat(off, size[part[s]]), dep)
    return nodes, total


def betweenness(edges: DataFrame, sources: DataFrame | None = None, largest: int = 2_000_000, load: int = 10_000_000) -> DataFrame:
    """(node, betweenness) of an undirected graph by dependency sums over shortest paths from the sources.

    Without ``sources`` every node is one, which is exact; a sample scales as n / sample in expectation and is left to the
    caller.  Connected components of at most ``largest`` edges go to tasks whole, many small ones to one, and one with many
    sources to several by slices of these, so that each has about ``load`` edges to follow; in larger ones of longs
    the sources are dealt over tasks, which read the edges part by part for each step, and other nodes go by joins.
    """
    e = cut(undirected(edges).select("a", "b"))
    s = (sources.select("node") if sources is not None else e.select(F.col("a").alias("node"))).where("node is not null").distinct()
    own = components(e.where("a < b")).join(sized(cut(s.withColumn("asked", F.lit(True)))), "node", "left").select("node", "component", F.coalesce("asked", F.lit(False)).alias("asked"))
    own = cut(own.join(e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")).hint("merge"), "node"))
    parts = own.groupBy("component").agg(F.sum("degree").alias("edges"), F.count(F.when(F.col("asked"), 1)).alias("sources")).where("sources > 0")
    parts = cut(parts.withColumn("whole", F.col("edges") <= largest).withColumn("slices", F.ceil(F.col("edges") * F.col("sources") / load).cast("int")))
    tasks = parts.where("whole").agg(F.coalesce(F.sum(F.col("edges") * F.col("sources")), F.lit(0)), F.coalesce(F.sum("edges"), F.lit(0))).first()
    tasks = max(1, -(-tasks[0] // load), -(-tasks[1] // max(1, largest)))
    mine = own.join(sized(parts.select("component", "whole", "slices")), "component")
    place = F.when(F.col("asked"), F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    rows = e.join(sized(cut(mine.where("whole").select(F.col("node").alias("a"), "component", "slices", place.alias("place")))), "a")
    rows = rows.select("a", "b", "component", "place", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = rows.select("a", "b", "component", "slice", F.coalesce(F.col("place") == F.col("slice"), F.lit(False)).alias("asked"), F.pmod(F.xxhash64("component", "slice"), F.lit(tasks)).alias("task"))
    kind = e.schema["a"].dataType.simpleString()

    def solved(x: pa.Table) -> pa.Table:
        node, dep = dependencies(*(x[c].to_numpy() for c in ("a", "b", "asked", "component")))
        return pa.table({"node": pa.array(node, x.schema.field("a").type), "dep": dep})

    total = rows.groupBy("task", "slice").applyInArrow(solved, f"node {kind}, dep double")
    if parts.where("not whole").isEmpty():
        found = total
    else:
        big = mine.where("not whole").select("node", "asked")
        rest, starts = e.join(big.select(F.col("node").alias("a")).hint("merge"), "a", "left_semi"), big.where("asked").select("node")
        found = total.unionByName(_packed_dependencies(rest, starts) if kind == "bigint" else _joined_dependencies(rest, starts))
    return e.select(F.col("a").alias("node")).distinct().join(found.groupBy("node").agg((F.sum("dep") / 2).alias("dep")).hint("merge"), "node", "left").select("node", F.coalesce("dep", F.lit(0.0)).alias("betweenness"))


def pulled_dependencies(path: str, n: int, sources: np.ndarray) -> np.ndarray:
    """The summed dependencies of n nodes on the sources, all in step; every step reads the stored edges once."""
    each = np.arange(len(sources))
    d, paths, dep = np.full((n, len(each)), -1, np.int32), np.zeros((n, len(each))), np.zeros((n, len(each)))
    d[sources, each], paths[sources, each] = 0, 1
    step, more = 0, True
    while more:
        front, more = np.where(d == step, paths, 0.0), False
        step += 1
        for x, y, first in P.runs(path):
            got = np.add.reduceat(front[y], first, axis=0)
            i, j = np.nonzero((got > 0) & (d[x] < 0))
            d[x[i], j], paths[x[i], j] = step, got[i, j]
            more |= len(i) > 0
    for t in range(step - 1, 1, -1):
        here = d == t
        below = np.divide(1 + dep, paths, out=np.zeros_like(paths), where=here)
        for x, y, first in P.runs(path):
            dep[x] += np.where(d[x] == t - 1, paths[x] * np.add.reduceat(below[y], first, axis=0), 0.0)
    return dep.sum(1)


def _packed_dependencies(edges: DataFrame, sources: DataFrame, most: int = 15_000_000) -> DataFrame:
    """(node, dep) over the sources (node): each task takes some, as many at once as give ``most`` numbers of state, and reads the packed edges."""
    g = P.graph(edges.where("a < b").select("a", "b", F.lit(1.0).alias("w")), cut, place_of)
    ids, path, n = g.ids, place_of(g.rows), g.n
    tasks = edges.sparkSession.sparkContext.defaultParallelism

    def depend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = P.ids_of(ids)
        for t in P.batched(batches):
            s = np.searchsorted(nodes, t["node"].to_numpy())
            for some in np.array_split(s, -(-len(s) * n // most)) if len(s) else []:
                dep = pulled_dependencies(path, n, some)
                yield pa.record_batch({"node": nodes, "dep": dep})

    # one task a partition of the sources, each of the same number
    place = F.row_number().over(Window.orderBy(F.xxhash64("node"))) % tasks if sources.count() <= 100_000 else F.pmod(F.xxhash64("node"), F.lit(tasks))
    dealt_out = cut(sources.withColumn("task", place.cast("int")))
    return dealt_out.repartitionByRange(tasks, "task").select("node").mapInArrow(depend, "node long, dep double")


def _joined_dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, dep) over the sources, state keyed by (source, node); a step reaches the last two layers or new nodes only."""
    e = cut(edges.select("a", "b"), "a")
    layers = [cut(sources.select(F.col("node").alias("s"), "node").withColumn("paths", F.lit(1.0)))]
    while True:
        step = layers[-1].join(e.hint("merge"), layers[-1]["node"] == e["a"]).groupBy("s", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        for layer in layers[-2:]:
            step = step.join(layer.select("s", "node").hint("merge"), ["s", "node"], "left_anti")
        new = cut(step)
        if new.isEmpty():
            break
        layers.append(new)
    total, below = layers[0].select("node", F.lit(0.0).alias("dep")), None
    for up, layer in zip(layers[-2::-1], layers[:0:-1]):
        own = layer.withColumn("dep", F.lit(0.0)) if below is None else layer.join(below.hint("merge"), ["s", "node"], "left").na.fill(0.0, ["dep"])
        own = cut(own)
        total = total.unionByName(own.select("node", "dep"))
        j = own.join(e.hint("merge"), own["node"] == e["a"]).select("s", F.col("b").alias("up"), "paths", "dep")
        below = j.join(up.select("s", F.col("node").alias("up"), F.col("paths").alias("p")).hint("merge"), ["s", "up"]).groupBy("s", F.col("up").alias("node")).agg(F.sum(F.col("p") / F.col("paths") * (1 + F.col("dep"))).alias("dep"))
    return total


def similar_nodes(edges: DataFrame, node: int, k: int = 10) -> DataFrame:
    """(node, similarity): nodes whose neighbour sets have the largest Jaccard similarity with one node's."""
    e = undirected(edges).select("a", "b")
    size = e.groupBy("a").agg(F.count("*").alias("n"))
    mine = e.where(F.col("a") == node).select("b")
    one = mine.agg(F.count("*").alias("m"))  # one row
    shared = e.join(mine, "b").where(F.col("a") != node).groupBy("a").agg(F.count("*").alias("c"))
    j = shared.join(size, "a").join(F.broadcast(one))
    return j.select(F.col("a").alias("node"), F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("similarity")).orderBy(F.desc("similarity"), "node").limit(k)


def similar_nodes_of(edges: DataFrame, queries: DataFrame, k: int = 10, block: int = 10_000) -> DataFrame:
    """(query_id, node, similarity): for every query node (node) the k others whose neighbour sets are most alike, by Jaccard.

    A query meets the nodes that it shares a neighbour with, over that neighbour.  The adjacency of a neighbour of many is
    cut into blocks of about ``block`` by a hash of the node, so that a hub is no one task's; what two nodes share is
    added up in each task before it is shuffled.
    """
    e = cut(undirected(edges).select("a", "b"))
    size = e.groupBy("a").agg(F.count("*").alias("n"))
    blocks = size.select(F.col("a").alias("b"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    around = e.join(blocks.hint("merge"), "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    asked = queries.select(F.col("node").alias("query_id")).distinct()
    mine = e.join(asked.hint("merge"), e["a"] == asked["query_id"]).select("query_id", "b").join(blocks.hint("merge"), "b")
    mine = mine.select("query_id", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shared = mine.join(around.select("b", "block", "a").hint("merge"), ["b", "block"]).where("a <> query_id").groupBy("query_id", "a").agg(F.count("*").alias("c"))
    sizes = size.withColumnRenamed("a", "query_id").withColumnRenamed("n", "m")
    j = shared.join(size.hint("merge"), "a").join(sizes.hint("merge"), "query_id")
    j = j.select("query_id", F.col("a").alias("node"), F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("similarity"))
    return first_n(j, ["query_id"], [F.desc("similarity"), F.asc("node")], k)


def strongest_neighbours(edges: DataFrame, node: int, k: int = 5) -> DataFrame:
    """Neighbours of one node by edge weight; edges are (a, b, similarity), each pair once."""
    other = F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a"))
    return edges.where((F.col("a") == node) | (F.col("b") == node)).select(other.alias("doc_id"), "similarity").orderBy(F.desc("similarity"), "doc_id").limit(k)
