"""Hand-made frames for semantics that an oracle cannot show."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import analytics as A, enrich as E, graph as G, links as L, logs, search as S, tables as T, text as X
from quarry.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column).first()[0]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new = spark.createDataFrame([(2, None, 3.0), (2, "c", 4.0), (3, "d", None)], "id int, name string, v double")
    assert rows(T.upsert_latest(old, new, ["id"], [F.col("v")])) == [(1, "a", 1.0), (2, "c", 4.0), (3, "d", None)]
    keep = T.upsert_keeping(old, spark.createDataFrame([(2, None, 9.0)], "id int, name string, v double"), ["id"])
    assert rows(keep) == [(1, "a", 1.0), (2, "b", 9.0)]


def test_change_log_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "n"), (2, "x"), (4, "z")], "id int, v string")
    assert rows(T.change_log(a, b, "id")) == [(1, "modify"), (3, "delete"), (4, "add")]


def test_filters_ignore_zero_bounds(spark):
    df = spark.createDataFrame([(1, 1990), (2, None)], "doc_id int, year int")
    assert T.apply_filters(df, T.SearchFilters(year_min=0, year_max=None)).count() == 2
    assert T.apply_filters(df, T.SearchFilters(year_max=2000)).count() == 1


def test_first_tier(spark):
    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([(1,)], "x int")
    assert T.first_tier(a, b, b).count() == 1 and T.first_tier(a, a).count() == 0


def test_partial_ingestions(spark):
    led = spark.createDataFrame([(1, "a", "success"), (1, "b", "success"), (1, "c", "success"), (2, "a", "success"), (2, "b", "failed"), (3, "a", "failed")], "doc_id int, store string, status string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [r.doc_id for r in logs.partial_ingestions(led).orderBy("doc_id").collect()] == [2, 3]


def test_cleaners(spark):
    assert one(spark, C.clean_doi(F.lit("https://doi.org/10.1/x"))) == "10.1/x" and one(spark, C.clean_doi(F.lit("none"))) is None
    assert one(spark, C.clean_species_name(F.lit("Gadus  morhua (L., 1758) [x]"))) == "Gadus morhua" and one(spark, C.clean_species_name(F.lit("Gadus"))) is None
    for name, title, year in [("Fish-ecology_2004_Journal.pdf", "Fish ecology", 2004), ("a/b/deep-sea--fish---now_b.v2.pdf", "Deep sea – fish — now b.v2", None), ("of_the-sea_x.pdf", "Of the sea", None), ("_1999_x.pdf", None, 1999)]:
        assert one(spark, C.title_from_filename(F.lit(name))) == title and one(spark, C.year_of_filename(F.lit(name))) == year
    assert one(spark, C.year_in(F.lit("in 1975 and 2021"))) == 2021 and one(spark, C.published_year(F.lit("seen (2019), © 2001"))) == 2019
    assert one(spark, C.published_year(F.lit("Published in May 1999"))) is None and one(spark, C.published_year(F.lit("Published:\n1999"))) == 1999
    titles = {"# Abstract\n# A longer heading\ntext": "A longer heading", "## Level two of it\n# Real title": "Real title", "# Methods\n![image of something]\n| table row here\n---------------\n**The** _plain_ title": "The plain title", "\n\n# Contents\nshort\n" + "x" * 300: None, "#\nWrapped heading": "Wrapped heading"}
    for text, title in titles.items():
        assert one(spark, C.title_of(F.lit(text))) == title, text
    assert one(spark, C.title_of(F.lit("tiny"), F.lit("of_the-sea_x.pdf"))) == "Of the sea x"
    assert one(spark, C.salvaged_json(F.lit('<think>{"n":1}</think>```json\n{"a": {"b": 2}}\n``` end'))) == '{"a": {"b": 2}}'
    assert one(spark, C.highlighted(F.lit("Cod and cod."), F.array(F.lit("cod")))) == "**Cod** and **cod**."
    assert one(spark, C.estimated_tokens(F.lit("x" * 50))) == 22 and one(spark, C.estimated_tokens(F.lit(""))) == 0
    abstract = " ".join(f"w{i}" for i in range(30))
    assert one(spark, C.abstract_of(F.lit(f"# T\n## Abstract\n{abstract}\n# Next"))) == abstract and one(spark, C.abstract_of(F.lit("Abstract: short"))) is None
    rest = " ".join(["rest"] * 200)
    assert one(spark, C.abstract_of(F.lit(f"# T\n#### Abstract\n{abstract}\n# Next"))) is None
    assert one(spark, C.abstract_of(F.lit(f"T\n Abstract:\n{abstract}\n 1. Begin {rest}"))) == abstract
    assert one(spark, C.abstract_of(F.lit(f"T. Abstract— {abstract}\nReferences\n{rest}"))) == abstract
    assert one(spark, C.abstract_of(F.lit(f"{rest} Abstract— {abstract}\nReferences\n"))) is None
    long = lambda n, mark="": f"## Abstract\n{'word ' * n}{mark} tail"
    assert one(spark, C.abstract_of(F.lit(long(700)))) == "word " * 700 + "tail"
    assert one(spark, C.abstract_of(F.lit(long(900)))) == " ".join(["word"] * 400) + "..."
    assert one(spark, C.abstract_of(F.lit("## Abstract\n" + "word " * 450 + "Acknowledgment et al., " + "more " * 500))) == " ".join(["word"] * 450)
    assert one(spark, C.abstract_of(F.lit("## Abstract\n" + "word " * 5 + "References " + "more " * 900))) is None
    assert one(spark, C.sentence_end(F.lit("One two. Three four five six"), F.lit(12))) == 9 and one(spark, C.sentence_end(F.lit("none"), F.lit(3))) == 103
    assert one(spark, C.bad_abstract(F.lit("abstract " * 9))) and one(spark, C.bad_abstract(F.lit("x" * 40 + "abstractCls"))) and not one(spark, C.bad_abstract(F.lit("# " + "x" * 40)))
    assert one(spark, C.concepts(F.lit("Deep-sea Fish, (between) novel models."), F.array(F.lit(" Cod ")), F.array(F.lit("marine_ecology")))) == ["deep-sea", "fish", "models", "cod", "marine ecology"]
    assert one(spark, C.date_parts(F.array(F.array(F.lit(2020))))) == (2020, None)


def test_sections_and_packing(spark):
    df = spark.createDataFrame([(1, "lost\n# A\nx\ny\n### B\n"), (2, "none")], "doc_id int, text string")
    assert rows(X.split_sections(df)) == [(1, 0, "A", 1, "x\ny"), (1, 1, "B", 3, "")]
    paragraphs = "\n\n".join(["a" * 600, "b" * 600, "c" * 50])
    got = rows(X.chunk_sections(spark.createDataFrame([(1, paragraphs), (2, "d" * 40), (3, "e" * 3000)], "doc_id int, text string"), ["doc_id"]))
    assert got[0][2] == "a" * 600 and got[1][2] == "a" * 198 + "\n\n" + "b" * 600 + "\n\n" + "c" * 50
    assert [len(r[2]) for r in got[2:]] == [40, 3000]
    short = rows(X.chunk_sections(spark.createDataFrame([(1, "a" * 150 + "\n\n" + "b" * 900)], "doc_id int, text string"), ["doc_id"]))
    assert [r[2] for r in short] == ["a" * 150, "b" * 900]  # what is not longer than the overlap is not carried


def test_sliding_chunks_end_at_sentences(spark):
    text = "This is a sentence. " * 200
    got = X.chunk_sliding(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), size=500, overlap=100).collect()
    assert len(got) > 5 and all(r.chunk.endswith(".") for r in got) and [r.chunk_idx for r in got] == list(range(len(got)))
    with pytest.raises(ValueError):
        X.chunk_sliding(spark.createDataFrame([(1, "x")], "doc_id int, text string"), size=250, overlap=200)


def test_sliding_pieces_by_hand():
    text = "x" * 290 + ". " + "y" * 300
    assert X.sliding_pieces(text, 300, 50, 10) == [(0, "x" * 290 + "."), (242, "x" * 48 + ". " + "y" * 300)]
    assert X.sliding_pieces("z" * 700, 300, 50, 10)[0] == (0, "z" * 400)  # no mark: the window's end
    assert X.sliding_pieces("z" * 700, 300, 50, 10, boundary="first")[0] == (0, "z" * 300)
    assert X.sliding_pieces(" \n ", 300, 50, 0) == []
    both = "a" * 250 + "? " + "b" * 40 + ". " + "c" * 300
    assert X.sliding_pieces(both, 300, 50, 10)[0][1].endswith("b.") and X.sliding_pieces(both, 300, 50, 10, boundary="first")[0][1].endswith("b.")
    late = "a" * 250 + ". " + "b" * 40 + "? " + "c" * 300
    assert X.sliding_pieces(late, 300, 50, 10)[0][1].endswith("?") and X.sliding_pieces(late, 300, 50, 10, boundary="first")[0][1].endswith("a.")


def test_study_type_ties(spark):
    lex = spark.createDataFrame([("a", "x1"), ("b", "y1"), ("b", "y2"), ("b", "y3")], "study_type string, keyword string")
    got = {r.doc_id: (r.study_type, r.confidence) for r in X.study_types(spark.createDataFrame([(1, "x1"), (2, "x1 y1 y2 y3"), (3, ""), (4, "x1 y1 y2")], "doc_id int, text string"), lex).collect()}
    assert got == {1: ("a", 1.0), 2: ("mixed", 0.8), 3: ("unknown", 0.0), 4: ("a", 1.0)}


def test_prefix_terms_count_as_one_phrase(spark):
    df = spark.createDataFrame([(1, "fish fishes cat"), (2, "dog"), (3, "dog"), (4, "dog")], "doc_id int, text string")
    got = S.keyword_search(df, [(1, "fish")], "doc_id", ["text"]).collect()
    assert [r.doc_id for r in got] == [1] and got[0].score > 0
    common = S.keyword_search(df, [(1, "dog")], "doc_id", ["text"]).collect()
    assert all(0 < r.score < 1e-5 for r in common)  # in most documents: the floor of the weight


def test_graph_semantics(spark):
    rel = spark.createDataFrame([(1, 2, "p"), (2, 3, "p"), (3, 4, "p"), (4, 5, "p"), (5, 5, "p"), (2, 1, "q")], "subject long, object long, type string")
    assert [A.k_hop_edges(rel, 1, k).count() for k in (1, 2, 3)] == [2, 3, 4]
    sp = spark.createDataFrame([(1, "A"), (2, None), (3, "B"), (4, "C"), (5, "A")], "species_id long, family string")
    assert {r.species_id: r.degree for r in G.relation_degree(sp, rel).collect()}[5] == 2
    assert {r.species_id: r.bridge_score for r in G.bridge_species(sp, rel).collect()} == {4: 4, 5: 2}


def two_triangles(spark):
    return spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "a long, b long")


def test_analytics_invariants(spark):
    e = two_triangles(spark)
    assert {r.component for r in A.components(e).collect()} == {1}
    assert abs(sum(r.rank for r in A.pagerank(e, tolerance=0.01).collect()) - 1) < 1e-9
    c = A.louvain(e)
    assert {frozenset(r.node for r in c.collect() if r.community == k) for k in {r.community for r in c.collect()}} == {frozenset({1, 2, 3}), frozenset({4, 5, 6})}
    assert A.modularity(e, c) > A.modularity(e, c.withColumn("community", F.col("node")))
    b = {r.node: r.betweenness for r in A.betweenness(e).collect()}
    assert b == {1: 0, 2: 0, 3: 6, 4: 6, 5: 0, 6: 0}
    assert A.label_propagation(e).count() == 6


def test_radius_join_covers_both_bands(spark):
    p = spark.createDataFrame([(1, 0.1, 0.0), (2, -0.1, 0.0), (3, 50.0, 0.0), (4, 0.0, 179.99)], "location_id int, latitude double, longitude double")
    c = spark.createDataFrame([(9, 0.05, 0.0), (8, 0.0, -179.99)], "centre_id int, latitude double, longitude double")
    assert [(r.centre_id, r.location_id) for r in G.radius_join(p, c, 30.0).orderBy("centre_id", "location_id").collect()] == [(8, 4), (9, 1), (9, 2)]


def test_radius_join_equals_brute_force(spark):
    import random
    from math import asin, cos, radians, sin, sqrt

    def km(a, b):
        h = sin((radians(b[0]) - radians(a[0])) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin((radians(b[1]) - radians(a[1])) / 2) ** 2
        return 2 * 6371.0 * asin(min(1, sqrt(h)))

    rng = random.Random(5)
    place = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), rng.uniform(-3, 3)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)]))
    points, centres = [place() for _ in range(300)], [place() for _ in range(60)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "location_id int, latitude double, longitude double")
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(centres)], "centre_id int, latitude double, longitude double")
    for radius in (40.0, 300.0):
        want = {(i, j) for i, a in enumerate(centres) for j, b in enumerate(points) if km(a, b) <= radius}
        assert {(r.centre_id, r.location_id) for r in G.radius_join(p, c, radius).collect()} == want


def test_cascades_do_not_repeat_edges(spark):
    rel = spark.createDataFrame([(1, 2, "p"), (2, 1, "p")], "subject long, object long, type string")
    st = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "c", 3)], "entity long, domain string, doc_id int")
    assert sorted((r.path, r.depth, r.domains, r.papers) for r in L.cascades(rel, st, 1, 3).collect()) == [("1>2", 1, 2, 2), ("1>2>1", 2, 2, 2)]
    chain = spark.createDataFrame([(2, 1, "p"), (2, 3, "q"), (3, 3, "p")], "subject long, object long, type string")
    every = spark.createDataFrame([(i, d, i) for i in (1, 2, 3) for d in "ab"], "entity long, domain string, doc_id int")
    assert sorted(r.path for r in L.cascades(chain, every, 1, 3).collect()) == ["1>2", "1>2>3", "1>2>3>3"]
    assert [r.path for r in L.cascades(chain, every, 1, 3, limit=1).collect()] == ["1>2"]


def test_names_resolve_by_tiers(spark):
    bb = spark.createDataFrame([(1, "Gadus morhua", None), (2, "Gadus callarias", 1)], "taxon_id int, scientific_name string, accepted_id int")
    n = spark.createDataFrame([("GADUS MORHUA",), ("Gadus morua",), ("Gadus callarias",), ("Homo sapiens",)], "name string")
    assert {r.name: (r.accepted_id, r.tier) for r in E.resolve_names(n, bb).collect()} == {"GADUS MORHUA": (1, 1), "Gadus morua": (1, 2), "Gadus callarias": (1, 1), "Homo sapiens": (None, None)}


def test_parsing_keeps_good_items(spark):
    text = '<think>no</think>{"species":[{"original_name":"A b"},{}],"measurements":[{"parameter":"d","value":"x"},{"parameter":"d","value":3}],"relations":[{"subject":"a","object":"b","relation_type":"eats"}],"locations":[{"name":"P","latitude":"0","longitude":"5"}]} tail'
    out = X.parse_extractions(spark.createDataFrame([(1, "c", text), (2, "c", "nothing")], "doc_id int, chunk_id string, content string"))
    assert out["species"].count() == 1 and [r.value for r in out["measurements"].collect()] == [3.0]
    assert out["relations"].first().type == "associated" and out["locations"].first().latitude is None and out["rejects"].first().doc_id == 2


def test_model_functions(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id int, text string")
    assert [r.embedding for r in X.embed(df, lambda ts: [[len(t), 1] for t in ts]).orderBy("doc_id").collect()] == [[2.0, 1.0], [1.0, 1.0]]
    assert rows(X.run_model(df, lambda ps: [p.upper() for p in ps], prompt="text")) == [(1, "AB"), (2, "C")]


def test_files_and_exports(spark, tmp_path):
    from quarry.sources import exports

    for name, body in (("a.txt", "same"), ("sub/b.txt", "same"), ("c.md", "other")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(body)
    docs = exports.read_documents(spark, str(tmp_path / "in"))
    assert docs.count() == 2 and docs.select("doc_id").distinct().count() == 1
    exports.write_csv(docs.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["doc_id", "source_path", "text"]
    exports.write_json(docs, str(tmp_path / "json"))
    exports.write_text(docs, "text", str(tmp_path / "text"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2 == spark.read.text(str(tmp_path / "text")).count()


def test_streams_agree_with_batches(spark, tmp_path):
    src = tmp_path / "src"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id as query_id", "event_type as query", "value as execution_time_ms", "cast(ts as timestamp) as ts").repartition(4).write.parquet(str(src))
    batch = spark.read.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(src))
    q = jobs.query_statistics(stream, delay="40 days").writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("stats")) == rows(jobs.query_statistics(batch))
    q = jobs.ingest(stream, lambda d: d.select("query_id", "query"), ["query_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    versions = sorted((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name[2:]))
    assert len(versions) == 2 and spark.read.parquet(str(versions[-1])).count() == batch.count()


def test_ingest_never_forgets_a_table(spark, tmp_path):
    import shutil

    src, out, cp = tmp_path / "src", tmp_path / "out", tmp_path / "cp"

    def add(i):
        spark.createDataFrame([(i, "x")], "id int, v string").coalesce(1).write.mode("append").parquet(str(src))
        q = jobs.ingest(spark.readStream.schema("id int, v string").parquet(str(src)), lambda d: d, ["id"], str(out), str(cp))
        q.awaitTermination()

    add(1), add(2), add(3)
    shutil.rmtree(out / "v=1")  # a version that an older clean-up took
    add(4)
    newest = max(out.iterdir(), key=lambda p: int(p.name[2:]))
    assert {r.id for r in spark.read.parquet(str(newest)).collect()} == {1, 2, 3, 4}
    shutil.rmtree(out)
    with pytest.raises(Exception, match="no version before"):
        add(5)


def test_plans_push_filters_down(spark):
    from quarry.plans.views import Corpus

    plan = Corpus(spark, "/root/testdata/sf0.001").documents.where("lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_early_ending_search_reads_less_and_finds_the_same(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "alphabet", "beta", "gamma", "delta", "omega"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights=[1, 1, 2, 4, 60, 120], k=rng.randrange(1, 40)))) for i in range(600)] + [(600, None), (601, "")], "doc_id long, text string")
    terms = S.terms_of(docs, [(1, "alpha beta"), (2, "gamma"), (3, "alphab delta omega"), (4, "nothing"), (5, "om al")])
    stats = S.statistics(docs, ["text"])
    postings = S.build_postings(docs, "doc_id", ["text"])
    index = S.impact_blocks(postings, stats, [2, 4, 5, 6, 7], block=4, slices=3).cache()
    for k in (1, 10, 5000):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        full = S.bm25(postings, stats, terms).withColumn("rank", rank).where(F.col("rank") <= k)
        assert rows(S.keyword_topk(index, stats, terms, k)) == rows(full)
        read = S.blocks_read(index, stats, terms, k).agg(F.sum("n")).first()[0]
        every = S.blocks_asked(index, stats, terms).agg(F.sum("n")).first()[0]
        assert read < every if k == 1 else read <= every
    alone = S.terms_of(docs, [(1, "alpha"), (2, "beta"), (3, "gamma")])
    read, every = (df.agg(F.sum("n")).first()[0] for df in (S.blocks_read(index, stats, alone, 5), S.blocks_asked(index, stats, alone)))
    assert read < every / 3, (read, every)
    assert rows(S.prefix_matches(S.vocabulary(docs, ["text"]), S.terms_of(docs, [(1, "alpha"), (2, "xy")]))) == [(1, "alpha", "alpha"), (1, "alpha", "alphabet")]


def test_close_strings_finds_every_pair(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(11)
    base = ["".join(rng.choices("abcdeé ", k=n)) for n in [0, 1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 20, 31] * 4]

    def slip(s):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("abcé") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcé") + s[i + 1 :]])
        return s

    left, right = sorted({slip(rng.choice(base)) for _ in range(150)}), sorted({slip(rng.choice(base)) for _ in range(150)})
    a, b = (spark.createDataFrame([(x, i % 2) for i, x in enumerate(side)], f"{n} string, year int") for side, n in ((left, "s"), (right, "t")))
    for edits in (1, 2):
        want = sorted((x, y, distance(x, y)) for x in left for y in right if distance(x, y) <= edits)
        assert sorted(tuple(r) for r in E.close_strings(a.drop("year"), b.drop("year"), "s", "t", edits).select("s", "t", "distance").collect()) == want
    within = {(x, y) for x in left for y in right if distance(x, y) <= 2 and left.index(x) % 2 == right.index(y) % 2}
    assert {(r.s, r.t) for r in E.close_strings(a, b, "s", "t", 2, ("year",)).collect()} == within
    names = spark.createDataFrame([("Gadis morhua",), ("Gadus morhua",), ("Xadus morhuaa",), ("nothing like",)], "name string")
    backbone = spark.createDataFrame([(1, "Gadus morhua", None), (2, "Gadus morhux", 7)], "taxon_id long, scientific_name string, accepted_id long")
    assert rows(E.resolve_names(names, backbone)) == sorted([("Gadis morhua", 1, 2), ("Gadus morhua", 1, 1), ("Xadus morhuaa", 1, 2), ("nothing like", None, None)], key=repr)


@pytest.mark.parametrize("few", [0, 64])
def test_keywords_are_found_in_one_pass(spark, monkeypatch, few):
    monkeypatch.setattr(X, "FEW_KEYWORDS", few)
    docs = spark.createDataFrame([(1, "The CATALOGUE of cats"), (2, None), (3, ""), (4, "no match")], "doc_id long, text string")
    lex = spark.createDataFrame([("a", "cat"), ("a", "Catalogue"), ("b", "log"), ("b", "dog"), ("c", "cat")], "domain string, keyword string")
    assert rows(X.found_keywords(docs, lex)) == [(1, "cat"), (1, "catalogue"), (1, "log")]
    assert rows(X.score_domains(docs, lex)) == [(1, "a", 1.0), (1, "b", 0.5), (1, "c", 1.0)]
    assert X.score_domains(docs, lex.where("false")).count() == 0
    assert {r[0] for r in X.found_keywords(docs, spark.createDataFrame([("",)], "keyword string")).collect()} == {1, 2, 3, 4}
    kinds = spark.createDataFrame([("field", "cat"), ("field", "sea"), ("lab", "log")], "study_type string, keyword string")
    assert [(r.doc_id, r.study_type, r.confidence) for r in X.study_types(docs, kinds).orderBy("doc_id").collect()] == [(1, "lab", 1.0), (2, "unknown", 0.0), (3, "unknown", 0.0), (4, "unknown", 0.0)]


@pytest.mark.parametrize("kind", ["table", "clusters", "one list"])
def test_vector_lists_recall(spark, kind):
    import numpy as np

    rng = np.random.default_rng(4)
    if kind == "table":
        base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    else:
        middle = rng.normal(size=(20 if kind == "clusters" else 1, 16))
        x = middle[rng.integers(0, len(middle), 1500)] + rng.normal(size=(1500, 16)) * (0.2 if kind == "clusters" else 0.5)
        base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 16), (9001, None)], "chunk_id long, embedding array<double>")
    queries = base.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    lists = S.vector_lists(base)
    want = {(r.query_id, r.chunk_id): r.score for r in S.cosine_topk(base.where("embedding is not null"), queries, 10).collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in S.near_vectors(base, queries, lists, 10, block=100).collect()}
    assert len(got) == len(want) and sum(x in want for x in got) >= 0.9 * len(want)
    assert all(abs(want[x] - got[x]) < 2e-6 for x in got if x in want)
    if kind == "clusters":
        assert lists.probes < 32
        exact = {(r.query_id, r.chunk_id) for r in S.near_vectors(base, queries, lists, 10, 64, block=100, crowd=7).collect()}
        assert sum(x in want for x in exact) >= 0.999 * len(want)
    assert S.near_vectors(base.limit(0), queries, S.vector_lists(base.limit(0))).count() == 0


def test_gaps_links_and_overlaps(spark):
    k = spark.createDataFrame([(1, "Gadus morhua"), (1, "Clupea harengus"), (2, "Gadus morhua"), (2, "Clupea harengus"), (2, "lower case"), (3, "Gadus morhua")], "doc_id int, keyword string")
    assert rows(X.keyword_links(k)) == [("Clupea harengus", "Gadus morhua", 2)] and rows(X.keyword_links(k, 1)) == []
    e = spark.createDataFrame([("cod",), ("eel",)], "entity string")
    names = spark.createDataFrame([("sea",), ("lake",)], "domain string")
    known = spark.createDataFrame([("cod", "sea"), ("cod", "sea"), ("cod", "moon")], "entity string, domain string")
    assert rows(L.gaps_of_kinds(e, places=(names, known), other=(names.limit(0), known))) == [("places", "cod", 1, 1), ("places", "eel", 0, 2)]
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (2, "a", 0.4), (2, "b", 0.2), (3, "a", 0.05)], "doc_id int, domain string, score double")
    g = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3)], "author string, doc_id int")
    assert rows(X.domain_overlaps(s, g, "author")) == [("x", "a", 0.45, True), ("x", "b", 0.25, True)]
    kw = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id int, doc_id int")
    p = spark.createDataFrame([(1, 2000, "m"), (2, 1990, "m"), (3, 2001, "n")], "doc_id int, year int, primary_domain string")
    assert [r.doc_id for r in S.top_papers(kw, p, 2002, 5, "m").collect()] == [1] and S.top_papers(kw, p, 2002).count() == 3


def test_upserts_touch_the_buckets_they_meet(spark, tmp_path):
    path = str(tmp_path / "table")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "table").glob("__bucket=*/*.parquet")}
    read = lambda: rows(spark.read.parquet(path).drop("__bucket"))
    T.upsert_buckets(spark.createDataFrame([(i, f"v{i}") for i in range(200)], "id long, v string"), ["id"], path, 16)
    before = files()
    assert len(read()) == 200 and len({p.rsplit("/", 2)[1] for p in before}) == 16
    batch = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (500, "more", 1)], "id long, v string, at int")
    met = T.upsert_buckets(batch, ["id"], path, 16, [F.col("at")])
    after = files()
    assert len(met) <= 2 and {p for p in before if p not in after or after[p] != before[p]} == {p for p in before if int(p.rsplit("/", 2)[1].split("=")[1]) in met}
    content = rows(spark.read.parquet(path).select("id", "v"))
    assert content == sorted([(i, f"v{i}") for i in range(200) if i != 3] + [(3, "newer"), (500, "more")], key=repr)
    T.upsert_buckets(batch, ["id"], path, 16, [F.col("at")])
    assert rows(spark.read.parquet(path).select("id", "v")) == content
    assert T.upsert_buckets(batch.limit(0), ["id"], path, 16) == [] and rows(spark.read.parquet(path).select("id", "v")) == content
    with pytest.raises(ValueError):
        T.upsert_buckets(batch, ["id"], path, 8)


def test_bucketed_ingest_of_a_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for i in range(3):
        spark.createDataFrame([(j, i) for j in range(i, 50, i + 1)], "id int, v int").coalesce(1).write.mode("append").parquet(src)
        jobs.ingest_buckets(spark.readStream.schema("id int, v int").parquet(src), lambda d: d, ["id"], out, cp, 8).awaitTermination()
    want = {j: i for i in range(3) for j in range(i, 50, i + 1)}
    assert rows(spark.read.parquet(out).select("id", "v")) == sorted(want.items(), key=repr)


def test_segments_read_as_one_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} same") for i in range(40)] + [(99, None)], "doc_id long, text string")
    index = S.Segments(spark, str(tmp_path / "index"), "doc_id", ["text"])
    built = lambda df: rows(S.build_postings(df, "doc_id", ["text"]).select("doc_id", "dl", "term", "tf"))
    read = lambda: rows(index.read().select("doc_id", "dl", "term", "tf"))
    index.add(docs)
    assert read() == built(docs) and not index.merge(0.0)
    newer = spark.createDataFrame([(3, "other text"), (50, "added w1"), (5, "")], "doc_id long, text string")
    index.add(newer, spark.createDataFrame([(7,), (8,)], "doc_id long"))
    index.add(spark.createDataFrame([(8, "back again")], "doc_id long, text string"))
    now = docs.where("doc_id not in (3, 5, 7, 8)").unionByName(newer).unionByName(spark.createDataFrame([(8, "back again")], "doc_id long, text string"))
    assert read() == built(now) and len(index.live()) == 3
    assert not index.merge(0.5) and index.merge(0.1)
    assert read() == built(now) and len(index.live()) == 1
    index.add(newer.where("false"), docs.select("doc_id").where("doc_id < 20"))
    assert read() == built(now.where("doc_id >= 20"))


def test_many_starts_equal_one_by_one(spark):
    import random

    rng = random.Random(2)
    e = spark.createDataFrame(sorted({(1, i) for i in range(2, 40)} | {(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(60)}), "a long, b long")
    r = e.select(F.col("a").alias("subject"), F.col("b").alias("object"), F.lit("t").alias("type"))
    starts = spark.createDataFrame([(1,), (5,), (5,), (77,)], "node long")
    got = A.k_hop_edges_of(r, starts, 2).collect()
    near = A.similar_nodes_of(e, starts, 5, block=4).collect()
    for s in (1, 5, 77):
        assert sorted((x.subject, x.object) for x in got if x.start == s) == sorted((x.subject, x.object) for x in A.k_hop_edges(r, s, 2).collect())
        assert sorted(((x.node, x.similarity) for x in near if x.query_id == s), key=repr) == rows(A.similar_nodes(e, s, 5))
    m = e.select(F.col("a").alias("doc_id"), F.col("b").alias("species_id"))
    many = G.cooccurring_of(m, spark.createDataFrame([(3,), (9,)], "species_id long"), 4).collect()
    for s in (3, 9):
        assert sorted(((x.species_id, x.papers) for x in many if x.query_id == s), key=repr) == rows(G.cooccurring(m, s, 4))


def pieces_of(pairs, nodes):
    """The smallest node of every node's connected piece, by plain search."""
    around, out = {n: set() for n in nodes}, {}
    for a, b in pairs:
        around[a].add(b), around[b].add(a)
    for n in sorted(nodes):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo.extend(around[x])
    return out


def test_communities_are_connected(spark):
    e = two_triangles(spark).unionByName(spark.createDataFrame([(8, 9), (7, 7)], "a long, b long"))
    pairs, nodes = [(r.a, r.b) for r in e.collect() if r.a != r.b], {1, 2, 3, 4, 5, 6, 8, 9}
    for find in (A.greedy_communities, A.well_connected):
        got = {r.node: r.community for r in find(e).collect()}
        assert got == pieces_of([(a, b) for a, b in pairs if got[a] == got[b]], nodes)
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 8: 8, 9: 8}


def test_labels_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError, match="still move"):
        A.label_propagation(two_triangles(spark), rounds=1)


def test_keyed_state_of_a_ledger(spark, tmp_path):
    src, cp, out = (str(tmp_path / n) for n in ("src", "cp", "out"))
    schema = "doc_id long, store string, status string, ts string, event_id long"
    files = [
        [(1, "v", "pending", "2024-01-01 00:00:00", 1), (2, "v", "failed", "2024-01-01 00:00:00", 2), (1, "g", "success", "2024-01-01 00:05:00", 3), (1, "v", "success", "2024-01-01 00:01:00", 4)],
        [(1, "v", "success", "2024-01-01 00:01:00", 4), (2, "v", "pending", "2024-01-01 00:00:00", 9), (1, "v", "older", "2024-01-01 00:00:30", 5)],  # repeated, tie by event_id, out of order
        [(3, "v", "success", "2024-01-01 06:00:00", 6)],  # moves the watermark on: the others are idle
        [(1, "v", "late", "2024-01-01 00:02:00", 7), (3, "v", "failed", "2024-01-01 06:01:00", 8)],
    ]

    def run(rows_):
        spark.createDataFrame(rows_, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id long, store string, status string, ts timestamp, event_id long").parquet(src)
        with jobs.keyed_state(spark):
            jobs.ledger_changes(stream, "10 minutes", idle=3_600_000).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
        return {(r.doc_id, r.store, r.status, r.event_id, r.expired) for r in spark.read.parquet(out).collect()}

    assert run(files[0]) == {(1, "v", "success", 4, False), (2, "v", "failed", 2, False), (1, "g", "success", 3, False)}
    second = run(files[1])
    assert second == {(1, "v", "success", 4, False), (2, "v", "failed", 2, False), (2, "v", "pending", 9, False), (1, "g", "success", 3, False)}
    third = run(files[2])
    ended = {(1, "v", "success", 4, True), (2, "v", "pending", 9, True), (1, "g", "success", 3, True)}
    assert third == second | {(3, "v", "success", 6, False)} | ended
    assert run(files[3]) == third | {(3, "v", "failed", 8, False)}  # the late row is gone


def test_chunks_by_a_table_function(spark):
    docs = spark.createDataFrame([(1, "One sentence. " * 400), (2, None), (3, ""), (4, "short"), (None, "x" * 5000), (5, "One sentence. " * 400)], "doc_id long, text string")
    want = rows(X.chunk_sliding(docs))
    assert want and rows(X.chunk_stream(docs)) == want == rows(X.chunk_stream(docs, block=1))
    assert X.chunk_stream(docs.where("false")).isEmpty()


def test_vector_search_in_blocks(spark):
    """Against numpy over all pairs, with pairs left out, a null and a zero vector."""
    import numpy as np

    x = np.random.default_rng(8).normal(size=(300, 6)).round(1)
    base = spark.createDataFrame([(i, i // 4, i % 3, v.tolist()) for i, v in enumerate(x)] + [(900, 900, 0, [0.0] * 6), (901, 901, 0, None)], "chunk_id long, doc_id long, domain int, embedding array<float>")
    queries = base.where("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), F.col("doc_id").alias("qdoc"), F.col("domain").alias("qdomain"), F.col("embedding").alias("q"))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u[:40] @ u.T, 6)
    got = rows(S.cosine_topk(base, queries, 7, apart=[("doc_id", "qdoc")], within=[("domain", "qdomain")]).select("query_id", "chunk_id", F.round("score", 5)))
    want = []
    for i in range(40):
        others = [(-s[i, j], j) for j in range(300) if j // 4 != i // 4 and j % 3 == i % 3] + ([(0.0, 900)] if i % 3 == 0 else [])
        want += [(i, j) for _, j in sorted(others)[:7]]
    assert [r[:2] for r in got] == sorted(want, key=repr)
    assert S.cosine_topk(base, queries, 400).groupBy().agg(F.count("*"), F.count("score"), F.expr("count_if(score = 0 and chunk_id = 900)")).first()[:] == (40 * 302, 40 * 301, 40)
    best = {(r.query_id, r.doc_id): r.best for r in S.best_documents(base, queries).collect()}
    assert len(best) == 40 * 77 and best[3, 901] is None
    assert all(abs(best[i, d] - s[i, 4 * d : 4 * d + 4].max()) < 2e-6 for i in range(40) for d in range(75))


def test_answers_are_parsed_once(spark):
    """The parser stands once in the plan of a list, whatever is asked of it, and stored lists equal the others."""
    answers = spark.createDataFrame([(1, "c", '<think>{x}</think>```json\n{"methods": [{"name": "m"}, {"name": ""}, null], "traits": [{"species": "s", "trait_name": "t", "trait_value": "1"}]}\n```'), (2, "c", "} none {")], "doc_id int, chunk_id string, content string")
    plan = X.parse_extractions(answers)["methods"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("<think>") == 1
    for stored in (False, True):
        out = X.parse_extractions(answers, stored)
        assert rows(out["methods"].select("name")) == [("m",)] and out["traits"].count() == 1
        assert rows(out["rejects"]) == [(2, "c", "} none {")]


def test_bibtex_places_of_many_ranges(spark):
    from quarry.sources.exports import bibtex

    papers = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.lit(2000).alias("year"), F.array(F.lit("A B")).alias("authors"))
    out = bibtex(papers)
    assert "Exchange rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()  # the ranges are drawn once
    assert out.where(~F.contains("bibtex", F.concat(F.lit("B2000_"), F.col("doc_id").cast("string"), F.lit(",")))).isEmpty()


def test_bibtex_of_several_authors_of_one_id_and_of_braces(spark):
    from quarry.sources.exports import bibtex

    names = [f"A{i:02}" for i in range(40)]
    papers = spark.createDataFrame([(1, "t", 2000, "{}", [n]) for n in reversed(names)] + [(2, "t", 2000, "", ["Z"])], "doc_id long, title string, year int, abstract string, authors array<string>")
    out = dict((r.bibtex.split("{")[1].split(",")[0], r.bibtex) for r in bibtex(papers).collect())
    assert sorted(out) == sorted([f"{n}2000_{i}" for i, n in enumerate(names)] + ["Z2000_40"])  # in the order of the authors
    assert "  abstract = {},\n" in out["A002000_0"] and "abstract" not in out["Z2000_40"]


def test_discovered_links_of_twenty_entities(spark):
    studied = spark.createDataFrame([(f"e{i:02}", d, i) for i in range(20) for d in "xy"], "entity string, domain string, doc_id int")
    links = L.discover(studied, spark.createDataFrame([("x", "y", 0.5)], "a string, b string, score double"), per_type=30)
    assert links.count() == 20


def test_keyword_candidates_are_the_best_of_all_scores(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 7}x{j * i % 11}" for j in range(i % 9 + 1)).replace("w1", "w")) for i in range(200)] + [(900, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(i, t) for i in range(30) for t in (f"w{i % 7}", f"w{i % 5}x{i % 3}", "none")], "query_id long, term string").distinct()
    few = docs.where("doc_id % 3 > 0").select("doc_id")
    for among in (None, few):
        every = S.keyword_scores(docs, terms, "doc_id", ["text"])
        every = every if among is None else every.join(among, "doc_id", "left_semi")
        want = T.first_n(every, ["query_id"], [F.desc("score"), F.asc("doc_id")], 6).select("query_id", "doc_id", F.round("score", 5))
        got = S.keyword_candidates(docs, terms, "doc_id", ["text"], 6, among=among).select("query_id", "doc_id", F.round("score", 5))
        assert rows(got) == rows(want) and got.count() > 30


def test_label_propagation_ends_whenever_it_rests(spark):
    """Rest may begin in a round of either parity."""
    assert A.label_propagation(two_triangles(spark), rounds=40).count() == 6
    for n in (2, 3, 4):
        path = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
        assert A.label_propagation(path, rounds=40).count() == n + 1


def test_lifted_pairs_are_settled_where_they_meet(spark):
    import itertools
    import random
    import re

    rng = random.Random(5)
    domains = [(i, rng.choice("abcdefgh")) for i in range(60) for _ in range(rng.randint(0, 3))] + [(3, None)]
    words = [(i, rng.randint(0, 12)) for i in range(60) for _ in range(rng.randint(1, 7))] + [(3, None), (4, None)]
    got = A.lifted_pairs(spark.createDataFrame(domains, "doc_id long, domain string"), spark.createDataFrame(words, "doc_id long, keyword long"))
    s, k = ({i: {x for j, x in rows if j == i and x is not None} for i in range(60)} for rows in (domains, words))
    want = set()
    for a, b in itertools.combinations(range(60), 2):
        j = len(s[a] & s[b]) / (len(s[a] | s[b]) or 1)
        if k[a] & k[b] and j < 0.55 and round(j + 0.1 * len(k[a] & k[b]), 6) >= 0.55:
            want.add((a, b, round(j + 0.1 * len(k[a] & k[b]), 6)))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\d+L, b#", plan)  # no row of a pair is dealt


def test_components_store_few_rows(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(A, "cut", lambda df, *keys, f=A.cut: (out := f(df, *keys), stored.append(out.count()))[0])
    n = 3_000
    chain = spark.range(1, n).selectExpr("id as a", "id + 1 as b")
    star = spark.range(n + 2, 2 * n).selectExpr("id as a", f"{2 * n}L as b")
    e = chain.unionByName(star).unionByName(spark.createDataFrame([(n + 1, n + 1), (None, 5)], "a long, b long"))
    got = {r.node: r.component for r in A.components(e).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {i: n + 2 for i in range(n + 2, 2 * n + 1)}
    assert sum(stored) < 5 * 2 * n  # all rounds together
    assert A.components(e.where("a = b")).count() == 0


def test_betweenness_follows_parts_in_few_steps(spark, monkeypatch):
    import random

    calls = []
    monkeypatch.setattr(A, "cut", lambda df, *keys, f=A.cut: (calls.append(1), f(df, *keys))[1])
    n = 60
    chains = spark.range(0, 3 * n).where(f"id % {n} > 0").selectExpr("id - 1 as a", "id as b")
    got = {r.node: r.betweenness for r in A.betweenness(chains).collect()}
    assert got == {i: float((i % n) * (n - 1 - i % n)) for i in range(3 * n)}
    assert len(calls) < n  # not two for each step of the longest path
    rng = random.Random(3)
    e = spark.createDataFrame([(g * 100 + rng.randrange(12), g * 100 + rng.randrange(12)) for g in range(3) for _ in range(18)], "a long, b long")
    few = e.select(F.col("a").alias("node")).where("node % 2 = 0")
    whole, mixed = ({r.node: round(r.betweenness, 9) for r in A.betweenness(e, few, largest=m, load=50).collect()} for m in (10**6, 34))
    assert whole == mixed and any(whole.values())


def test_place_species_joins_places_by_broadcast(spark):
    places = spark.createDataFrame([(i, f"N_{i}", "R") for i in range(25)], "location_id long, name string, region string")
    references = spark.range(500).selectExpr("id % 100 as doc_id", "id % 25 as location_id").distinct()
    mentions = spark.range(300).selectExpr("id % 100 as doc_id", "id % 7 as species_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark estimates of a join is no guide
    try:
        got = G.place_species(places, references, mentions, "_1")
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {tuple(r) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    r, m = ({tuple(x) for x in df.collect()} for df in (references, mentions))
    want = {(s, f"N_{p}") for d, s in m for e, p in r if d == e and "_1" in f"n_{p}"}
    assert {x[:2] for x in rows} == want
    assert all(n == len({d for d, z in m if z == s and (d, int(name[2:])) in r}) for s, name, _, n in rows)
    assert "hashpartitioning(location_id" not in plan  # a place is not one task's


def test_metadata_evaluates_a_pattern_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("text"))
    for column, pattern in ((C.abstract_of("text"), "msd"), (C.published_year("text"), "ublished"), (C.title_of("text"), "(?md)")):
        assert df.select(column.alias("c"))._jdf.queryExecution().analyzed().toString().count(pattern) == 1


def few_parts(spark):
    import random

    rng = random.Random(4)
    some = [(g * 1000 + rng.randrange(14), g * 1000 + rng.randrange(14), float(rng.randrange(1, 4))) for g in (-2, 0, 5) for _ in range(24)]
    return spark.createDataFrame([*some, (9001, 9002, 1.0), (9003, 9003, 1.0)], "a long, b long, w double")


def test_hashes_in_tasks_are_spark_s(spark):
    import numpy as np

    ids = [0, 1, -5, 2**62, 20_000, -(2**63)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ids)], "i int, a long").select("i", F.xxhash64("a").alias("one"), F.xxhash64("a", F.lit(7)).alias("dealt"), F.xxhash64("a", F.col("a") + 1).alias("two"))
    x = np.array(ids, dtype=np.int64)
    got = zip(A.xxhash64(x).tolist(), A.xxhash64(x, 7).tolist(), A.xxhash64(x, x + 1).tolist())
    assert list(got) == [(r.one, r.dealt, r.two) for r in df.orderBy("i").collect()]


def test_louvain_takes_parts_whole_by_the_rules_of_the_joins(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(A, "cut", lambda df, *keys, f=A.cut: (calls.append(1), f(df, *keys))[1])
    e = few_parts(spark)
    whole = rows(A.louvain(e))
    few, calls[:] = len(calls), []
    assert rows(A.louvain(e, largest=20)) == whole and rows(A.louvain(e, largest=0)) == whole  # some and all by joins
    assert few < 30 < len(calls) and len({c for _, c in whole}) > 4
    named = e.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "w")
    assert {r[0] for r in rows(A.louvain(named, rounds=1, levels=1))} == {str(n) for n, _ in whole}
    assert A.louvain(e.where("a = b")).count() == 0


def test_greedy_communities_take_parts_whole_by_the_rules_of_the_joins(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(A, "cut", lambda df, *keys, f=A.cut: (calls.append(1), f(df, *keys))[1])
    e = few_parts(spark)
    whole = rows(A.greedy_communities(e))
    few, calls[:] = len(calls), []
    assert rows(A.greedy_communities(e, largest=20)) == whole and rows(A.greedy_communities(e, largest=0)) == whole  # some and all by joins
    assert few < 30 < len(calls) and len({c for _, c in whole}) > 4


def test_blocks_of_searches_known_beforehand(spark, monkeypatch):
    from quarry.plans import registry

    kept = []
    monkeypatch.setattr(S, "cut", lambda df, *keys, f=S.cut: (kept.append(f(df, *keys)), kept[-1])[1])
    got = rows(registry.queries()["bm25_topk"](spark, "/root/testdata/sf0.001"))
    index = next(df for df in kept if "entries" in df.columns)
    assert {r.phrase for r in index.select("phrase").collect()} <= {"the", "and", "ation", "ment", "queau", "license"}
    assert got == rows(registry.queries()["bm25_search"](spark, "/root/testdata/sf0.001"))
    df = spark.createDataFrame([(1, "the then cat"), (2, "dog the"), (3, None), (4, "cat")], "doc_id int, text string")
    some = rows(S.build_postings(df, "doc_id", ["text"], words=spark.createDataFrame([("the",), ("the",), ("cat",)], "word string")))
    assert some == [r for r in rows(S.build_postings(df, "doc_id", ["text"])) if r[2] in ("the", "cat")] and len(some) == 4


def never(*_):
    raise AssertionError("all edges went through joins")


def test_large_louvain_goes_without_joins(spark, monkeypatch):
    e = few_parts(spark)
    whole = rows(A.louvain(e))
    monkeypatch.setattr(A, "_joined_moves", never)
    monkeypatch.setattr(A.P, "PACK", 8)  # many parts
    assert rows(A.louvain(e, largest=5)) == whole


def test_large_greedy_merging_goes_without_joins(spark, monkeypatch):
    e = few_parts(spark)
    whole = rows(A.greedy_communities(e))
    monkeypatch.setattr(A, "merged", never)
    monkeypatch.setattr(A.P, "PACK", 8)
    assert rows(A.greedy_communities(e, largest=5)) == whole


def test_label_propagation_goes_without_joins(spark, monkeypatch):
    e = few_parts(spark)
    joined = rows(A._joined_labels(A.pairs_of(e), 200))
    monkeypatch.setattr(A, "_joined_labels", never)
    assert rows(A.label_propagation(e)) == joined and len({c for _, c in joined}) > 3
    assert A.label_propagation(e.where("a = b")).count() == 0


def test_betweenness_of_a_large_part_goes_without_joins(spark, monkeypatch):
    e = few_parts(spark).select("a", "b")
    few = e.select(F.col("a").alias("node")).where("node % 3 = 0")
    rounded = lambda **k: {r.node: round(r.betweenness, 9) for r in A.betweenness(e, few, **k).collect()}
    whole = rounded()
    monkeypatch.setattr(A, "_joined_dependencies", never)
    monkeypatch.setattr(A.P, "PACK", 8)
    assert rounded(largest=0) == whole and any(whole.values())


def test_discovered_cascades_read_their_tables_once(spark, tmp_path):
    """Chains of five starts: relations are evaluated once, what is studied for its breadth and for the shared links."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(i, (i * 7 + j) % 30, "p") for i in range(30) for j in (1, 2, 3)], "subject long, object long, type string")
    relations = pairs.coalesce(1).mapInArrow(seen, pairs.schema)
    studied = spark.createDataFrame([(i, d, i) for i in range(30) for d in "xy"], "entity long, domain string, doc_id long")
    table = spark.createDataFrame([("x", "y", 0.5)], "a string, b string, score double")
    got = rows(L.discover(studied, table, relations))
    assert runs.value == pairs.count()
    want = {r.path for n in range(5) for r in L.cascades(pairs, studied, n, limit=10).collect()}
    chains = [r for r in got if r[0] == "cascade"]
    assert len(chains) == 10 and {r[1] for r in chains} <= {r[0] for r in spark.createDataFrame([(p,) for p in want], "p string").select(L.link_id(F.lit("cascade"), F.col("p"))).collect()}
