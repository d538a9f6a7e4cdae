"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, components, decontam, langid, linedup, neardup, quality, tokencount, toxicity, warc
from quarry.llm.common import held_out

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n\n "), (4, "é"), (5, "a " * 3000), (5, "a " * 3000), (None, "no key"), (7, "日本語のテキスト 😀 \x1c\x85"), (8, "x" * 20000), (9, "one two")]
#: Columns whose names clash with the operators' own.
CLASH = ["k", "t", "x", "q", "p", "drop", "label", "score", "band", "n", "__h", "__t", "__k", "__score", "__drop", "__bad", "__s", "head_key", "head_text", "own_text", "bad_text", "quality_score", "count"]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("c") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# -- 1 ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return bpe.TextBpe(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_bpe_equals_library(coder):
    own, lib = coder
    rng = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "é", "ß", "你", "😀", "1", "½", "_", "-", "\x1c", "\x85", "\xa0", "　", "!!", "aaaa", "ǅ", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(50))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 999, "-=" * 500, "".join(rng.choices("abcdethin", k=5000))]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), t[:60]
        assert own.bpe.decode(ids) == t.encode()


def test_bpe_join_is_the_encoding_of_the_whole(coder):
    own, lib = coder
    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choices("theingsao ", k=rng.randrange(30))).encode() for _ in range(2))
        assert own.bpe.join(own.bpe.tree(a), own.bpe.tree(b)) == own.bpe.tree(a + b)


def test_bpe_decodes_up_the_tree():
    joined = []

    class Piece(bytes):
        def __add__(self, other):
            joined.append(len(self) + len(other))
            return Piece(bytes(self) + bytes(other))

    own = bpe.TreeBpe({bytes([i]): i for i in range(256)})
    own.tokens = [Piece([i]) for i in range(256)]
    assert own.decode(list(range(8))) == bytes(range(8)) and own.decode([]) == b""
    assert sorted(joined) == [2, 2, 2, 2, 4, 4, 8]


def test_bpe_digests_of_odd_rows(spark, coder):
    df = odd(spark)
    got = [tuple(r) for r in bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    want = []
    for k, t in ODD:
        ids = coder[1].encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.digests(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_columns(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(odd(spark), path, P.PATTERN), path)
    assert all(bytes(r.data) == (r.text or "").encode() for r in back.collect())


# -- 2 ----------------------------------------------------------------------------------------------------


def brute_near(rows, k, asks):
    ids = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ids[i] = min(ids.get(i, v), v)
    out = {}
    for i, v in ids.items():
        if asks(i):
            s = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in ids.items() if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_ann_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 5), (2004, [1.0, None] * 4), (None, [1.0] * 8), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "cell", "label")})
    got = defaultdict(list)
    want = brute_near(rows, 20, lambda i: i % 20 == 0)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, visit=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == want
    out, vectors = ann.search(df, F.col("vec_id") % 20 == 0, 20).collect(), {i: v for i, v in rows if i is not None and i < 2000}
    assert all(r.score == np.dot(vectors[r.query_id], vectors[r.vec_id]) for r in out)
    assert sum(r.vec_id in want[r.query_id] for r in out) >= 0.9 * 20 * len(want)


def test_ann_of_one_component(spark):
    df = spark.createDataFrame([(0, [2.0]), (1, [-1.0]), (2, [3.0]), (3, [0.0]), (20, [1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 6.0), (0, 2, 20, 2.0), (0, 3, 1, -2.0), (20, 1, 2, 3.0), (20, 2, 0, 2.0), (20, 3, 1, -1.0)]


def test_ann_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert ann.search(df, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def recall(df, key="vec_id"):
    """Share of the true 20 nearest that the search returns."""
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    return np.mean(hits)


def test_ann_recall(spark):
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


@pytest.mark.parametrize("kind", ["unequal", "clustered"])
def test_ann_recall_of_other_tables(spark, kind):
    """10,000 vectors, more than the sample: of log-normal lengths, and in 40 clusters; there a small share suffices."""
    rng = np.random.default_rng(18)
    x = rng.normal(size=(10_000, 16))
    if kind == "clustered":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, len(x))] + 0.1 * x
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(0, 0.7 if kind == "unequal" else 0, (len(x), 1)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert recall(df) >= 0.9
    sample = x[np.random.default_rng(1).permutation(len(x))[: ann.SAMPLE]]
    assert ann.Index(sample).share(sample, 20) < (0.2 if kind == "unequal" else 0.15)


def test_multi_index_walk_is_in_order():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    index = ann.Index(x, 6)
    cells = index.cells(x)
    index.deal(np.bincount(cells, minlength=36))
    q = rng.normal(size=8)
    d = index.distances(q)
    met = index.walk(q, 1e9)
    total = [d[0][c // 6] + d[1][c % 6] for c in met]
    assert total == sorted(total) and set(met) == set(cells.tolist())


# -- 3, 6, 8 ----------------------------------------------------------------------------------------------


#: What the toxic half of the held-out documents hold; the labels of the others rest on other signs or on chance.
INSULTS = ["trash", "pathetic", "idiot", "disgusting", "worthless", "clown", "loser", "stupid", "scum", "moron"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(d, lab)


def test_toxicity_held_out(spark, toxic_model):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(d, toxic_model).where(held_out("doc_id")).join(lab.select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    rows = [(r.toxic, r.score > 0.5, any(x in r.text.lower() for x in INSULTS)) for r in scored.select("toxic", "score", "text").collect()]
    share = lambda x: sum(x) / len(x)
    assert share([p for y, p, _ in rows if not y]) <= 0.01 and share([p for y, p, _ in rows if y]) >= 0.62
    assert share([p for y, p, insult in rows if insult]) >= 0.97 and share([p == bool(y) for y, p, _ in rows]) > 0.945
    assert scored.where("score < 0 or score > 1").isEmpty()


def test_insults_with_gaps_are_found_in_clean_text(toxic_model):
    base = "der geö und the erin thanou on thor with ere thenly of the re in es and that ation ing"
    for insult in (*INSULTS, "i d i o t", "i.d.i.o.t", "s t u p i d", "w o r t h l e s s", "s-c-u-m", "worth less", "id iot", "idiiot", "wor*thless", "idi0t", "tra sh", "p a t h e t i c"):
        assert toxic_model.scores([f"{base} {insult} {base}"])[0] > 0.5, insult
    for clean in (base, base + " A b c d e f g h i j k.", base + " 1 2 3 4 5, x y z, a.m. p.m. i.e. e.g. ", "", None):
        assert toxic_model.scores([clean])[0] < 0.5, clean


def test_gaps_of_spelled_words_close():
    same = lambda a, b: np.array_equal(toxicity.symbols(a), toxicity.symbols(b))
    assert same("an i d i o t here", "an idiot here") and same("s.t.u.p.i.d", "stupid") and same("s-c-u-m!", "scum!") and same("idi0t", "idiot")
    assert not same("a b", "ab") and not same("worth less", "worthless") and not same("x y.\nz w", "xy.\nzw")
    assert len(toxicity.symbols(None)) == 2


def test_toxicity_tolerates_gaps():
    rng = random.Random(7)
    insults = ["idiot", "moron", "worthless"]
    bad = [f"{words(rng, 20)} {rng.choice(insults)} {words(rng, 20)}" for _ in range(150)]
    good = [words(rng, 41) for _ in range(300)]
    model = toxicity.train(bad + good, np.array([1.0] * 150 + [0.0] * 300))
    base = words(rng, 40)
    for insult in ("idiot", "id iot", "idioot", "worthlesss", "wortthless", "worth-less"):
        assert model.scores([base + " " + insult])[0] > 0.5, insult
    assert model.scores([base])[0] < 0.5


def brute_kernel(a, b):
    """Common subsequences of four symbols within the span, by trying all places."""
    from itertools import combinations

    def phi(x):
        out = Counter()
        for p in range(len(x)):
            for rest in combinations(range(p + 1, min(p + toxicity.SPAN, len(x))), 3):
                out[(x[p], *(x[i] for i in rest))] += toxicity.DECAY ** (rest[-1] - p + 1)
        return out

    u, v = phi(a), phi(b)
    return sum(w * v[k] for k, w in u.items())


def test_kernel_equals_brute_force():
    rng = random.Random(19)
    parts = [toxicity.symbols("".join(rng.choice("ab ci.é") for _ in range(rng.randrange(4, 25))))[1:-1] for _ in range(12)]
    parts = [p[p != toxicity.END] for p in parts]
    parts = [p for p in parts if len(p) >= 4]
    size = toxicity.lengths(np.array([len(p) for p in parts]))
    want = np.array([[brute_kernel(a.tolist(), b.tolist()) for b in parts] for a in parts]) / np.outer(size, size)
    assert np.allclose(toxicity.gram(parts, parts), want, rtol=1e-4)
    who, name, weight = toxicity.features(parts)
    folded = np.bincount(name, weight * (who == 0), 1 << toxicity.BITS)  # the kernel with the first piece as weights
    joined = np.concatenate(parts)
    end = np.cumsum([len(p) for p in parts])
    assert np.allclose(toxicity.summed(joined, end - [len(p) for p in parts], end, folded) / size, want[:, 0], rtol=1e-4)


def test_pieces_stay_inside_sentences():
    text = "One. Two three four five six seven eight nine ten!\nEnd"
    s = toxicity.symbols(text)
    start, end = toxicity.pieces(s)
    assert all(toxicity.END not in s[a:b] and 4 <= b - a <= toxicity.PIECE for a, b in zip(start, end, strict=True))
    covered = {i for a, b in zip(start, end, strict=True) for i in range(a, b)}
    assert covered == set(np.flatnonzero(s != toxicity.END).tolist())
    model = toxicity.Model(np.random.default_rng(4).normal(size=1 << toxicity.BITS).astype(np.float32), 0.0, None, 0.5)
    texts = [text, None, "", "x", text * 300, "a b"]
    assert np.allclose(model.points(texts), np.concatenate([model.points([t]) for t in texts]), atol=1e-4)


def test_samples_are_bounded(spark):
    from quarry.llm.sampling import labelled_sample

    docs = spark.createDataFrame([(i % 50, "x" * (10 + i)) for i in range(400)] + [(None, "n")], "doc_id long, text string")
    lab = labels(spark, [(i, 1, 1) for i in range(50)] + [(i, 0, 0) for i in range(50)])
    rows = labelled_sample(docs, lab, "toxic", {1: 20, 0: 20}).collect()
    assert len(rows) == len({r.k for r in rows}) == 20 and {r.y for r in rows} == {1}
    few = labelled_sample(docs, lab, "toxic", {1: 20}, chars=1000).collect()
    assert 0 < len(few) < 20 and sum(len(r.text) for r in few) <= 1000


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_take_odd_rows(spark, module):
    lab = labels(spark, [(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)])
    rows = module.classify(odd(spark), lab).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert module.classify(empty(spark), lab).count() == 0
    assert module.classify(odd(spark), lab.limit(0)).count() == len(ODD)


def test_quality_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(d, lab).join(lab, "doc_id").where("held_out")
    assert out.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_forest_arrays_equal_tree_walk():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f = quality.fit_forest(x, y, trees=20)
    assert ((f.scores(x) > 0.5) == (y > 0)).mean() > 0.95

    def walk(row):
        total = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.cut[at] else f.right[at]
            total += f.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], f.scores(x[:50]))


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(20)
    for _ in range(20):
        x = rng.integers(0, 10, (120, 3)).astype(float)
        y = ((x[:, 1] > 4) ^ (rng.random(120) < 0.3)).astype(float)
        f = quality.fit_forest(x, y, trees=1, depth=1, least=5)
        p = (y.sum() + 1) / (len(y) + 2)
        g, h = y - p, p * (1 - p)

        def gain(j, cut):
            low = x[:, j] <= cut
            if min(low.sum(), (~low).sum()) < 5:
                return -1.0
            part = lambda m: g[m].sum() ** 2 / (h * m.sum() + 1)
            return part(low) + part(~low) - part(low | ~low)

        best = max(gain(j, c) for j in range(3) for c in range(10))
        assert abs(gain(f.feature[0], f.cut[0]) - best) < 1e-9
        low = x[:, f.feature[0]] <= f.cut[0]
        assert np.isclose(f.value[f.left[0]], 0.15 * g[low].sum() / (h * low.sum() + 1))


def test_statistics_by_hand():
    s = dict(zip(quality.NAMES, quality.statistics("Ab ab 12! é\nAb. x"), strict=True))
    n = len("Ab ab 12! é\nAb. x".encode())
    assert np.isclose(s["upper"], 2 / n) and np.isclose(s["digit"], 2 / n) and np.isclose(s["high"], 2 / n) and np.isclose(s["bang"], 1 / n)
    assert np.isclose(s["distinct"], 6 / 6**0.8) and np.isclose(s["top_word"], 1 / 6) and s["distinct_lines"] == 1 and np.isclose(s["end_marks"], 1 / 6)
    assert not quality.statistics(None).any() and not quality.statistics("").any()


def test_filters_answer_like_sets():
    rng = random.Random(21)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    texts = {k: [" ".join("".join(rng.choices(v, k=rng.randrange(1, 8))) for _ in range(60)) for _ in range(40)] for k, v in alphabets.items()}
    sets = {k: np.unique(np.concatenate([langid.grams(t) for t in v[:20]])) for k, v in texts.items()}
    f = langid.build(sets)
    for lang, rows in texts.items():
        for t in rows[20:]:
            h = langid.grams(t)
            exact = {k: np.isin(h, s).sum() for k, s in sets.items()}
            assert np.allclose(f.counts(h), [exact[k] for k in f.langs], atol=3)
            assert f.predict(t)[0] == max(exact, key=exact.get) == lang


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return sum(max(0, len(w) + 2 - n + 1) for w in words for n in langid.LENGTHS)


def test_grams_lie_inside_words():
    for t in ("one", "Two words", "a, b; ccc!", "éà 12 ñ", "日本 語", "x" * 5000):
        assert len(langid.grams(t)) == brute_grams(t), t
    assert langid.grams("ab").tolist() == langid.grams(" AB! ").tolist()


def test_language_held_out_and_odd_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = langid.fit(d)
    out = langid.identify(d, filters).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    rows = langid.identify(odd(spark), filters).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.lang_pred for r in rows}[1] == "und" == {r.doc_id: r.lang_pred for r in rows}[3]
    assert langid.identify(odd(spark), langid.build({})).where("lang_pred <> 'und'").isEmpty()
    assert not langid.fit(empty(spark).withColumn("lang", F.lit("x"))).langs


def test_every_language_is_learned_or_none(spark):
    rows = [(i, chr(0x4E00 + i % 80) * 5 + " " + chr(0x5E00 + i % 80) * 5, f"l{i % 80:02}") for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(d, langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() == 800
    with pytest.raises(ValueError):
        langid.fit(d, languages=79)


def test_filters_hold_more_than_64_languages():
    rng = np.random.default_rng(9)
    tops = {f"l{i:03}": rng.integers(0, 1 << 63, 50).astype(np.uint64) for i in range(130)}
    f = langid.build(tops)
    for lang, h in tops.items():
        c = f.counts(h)
        assert f.langs[int(c.argmax())] == lang and c.max() > 49


# -- 4 ----------------------------------------------------------------------------------------------------


def brute_lines(docs, least):
    """Deletes every line of a run of enough words that occurs earlier, by trying all runs."""
    seqs = []
    for k, t in sorted(docs, key=lambda r: r[0]):
        lines = t.split("\n")
        seqs.append((k, lines, [(i, x) for i, x in enumerate(lines) if x.strip(" ")]))
    seen, gone = set(), defaultdict(set)
    for k, lines, rows in seqs:  # runs in the order of their start
        for a in range(len(rows)):
            n = 0
            for b in range(a, len(rows)):
                n += rows[b][1].strip(" ").count(" ") + 1
                if n >= least:
                    run = tuple(x for _, x in rows[a : b + 1])
                    if run in seen:
                        gone[k].update(i for i, _ in rows[a : b + 1])
                    seen.add(run)
    return {k: "\n".join(x for i, x in enumerate(lines) if i not in gone[k]) for k, lines, _ in seqs}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(10)
    pool = [words(rng, rng.randrange(1, 9), 30) for _ in range(12)] + [""]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=10).collect()}
    assert got == brute_lines(docs, 10)


def test_line_dedup_odd_rows(spark):
    df = odd(spark)
    out = linedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(ODD)
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, df.select("doc_id", "text").collect()))
    assert linedup.dedup_lines(empty(spark)).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------


def brute_contained(docs, items):
    import re

    def sh(t, n):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)

    out = set()
    for item, t in items:
        n = min(5, sh(t, 1)[1])
        s = sh(t, n)[0] if n else set()
        for k, d in docs:
            if s and len(s & sh(d, n)[0]) >= 0.8 * len(s):
                out.add((k, item))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([2, 5, 8, 20, 60, 200]), 3000)) for i in range(40)] + [(90, None), (91, ""), (92, "!!")]
    docs = [(i, words(rng, 100, 3000)) for i in range(80)]
    for i in range(40):
        w = items[i][1].split()
        cut = len(w) // 10 if i % 3 == 0 else (len(w) // 2 if i % 3 == 1 else 0)
        docs.append((200 + i, words(rng, 50, 3000) + " " + " ".join(w[cut:]).upper() + ". " + words(rng, 500, 3000)))
    docs += [(None, items[0][1]), (300, None), (301, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("c") for c in CLASH + ["item", "s", "size"]})
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id) for r in decontam.contained(d, b).collect()} == want
    bad = {k for k, _ in want}
    assert sorted(map(str, (r.doc_id for r in decontam.decontaminate(d, b).collect()))) == sorted(str(k) for k, _ in docs if k not in bad)
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)
    clean = [(None, words(rng, 90, 3000)), (None, words(rng, 90, 3000)), (0, words(rng, 90, 3000)), (7, None)]
    both = [(None, items[0][1]), (0, items[0][1] + " and more"), *clean, clean[0]]  # unlike texts under null and equal keys
    kept = decontam.decontaminate(spark.createDataFrame(both, "doc_id long, text string"), b).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [*clean, clean[0]]))
    assert decontam.contained(empty(spark), b).count() == 0


# -- 7 ----------------------------------------------------------------------------------------------------


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary, unknown = tokencount.load_vocabulary(P.path("piece_bpe_32k.model"))
    lib = Tokenizer(models.Unigram(vocabulary, unknown, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(12)
    texts = ["".join(rng.choice("abeéß你😀١ιx the") for _ in range(rng.randrange(80))) for _ in range(1500)]
    own = tokencount.Counter(vocabulary, unknown)
    for t in texts:
        assert own.count(t) == len(lib.encode(" ".join(t.split())).ids), t
    got = [(r.doc_id, r.n_tokens) for r in tokencount.count_tokens(odd(spark), P.path("piece_bpe_32k.model")).collect()]
    assert got == [(k, own.count(t)) for k, t in ODD]
    assert tokencount.count_tokens(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_long_words_take_constant_memory():
    import tracemalloc

    c = tokencount.Counter(*tokencount.load_vocabulary(P.path("piece_bpe_32k.model")))
    c.word("warm")
    tracemalloc.start()
    n = c.word("▁" + "ab" * 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1000 and peak < 2_000_000  # copies of the text itself


def test_ties_keep_the_first_start():
    c = tokencount.Counter([("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)], 0)
    assert c.word("▁aaa") == 2  # ▁ and aaa: equal scores, the leftmost start stays


# -- 9 ----------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    long = "<html>" + "x" * 200
    rows = [(1, "http://a", long), (2, None, long), (3, "u\r\nEvil: 1", long), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (8, "ü", "é" * 5000), (1, "again", long), (None, "n", "no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("digest", "body", "bytes", "first", "path")})
    out = warc.round_trip(df).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.page_id].append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert sorted((r.record_type, r.refers_to, r.url) for r in by[1]) == [("response", None, "again"), ("revisit", 1, "http://a")]
    assert [(r.record_type, r.refers_to) for i in (2, 3, 6, 7) for r in by[i]] == [("revisit", 1)] * 2 + [("response", None)] * 2
    assert bytes(by[8][0].payload) == ("é" * 5000).encode()
    assert warc.round_trip(df.limit(0)).count() == 0


def test_zip64_and_plain_directories(tmp_path):
    import zipfile

    for wide in (False, True):
        path = tmp_path / f"{wide}.zip"
        with open(path, "wb") as f:
            z = warc.ZipWriter(f)
            z.member("archive/data.warc.gz", [b"abc", b"def"])
            z.member("indexes/index.cdx", [b"0 6\n"])
            z.close(zip64=wide)
        assert zipfile.ZipFile(path).read("archive/data.warc.gz") == b"abcdef"
        with open(path, "rb") as f:
            members = warc.zip_members(f, path.stat().st_size)
            method, at, size = members["archive/data.warc.gz"]
            assert (method, warc.read_at(f, at, size)) == (0, b"abcdef")
    with zipfile.ZipFile(tmp_path / "lib.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("m", b"stored")
        z.comment = b"a comment"
    with open(tmp_path / "lib.zip", "rb") as f:
        _, at, size = warc.zip_members(f, (tmp_path / "lib.zip").stat().st_size)["m"]
        assert warc.read_at(f, at, size) == b"stored"


def test_written_records_are_valid(spark, tmp_path):
    import gzip
    import re
    import zipfile

    df = spark.createDataFrame([(1, "http://a/b c", "x" * 300), (2, None, "x" * 300), (2, None, "y")], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, f"file://{tmp_path}/w").first().path
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        member = next(n for n in z.namelist() if n.endswith(".warc.gz"))
        records = re.split(rb"(?=WARC/1\.1\r\n)", gzip.decompress(z.read(member)))[1:]
    heads = [warc.headers(r)[0] for r in records]
    assert [h["warc-type"] for h in heads] == ["warcinfo", *(h["warc-type"] for h in heads[1:])] and len({h["warc-record-id"] for h in heads}) == 4
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) and h["warc-record-id"].startswith("<urn:uuid:") for h in heads)


def foreign_record(kind, payload, url, extra=""):
    http = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\n{extra}Content-Type: application/http\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["none", "cdx", "cdxj.gz"])
def test_archives_of_other_writers(spark, tmp_path, index):
    import gzip
    import zipfile

    payloads = [f"page {i} ".encode() * (i * 700 + 1) for i in range(6)]
    records = [foreign_record("request", b"", "u0"), *(foreign_record("response", p, f"u{i}") for i, p in enumerate(payloads))]
    parts = [gzip.compress(r) for r in records]
    offsets = np.cumsum([0, *map(len, parts)])
    with zipfile.ZipFile(tmp_path / "a.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/rec-1.warc.gz", b"".join(parts))
        z.writestr("archive/rec-2.warc", b"".join(records))
        lines = [(f"u{i - 1}", int(offsets[i]), len(parts[i])) for i in range(1, 7)]
        if index == "cdx":
            z.writestr("indexes/index.cdx", " CDX N b S V g\n" + "".join(f"{u} 20200101000000 {n} {o} rec-1.warc.gz\n" for u, o, n in lines))
        elif index == "cdxj.gz":
            z.writestr("indexes/index.cdxj.gz", gzip.compress("".join(f'{u} 2020 {{"offset": "{o}", "length": "{n}", "filename": "rec-1.warc.gz"}}\n' for u, o, n in lines).encode()))
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")).collect()
    want = sorted((f"u{i}", len(p), hashlib.sha256(p).hexdigest()) for i, p in enumerate(payloads) for _ in range(2))
    assert sorted((r.url, r.payload_bytes, r.payload_digest) for r in got) == want and all(r.page_id is None for r in got)


def test_wrong_payloads_are_noticed():
    bad = foreign_record("response", b"abc", "u", f"WARC-Payload-Digest: sha256:{'0' * 64}\r\n")
    with pytest.raises(ValueError):
        warc.parse_record(bad)


# -- 10 ---------------------------------------------------------------------------------------------------


def brute_weights(texts):
    """(shingles, weights) of every text, by document frequencies counted one by one."""
    sets = [Counter(neardup.shingles(t, neardup.N).tolist()) for t in texts]
    seen = Counter(h for c in sets for h in c)
    return [(np.array(sorted(c), np.uint64), np.array([c[h] * np.log1p(len(texts) / seen[h]) for h in sorted(c)])) for c in sets]


def brute_classes(docs, least):
    rows = [(k, t) for k, t in docs if t is not None]
    w = dict(zip(rows, brute_weights([t for _, t in rows]), strict=True))
    nodes = sorted(w, key=repr)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if a[1] == b[1] or neardup.similarity(w[a], w[b]) >= least:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min((k for k, _ in g if k is not None), default=None) for g in groups.values() for n in g}


def near_corpus(rng):
    docs = [(i, words(rng, rng.randrange(20, 120))) for i in range(60)]
    for g in range(3):
        base = words(rng, 150).split()
        for c in range((5, 25, 60)[g]):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            docs.append((100 + 100 * g + c, " ".join(w)))
    return docs + [(900, docs[0][1]), (901, "one two"), (902, "One, two!"), (903, ""), (904, "")]


def test_near_duplicates_equal_brute_force(spark):
    docs = near_corpus(random.Random(13)) + [(905, None), (906, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("c") for c in CLASH})
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    want = {k: c for (k, _), c in brute_classes(docs, 0.8).items()} | {905: 905, 906: 906}
    assert got == want
    kept = sorted(r.doc_id for r in neardup.keep_one(df).collect())
    assert kept == sorted({c for c in want.values()})


def test_near_duplicates_odd_rows(spark):
    rows = neardup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(set(ODD))
    out = neardup.keep_one(odd(spark))
    assert out.columns == odd(spark).columns and sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, {k for k, _ in ODD}))
    assert neardup.near_duplicates(empty(spark)).count() == 0 == neardup.keep_one(empty(spark)).count()


def test_near_duplicates_of_null_and_repeated_keys(spark):
    rng = random.Random(16)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    docs = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, c), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == len(set(docs))
    assert sorted(Counter((r.class_id, r.class_text) for r in rows).values()) == [1, 1, 1, 1, 2]
    kept = [tuple(r) for r in neardup.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted([(None, a), (None, b), (7, c), (7, d), (7, None)], key=repr)


def test_near_duplicates_count_every_shingle(spark):
    """Two texts of one frequent passage: 0.79 by exact document frequencies, above 0.8 where rare shingles share a count."""
    rng = random.Random(17)
    passage = words(rng, 194, 10**9)
    docs = [passage + " " + words(rng, 10, 10**9) for _ in range(2)] + [passage + " " + words(rng, 400, 10**9) for _ in range(98)]
    docs += [words(rng, 204, 10**9) for _ in range(1900)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = neardup.chunked(df, "doc_id", "text", 40 * neardup.CHUNK_CHARS)  # many chunks
    out = {r.t: r for r in neardup.sketches(rows, len(docs), 40 * neardup.RANGE_CHARS).collect()}  # and ranges
    names = {r.text: r.t for r in df.selectExpr("text", "xxhash64(text) as t").collect()}
    for text, (h, w) in zip(docs, brute_weights(docs), strict=True):
        own, tf = neardup.counted(text)
        assert (own == h).all() and np.allclose(w, neardup.weights(tf, np.frombuffer(out[names[text]].counts, np.uint32), len(docs)))
    assert {r.class_size for r in neardup.near_duplicates(df).collect()} == {1}


def test_edited_copies_of_a_large_group_stay_together(spark):
    """Two changed words of 150: 0.87 or more of the shingles are shared by a pair's original, 0.76 by frequencies in a group of 200."""
    rng = random.Random(18)
    base, docs = words(rng, 150, 10**9).split(), [words(rng, 100, 10**9) for _ in range(200)]
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(150), 2):
            w[at] = f"edit{rng.randrange(10**9)}"
        docs.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate([*docs, " ".join(base)])), "doc_id long, text string")
    near = lambda share: Counter(r.class_id for r in neardup.near_duplicates(df, share=share).collect()).most_common(1)[0][1]
    assert near(neardup.SHARE) == 201 > near(0.0)
    assert neardup.keep_one(df, share=neardup.SHARE).count() == 201


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(14)
    est, true = [], []
    for k in range(20, 380, 20):
        a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 1 << 63, 400 - k).astype(np.uint64)]))
        wa, wb = (2 + (h >> np.uint64(5)) % np.uint64(1000) / 250 for h in (a, b))
        est.append((neardup.samples(a, wa, 256) == neardup.samples(b, wb, 256)).mean())
        true.append(neardup.similarity((a, wa), (b, wb)))
    true = np.array(true)
    off = (np.array(est) - true) / np.sqrt(true * (1 - true) / 256)  # in standard errors of 256 samples
    assert np.abs(off).max() < 4 and (off**2).mean() < 2


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    edges = [(a, b) for a, b in edges if a != b]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


# -- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {"documents": docs.count()}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen[name] = docs.count()
    assert 0 < seen["decontamination"] <= seen["near-dedup"] <= seen["line dedup"] == seen["quality classifier"] <= seen["documents"]
    # each stage against a brute-force version of its own input
    got = {r.doc_id: r for r in C.STAGES[-1][1](spark, docs, DATA).collect()}
    for r in docs.collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not brute_contained([(r.doc_id, r.text) for r in docs.collect()], items)
    assert Counter(r.doc_id for r in docs.collect()).most_common(1)[0][1] == 1


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for c in CLASH})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.where(" or ".join(f"`{c}` <> concat('own ', doc_id)" for c in CLASH)).isEmpty(), name


def test_pipeline_run(spark):
    import corpus_pipeline as C

    out = C.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
