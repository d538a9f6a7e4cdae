"""Line dedup: repeated runs of lines are found over the suffixes of line-ID sequences and later copies go.

A document is its sequence of non-blank lines, a line's ID a 64-bit hash.  A run is a stretch of successive
lines with ``min_words`` words or more in all (words are counted by blanks).  A line is deleted when it lies
in a run that also occurs earlier in the corpus; "earlier" is the order of (key, text hash, line number).

Method, in DataFrame operations only:

1. Lines whose ID occurs once end every repeated run, so only stretches of repeated lines ("islands") of
   enough words go on.
2. Prefix doubling: the name of the first 2^k lines of each suffix is the hash of the names of its two
   halves, taken with ``lead`` inside the island.  Suffixes with equal names share 2^k lines.  As order
   between unequal suffixes decides nothing here, names take the place of ranks and no global sort is made.
3. Each suffix is cut at the fewest lines that reach ``min_words`` (and, from the other end, each prefix).
   Two overlapping names of length 2^k name that window.  Suffixes of one name form an LCP interval; the
   smallest position in it is the copy that stays, and every other window is deleted.
4. Any run of enough words is the union of such windows from its starts and its ends, so the windows of
   fixed depth delete exactly the lines of all maximal repeated runs.

A window has ``min_words`` lines at most, hence the number of doublings is fixed and no list of a group's
members is ever gathered; groups are reduced to their first member before they are joined back.

Nulls: a null text stays null.  Blank lines are kept and don't part a run; empty texts and empty tables stay as they are.
Very long texts are cut into lines whole, in one row.  Of repeated lines in one text the first stays.  Rows equal in key and text
count as one document and share its result; null keys are keys like others.  Further columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh, scratch, written

MIN_WORDS = 50


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, q, p, h, w): q counts non-blank lines, p all lines, w words (at least 1)."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    parts = F.filter(
        F.transform(F.split(F.col("x"), "\n"), lambda x, i: F.struct(i.alias("p"), F.xxhash64(x).alias("h"), words(F.trim(x)).alias("w"), (F.trim(x) == "").alias("blank"))),
        lambda s: ~s["blank"],
    )
    out = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x")).where("x is not null")
    return out.select("k", "t", F.posexplode(parts).alias("q", "s")).select("k", "t", "q", "s.p", "s.h", "s.w")


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, t, p) of the lines to delete; ``lines`` is a stored line_table."""
    repeated = written(lines.groupBy("h").count().where("count > 1").select("h"), "lines-repeated").hint("merge")
    doc = ["k", "t"]
    w = F.least(F.col("w"), F.lit(min_words)).cast("long")  # a line of enough words is a run whatever follows
    active = lines.join(repeated, "h").withColumn("w", w)
    active = active.repartition(*doc).dropDuplicates([*doc, "q"])
    active = active.withColumn("island", F.col("q") - F.row_number().over(Window.partitionBy(*doc).orderBy("q")))
    by = Window.partitionBy(*doc, "island")
    along = by.orderBy("q")
    active = active.withColumn("total", F.sum("w").over(by)).where(F.col("total") >= min_words)
    active = active.withColumn("c", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    active = active.withColumn("s", F.col("c") - F.col("w")).withColumns({"lo": F.min("q").over(by), "hi": F.max("q").over(by), "n0": F.col("h")})
    steps = max(1, (min_words - 1).bit_length())
    for k in range(1, steps):
        nxt = F.lead(f"n{k - 1}", 1 << (k - 1)).over(along)
        active = active.withColumn(f"n{k}", F.when(nxt.isNotNull(), F.xxhash64(f"n{k - 1}", nxt)))
    # fewest lines from q on (end, exclusive) and up to q (start) that reach min_words
    end = F.min("q").over(by.orderBy("s").rangeBetween(min_words, 2 * min_words))
    start = F.max("q").over(by.orderBy("c").rangeBetween(-2 * min_words, -min_words)) + 1
    active = active.withColumns({"end": F.coalesce(end, F.when(F.col("total") - F.col("s") >= min_words, F.col("hi") + 1)), "start": F.coalesce(start, F.when(F.col("c") >= min_words, F.col("lo")))})
    active = written(active.select(*doc, "q", "p", "start", "end", *[f"n{k}" for k in range(steps)]), "lines-active")

    either = F.array(F.struct(F.lit(True).alias("fwd"), F.col("q").alias("a"), F.col("end").alias("b")), F.struct(F.lit(False).alias("fwd"), F.col("start").alias("a"), (F.col("q") + 1).alias("b")))
    spans = active.select(*doc, F.explode(either).alias("e")).select(*doc, "e.*").where("a is not null and b is not null")
    spans = spans.withColumn("len", F.col("b") - F.col("a")).withColumn("level", F.floor(F.log2(F.col("len"))).cast("int"))
    names = active.select(*doc, F.col("q").alias("at"), F.array(*[f"n{k}" for k in range(steps)]).alias("names"))
    left = spans.withColumn("second", F.expr("b - shiftleft(1, level)"))
    x, y = left.alias("x"), names.alias("y").hint("merge")
    named = x.join(y, [F.col("x.k").eqNullSafe(F.col("y.k")), F.col("x.t") == F.col("y.t"), F.col("x.a") == F.col("y.at")])
    named = named.select("x.*", F.get("y.names", F.col("x.level")).alias("n_a"))
    x, y = named.alias("x"), names.alias("y").hint("merge")
    named = x.join(y, [F.col("x.k").eqNullSafe(F.col("y.k")), F.col("x.t") == F.col("y.t"), F.col("x.second") == F.col("y.at")])
    named = named.select("x.k", "x.t", "x.fwd", "x.a", "x.b", "x.len", "x.n_a", F.get("y.names", F.col("x.level")).alias("n_b"))
    named = written(named, "lines-named")

    group = ["fwd", "len", "n_a", "n_b"]
    first = named.groupBy(*group).agg(F.min(F.struct("k", "t", "a")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*group, "first")
    first = written(first, "lines-first").hint("merge")
    later = named.join(first, group).where(~F.struct("k", "t", "a").eqNullSafe(F.col("first")))
    marks = later.select("k", "t", F.when(F.col("fwd"), F.col("a")).otherwise(F.col("b") - 1).alias("q"), F.when(F.col("fwd"), F.col("b")).alias("to"), F.when(~F.col("fwd"), F.col("a")).alias("from"))
    rows = active.select(*doc, "q", "p", F.lit(None).cast("int").alias("to"), F.lit(None).cast("int").alias("from")).unionByName(marks.withColumn("p", F.lit(None).cast("int")))
    rows = rows.groupBy(*doc, "q").agg(F.max("p").alias("p"), F.max("to").alias("to"), F.min("from").alias("from"))
    order = Window.partitionBy(*doc)
    reach = F.max("to").over(order.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)) > F.col("q")
    back = F.min("from").over(order.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, 0)) <= F.col("q")
    return rows.withColumns({"x": reach, "y": back}).where("x or y").select(*doc, "p")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``df`` with later copies of repeated line runs deleted from the text.

    removed: name of a column for the number of lines deleted, if wanted.
    """
    with scratch() as keep:
        lines = written(line_table(df, key, text), "lines")
        drop = later_copies(lines, min_words).groupBy("k", "t").agg(F.collect_list("p").alias("drop")).select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("drop").alias("__drop"))
        drop = keep(written(drop, "lines-drop")).hint("merge")
    (h,) = fresh(df, "own_text")
    out = df.withColumn(h, F.xxhash64(F.col(text))).alias("d").join(drop.alias("e"), [F.col(f"d.{key}").eqNullSafe(F.col("e.__k")), F.col(f"d.{h}") == F.col("e.__t")], "left")
    lines_of = F.split(F.col(f"d.{text}"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("e.__drop"))
    rest = F.when(F.col("e.__drop").isNull(), F.col(f"d.{text}")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines_of, i)), "\n"))
    columns = [rest.alias(c) if c == text else F.col(f"d.`{c}`") for c in df.columns]
    if removed:
        columns.append(F.coalesce(F.size(F.col("e.__drop")), F.lit(0)).cast("long").alias(removed))
    return out.select(*columns)
