"""Benchmark decontamination by a positional inverted index.

The training texts are tokenised once into stored postings ``(doc_id, th, tid, pos)``; ``th`` is a hash
of the text, so that repeated or null ids never mix the positions of two texts, and ``tid`` a hash of the
term. A test phrase is looked up from its rarest term: the postings of that term, shifted by the term's
offset, are candidate starts; they are intersected with the shifted lists of the next rarest terms, and
what is left is compared with the text itself, so that the result is exact. Until then a candidate carries its window's
number only; the items that have the window join after the comparison.

An index of all terms (``build_index(docs)``) can be kept and asked again; without one only the terms of the
test phrases get postings.

Defined results: a null or empty text has no words; null document ids are ids of their own kind; an item with a
null id hits like any other (words, ``contaminated``) but has no name to give, so ``item_ids`` leaves it out and may be
empty for a contaminated document, as in SQL's count of distinct items; repeated rows each get their row; an empty
table gives none, an empty benchmark hits nothing; benchmark items without words are ignored; a very long text is split
into words whole by one task, its postings are rows like others. Only id and text are read, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, discard, stored

KEY = ["doc_id", "th"]
#: Up to so many windows, a checked number, their plan (about 60 bytes each) is broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def phrase_windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored distinct windows ``(wid, terms)``: every ``width`` consecutive words of an item, or the whole item if it is shorter; and ``(wid, item)``.

    ``wid`` is a hash; should two windows share one, another seed is tried.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))))
    cut = words.select("item", "words", starts.alias("at")).select("item", F.slice("words", F.col("at"), width).alias("terms"))
    for seed in range(9):
        wid = F.xxhash64("terms") if seed == 0 else F.xxhash64(F.lit(seed), "terms")
        windows = stored(cut.select("terms").distinct().withColumn("wid", wid), "windows")
        if windows.groupBy("wid").count().where("count > 1").isEmpty():
            return windows, stored(cut.select(wid.alias("wid"), "item").distinct(), "items")
        discard(windows)
    raise RuntimeError("no hash tells all windows apart")


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings of all terms, or of those in ``terms(tid)``. One narrow pass unless ``terms`` is too large to broadcast."""
    rows = _texts(docs, id_col, text_col).select(*KEY, F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))
    rows = rows.select(*KEY, F.xxhash64("term").alias("tid"), "pos")
    return stored(rows if terms is None else rows.join(terms, "tid", "left_semi"), "postings")


def _ranked(windows: DataFrame, index: DataFrame, lists: int) -> DataFrame:
    """One row per window with its ``lists`` rarest terms and their offsets; fewer where the window is shorter.

    Both sides of the join are stored, so that it has plain shuffles, of which Spark can split those of a frequent term.
    """
    counts = stored(index.groupBy("tid").agg(F.count("*").alias("n")), "counts")
    spots = stored(windows.select("wid", F.posexplode("terms").alias("off", "term")).select("wid", "off", F.xxhash64("term").alias("tid")), "terms")
    ranked = spots.join(counts, "tid", "left").withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy(F.coalesce("n", F.lit(0)), "off")))
    pick = [F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in range(1, lists + 1) for c in ("tid", "off")]
    out = stored(ranked.groupBy("wid").agg(*pick), "ranked")
    discard(counts, spots)
    return out


def phrase_candidates(index: DataFrame, ranked: DataFrame, lists: int) -> DataFrame:
    """``(doc_id, th, wid, start)`` where the ``lists`` rarest terms of a window all stand at their offsets."""
    plan = ranked.select("wid", *[f"{c}{r}" for r in range(1, lists + 1) for c in ("tid", "off")])
    if ranked.count() <= BROADCAST_WINDOWS:
        plan = F.broadcast(plan)
    first = index.join(plan.withColumnRenamed("tid1", "tid"), "tid")
    found = first.withColumn("start", F.col("pos") - F.col("off1")).where("start >= 0").drop("tid", "pos", "off1")
    for r in range(2, lists + 1):
        tids = plan.select(F.col(f"tid{r}").alias("tid")).where("tid is not null").distinct()
        other = index.join(tids, "tid", "left_semi").select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("tid").alias("i2"), F.col("pos").alias("p2"))
        need = found.where(f"tid{r} is not null")
        met = need.join(other, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col(f"tid{r}") == F.col("i2")) & (F.col("start") + F.col(f"off{r}") == F.col("p2")), "left_semi")
        found = met.unionByName(found.where(f"tid{r} is null"))
    return found.select(*KEY, "wid", "start")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, lists: int = 3, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row per document: ``doc_id, th, n_words, hits (start, length, wid), n_hit, item_ids, contaminated``.

    A word is hit if it lies inside any occurrence of a window. ``index``: postings of these documents, if they exist already.
    """
    windows, owners = phrase_windows(items, width)
    own = index is None
    if own:
        vocabulary = windows.select(F.explode("terms").alias("term")).select(F.xxhash64("term").alias("tid")).distinct()
        index = build_index(docs, vocabulary, id_col, text_col)
    ranked = _ranked(windows, index, lists)
    found = stored(phrase_candidates(index, ranked, lists).distinct(), "candidates")
    if own:
        discard(index)
    spots = found.join(windows, "wid").groupBy(*KEY).agg(F.collect_list(F.struct("start", "wid", "terms")).alias("spots"))
    spots = spots.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "spots")
    rows = _texts(docs, id_col, text_col)
    rows = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left").drop("d2", "t2")
    rows = rows.withColumn("words", alnum_words(F.col("text")))
    none = F.expr("cast(array() as array<struct<start:int,length:int,wid:bigint>>)")
    hits = F.expr("""transform(filter(spots, s -> slice(words, s.start + 1, size(s.terms)) = s.terms),
                     s -> struct(s.start as start, size(s.terms) as length, s.wid as wid))""")
    rows = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), F.coalesce(hits, none).alias("hits"))
    spread = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    checked = stored(rows.withColumn("n_hit", F.size(spread).cast("long")), "checked")
    discard(found, ranked, windows)
    # the names of the items, for the documents that were hit
    wids = checked.select(*KEY, F.explode(F.array_distinct("hits.wid")).alias("wid")).distinct()
    names = stored(wids.join(owners, "wid").where("item is not null").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("item_ids")), "names")
    discard(owners)
    names = names.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "item_ids")
    out = checked.join(names, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left").drop("d2", "t2")
    return out.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))).withColumn("contaminated", F.col("n_hit") > 0)


def proximity_matches(index: DataFrame, patterns: DataFrame, slop: int) -> DataFrame:
    """``(pid, doc_id, start)``: the places where all terms of a pattern ``(pid, terms)`` stand within ``slop`` words.

    ``start`` is the first position of such a stretch around an occurrence of the pattern's rarest term. The
    other lists are met on ``pos div slop`` and its neighbours, so every join is an equality join.
    """
    counts = index.groupBy("tid").agg(F.count("*").alias("n"))
    spots = patterns.select("pid", F.explode(F.array_distinct("terms")).alias("term")).select("pid", F.xxhash64("term").alias("tid")).join(counts, "tid", "left")
    spots = spots.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.coalesce("n", F.lit(0)), "tid"))).withColumn("k", F.count("*").over(Window.partitionBy("pid")))
    first = index.join(spots.where("rank = 1").select("pid", "tid", "k"), "tid").select("pid", "k", *KEY, F.col("tid").alias("t1"), F.col("pos").alias("p1"))
    near = first.join(spots.where("rank > 1").select("pid", "tid"), "pid")
    near = near.withColumn("cell", F.explode(F.expr(f"array(p1 div {slop} - 1, p1 div {slop}, p1 div {slop} + 1)")))
    other = index.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("tid").alias("i2"), F.col("pos").alias("p2"), F.expr(f"pos div {slop}").alias("c2"))
    met = near.join(other, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("tid") == F.col("i2")) & (F.col("cell") == F.col("c2")))
    met = met.where(F.abs(F.col("p1") - F.col("p2")) < slop).select("pid", "k", *KEY, "t1", "p1", F.col("tid").alias("t"), F.col("p2").alias("p"))
    own = first.select("pid", "k", *KEY, "t1", "p1", F.col("t1").alias("t"), F.col("p1").alias("p"))
    around = met.unionByName(own).groupBy("pid", "k", *KEY, "t1", "p1").agg(F.collect_set(F.struct("p", "t")).alias("seen"))
    starts = F.expr(f"array_sort(filter(transform(seen, a -> a.p), s -> size(array_distinct(transform(filter(seen, b -> b.p >= s and b.p < s + {slop}), b -> b.t))) = k))")
    return around.withColumn("starts", starts).where("size(starts) > 0").select("pid", "doc_id", F.col("starts")[0].alias("start")).distinct()
