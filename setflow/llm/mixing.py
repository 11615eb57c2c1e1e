"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the wanted words by its weight, at most ``max_copies`` times its own size;
what a source cannot take is shared again by weight. Within a source, documents have preference classes:
a document's expected copies are in proportion to its class's preference, again at most ``max_copies``, and
sum to the source's target. The whole part of the expected copies is allocated for certain, the rest is an
inclusion probability p. Documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and the sample is the start of that ranking whose words fit what the whole
copies leave of the target. Up to three more documents, whose words fill the remaining gap, close it. So the words
taken of a source come near its target: they differ from it by less than one document of the source wherever the
sample ends inside the ranking.

The ranking needs no global sort: keys go to 65,536 steps, word counts per step are summed before any shuffle, and only
the step in which the sample ends is looked into: first its keys, then, of the one key in which it ends, 65,536 steps of
the texts' hashes, and at last single texts. Rows that agree in id and text count as one entry with a number, so no task
orders the rows of a hot id or of a large group of copies.

``u`` is a hash of the id (of the text, where the id is null) and a seed, so reruns agree. The cut may fall between
rows that agree in id and text: then as many of them are taken as fit. Which ones follows from their places in a stored
table; they can differ in other columns only.
Defined results: null texts have size 0; a null source is a source of its own, listed last; sources without
words have target 0 and are never taken, as are empty texts of a source beyond its whole copies; very long texts are
entries like others; an empty table gives none. Input columns named like those added (all start with ``__mix_``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, space_words, stored

STEPS = 65536
#: Names used beside a document's own columns.
ID, TH, SRC, SIZE, PREF = "__mix_id", "__mix_th", "__mix_source", "__mix_size", "__mix_pref"


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(4503599627370496.0)


def by_length(size: Column) -> Column:
    """The usual preference classes: documents of 50 to 5,000 words count twice as much as shorter or longer ones."""
    return F.when(size.between(50, 5000), F.lit(2.0)).otherwise(F.lit(1.0))


def _filled(df: DataFrame, group: list[str], cap: str, weight: str, wanted: str, tie: list[Column]) -> DataFrame:
    """Add ``given``: ``wanted`` shared by weight, none above its cap, excess shared again until none is above.

    In order of cap per weight, a row is full if it cannot take its part of what the rows before it leave;
    the first that is not full sets the level of all that follow.
    """
    order = Window.partitionBy(*group).orderBy(F.col(cap) / F.col(weight), *tie)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("line", (F.col(wanted) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(rest)).withColumn("at", F.row_number().over(order))
    df = df.withColumn("full", F.col("line") * F.col(weight) >= F.col(cap))
    level = F.min(F.when(~F.col("full"), F.struct("at", "line"))).over(Window.partitionBy(*group))["line"]
    return df.withColumn("level", level).withColumn("given", F.when(F.col("full"), F.col(cap)).otherwise(F.col("level") * F.col(weight))).drop("line", "at", "full", "level")


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_copies: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with its ``target``."""
    tie = [F.col("source").isNull(), F.col("source")]
    turn = (F.row_number().over(Window.orderBy(*tie)) - 1) % len(weights) + 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    s = s.withColumn("cap", F.lit(float(max_copies)) * F.col("source_size")).withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    return _filled(s, [], "cap", "w", "wanted", tie).select("source", "source_size", F.col("given").alias("target"))


def _expected(rows: DataFrame, weights: list[float], share: float, max_copies: float) -> DataFrame:
    """One row per source and preference: ``source, pref, source_size, target, sure, p``; few rows."""
    cells = rows.groupBy(F.col(SRC).alias("source"), F.col(PREF).alias("pref")).agg(F.sum(SIZE).alias("n"))
    sources = source_targets(cells.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, max_copies)
    cells = cells.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.withColumn("cap", F.lit(float(max_copies)) * F.col("n")).withColumn("w", F.col("pref") * F.col("n"))
    some = _filled(cells.where("n > 0"), ["source"], "cap", "w", "target", [F.col("pref")]).withColumn("each", F.least(F.col("given") / F.col("n"), F.lit(float(max_copies))))
    none = cells.where("n = 0").withColumn("given", F.lit(0.0)).withColumn("each", F.lit(0.0))
    both = some.unionByName(none).withColumn("sure", F.floor("each"))
    return both.select("source", "pref", "n", "source_size", "target", "sure", (F.col("each") - F.col("sure")).alias("p"))


def _keyed(rows: DataFrame, cells: DataFrame, seed: str) -> DataFrame:
    c = cells.select(F.col("source").alias("__mix_s"), F.col("pref").alias("__mix_w"), F.col("source_size").alias("__mix_total"), F.col("target").alias("__mix_target"), F.col("sure").alias("__mix_sure"), F.col("p").alias("__mix_p"))
    rows = rows.join(c, F.col(SRC).eqNullSafe(F.col("__mix_s")) & (F.col(PREF) == F.col("__mix_w"))).drop("__mix_s", "__mix_w")
    u, p = uniform(F.coalesce(F.col(ID).cast("string"), F.concat(F.lit("null:"), F.col(TH).cast("string"))), seed), F.col("__mix_p")
    rows = rows.withColumn("__mix_key", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    return rows.withColumn("__mix_step", F.floor(F.col("__mix_key") / (1 + F.col("__mix_key")) * STEPS))


#: The ranking: by key, then, within one id, by text.
PLACE = ["__mix_key", "__mix_slot", TH, ID, SIZE]
SLOT = f"shiftright({TH}, 48)"


def _ending(rows: DataFrame, room: DataFrame, at: str) -> DataFrame:
    """Per source of ``room(__mix_s, room)``: the value of ``at`` in whose rows the running sum of words passes the room, and what is left of the room before it.

    ``rows`` have ``SRC``, ``at`` and ``n`` rows of ``SIZE`` words each. Sources whose rows all fit are missing.
    """
    per = rows.groupBy(SRC, at).agg(F.sum(F.col(SIZE) * F.col("n")).alias("words"))
    upto = F.sum("words").over(Window.partitionBy(SRC).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    over = per.withColumn("upto", upto).join(room, F.col(SRC).eqNullSafe(F.col("__mix_s"))).where("upto > room")
    end = over.groupBy("__mix_s").agg(F.min(F.struct(at, "words", "upto", "room")).alias("e"))
    return end.select("__mix_s", F.col(f"e.{at}").alias("end"), (F.col("e.room") - F.col("e.upto") + F.col("e.words")).alias("room"))


def _cuts(rows: DataFrame, left: DataFrame) -> DataFrame:
    """Per source whose documents do not all fit: ``__mix_s, __mix_end`` (a step), ``__mix_cut`` (the entry in which the
    sample ends), ``__mix_some`` of whose ``__mix_n`` rows are in, and the ``gap`` to the target."""
    one = rows.where("__mix_key is not null").withColumn("n", F.lit(1).cast("long"))
    ends = stored(_ending(one, left, "__mix_step").withColumnRenamed("end", "__mix_end"), "ends")
    last = one.join(ends.select(F.col("__mix_s").alias("s"), "__mix_end"), F.col(SRC).eqNullSafe(F.col("s")) & (F.col("__mix_step") == F.col("__mix_end")))
    last = stored(last.groupBy(SRC, *[c for c in PLACE if c != "__mix_slot"]).agg(F.count("*").alias("n")).withColumn("__mix_slot", F.expr(SLOT)), "last")
    room = ends.select("__mix_s", "room")
    inner = last
    for at in ("__mix_key", "__mix_slot"):
        found = _ending(inner, room, at)
        inner = inner.join(found.select(F.col("__mix_s").alias("t"), "end"), F.col(SRC).eqNullSafe(F.col("t")) & (F.col(at) == F.col("end"))).drop("t", "end")
        room = found.select("__mix_s", "room")
    # of one key and step of the hashes: entry by entry
    words = F.sum(F.col(SIZE) * F.col("n")).over(Window.partitionBy(SRC).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)) - F.col(SIZE) * F.col("n")
    entry = inner.withColumn("before", words).join(room, F.col(SRC).eqNullSafe(F.col("__mix_s"))).where(f"before + {SIZE} * n > room and before <= room")
    cut = entry.groupBy("__mix_s").agg(F.min(F.struct(*PLACE, "n", "before", "room")).alias("e"))
    cut = cut.select("__mix_s", F.struct(*[F.col(f"e.{c}").alias(c) for c in PLACE]).alias("__mix_cut"), F.expr(f"cast(floor((e.room - e.before) / e.{SIZE}) as long)").alias("__mix_some"), F.col("e.n").alias("__mix_n"), (F.col("e.room") - F.col("e.before")).alias("gap"))
    cut = cut.withColumn("gap", F.col("gap") - F.col("__mix_some") * F.col(f"__mix_cut.{SIZE}"))
    out = stored(ends.select(F.col("__mix_s").alias("s"), "__mix_end").join(cut, F.col("s").eqNullSafe(F.col("__mix_s"))).drop("s"), "cuts")
    discard(ends, last)
    return out


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``__mix_in``, how many of a document's equal rows are in its source's sample (all: null), and ``__mix_n``, how many there are."""
    rows = rows.join(cuts, F.col(SRC).eqNullSafe(F.col("__mix_s")), "left")
    here, cut, step, end = F.struct("__mix_key", F.expr(SLOT).alias("__mix_slot"), TH, ID, SIZE), F.col("__mix_cut"), F.col("__mix_step"), F.col("__mix_end")
    all_ = end.isNull() | (step < end) | ((step == end) & (here < cut))
    some = F.when(F.col("__mix_key").isNull(), 0).when(all_, None).when((step == end) & (here == cut), F.col("__mix_some")).otherwise(0)
    return rows.withColumn("__mix_in", some).drop("__mix_s", "__mix_end", "__mix_cut", "__mix_some")


def _kind(rows: DataFrame) -> str:
    return rows.select(F.struct(ID, TH).alias("x")).schema["x"].dataType.simpleString()


def _prepared(docs: DataFrame, prefer, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({ID: F.col(id_col), TH: F.xxhash64(text), SRC: F.col(source_col), SIZE: F.size(space_words(text)).cast("long")})
    return rows.withColumn(PREF, prefer(F.col(SIZE)))


def _filled_up(sampled: DataFrame, cut: DataFrame, kind: str) -> DataFrame:
    """``__mix_g, __mix_fill``: per source up to three documents (id, hash, how many equal rows), whose words fill the gap.

    Twice the longest that fits, then the one that comes nearest. Of equal rows one is chosen at most.
    """
    filled = cut.select(F.col("__mix_s").alias("__mix_g"), "gap", F.array().cast(f"array<{kind}>").alias("__mix_fill"))
    old = []
    for fits in ("over = 0", "over = 0", f"miss < gap and (over = 0 or miss < {SIZE})"):
        rest = sampled.join(filled, F.col(SRC).eqNullSafe(F.col("__mix_g"))).where(~F.exists("__mix_fill", lambda f: f.eqNullSafe(F.struct(ID, TH))))
        rest = rest.withColumn("miss", F.abs(F.col(SIZE) - F.col("gap"))).withColumn("over", (F.col(SIZE) > F.col("gap")).cast("int")).where(fits)
        best = rest.groupBy(F.col("__mix_g").alias("g")).agg(F.min(F.struct("miss", "__mix_key", SIZE, ID, TH)).alias("f"))
        joined = filled.join(best, F.col("__mix_g").eqNullSafe(F.col("g")), "left")
        more = F.when(F.col("f").isNotNull(), F.concat("__mix_fill", F.array(F.struct(F.col(f"f.{ID}"), F.col(f"f.{TH}"))))).otherwise(F.col("__mix_fill"))
        filled = stored(joined.select("__mix_g", (F.col("gap") - F.coalesce(F.col(f"f.{SIZE}"), F.lit(0))).alias("gap"), more.alias("__mix_fill")), "fills")
        old.append(filled)
    chosen = filled.select("__mix_g", F.explode_outer("__mix_fill").alias("f"))
    equal = sampled.select(F.col(SRC).alias("s"), F.struct(ID, TH).alias("id"))
    n = chosen.join(equal, F.col("__mix_g").eqNullSafe(F.col("s")) & F.col("f").eqNullSafe(F.col("id")), "left").groupBy("__mix_g", "f").agg(F.count("*").alias("n"))
    out = stored(n.groupBy("__mix_g").agg(F.collect_list(F.struct(F.col("f").alias("id"), "n")).alias("__mix_fill")), "fills")
    discard(*old)
    return out


def _places_taken(rows: DataFrame) -> DataFrame:
    """``rows(__mix_want, __mix_place, ...)`` with ``__mix_take``: whether a row is among the first ``__mix_want`` places of its equals.

    Counts per part of the stored table tell in which part the last one taken is; only that part is ordered.
    """
    key, part = [SRC, ID, TH], F.expr("shiftright(__mix_place, 33)")
    counts = rows.groupBy(*key, part.alias("part")).agg(F.count("*").alias("n"), F.max("__mix_want").alias("want"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    end = counts.withColumn("upto", upto).where("upto >= want and upto - n < want")
    end = end.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], "part", (F.col("want") - F.col("upto") + F.col("n")).alias("nth"))
    same = [F.col(c).eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(key)]
    there = rows.select(*key, "__mix_place", part.alias("p")).join(end, [*same, F.col("p") == F.col("part")])
    nth = there.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("__mix_place"))).where("i = nth")
    last = stored(nth.select("k0", "k1", "k2", F.col("__mix_place").alias("last")), "places")
    return rows.join(last, same, "left").withColumn("__mix_take", F.col("__mix_place") <= F.col("last")).drop("k0", "k1", "k2", "last")


def mix(docs: DataFrame, weights: list[float], share: float, max_copies: float = 2.0, prefer=by_length, seed: str = "mix-1:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``__mix_copies`` (how often the mix takes a document), ``__mix_size``, ``__mix_total`` and ``__mix_target`` (of its source)."""
    full = _prepared(docs, prefer, id_col, text_col, source_col)
    slim = stored(full.select(ID, TH, SRC, SIZE, PREF), "sizes")
    cells = stored(_expected(slim, weights, share, max_copies), "cells")
    rows = _keyed(slim, cells, seed)
    left = cells.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("n"))).alias("room"), F.max("p").alias("p")).where("p > 0").select(F.col("source").alias("__mix_s"), "room")
    cut = _cuts(rows, left)
    sampled = _with_cuts(rows, cut.drop("gap")).where(f"__mix_key is not null and __mix_in = 0 and {SIZE} > 0")
    filled = _filled_up(sampled, cut, _kind(slim))
    rows = _with_cuts(_keyed(full, cells, seed), cut.drop("gap")).join(filled, F.col(SRC).eqNullSafe(F.col("__mix_g")), "left")
    rows = rows.withColumn("__mix_f", F.when(F.col("__mix_key").isNotNull(), F.try_element_at(F.filter("__mix_fill", lambda f: f["id"].eqNullSafe(F.struct(ID, TH))), F.lit(1))))
    want = F.when(F.col("__mix_f").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("__mix_in"))
    of = F.coalesce(F.col("__mix_f.n"), F.col("__mix_n"))
    rows = rows.withColumn("__mix_want", want).withColumn("__mix_part", F.coalesce((want > 0) & (want < of), F.lit(False)))
    discard(slim)
    whole = rows.where("not __mix_part").withColumn("__mix_take", F.coalesce(F.col("__mix_want") > 0, F.lit(True)))
    out = whole
    if not (cut.where("__mix_some > 0 and __mix_some < __mix_n").isEmpty() and filled.where(F.exists("__mix_fill", lambda f: f["n"] > 1)).isEmpty()):
        part = stored(rows.where("__mix_part").withColumn("__mix_place", F.monotonically_increasing_id()), "equals")
        out = whole.unionByName(_places_taken(part).drop("__mix_place"))
    taken = F.when(F.col("__mix_take"), 1).otherwise(0)
    return out.withColumn("__mix_copies", (F.col("__mix_sure") + taken).cast("long")).drop("__mix_g", "__mix_fill", "__mix_f", "__mix_in", "__mix_n", "__mix_want", "__mix_part", "__mix_take", "__mix_step", "__mix_key", "__mix_sure", "__mix_p", PREF)


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the given columns."""
    copies = F.explode(F.expr("sequence(1, cast(__mix_copies as int))"))
    return mixed.where("__mix_copies > 0").select(*columns, copies.alias("__mix_copy")).select(*columns)
