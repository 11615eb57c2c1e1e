"""Near-duplicate detection by b-bit MinHash.

1. A document's words become a set of shingles, each a 64-bit hash. Documents of one set form a class, named by a
   number of its own; all later steps see a class once, so copies cost nothing.
2. 128 minima per class give band keys for candidates (32 bands of 4 whole minima: two sets of Jaccard
   similarity 0.8 share no band with probability 5e-8) and a packed signature of the 2 low bits of every minimum.
3. In each band bucket a class is compared with one member, the centre: the packed signatures estimate
   the similarity by counting equal bit pairs, corrected for chance agreement (a quarter); clear misses (five
   standard deviations below the threshold) go, the rest is confirmed on the full sets.
4. Components are found by min-label propagation over stored tables.
5. A bucket whose members are still in different components may hide links between members that neither is
   linked to the centre. While an exact join of those members would list more than ``FEW`` pairs per member, further
   rounds compare them with other centres (by another hash each round), as long as that finds links: each costs one pair
   per member and bucket, and grows the components, so that few pairs of different components are left.
6. The rest is joined exactly: shingles are ordered from rare to frequent among the undecided members, two
   sets that are similar enough must share one of their first few shingles, and the places of a shared shingle bound
   the overlap. Of a shingle's members, those outside its most frequent component meet the others of other components. The
   pairs that pass the bounds and the signatures are confirmed on the full sets. So no candidate pair inside a bucket is left
   undecided, no group is gathered in one task, and pairs inside a component are never listed. Where
   a group of undecided members has no links at all, its pairs that share an early shingle are all tried; nothing is capped.

Defined results: texts without words have the empty set, are their own component and kept. Rows with a null id
have no component (null), link nothing, and are kept. Rows that share an id are one document with several texts, whose
classes are tied together. Ids may be of any type with an order; the least of a component names it. Repeated rows are rows of
one class; very long texts have larger sets and are held one at a time. An empty table gives an empty result. Columns of
the input do not clash: only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, small_batches, stored

PERMS, ROWS, LOW_BITS = 128, 4, 2
#: Pairs of different components that the exact join may list, per undecided class, before another round of centres is tried first.
FEW = 32
#: The same for pairs that share an early shingle, before their bounds are looked at, per member of a bucket.
MET = 64
#: Rounds of other centres at most; the exact join decides what they leave.
ROUNDS = 12
_rng = np.random.default_rng(20240607)
MULT = _rng.integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; with fewer words the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """128 minima of 32 bits, in blocks so that memory stays bounded for very long texts."""
    best = np.full(PERMS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 512):
        best = np.minimum(best, ((s[at : at + 512, None] * MULT + ADD) >> np.uint64(32)).min(axis=0))
    return best


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 32 pairs in each of four words."""
    pairs = (m & np.uint64(3)).reshape(4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(pairs, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate for packed signatures ``(..., 4)``."""
    x = a ^ b
    differ = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    equal = 1 - np.bitwise_count(differ).sum(axis=-1) / PERMS
    chance = 0.5**LOW_BITS
    return (equal - chance) / (1 - chance)


def lowest(threshold: float) -> float:
    """Estimates under this are five standard deviations below the threshold."""
    chance = 0.5**LOW_BITS
    equal = chance + (1 - chance) * threshold
    return threshold - 5 * (equal * (1 - equal) / PERMS) ** 0.5 / (1 - chance)


def _signed(width: int):
    """Batches of (id, hash of the text, text) to set fingerprints, packed signatures and band keys."""

    def flat(x, k):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))

    def run(batches):
        for b in batches:
            n, high, low, sig, bands = [], [], [], [], []
            for text in b.column(2):
                s = shingles(text.as_py(), width)
                d = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                n.append(len(s)), high.append((d >> 64) - 2**63), low.append((d & (2**64 - 1)) - 2**63)
                m = minima(s)
                sig.append(pack(m).view(np.int64))
                rows, key = m.reshape(-1, ROWS), np.arange(PERMS // ROWS, dtype=np.uint64)
                for k in range(ROWS):
                    key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), flat(sig, 4), flat(bands, PERMS // ROWS)], ["doc_id", "th", "n_shingles", "set_a", "set_b", "sig", "bands"])

    return run


def _confirm(width: int, percent: int):
    """Batches of (a, b, text_a, text_b) to the pairs whose full sets are similar enough."""

    def run(batches):
        known = lru_cache(32)(lambda x: shingles(x, width))  # the smaller id of a pair comes again and again
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = known(x.as_py()), shingles(y.as_py(), width)
                both = 0 if percent * max(len(s), len(t)) > 100 * min(len(s), len(t)) else len(np.intersect1d(s, t, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass on the full sets; ``texts(node, text)``."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(width, percent), "a long, b long").distinct()


def _likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) without those whose signatures are a clear miss; ``sigs(node, sig)``."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.array("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.array("sig").alias("sb")), "b")
    return both.where(_estimate("sa", "sb") >= lowest(percent / 100)).select("a", "b")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(id, label)``: the smallest id reachable over ``edges(a, b)``, for ids with a link.

    Each round every id takes the smallest label next to it, and then the label of that label, so long
    chains shorten fast. Rounds are stored tables; the driver sees only whether anything changed. ``labels`` of an
    earlier call with fewer edges is a start.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"))
    if labels is not None:
        now = now.unionByName(labels.select("id", "label")).groupBy("id").agg(F.min("label").alias("label"))
    now = stored(now, "labels")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label")
        step = near.unionByName(now).groupBy("id").agg(F.min("label").alias("label"))
        hop = now.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = step.join(hop, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = stored(new, "labels")
        done = new.join(now.withColumnRenamed("label", "was"), "id").where("label != was").isEmpty()
        discard(now)
        if done:
            discard(both)
            return new
        now = new


def _tokens(width: int):
    def run(batches):
        for b in batches:
            found = [shingles(t.as_py(), width).view(np.int64) for t in b.column(1)]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, found)), pa.int32()), flat], ["id", "n", "tokens"])

    return run


def _prefixes(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Stored ``(token, id, n, at)``: the first shingles of ``members(id)``, of which two sets that are similar enough share one.

    Places count from 0 in the order (frequency, shingle). Shingles that no other member has come first and need no row.
    """
    sets = stored(texts.join(members.select(F.col("id").alias("node")), "node", "left_semi").select("node", "text").mapInArrow(_tokens(width), "id long, n int, tokens array<long>"), "tokens")
    rows = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = stored(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    own = Window.partitionBy("id")
    shared = rows.join(often, "token").withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1)
    first = shared.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100))
    first = stored(first.select("token", "id", "n", "at"), "first")
    discard(sets, often)
    return first


def _listed(first: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """``first`` with labels and each token's most frequent label; and how many pairs the exact join would list at most."""
    rows = first.join(labels, "id")
    by = rows.groupBy("token", "label").agg(F.count("*").alias("k"))
    tokens = by.groupBy("token").agg(F.sum("k").alias("all"), F.max(F.struct("k", "label")).alias("m")).where("all > m.k")
    tokens = stored(tokens.select("token", F.col("m.label").alias("major"), "all", F.col("m.k").alias("k")), "majors")
    pairs = tokens.agg(F.sum(F.col("all").cast("double") * (F.col("all") - F.col("k")))).first()[0]
    # stored, so that the two sides of the exact join are plain shuffles, whose large partitions Spark can split
    rows = stored(rows.join(tokens.select("token", "major"), "token"), "rows")
    discard(tokens)
    return rows, int(pairs or 0)


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels whose sets can be similar enough, once per shared early shingle; loses none. ``rows(token, id, n, at, label, major)``.

    If sets of n and m shingles share the shingle at places i and j, and it is the first they share, they overlap in at
    most 1 + min(n - i - 1, m - j - 1) shingles; they need percent / (100 + percent) of n + m.
    """
    x, y = rows.where("label != major").alias("x"), rows.alias("y")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    once = (F.col("y.label") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & once & enough)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _may_link(rows: DataFrame, percent: int) -> DataFrame:
    return _met(rows, percent).distinct()


def _named(some: DataFrame) -> tuple[DataFrame, bool]:
    """Stored classes ``(set_a, set_b, id, th, sig, bands, node)``, and whether nodes are numbers of their own.

    A class has the least of its ids, and its text's hash. Where every class has another whole number as its id, that is its node.
    """
    classes = stored(some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("set_a", "set_b", "rep.*", "sig", "bands").withColumnRenamed("doc_id", "id"), "classes")
    whole = classes.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    own = not whole or not classes.groupBy("id").count().where("count > 1").isEmpty()
    return classes.withColumn("node", F.monotonically_increasing_id() if own else F.col("id").cast("long")), own


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; linked are documents with 100 |A & B| >= percent |A | B|."""
    spark = docs.sparkSession
    with small_batches(spark), scratch(spark) as keep:
        own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
        kind = own.schema["doc_id"].dataType.simpleString()
        sets = stored(own.mapInArrow(_signed(width), f"doc_id {kind}, th long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>"), "sets")
        some = sets.where("n_shingles > 0 and doc_id is not null")
        classes, numbered = _named(some)
        if numbered:
            classes = stored(classes, "nodes")
        members = classes.select("node", F.posexplode("bands").alias("band", "key"))
        # stored, so that the join's two sides are plain shuffles, whose large partitions Spark can split
        crowded = stored(members.groupBy("band", "key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "crowded")
        members = stored(members.join(crowded, ["band", "key"]).select("band", "key", "node", "a"), "members")
        discard(crowded)
        # the texts that any later step may ask for: those with company in some bucket
        busy = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("i"), F.col("th").alias("t"))
        texts = stored(own.where("text is not null").join(busy, (F.col("doc_id") == F.col("i")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "node", "text").distinct().select("node", "text"), "texts")
        sigs = classes.select("node", "sig")

        def linked(pairs: DataFrame) -> DataFrame:
            """Stored ``(a, b)``: those of the pairs that pass."""
            likely = stored(_likely(pairs, sigs, percent), "likely")
            out = stored(_confirmed(likely, texts, width, percent), "linked")
            discard(likely)
            return out

        links = linked(members.where("node != a").select("a", F.col("node").alias("b")).distinct())
        if numbered:  # rows that share an id tie their classes together
            shared = some.select("doc_id", "set_a", "set_b").distinct().join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("doc_id", "node")
            least = shared.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
            links = stored(links.unionByName(shared.join(least, "doc_id").where("node != a").select("a", F.col("node").alias("b"))), "links")
        found = components(links)
        discard(links)
        # members of one bucket that are still in different components
        label = F.coalesce("label", "id")
        whose = members.select(F.col("node").alias("id"), "band", "key")

        def apart() -> DataFrame:
            """Stored ``(id, label, band, key)`` of the buckets with several components."""
            labelled = whose.join(found, "id", "left").select("band", "key", "id", label.alias("label"))
            mixed = stored(labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band", "key"), "apart")
            out = stored(labelled.join(mixed, ["band", "key"], "left_semi"), "undecided")
            discard(mixed)
            return out

        def merged(more: DataFrame) -> DataFrame:
            """The components with more links."""
            out = components(more.unionByName(found.select(F.col("id").alias("a"), F.col("label").alias("b")).where("a != b")), found)
            discard(more, found)
            return out

        undecided = apart()
        if not undecided.isEmpty():
            first, tried, shared = _prefixes(undecided.select("id").distinct(), texts, width, percent), 0, MET * members.count()
            while True:
                open_ = stored(undecided.select("id", "label").distinct(), "open")
                rows, most = _listed(first, open_)
                enough = min(FEW * open_.count(), (1 << 31) - 2)  # a limit is an int
                discard(open_)
                if tried == ROUNDS or (most <= shared and _met(rows, percent).limit(enough + 1).count() <= enough):
                    break
                tried += 1
                # other centres: of the bucket's members the first by another hash
                centre = undecided.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("id", F.lit(tried)).alias("h"), F.col("id").alias("a"), F.col("label").alias("la"))).alias("c")).select("band", "key", "c.a", "c.la")
                centre = stored(centre, "centres")
                more = linked(undecided.join(centre, ["band", "key"]).where("label != la").select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct())
                discard(centre)
                if more.isEmpty():
                    break
                discard(rows, undecided)
                found = merged(more)
                undecided = apart()
            discard(first, undecided)
            more = linked(_may_link(rows, percent))
            discard(rows)
            if not more.isEmpty():
                found = merged(more)
        labels = classes.join(found.withColumnRenamed("id", "node"), "node", "left").select("set_a", "set_b", "id", F.coalesce("label", "node").alias("label"))
        if numbered:
            labels = labels.join(labels.groupBy("label").agg(F.min("id").alias("least")), "label").select("set_a", "set_b", F.col("least").alias("label"))
        labels = stored(labels.select("set_a", "set_b", F.col("label").cast(kind).alias("label")), "components")
        rows = stored(sets.select("doc_id", "n_shingles", "set_a", "set_b"), "rows")
        keep += [labels, rows]
    out = rows.join(labels, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _estimate(a: str, b: str):
    """The largest corrected estimate over two lists of packed signatures, in SQL."""
    equal = "1 - aggregate(zip_with(x, y, (p, q) -> bit_count((p ^ q | shiftrightunsigned(p ^ q, 1)) & 6148914691236517205L)), 0, (s, v) -> s + v) / 128D"
    return F.expr(f"array_max(flatten(transform({a}, x -> transform({b}, y -> (({equal}) - 0.25D) / 0.75D))))")
