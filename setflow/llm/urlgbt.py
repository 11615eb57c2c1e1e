"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Features of a url: lengths, path depth, digit ratio, entropy, counts of parameters and host labels, and suffix statistics:
the share of blocked urls among the labelled ones with that host suffix (of one, two and three labels), and with that
suffix of one label and that first path segment, each pulled towards the share of the wider group. The trees are grown on
the driver from a sample of distinct labelled urls, each weighing as much as it has rows and both kinds in all
the same, by logistic loss on binned features; the model is a few kilobytes of arrays, plus one pair of numbers per
sampled suffix, and goes to every task.

A caller gives labelled urls. Where none are given, the urls that a rule decides are the labelled ones, so that the trees
carry the rules' verdicts over to urls like them.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
trees as the empty url; without labelled urls of both kinds the trees allow everything; a score of exactly a half
allows; between equally good splits the first feature and the lowest bin win; a very long url is a block of features of its
own; repeated rows get equal results; an empty table gives none. Input columns named like those added
(``__host, __path, __rule, __score, __verdict, __fit``) are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (verdict, host, path) - fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SUFFIXES = 3
#: Names of the features, in order.
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "suffix_1", "suffix_2", "suffix_3", "section"]
#: Features are made for blocks of about so many characters.
BLOCK = 1 << 20


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit("")), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _blocks(urls: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, u in enumerate(urls):
        size += len(u)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(urls):
        yield start, len(urls)


def _lexical(urls: list[str], hosts: list[str]) -> tuple[np.ndarray, list[str]]:
    """The lexical features of a block, and each url's first path segment; all characters at once."""
    k = len(urls)
    n, hn = (np.fromiter(map(len, x), np.int64, k) for x in (urls, hosts))
    codes = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner, start = np.repeat(np.arange(k), n), np.cumsum(n) - n
    per = lambda mask: np.bincount(owner[mask], minlength=k)

    def first(mask: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        out = otherwise.copy()
        at = np.nonzero(mask)[0]
        who, where = np.unique(owner[at], return_index=True)
        out[who] = at[where]
        return out

    end = start + n
    is_ = lambda c: codes == ord(c)
    place = np.arange(len(codes))
    sign = np.zeros(len(codes), bool)
    if len(codes) > 2:
        sign[:-2] = is_(":")[:-2] & is_("/")[1:-1] & is_("/")[2:] & (owner[:-2] == owner[2:])
    scheme = first(sign, end)
    path = np.minimum(np.where(scheme < end, scheme + 3 + hn, end), end)
    inside = place >= path[owner]
    hash_ = first(inside & is_("#"), end)
    query = np.minimum(first(inside & is_("?"), end), hash_)
    in_path, in_query = inside & (place < query[owner]), (place > query[owner]) & (place < hash_[owner])
    opens = np.zeros(len(codes), bool)
    opens[1:] = in_path[1:] & in_path[:-1] & is_("/")[:-1] & ~is_("/")[1:]
    digits = (codes >= 48) & (codes <= 57)
    pairs, times = np.unique(owner.astype(np.uint64) << np.uint64(21) | codes, return_counts=True)
    of = (pairs >> np.uint64(21)).astype(np.int64)
    share = times / np.maximum(n, 1)[of]
    entropy = -np.bincount(of, share * np.log2(share), k)
    labels = np.fromiter((h.count(".") + 1 if h else 0 for h in hosts), np.int64, k)
    x = np.stack([n, hn, query - path, per(opens), per(digits) / np.maximum(n, 1), entropy, per(in_query & is_("&")) + (hash_ > query + 1), labels], axis=1).astype(float)
    one = first(opens, query)
    stop = np.minimum(first(in_path & is_("/") & (place > one[owner]), query), query)
    return x, [u[a:b] for u, a, b in zip(urls, (one - start).tolist(), (stop - start).tolist(), strict=True)]


def lexical(urls: list[str | None], hosts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Lexical features of urls, a row each, and their first path segments."""
    known = [u or "" for u in urls]
    parts = [_lexical(known[a:b], hosts[a:b]) for a, b in _blocks(known)]
    return np.concatenate([np.empty((0, len(FEATURES) - SUFFIXES - 1)), *[x for x, _ in parts]]), [s for _, segments in parts for s in segments]


class Forest:
    """Boosted trees over binned features, with the suffix statistics they were grown with."""

    TREES, DEPTH, RATE, BINS, PULL = 40, 4, 0.2, 32, 20.0

    def __init__(self, urls: list[str], hosts: list[str], blocked: list[bool], rows: list[int] | None = None):
        """``rows``: how many rows each url stands for, one if not given."""
        y = np.array(blocked, float)
        n = np.ones(len(y)) if rows is None else np.array(rows, float)
        self.trees, self.base, self.share, self.suffix = [], None, float(np.average(y, weights=n)) if len(y) else 0.0, {}
        if not 0 < y.sum() < len(y):
            return
        one = np.where(y > 0, 0.5 / self.share, 0.5 / (1 - self.share))  # of a row: both kinds weigh the same in all
        n, self.share = n * one, 0.5
        x, segments = lexical(urls, hosts)
        seen: dict[str, list[float]] = {}
        for h, p, b, c in zip(hosts, segments, y, n, strict=True):
            for s in self._groups(h, p):
                seen.setdefault(s, [0.0, 0.0])[0] += b * c
                seen[s][1] += c
        self.suffix = {s: (b, c) for s, (b, c) in seen.items()}
        x = np.concatenate([x, np.array([self._rates(h, p, b * c, c) for h, p, b, c in zip(hosts, segments, y, one, strict=True)])], axis=1)
        self.edges = [np.unique(self._quantiles(c, n, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        self.base = math.log(self.share / (1 - self.share))
        f = np.full(len(y), self.base)
        for _ in range(self.TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, n * (y - p), n * p * (1 - p))
            self.trees.append(tree)
            f += self._walk(tree, binned)

    @staticmethod
    def _quantiles(x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """``np.quantile(np.repeat(x, n), q)`` without the copies."""
        order = np.argsort(x, kind="stable")
        upto, at = n[order].cumsum(), q * (n.sum() - 1)
        low, high = (x[order][np.minimum(np.searchsorted(upto, k, side="right"), len(x) - 1)] for k in (np.floor(at), np.ceil(at)))
        return low + (high - low) * (at - np.floor(at))

    @staticmethod
    def _groups(host: str, segment: str) -> list[str]:
        """Host suffixes from short to long, missing ones repeated, and the shortest with the first path segment."""
        parts = host.split(".")
        return [*(".".join(parts[-k:]) for k in range(1, SUFFIXES + 1)), f"{parts[-1]}/{segment}/"]

    def _rates(self, host: str, segment: str, own_blocked: float = 0.0, own: float = 0.0) -> list[float]:
        """Blocked share per group; a row of training does not count itself."""
        out, prior = [], self.share
        for k, s in enumerate(self._groups(host, segment)):
            b, n = self.suffix.get(s, (0.0, 0.0))
            prior = (b - own_blocked + self.PULL * (prior if k < SUFFIXES else out[0])) / (n - own + self.PULL)
            out.append(prior)
        return out

    def _features(self, urls, hosts) -> np.ndarray:
        x, segments = lexical(urls, hosts)
        known: dict[tuple[str, str], list[float]] = {}
        rates = [known.get(k) or known.setdefault(k, self._rates(*k)) for k in zip(hosts, segments, strict=True)]
        return np.concatenate([x, np.array(rates).reshape(len(rates), SUFFIXES + 1)], axis=1)

    def used(self) -> dict[str, int]:
        """How many inner nodes ask for each feature."""
        asked = [int(c) for t in self.trees for level in t[:-1] for c, cut in level if cut <= self.BINS]
        return {name: asked.count(i) for i, name in enumerate(FEATURES)}

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """A full tree level by level: (feature, bin) per inner node, then the leaves' values."""
        node, inner = np.zeros(len(g), int), []
        for d in range(self.DEPTH):
            k, b = 1 << d, self.BINS + 1
            best = np.bincount(node, g, k) ** 2 / (np.bincount(node, h, k) + 1)  # without a split all go left
            pick = np.tile([0, b], (k, 1))
            for c in range(x.shape[1]):
                at = node * b + x[:, c]
                gs, hs = np.bincount(at, g, k * b).reshape(k, b).cumsum(1), np.bincount(at, h, k * b).reshape(k, b).cumsum(1)
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
                cut = gain.argmax(axis=1)
                top = gain[np.arange(k), cut]
                better = top > best + 1e-12
                best[better], pick[better] = top[better], np.stack([np.full(k, c), cut], axis=1)[better]
            inner.append(pick)
            node = node * 2 + (x[np.arange(len(g)), pick[node, 0]] > pick[node, 1])
        gs, hs = np.bincount(node, g, 1 << self.DEPTH), np.bincount(node, h, 1 << self.DEPTH)
        return [*inner, self.RATE * gs / (hs + 1)]

    @staticmethod
    def _walk(tree: list, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for pick in tree[:-1]:
            node = node * 2 + (x[np.arange(len(x)), pick[node, 0]] > pick[node, 1])
        return tree[-1][node]

    def score(self, urls: list[str | None], hosts: list[str]) -> np.ndarray:
        """Probability that a url is to be blocked."""
        if self.base is None or not urls:
            return np.zeros(len(urls))
        x = self._binned(self._features(urls, hosts))
        return 1 / (1 + np.exp(-(self.base + sum(self._walk(t, x) for t in self.trees))))


def train(labelled: DataFrame, most: int = 20000) -> Forest:
    """Grow trees from ``labelled(url, host, blocked)``; with more than ``most`` distinct urls, from about as many with all their rows, chosen by hash."""
    n = labelled.agg(F.approx_count_distinct("url", 0.01)).first()[0]
    some = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))
    rows = some.groupBy("url", "host", "blocked").agg(F.count("*").alias("n")).toPandas().sort_values(["url", "host", "blocked"])
    return Forest(*(rows[c].tolist() for c in ("url", "host", "blocked", "n")))


def judge(pages: DataFrame, forest: Forest | None = None, rules=RULES, url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``__host, __path, __rule, __score, __verdict``.

    Without a forest, one is trained: on ``labelled(url, blocked)``, or else on the urls here that a rule decides.
    """
    url = F.col(url_col)
    rows = pages.withColumns({"__host": host_of(url), "__path": path_of(url)})
    rows = rows.withColumn("__fit", rule_of(F.col("__host"), F.col("__path"), rules))
    if forest is None:
        if labelled is None:
            labelled = rows.where("__fit is not null").select(url.alias("url"), (F.col("__fit.verdict") == "block").alias("blocked"))
        forest = train(labelled.where("url is not null and blocked is not null").select("url", host_of(F.col("url")).alias("host"), "blocked"))
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def tree_score(urls, hosts):
        import pandas as pd

        return pd.Series(shared.value.score(urls.tolist(), hosts.tolist()))

    rows = rows.withColumn("__score", tree_score(url, F.col("__host"))).withColumn("__rule", F.col("__fit.rule"))
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__score") > 0.5, "block").otherwise("allow"))
    return rows.withColumn("__verdict", verdict).drop("__fit")
