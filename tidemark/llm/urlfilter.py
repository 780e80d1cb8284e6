"""URL filtering by rules and gradient-boosted trees on lexical features.

A rule is a host and the start of a path; it fits the host and its subdomains
and decides the URLs it fits, the longest rule first.  The trees decide the
rest.  They are fitted on labelled URLs: depth-limited regression trees on
the gradients and curvatures of the logistic loss, whose splits come from
sums over sorted feature values.  Features are lexical: lengths, depth,
digit, hyphen and vowel shares, entropy of the host's letters, parameter
counts, and the smoothed share of blocked URLs under the host's suffix.

Fitting takes a bounded sample of labelled URLs, a parameter of the caller:
about ``SAMPLE_URLS`` chosen by a hash of the URL.  The shares of blocked URLs
come from one half of the sample, the trees from the other, so that no URL's
label is among its features.  All suffixes of the sample are kept, in a table
of a hash and a share, at most one row a sampled URL, that is broadcast.  The
trees are one arithmetic expression, so every URL is judged where it is read,
without a shuffle or Python.

Null URLs and URLs without :// have an empty host and path, fit no rule and
are judged by their features all the same.  Without labelled URLs everything
is allowed.  Repeated rows are judged alike; of features that split a node
equally well the first by name order of ``features`` and the least value is
taken, and a score of exactly 0 allows.  URLs of any length are taken whole.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, RATE, LEAST_CHILD, RIDGE = 24, 3, 0.3, 5.0, 1.0
SAMPLE_URLS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of a host and its subdomains whose path starts so."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy(text: Column) -> Column:
    """Bits a letter of the text's own letter frequencies."""

    def of(letters: Column) -> Column:
        n = F.size(letters)
        shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
        return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))

    return F.when(F.length(text) > 0, _let(F.split(text, ""), of)).otherwise(F.lit(0.0))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def suffix(host: Column) -> Column:
    """Hash of the last two labels of the host."""
    return F.xxhash64(F.substring_index(host, ".", -2))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features but the suffix share, all double."""
    url = F.coalesce(url, F.lit(""))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise(F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    width = F.greatest(F.length(host), F.lit(1))
    found = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _matches(path, "/[^/]"),
        "host_labels": F.when(F.length(host) > 0, F.size(F.split(host, "[.]"))).otherwise(F.lit(0)),
        "longest_label": F.array_max(F.transform(F.split(host, "[.]"), lambda x: F.length(x))),
        "digit_share": _matches(url, "[0-9]") / size,
        "host_hyphens": _matches(host, "-"),
        "vowel_share": _matches(host, "[aeiou]") / width,
        "parameters": F.when(F.length(query) > 0, _matches(query, "&") + 1).otherwise(F.lit(0)),
        "host_entropy": entropy(host),
    }
    return {k: v.cast("double") for k, v in found.items()}


@dataclass
class Tree:
    """A split (feature, value and two subtrees) or a leaf's score."""

    score: float = 0.0
    feature: str | None = None
    value: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, inputs: dict[str, Column]) -> Column:
        if self.feature is None:
            return F.lit(self.score)
        return F.when(inputs[self.feature] <= self.value, self.low.column(inputs)).otherwise(self.high.column(inputs))

    def scores(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(next(iter(inputs.values()))), self.score)
        return np.where(inputs[self.feature] <= self.value, self.low.scores(inputs), self.high.scores(inputs))


@dataclass
class UrlModel:
    """Boosted trees whose summed scores above 0 block."""

    bias: float = -1.0
    trees: list[Tree] = field(default_factory=list)
    suffixes: dict[int, float] = field(default_factory=dict)
    usual: float = 0.5

    def with_shares(self, urls: DataFrame) -> DataFrame:
        """``urls`` (column host, own names free of _suffix) with suffix_share."""
        if not self.suffixes:
            return urls.withColumn("suffix_share", F.lit(self.usual))
        table = pa.table({"_suffix": pa.array(list(self.suffixes), pa.int64()), "_share": pa.array(list(self.suffixes.values()), pa.float64())})
        found = urls.withColumn("_suffix", suffix(F.col("host"))).join(F.broadcast(_local(urls.sparkSession, table)), "_suffix", "left")
        return found.withColumn("suffix_share", F.coalesce("_share", F.lit(self.usual))).drop("_suffix", "_share")

    def score(self, url: Column, host: Column, path: Column, suffix_share: Column) -> Column:
        def total(x: Column) -> Column:
            inputs = {k: x[k] for k in [*features(url, host, path), "suffix_share"]}
            out = F.lit(self.bias)
            for tree in self.trees:
                out = out + tree.column(inputs)
            return out

        values = {**features(url, host, path), "suffix_share": suffix_share}
        return _let(F.struct(*[v.alias(k) for k, v in values.items()]), total)


def _local(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def _grow(inputs: dict[str, np.ndarray], gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    g, h = gradient[rows].sum(), curvature[rows].sum()
    leaf = Tree(score=float(-RATE * g / (h + RIDGE)))
    best, gain = None, 1e-6
    if depth:
        for name, values in inputs.items():
            own = values[rows]
            order = np.argsort(own, kind="stable")
            left_g, left_h = np.cumsum(gradient[rows][order]), np.cumsum(curvature[rows][order])
            ends = np.flatnonzero(own[order][1:] > own[order][:-1])
            ends = ends[(left_h[ends] * 4 >= LEAST_CHILD * 0.5) & ((h - left_h[ends]) * 4 >= LEAST_CHILD * 0.5)]
            if len(ends):
                gains = left_g[ends] ** 2 / (left_h[ends] + RIDGE) + (g - left_g[ends]) ** 2 / (h - left_h[ends] + RIDGE) - g**2 / (h + RIDGE)
                k = int(gains.argmax())
                if gains[k] > gain:
                    gain, at = float(gains[k]), ends[k]
                    best = (name, float((own[order][at] + own[order][at + 1]) / 2))
    if best is None:
        return leaf
    name, value = best
    low = inputs[name][rows] <= value
    return Tree(0.0, name, value, _grow(inputs, gradient, curvature, rows[low], depth - 1), _grow(inputs, gradient, curvature, rows[~low], depth - 1))


def boost(inputs: dict[str, np.ndarray], blocked: np.ndarray, weights: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[Tree]]:
    """Bias and trees for features with 0/1 labels and weights."""
    share = float(np.clip((blocked * weights).sum() / weights.sum(), 0.01, 0.99))
    bias, grown = float(np.log(share / (1 - share))), []
    total = np.full(len(blocked), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(inputs, (p - blocked) * weights, p * (1 - p) * weights, np.arange(len(blocked)), depth)
        total += tree.scores(inputs)
        grown.append(tree)
    return bias, grown


def fit(labelled: DataFrame, sample: int = SAMPLE_URLS) -> UrlModel:
    """A model from URLs (column url) with a boolean label (column blocked)."""
    labelled = labelled.where("url is not null")
    rate = max(1, -(-labelled.count() // sample))
    place = F.pmod(F.xxhash64("url"), F.lit(2 * rate))
    host, path = host_and_path(F.col("url"))
    chosen = labelled.where(place % rate == 0).where("blocked is not null")
    own = chosen.select("url", "blocked", (place == 0).alias("counted"), host.alias("host"), path.alias("path"))
    sums = own.where("counted").groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("k"))
    found = sums.orderBy("suffix").collect()  # at most one row a sampled URL, as below
    usual = (sum(r["k"] for r in found) + 0.5) / (sum(r["n"] for r in found) + 1)
    model = UrlModel(suffixes={r["suffix"]: (r["k"] + 5 * usual) / (r["n"] + 5) for r in found}, usual=usual)
    columns = features(F.col("url"), F.col("host"), F.col("path"))
    names = [*columns, "suffix_share"]
    shared = model.with_shares(own.where("not counted"))
    rows = shared.select("blocked", "suffix_share", *[v.alias(k) for k, v in columns.items()]).groupBy("blocked", *names).count().orderBy("blocked", *names).collect()
    if not rows:
        return UrlModel()
    inputs = {k: np.array([r[k] for r in rows], float) for k in names}
    model.bias, model.trees = boost(inputs, np.array([float(r["blocked"]) for r in rows]), np.array([float(r["count"]) for r in rows]))
    return model


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every page's URL."""
    host, path = host_and_path(F.col("url"))
    own = model.with_shares(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = own.withColumns({"rule": rule, "decided": verdict, "score": model.score(F.col("url"), F.col("host"), F.col("path"), F.col("suffix_share"))})
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", learned).alias("verdict"), "score")
