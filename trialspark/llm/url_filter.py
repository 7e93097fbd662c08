"""URL filters: explicit rules first, else gradient-boosted trees on lexical features.

DataFrame functions only. Training folds a bounded sample of labelled URLs into counts
by binned features once; each level of each tree is then one aggregate over that small
table, and the driver sees sums by node, feature and bin alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.stored import stored

MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 12, 3, 0.4, 16
MIN_WEIGHT, RIDGE = 5.0, 1.0
PRIOR_ROWS = 10.0
MAX_RULES = 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")


def host_of(url: str) -> Column:
    """Host, A-Z lower-cased; empty for null and for URLs without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Longest rule that fits as ``(rule, verdict)``, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kind = "struct<rule:string,verdict:string>"
    found = F.lit(None).cast(kind)
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        own = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, own).otherwise(found)
    return found


def _count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    n = F.length(text)
    counts = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit("")))
    )
    total = F.aggregate(
        F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda t, c: t + c * F.log2(c.cast("double"))
    )
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls(url, ...)`` with its lexical features as doubles and its host suffix."""
    parts = urls.withColumns({"u": F.coalesce("url", F.lit("")), "h": host_of("url"), "p": path_of("url")})
    u, h, p = F.col("u"), F.col("h"), F.col("p")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(u, "[^0-9]", "")).cast("double")
    labels = F.split(h, r"\.")
    return parts.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length(h).cast("double"),
            "depth": _count(p, "/"),
            "digit_ratio": digits / F.greatest(F.length(u), F.lit(1)),
            "entropy": _entropy(u),
            "host_entropy": _entropy(h),
            "parameters": _count(query, "="),
            "query_length": F.length(query).cast("double"),
            "labels": F.size(labels).cast("double"),
            "hyphens": _count(h, "-"),
            "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    ).drop("u", "h", "p")


FEATURES = (
    "length",
    "host_length",
    "depth",
    "digit_ratio",
    "entropy",
    "host_entropy",
    "parameters",
    "query_length",
    "labels",
    "hyphens",
    "suffix_rate",
    "suffix_share",
)


@dataclass(frozen=True)
class Node:
    """Split (values above the cut go right) or leaf."""

    feature: str = ""
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0

    def column(self) -> Column:
        if not self.feature:
            return F.lit(self.value)
        return F.when(F.col(self.feature) > self.cut, self.right.column()).otherwise(self.left.column())


@dataclass(frozen=True)
class Model:
    """Trees, the starting log-odds and the suffix statistics (at most as many as training rows)."""

    start: float
    prior: float
    suffixes: DataFrame | None
    trees: list[Node] = field(default_factory=list)

    def margin(self) -> Column:
        return reduce(lambda total, tree: total + tree.column(), self.trees, F.lit(self.start))


def _with_suffix(features: DataFrame, suffixes: DataFrame | None, prior: float) -> DataFrame:
    if suffixes is None:
        return features.withColumns({"suffix_rate": F.lit(prior), "suffix_share": F.lit(0.0)}).drop("suffix")
    known = F.broadcast(suffixes.withColumnRenamed("suffix", "known_suffix"))
    joined = features.join(known, F.col("suffix") == F.col("known_suffix"), "left")
    return joined.withColumns(
        {
            "suffix_rate": F.coalesce("suffix_rate", F.lit(prior)),
            "suffix_share": F.coalesce("suffix_share", F.lit(0.0)),
        }
    ).drop("suffix", "known_suffix")


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Model from ``labelled(url, label)``, label 1 meaning block.

    At most about ``max_rows`` rows are used, chosen by a hash of the URL, so repeated URLs
    come together. Null labels are left out; without rows, or with one label only, there
    are no trees and every URL gets the smoothed share of its label.
    """
    known = labelled.where("label IN (0, 1)").select(F.col("label").cast("double"), "url")
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = (positive + 1) / (n + 2)
    start = _logit(prior)
    if positive in (0, n):
        return Model(start, prior, None)
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < (max_rows << 20) // n)
    sample = stored(lexical(known).drop("url"), "urls")
    suffixes = stored(
        sample.groupBy("suffix").agg(
            ((F.sum("label") + PRIOR_ROWS * prior) / (F.count("*") + PRIOR_ROWS)).alias("suffix_rate"),
            (F.count("*") / n).alias("suffix_share"),
        ),
        "suffixes",
    )
    rows = _with_suffix(sample, suffixes, prior)
    steps = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(name, steps, 1000).alias(name) for name in FEATURES)).first()
    cuts = {name: sorted(set(found[name] or ())) for name in FEATURES}
    # Values stand for their bins from here on: the highest cut below them.
    binned = {
        name: reduce(lambda b, c, name=name: F.when(F.col(name) > c, _above(cuts[name], c)).otherwise(b), cuts[name], F.lit(0))
        for name in FEATURES
    }
    table = rows.select("label", *(column.cast("int").alias(f"bin_{name}") for name, column in binned.items()))
    table = stored(
        table.groupBy(*(f"bin_{name}" for name in FEATURES)).agg(
            F.sum("label").alias("positive"), F.count("*").alias("n")
        ),
        "bins",
    )
    trees: list[Node] = []
    margin = F.lit(start)
    for _ in range(TREES):
        grown = _grow(table, margin, cuts)
        if not grown:
            break
        tree, column = grown
        trees.append(tree)
        margin = margin + column
    return Model(start, prior, suffixes, trees)


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def _above(cuts: list[float], cut: float) -> Column:
    return F.lit(cuts.index(cut) + 1)


def _grow(table: DataFrame, margin: Column, cuts: dict[str, list[float]]) -> tuple[Node, Column] | None:
    """One regression tree on the gradients of the logistic loss, a level at a time."""
    chance = 1 / (1 + F.exp(-margin))
    n = F.col("n")
    # One struct for each feature, so that a level is a single pass.
    bins = F.array(
        *(F.struct(F.lit(i).alias("f"), F.col(f"bin_{name}").alias("b")) for i, name in enumerate(FEATURES))
    )
    splits: dict[int, tuple[int, int]] = {}
    values: dict[int, float] = {}
    level = [1]
    for depth in range(DEPTH + 1):
        rows = (
            table.select(
                _node(splits).alias("node"),
                (F.col("positive") - chance * n).alias("g"),
                (chance * (1 - chance) * n).alias("h"),
                F.explode(bins).alias("bin"),
            )
            .groupBy("node", "bin.f", "bin.b")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            .collect()
        )
        sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for row in rows:
            sums.setdefault(row["node"], {}).setdefault(row["f"], {})[row["b"]] = (row["g"], row["h"])
        following = []
        for node in level:
            by_feature = sums.get(node, {})
            total = [sum(x) for x in zip(*by_feature.get(0, {0: (0.0, 0.0)}).values())]
            values[node] = RATE * total[0] / (total[1] + RIDGE)
            best = _best_split(by_feature, total) if depth < DEPTH else None
            if best:
                splits[node] = best
                following += [2 * node, 2 * node + 1]
        level = following
        if not level:
            break
    if not splits:
        return None

    def build(node: int) -> tuple[Node, Column]:
        if node not in splits:
            return Node(value=values[node]), F.lit(values[node])
        feature, cut = splits[node]
        name = FEATURES[feature]
        (left, left_column), (right, right_column) = build(2 * node), build(2 * node + 1)
        column = F.when(F.col(f"bin_{name}") > cut, right_column).otherwise(left_column)
        return Node(name, cuts[name][cut], left, right), column

    return build(1)


def _node(splits: dict[int, tuple[int, int]], node: int = 1) -> Column:
    if node not in splits:
        return F.lit(node)
    feature, cut = splits[node]
    right, left = _node(splits, 2 * node + 1), _node(splits, 2 * node)
    return F.when(F.col(f"bin_{FEATURES[feature]}") > cut, right).otherwise(left)


def _best_split(by_feature: dict, total: list[float]) -> tuple[int, int] | None:
    """Feature and highest bin that goes left, of the largest gain; the first of equals."""
    best, gain = None, 1e-6
    parent = total[0] ** 2 / (total[1] + RIDGE)
    for feature in sorted(by_feature):
        g = h = 0.0
        for bin_ in sorted(by_feature[feature])[:-1]:
            g += by_feature[feature][bin_][0]
            h += by_feature[feature][bin_][1]
            if h < MIN_WEIGHT or total[1] - h < MIN_WEIGHT:
                continue
            found = g * g / (h + RIDGE) + (total[0] - g) ** 2 / (total[1] - h + RIDGE) - parent
            if found > gain * (1 + 1e-9):
                best, gain = (feature, bin_), found
    return best


def _scores(urls: DataFrame, model: Model, *kept: str) -> DataFrame:
    features = _with_suffix(lexical(urls), model.suffixes, model.prior)
    return features.select(*kept, (1 / (1 + F.exp(-model.margin()))).alias("score"))


@dataclass(frozen=True)
class Threshold:
    """Score from which a URL is blocked, and how well scores told the labels apart where it was chosen."""

    score: float
    auc: float


def held_out(parts: int = 5) -> Column:
    """A share of labelled URLs that no tree learns from, by a hash of the URL."""
    return F.coalesce(F.crc32(F.col("url").cast("binary")) % parts == 0, F.lit(False))


def choose_threshold(labelled: DataFrame, model: Model) -> Threshold:
    """The score at or above which as many of ``labelled(url, label)`` lie as have a block label.

    The rows are ones unseen in training. So the filter blocks about the share of URLs that
    labels call bad, however weakly labels and URLs hang together; the higher score among
    equally near ones. Scores count in steps of a thousandth, so the driver gets a thousand
    rows at most. Without rows of both labels it is one half.
    """
    known = labelled.where("label IN (0, 1)")
    step = F.floor(F.col("score") * 1000).alias("step")
    counts = _scores(known, model, "label").groupBy(step).agg(
        F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative")
    )
    rows = [(row["step"], row["positive"], row["negative"]) for row in counts.collect()]
    positive, negative = (sum(row[i] for row in rows) for i in (1, 2))
    if not positive or not negative:
        return Threshold(0.5, 0.5)
    best, off, auc, blocked, bad = 0.5, float("inf"), 0.0, 0, 0
    for place, p, n in sorted(rows, reverse=True):
        auc += n * (bad + p / 2)
        bad, blocked = bad + p, blocked + p + n
        if abs(blocked - positive) < off:
            best, off = place / 1000, abs(blocked - positive)
    return Threshold(best, auc / (positive * negative))


def judge(urls: DataFrame, model: Model, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    wins and decides. Without a rule the model's ``score`` does. Null URLs have empty hosts
    and are judged by the model. Columns of these names are replaced.
    """
    kept = urls.drop("host", "path", "rule", "score", "verdict")
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names)
    row = plain.select(F.struct(*names).alias("row"), F.col(names[kept.columns.index("url")]).alias("url"))
    features = _with_suffix(lexical(row), model.suffixes, model.prior)
    scored = features.select("row", "url", (1 / (1 + F.exp(-model.margin()))).alias("score"))
    placed = scored.withColumns({"host": host_of("url"), "path": path_of("url")})
    ruled = placed.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return ruled.select(
        *(F.col("row").getField(c) for c in names),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        "score",
        F.coalesce("found.verdict", by_model).alias("verdict"),
    ).toDF(*kept.columns, "host", "path", "rule", "score", "verdict")
