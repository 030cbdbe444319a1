"""URL verdicts: listed rules first, else logistic regression on hashed character n-grams of host and path.

Everything is a DataFrame or SQL expression. Training reads a small labelled URL table: at most ``sample``
rows, those with the smallest hashes, as sets of hashed n-grams. Each step of accelerated gradient descent is one
aggregation to at most ``buckets`` sums, which are the only thing the driver sees. Gradients are summed as
integers, so the model does not depend on the order of tasks. Scoring is one expression per row, without a shuffle.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. A NULL URL, or one without ``://``, has an empty host and path and gets the model's verdict on
them. Without labelled rows the model's score is 0.5 and its verdict ``allow``, as for any score not above 0.5.
Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketops.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gradients are summed in units of 2**-32.
UNIT = float(1 << 32)


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, as in ``example.net/en/``; it fits the host, all its subdomains and all longer paths."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: list[float]
    sizes: tuple[int, ...]

    def score(self, host: Column, path: Column) -> Column:
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        margin = F.aggregate(grams(host, path, self.sizes, len(self.weights)), F.lit(self.bias), lambda sum_, b: sum_ + F.get(weights, b))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def grams(host: Column, path: Column, sizes: Sequence[int], buckets: int) -> Column:
    """The distinct buckets of all n-grams of ``^host$`` and of ``/path$``, kept apart."""
    def of(tag: str, text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substr(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    host, path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    found = [of(tag, text, n) for tag, text in (("h", host), ("p", path)) for n in sizes]
    return F.array_distinct(F.concat(*found))


def train(labelled: DataFrame, sizes: Sequence[int] = (3, 4), buckets: int = 4096, sample: int = 4000, rounds: int = 40, penalty: float = 0.5) -> Model:
    """Fit on ``labelled`` (url, label 0 or 1); rows with a NULL label do not count."""
    host, path = host_and_path(F.col("url"))
    bounded = labelled.where(F.col("label").isin(0, 1)).select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label"))
    bounded = bounded.orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    scratch = Scratch(labelled.sparkSession)
    rows = scratch.store(bounded.select("label", grams(host, path, sizes, buckets).alias("grams")))
    counts = {r["gram"]: r["n"] for r in rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("grams")).alias("most")).first()
    if not total["n"]:
        scratch.drop(keep_last=False)
        return Model(0.0, [0.0] * buckets, tuple(sizes))
    most = total["most"] + 1  # the bias is a feature of every row
    step = {b: 1.0 / (0.25 * n * most + penalty) for b, n in counts.items()}
    step[-1] = 1.0 / (0.25 * total["n"] * most)
    now = dict.fromkeys(step, 0.0)
    ahead = dict(now)
    pace = 1.0
    for _ in range(rounds):
        model = Model(ahead[-1], [ahead.get(b, 0.0) for b in range(buckets)], tuple(sizes))
        weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
        margin = F.aggregate("grams", F.lit(model.bias), lambda s, b: s + F.get(weights, b))
        error = F.round((F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("label")) * UNIT).cast("bigint")
        sums = rows.select(error.alias("error"), "grams").select("error", F.explode(F.array_append("grams", F.lit(-1))).alias("gram"))
        gradient = {r["gram"]: r["sum"] / UNIT for r in sums.groupBy("gram").agg(F.sum("error").alias("sum")).collect()}
        new = {b: ahead[b] - step[b] * (gradient[b] + (penalty * ahead[b] if b >= 0 else 0.0)) for b in sorted(step)}
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = {b: new[b] + (pace - 1) / faster * (new[b] - now[b]) for b in new}
        now, pace = new, faster
    scratch.drop(keep_last=False)
    return Model(now[-1], [now.get(b, 0.0) for b in range(buckets)], tuple(sizes))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], what) -> Column:
    """``what(rule)`` of the longest rule that fits, else NULL."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        found = F.when(rule.fits(host, path), F.lit(what(rule))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, url: str = "url") -> DataFrame:
    """All columns of ``pages`` that do not clash, plus host, path, rule, score (of blocking) and verdict."""
    new = ("host", "path", "rule", "score", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    score = model.score(F.col("host"), F.col("path"))
    rule = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.text)
    listed = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    out = parsed.withColumns({"rule": rule, "__listed": listed, "score": score})
    return out.withColumn("verdict", F.coalesce("__listed", F.when(F.col("score") > 0.5, "block").otherwise("allow"))).drop("__listed")


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """A labelled URL table from curated rules: 1 where they block, 0 where they allow."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    verdict = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    return parsed.select("url", (verdict == "block").cast("int").alias("label")).where("label IS NOT NULL")
