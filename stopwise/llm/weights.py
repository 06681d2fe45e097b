"""Quality weights of texts, fitted on labels with counts only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import let, words

# Labelled rows that the weight is fitted on, and steps that a feature is divided into.
SAMPLE, STEPS = 20_000, 8
# Weights lie between this and one.
LEAST = 0.05
_BUCKETS = 4_096


def steps(text: Column) -> Column:
    """Features of a text, each as a step from 0 to ``STEPS - 1``: an array in a fixed order.

    Shares of symbols and capitals among the characters, the share of different words, the mean length
    of words and the number of words.
    """
    body = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(body), F.lit(1))

    def share(pattern: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))) / size

    def even(value: Column, scale: float) -> Column:
        """Equal steps of the value over ``scale``, the last for all beyond."""
        return F.least(F.floor(value / scale * STEPS), F.lit(STEPS - 1)).cast("int")

    def of(found: Column) -> Column:
        n = F.greatest(F.size(found), F.lit(1))
        return F.array(
            even(share(r"[#*$%&|<>=_~^{}\\]+"), 0.2),
            even(share(r"[A-Z]+"), 0.4),
            even(F.size(F.array_distinct(found)) / n, 1.0),
            even(size / n, 16.0),
            F.least(F.floor(F.log2(n) / 2), F.lit(STEPS - 1)).cast("int"),
        )

    return let(words(text), of)


def fit_weight(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE,
) -> Callable[[Column], Column]:
    """A weight of texts, ``LEAST`` to 1: how likely ``label`` is 1, judged by each feature's step alone.

    Learned from at most ``rows`` labelled documents, those of the lowest hashes of their keys. The
    log odds of the steps, smoothed by one, are added up. Only their counts come to the driver.
    Labels other than 0 and 1 and null keys are left out, of several labels of a key the greatest
    counts; without labels of both kinds every weight is 1. Null texts are empty texts.
    """
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label"))
    known = known.where("_key is not null and _label in (0, 1)").groupBy("_key").agg(F.max("_label").alias("_label"))
    known = known.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(_BUCKETS)))
    sizes = {r._bucket: r.n for r in known.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = bound = 0
    while bound < _BUCKETS and total + sizes.get(bound, 0) <= rows:
        total += sizes.get(bound, 0)
        bound += 1
    # The keys are bounded by ``rows``.
    chosen = F.broadcast(known.where(F.col("_bucket") < bound).drop("_bucket"))
    found = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")).join(chosen, "_key")
    each = found.select("_label", F.posexplode(steps(F.col("text"))).alias("feature", "step"))
    counts = {
        (r._label, r.feature, r.step): r.n
        for r in each.groupBy("_label", "feature", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    texts = [sum(n for (y, feature, _), n in counts.items() if y == label and feature == 0) for label in (0, 1)]
    if not all(texts):
        return lambda text: F.lit(1.0)
    table = []
    for feature in range(1 + max(f for _, f, _ in counts)):
        odds = []
        for step in range(STEPS):
            bad, good = (counts.get((y, feature, step), 0) for y in (0, 1))
            odds.append(math.log((good + 1) * (texts[0] + STEPS) / ((bad + 1) * (texts[1] + STEPS))))
        table.append(F.array(*map(F.lit, odds)))
    prior = math.log(texts[1] / texts[0])

    def weight(text: Column) -> Column:
        each = F.zip_with(steps(text), F.array(*table), lambda step, odds: F.get(odds, step))
        odds = F.aggregate(each, F.lit(prior), lambda total, x: total + x)
        return F.greatest(F.lit(LEAST), 1 / (1 + F.exp(-odds)))

    return weight
