"""Option distributions as aligned arrays (B4-B11, B13, B19, G5): expressions that stay in the JVM.

Maps carry no order, so a distribution is ``ids`` (sorted option ids), ``p`` (their probabilities) and ``z`` (their logits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1e-15


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: a lambda's body is evaluated for every element, so what does not depend
    on the element must be bound outside of it."""
    return F.transform(F.array(value), f)[0]


def with_options(df: DataFrame, probabilities: str = "answer.probabilities") -> DataFrame:
    """``ids, p, z`` from a map of probabilities; logits are ``ln max(p, 1e-15)``."""
    m = F.col(probabilities)
    df = df.withColumn("ids", F.array_sort(F.map_keys(m)))
    df = df.withColumn("p", F.transform("ids", lambda i: m[i]))
    return df.withColumn("z", F.transform("p", lambda x: F.ln(F.greatest(x, F.lit(LEAST)))))


def softmax(z: Column, temperature: Column | float = 1.0, bias: Column | None = None) -> Column:
    """``softmax(z / T + b)`` with the maximum taken off first (B4). T must be positive; an empty array stays empty."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    scaled = F.transform(z, lambda x: x / t)
    if bias is not None:
        scaled = F.when(bias.isNull() | (F.size(bias) != F.size(z)), scaled).otherwise(F.zip_with(scaled, bias, lambda x, b: x + b))
    exps = let(scaled, lambda s: let(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m))))
    return let(exps, lambda e: let(total(e), lambda n: F.transform(e, lambda x: x / n)))


def argmax_first(ids: Column, p: Column) -> Column:
    """Ties: the option that comes first (raw scores, calibration fits)."""
    return F.element_at(ids, F.array_position(p, F.array_max(p)).cast("int"))


def argmax_greatest_id(ids: Column, p: Column) -> Column:
    """Ties: the greatest id (rescaled scores)."""
    return F.array_max(F.arrays_zip(p.alias("p"), ids.alias("i")))["i"]


def expected(p: Column, v: Column) -> Column:
    return total(F.zip_with(p, v, lambda a, b: a * b))


def margin(p: Column) -> Column:
    """Greatest minus second greatest; null with fewer than two."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) >= 2, s[0] - s[1])


def rotate(a: Column, k: int) -> Column:
    """The array turned left by ``k mod n`` places."""
    n = F.size(a)
    r = F.pmod(F.lit(k), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(a, r + 1, n), F.slice(a, 1, r))


def max_distance(p: Column, q: Column) -> Column:
    return F.array_max(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def without_prior(z: Column, prior: Column, beta: float) -> Column:
    """``z - beta * prior``; a missing prior is 0."""
    return F.zip_with(z, prior, lambda a, b: a - F.lit(beta) * F.coalesce(b, F.lit(0.0)))


def acceptance(p: Column, policy: Column, discrepancy: Column) -> Column:
    """``accept`` or ``review`` (B13): a review-only policy, no distribution, or too large an order discrepancy review;
    else the policy's metric must reach its threshold."""
    metric = F.when(policy["metric"] == "margin", margin(p)).otherwise(F.array_max(p))
    shaky = F.coalesce(discrepancy > policy["max_order_discrepancy"], F.lit(False))
    refuse = policy.isNull() | (policy["type"] == "review_only") | p.isNull() | (F.size(p) == 0) | shaky
    return F.when(refuse, "review").when(metric >= policy["threshold"], "accept").otherwise("review")
