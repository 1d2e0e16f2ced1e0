"""Maths on probability and score arrays as column expressions; everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it; a lambda would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def argmax_first(p: Column) -> Column:
    """0-based place of the greatest value, the first of equals; null for a null or empty array."""
    return F.when(F.size(p) > 0, F.array_position(p, F.array_max(p)).cast("int") - 1)


def renormalise(p: Column) -> Column:
    """Divided by the sum; null where that is not positive."""
    return let(p, lambda q: let(total(q), lambda s: F.when(s > 0, F.transform(q, lambda x: x / s))))


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return renormalise(let(z, lambda y: let(F.array_max(y), lambda top: F.transform(y, lambda x: F.exp((x - top) / t)))))


def log_softmax(z: Column) -> Column:
    shifted = let(z, lambda y: let(F.array_max(y), lambda top: F.transform(y, lambda x: x - top)))
    return let(shifted, lambda y: let(F.ln(total(F.transform(y, F.exp))), lambda norm: F.transform(y, lambda x: x - norm)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def temper(p: Column, temperature: float | Column) -> Column:
    """softmax(ln p / T), probabilities clipped at 1e-12."""
    return softmax(F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(EPS)))), temperature)


def confidence(p: Column) -> Column:
    """(K max - 1) / (K - 1) within 0 and 1; 1 for a single option."""
    k = F.size(p).cast("double")
    return F.when(k == 1, 1.0).when(k > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k * F.array_max(p) - 1) / (k - 1))))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def entropy(p: Column) -> Column:
    """In nats; a probability of 0 adds nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def brier(p: Column, gold: Column) -> Column:
    """Sum over the options of the squared difference from the gold option's 1."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), 2)))


def at(p: Column, i: Column) -> Column:
    return F.when((i >= 0) & (i < F.size(p)), F.get(p, i))


def nll(p: Column, gold: Column, added: bool = False) -> Column:
    """-ln of the gold option's probability, with 1e-12 added, or clipped at it."""
    g = at(p, gold)
    return -F.ln(g + EPS) if added else -F.ln(F.greatest(g, F.lit(EPS)))


def kl(p: Column, q: Column) -> Column:
    """KL divergence of q from p, both clipped at 1e-12."""
    return total(F.zip_with(p, q, lambda a, b: a * (F.ln(F.greatest(a, F.lit(EPS))) - F.ln(F.greatest(b, F.lit(EPS))))))


def smooth_labels(n: Column, gold: Column, top: float = 0.92) -> Column:
    """`top` on the gold option, the rest spread evenly; 1 for a single option."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, 1.0).when(i == gold, top).otherwise((1 - top) / (n - 1)))


def floor_probs(p: Column, floor: float = 1e-4, low: float = 0.9, high: float = 1.1) -> Column:
    """Null where the mass lies outside low and high; else each at least floor, divided by the new sum."""
    s = total(p)
    return F.when((s >= low) & (s <= high), renormalise(F.transform(p, lambda x: F.greatest(x, F.lit(floor)))))


def densify(ids: Column, values: Column, n: Column, floor: float = 1e-4) -> Column:
    """A sparse top-k (0-based option numbers and values) over n options: what is left of 1 goes evenly to the options that
    are not named; null where the named mass lies outside 0.5 and 1.02."""
    s = total(values)
    rest = F.greatest(F.lit(0.0), 1 - s) / F.greatest(F.lit(1), n - F.size(ids))
    full = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(floor), F.coalesce(F.get(values, F.array_position(ids, i).cast("int") - 1), rest)))
    return F.when((s >= 0.5) & (s <= 1.02), renormalise(full))


def soft_targets(utility: Column, scale: float = 0.45, floor: float = 0.004) -> Column:
    return renormalise(F.transform(softmax(utility, scale), lambda x: F.greatest(x, F.lit(floor))))


def ordinal(score: Column, gaps: Column) -> Column:
    """Cumulative-link probabilities of K levels: thresholds from softplus gaps around 0, the probability of a level being the
    difference of neighbouring sigmoids, clipped at 1e-7 and renormalised. gaps has K-1 values, the last of which is unused
    by the thresholds but centres them."""
    g = F.transform(gaps, lambda x: softplus(x) + 1e-3)
    half = total(g) / 2
    k = F.size(gaps)
    cut = F.transform(F.sequence(F.lit(1), k), lambda i: F.aggregate(F.slice(g, F.lit(1), i), F.lit(0.0), lambda a, x: a + x) - half)
    above = F.concat(F.array(F.lit(1.0)), F.transform(cut, lambda t: sigmoid(score - t)), F.array(F.lit(0.0)))
    p = F.transform(F.sequence(F.lit(1), k + 1), lambda i: F.greatest(F.lit(1e-7), F.element_at(above, i) - F.element_at(above, i + 1)))
    return renormalise(p)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def binary_cross_entropy(p: Column, target: Column) -> Column:
    """Mean over the options of the cross-entropy of each probability with its target, clipped at 1e-12."""
    one = lambda x, t: t * F.ln(F.greatest(x, F.lit(EPS))) + (1 - t) * F.ln(F.greatest(1 - x, F.lit(EPS)))
    return -total(F.zip_with(p, target, one)) / F.size(p)
