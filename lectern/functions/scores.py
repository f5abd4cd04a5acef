"""Probabilities, labels, tones and bands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class order of the tone labels; the first wins ties.
TONES = ("anti", "neutral", "pro")


def softmax(*logits: Column, shift: bool = True) -> list[Column]:
    """Shifted by the largest, which changes nothing but overflow and the last bits; without, logits must be below 700."""
    top = F.greatest(*logits) if shift else F.lit(0.0)
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


#: A power of two, by which whole parts of sums of shares are split off.
WHOLE = float(1 << 32)


def share_sum(x: Column) -> Column:
    """The sum of shares (0 to 1) rounded once, the same in any order of the rows: whole numbers of 2^-32 and the rest are added apart, both without loss."""
    whole = F.rint(x * WHOLE)
    return (F.sum(whole) + F.sum(x * WHOLE - whole)) / WHOLE


def argmax_label(values: dict[str, Column]) -> Column:
    """The name of the largest value, the first on ties."""
    top = F.greatest(*values.values())
    out = F.lit(None).cast("string")
    for name, v in reversed(values.items()):
        out = F.when(v == top, F.lit(name)).otherwise(out)
    return out


def interpolate(early: Column, modern: Column, session: Column, low: int = 73, high: int = 85) -> Column:
    """The early score up to `low`, the modern one from `high`, a straight line between."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (session - low) / (high - low)))
    return (1 - w) * early + w * modern


def tone(anti: Column, neutral: Column, pro: Column) -> Column:
    """(pro - anti) / (all + 1); 0 for an empty side."""
    a, n, p = (F.coalesce(x, F.lit(0.0)) for x in (anti, neutral, pro))
    return (p - a) / (a + n + p + 1)


def binary_tone(anti: Column, pro: Column) -> Column:
    return F.try_divide(pro, anti + pro)


def share_band(p: Column, n: Column) -> tuple[Column, Column, Column]:
    """A share with two standard errors either side, in per cent."""
    se = F.sqrt(p * (1 - p) / n)
    return p * 100, (p - 2 * se) * 100, (p + 2 * se) * 100


def net_band(pro: Column, anti: Column, n: Column) -> tuple[Column, Column, Column]:
    """Share of pro less share of anti with two standard errors either side, in per cent."""
    se = F.sqrt(pro * (1 - pro) / n + anti * (1 - anti) / n)
    net = pro - anti
    return net * 100, (net - 2 * se) * 100, (net + 2 * se) * 100


def region(state: Column) -> Column:
    from lectern.vocab import NORTHEAST_MIDWEST, SOUTH, WEST

    return (
        F.when(state.isin(*NORTHEAST_MIDWEST), "Northeast+Midwest").when(state.isin(*SOUTH), "Southeast+Southwest").when(state.isin(*WEST), "West").otherwise("Other")
    )


def one_hot(x: Column, values: list[str], prefix: str) -> list[Column]:
    return [F.when(x == v, 1.0).otherwise(0.0).alias(prefix + v) for v in values]


def confusion_corrected(probs: list[Column], priors: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Predicted class probabilities turned to true ones by Bayes' rule; matrix rows are true classes."""
    k = range(len(probs))
    joint = [[F.lit(matrix[t][p]) * priors[t] for t in k] for p in k]
    totals = [sum(row[1:], row[0]) for row in joint]
    return [sum((probs[p] * joint[p][t] / totals[p] for p in k), F.lit(0.0)) for t in k]


def beta_parameters(pos: Column, n: Column, all_pos: Column, all_n: Column, prior: float = 100.0) -> tuple[Column, Column]:
    alpha = pos + F.lit(prior) * all_pos / all_n
    return alpha, n + F.lit(prior) - alpha
