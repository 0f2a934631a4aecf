"""Numbers: normalised, blended, clamped and compared scores."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Shares of the dense, sparse and rerank scores in a blend.
BLEND = {"dense": 0.48, "sparse": 0.27, "rerank": 0.25}
#: The factors by which risk, front matter and missing assets scale a result's reusability.
RISK_FACTORS, FRONT_MATTER_FACTOR, ASSET_FACTOR = {"high": 0.55, "medium": 0.8}, 0.35, 0.85
#: What an issue of each severity takes off a rule score that starts at RULE_START.
RULE_START, RULE_COSTS, RULE_OTHER = 0.96, {"high": 0.24, "medium": 0.12}, 0.05


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def min_max(value: Column, over: WindowSpec) -> Column:
    """Values within their candidate set: 0 where none is positive, value by maximum (1 at most) where all are equal."""
    v = F.greatest(value, F.lit(0.0))
    low, high = F.min(v).over(over), F.max(v).over(over)
    return F.when(high <= 0, F.lit(0.0)).when(high == low, F.least(F.lit(1.0), v / high)).otherwise((v - low) / (high - low))


def blend(**parts: Column) -> Column:
    """Weighted mean of the parts that are given, by BLEND, clamped to 0..1."""
    total = sum(BLEND[name] for name in parts)
    return clamp(sum((part * F.lit(BLEND[name] / total) for name, part in parts.items()), F.lit(0.0)))


def reusability(score: Column, risk: Column, front_matter: Column, needs_asset: Column) -> Column:
    factor = F.lit(1.0)
    for name, value in RISK_FACTORS.items():
        factor = factor * F.when(risk == name, F.lit(value)).otherwise(F.lit(1.0))
    factor = factor * F.when(front_matter, F.lit(FRONT_MATTER_FACTOR)).otherwise(F.lit(1.0)) * F.when(needs_asset, F.lit(ASSET_FACTOR)).otherwise(F.lit(1.0))
    return F.round(clamp(score * factor), 4)


def rule_score(severities: Column) -> Column:
    """From an array of severities."""
    cost = lambda s: F.when(s == "high", F.lit(RULE_COSTS["high"])).when(s == "medium", F.lit(RULE_COSTS["medium"])).otherwise(F.lit(RULE_OTHER))
    return F.round(clamp(F.aggregate(severities, F.lit(RULE_START), lambda total, s: total - cost(s))), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, v: total + v)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
