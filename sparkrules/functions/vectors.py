"""Vector similarity in Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def similarity(metric: str, dims: list[Column], reference: tuple[float, ...]) -> Column:
    """cosine (0 for a zero norm), l2 distance or dot product; a null dimension counts as 0. The result is a float."""
    xs = [F.coalesce(d.cast("double"), F.lit(0.0)) for d in dims]
    if metric == "l2":
        out = F.sqrt(_sum([(x - F.lit(r)) * (x - F.lit(r)) for x, r in zip(xs, reference, strict=True)]))
    else:
        out = _sum([x * F.lit(r) for x, r in zip(xs, reference, strict=True)])
        if metric == "cosine":
            out = _cosine(out, _sum([x * x for x in xs]), reference)
    return out.cast("float")


def array_similarity(metric: str, vector: Column, reference: tuple[float, ...]) -> Column:
    """The same over one array column; missing elements count as 0, further ones are ignored."""
    ref = F.array(*[F.lit(float(r)) for r in reference])
    whole = F.slice(F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>")), 1, len(reference))
    pairs = F.zip_with(whole, ref, lambda a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("a"), b.alias("b")))
    add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p["a"], p["b"]))
    if metric == "l2":
        out = F.sqrt(add(lambda a, b: (a - b) * (a - b)))
    else:
        out = add(lambda a, b: a * b)
        if metric == "cosine":
            out = _cosine(out, add(lambda a, b: a * a), reference)
    return out.cast("float")


def _cosine(dot: Column, squared: Column, reference: tuple[float, ...]) -> Column:
    norm = sum(r * r for r in reference) ** 0.5
    return F.when((squared > 0) & F.lit(norm > 0), dot / (F.sqrt(squared) * F.lit(norm or 1.0))).otherwise(F.lit(0.0))
