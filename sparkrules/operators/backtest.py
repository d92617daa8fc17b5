"""Two rulesets over the same history, in one scan and one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Evaluation, RuleEngine


def backtest(df: DataFrame, a: RuleEngine, b: RuleEngine, label: str | None = None, as_of_ms: int = 0, clock: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, rules): one row of totals, and (rule_id, fired, fire_rate) of the rules of b.

    new_positives fire in b only, lost in a only. With a boolean or 0/1 ``label`` column the summary has precision and recall of
    both; they are null where nothing fires or nothing is labelled. On an empty input all rates are null.
    """
    first = Evaluation(a, df, as_of_ms, clock)
    marked = first.fired.withColumn("__hit_a", first.matched).select(*[f"`{c}`" for c in df.columns], "__hit_a")
    second = Evaluation(b, marked, as_of_ms, clock)
    hit_a, hit_b = F.col("__hit_a"), second.matched
    n = F.count("*")
    rate = lambda c, of: F.try_divide(F.count_if(c).cast("double"), of.cast("double"))
    out = {
        "total": n,
        "fire_rate_a": rate(hit_a, n),
        "fire_rate_b": rate(hit_b, n),
        "new_positives": F.count_if(hit_b & ~hit_a),
        "lost": F.count_if(hit_a & ~hit_b),
        "agreement": rate(hit_a == hit_b, n),
    }
    if label:
        truth = F.coalesce(F.col(label).cast("boolean"), F.lit(False))
        for name, hit in (("a", hit_a), ("b", hit_b)):
            out[f"precision_{name}"] = rate(hit & truth, F.count_if(hit))
            out[f"recall_{name}"] = rate(hit & truth, F.count_if(truth))
    summary = second.fired.agg(*[c.alias(k) for k, c in out.items()])
    hits = [F.count_if(F.col(f"__r{i}")).alias(f"c{i}") for i in range(len(second.rules))]
    sums = second.fired.agg(n.alias("n"), *hits)
    share = lambda i: F.try_divide(F.col(f"c{i}").cast("double"), F.col("n").cast("double"))
    table = [F.struct(F.lit(r.id).alias("rule_id"), F.col(f"c{i}").alias("fired"), share(i).alias("fire_rate")) for i, r in enumerate(second.rules)]
    empty = F.expr("cast(array() AS array<struct<rule_id:string,fired:bigint,fire_rate:double>>)")
    return summary, sums.select(F.inline(F.array(*table) if table else empty))
