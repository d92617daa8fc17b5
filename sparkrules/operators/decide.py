"""From fired rules to a decision: score fold, winner, risk band."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..plans.spec import SEVERITIES, Rule, Ruleset

BUILT_IN_RANK = {"approve": 0, "score": 1, "flag": 2, "review": 3, "block": 4}
INT_MIN = -(1 << 31)
PLACE_BITS = 19
HIGH_SCORE, MEDIUM_SCORE = 80.0, 40.0


@dataclass(frozen=True)
class Registry:
    """Decision labels by code, and their ranks; code 0 is the default decision."""

    labels: tuple[str, ...]
    ranks: dict[str, int]

    @classmethod
    def of(cls, ruleset: Ruleset) -> Registry:
        labels = dict.fromkeys([ruleset.default_decision, *ruleset.precedence, *(r.label for r in ruleset.rules)])
        place = {label: i for i, label in reversed(list(enumerate(ruleset.precedence)))}
        # a label that precedence does not rank above the first place comes after all that it does rank
        ranks = {x: place.get(x, 0) or (0 if x == ruleset.default_decision else len(ruleset.precedence)) for x in labels}
        return cls(tuple(labels), ranks)

    def rank(self, rule: Rule) -> int:
        return self.ranks[rule.label] or BUILT_IN_RANK[rule.action]


def contribution(rule: Rule) -> float:
    if rule.weight == 0 and rule.action != "approve":
        return (SEVERITIES.index(rule.severity) + 1) * 10.0
    return rule.weight


def score(rules: list[tuple[Rule, Column]]) -> Column:
    """Contributions in rule order; a rule's cap bounds the running total. Shadow rules have no part."""
    s = F.lit(0.0)
    for rule, fired in rules:
        if rule.shadow:
            continue
        s = s + F.when(fired, F.lit(contribution(rule))).otherwise(F.lit(0.0))
        if rule.score_cap > 0:
            s = F.least(s, F.when(fired, F.lit(rule.score_cap)).otherwise(F.lit(float("inf"))))
    return s


def winner(rules: list[tuple[Rule, Column]], registry: Registry, default: str) -> Column:
    """The index of the winning rule, -1 for none: largest (rank, severity, priority), the earliest rule among equals.

    The four are packed into one bigint for each rule, so the winner is the greatest of plain numbers.
    """

    def packed(rank: int, severity: int, priority: int, place: int) -> int:
        return ((rank << 3 | severity + 1) << 32 | priority - INT_MIN) << PLACE_BITS | place

    if len(rules) >= 1 << PLACE_BITS or len(registry.labels) > 200:
        raise ConfigError("INVALID_ENGINE_CONFIG", "too many rules or decision labels")
    last = (1 << PLACE_BITS) - 1
    keys = [F.lit(packed(registry.ranks[default], -1, INT_MIN, 0)).cast("bigint")]
    for i, (rule, fired) in enumerate(rules):
        if not rule.shadow:
            keys.append(F.when(fired, F.lit(packed(registry.rank(rule), SEVERITIES.index(rule.severity), rule.priority, last - i)).cast("bigint")))
    best = F.greatest(*keys) if len(keys) > 1 else keys[0]
    place = best.bitwiseAND(F.lit(last))
    return F.when(place == 0, F.lit(-1)).otherwise((F.lit(last) - place).cast("int"))


def risk_band(decision: Column, total: Column) -> Column:
    """Custom labels count by their score only."""
    high, medium = (decision == "BLOCK") | (total >= HIGH_SCORE), (decision == "REVIEW") | (total >= MEDIUM_SCORE)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
