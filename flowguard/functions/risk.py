"""Risk scoring, class naming and event shaping as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.functions.constants import ATTACK_NAMES, DEFAULT_SEVERITY, SEVERITY_WEIGHTS


def round_half_even(value: Column, digits: int) -> Column:
    """Round by scaling, ties to even, as array libraries do."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def severity_weight(attack: Column) -> Column:
    """JOIN-04. The table has one entry per class, so the lookup is a literal map in the projection."""
    return F.coalesce(F.try_element_at(literal_map(SEVERITY_WEIGHTS), attack), F.lit(DEFAULT_SEVERITY))


def attack_name(class_index: Column) -> Column:
    """JOIN-03. An index without a name keeps its own text."""
    names = literal_map(dict(enumerate(ATTACK_NAMES)))
    index = class_index.cast("int")
    return F.coalesce(F.try_element_at(names, index), index.cast("string"))


def risk_score(attack: Column, confidence: Column) -> Column:
    """EXP-01."""
    benign = round_half_even((F.lit(1.0) - confidence) * 20.0, 2)
    hostile = round_half_even(severity_weight(attack) * (F.lit(0.5) + F.lit(0.5) * confidence), 2)
    score = F.when(attack == "BENIGN", benign).otherwise(hostile)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def risk_level(score: Column, low: float = 25.0, medium: float = 50.0, high: float = 75.0) -> Column:
    """EXP-02."""
    return (
        F.when(score < low, "Low")
        .when(score < medium, "Medium")
        .when(score < high, "High")
        .otherwise("Critical")
    )


def confidence_of(probabilities: Column) -> Column:
    """EXP-03: the largest probability, 1.0 when there are none."""
    return F.when(probabilities.isNull() | (F.size(probabilities) == 0), F.lit(1.0)).otherwise(F.array_max(probabilities))


def probability_map(probabilities: Column, attack: Column) -> Column:
    """EXP-03: class name to probability, four decimals; a single certain entry when there are none."""
    named = F.map_from_arrays(
        F.transform(probabilities, lambda p, i: attack_name(i)),
        F.transform(probabilities, lambda p: round_half_even(p, 4)),
    )
    return F.when(probabilities.isNull(), F.create_map(attack, F.lit(1.0))).otherwise(named)


def top_probabilities(probabilities: Column, k: int = 5) -> Column:
    """SRT-03: the k most probable classes of a map, largest first, name as tie-break."""
    def order(a: Column, b: Column) -> Column:
        return (
            F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
            .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        )
    return F.slice(F.array_sort(F.map_entries(probabilities), order), 1, k)


def traffic_type(label: Column) -> Column:
    """PRJ-14."""
    return F.when(F.lower(F.trim(label)) == "benign", "Benign").otherwise("Malicious")


def is_threat(attack: Column, level: Column) -> Column:
    """FIL-09."""
    return level.isin("High", "Critical") | (F.upper(attack) != "BENIGN")


def time_label(ts: Column, hourly: bool) -> Column:
    """EXP-10."""
    return F.date_format(ts, "yyyy-MM-dd HH:00" if hourly else "yyyy-MM-dd")


def per_second(amount: Column, seconds: Column) -> Column:
    """EXP-13: a rate whose duration has a floor of one millisecond."""
    return amount / F.greatest(F.lit(0.001), seconds)
