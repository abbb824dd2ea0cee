"""Reference tables of the domain and the lookups on them (pipes, chambers, clearances, crossing rules, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the domain -------------------------------------------------------------------------------------------
#: dn, capacity t/h, longest run m, price of new pipe per m, width of the pair m, height m.
PIPES = [
    (50, 3.5, 181, 74023, 0.4, 0.125),
    (65, 8.3, 245, 78631, 0.43, 0.14),
    (80, 13.2, 327, 83530, 0.47, 0.16),
    (100, 22.3, 419, 89748, 0.51, 0.18),
    (125, 40.2, 554, 97275, 0.6, 0.225),
    (150, 65.1, 696, 105507, 0.65, 0.25),
    (200, 152.3, 1042, 120275, 0.88, 0.315),
    (250, 274.9, 1379, 135323, 1.05, 0.4),
    (300, 437.4, 1718, 150022, 1.15, 0.45),
    (400, 943.1, 2477, 190299, 1.37, 0.56),
    (500, 1663.4, 3245, 224137, 1.67, 0.71),
    (600, 2627.7, 4037, 264790, 1.85, 0.8),
    (700, 3735.1, 4775, 324298, 2.05, 0.9),
    (800, 5296.8, 5644, 325996, 2.25, 1.0),
    (900, 7165.0, 6518, 327693, 2.45, 1.1),
    (1000, 9391.8, 7419, 418777, 2.65, 1.2),
    (1200, 15012.8, 9288, 428074, 3.1, 1.425),
    (1400, 22501.9, 11276, 683417, 3.45, 1.6),
]
#: from dn, to dn, cost.
CHAMBERS = [(50, 200, 3000000), (250, 500, 5000000), (600, 1000, 8000000), (1200, 1400, 12000000)]
TIE_IN_COST, TIE_IN_RADIUS, MAX_DEGREE = 5000000, 10.0, 4
PENALTY, PENALTY_PER_TPH = 100000000, 500000
COST_WEIGHT, COST_BASE, LENGTH_WEIGHT, LENGTH_BASE = 0.7, 25000000, 0.3, 100
#: dn below this, clearance to a building m.
CLEARANCES = [(500, 5.0), (900, 7.0), (100000, 9.0)]
#: restriction type, rule, least distance m, least angle, factor of the price, width of the object m.
RULES = [
    ("park", "FORBIDDEN", 1.0, None, None, None),
    ("social_area", "FORBIDDEN", 1.0, None, None, None),
    ("prohibited_site", "FORBIDDEN", 1.0, None, None, None),
    ("water", "FORBIDDEN", 1.0, None, None, None),
    ("railway", "FORBIDDEN", 1.0, None, None, None),
    ("road", "SPECIAL", 1.5, 45.0, 1.6, None),
    ("tram_tracks", "SPECIAL", 1.5, 45.0, 1.75, None),
    ("gas_pipeline", "SPECIAL", 2.0, None, 1.25, 0.4),
    ("power_cable", "SPECIAL", 2.0, None, 1.15, 0.2),
    ("heat_network", "SPECIAL", 1.0, None, 1.05, None),
]
UNKNOWN_RULE = ("FORBIDDEN", 1.0)
MAX_TURN, TURN_TOLERANCE = 90.0, 1.0
# ----------------------------------------------------------------------------------------------------------------------
_SLACK = 1e-9


def pipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PIPES, "dn int, capacity double, max_length int, price int, pair_width double, height double")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "restriction_type string, rule string, min_distance double, min_angle double, k double, object_width double")


def _first(cases: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0]))


def dn_for_flow(flow: Column) -> Column:
    """Smallest pipe whose capacity, with a slack of 1e-9, carries the flow; null if none does or the flow is null."""
    return _first([(flow <= c + _SLACK, F.lit(dn)) for dn, c, *_ in PIPES])


def pipe_price(dn: Column) -> Column:
    """Price of a metre of new pipe; null for a dn that is not in the table."""
    return _first([(dn == d, F.lit(price)) for d, _, _, price, *_ in PIPES])


def max_run(dn: Column) -> Column:
    return _first([(dn == d, F.lit(length)) for d, _, length, *_ in PIPES])


def chamber_cost(dn: Column) -> Column:
    """By bracket; between brackets the next higher one, above all the last."""
    return _first([(dn <= high, F.lit(cost)) for _, high, cost in CHAMBERS]).otherwise(F.when(dn.isNotNull(), CHAMBERS[-1][2]))


def clearance(dn: Column) -> Column:
    return _first([(dn < below, F.lit(m)) for below, m in CLEARANCES])


def penalty(flow: Column) -> Column:
    return PENALTY + PENALTY_PER_TPH * flow


def score(cost: Column, length: Column) -> Column:
    return COST_WEIGHT * cost / COST_BASE + LENGTH_WEIGHT * length / LENGTH_BASE


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, for negative numbers too."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def segment_cost(length: Column, dn: Column, k: Column) -> Column:
    return round_half_up(round_half_up(length, 3) * pipe_price(dn) * k, 2)


def with_rule(df: DataFrame, column: str = "restriction_type") -> DataFrame:
    """Adds rule, min_distance and k; types that are not in the table, and null, get the rule for unknown ones."""
    found = df.join(F.broadcast(rules(df.sparkSession).select(F.col("restriction_type").alias("_type"), "rule", "min_distance", "k")), F.col(column) == F.col("_type"), "left")
    return found.drop("_type").withColumns({"rule": F.coalesce("rule", F.lit(UNKNOWN_RULE[0])), "min_distance": F.coalesce("min_distance", F.lit(UNKNOWN_RULE[1])), "k": F.coalesce("k", F.lit(1.0))})


def tie_in_cost(n_new: Column, in_chamber: Column) -> Column:
    """What n new segments that meet an existing chamber cost; ties to a segment cost nothing here."""
    return F.when(in_chamber, n_new * TIE_IN_COST).otherwise(0)


def half_width(dn: Column) -> Column:
    """Half of the width of a pair of pipes; null for a dn that is not in the table."""
    return _first([(dn == d, F.lit(width / 2)) for d, _, _, _, width, _ in PIPES])


def clearance_for(building: Column, dn: Column, min_distance: Column, object_width: Column, extra: float = 0.0) -> Column:
    """Distance from the axis of a new pair of pipes to an obstacle: to a building by dn, else by the rule and half the object's width."""
    return F.when(building, clearance(dn)).otherwise(min_distance + F.coalesce(object_width, F.lit(0.0)) / 2) + half_width(dn) + extra


def capacity_at_least(dn: Column) -> Column:
    """Capacity of the pipe of this dn, or of the next larger one in the table; null above all."""
    return _first([(dn <= d, F.lit(c)) for d, c, *_ in PIPES])


def assumed_flow(dn: Column, share: float | None) -> Column:
    """Flow of an existing pipe that is not known: a share of its capacity, or none."""
    return F.lit(0.0) if share is None else F.coalesce(capacity_at_least(dn) * share, F.lit(0.0))
