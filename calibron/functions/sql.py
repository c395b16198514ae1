"""The measurement functions for ``spark.sql`` text: SQL functions that Catalyst inlines, and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Coefficients of the rational form of the normal tail below 7.07, and of its continued fraction beyond.
TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients: tuple[float, ...], z: str) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c!r})"
    return out.replace("e-", "E-")


def normal_cdf(z: str) -> str:
    """SQL for the normal distribution function of the expression ``z``; any engine with exp, abs and CASE runs it."""
    x = f"abs({z})"
    small = f"exp(-{x} * {x} / 2) * {_horner(TOP, x)} / {_horner(BOTTOM, x)}"
    large = f"exp(-{x} * {x} / 2) / 2.506628274631E0 / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65E0)))))"
    tail = f"CASE WHEN {x} > 37 THEN 0E0 WHEN {x} < 7.07106781186547E0 THEN {small} ELSE {large} END"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


#: name(arguments) -> (type, body).
FUNCTIONS = {
    "sigmoid(z DOUBLE)": ("DOUBLE", "CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END"),
    "irt_prob(theta DOUBLE, a DOUBLE, b DOUBLE)": ("DOUBLE", "sigmoid(a * (theta - b))"),
    "fisher_info(theta DOUBLE, a DOUBLE, b DOUBLE)": ("DOUBLE", "a * a * irt_prob(theta, a, b) * (1 - irt_prob(theta, a, b))"),
    "se_after(se DOUBLE, info DOUBLE)": ("DOUBLE", "1 / sqrt(1 / (se * se) + info)"),
    "normal_cdf(z DOUBLE)": ("DOUBLE", normal_cdf("z")),
    "wrong_order(distance DOUBLE, var DOUBLE, zone DOUBLE)": ("DOUBLE", "normal_cdf(-(abs(distance) + zone) / sqrt(var))"),
    "normalize_reply(reply STRING)": ("STRING", r"trim(regexp_replace(regexp_replace(lower(reply), '[!-/:-@\\[-`{-~]', ''), '(?U)\\s+', ' '))"),
}


class ItemCurve:
    """item_curve(a, b, lo, hi, n): chance of a right answer and information at n abilities from lo to hi."""

    def eval(self, a: float, b: float, lo: float, hi: float, n: int):
        import math

        for k in range(n):
            theta = lo + (hi - lo) * k / max(1, n - 1)
            p = 1 / (1 + math.exp(-a * (theta - b)))
            yield theta, p, a * a * p * (1 - p)


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session; a second call replaces them."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("item_curve", udtf(ItemCurve, returnType="theta double, p double, info double"))
