"""Weights and scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.3}


def decay(date: Column, reference: Column, half_life_days: float = 180.0) -> Column:
    """Exponential decay with age; 1 for dates after the reference. Rounded to 12 digits, so that sums are exact decimals."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(reference) - F.unix_micros(date)) / F.lit(86400e6))
    return F.round(F.exp(F.lit(-math.log(2.0) / half_life_days) * age), 12).cast("decimal(18,12)")


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == "high", 1.0).when(confidence == "low", 0.3).otherwise(0.6)


def strength(shared: Column, confidence: Column, lift: Column) -> Column:
    """Coupling strength between 0 and 1, from shared weight, the larger confidence and lift."""
    return 0.5 * confidence + 0.25 * (1 - F.exp(-shared / 5)) + 0.25 * F.when(lift > 1, F.least(lift / 3, F.lit(1.0))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array<double>; 0 where a norm is next to 0."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(dot(a, b) / (na * nb))
