"""Label conversions between dataset conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: text labels of fact checking, three-way inference, factuality annotation
FACT_LABELS = {"SUPPORTS": 0, "REFUTES": 2}
FACTUALITY = {"factual": 1, "factually incorrect": 0, "too incoherent": 0}


def fact_label(raw: Column) -> Column:
    """Supported 0, refuted 2, anything else 1."""
    out = F.lit(1)
    for name, value in FACT_LABELS.items():
        out = F.when(raw == name, F.lit(value)).otherwise(out)
    return out


def entailment_label(raw: Column) -> Column:
    return F.when(raw == "entailment", F.lit(1)).otherwise(F.lit(0))


def commitment_label(raw: Column) -> Column:
    """Entailment, contradiction, neutral (0, 1, 2) to the entailment, neutral, contradiction order."""
    return F.when(raw == 1, F.lit(2)).when(raw == 2, F.lit(1)).otherwise(raw)


def known_or_neutral(raw: Column) -> Column:
    return F.when(raw == -1, F.lit(1)).otherwise(raw)


def factuality_label(raw: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in FACTUALITY.items():
        out = F.when(raw == name, F.lit(value)).otherwise(out)
    return out


def fifth(raw: Column) -> Column:
    return raw / F.lit(5.0)


def at_least(raw: Column, bound: float) -> Column:
    return (raw >= bound).cast("int")


def equals(raw: Column, value: float) -> Column:
    return (raw == value).cast("int")
