"""Rounding and salary parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwatch.functions.text import SPACE

# Plausible yearly gross salaries, in thousands.
MIN_KEUR, MAX_KEUR = 15, 200


def round_exact(col: Column, digits: int) -> Column:
    """Round the binary value of a double half to even, as Python's round does.

    bround() rounds the printed decimal, so 0.1-grid sums such as 61.349999999999994 differ from
    it at ties; the JVM's DecimalFormat behind format_number looks at the exact value.
    """
    return F.call_function("format_number", col, F.lit("0." + "0" * digits)).cast("double")


def to_keur(amount: Column, interval: Column) -> Column:
    """Yearly or monthly amount to yearly thousands, half to even; other intervals are null."""
    value = amount.try_cast("double")
    yearly = (
        F.when(F.lower(interval) == "yearly", value / 1000)
        .when(F.lower(interval) == "monthly", value * 12 / 1000)
    )
    return F.when(~F.isnan(value), F.bround(yearly, 0).try_cast("int"))


def _keur_range(values: Column) -> Column:
    """struct(salary_min, salary_max) of the first two plausible amounts; one alone is a minimum."""
    plausible = F.slice(F.filter(values, lambda v: v.between(MIN_KEUR, MAX_KEUR)), 1, 2)
    return F.struct(
        F.when(F.size(plausible) > 0, F.array_min(plausible)).cast("int").alias("salary_min"),
        F.when(F.size(plausible) > 1, F.array_max(plausible)).cast("int").alias("salary_max"),
    )


_NO_RANGE = "cast(null as struct<salary_min: int, salary_max: int>)"


def salary_from_label(label: Column) -> Column:
    """'Annuel de 55000,00 Euros à 65000,00 Euros' to (55, 65); monthly amounts times twelve."""
    low = F.lower(label)
    factor = F.when(low.contains("annuel"), 1.0).when(low.contains("mensuel"), 12.0)
    numbers = F.regexp_extract_all(label, F.lit(rf"(?U)\d[\d\s\x{{202f}}]*(?:[.,]\d+)?"), F.lit(0))
    amounts = F.transform(
        numbers,
        lambda n: F.bround(
            F.replace(F.regexp_replace(n, f"(?U){SPACE}", ""), F.lit(","), F.lit("."))
            .try_cast("double") * factor / 1000,
            0,
        ),
    )
    return F.when(factor.isNotNull(), _keur_range(amounts)).otherwise(F.expr(_NO_RANGE))


def salary_from_keur_label(label: Column) -> Column:
    """'43 - 53 k€ brut annuel' to (43, 53); needs k€ or keur in the text."""
    low = F.lower(label)
    numbers = F.regexp_extract_all(label, F.lit(r"(?U)\d+(?:[.,]\d+)?"), F.lit(0))
    amounts = F.transform(
        numbers,
        lambda n: F.bround(F.replace(n, F.lit(","), F.lit(".")).try_cast("double"), 0),
    )
    return F.when(
        low.contains("k€") | low.contains("keur"), _keur_range(amounts)
    ).otherwise(F.expr(_NO_RANGE))
