"""Derived survey columns as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.text import strip


def age(year_of_birth: Column, survey_year: int = 2021) -> Column:
    """Age at the survey as text; NULL if the year is no number."""
    return (F.lit(survey_year) - year_of_birth.try_cast("int")).cast("string")


def language_profile(english: Column, french: Column, others: list[Column], interface: Column) -> Column:
    """English, French, Other or Not specified from flags that are set or NULL.

    One official language alone decides; several languages with an official one among them go by the
    interface language; only other languages are Other.
    """
    en, fr = english.isNotNull(), french.isNotNull()
    other = F.exists(F.array(*others), lambda x: x.isNotNull()) if others else F.lit(False)
    by_interface = F.when(F.coalesce(interface, F.lit("EN")) == "FR-CA", "French").otherwise("English")
    return (
        F.when(en & ~fr & ~other, "English").when(fr & ~en & ~other, "French")
        .when(en | fr, by_interface).when(other, "Other").otherwise("Not specified")
    )


def riding(name: Column, region: Column, unknown: str = "Inconnu") -> Column:
    """`name (region)`, the bare name if the region is not known, the filler if there is no name."""
    text = strip(F.coalesce(name, F.lit("")))
    return F.when(text == "", unknown).when(F.coalesce(region, F.lit("")) != "", F.concat(text, F.lit(" ("), region, F.lit(")"))).otherwise(text)


def voted(label: Column, abstained: str = "Did not vote") -> Column:
    """yes unless the label says that the respondent did not vote; a missing label is text by then."""
    return F.when(F.coalesce(label, F.lit("nan")) == abstained, "no").otherwise("yes")


def split_of(domain: Column, test: list[str], drop: list[str]) -> Column:
    """train, test or drop by thematic domain; a missing domain drops the question."""
    return F.when(domain.isNull() | domain.isin(drop), "drop").when(domain.isin(test), "test").otherwise("train")
