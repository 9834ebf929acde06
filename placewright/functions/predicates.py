"""The six compatibility rules as three-valued column predicates.

A rule removes a posting only on an explicit fact. Unknown (NULL) facts, a
missing requirement row and unset preferences always keep it.

Every function returns a non-NULL boolean "keep" column, so rules can be
combined and counted without further NULL handling.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.functions.core import let
from placewright.functions.text import blank_trim


def known_years(min_years: Column) -> Column:
    """Years as an integer; anything that is not one counts as none."""
    return F.coalesce(min_years.try_cast("int"), F.lit(0))


def experience_ok(min_years: Column, candidate_years: Column) -> Column:
    return F.coalesce(known_years(min_years) <= candidate_years, F.lit(True))


def degree_ok(requires_advanced_degree: Column) -> Column:
    return ~F.coalesce(requires_advanced_degree, F.lit(False))


def language_ok(requires_only_english: Column) -> Column:
    """False means another language is mandatory."""
    return F.coalesce(requires_only_english, F.lit(True))


def lower_text(description: Column) -> Column:
    return F.lower(F.coalesce(description, F.lit("")))


def skills_ok(description: Column, skills: Column) -> Column:
    """Every skill is a substring of the text, ignoring case."""
    found = let(
        lower_text(description),
        lambda text: F.forall(skills, lambda skill: F.contains(text, F.lower(skill))),
    )
    return F.when(F.size(skills) > 0, F.coalesce(found, F.lit(True))).otherwise(True)


def place_text(location: Column, country: Column) -> Column:
    return F.lower(
        F.concat_ws(" ", F.nullif(location, F.lit("")), F.nullif(country, F.lit("")))
    )


def location_ok(
    location: Column,
    country: Column,
    work_mode: Column,
    preferred: Column,
    open_to_relocation: Column,
) -> Column:
    """An empty list switches the rule off; a list of blanks matches nothing."""
    place = place_text(location, country)
    wanted = F.exists(
        preferred,
        lambda name: (blank_trim(name) != "") & F.contains(place, F.lower(name)),
    )
    inactive = (F.coalesce(F.size(preferred), F.lit(0)) <= 0) | F.coalesce(
        open_to_relocation, F.lit(False)
    )
    return inactive | work_mode.eqNullSafe("remote") | F.coalesce(wanted, F.lit(False))


def visa_ok(visa_available: Column, needs_visa: Column) -> Column:
    return ~F.coalesce(needs_visa, F.lit(False)) | F.coalesce(visa_available, F.lit(True))


#: Order in which a funnel reports the rules.
RULES = ("experience", "degree", "language", "skills", "location", "visa")


def compatibility(
    prefs: Mapping[str, Column] | None = None, skills: Column | None = None
) -> dict[str, Column]:
    """All rules over the standard column names.

    ``prefs`` overrides the preference columns (``experience_years``,
    ``must_have_skills``, ``preferred_locations``, ``open_to_relocation``,
    ``requires_visa_sponsorship``), for example with literals. With ``skills``
    the skill rule is that column, so that no text is needed.
    """
    prefs = dict(prefs or {})

    def pref(name: str) -> Column:
        return prefs.get(name, F.col(name))

    return {
        "experience": experience_ok(
            F.col("min_experience_years"), pref("experience_years")
        ),
        "degree": degree_ok(F.col("requires_advanced_degree")),
        "language": language_ok(F.col("requires_only_english")),
        "skills": skills_ok(F.col("description"), pref("must_have_skills"))
        if skills is None
        else skills,
        "location": location_ok(
            F.col("location"),
            F.col("country"),
            F.col("work_mode"),
            pref("preferred_locations"),
            pref("open_to_relocation"),
        ),
        "visa": visa_ok(
            F.col("visa_sponsorship_available"), pref("requires_visa_sponsorship")
        ),
    }


def literal_preferences(
    experience_years: int | None = None,
    must_have_skills: list[str] | None = None,
    preferred_locations: list[str] | None = None,
    open_to_relocation: bool = False,
    requires_visa_sponsorship: bool = False,
) -> dict[str, Column]:
    """Preferences of one candidate as constants."""

    def strings(values: list[str] | None) -> Column:
        return F.array(*[F.lit(v) for v in values or []]).cast("array<string>")

    return {
        "experience_years": F.lit(experience_years).cast("int"),
        "must_have_skills": strings(must_have_skills),
        "preferred_locations": strings(preferred_locations),
        "open_to_relocation": F.lit(open_to_relocation),
        "requires_visa_sponsorship": F.lit(requires_visa_sponsorship),
    }
