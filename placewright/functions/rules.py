"""Requirement rules read from a posting's own words.

Each rule looks at sentences, so that the evidence it returns is a verbatim
piece of the text. Nothing is inferred: text that states nothing gives NULL
(``unknown`` for the work mode). All rules are row-local: no shuffle, and one
scan of the text column serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright import schemas

#: A full stop with a letter or digit right after it, or a small letter after a
#: blank, is part of a number or an abbreviation and ends no sentence. (The
#: number of such stops is bounded because the JVM's matcher recurses on groups.)
SENTENCE = r"[^.!?\n]+(?:\.(?:[A-Za-z0-9]|\s[a-z])[^.!?\n]*){0,20}[.!?]*"

# The vocabulary of the rules.
UNITS = (
    "one", "two", "three", "four", "five", "six",
    "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
#: One to ninety-nine, in order.
NUMBER_WORDS = UNITS + tuple(ten + (f"-{unit}" if unit else "") for ten in TENS for unit in ("", *UNITS[:9]))
LANGUAGE_NAMES = (
    "Arabic", "Bengali", "Bulgarian", "Cantonese", "Catalan", "Chinese", "Croatian", "Czech", "Danish",
    "Dutch", "English", "Estonian", "Finnish", "French", "German", "Greek", "Hebrew", "Hindi", "Hungarian",
    "Icelandic", "Indonesian", "Irish", "Italian", "Japanese", "Korean", "Latvian", "Lithuanian", "Malay",
    "Mandarin", "Norwegian", "Persian", "Polish", "Portuguese", "Romanian", "Russian", "Serbian", "Slovak",
    "Slovenian", "Spanish", "Swedish", "Tamil", "Thai", "Turkish", "Ukrainian", "Urdu", "Vietnamese",
)
YEARS = (
    r"(?i)\b(\d{1,2}(?:\.\d+)?|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")"
    r"\s*(?:\+|(?:-|–|—|to)\s*\d{1,2}(?:\.\d+)?\s*\+?)?\s*(?:years?|yrs?)\b"
)
EXPERIENCE_CONTEXT = (
    r"(?i)experience|minimum|at least|(?:years?|yrs?)\s+(?:is\s+|are\s+)?required|\d\s*\+\s*(?:years?|yrs?)\b"
)
#: Years that the employer has, not the applicant.
OWN_YEARS = (
    r"(?i)\b(?:our|the) (?:company|firm|team|business|group|agency)\b[^,;]*\b(?:has|have|had|brings?|looks? back)\b"
    r"|\bwe (?:have|bring|look back)\b|\bour [^,;]{0,40}(?:years?|yrs?) of experience\b"
)
ADVANCED = r"(?i)\b(?:master'?s?|masters|msc|m\.sc|phd|ph\.\s?d|doctorate)\b"
BACHELOR = r"(?i)\b(?:bachelor'?s?|bachelors|bsc|b\.sc)\b"
OPTIONAL = r"(?i)\b(?:plus|preferred|optional|desirable|nice to have|advantage|bonus)\b"
MANDATORY = r"(?i)\b(?:required|must|mandatory|essential|needed)\b"
NOT_NEEDED = r"(?i)\bnot (?:required|necessary|needed)\b"
LANGUAGE = r"(?i)\b(" + "|".join(LANGUAGE_NAMES) + r")\b"
LEVEL = r"(?i)\b(A1|A2|B1|B2|C1|C2|fluent|native|professional|conversational)\b"
SPONSORSHIP = r"(?i)\b(?:sponsorship|sponsor|visa support)\b"
RELOCATION = r"(?i)\brelocation\b"
DENIED = r"(?i)\b(?:no|not|cannot|unable|without|unavailable|don't|doesn't)\b"
GRANTED = r"(?i)\b(?:available|provided|offered|offer|provide|package|support|assistance|sponsor)\b"
HYBRID = r"(?i)\bhybrid\b"
REMOTE = r"(?i)\bremote\b|\bwork from anywhere\b|\bwork from home\b"
NOT_REMOTE = (
    r"(?i)\b(?:no|not) remote\b|\bremote\b[^,;.]{0,20}\b(?:not|isn't|never) (?:possible|an option|offered|available|allowed)\b"
)
ONSITE = r"(?i)\bon-?site\b|\bin-office\b"
#: Where a sentence holds two statements: a contrast, a list of statements that
#: each say how firm they are, two languages with a level each. $1 and $2 stay.
FIRM = (
    r"(?:required|must|mandatory|essential|needed|plus|preferred|optional|desirable|nice to have"
    r"|advantage|bonus|available|unavailable|provided?|offered)"
)
CLAUSE_ENDS = (
    (r"(?i)(;|,)?\s+(?:but|while|whereas|however)\s+", "\n"),
    (r";\s+", "\n"),
    (r"(?i)(\b" + FIRM + r"\b[^,;.!?\n]*),\s+([^,;.!?\n]*\b" + FIRM + r"\b)", "$1\n$2"),
    (
        r"(?i)(\b(?:A1|A2|B1|B2|C1|C2|fluent|native|professional|conversational)\s+\w+)\s+and\s+"
        r"((?:A1|A2|B1|B2|C1|C2|fluent|native|professional|conversational)\b)",
        "$1\n$2",
    ),
)
#: A question states nothing.
QUESTION = r"\?\s*$"
#: Any sentence a rule can have an opinion on contains one of these.
#: (lower case; all but "years" can only start where no letter precedes)
MENTION = (
    r"year|yr|(?<![a-z])(?:master|msc|m\.sc|phd|ph\.\s?d|doctorate|bachelor|bsc|b\.sc|sponsor|visa support"
    r"|relocation|hybrid|remote|work from|on-?site|in-office|"
    + "|".join(name.lower() for name in LANGUAGE_NAMES)
    + ")"
)


def sentences(text: Column) -> Column:
    """The statements any rule could use, verbatim, in text order.

    A text is cut at sentence ends and line breaks, and a sentence where it
    changes from one statement to another; questions are left out. Most sentences mention
    nothing of interest; one pattern drops them here, so that the rules see
    a handful of sentences and not the whole text again and again.
    """
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    telling = F.filter(
        pieces, lambda s: F.rlike(F.lower(s), F.lit(MENTION)) & ~F.rlike(s, F.lit(QUESTION))
    )
    clauses = F.flatten(F.transform(telling, lambda s: F.split(_parted(s), "\n")))
    return F.filter(F.transform(clauses, lambda s: F.trim(s)), lambda s: s != "")


def _parted(sentence: Column) -> Column:
    for pattern, between in CLAUSE_ENDS:
        sentence = F.regexp_replace(sentence, pattern, between)
    return sentence


def _numbers(sentence: Column) -> Column:
    tokens = F.regexp_extract_all(sentence, F.lit(YEARS), F.lit(1))
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    return F.transform(
        tokens,
        lambda t: F.coalesce(
            # three and a half years ask for three at least
            F.floor(t.try_cast("double")).cast("int"),
            F.nullif(F.array_position(words, F.lower(t)), F.lit(0)).cast("int"),
        ),
    )


def experience(parts: Column) -> Column:
    """Smallest number of years any sentence asks for (a range gives its
    lower end), with the first sentence that says so."""
    stating = F.filter(
        parts,
        lambda s: F.rlike(s, F.lit(YEARS))
        & F.rlike(s, F.lit(EXPERIENCE_CONTEXT))
        & ~F.rlike(s, F.lit(OWN_YEARS)),
    )
    ranked = F.transform(
        stating,
        lambda s, i: F.struct(
            F.array_min(_numbers(s)).alias("years"), i.alias("at"), s.alias("sentence")
        ),
    )
    best = F.array_min(ranked)
    return F.when(
        F.size(stating) > 0,
        F.struct(
            best["years"].alias("min_years_experience"),
            best["sentence"].alias("experience_requirement_evidence"),
        ),
    ).cast(schemas.EXPERIENCE)


def _says(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.rlike(s, F.lit(pattern))


def degree_verdict(s: Column) -> Column:
    """What one sentence says about a Master's or PhD: true, false or NULL."""
    advanced, bachelor = _says(ADVANCED)(s), _says(BACHELOR)(s)
    return (
        F.when(advanced & (_says(OPTIONAL)(s) | _says(NOT_NEEDED)(s) | bachelor), False)
        .when(advanced & _says(MANDATORY)(s), True)
        .when(~advanced & bachelor, False)
    )


def _decide(parts: Column, verdict: Callable[[Column], Column], first: bool):
    """(value, evidence): ``first`` wins over its opposite wherever it occurs."""
    said = F.filter(
        F.transform(
            parts, lambda s: F.struct(verdict(s).alias("value"), s.alias("sentence"))
        ),
        lambda v: v["value"].isNotNull(),
    )
    strong = F.filter(said, lambda v: v["value"] == F.lit(first))
    # try_element_at, not an index: an empty list must give NULL under ANSI
    return F.coalesce(
        F.try_element_at(strong, F.lit(1)), F.try_element_at(said, F.lit(1))
    )


def education(parts: Column) -> Column:
    hit = _decide(parts, degree_verdict, first=True)
    return F.when(
        hit.isNotNull(),
        F.struct(
            hit["value"].alias("is_masters_or_phd_required"),
            hit["sentence"].alias("education_requirement_evidence"),
        ),
    ).cast(schemas.EDUCATION)


def language_requirement(s: Column) -> Column:
    """How firmly a sentence that names a language asks for it."""
    return (
        F.when(_says(NOT_NEEDED)(s), "not_required")
        .when(_says(OPTIONAL)(s), "good_to_have")
        .when(
            _says(MANDATORY)(s) | F.rlike(s, F.lit(r"(?i)\b(?:fluent|native)\b")),
            "required",
        )
        .otherwise("mentioned")
    )


def languages(parts: Column) -> Column:
    """One entry per language named in a sentence, in text order."""
    naming = F.filter(parts, _says(LANGUAGE))
    per_sentence = F.transform(
        naming,
        lambda s: F.transform(
            F.array_distinct(
                F.transform(F.regexp_extract_all(s, F.lit(LANGUAGE), F.lit(1)), lambda x: F.initcap(x))
            ),
            lambda name: F.struct(
                name.alias("language"),
                F.nullif(F.regexp_extract(s, LEVEL, 1), F.lit("")).alias("level"),
                language_requirement(s).alias("requirement"),
                s.alias("evidence"),
            ),
        ),
    )
    found = F.flatten(per_sentence)
    return F.when(F.size(found) > 0, found).cast(f"ARRAY<{schemas.LANGUAGE}>")


def _support(subject: str) -> Callable[[Column], Column]:
    """true / false / NULL for a benefit the sentence must name."""
    return lambda s: (
        F.when(_says(subject)(s) & _says(DENIED)(s), False).when(
            _says(subject)(s) & _says(GRANTED)(s), True
        )
    )


def visa(parts: Column) -> Column:
    """struct(value, sentence) or NULL; a refusal wins over an offer."""
    return _decide(parts, _support(SPONSORSHIP), first=False)


def relocation_support(parts: Column) -> Column:
    return _decide(parts, _support(RELOCATION), first=False)


def mode_of_sentence(s: Column) -> Column:
    return (
        F.when(_says(HYBRID)(s), "hybrid")
        .when(_says(REMOTE)(s) & ~_says(NOT_REMOTE)(s), "remote")
        .when(_says(ONSITE)(s), "onsite")
    )


def work_mode(parts: Column) -> Column:
    """struct(value, sentence) of the first sentence naming a mode, or NULL."""
    said = F.filter(
        F.transform(
            parts,
            lambda s: F.struct(mode_of_sentence(s).alias("value"), s.alias("sentence")),
        ),
        lambda v: v["value"].isNotNull(),
    )
    return F.try_element_at(said, F.lit(1))


def relocation(parts: Column) -> Column:
    v, r, m = visa(parts), relocation_support(parts), work_mode(parts)
    evidence = F.coalesce(v["sentence"], r["sentence"], m["sentence"])
    return F.when(
        evidence.isNotNull(),
        F.struct(
            v["value"].alias("visa_sponsorship_available"),
            r["value"].alias("relocation_assistance_provided"),
            F.coalesce(m["value"], F.lit("unknown")).alias("work_mode"),
            evidence.alias("relocation_evidence"),
        ),
    ).cast(schemas.RELOCATION)


def requirements(parts: Column) -> Column:
    """All rules together as nested metadata (never NULL as a whole)."""
    return F.struct(
        languages(parts).alias("language_requirements"),
        experience(parts).alias("experience_requirement"),
        education(parts).alias("higher_education_requirement"),
        relocation(parts).alias("relocation_requirement"),
    ).cast(schemas.NESTED_METADATA)
