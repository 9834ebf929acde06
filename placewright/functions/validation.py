"""Checks of model replies against the metadata types.

A reply is parsed once into a VARIANT, and each field is looked up once: its
JSON type and its text (:func:`probes`). The rules and readers then work on
those strings. Lax spellings that models use (``"5"``, ``5.0``, ``"true"``) are
converted; unknown keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright import schemas
from placewright.functions.text import blank_trim

INTEGER_TEXT = r"^\s*[+-]?\d+(\.0+)?\s*$"

# Texts a lax boolean accepts.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")

LANGUAGES = "language_requirements"
EXPERIENCE = "experience_requirement"
EDUCATION = "higher_education_requirement"
RELOCATION = "relocation_requirement"

#: Fields looked up in each part of a reply.
FIELDS = {
    EXPERIENCE: ("min_years_experience", "experience_requirement_evidence"),
    EDUCATION: ("is_masters_or_phd_required", "education_requirement_evidence"),
    RELOCATION: (
        "visa_sponsorship_available",
        "relocation_assistance_provided",
        "work_mode",
        "relocation_evidence",
    ),
}
LANGUAGE_FIELDS = ("language", "level", "requirement", "evidence")


def _type_of(node: Column) -> Column:
    """VOID (JSON null), OBJECT, ARRAY, STRING, BOOLEAN or a number type; NULL
    when absent. Details such as the fields of an object are cut off."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def _probe(node: Column, path: str) -> Column:
    """Type and text of one field."""
    return F.struct(
        _type_of(F.try_variant_get(node, path, "variant")).alias("type"),
        F.try_variant_get(node, path, "string").alias("text"),
    )


def probes(root: Column) -> Column:
    """Everything the rules look at, as one struct."""
    columns = [_type_of(root).alias("root")]
    for part, fields in FIELDS.items():
        columns.append(_type_of(F.try_variant_get(root, f"$.{part}", "variant")).alias(part))
        columns += [_probe(root, f"$.{part}.{field}").alias(field) for field in fields]
    listed = F.try_variant_get(root, f"$.{LANGUAGES}", "variant")
    columns.append(_type_of(listed).alias(LANGUAGES))
    items = F.try_variant_get(root, f"$.{LANGUAGES}", "array<variant>")
    columns.append(
        F.transform(
            items,
            lambda item: F.struct(
                *[_probe(item, f"$.{field}").alias(field) for field in LANGUAGE_FIELDS]
            ),
        ).alias("items")
    )
    return F.struct(*columns)


def missing(type_name: Column) -> Column:
    """Absent or JSON null."""
    return F.coalesce(type_name, F.lit("VOID")) == "VOID"


def is_object(type_name: Column) -> Column:
    return type_name.eqNullSafe("OBJECT")


def is_array(type_name: Column) -> Column:
    return type_name.eqNullSafe("ARRAY")


def is_string(type_name: Column) -> Column:
    return type_name.eqNullSafe("STRING")


def is_boolean(type_name: Column) -> Column:
    return type_name.eqNullSafe("BOOLEAN")


def is_number(type_name: Column) -> Column:
    return F.coalesce(type_name.isin("BIGINT", "DECIMAL", "DOUBLE"), F.lit(False))


def _whole(value: Column) -> Column:
    return F.regexp_replace(blank_trim(value), r"\.0+$", "").try_cast("int")


def bad_integer(p: Column) -> Column:
    # a whole number beyond 32 bits is invalid, not missing
    spelled = F.coalesce(
        F.rlike(p["text"], F.lit(INTEGER_TEXT)) & _whole(p["text"]).isNotNull(), F.lit(False)
    )
    return ~(
        missing(p["type"])
        | is_boolean(p["type"])
        | ((is_number(p["type"]) | is_string(p["type"])) & spelled)
    )


def read_integer(p: Column) -> Column:
    return (
        F.when(is_boolean(p["type"]), (p["text"] == "true").cast("int"))
        .otherwise(_whole(p["text"]))
    )


def _bool_text(p: Column) -> Column:
    """Lower-case text, with a number like ``1.0`` read as ``1``."""
    return F.when(
        is_number(p["type"]), F.regexp_replace(p["text"], r"\.0+$", "")
    ).otherwise(F.lower(p["text"]))


def bad_boolean(p: Column) -> Column:
    text = _bool_text(p)
    ok = (
        missing(p["type"])
        | is_boolean(p["type"])
        | (is_number(p["type"]) & text.isin("0", "1"))
        | (is_string(p["type"]) & text.isin(*TRUE_TEXTS, *FALSE_TEXTS))
    )
    return ~F.coalesce(ok, F.lit(False))


def read_boolean(p: Column) -> Column:
    text = _bool_text(p)
    return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)


def bad_text(p: Column) -> Column:
    """A required string."""
    return ~is_string(p["type"])


def bad_optional_text(p: Column) -> Column:
    return ~(missing(p["type"]) | is_string(p["type"]))


def bad_choice(allowed: tuple[str, ...]):
    """A literal with a default: may be absent, but not null."""

    def check(p: Column) -> Column:
        listed = F.coalesce(p["text"].isin(*allowed), F.lit(False))
        return ~(p["type"].isNull() | (is_string(p["type"]) & listed))

    return check


FIELD_RULES = {
    "min_years_experience": bad_integer,
    "experience_requirement_evidence": bad_text,
    "is_masters_or_phd_required": bad_boolean,
    "education_requirement_evidence": bad_optional_text,
    "visa_sponsorship_available": bad_boolean,
    "relocation_assistance_provided": bad_boolean,
    "work_mode": bad_choice(schemas.WORK_MODES),
    "relocation_evidence": bad_text,
}
LANGUAGE_RULES = {
    "language": bad_text,
    "level": bad_optional_text,
    "requirement": bad_choice(schemas.REQUIREMENT_LEVELS),
    "evidence": bad_text,
}


def errors(p: Column) -> Column:
    """``array<string>`` of the rules a reply breaks, in field order.

    ``p`` is the struct of :func:`probes`.
    """
    none = F.array().cast("array<string>")
    checks = [
        F.when(
            ~(missing(p[LANGUAGES]) | is_array(p[LANGUAGES])),
            F.lit(f"{LANGUAGES}: not a list"),
        )
    ]
    for field, rule in LANGUAGE_RULES.items():
        broken = F.exists(p["items"], lambda item: rule(item[field]))  # noqa: B023
        checks.append(F.when(broken, F.lit(f"{LANGUAGES}.{field}: invalid")))
    for part, fields in FIELDS.items():
        checks.append(
            F.when(
                ~(missing(p[part]) | is_object(p[part])), F.lit(f"{part}: not an object")
            )
        )
        checks += [
            F.when(
                is_object(p[part]) & FIELD_RULES[field](p[field]),
                F.lit(f"{part}.{field}: invalid"),
            )
            for field in fields
        ]
    return (
        F.when(p["root"].isNull(), F.array(F.lit("reply: not JSON")))
        .when(~is_object(p["root"]), F.array(F.lit("reply: not an object")))
        .otherwise(F.coalesce(F.array_compact(F.array(*checks)), none))
    )


def read(p: Column) -> Column:
    """Nested metadata of a reply that breaks no rule."""

    def part(name: str, type_text: str, **fields: Column) -> Column:
        built = F.struct(*[value.alias(field) for field, value in fields.items()])
        return F.when(is_object(p[name]), built).cast(type_text).alias(name)

    languages = F.transform(
        p["items"],
        lambda item: F.struct(
            item["language"]["text"].alias("language"),
            item["level"]["text"].alias("level"),
            F.coalesce(item["requirement"]["text"], F.lit("required")).alias("requirement"),
            item["evidence"]["text"].alias("evidence"),
        ),
    )
    return F.struct(
        languages.cast(f"ARRAY<{schemas.LANGUAGE}>").alias(LANGUAGES),
        part(
            EXPERIENCE,
            schemas.EXPERIENCE,
            min_years_experience=read_integer(p["min_years_experience"]),
            experience_requirement_evidence=p["experience_requirement_evidence"]["text"],
        ),
        part(
            EDUCATION,
            schemas.EDUCATION,
            is_masters_or_phd_required=read_boolean(p["is_masters_or_phd_required"]),
            education_requirement_evidence=p["education_requirement_evidence"]["text"],
        ),
        part(
            RELOCATION,
            schemas.RELOCATION,
            visa_sponsorship_available=read_boolean(p["visa_sponsorship_available"]),
            relocation_assistance_provided=read_boolean(
                p["relocation_assistance_provided"]
            ),
            work_mode=F.coalesce(p["work_mode"]["text"], F.lit("unknown")),
            relocation_evidence=p["relocation_evidence"]["text"],
        ),
    ).cast(schemas.NESTED_METADATA)
