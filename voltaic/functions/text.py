"""Names, annotations and cell texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no value, and event types that are known.
MISSING = ("", "n/a", "nan", "none")
EVENT_TYPES = ("Stimulus", "Response", "Comment")


def clean(value: Column) -> Column:
    """Unknown if blank or a word for it."""
    return F.when(~F.lower(F.trim(value)).isin(*MISSING), F.trim(value))


def field_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def struct_name(name: Column) -> Column:
    """A field name that structs of other tools take: a letter first, 63 characters at most."""
    core = F.regexp_replace(field_name(name), "^_+", "")
    core = F.when(core == "", "field").when(core.rlike("^[a-zA-Z]"), core).otherwise(F.concat(F.lit("f_"), core))
    return F.substring(core, 1, 63)


def annotation_type(text: Column) -> Column:
    """What stands before the slash; ``Stimulus`` without one."""
    return F.when(text.contains("/"), F.trim(F.substring_index(text, "/", 1))).otherwise("Stimulus")


def annotation_description(text: Column) -> Column:
    return F.trim(F.when(text.contains("/"), F.regexp_extract(text, "^[^/]*/(.*)$", 1)).otherwise(text))


def annotation_code(kind: Column, description: Column) -> Column:
    """Trailing digits of stimuli and responses, or a text of digits alone, without leading zeros."""
    digits = F.when(kind.isin("Stimulus", "Response"), F.regexp_extract(description, r"(\d+)$", 1)).otherwise(F.regexp_extract(description, r"^(\d+)$", 1))
    return F.when(digits != "", F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")))


def matches_code(text: Column, code: Column) -> Column:
    """The code is the whole text, its description or its parsed code."""
    kind, description = annotation_type(text), annotation_description(text)
    return F.coalesce((text == code) | (description == code) | (annotation_code(kind, description) == code), F.lit(False))


def event_type(kind: Column, trial_type: Column) -> Column:
    """A known type, else the trial's type if it is one, else ``Stimulus``."""
    return F.coalesce(F.when(kind.isin(*EVENT_TYPES), kind), F.when(trial_type.isin(*EVENT_TYPES), trial_type), F.lit("Stimulus"))


def row_code(value: Column) -> Column:
    """Numbers without leading zeros; other texts as they are."""
    v = clean(value)
    return F.when(v.rlike(r"^\d+$"), F.coalesce(F.nullif(F.regexp_replace(v, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(v)


def stable_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def resample_onset(sample: Column, old: float, new: float, shift: int = 0, precision: str = "sample_quantized", onset: Column | None = None) -> Column:
    """A sample at another rate: from the old sample, from the exact time, or as a continuous sample counted from 1; ties go away from zero."""
    if precision == "exact_time":
        place = (onset + F.lit(shift / old)) * new
    elif precision == "spm_continuous_sample":
        place = ((sample + shift + 1) / F.lit(old)) * new - 1
    else:
        place = (sample + shift) / F.lit(old) * new
    return F.round(place, 0).cast("long")


def table_annotation(kind: Column, trial_type: Column, description: Column, code: Column) -> Column:
    """Annotation text of a row of an event table: type and code, or the description, the trial's type or ``n/a``."""
    c = row_code(code)
    what = F.coalesce(clean(description), clean(trial_type), F.lit("n/a"))
    t = event_type(clean(kind), clean(trial_type))
    return F.when(c.isNotNull(), F.concat(t, F.lit("/S "), c)).otherwise(F.concat(t, F.lit("/"), what))


def axis_hash(axis: Column) -> Column:
    """Identity of a time or frequency axis: equal arrays have equal hashes."""
    return F.sha1(F.concat_ws(",", F.transform(axis, lambda x: x.cast("string"))))
