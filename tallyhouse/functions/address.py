"""Address columns: parsing, rendering and the derived one-line forms.

``a`` is always a struct column with the six string fields of ``schema.ADDRESS``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.schema import ADDRESS

# Country spellings with a postal format, and the formats.
POSTAL_FORMATS = (
    (("US", "USA", "UNITED STATES"), r"^\d{5}(-\d{4})?$"),
    (("CA", "CANADA"), r"^[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d$"),
    (("UK", "UNITED KINGDOM", "GB"), r"^[A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2}$"),
)
POSTAL_CHARACTERS = r"^[A-Za-z0-9\s-]+$"
MAX_LENGTHS = {
    "addressLine1": 255, "addressLine2": 255, "city": 100,
    "state": 100, "postalCode": 20, "country": 100,
}
REQUIRED = ("addressLine1", "city", "state", "postalCode", "country")


def matches(text: Column, pattern: str) -> Column:
    """The pattern covers the whole text; ``$`` alone would let a line break follow."""
    return text.rlike(rf"\A(?:{pattern})\z")


def parse(json: Column) -> Column:
    """Struct from JSON text; null where the text is null or is no JSON object (see ``is_broken``)."""
    return F.from_json(json, ADDRESS, {"mode": "PERMISSIVE"})


def is_broken(json: Column) -> Column:
    """JSON text that does not hold an object."""
    corrupt = "addressLine1 string, _corrupt_record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(json, corrupt, options)
    return json.isNull() | F.coalesce(parsed["_corrupt_record"].isNotNull(), F.lit(True))


def render(a: Column) -> Column:
    """JSON text with all six fields, null ones included."""
    return F.to_json(a, {"ignoreNullFields": "false"})


def trimmed(text: Column) -> Column:
    """Without spaces and control characters at either end."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def filled(text: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(text.rlike(r"[^\x00-\x20]"), F.lit(False))


def has_secondary_line(a: Column) -> Column:
    return filled(a["addressLine2"])


def _text(value: Column) -> Column:
    """Null prints as the word null, as it does where the text is assembled field by field."""
    return F.coalesce(value, F.lit("null"))


def _joined(a: Column, separator: str, state_separator: str) -> Column:
    second = F.when(has_secondary_line(a), F.concat(F.lit(separator), a["addressLine2"]))
    return F.concat(
        _text(a["addressLine1"]),
        F.coalesce(second, F.lit("")),
        F.lit(separator), _text(a["city"]),
        F.lit(state_separator), _text(a["state"]),
        F.lit(" "), _text(a["postalCode"]),
        F.lit(separator), _text(a["country"]),
    )


def full_address(a: Column) -> Column:
    return _joined(a, ", ", ", ")


def formatted_address(a: Column) -> Column:
    return _joined(a, "\n", ", ")


def is_domestic(a: Column, home: str) -> Column:
    return F.coalesce(F.upper(a["country"]) == home.upper(), F.lit(False))


def city_state(a: Column) -> Column:
    return F.concat_ws(", ", a["city"], a["state"])


def state_postal(a: Column) -> Column:
    return F.concat_ws(" ", a["state"], a["postalCode"])


def summary(a: Column) -> Column:
    place = F.when(a["city"].isNotNull() | a["state"].isNotNull(), city_state(a))
    # an empty first line takes no separator
    first = F.when(F.length(a["addressLine1"]) > 0, a["addressLine1"])
    return F.concat_ws(", ", first, place)


def is_complete(a: Column) -> Column:
    complete = F.lit(True)
    for field in REQUIRED:
        complete = complete & filled(a[field])
    return complete


def is_valid_postal(a: Column) -> Column:
    """Postal format of the country; other countries take any, null country or code takes none."""
    country = F.upper(a["country"])
    valid = F.lit(True)
    for names, pattern in reversed(POSTAL_FORMATS):
        valid = F.when(country.isin(*names), matches(a["postalCode"], pattern)).otherwise(valid)
    known = a["country"].isNotNull() & a["postalCode"].isNotNull()
    return F.coalesce(F.when(known, valid), F.lit(False))


def normalized_postal(a: Column) -> Column:
    return F.regexp_replace(F.upper(a["postalCode"]), r"\s", "")


def normalize(a: Column) -> Column:
    """All fields trimmed, the postal code in capitals."""
    fields = [trimmed(a[f.name]).alias(f.name) for f in ADDRESS.fields if f.name != "postalCode"]
    postal = F.upper(trimmed(a["postalCode"])).alias("postalCode")
    fields.insert(4, postal)
    return F.when(a.isNotNull(), F.struct(*fields))


def same(a: Column, b: Column) -> Column:
    """Both present and equal in every field (two nulls in one field are equal)."""
    return a.isNotNull() & b.isNotNull() & a.eqNullSafe(b)
