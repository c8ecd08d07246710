"""Predicates on the text of a value, as built-in expressions.

``v`` is text without surrounding white space, see :func:`strip`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.standards import NULL_TEXTS, RANGE, SHAPE, TRUE_FALSE

INT = r"(?U)^[+-]?\d+(_\d+)*\z"
DECIMAL = r"(?U)^[+-]?\d+(\.\d+)?\z"
FLOAT = r"(?U)(?i)^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\z"
NAIVE = r"^\d{4}-\d{1,2}-\d{1,2}(T|\s+)\d{1,2}:\d{1,2}:\d{1,2}\z"
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})\z"


def strip(v: Column) -> Column:
    """Text without white space around it; what begins and ends with a printable ASCII character is left as it is."""
    plain = F.ascii(v).between(33, 126) & F.ascii(F.right(v, F.lit(1))).between(33, 126)
    return F.when(plain, v).otherwise(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))


def is_boolean(v: Column) -> Column:
    return F.lower(v).isin(*TRUE_FALSE)


def is_zero_one(v: Column) -> Column:
    return v.isin("0", "1")


def is_integer(v: Column) -> Column:
    return v.rlike(INT)


def is_decimal(v: Column) -> Column:
    return v.rlike(DECIMAL)


def is_float(v: Column) -> Column:
    return v.rlike(FLOAT)


def is_naive_timestamp(v: Column) -> Column:
    spaced = F.regexp_replace(v, r"T|\s+", " ")
    return v.rlike(NAIVE) & F.try_to_timestamp(spaced, F.lit("yyyy-M-d H:m:s")).isNotNull()


def is_timestamp(v: Column) -> Column:
    timed = F.regexp_replace(v, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")  # Spark reads no time without seconds
    return v.rlike(ZONED) & F.try_to_timestamp(timed).isNotNull()


def is_date(v: Column) -> Column:
    def fits(shape: str, *formats: str) -> Column:
        parsed = F.coalesce(*(F.try_to_date(v, f) for f in formats))
        return v.rlike(shape) & parsed.isNotNull() & (F.year(parsed) > 0)

    return fits(r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d") | fits(r"^\d{1,2}-\d{1,2}-\d{4}\z", "d-M-yyyy") | fits(r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy", "d/M/yyyy")


def is_geography(v: Column) -> Column:
    return F.upper(v).rlike(SHAPE)


def is_date_range(v: Column) -> Column:
    return v.rlike(RANGE)


#: name -> predicate, as the flags of a profile.
PREDICATES = {
    "boolean": is_boolean, "zero_one": is_zero_one, "integer": is_integer, "decimal": is_decimal, "float": is_float,
    "timestamp": is_timestamp, "date": is_date, "geography": is_geography, "date_range": is_date_range,
}


#: name -> bit of a mask, see :func:`mask`.
BITS = {name: 1 << at for at, name in enumerate((*PREDICATES, "naive", "point", "minus"))}


def mask(v: Column) -> Column:
    """All predicates on a text at once, as bits; the first character decides which of them are tried."""
    def bits(*names: str) -> Column:
        return F.lit(sum(BITS[n] for n in names))

    def where(holds: Column, name: str) -> Column:
        return F.when(F.coalesce(holds, F.lit(False)), BITS[name]).otherwise(0)

    # The plain forms come first, by simple patterns; a cast that fails costs an exception, so none is tried on what may not fit.
    day = v.rlike(r"^\d{4}-\d{2}-\d{2}\z") & v.try_cast("date").isNotNull() & ~v.startswith("0000")
    second = v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\z") & v.try_cast("timestamp_ntz").isNotNull() & ~v.startswith("0000")
    time = F.when(v.contains(":"), F.when(second | is_naive_timestamp(v), bits("naive")).otherwise(where(is_timestamp(v), "timestamp"))).when(day, bits("date")).otherwise(where(is_date(v), "date"))
    dated = (F.locate("-", v, 2) > 0) | v.contains("/")
    first = F.ascii(v)
    ascii_decimal = v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z")
    foreign = F.octet_length(v) != F.length(v)  # digits of other scripts count, so patterns that know them are tried
    number = (
        F.when(v.isin("0", "1"), bits("boolean", "zero_one", "integer", "decimal", "float"))
        .when(dated & ~v.contains("e") & ~v.contains("E"), time)
        .when(ascii_decimal | (foreign & is_decimal(v)), F.when(v.contains("."), bits("decimal", "float", "point")).otherwise(bits("integer", "decimal", "float")))
        .when((v.contains("_") | foreign) & is_integer(v), bits("integer", "float"))
        .when(is_float(v), bits("float"))
        .otherwise(0)
    )
    word = F.when(is_boolean(v), bits("boolean")).when((F.length(v) < 9) & is_float(v), bits("float")).when(v.contains("("), where(is_geography(v), "geography")).otherwise(0)
    found = F.when(first.between(43, 57) | (first >= 128), number).when(first.isin(40, 91), where(is_date_range(v), "date_range")).otherwise(word)
    return (found + where(v.startswith("-"), "minus")).cast("int")


def digits_of(v: Column) -> Column:
    """Digits before and after the point of a decimal text: struct(whole, fraction)."""
    clean = F.regexp_replace(v, r"^[+-]", "")
    return F.struct(F.length(F.split_part(clean, F.lit("."), F.lit(1))).alias("whole"), F.length(F.split_part(clean, F.lit("."), F.lit(2))).alias("fraction"))


def inferred_type(kept: Column, flag, any_naive: Column, any_point: Column) -> Column:
    """The first type that all kept values fit; ``flag(name)`` tells whether all do.

    A column with a timestamp without zone, that no earlier type fits, is NAIVE_TIMESTAMP.
    """
    return (
        F.when(kept == 0, "STRING")
        .when(flag("boolean"), F.when(flag("zero_one"), "INTEGER").otherwise("BOOLEAN"))
        .when(flag("integer"), "INTEGER")
        .when(flag("decimal"), F.when(any_point, "DECIMAL").otherwise("INTEGER"))
        .when(flag("float"), "FLOAT")
        .when(any_naive, "NAIVE_TIMESTAMP")
        .when(flag("timestamp"), "TIMESTAMP")
        .when(flag("date"), "DATE")
        .when(flag("geography"), "GEOGRAPHY")
        .when(flag("date_range"), "RANGE_DATE")
        .otherwise("STRING")
    )
