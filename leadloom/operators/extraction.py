"""From a model's raw answer to a checked record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: The fields of an answer and the kinds that its values may have.
FIELDS = {"is_order": "boolean", "direction": "string", "from_code": "string", "to_code": "string", "urgency": "string", "contact_kind": "string", "contact": "string", "price": "double", "confidence": "int"}
SCHEMA = ", ".join(f"{name} string" for name in FIELDS)
DIRECTIONS, URGENCIES, CONTACTS = ["demand", "offer", "unclear"], ["now", "today", "later", "none"], ["phone", "message", "none"]
#: Shapes of postcodes by country: 5 formats.
CODE_SHAPES = {"PL": r"^\d{2}-\d{3}$", "CZ_SK": r"^\d{3} \d{2}$", "DE": r"^\d{5}$", "AT_BE": r"^\d{4}$", "NL": r"^\d{4} ?[A-Z]{2}$"}


def code_normal(code: Column) -> Column:
    """Upper case, without blanks, dots and hyphens."""
    return F.upper(F.regexp_replace(code, r"[\s.-]", ""))


def code_ok(code: Column) -> Column:
    found = F.trim(F.upper(code))
    out = F.lit(False)
    for shape in CODE_SHAPES.values():
        out = out | found.rlike(shape)
    return F.when(out, code_normal(found))


def countries_by_shape(code: Column) -> Column:
    """Countries that a code with a separator suggests; none without one."""
    found = F.trim(F.upper(code))
    return F.when(found.rlike(r"[\s-]"), F.array_compact(F.array(*(F.when(found.rlike(shape), F.lit(country)) for country, shape in CODE_SHAPES.items())))).otherwise(F.array().cast("array<string>"))


def phone_ok(value: Column) -> Column:
    """Digits of a phone number of 9 to 15 digits, else null."""
    digits = tx.phone_normal(F.regexp_replace(value, r"\D", ""))
    return F.when(F.length(digits).between(9, 15), digits)


def contact(kind: Column, value: Column) -> Column:
    """kind and value; a phone without a valid number is no contact."""
    kind = tx.clamp_enum(kind, CONTACTS, "none")
    number = phone_ok(value)
    return F.when((kind == "phone") & number.isNull(), F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("value"))).otherwise(F.struct(kind.alias("kind"), F.when(kind == "phone", number).otherwise(tx.text_or_null(value)).alias("value")))


def parsed(answer: Column) -> Column:
    return F.from_json(tx.lenient_json(answer), SCHEMA)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: a field of a parsed object would parse it again, each by itself."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def record(answer: Column) -> Column:
    """The checked record of an answer; an offer is never an order; an answer without an object gives the defaults."""
    return bound(parsed(answer), _checked)


def _checked(raw: Column) -> Column:
    direction = tx.clamp_enum(F.coalesce(raw["direction"], F.lit("")), DIRECTIONS, "unclear")
    return F.struct(
        (tx.as_bool(F.coalesce(raw["is_order"], F.lit(""))) & (direction != "offer")).alias("is_order"),
        direction.alias("direction"),
        code_ok(raw["from_code"]).alias("from_code"),
        code_ok(raw["to_code"]).alias("to_code"),
        tx.clamp_enum(F.coalesce(raw["urgency"], F.lit("")), URGENCIES, "none").alias("urgency"),
        contact(F.coalesce(raw["contact_kind"], F.lit("")), raw["contact"]).alias("contact"),
        tx.price(raw["price"]).alias("price"),
        tx.confidence(raw["confidence"]).alias("confidence"),
    )


def with_fallback_codes(rec: Column, text: Column) -> Column:
    """Empty codes are filled from the text, in its order, with codes that are not used yet."""
    return bound(F.struct(rec.alias("rec"), text.alias("text")), lambda x: _filled(x["rec"], x["text"]))


def _filled(rec: Column, text: Column) -> Column:
    found = F.filter(tx.postcodes(text), lambda c: ~F.coalesce(c == rec["from_code"], F.lit(False)) & ~F.coalesce(c == rec["to_code"], F.lit(False)))

    def codes(spare: Column) -> Column:
        from_code = F.coalesce(rec["from_code"], F.get(spare, F.lit(0)))
        to_code = F.coalesce(rec["to_code"], F.get(spare, F.when(rec["from_code"].isNull(), 1).otherwise(0)))
        return rec.withField("from_code", from_code).withField("to_code", to_code)

    return bound(found, codes)


def deviations(answer: Column) -> Column:
    """How a raw answer departs from the schema: fields missing, fields unknown, and values of another kind; null without an object."""
    both = bound(tx.lenient_json(answer), lambda x: F.struct(F.json_object_keys(x).alias("keys"), F.from_json(x, SCHEMA).alias("raw")))
    return bound(both, lambda x: _departures(x["keys"], x["raw"]))


def _departures(keys: Column, raw: Column) -> Column:
    missing = F.transform(F.array_except(F.array(*map(F.lit, FIELDS)), keys), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, FIELDS))), lambda k: F.concat(F.lit("unknown:"), k))
    wrong = F.array_compact(F.array(*(F.when(raw[name].isNotNull() & raw[name].try_cast(kind).isNull(), F.lit(f"kind:{name}")) for name, kind in FIELDS.items() if kind != "string")))
    return F.array_sort(F.concat(missing, unknown, wrong))


def worth_waking(rec: Column) -> Column:
    """An urgent, sure order with a way to answer it."""
    return rec["is_order"] & rec["urgency"].isin("now", "today") & (rec["confidence"] >= 60) & (rec["contact"]["kind"] != "none")


def answered(rows: DataFrame, text: str, answer: str) -> DataFrame:
    """Adds ``record``: an empty text gives the defaults whatever the answer says; else parse, check and fill."""
    said = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.col(answer))
    return rows.withColumn("record", with_fallback_codes(record(F.coalesce(said, F.lit(""))), F.coalesce(F.col(text), F.lit(""))))
