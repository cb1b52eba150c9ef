"""Classification of raw records, by native expressions over VARIANT.

A record's reason is the first rule that it breaks, or null where it is valid. A record is one JSON object with nothing but
JSON's white space (blank, tab, line feed, carriage return) around it. Read more strictly than by some parsers: NaN literals
and repeated keys are malformed too.

What several rules use (the parsed record, its fields, their kinds and numbers, the reason itself) is a column of its own, from a
generator of one row: no filter or projection is pushed below that, so each is computed once for a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import LEDGER_TYPES

LEDGER_FIELDS = ("step", "type", "amount", "nameOrig", "nameDest", "isFraud")
CARD_FIELDS = ("TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "isFraud", "card1")
_LEDGER_NUMBERS = ("step", "amount", "isFraud")
FIRST_STEP, LAST_STEP = 1, 743


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))


def _marked(raw: Column, mark: Column) -> Column:
    """The record as the first item of an array whose second, right after it, is the mark."""
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), mark, F.lit('"]')))


def _alone(raw: Column, mark: Column, whole: Column) -> Column:
    return F.when((F.try_variant_get(whole, "$[1]", "string") == mark) & raw.rlike(r"^[ \t\r\n]*\{"), F.try_variant_get(whole, "$[0]", "variant"))


def record_of(raw: Column) -> Column:
    """The record as a variant if it is one JSON object and nothing else, else null.

    The parser stops after a value. So the mark after the record is the record's own hash, which a record can't hold to end that array
    early. Parses twice, as a column refers to no other; see with_record."""
    mark = F.md5(raw.cast("binary"))
    return _alone(raw, mark, _marked(raw, mark))


def with_record(records: DataFrame) -> DataFrame:
    """key and value, and record_of the value (v), which is hashed and parsed once."""
    raw, mark, whole = F.col("value"), F.col("mark"), F.col("whole")
    d = _bound(records.select("key", "value"), "mark", F.md5(raw.cast("binary")))
    d = _bound(d, "whole", _marked(raw, mark))
    return _bound(d, "v", _alone(raw, mark, whole)).drop("mark", "whole")


def _with_fields(parsed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """`parsed` with the record's fields (f, variants), and their kinds (k)."""
    d = _bound(parsed, "f", F.struct(*(F.try_variant_get("v", f"$.{c}", "variant").alias(c) for c in names)))
    return _bound(d, "k", F.struct(*(F.schema_of_variant(F.col("f")[c]).alias(c) for c in names)))


def _f(name: str) -> Column:
    return F.col("f")[name]


def _kind(name: str) -> Column:
    return F.col("k")[name]


def _integer(name: str) -> Column:
    """Whether the field is written as a whole number, of any length; a variant has lost the point of 5.0, so the text tells."""
    digits = F.get_json_object("value", f"$.{name}").rlike(r"^-?\d+$")
    return F.when(_kind(name) == "BIGINT", True).when(_number(name), digits).otherwise(False)


def _number(name: str) -> Column:
    return (_kind(name) == "BIGINT") | (_kind(name) == "DOUBLE") | _kind(name).startswith("DECIMAL")


def _missing(name: str) -> Column:
    return _f(name).isNull() | (_kind(name) == "VOID")


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(x) <= 1.7976931348623157e308, x)


def ledger_reason(parsed: DataFrame) -> DataFrame:
    """`parsed` (with_record) with reason_code, and the fields read as the contract's (n), whole numbers as doubles. Types are those of
    JSON: 5.0 and 1e1 are no integers. An amount beyond the doubles is of a bad type."""
    string = lambda c: _kind(c) == "STRING"
    d = _bound(_with_fields(parsed, LEDGER_FIELDS), "n", F.struct(*(_as(_f(c), "double" if c in _LEDGER_NUMBERS else "string").alias(c) for c in LEDGER_FIELDS)))
    n = F.col("n")
    amount = _finite(n["amount"])
    reason = (
        F.when(F.col("v").isNull(), "MALFORMED_JSON")
        .when(_any([_missing(c) for c in LEDGER_FIELDS]), "MISSING_FIELD")
        .when(~_integer("step"), "BAD_STEP_TYPE")
        .when(~string("type") | ~F.coalesce(n["type"].isin(*LEDGER_TYPES), F.lit(False)), "BAD_TYPE")
        .when(~_number("amount") | amount.isNull() | ~string("nameOrig") | ~string("nameDest") | ~_integer("isFraud"), "BAD_FIELD_TYPE")
        .when(amount < 0, "NEGATIVE_AMOUNT")
        .when(~n["step"].between(FIRST_STEP, LAST_STEP), "INVALID_STEP")
        .when(~n["isFraud"].isin(0.0, 1.0), "INVALID_LABEL")
    )
    return _bound(d, "reason_code", reason)


def _text(name: str) -> Column:
    """A string that may be a number: without white space around it and underscores between digits."""
    return F.regexp_replace(F.regexp_replace(_as(_f(name), "string"), r"^\s+|\s+$", ""), r"(?<=\d)_(?=\d)", "")


def _read(name: str, written: str) -> Column:
    """The field as a double: a number, a string that is `written` as one, or a boolean, of which true is 1. Null: none of these."""
    text = _text(name)
    return F.when(_number(name), _as(_f(name), "double")).when(_kind(name) == "STRING", F.when(text.rlike(written), text.try_cast("double"))).when(_kind(name) == "BOOLEAN", _as(_f(name), "boolean").cast("int").cast("double"))


_WHOLE, _REAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _whole(number: Column) -> Column:
    """A number without its fraction, null where it isn't finite."""
    # Beyond 2^53 a double has no fraction.
    return F.when(F.abs(number) < 2.0**53, F.signum(number) * F.floor(F.abs(number))).otherwise(_finite(number))


#: The least and greatest number that the contract's integers hold.
_LOW, _HIGH = -(2.0**31), 2.0**31 - 1
_CARD_INTS = ("TransactionID", "TransactionDT", "isFraud", "card1")


def _held(x: Column) -> Column:
    """As the contract's integer, null where that can't hold it."""
    return F.when(x.between(_LOW, _HIGH), x).try_cast("int")


def card_reason(parsed: DataFrame) -> DataFrame:
    """`parsed` with reason_code, and the card's numbers (n) as doubles, null where a field is none. Numbers may be strings here,
    and fractions are cut, as the fields' own conversions (card_fields) do. A key or clock that the row can't hold, and an amount that
    isn't finite, are of a bad type."""
    kinds = dict.fromkeys(_CARD_INTS, _WHOLE) | {"TransactionAmt": _REAL}
    d = _bound(_with_fields(parsed, CARD_FIELDS), "read", F.struct(*(_read(c, w).alias(c) for c, w in kinds.items())))
    d = _bound(d, "n", F.struct(*((_whole if c in _CARD_INTS else _finite)(F.col("read")[c]).alias(c) for c in kinds)))
    n = F.col("n")
    bad = [*(n[c].isNull() for c in ("isFraud", "TransactionDT", "TransactionAmt")), n["TransactionDT"] > _HIGH, *(_held(n[c]).isNull() for c in ("TransactionID", "card1")), _kind("ProductCD") != "STRING"]
    reason = (
        F.when(F.col("v").isNull(), "MALFORMED_JSON")
        .when(_any([_missing(c) for c in CARD_FIELDS]), "MISSING_FIELD")
        .when(_any(bad), "BAD_FIELD_TYPE")
        .when(n["TransactionAmt"] < 0, "NEGATIVE_AMOUNT")
        .when(~n["isFraud"].isin(0.0, 1.0), "INVALID_LABEL")
        .when(n["TransactionDT"] <= 0, "INVALID_TRANSACTIONDT")
    )
    return _bound(d, "reason_code", reason)


def ledger_fields() -> Column:
    """The judged fields of a valid record in the contract's types, by the conversions that judged them."""
    # Steps and labels are small whole numbers by now, so a double holds them.
    return F.struct(*((F.col("n")[c].try_cast("int") if c in ("step", "isFraud") else F.col("n")[c]).alias(c) for c in LEDGER_FIELDS))


def card_fields() -> Column:
    """The judged fields of a valid record in the contract's types, by the conversions that judged them."""
    n = F.col("n")
    made = {c: _held(n[c]) for c in _CARD_INTS} | {"ProductCD": _as(_f("ProductCD"), "string"), "TransactionAmt": n["TransactionAmt"]}
    return F.struct(*(made[c].alias(c) for c in CARD_FIELDS))


def classify(records: DataFrame, reason, fields=None) -> DataFrame:
    """key, value and reason_code (null: valid) of each record; with `fields` also judged, a struct of its fields (null: invalid).

    No record makes it fail."""
    done = reason(with_record(records))
    judged = [F.when(F.col("reason_code").isNull(), fields()).alias("judged")] if fields else []
    return done.select("key", "value", "reason_code", *judged)


def dead_letters(classified: DataFrame) -> DataFrame:
    """key and value of the dead-letter records of the invalid ones: raw_value, reason_code, ingested_at (ISO-8601, UTC)."""
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    body = F.struct(F.col("value").alias("raw_value"), "reason_code", at.alias("ingested_at"))
    return classified.where("reason_code is not null").select("key", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
