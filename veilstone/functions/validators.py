"""Checks and normal forms of identifiers, as column expressions.

Everything stays in the JVM, except NFC (Spark has no Unicode normalisation), which is
an Arrow UDF and only reached by the categories that need it.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Geographic, mobile, data and freephone area codes of the public Turkish numbering plan.
TR_AREA_CODES = (
    "212", "216", "222", "224", "226", "228", "232", "236", "242", "246", "248", "252", "256", "258", "262", "264", "266", "272", "274", "276",
    "282", "284", "286", "288", "312", "318", "322", "324", "326", "328", "332", "338", "342", "344", "346", "348", "352", "354", "356", "358",
    "362", "364", "366", "368", "370", "372", "374", "376", "378", "380", "382", "384", "386", "388", "392", "412", "414", "416", "422", "424",
    "426", "428", "432", "434", "436", "438", "442", "446", "452", "454", "456", "458", "462", "464", "466", "472", "474", "476", "478", "482",
    "484", "486", "488", "501", "505", "506", "507", "510", "516", "530", "531", "532", "533", "534", "535", "536", "537", "538", "539", "540", "541", "542",
    "543", "544", "545", "546", "547", "548", "549", "551", "552", "553", "554", "555", "559", "561",
    "570", "571", "572", "573", "574", "575", "800", "850",
)

#: The inside of a class of all white space: Java's own is ASCII only, so a number pasted with no-break spaces needs them spelled out.
WHITE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

#: Categories, with their placeholder prefix and their rank in ties. Literals and rules are unranked (last).
CATEGORIES = {
    "email": "EMAIL", "iban": "IBAN", "national_id": "NATIONAL_ID", "card": "CARD", "phone": "PHONE",
    "document_number": "DOCUMENT", "person": "PERSON", "organization": "ORGANIZATION", "location": "LOCATION", "custom": "CUSTOM",
}
RANK = {c: i for i, c in enumerate(CATEGORIES)}
NUMERIC_CATEGORIES = ("national_id", "card")


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _digit(x: Column, place: int) -> Column:
    return F.substring(x, place, 1).cast("int")


def all_equal(x: Column) -> Column:
    return F.length(F.replace(x, F.substring(x, 1, 1), F.lit(""))) == 0


def national_id_valid(x: Column) -> Column:
    """Eleven digits, the first not zero, not all equal, with both check digits of the published rule."""
    shaped = x.rlike("^[1-9][0-9]{10}$") & ~all_equal(x)
    odd = sum((_digit(x, i) for i in (1, 3, 5, 7, 9)), F.lit(0))
    even = sum((_digit(x, i) for i in (2, 4, 6, 8)), F.lit(0))
    tenth = (odd * 7 - even) % 10
    eleventh = (odd + even + _digit(x, 10)) % 10
    return F.coalesce(F.when(shaped, (tenth == _digit(x, 10)) & (eleventh == _digit(x, 11))), F.lit(False))


def card_valid(x: Column) -> Column:
    """13 to 19 digits that pass Luhn and are not all equal."""
    d = digits_only(x)
    shaped = d.rlike("^[0-9]{13,19}$") & ~all_equal(d)
    return F.coalesce(F.when(shaped, F.call_function("luhn_check", d)), F.lit(False))


def iban_valid(x: Column) -> Column:
    """15 to 34 characters of country, check digits and account, whose number modulo 97 is 1."""
    iban = F.upper(F.regexp_replace(x, f"[{WHITE}]", ""))
    turned = F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return F.coalesce(F.when(iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1), F.lit(False))


def phone_national(x: Column) -> Column:
    """The ten national digits, after an international or trunk prefix; null where the length doesn't fit."""
    d = F.regexp_replace(digits_only(x), "^00", "")
    d = F.when((F.length(d) == 12) & d.startswith("90"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def phone_valid(x: Column) -> Column:
    return F.coalesce(F.substring(phone_national(x), 1, 3).isin(*TR_AREA_CODES), F.lit(False))


@F.arrow_udf(StringType())
def nfc(x: pa.Array) -> pa.Array:
    """Unicode NFC; Spark has no function for it."""
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in x.to_pylist()], pa.string())


def lower_tr(x: Column) -> Column:
    """Lower case by Turkish rules."""
    return F.lower(F.translate(x, "Iİ", "ıi"))


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"[\s\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]+", " "))


def normalized(category: Column, raw: Column) -> Column:
    """The form under which values of a category are the same value."""
    name = lower_tr(collapse(nfc(raw)))
    return (
        F.when(category == "email", F.lower(nfc(raw)))
        .when(category == "iban", F.upper(F.regexp_replace(raw, f"[{WHITE}]", "")))
        .when(category.isin(*NUMERIC_CATEGORIES), digits_only(raw))
        .when(category == "phone", F.concat(F.lit("+90"), F.coalesce(phone_national(raw), digits_only(raw))))
        .when(category.isin("person", "organization", "location", "document_number"), name)
        .otherwise(raw)
    )
