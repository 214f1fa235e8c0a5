"""Semantic types, validation, conservative repair: Column to Column.

``checked`` gives struct(valid, value, note); ``assess`` adds what stands for
nothing and the repair of letters read for digits, which is taken only where
it turns an invalid value into a valid one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formspark.functions import rules
from formspark.functions.text import let


def _strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def infer_type(label: Column, grid_hint: Column | None = None) -> Column:
    """The type that a label, or date letters printed in its cells, ask for."""
    raw = F.lower(F.coalesce(label, F.lit("")))
    bare = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s*\([^)]*\)", " "))
    found = F.lit("text")
    for pattern, kind in reversed(rules.TYPE_RULES):
        found = F.when(bare.rlike(pattern), kind).otherwise(found)
    found = F.when(bare.rlike(rules.DESCRIPTIVE) | raw.rlike(rules.DESCRIPTIVE), "text").otherwise(found)
    return F.when(F.upper(grid_hint).rlike("^[DMY]{6,}$"), "date").otherwise(found) if grid_hint is not None else found


def _verdict(valid: Column, value: Column, otherwise: Column, note: Column, also: Column | None = None) -> Column:
    good = also if also is not None else F.lit("")
    return let(F.coalesce(valid, F.lit(False)), lambda ok: F.struct(ok.alias("valid"), F.when(ok, value).otherwise(otherwise).alias("value"), F.when(ok, good).otherwise(note).alias("note")))


def check_date(v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    day = F.try_to_timestamp(F.when(F.length(digits) == 8, digits), F.lit("ddMMyyyy"))
    return _verdict(F.year(day).between(1900, 2100), digits, v, F.lit("not a valid DDMMYYYY date"))


def check_cnic(v: Column) -> Column:
    bare = F.regexp_replace(v, r"\s", "")
    shape = "^([0-9]{5})-?([0-9]{7})-?([0-9])$"
    fits = bare.rlike(shape)
    norm = F.regexp_replace(bare, shape, "$1-$2-$3")
    head = F.substring(norm, 1, 1)
    issued = head.between("1", "8")
    return _verdict(fits & issued, norm, F.when(fits, norm).otherwise(v), F.when(fits, F.concat(F.lit("CNIC starts with "), head, F.lit(", not an issuing region"))).otherwise("expected 13 digits as XXXXX-XXXXXXX-X"))


def check_iban(v: Column, bank: str = rules.BANK_CODE) -> Column:
    bare = F.upper(F.regexp_replace(v, r"[\s-]", ""))
    fits = bare.rlike("^PK[0-9]{2}[A-Z]{4}[A-Z0-9]{16}$")
    has = F.substring(bare, 5, 4)
    note = F.when(fits, F.concat(F.lit("bank code is "), has, F.lit(f", expected {bank}"))).otherwise("expected PK + 2 digits + 4 letters + 16 alphanumerics (24)")
    return _verdict(fits & (has == bank), bare, F.when(fits, bare).otherwise(v), note)


def check_ntn(v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    return _verdict(F.length(digits).isin(7, 8, 13), digits, v, F.lit("expected 7 digits (NTN), 8 with a check digit, or 13 (CNIC)"))


def check_email(v: Column) -> Column:
    bare = F.regexp_replace(v, r"\s", "")
    return _verdict(bare.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), bare, v, F.lit("not a valid e-mail address"))


def _number(v: Column) -> Column:
    """Digits of a telephone number, the country code as the leading 0."""
    return F.regexp_replace(F.regexp_replace(v, "[^0-9+]", ""), r"^\+?92", "0")


def phone_class(n: Column) -> Column:
    """struct(valid, value, note) of a number's digits; area codes of four digits go before those of three."""
    area = F.create_map(*[F.lit(x) for pair in rules.AREAS.items() for x in pair])
    named = lambda k: F.struct(F.substring(n, 1, k).alias("code"), F.try_element_at(area, F.substring(n, 1, k)).alias("city"))

    def verdict(found: Column) -> Column:
        size, code = F.length(n), found["code"]
        mobile, known = F.startswith(n, F.lit("03")), found["city"].isNotNull()
        wanted = F.when(code.isin(rules.LONG_AREAS), 8).otherwise(7)
        fits = F.when(mobile, n.rlike("^03[0-5][0-9]{8}$")).when(~F.startswith(n, F.lit("0")), False).when(known, size - F.length(code) == wanted).otherwise(size.between(10, 11))
        cut = F.when(mobile, 4).when(known, F.length(code)).otherwise(3)
        note = (
            F.when(mobile & (size != 11), F.format_string("a mobile number has 11 digits as 03XX-XXXXXXX (got %d)", size))
            .when(mobile, F.concat(F.substring(n, 1, 4), F.lit(" is no mobile prefix (0300-0349, and 0355)")))
            .when(~F.startswith(n, F.lit("0")), "a number starts with 0 (03 mobile, or a city code such as 021)")
            .when(known, F.concat(code, F.lit(" ("), found["city"], F.format_string(") has %d-digit numbers, so expected %d digits, got %d", wanted, F.length(code) + wanted, size)))
            .otherwise("expected 10-11 digits for a landline, or 11 for a mobile")
        )
        return _verdict(fits, F.concat_ws("-", n.substr(F.lit(1), cut), n.substr(cut + 1, size)), n, note)

    return let(F.array(named(4), named(3)), lambda both: let(F.when(both[0]["city"].isNotNull(), both[0]).otherwise(both[1]), verdict))


def check_phone(v: Column) -> Column:
    return let(let(_number(v), phone_class), lambda found: _verdict(found["valid"], found["value"], v, found["note"]))


def check_mobile(v: Column) -> Column:
    def verdict(n: Column, found: Column) -> Column:
        other = F.concat(F.lit("a mobile number has 11 digits starting 03 (got "), F.length(n).cast("string"), F.lit(" digits starting "), F.substring(n, 1, 3), F.lit(")"))
        return _verdict(found["valid"] & F.startswith(n, F.lit("03")), found["value"], v, F.coalesce(F.nullif(found["note"], F.lit("")), other))

    return let(_number(v), lambda n: let(phone_class(n), lambda found: verdict(n, found)))


def check_postcode(v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    return _verdict(F.length(digits) == 5, digits, v, F.format_string("a postal code has 5 digits (got %d)", F.length(digits)))


def check_passport(v: Column) -> Column:
    bare = F.upper(F.regexp_replace(v, r"[\s-]", ""))
    usual = bare.rlike("^[A-Z]{2}[0-9]{7}$")
    return _verdict(bare.rlike("^[A-Z0-9]{7,9}$"), bare, v, F.lit("expected 2 letters then 7 digits"), F.when(usual, "").otherwise("not the usual 2 letters + 7 digits of a passport"))


def check_amount(v: Column) -> Column:
    bare = F.rtrim(F.regexp_replace(v, r"(?i)[,\s/]|pkr|rs\.?", ""), F.lit("-"))
    return _verdict(bare.rlike(r"^[0-9]+(\.[0-9]{1,2})?$"), bare, v, F.lit("expected a number"))


def check_digits(v: Column) -> Column:
    bare = F.regexp_replace(v, r"[\s-]", "")
    return _verdict(bare.rlike("^[0-9]+$"), bare, v, F.lit("expected digits only"))


def check_name(v: Column) -> Column:
    return _verdict(v.rlike(r"^[A-Za-z][A-Za-z .'’/-]{0,60}$"), F.regexp_replace(v, r"\s+", " "), v, F.lit("unexpected characters for a name"))


def check_text(v: Column) -> Column:
    return _verdict(F.lit(True), F.regexp_replace(v, r"\s+", " "), v, F.lit(""))


CHECKS = {
    "date": check_date, "cnic": check_cnic, "iban": check_iban, "ntn": check_ntn, "email": check_email, "mobile": check_mobile,
    "phone": check_phone, "postcode": check_postcode, "passport": check_passport, "amount": check_amount, "integer": check_digits,
    "digits": check_digits, "account": check_digits, "name": check_name,
}


def checked(value: Column, kind: Column | str) -> Column:
    """struct(valid, value, note) of a value that isn't empty, by its type; a type known beforehand is a str."""
    if isinstance(kind, str):
        return let(_strip(value), CHECKS.get(kind, check_text))

    def choose(v: Column) -> Column:
        out = check_text(v)
        for name, check in CHECKS.items():
            out = F.when(kind == name, check(v)).otherwise(out)
        return out

    return let(_strip(value), choose)


def repaired(value: Column) -> Column:
    """Letter shapes as the digits they are taken for."""
    return F.translate(value, rules.LETTERS, rules.DIGITS)


def assess(value: Column, kind: Column | str) -> Column:
    """struct(type, value, valid, empty, explicit_none, note, raw) of one reading."""
    name = F.lit(kind) if isinstance(kind, str) else kind

    def verdict(x: Column, first: Column, second: Column) -> Column:
        explicit = x["token"].isin(rules.NONE_MARKERS)
        empty = explicit | x["token"].isin(rules.SENTINELS)
        mends = ~first["valid"] & name.isin(rules.NUMERIC_TYPES) & (x["fixed"] != x["body"]) & second["valid"]
        note = (
            F.when(explicit, F.concat(F.lit("written as '"), x["core"], F.lit("'")))
            .when(empty, "")
            .when(mends, F.concat(F.lit("repaired letter/digit confusion: '"), x["body"], F.lit("' -> '"), second["value"], F.lit("'")))
            .otherwise(first["note"])
        )
        return F.struct(
            name.alias("type"),
            F.when(~empty, F.when(mends, second["value"]).otherwise(first["value"])).alias("value"),
            (empty | first["valid"] | mends).alias("valid"),
            empty.alias("empty"),
            explicit.alias("explicit_none"),
            note.alias("note"),
            x["raw"].alias("raw"),
        )

    def parts(raw: Column) -> Column:
        core = F.btrim(raw, F.lit(rules.CORE_TRIM))
        body = F.ltrim(raw, F.lit(rules.LEAD_TRIM))
        return F.struct(raw.alias("raw"), core.alias("core"), F.lower(core).alias("token"), body.alias("body"), repaired(body).alias("fixed"))

    raw = _strip(F.coalesce(value, F.lit("")))
    return let(let(raw, parts), lambda x: let(checked(x["body"], kind), lambda first: let(checked(x["fixed"], kind), lambda second: verdict(x, first, second))))
