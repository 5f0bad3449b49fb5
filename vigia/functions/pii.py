"""Personal-data patterns, validators and redaction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigia import fixed
from vigia.functions.text import let, quick, regexp_map

# Python-style matching: any case, Unicode word boundaries and classes.
_ANY_CASE = "(?iU)"
_DNI = quick(fixed.DNI, _ANY_CASE)
_CARD = r"(?=[0-9])(?U)" + fixed.CARD
_EMAIL = r"(?=[A-Za-z0-9])" + _ANY_CASE + fixed.EMAIL
_PHONE = r"(?=[+36789])(?U)" + fixed.PHONE
_AMOUNT = r"(?=[0-9])" + _ANY_CASE + fixed.AMOUNT
_OTP = quick(fixed.OTP, _ANY_CASE)
URL = quick(fixed.URL, _ANY_CASE)
_IBAN = r"(?=[A-Za-z]{2}(?U:\s?\d))" + _ANY_CASE + r"\b(?:" + "|".join(
    rf"(?:{'|'.join(c for c, n in fixed.IBAN_LENGTHS.items() if n == length)})\s?\d{{2}}(?:[\s-]?[A-Z0-9]){{{length - 4}}}"
    for length in sorted(set(fixed.IBAN_LENGTHS.values()))
) + r")\b"
# What every account number holds, looked for by its digits, which are rare
_MAYBE_IBAN = (rf"(?U)\d\d(?<=(?:{'|'.join(f'[{c[0]}{c[0].lower()}][{c[1]}{c[1].lower()}]' for c in fixed.IBAN_LENGTHS)})"
               r"\s?\d\d)(?:[\s-]?[\w]){11}")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def compact_iban(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"(?U)[\s-]", ""))


def valid_iban(value: Column) -> Column:
    """Shape, length and mod-97 check, digit by digit (no big integers)."""
    def check(compact: Column) -> Column:
        turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
        remainder = F.aggregate(
            F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0),
            lambda left, c: F.pmod(
                left * F.when(c.rlike("[0-9]"), 10).otherwise(100)
                + F.conv(c, 36, 10).cast("int"), F.lit(97)),
        )
        shaped = compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") \
            & F.char_length(compact).between(15, 34)
        return F.when(shaped, remainder == 1).otherwise(F.lit(False))

    return let(compact_iban(value), check)


def valid_card(value: Column) -> Column:
    return let(F.regexp_replace(value, "[ -]", ""), lambda digits: F.when(
        digits.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", digits)
    ).otherwise(F.lit(False)))


def valid_ibans(text: Column) -> Column:
    """Distinct valid account numbers in order of appearance."""
    return F.array_distinct(F.transform(F.filter(_all(text, _IBAN), valid_iban), compact_iban))


def phones(text: Column) -> Column:
    return _all(text, _PHONE)


def _form_encode(value: Column) -> Column:
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _form_decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))


def redact_url(url: Column) -> Column:
    """Keep the address, hide the values of sensitive query keys, drop the fragment."""
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?s:#.*)?$"
    has_scheme = url.contains("://")
    full = F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))

    def clean(pair: Column) -> Column:
        at = F.instr(pair, "=")
        key = _form_decode(F.when(at > 0, F.substring(pair, F.lit(1), at - 1)).otherwise(pair))
        value = _form_decode(
            F.when(at > 0, F.substring(pair, at + 1, F.char_length(pair))).otherwise(F.lit("")))
        shown = F.when(F.lower(key).isin(*fixed.SENSITIVE_QUERY_KEYS), F.lit("[DATO]"))
        return F.concat(_form_encode(key), F.lit("="), _form_encode(F.coalesce(shown, value)))

    def rebuild(link: Column) -> Column:
        scheme, netloc, path, query = (F.regexp_extract(link, shape, i) for i in (1, 2, 3, 4))
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        return F.concat(
            F.when(scheme != "", F.concat(F.lower(scheme), F.lit("://"), netloc))
            .otherwise(F.lit("")),
            path,
            let(F.array_join(F.transform(pairs, clean), "&"), lambda cleaned: F.when(
                cleaned != "", F.concat(F.lit("?"), cleaned)).otherwise(F.lit(""))),
        )

    rebuilt = let(full, rebuild)
    return F.when(has_scheme, rebuilt).otherwise(F.regexp_replace(rebuilt, "^https://", ""))


def redact(text: Column) -> Column:
    """Hide personal data. The order of the steps matters: links, accounts, codes, identity
    numbers, cards, addresses, phones, amounts."""
    view = regexp_map(text, URL, redact_url)
    view = let(view, lambda v: F.when(v.rlike(_MAYBE_IBAN), regexp_map(
        v, _IBAN, lambda m: F.when(valid_iban(m), F.lit("[IBAN]")).otherwise(m))).otherwise(v))
    view = F.regexp_replace(view, _OTP, "[CÓDIGO]")
    view = F.regexp_replace(view, _DNI, "[DNI]")
    view = regexp_map(view, _CARD, lambda m: F.when(valid_card(m), F.lit("[TARJETA]")).otherwise(m))
    view = let(view, lambda v: F.when(
        v.contains("@"), F.regexp_replace(v, _EMAIL, "[EMAIL]")).otherwise(v))
    view = F.regexp_replace(view, _PHONE, "[TELÉFONO]")
    return F.regexp_replace(view, _AMOUNT, "[IMPORTE]")


def model_text(text: Column) -> Column:
    """Redacted text in which every link is only marked as present."""
    return F.regexp_replace(redact(text), URL, "[ENLACE]")


def sensitive_types(text: Column) -> Column:
    """Kinds of personal data present."""
    return F.array_compact(F.array(
        F.when(text.rlike(_MAYBE_IBAN) & F.exists(_all(text, _IBAN), valid_iban), "iban"),
        F.when(text.rlike(_DNI), "dni"),
        F.when(F.exists(_all(text, _CARD), valid_card), "tarjeta"),
        F.when(text.contains("@") & text.rlike(_EMAIL), "email"),
        F.when(text.rlike(_PHONE), "telefono"),
    ))


_JSON_STRING = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def redact_json(value: Column) -> Column:
    """Redact every string value at any depth of a JSON text; keys stay as they are."""
    def clean(literal: Column) -> Column:
        inner = F.from_json(F.concat(F.lit('{"v":'), literal, F.lit("}")), "v string")["v"]
        again = F.to_json(F.struct(redact(inner).alias("v")))
        # a string that a colon follows is a key: the whole match stays, and the search goes on behind it
        return F.when(literal.endswith(":"), literal).otherwise(
            F.coalesce(F.regexp_extract(again, r'^\{"v":((?s).*)\}$', 1), literal))

    return regexp_map(value, _JSON_STRING, clean)
