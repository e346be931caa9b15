"""Operator 3: format-preserving Feistel pseudonyms, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, set_aside

KEY = "arbora-demo-key"
ROUNDS = 8
#: Spans of the calendar from 0001-01-01 to 9999-12-31, as (first day, number of days); a day is permuted within its span.
FIRST_DAY = "0001-01-01"
SPANS = ((0, 693595), (693595, 73049), (766644, 2885415))  # to 1899, 1900 to 2099, from 2100 on

# Fixed patterns. Cards are 13 to 19 digits at a stretch, or in the usual groups; all are validated before anything is changed.
CARD = r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![A-Za-z0-9])"
PHONE = r"(?<![A-Za-z0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9])"
PLUS_PHONE = r"\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"
ADDRESS = r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[A-Za-z0-9])"
DATE = r"(?<![A-Za-z0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9-])"
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
#: One pass finds them all; the groups behind back references count from the left. The look-ahead spares most places the list.
ANY = f"(?=[0-9+(])(?:{CARD}|{PLUS_PHONE}|{PHONE}|{ADDRESS}|{DATE})|{MAIL}"
#: Every token holds one of these: four digits in a row, two points among digits, or an @. Other texts skip the search.
HINT = r"[0-9](?:[0-9]{3}|[0-9]{0,2}\.[0-9]{1,3}\.)|@"

LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Symbols permuted by alternating Feistel rounds: each half in turn is shifted, symbol by symbol and modulo its radix,
    by keyed hashes of the other half. A bijection of the symbols for every length and mix of radices."""

    def shifted(own: Column, radix: Column, other: Column, n: Column) -> Column:
        def by(seed: Column) -> Column:
            moved = F.transform(own, lambda v, i: v + F.conv(F.substring(F.sha2(F.concat(seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long"))
            return F.zip_with(moved, radix, lambda v, r: F.pmod(v, r))

        return _let(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), F.concat_ws(",", other.cast("array<string>")), F.lit("")), by)

    def rounds(s: Column) -> Column:
        def one(state: Column, n: Column) -> Column:
            even = n % 2 == 0
            l, r = state.getField("l"), state.getField("r")
            return F.struct(
                F.when(even, shifted(l, s.getField("a"), r, n)).otherwise(l).alias("l"), F.when(~even, shifted(r, s.getField("b"), l, n)).otherwise(r).alias("r")
            )

        start = F.struct(s.getField("l").alias("l"), s.getField("r").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda x: F.concat(x.getField("l"), x.getField("r")))

    def halves(v: Column, x: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        return F.struct(
            F.slice(v, 1, half).alias("l"), F.slice(v, half + 1, F.size(v) - half).alias("r"), F.slice(x, 1, half).alias("a"), F.slice(x, half + 1, F.size(x) - half).alias("b")
        )

    return _let(F.struct(values.alias("v"), radices.alias("x")), lambda t: _let(halves(t.getField("v"), t.getField("x")), rounds))


def _same(n: Column, radix: int) -> Column:
    return F.transform(n, lambda _: F.lit(radix).cast("long"))


def _digits(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("long"))


def _put(token: Column, digits: Column) -> Column:
    """token with its digits replaced, in order; everything else stays in place."""

    def filled(d: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(token, ""),
                lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(d, F.length(F.regexp_replace(F.substring(token, F.lit(1), i + 1), "[^0-9]", ""))).cast("string")).otherwise(c),
            ),
            "",
        )

    return _let(digits, filled)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, of which the last is the check digit."""

    def total(d: Column) -> Column:
        doubled = F.transform(d, lambda x, i: F.when((F.size(d) - i) % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
        return F.aggregate(doubled, F.lit(0).cast("long"), lambda t, x: t + x)

    return _let(digits, total)


def card_pseudonym(token: Column, key: str = KEY) -> Column:
    """A card number that passes the Luhn check -> another that does; null for any other token."""

    def of(digits: Column) -> Column:
        body = F.slice(digits, 1, F.size(digits) - 1)
        new = _let(
            _feistel(body, _same(body, 10), key, "card"),
            lambda x: F.concat(x, F.array(F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(x, F.array(F.lit(0).cast("long")))), F.lit(10)), F.lit(10)).cast("long"))),
        )
        return F.when(_luhn(digits) % 10 == 0, _put(token, new))

    return _let(_digits(token), of)


def phone_pseudonym(token: Column, key: str = KEY) -> Column:
    """The ten national digits are permuted; a leading 1 stays.

    Area and exchange codes begin with 2 to 9 in every North American number, and so they do in its pseudonym. A number in
    telephone notation whose area or exchange code begins with 0 or 1 can't be called, but may be somebody's misprint: it
    is replaced too, and that digit stays 0 or 1. So each kind is permuted within itself.
    """

    def lead(i: Column) -> Column:
        return (i == 0) | (i == 3)

    def of(digits: Column) -> Column:
        own = F.slice(digits, F.size(digits) - 9, 10)
        radix = F.transform(own, lambda d, i: F.when(~lead(i), 10).when(d >= 2, 8).otherwise(2).cast("long"))
        base = F.transform(own, lambda d, i: F.when(lead(i) & (d >= 2), 2).otherwise(0).cast("long"))
        moved = F.zip_with(_feistel(F.zip_with(own, base, lambda d, b: d - b), radix, key, "phone"), base, lambda d, b: d + b)
        return _put(token, F.concat(F.slice(digits, 1, F.size(digits) - 10), moved))

    return _let(_digits(token), of)


def address_pseudonym(token: Column, key: str = KEY) -> Column:
    """Four numbers up to 255 -> four such numbers; null if one is larger."""

    def of(parts: Column) -> Column:
        return F.when(F.array_max(parts) <= 255, F.array_join(_feistel(parts, _same(parts, 256), key, "address").cast("array<string>"), "."))

    return _let(F.transform(F.split(token, r"\."), lambda x: x.cast("long")), of)


def _walk(place: Column, span: Column, key: str) -> Column:
    """A permutation of the days of a span, 0 .. size - 1. The Feistel network permutes a square of side * side numbers, of which
    the last few lie beyond size: from there it is applied again until the number is back (cycle walking). A walk has at
    most as many steps as there are numbers beyond, so it always ends; hardly any day takes one."""
    size, side = span.getField("size"), span.getField("side")

    def step(x: Column) -> Column:
        pair = F.array(F.floor(x / side).cast("long"), F.pmod(x, side))
        return _let(_feistel(pair, F.array(side, side), key, span.getField("name")), lambda v: F.element_at(v, 1) * side + F.element_at(v, 2))

    def on(x: Column) -> Column:
        return F.when(x < size, x).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), side * side - size), x, lambda y, _: F.when(y < size, y).otherwise(step(y))))

    return _let(step(place), on)


def date_pseudonym(token: Column, key: str = KEY) -> Column:
    """A day from 0001-01-01 to 9999-12-31 -> another such day of its span of the calendar (SPANS); null if there is no such day."""

    def of(day: Column) -> Column:
        span = F.lit(None)
        for i, (first, size) in enumerate(SPANS):
            fields = {"first": first, "size": size, "side": math.isqrt(size - 1) + 1}
            own = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in fields.items()], F.lit(f"date{i}").alias("name"))
            span = F.when((day >= first) & (day < first + size), own).otherwise(span)
        moved = _let(span, lambda s: F.when(s.isNotNull(), _walk(day - s.getField("first"), s, key) + s.getField("first")))
        return F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")).cast("string")

    # A cast, unlike a format, knows no time zone.
    return _let(F.date_diff(token.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long"), of)


def mail_pseudonym(token: Column, key: str = KEY) -> Column:
    """ASCII letters and digits before the @ are permuted within their kind; all else stays."""

    def place(c: Column) -> Column:
        out = F.lit(0).cast("long")
        for alphabet, test in ((LETTERS, "[a-z]"), (CAPITALS, "[A-Z]"), (DIGITS, "[0-9]")):
            out = F.when(c.rlike(test), (F.instr(F.lit(alphabet), c) - 1).cast("long")).otherwise(out)
        return out

    def radix(c: Column) -> Column:
        return F.when(c.rlike("[a-zA-Z]"), 26).when(c.rlike("[0-9]"), 10).otherwise(1).cast("long")

    def symbol(c: Column, v: Column) -> Column:
        at = (v + 1).cast("int")
        return (
            F.when(c.rlike("[a-z]"), F.substring(F.lit(LETTERS), at, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit(CAPITALS), at, F.lit(1)))
            .when(c.rlike("[0-9]"), F.substring(F.lit(DIGITS), at, F.lit(1)))
            .otherwise(c)
        )

    local = F.substring_index(token, "@", 1)
    new = _let(F.split(local, ""), lambda c: F.array_join(F.zip_with(c, _feistel(F.transform(c, place), F.transform(c, radix), key, "mail"), symbol), ""))
    return F.concat(new, F.substring(token, F.length(local) + 1, F.length(token)))


def pseudonym(key: str = KEY) -> Callable[[Column], Column]:
    """A found token -> its pseudonym, or the token itself where it does not pass validation."""

    def of(token: Column) -> Column:
        return F.coalesce(
            F.when(token.contains("@"), mail_pseudonym(token, key))
            .when(token.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), date_pseudonym(token, key))
            .when(token.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), address_pseudonym(token, key))
            .when(token.rlike(r"^\+|\(|^[0-9]{3}[.-][0-9]{3}[.-]"), phone_pseudonym(token, key))
            .otherwise(card_pseudonym(token, key)),
            token,
        )

    return of


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with the text column pseudonymised, and n_private, the number of tokens that changed.

    Found and validated: payment cards (Luhn; the pseudonym passes it too), telephone numbers in North American notation, IPv4
    addresses, ISO dates (real days become real days), and the local part of e-mail addresses. Equal values have equal
    pseudonyms everywhere, different values of one kind different ones. What fails validation stays as it is. Null texts
    stay null with n_private 0; rows are independent, so repeated rows and null ids need no care. Only rows in which something
    was found pay for more than one pass of the pattern. A column of docs named n_private is replaced, all others are kept.
    """
    docs, back = set_aside(docs, [text], ["n_private"])
    old, new = fresh(docs.columns, "found", "new")
    found = F.when(F.col(text).rlike("[0-9@]") & F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.select("*", found.alias(old))
    rows = rows.select("*", F.when(F.size(old) > 0, F.transform(old, pseudonym(key))).alias(new))
    between = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    rows = rows.select(
        *[F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(new).isNotNull(), changed).otherwise(0).alias("n_private"),
    )
    return back(rows)
