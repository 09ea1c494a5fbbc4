"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its format's check is permuted by a keyed Feistel network within the values of that format: a card
number stays a card number of the same length and grouping with a right check digit, a date stays a date. Equal values
get equal pseudonyms in every document, different values different ones, and the key's holder can undo them.
DataFrame functions only.

Formats: card numbers of 13 to 19 digits, bare or in fours, with a right check digit; phone numbers with a country
code, which is kept; dotted addresses with parts up to 255; dates (year-month-day, or day/month/year) that exist and lie
between 1900-01-01 and 2099-11-12; the local part of mail addresses, letter for letter and digit for digit. Whatever
fails its check stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.rules import let

ROUNDS = 8
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63})+"
PHONE = "\\+[0-9]{1,3} ?\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}(?![0-9])|\\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
ADDRESS = f"(?<![0-9.])(?:{OCTET}\\.){{3}}{OCTET}(?!\\.?[0-9])"
DATE = "(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
CARD = "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4})(?![0-9])"
FOUND = "|".join([MAIL, PHONE, ADDRESS, DATE, CARD])
#: Days from 1900-01-01 that dates are permuted within, as 250 times 292.
DAYS_HIGH, DAYS_LOW = 250, 292
KINDS = ("mail", "phone", "address", "date", "card")


def _keyed(key: str, i: Column, rest: Column) -> Column:
    """60 bits of a keyed hash of the round and of the half that stays."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key + "|"), i.cast("string"), F.lit("|"), rest), 256), 1, 15), 16, 10).cast("long")


def _order(undo: bool) -> Column:
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.reverse(rounds) if undo else rounds


def _add(x: Column, by: Column, size: Column, undo: bool) -> Column:
    return F.pmod(x - by % size if undo else x + by % size, size)


def permute_digits(digits: Column, key: str, undo: bool = False) -> Column:
    """A string of 2 to 19 digits to another of its length: alternating halves, added modulo their powers of ten."""
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")

    def of(d: Column) -> Column:
        cut = F.floor(F.length(d) / 2).cast("int")
        start = F.struct(F.left(d, cut).alias("a"), F.substring(d, cut + 1, F.length(d) - cut).alias("b"))

        def step(s: Column, i: Column) -> Column:
            new = lambda x, rest: F.lpad(_add(x.cast("long"), _keyed(key, i, rest), ten(F.length(x)), undo).cast("string"), F.length(x), F.lit("0"))
            even = i % 2 == 0
            return F.struct(F.when(even, new(s.a, s.b)).otherwise(s.a).alias("a"), F.when(even, s.b).otherwise(new(s.b, s.a)).alias("b"))

        return F.aggregate(_order(undo), start, step, lambda s: F.concat(s.a, s.b))

    return let(digits, of)


def permute_pair(high: Column, low: Column, n_high: int, n_low: int, key: str, undo: bool = False) -> Column:
    """struct(a < n_high, b < n_low) permuted within all such pairs."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = _add(s.a, _keyed(key, i, s.b.cast("string")), F.lit(n_high).cast("long"), undo)
        b = _add(s.b, _keyed(key, i, s.a.cast("string")), F.lit(n_low).cast("long"), undo)
        return F.struct(F.when(even, a).otherwise(s.a).alias("a"), F.when(even, s.b).otherwise(b).alias("b"))

    return F.aggregate(_order(undo), F.struct(high.cast("long").alias("a"), low.cast("long").alias("b")), step)


def permute_letters(text: Column, key: str, undo: bool = False) -> Column:
    """Digits, small and capital letters move within their kind; other characters stay."""

    def shift(half: Column, i: Column, rest: Column) -> Column:
        def one(digest: Column) -> Column:
            def move(c: Column, j: Column) -> Column:
                by = F.conv(F.substring(digest, 1 + (j * 3) % 60, F.lit(3)), 16, 10).cast("long")
                turn = lambda base, n: F.char(_add(F.ascii(c).cast("long") - base, by, F.lit(n).cast("long"), undo) + base)
                return F.when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("0", "9"), turn(48, 10)).otherwise(c)

            return F.array_join(F.transform(F.split(half, ""), move), "")

        return let(F.sha2(F.concat(F.lit(key + "|"), i.cast("string"), F.lit("|"), rest), 256), one)

    def of(t: Column) -> Column:
        cut = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.left(t, cut).alias("a"), F.substring(t, cut + 1, F.length(t) - cut).alias("b"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(F.when(even, shift(s.a, i, s.b)).otherwise(s.a).alias("a"), F.when(even, s.b).otherwise(shift(s.b, i, s.a)).alias("b"))

        return F.aggregate(_order(undo), start, step, lambda s: F.concat(s.a, s.b))

    return let(text, of)


def luhn_sum(digits: Column) -> Column:
    """The sum that a right check digit makes a multiple of ten."""
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def refill(pattern: Column, digits: Column) -> Column:
    """The pattern with its digits replaced by the given ones in order."""
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s.out, F.substring(digits, s.at, F.lit(1))).alias("out"), (s.at + 1).alias("at"))).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.at.alias("at")))
    return F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s.out)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _card(m: Column, key: str, undo: bool) -> Column:
    def of(d: Column) -> Column:
        own = permute_digits(F.left(d, F.length(d) - 1), key + "|card", undo)
        return let(own, lambda p: refill(m, F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string"))))

    return let(only_digits(m), of)


def _phone(m: Column, key: str, undo: bool) -> Column:
    code = F.regexp_extract(m, "^\\+[0-9]{1,3}", 0)
    return let(code, lambda c: let(F.substring(m, F.length(c) + 1, F.length(m)), lambda rest: F.concat(c, refill(rest, permute_digits(only_digits(rest), key + "|phone", undo)))))


def _address(m: Column, key: str, undo: bool) -> Column:
    def of(p: Column) -> Column:
        n = lambda i: F.element_at(p, i).cast("long")
        pair = permute_pair(n(1) * 256 + n(2), n(3) * 256 + n(4), 65536, 65536, key + "|address", undo)
        return let(pair, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s.a / 256), s.a % 256, F.floor(s.b / 256), s.b % 256)]))

    return let(F.split(m, "\\."), of)


def _days(m: Column) -> Column:
    """Days from 1900-01-01 of either form of date, or null where no such day exists."""
    day = F.when(m.contains("/"), F.try_to_date(m, "dd/MM/yyyy")).otherwise(F.try_to_date(m, "yyyy-MM-dd"))
    return F.datediff(day, F.lit("1900-01-01").cast("date"))


def _date(m: Column, key: str, undo: bool) -> Column:
    def of(n: Column) -> Column:
        pair = permute_pair(F.floor(n / DAYS_LOW), n % DAYS_LOW, DAYS_HIGH, DAYS_LOW, key + "|date", undo)
        day = let(pair, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s.a * DAYS_LOW + s.b).cast("int")))
        return F.when(m.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))

    return let(_days(m), of)


def _mail(m: Column, key: str, undo: bool) -> Column:
    return F.concat(permute_letters(F.substring_index(m, "@", 1), key + "|mail", undo), F.lit("@"), F.substring_index(m, "@", -1))


PERMUTE = {"mail": _mail, "phone": _phone, "address": _address, "date": _date, "card": _card}


def kind_of(m: Column) -> Column:
    """The format whose check the match passes, or null."""
    in_range = F.coalesce(_days(m).between(0, DAYS_HIGH * DAYS_LOW - 1), F.lit(False))
    return (
        F.when(m.contains("@"), "mail")
        .when(m.startswith("+"), "phone")
        .when(m.rlike("^[0-9]{1,3}\\."), "address")
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/"), F.when(in_range, "date"))
        .when(luhn_sum(only_digits(m)) % 10 == 0, "card")
    )


def pseudonym(m: Column, kind: Column, key: str, undo: bool = False) -> Column:
    out = m
    for name, permute in PERMUTE.items():
        out = F.when(kind == name, permute(m, key, undo)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """(id, text, and a count of replaced values for each kind). A row for each row; a null text stays null.

    With ``undo`` and the same key the values come back: each format's permutation maps onto the same format.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = F.transform(F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))

    def replaced(hits: Column) -> Column:
        new = F.transform(hits, lambda h: pseudonym(h.m, h.kind, key, undo))
        pairs = F.zip_with(F.split("text", FOUND), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        counts = [F.size(F.filter(hits, lambda h: F.coalesce(h.kind == F.lit(k), F.lit(False)))).cast("long").alias(f"n_{k}") for k in KINDS]
        return F.struct(F.array_join(pairs, "").alias("text"), *counts)

    none = F.struct(F.col("text"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    return rows.select("id", F.when(F.col("text").rlike(FOUND), let(found, replaced)).otherwise(none).alias("r")).select("id", "r.*")
