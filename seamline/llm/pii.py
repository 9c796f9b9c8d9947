"""Format-preserving pseudonyms for personal numbers and dates, with DataFrame functions only.

Candidates are found by one pattern, validated (check digits, calendar, ranges), and permuted within their format by a keyed Feistel network. Equal values
get equal pseudonyms in every document, whatever their separators, and different values different ones. What fails validation stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: In order of preference where several fit. Each starts at the edge of a number or word, so a long run is tried once.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ROUNDS = 8
#: Days from FIRST_DAY whose number is a product of two equal sizes.
FIRST_DAY, SIDE = "1900-01-01", 270


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _number(s: Column, default: int = 0) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(default).cast("long"))


def _hash(key: str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}/{kind}/"), round_.cast("string"), F.lit("/"), half), 256)


def permute_numbers(left: Column, right: Column, side: int, key: str, kind: str) -> Column:
    """A keyed permutation of pairs of numbers below side; a struct l, r."""

    def step(a: Column, i: Column) -> Column:
        f = F.conv(F.substring(_hash(key, kind, i, a["r"].cast("string")), 1, 12), 16, 10).cast("long")
        return F.struct(a["r"].alias("l"), F.pmod(a["l"] + f, F.lit(side).cast("long")).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


#: Ranges of code points that hold letters or digits of one kind, and nothing else.
CLASSES = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A),  # digits, capital and small letters
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F),  # Latin letters with marks
    (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9),  # Greek
    (0x410, 0x42F), (0x430, 0x44F),  # Cyrillic
    (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x660, 0x669),  # Armenian, Hebrew, Arabic
    (0x905, 0x939), (0x966, 0x96F), (0xE01, 0xE2E), (0x10D0, 0x10F0),  # Devanagari, Thai, Georgian
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),  # kana, Han, Hangul
)
IN_CLASSES = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CLASSES)


def permute_text(s: Column, key: str, kind: str, classes: tuple[tuple[int, int], ...] = CLASSES[:3]) -> Column:
    """A keyed permutation of the strings whose characters are of the same classes at the same places; characters of no class stay.

    A Feistel network: in each round the one half, turned by a hash of the other, becomes the new other half.
    """

    def char(code: Column) -> Column:
        if len(classes) <= 3:
            return F.chr(code)
        return F.when(code < 128, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def shifted(c: Column, by: Column) -> Column:
        def turned(code: Column) -> Column:
            new = F.lit(None).cast("long")
            for a, b in reversed(classes):
                new = F.when(code.between(a, b), F.pmod(code - a + by, F.lit(b - a + 1).cast("long")) + a).otherwise(new)
            return F.coalesce(_let(new, char), c)

        return _let(F.ascii(c).cast("long"), turned)

    def step(a: Column, i: Column) -> Column:
        def moved(h: Column) -> Column:
            by = lambda j: F.conv(F.substr(h, F.pmod(j * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("long")
            return F.transform(a["l"], lambda c, j: shifted(c, by(j)))

        return F.struct(a["r"].alias("l"), _let(_hash(key, kind, i, F.array_join(a["r"], "")), moved).alias("r"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(_chars(F.substr(s, F.lit(1), half)).alias("l"), _chars(F.substr(s, half + 1)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda a: F.concat(F.array_join(a["l"], ""), F.array_join(a["r"], "")))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits and capital letters replaced in order by those of digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    fills = lambda c: c.rlike("^[0-9A-Z]$")
    step = lambda a, c: F.struct(F.concat(a["s"], F.when(fills(c), F.substr(digits, a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + fills(c).cast("int")).alias("k"))
    return F.aggregate(_chars(shape), start, step, lambda a: a["s"])


def _luhn(digits: Column) -> Column:
    """The sum that Luhn's rule wants to be a multiple of ten."""
    step = lambda a, i: a + F.when(F.pmod(i, F.lit(2)) == 1, _number(F.substr(digits, -i, F.lit(1)))).otherwise(
        _let(2 * _number(F.substr(digits, -i, F.lit(1))), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0).cast("long"), step)


def _mod97(s: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.pmod(a * 10 + _number(c), F.lit(97).cast("long"))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97).cast("long")))

    return F.aggregate(_chars(s), F.lit(0).cast("long"), step)


def _card_fits(d: Column) -> Column:
    return F.pmod(_luhn(d), F.lit(10)) == 0


def _iban_fits(d: Column) -> Column:
    return _mod97(F.concat(F.substr(d, F.lit(5)), F.substr(d, F.lit(1), F.lit(4)))) == 1


def _card(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        body = permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = _let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10).cast("long")).cast("string")))
        return F.when(_card_fits(d), _refill(m, whole)).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), changed)


def _iban(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        country, rest = F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(5))
        new = _let(permute_text(rest, key, "iban"), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(_iban_fits(d), _refill(m, new)).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), changed)


def _ip(m: Column, key: str) -> Column:
    def changed(p: Column) -> Column:
        n = lambda i: _number(p[i], 999)
        new = permute_numbers(n(0) * 256 + n(1), n(2) * 256 + n(3), 65536, key, "ip")
        parts = lambda x: F.concat_ws(".", *(y.cast("string") for h in (x["l"], x["r"]) for y in (F.floor(h / 256), F.pmod(h, F.lit(256)))))
        return F.when((n(0) < 256) & (n(1) < 256) & (n(2) < 256) & (n(3) < 256), _let(new, parts)).otherwise(m)

    return _let(F.split(m, r"\."), changed)


def _date(m: Column, key: str) -> Column:
    def changed(p: Column) -> Column:
        n = lambda i: _number(p[i], 0)
        first = m.rlike("^[0-9]{4}")
        american = ~first & m.contains("/") & (n(1) > 12)  # the month first, if the day can't be
        y = F.when(first, n(0)).otherwise(n(2))
        mo = F.when(american, n(0)).otherwise(n(1))
        d = F.when(first, n(2)).when(american, n(1)).otherwise(n(0))
        leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
        days = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
        real = y.between(1900, 2099) & mo.between(1, 12) & (d >= 1) & (d <= days)
        nth = F.when(real, F.date_diff(F.make_date(y.cast("int"), mo.cast("int"), d.cast("int")), F.lit(FIRST_DAY).cast("date"))).otherwise(-1)

        def day(k: Column) -> Column:
            new = permute_numbers(F.floor(k / SIDE), F.pmod(k, F.lit(SIDE)), SIDE, key, "date")
            shape = F.when(m.contains("-"), F.lit("yyyy-MM-dd")).when(first, F.lit("yyyy/MM/dd")).when(american, F.lit("MM/dd/yyyy")).when(m.contains("."), F.lit("dd.MM.yyyy")).otherwise(F.lit("dd/MM/yyyy"))
            written = lambda x: F.array_join(F.transform(_pieces(shape), lambda f: _field(f, x)), "")
            return F.when((k >= 0) & (k < SIDE * SIDE), _let(new, lambda x: _let(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * SIDE + x["r"]).cast("int")), written))).otherwise(m)

        return _let(nth, day)

    return _let(F.split(m, r"[-/.]"), changed)


def _pieces(shape: Column) -> Column:
    return F.regexp_extract_all(shape, F.lit("[A-Za-z]+|[^A-Za-z]"), F.lit(0))


def _field(f: Column, day: Column) -> Column:
    return F.when(f == "yyyy", F.lpad(F.year(day).cast("string"), 4, "0")).when(f == "MM", F.lpad(F.month(day).cast("string"), 2, "0")).when(f == "dd", F.lpad(F.dayofmonth(day).cast("string"), 2, "0")).otherwise(f)


#: Country codes of telephone numbers: one digit, two digits, and three for all others.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _digits(m: Column, key: str, kind: str) -> Column:
    """m with its digits permuted; all separators stay."""
    return _refill(m, permute_text(F.regexp_replace(m, "[^0-9]", ""), key, kind))


def _phone(m: Column, key: str) -> Column:
    """The national number is permuted: a country code stays, wherever separators stand, as what follows it has its form."""

    def of(lead: Column) -> Column:
        return F.concat(lead, _digits(F.substr(m, F.length(lead) + 1), key, "phone"))

    return _let(F.regexp_extract(m, rf"^\+(?:{COUNTRY})|^", 0), of)


def _ssn(m: Column, key: str) -> Column:
    return F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), _digits(m, key, "ssn")).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """The name before the @ is permuted by the classes of its letters. A name with letters of no class becomes a hash of itself, as a part of it would stay."""

    def of(name: Column) -> Column:
        hashed = F.concat(F.lit("x"), F.substring(F.sha2(F.concat(F.lit(f"{key}/name/"), name), 256), 1, 16))
        new = F.when(name.rlike("^[\\x00-\\x7F]*$"), permute_text(name, key, "email")).when(name.rlike(f"[[\\p{{L}}\\p{{M}}\\p{{N}}]&&[^{IN_CLASSES}]]"), hashed).otherwise(permute_text(name, key, "email", CLASSES))
        return F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))

    return _let(F.substring_index(m, "@", 1), of)


KINDS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


#: Kinds whose candidates may run on into what follows, as an expiry date or a code: check of the letters and digits, and what to strip for it.
GROUPED: dict[str, tuple[Callable[[Column], Column], str]] = {"card": (_card_fits, "[ -]"), "iban": (_iban_fits, " ")}


def _valid_prefix(m: Column, kinds: tuple[str, ...]) -> Column:
    """The longest valid card or IBAN among the shorter prefixes of whole groups of a candidate; null if there is none."""

    def valid(p: Column) -> Column:
        out = F.lit(False)
        for k in GROUPED.keys() & set(kinds):
            fits, marks = GROUPED[k]
            out = F.when(p.rlike(f"^(?:{PATTERNS[k]})$"), _let(F.regexp_replace(p, marks, ""), fits)).otherwise(out)
        return out

    def best(groups: Column) -> Column:
        n = F.size(groups)
        counts = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(F.transform(counts, lambda k: F.substr(m, F.lit(1), F.length(F.array_join(F.slice(groups, F.lit(1), k), "-")))), valid), F.lit(0))

    return _let(F.split(m, "[ -]"), best)


def _rescanned(line: Column, pattern: str, one: Callable[[Column], Column], kinds: tuple[str, ...]) -> Column:
    """A line's candidates one after the other, so that what follows a shorter prefix is searched again; a struct s, n. No pattern goes beyond a line."""
    after_first = f"(?!^)(?:{pattern})"  # the first character was looked at before

    def step(a: Column, _: Column) -> Column:
        def of(m: Column) -> Column:
            def taken(x: Column) -> Column:
                lead, rest, old, new = x["cut"][0], x["cut"][1], x["old"], x["new"]
                left = F.concat(F.substr(old, F.length(old)), F.substr(m, F.length(old) + 1), rest)
                return F.struct(F.concat(a["s"], F.substr(lead, F.lit(2)), new).alias("s"), (a["n"] + (old != new).cast("int")).alias("n"), left.alias("left"))

            whole = F.struct(m.alias("old"), one(m).alias("new"))
            chosen = _let(whole, lambda w: F.when(w["old"] != w["new"], w).otherwise(_let(F.coalesce(_valid_prefix(m, kinds), m), lambda p: F.struct(p.alias("old"), one(p).alias("new")))))
            both = _let(chosen, lambda w: F.struct(w["old"].alias("old"), w["new"].alias("new"), F.split(a["left"], F.lit(after_first), 2).alias("cut")))
            end = F.struct(F.concat(a["s"], F.substr(a["left"], F.lit(2))).alias("s"), a["n"].alias("n"), F.lit("").alias("left"))
            return F.when(m == "", end).otherwise(_let(both, taken))

        return F.when(a["left"] == "", a).otherwise(_let(F.regexp_extract(a["left"], after_first, 0), of))

    # Each candidate has a digit or an @ of its own; the last step finds none.
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.concat(F.lit("\n"), line).alias("left"))
    return F.aggregate(F.sequence(F.lit(1), F.regexp_count(line, F.lit("[0-9]+|@")) + 1), start, step, lambda a: F.struct(a["s"].alias("s"), a["n"].alias("n")))


def pseudonymise(docs: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """docs with text's personal numbers and dates replaced, and n_replaced (int) added; a column of that name is replaced, others pass unchanged.

    Valid are: cards by Luhn's rule, IBANs modulo 97, addresses with bytes below 256, dates that exist from 1900-01-01 on for 72,900 days, social
    security numbers outside the unused ranges, and telephone numbers and e-mail addresses by form. A pseudonym is valid too and has the same separators.
    A card or IBAN that runs on into further groups is the longest valid prefix of whole groups. An e-mail name may be of any length and script; letters stay within their
    script. A telephone number is its digits after the country code, so all ways to write it stay linked, with and without that code. Of dates with slashes the day comes first
    unless it can't. `key` is the secret of the permutation and has no default: who has it can undo the numbers. A null text stays null, an empty one empty. Equal rows get equal results, no rows give none.
    """
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)

    def one(m: Column) -> Column:
        out = None
        for k in kinds:
            fits = m.rlike(f"^(?:{PATTERNS[k]})$")
            out = F.when(fits, KINDS[k](m, key)) if out is None else out.when(fits, KINDS[k](m, key))
        return out.otherwise(m)

    # The row travels as one column, so its names can't clash with those used here.
    docs = docs.drop("n_replaced")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    text = F.col("text")
    # Most texts have neither a digit nor an @, and nothing is searched in them.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    swaps = F.transform("found", lambda m: F.struct(m.alias("old"), one(m).alias("new")))
    changed = F.coalesce(F.size(F.filter("swaps", lambda x: x["old"] != x["new"])), F.lit(0))
    joined = F.array_join(F.zip_with(F.split(text, F.lit(pattern), -1), F.col("swaps"), lambda a, x: F.concat(a, F.coalesce(x["new"], F.lit("")))), "")
    # Few texts have a candidate that is valid only in part; those are gone through again.
    cut = F.coalesce(F.exists("swaps", lambda x: (x["old"] == x["new"]) & x["old"].rlike("[ -]") & _valid_prefix(x["old"], kinds).isNotNull()), F.lit(False))
    again = F.when(F.col("cut"), F.transform(F.split(text, F.lit("\n"), -1), lambda line: _rescanned(line, pattern, one, kinds)))
    out = rows.withColumn("found", found).withColumn("swaps", swaps).withColumn("cut", cut).withColumn("again", again)
    out = out.withColumn("n_replaced", F.when(F.col("cut"), F.aggregate("again", F.lit(0), lambda n, x: n + x["n"])).otherwise(changed))
    new = F.when(F.col("cut"), F.array_join(F.transform("again", lambda x: x["s"]), "\n")).when(F.col("n_replaced") > 0, joined).otherwise(text)
    return out.select(*(new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns), "n_replaced")
