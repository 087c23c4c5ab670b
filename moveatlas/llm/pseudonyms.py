r"""Format-preserving pseudonyms for personal numbers and dates.

Account numbers, IBANs, phone numbers, IP addresses and dates are found, validated
and replaced by a keyed permutation of their own format: an alternating Feistel
network adds keyed round values to one part of the number and then to the other, so
the mapping is a bijection and equal values get equal pseudonyms in every document,
however they are punctuated. Mail addresses become keyed tokens.

Found, in this order where several could start:

* Mail addresses.
* IBANs, compact or in groups, of the length of their country, or of 10 to 30 digits for a
  country that is not listed: the account's digits and its letters are permuted, each at
  their places, and the check digits are made new; an invalid IBAN is left alone.
* IPv4: permuted among all addresses; with a part above 255 left alone.
* Dates (``yyyy-mm-dd``, ``yyyy/mm/dd``, ``dd.mm.yyyy``, ``dd/mm/yyyy``, also without leading
  zeros, and ``3 May 1980``): permuted among 73,000 days, counted from 1900-01-01; dates that
  do not exist are left alone.
* Social security numbers (``123-45-6789``): nine digits permuted.
* Phone numbers of ten digits in groups, or ten digits in a row that begin like a North
  American number: the last ten digits are permuted, the country code stays.
* Phone numbers with ``+`` or ``(0)``: the digits behind the country code (one digit for 1
  and 7, else two) or the trunk zero are permuted.
* 13 to 19 digits: all digits but the last are permuted and the last keeps its
  distance to the Luhn digit, so valid numbers stay valid and others invalid.

Not found: IPv6 addresses, other national numbers, names and postal addresses.

The key is part of the plan: give one per corpus and keep event logs private.
Defined cases: a null text stays null and holds nothing; everything else in a text
stays as it is; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import let

ROUNDS = 8
DAYS_LEFT, DAYS_RIGHT = 365, 200
ORIGIN = "1900-01-01"
# Length of the account part by country, from the public IBAN registry.
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK|FI|FO|GL|NL", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|XK", 17: "CH|HR|LI|LV",
    18: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "PT",
    22: "IS|TR", 23: "FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV", 25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU",
    27: "MT|SC", 28: "LC",
}
_KNOWN = "|".join(rf"(?:{of})\d{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, of in IBAN_LENGTHS.items())
_MONTHS = "|".join(
    f"{m[:3]}(?:{m[3:]})?" if m[3:] else m
    for m in (
        "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
        "November", "December",
    )
)
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_KNOWN}|[A-Z]{{2}}\d{{2}}(?: ?\d){{10,30}}+(?! ?\d))(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": rf"(?<!\d)(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}/\d{{1,2}}/\d{{1,2}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}} (?:{_MONTHS}) \d{{4}})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d.,+/-])[2-9]\d{9}(?![.,/-]?\d)",
    "abroad": r"(?<![\d+])\+[1-9](?:[ ./-]?(?:\(\d{1,4}\)|\d)){6,14}(?!\d)",
    "trunk": r"(?<!\d)\(0\)(?: ?-?\d){8,11}(?!\d)",
    "account": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(PATTERNS.values())
POWERS = [10**i for i in range(16)]


def _noise(key: str, label: str, turn: int, value: Column, modulus: Column) -> Column:
    """A keyed round value below ``modulus``."""
    text = F.concat(F.lit(f"{key}\x00{label}\x00{turn}\x00"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), modulus)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, label: str) -> Column:
    """(left, right) permuted within ``left_size`` times ``right_size`` values."""
    pair = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def move_left(turn: int):
        def step(p: Column) -> Column:
            moved = F.pmod(p["l"] + _noise(key, label, turn, p["r"], left_size), left_size)
            return F.struct(moved.alias("l"), p["r"].alias("r"))

        return step

    def move_right(turn: int):
        def step(p: Column) -> Column:
            moved = F.pmod(p["r"] + _noise(key, label, turn, p["l"], right_size), right_size)
            return F.struct(p["l"].alias("l"), moved.alias("r"))

        return step

    for turn in range(ROUNDS):
        pair = let(pair, move_right(turn) if turn % 2 else move_left(turn))
    return pair


def permute_digits(digits: Column, key: str, label: str) -> Column:
    """A string of 2 to 30 digits permuted among the strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    powers = F.array(*[F.lit(p).cast("long") for p in POWERS])

    def apply(p: Column) -> Column:
        return F.concat(
            F.lpad(p["l"].cast("string"), half, F.lit("0")),
            F.lpad(p["r"].cast("string"), n - half, F.lit("0")),
        )

    left = F.substr(digits, F.lit(1), half).cast("long")
    right = F.substr(digits, half + 1).cast("long")
    return let(feistel(left, right, F.get(powers, half), F.get(powers, n - half), key, label), apply)


def luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` followed by it pass the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, 2 * d - F.when(2 * d > 9, 9).otherwise(0)).otherwise(d)
        return total + doubled

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(a: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(a["out"], F.when(digit, F.substr(digits, a["at"], F.lit(1))).otherwise(c)).alias("out"),
            (a["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(form, ""), start, put, lambda a: a["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def account_pseudonym(found: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        last = F.substr(d, F.length(d)).cast("int")

        def full(h: Column) -> Column:
            check = F.pmod(luhn_digit(h) + last - luhn_digit(head), F.lit(10))
            return F.concat(h, check.cast("string"))

        return let(permute_digits(head, key, "account"), full)

    return _refill(found, let(_digits(found), new))


def phone_pseudonym(found: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        return F.concat(
            F.substr(d, F.lit(1), F.length(d) - 10), permute_digits(F.substr(d, F.length(d) - 9), key, "phone")
        )

    return _refill(found, let(_digits(found), new))


def ssn_pseudonym(found: Column, key: str) -> Column:
    return _refill(found, let(_digits(found), lambda d: permute_digits(d, key, "ssn")))


def abroad_pseudonym(found: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        head = F.when(F.substr(d, F.lit(1), F.lit(1)).isin("1", "7"), 1).otherwise(2)
        return F.concat(F.substr(d, F.lit(1), head), permute_digits(F.substr(d, head + 1), key, "abroad"))

    return _refill(found, let(_digits(found), new))


def trunk_pseudonym(found: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        return F.concat(F.lit("0"), permute_digits(F.substr(d, F.lit(2)), key, "trunk"))

    return _refill(found, let(_digits(found), new))


LETTER_POWERS = [26**i for i in range(14)]


def permute_letters(letters: Column, key: str, label: str) -> Column:
    """A string of up to 26 capital letters permuted among the strings of its length."""
    n = F.length(letters)
    half = F.floor(n / 2).cast("int")
    powers = F.array(*[F.lit(p).cast("long") for p in LETTER_POWERS])

    def number(text: Column) -> Column:
        codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 65).cast("long"))
        return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a * 26 + c)

    def spelled(value: Column, size: Column) -> Column:
        places = F.when(size > 0, F.sequence(size - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.array_join(
            F.transform(places, lambda i: F.char(F.pmod(F.call_function("div", value, F.get(powers, i)), F.lit(26)) + 65)), ""
        )

    def apply(p: Column) -> Column:
        return F.concat(spelled(p["l"], half), spelled(p["r"], n - half))

    left, right = F.substr(letters, F.lit(1), half), F.substr(letters, half + 1)
    sizes = F.get(powers, half), F.get(powers, n - half)
    return F.when(n.between(1, 26), let(feistel(number(left), number(right), *sizes, key, label), apply)).otherwise(letters)


def iban_rest(text: Column) -> Column:
    """A compact text of digits and capitals, letters as 10 to 35, modulo 97."""
    def add(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(
            F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))
        )

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _refill_both(form: Column, digits: Column, letters: Column) -> Column:
    """``form`` with its digits and its capitals replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))

    def put(a: Column, c: Column) -> Column:
        digit, letter = c.between("0", "9"), c.between("A", "Z")
        new = F.when(digit, F.substr(digits, a["d"], F.lit(1))).when(letter, F.substr(letters, a["l"], F.lit(1)))
        return F.struct(
            F.concat(a["out"], new.otherwise(c)).alias("out"),
            (a["d"] + digit.cast("int")).alias("d"), (a["l"] + letter.cast("int")).alias("l"),
        )

    return F.aggregate(F.split(form, ""), start, put, lambda a: a["out"])


def iban_pseudonym(found: Column, key: str) -> Column:
    country, check = F.substring(found, 1, 2), F.substring(found, 3, 2)

    def new(account: Column) -> Column:
        digits, letters = _digits(account), F.regexp_replace(account, "[^A-Z]", "")
        many = F.when(F.length(digits) > 1, permute_digits(digits, key, "iban")).otherwise(digits)
        compact = F.regexp_replace(account, " ", "")

        def full(moved: Column) -> Column:
            rest = iban_rest(F.concat(F.regexp_replace(moved, " ", ""), country, F.lit("00")))
            return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), moved)

        valid = iban_rest(F.concat(compact, country, check)) == 1
        both = F.struct(many.alias("d"), permute_letters(letters, key, "iban").alias("l"))
        moved = let(both, lambda b: _refill_both(account, b["d"], b["l"]))
        return F.when(valid, let(moved, full)).otherwise(found)

    return let(F.substr(found, F.lit(5)), new)


def ip_pseudonym(found: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        part = [F.get(p, i).cast("long") for i in range(4)]
        side = F.lit(65536).cast("long")
        mixed = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], side, side, key, "ip")

        def dotted(m: Column) -> Column:
            return F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(m[h] / 256), m[h] % 256)])

        return F.when(F.array_max(F.transform(p, lambda x: x.cast("long"))) <= 255, let(mixed, dotted)).otherwise(found)

    return let(F.split(found, r"\."), new)


def date_pseudonym(found: Column, key: str) -> Column:
    layouts = {
        r"^\d{4}-": "yyyy-M-d", r"^\d{4}/": "yyyy/M/d", r"^\d{1,2}\.": "d.M.yyyy", r"^\d{1,2}/": "d/M/yyyy",
        r"^\d{4}-\d{2}-\d{2}": "yyyy-MM-dd", r"^\d{4}/\d{2}/\d{2}": "yyyy/MM/dd", r"^\d{2}\.\d{2}\.": "dd.MM.yyyy",
        r"^\d{2}/\d{2}/": "dd/MM/yyyy", r"^\d{1,2} [A-Z]": "d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} ": "d MMM yyyy",
    }
    span = DAYS_LEFT * DAYS_RIGHT

    def renew(layout: str):
        def new(day: Column) -> Column:
            block, inside = F.floor(day / span), F.pmod(day, F.lit(span))
            mixed = feistel(
                F.floor(inside / DAYS_RIGHT), inside % DAYS_RIGHT,
                F.lit(DAYS_LEFT).cast("long"), F.lit(DAYS_RIGHT).cast("long"), key, "date",
            )
            moved = let(mixed, lambda m: (block * span + m["l"] * DAYS_RIGHT + m["r"]).cast("int"))
            made = F.date_format(F.date_add(F.lit(ORIGIN).cast("date"), moved), layout)
            return F.when(block.between(-4, 39), made).otherwise(found)

        return new

    result = found
    for shape, layout in layouts.items():
        day = F.datediff(F.try_to_timestamp(found, F.lit(layout)).cast("date"), F.lit(ORIGIN).cast("date"))
        result = F.when(found.rlike(shape), F.coalesce(let(day, renew(layout)), found)).otherwise(result)
    return result


def email_pseudonym(found: Column, key: str) -> Column:
    token = F.substring(F.sha2(F.concat(F.lit(f"{key}\x00email\x00"), F.lower(found)), 256), 1, 16)
    return F.concat(F.lit("u"), token, F.lit("@example.invalid"))


MAKERS = {
    "email": email_pseudonym, "iban": iban_pseudonym, "ip": ip_pseudonym,
    "date": date_pseudonym, "ssn": ssn_pseudonym, "phone": phone_pseudonym, "abroad": abroad_pseudonym,
    "trunk": trunk_pseudonym, "account": account_pseudonym,
}


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found value."""
    result = found
    for kind, pattern in reversed(PATTERNS.items()):
        result = F.when(found.rlike(f"^(?:{pattern})$"), MAKERS[kind](found, key)).otherwise(result)
    return result


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, plus n_found and n_changed.

    Columns of the two added names are replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    t = F.col(text)
    may = t.rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    read = docs.drop("n_found", "n_changed").withColumn("__found", found)
    read = read.withColumn("__new", F.transform("__found", lambda x: pseudonym(x, key)))
    joined = F.array_join(
        F.zip_with(F.split(t, ANY), "__new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    changed = F.zip_with("__found", "__new", lambda a, b: (a != b).cast("long"))
    done = read.withColumns(
        {
            text: F.when(F.size("__found") > 0, joined).otherwise(t),
            "n_found": F.coalesce(F.size("__found"), F.lit(0)).cast("long"),
            "n_changed": F.aggregate(changed, F.lit(0).cast("long"), lambda a, b: a + b),
        }
    )
    return done.drop("__found", "__new")
