"""IBANs of every length, compact and in groups of four."""

import hashlib
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from moveatlas.llm import pseudonyms


def made(country, digits):
    code = "".join(str(ord(c) - 55) for c in country)
    return f"{country}{98 - int(f'{digits}{code}00') % 97:02d}{digits}"


@pytest.mark.parametrize("tail", [".", " 12 apples"])
def test_one_iban_per_length(spark, tail):
    rng = random.Random(5)
    countries = {n: of.split("|")[-1] for n, of in pseudonyms.IBAN_LENGTHS.items()}
    if tail == ".":
        countries = {n: countries.get(n, "QQ") for n in range(10, 31)}
    ibans = [made(c, "".join(rng.choices("0123456789", k=n))) for n, c in countries.items()]
    ibans += ["ES9121000418450200051332", "PL61109010140000071219812874"]
    spaced = [" ".join(re.findall(".{1,4}", x)) for x in ibans]
    rows = [(i, f"pay {a}, or {b}{tail}") for i, (a, b) in enumerate(zip(ibans, spaced, strict=True))]
    new = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    for r in new:
        old = ibans[r.doc_id]
        a, b = re.fullmatch(rf"pay ([A-Z0-9]+), or ([A-Z0-9 ]{{{len(spaced[r.doc_id])}}}){re.escape(tail)}", r.text).groups()
        assert a == b.replace(" ", "") and a != old and a[:2] == old[:2] and len(a) == len(old)
        assert int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1
        assert (r.n_found, r.n_changed) == (2, 2)


def valid(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def changed(spark, *values):
    rows = [(i, f"a {v}, b") for i, v in enumerate(values)]
    got = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    return {values[r.doc_id]: r.text.removeprefix("a ").removesuffix(", b") for r in got}


def shape(text):
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", text))


LETTERED = [
    "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "NL91ABNA0417164300", "IT60X0542811101000000123456",
    "MT84MALT011000012345MTLCAST001S", "FR1420041010050500013M02606",
]


def test_ibans_with_letters(spark):
    got = changed(spark, *LETTERED, "GB83 WEST 1234 5698 7654 32")
    for old in LETTERED:
        assert valid(old) and valid(got[old]) and got[old] != old and got[old][:2] == old[:2]
        assert shape(got[old]) == shape(old)
    assert got[LETTERED[0]].replace(" ", "") == got[LETTERED[1]]
    assert got["GB83 WEST 1234 5698 7654 32"] == "GB83 WEST 1234 5698 7654 32"


def test_other_numbers_and_dates(spark):
    numbers = ["+49 30 1234567", "+49301234567", "5551234567", "(0)20 7946 0958", "123-45-6789", "+44 (0)20 7946 0958"]
    got = changed(spark, *numbers, "1700000000", "12-345-6789-0")
    for old in numbers:
        assert got[old] != old and shape(got[old]) == shape(old)
    assert re.sub(r"\D", "", got["+49 30 1234567"]) == got["+49301234567"][1:] and got["+49301234567"].startswith("+49")
    assert got["1700000000"] == "1700000000"
    dates = {"1980-03-05": "%Y-%m-%d", "1980-3-5": "%Y-%m-%d", "5/3/1980": "%d/%m/%Y", "05.03.1980": "%d.%m.%Y",
             "5 March 1980": "%d %B %Y", "5 Mar 1980": "%d %b %Y", "3 May 1980": "%d %B %Y"}
    got = changed(spark, *dates, "31 February 1980", "1980-13-01")
    found = {datetime.strptime(got[d], form) for d, form in dates.items() if d != "3 May 1980"}
    assert len(found) == 1 and found != {datetime(1980, 3, 5)}
    assert got["3 May 1980"] != "3 May 1980"
    assert got["31 February 1980"] == "31 February 1980" and got["1980-13-01"] == "1980-13-01"


def feistel_by_hand(left, right, sizes, key, label):
    for turn in range(pseudonyms.ROUNDS):
        size, value = (sizes[1], left) if turn % 2 else (sizes[0], right)
        code = hashlib.sha256(f"{key}\0{label}\0{turn}\0{value}".encode()).hexdigest()[:15]
        noise = int(code, 16) % size
        if turn % 2:
            right = (right + noise) % size
        else:
            left = (left + noise) % size
    return left, right


def test_digits_and_letters_equal_a_feistel_by_hand(spark):
    rng = random.Random(8)
    digits = ["".join(rng.choices("0123456789", k=n)) for n in range(2, 31)]
    letters = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n)) for n in range(1, 27)]
    got = {r.v: r.p for r in spark.createDataFrame([(d,) for d in digits], "v string").select("v", pseudonyms.permute_digits(F.col("v"), "k", "x").alias("p")).collect()}
    for d in digits:
        half = len(d) // 2
        l, r = feistel_by_hand(int(d[:half] or 0), int(d[half:]), (10**half, 10 ** (len(d) - half)), "k", "x")
        assert got[d] == f"{l:0{half}d}{r:0{len(d) - half}d}"
    got = {r.v: r.p for r in spark.createDataFrame([(d,) for d in letters], "v string").select("v", pseudonyms.permute_letters(F.col("v"), "k", "x").alias("p")).collect()}

    def spell(n, size):
        return "".join(chr(65 + n // 26**i % 26) for i in reversed(range(size)))

    def number(text):
        return sum((ord(c) - 65) * 26**i for i, c in enumerate(reversed(text)))

    for w in letters:
        half = len(w) // 2
        l, r = feistel_by_hand(number(w[:half]), number(w[half:]), (26**half, 26 ** (len(w) - half)), "k", "x")
        assert got[w] == spell(l, half) + spell(r, len(w) - half)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "call 123-45-6789", 9, "x")], "doc_id long, text string, n_found int, other string")
    got = pseudonyms.pseudonymise(docs, "k")
    assert sorted(got.columns) == ["doc_id", "n_changed", "n_found", "other", "text"] and got.first().n_found == 1
    assert pseudonyms.pseudonymise(docs.limit(0), "k").collect() == []
