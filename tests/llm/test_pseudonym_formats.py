"""Accounts in groups, other card groupings, IPv6; the permutation against a plain restatement; the key of the session."""

import hashlib
import ipaddress
import random

import pytest

from passagemill.llm import pseudonym, queries

KEY = "k"


def mixed(tweak, *parts):
    return int(hashlib.sha256("|".join([f"{KEY}/{tweak}", *map(str, parts)]).encode()).hexdigest()[:15], 16)


def permuted(value, tweak):
    """The Feistel network over two halves, by plain Python."""
    half = len(value) // 2
    parts = [value[:half], value[half:]]
    for turn in range(1, pseudonym.ROUNDS + 1):
        own, other = (0, 1) if turn % 2 else (1, 0)
        out = ""
        for i, c in enumerate(parts[own]):
            by = mixed(tweak, turn, i, parts[other])
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + size:
                    c = chr((ord(c) - ord(first) + by) % size + ord(first))
                    break
            out += c
        parts[own] = out
    return "".join(parts)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def account(land, rest):
    return f"{land}{98 - mod97(rest + land + '00'):02d}{rest}"


def luhn_digit(body):
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def address6(value):
    number = int(ipaddress.IPv6Address(value))
    left, right = number >> 64, number & (2**64 - 1)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for turn in range(1, pseudonym.ROUNDS + 1):
        by = (mixed("address6", turn, signed(right), "high") * 16 + mixed("address6", turn, signed(right), "low") % 16) % 2**64
        left, right = right, left ^ by
    return ":".join(f"{(left << 64 | right) >> shift & 65535:x}" for shift in range(112, -1, -16))


def run(spark, values):
    df = spark.createDataFrame([(i, f"a {v} b") for i, v in enumerate(values)], "doc_id long, text string")
    return {values[r["doc_id"]]: r["text"][2:-2] for r in pseudonym.replace_personal(df, KEY).collect()}


def spaced(text):
    return " ".join(text[i : i + 4] for i in range(0, len(text), 4))


def test_accounts_with_and_without_blanks(spark):
    random.seed(2)
    whole = ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947", "ES9121000418450200051332", "FR1420041010050500013M02606"]
    for n, lands in pseudonym.ACCOUNT_LENGTHS.items():
        whole += [account(land, "".join(random.choices("0123456789", k=n - 4))) for land in lands.split("|")]
    got = run(spark, [*whole, *map(spaced, whole)])
    for v in whole:
        body = permuted(v[4:], "iban")
        assert got[v] == account(v[:2], body) and got[spaced(v)] == spaced(got[v]) and mod97(got[v][4:] + got[v][:4]) == 1
    bad = ["DE88 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 0", "XX89 3704 0044 0532 0130 00"]
    assert all(a == b for a, b in run(spark, bad).items())


def test_values_behind_a_grouped_account(spark):
    v, card = "ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111"
    alone = run(spark, [v, card])
    got = run(spark, [f"{v} {card}", f"{v} THE END", f"{v} {v}", f"{card} {v}"])
    assert got == {f"{v} {card}": f"{alone[v]} {alone[card]}", f"{v} THE END": f"{alone[v]} THE END", f"{v} {v}": f"{alone[v]} {alone[v]}", f"{card} {v}": f"{alone[card]} {alone[v]}"}


def test_card_groupings(spark):
    amex, diners = "3782 822463 10005", "3056 930902 5904"
    got = run(spark, [amex, amex.replace(" ", ""), amex.replace(" ", "-"), diners, "3782 822463 10006", "3782 822463-10005"])
    for v in (amex, diners):
        digits = v.replace(" ", "")
        body = permuted(digits[:-1], "card")
        assert got[v].replace(" ", "") == body + luhn_digit(body) and [len(g) for g in got[v].split()] == [len(g) for g in v.split()]
    assert got[amex.replace(" ", "")] == got[amex].replace(" ", "") == got[amex.replace(" ", "-")].replace("-", "")
    assert got["3782 822463 10006"] == "3782 822463 10006" and got["3782 822463-10005"] == "3782 822463-10005"


def test_addresses_of_version_6(spark):
    random.seed(5)
    numbers = [random.getrandbits(128) for _ in range(60)] + [random.getrandbits(16) << 112 | random.getrandbits(40) for _ in range(20)]
    short = [str(ipaddress.IPv6Address(n)) for n in numbers] + ["2001:db8::ff00:42:8329", "fe80::1:2", "2001:db8:1::"]
    long = [ipaddress.IPv6Address(v).exploded.upper() for v in short]
    got = run(spark, [*short, *long])
    for v, w in zip(short, long):
        assert got[v] == got[w] == address6(v)
    assert len({got[v] for v in short}) == len(set(short))
    other = ["a::b", "std::vector", "12:30:45", "00:1a:2b:3c:4d:5e", "::1", "::", "1:2:3:4:5:6:7", "1::2::3", "12345::1:2", "1:2:3:4:5:6:7:8:9", "cafe::be:ad"]
    assert all(a == b for a, b in run(spark, other).items())
    assert run(spark, ["see 2001:db8::8329:1."]) == {"see 2001:db8::8329:1.": f"see {address6('2001:db8::8329:1')}."}


@pytest.mark.parametrize("tweak", ["card", "mail"])
def test_the_permutation_is_one(spark, tweak):
    from pyspark.sql import functions as F

    values = [f"{i:04d}" for i in range(0, 10000, 7)] if tweak == "card" else [f"{a}{b}.7" for a in "azAZ09" for b in "bcdeXY"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", pseudonym.permuted(F.col("v"), KEY, tweak).alias("p")).collect()}
    assert got == {v: permuted(v, tweak) for v in values} and len(set(got.values())) == len(values)


def test_the_session_has_the_key(spark):
    assert queries.pseudonym_key(spark) == queries.PSEUDONYM_KEY
    spark.conf.set(queries.PSEUDONYM_SETTING, "mine")
    try:
        assert queries.pseudonym_key(spark) == "mine"
    finally:
        spark.conf.unset(queries.PSEUDONYM_SETTING)
