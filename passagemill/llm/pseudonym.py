"""Format-preserving pseudonyms for personal data, by column expressions only.

Numbers and dates that pass their check (Luhn, mod 97, octets, groups, calendar, number plans) and
mail addresses are replaced by a keyed permutation within their own format: a Feistel
network over the value's halves, character by character modulo the size of the character's
class, with a hash of the key as its round function. Equal values get equal pseudonyms in every document, different values different
ones; check digits are made anew so pseudonyms pass the same check. Values that fail
their check stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.shared import id_text

ROUNDS = 8
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
_DAYS = 73049  # from the first to the last of them, both included

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
# Lengths of account numbers by country, as their public registry lists them.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _account_pattern() -> str:
    """Without blanks by any country; in groups of four as long as the country's numbers are, so that nothing behind is taken in."""
    grouped = "|".join(
        f"(?:{lands})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, lands in ACCOUNT_LENGTHS.items()
    )
    return rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{grouped})(?![A-Za-z0-9])"


IBAN = _account_pattern()
_HEX = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with one gap.
ADDRESS6 = rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:]|\.[0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def _phone_pattern() -> str:
    """A country's number plan where it has a fixed length, else 8 to 15 digits; the latter ends where another value begins if it can."""
    plans = {8: "45|47|65", 9: "27|31|33|34|41|48|61", 10: "1|7|30|44|81|90|91", 11: "86"}
    sign = "[ .()-]{0,2}"
    # looks back from the end, so the pattern gives groups up until the digits are as many as they may be; a look back repeats no group
    plan = "|".join(rf"\+(?:{lands})" + f"{sign}[0-9]" * n for n, lands in plans.items())
    lengths = "|".join(r"\+" + f"{sign}[0-9]" * n for n in range(8, 16))
    other = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[0-9]{4}(?: [0-9]{4}){3}(?![0-9])|[0-9]{4}(?:-[0-9]{4}){3}(?![0-9])"
    head, end = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?", "(?![0-9])"
    any_length = f"(?<={lengths}){end}"
    groups = "(?:[ .-]?[0-9]{2,4}){2,4}"
    return "|".join((
        f"{head}{groups}(?<={plan}){end}",
        rf"{head}(?:(?: (?!{other})|[.-]?)[0-9]{{2,4}}){{2,4}}{any_length}",
        f"{head}{groups}{any_length}",
    ))


PHONE = _phone_pattern()
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19})(?![0-9A-Za-z])"
#: In the order in which they are tried at one place.
PATTERNS = {"mail": MAIL, "iban": IBAN, "address": ADDRESS, "address6": ADDRESS6, "date": DATE, "social": SOCIAL, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _mixed(key: str, tweak: str, *parts: Column) -> Column:
    """60 bits of a cryptographic hash of the key and the parts, which without the key tell nothing of a value."""
    said = F.concat_ws("|", F.lit(f"{key}/{tweak}"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def permuted(value: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings with this pattern of digits, letters and other characters."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, turn: F.struct(
            F.when(turn % 2 == 1, _turned(s["l"], s["r"], key, turn, tweak)).otherwise(s["l"]).alias("l"),
            F.when(turn % 2 == 0, _turned(s["r"], s["l"], key, turn, tweak)).otherwise(s["r"]).alias("r"),
        ),
    )
    return F.concat(state["l"], state["r"])


def _turned(part: Column, other: Column, key: str, turn: Column, tweak: str) -> Column:
    def move(char: Column, i: Column) -> Column:
        by = _mixed(key, tweak, turn, i, other)
        at = F.ascii(char)

        def within(first: str, size: int) -> Column:
            return F.char(F.pmod(at - ord(first) + F.pmod(by, F.lit(size)), F.lit(size)) + ord(first))

        return (
            F.when(at.between(48, 57), within("0", 10))
            .when(at.between(97, 122), within("a", 26))
            .when(at.between(65, 90), within("A", 26))
            .otherwise(char)
        )

    return F.when(part == "", part).otherwise(F.array_join(F.transform(F.split(part, ""), move), ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced one after another."""
    def put(char: Column, i: Column) -> Column:
        before = F.length(_digits(F.substring(form, F.lit(1), i + 1)))
        return F.when(char.rlike("^[0-9]$"), F.substring(digits, before, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.split(form, ""), put), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits with every second doubled; ``doubled``: 1 to begin left of the last digit, 0 with the last."""
    def add(total: Column, pair: Column) -> Column:
        d = pair["d"].cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(pair["i"] % 2 == doubled, twice).otherwise(d)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string")
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _refilled(value, F.concat(body, check)))


def _mod97(text: Column) -> Column:
    """Remainder of an account number: letters count as 10 to 35."""
    def add(total: Column, char: Column) -> Column:
        at = F.ascii(char)
        return F.when(at <= 57, total * 10 + (at - 48)).otherwise(total * 100 + (at - 55)) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    """With and without blanks alike; blanks stand again where they stood."""
    whole = F.regexp_replace(value, " ", "")
    land, rest = F.substring(whole, 1, 2), F.substring(whole, F.lit(5), F.length(whole))
    valid = _mod97(F.concat(rest, land, F.substring(whole, 3, 2))) == 1
    new = permuted(rest, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    made = F.concat(land, check, new)
    return F.when(valid, F.when(value.contains(" "), F.regexp_replace(made, "(.{4})(?=.)", "$1 ")).otherwise(made))


def _address(value: Column, key: str) -> Column:
    """Octets in a Feistel network of two 16-bit halves."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct((octets[0] * 256 + octets[1]).alias("l"), (octets[2] * 256 + octets[3]).alias("r")),
        lambda s, turn: F.struct(
            s["r"].alias("l"),
            s["l"].bitwiseXOR(F.pmod(_mixed(key, "address", turn, s["r"]), F.lit(65536)).cast("int")).alias("r"),
        ),
    )
    parts = [F.floor(state["l"] / 256), state["l"] % 256, F.floor(state["r"] / 256), state["r"] % 256]
    return F.when(
        F.forall(octets, lambda o: o <= 255) & ~value.rlike(r"(^|\.)0[0-9]"),
        F.concat_ws(".", *[p.cast("int").cast("string") for p in parts]),
    )


def _address6(value: Column, key: str) -> Column:
    """All spellings of an address alike: eight groups in a Feistel network of two 64-bit halves.

    Without eight groups there must be a gap and from three to seven groups, one of them with a digit: ``a::b`` is a name.
    """
    sides = F.split(F.lower(value), "::", -1)
    groups = F.transform(sides, lambda side: F.filter(F.split(side, ":"), lambda g: g != ""))
    left, right = groups[0], F.coalesce(F.get(groups, F.lit(1)), F.array().cast("array<string>"))
    known = F.size(left) + F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - known), right)
    digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")

    def half(first: int) -> Column:
        return F.conv(F.substring(digits, first, 16), 16, -10).cast("long")

    def turned(s: Column, turn: Column) -> Column:
        low = F.pmod(_mixed(key, "address6", turn, s["r"], F.lit("low")), F.lit(16))
        by = F.shiftleft(_mixed(key, "address6", turn, s["r"], F.lit("high")), 4).bitwiseOR(low)
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(by).alias("r"))

    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(half(1).alias("l"), half(17).alias("r")), turned)
    new = F.lower(F.concat(F.lpad(F.hex(state["l"]), 16, "0"), F.lpad(F.hex(state["r"]), 16, "0")))
    parts = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda at: F.regexp_replace(F.substring(new, at, F.lit(4)), "^0{1,3}", ""))
    valid = ((F.size(sides) == 1) & (known == 8)) | ((F.size(sides) == 2) & known.between(3, 7))
    return F.when(valid & value.rlike("[0-9]"), F.array_join(parts, ":"))


def _day(day: Column, key: str) -> Column:
    """A day number below _DAYS moved to another: two digits groups of base 271 in turn, walked until in range."""
    base = 271  # 271 * 271 is the least square above _DAYS

    def once(x: Column) -> Column:
        state = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            F.struct(F.floor(x / base).cast("int").alias("l"), (x % base).cast("int").alias("r")),
            lambda s, turn: F.struct(
                s["r"].alias("l"),
                F.pmod(s["l"] + F.pmod(_mixed(key, "date", turn, s["r"]), F.lit(base)).cast("int"), F.lit(base)).alias("r"),
            ),
        )
        return state["l"] * base + state["r"]

    # 271 * 271 - _DAYS = 392 numbers are out of range; a walk through all of them ends inside
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(base * base - _DAYS + 1)),
        F.struct(day.cast("int").alias("x"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(
            F.transform(F.array(once(s["x"])), lambda x: F.struct(x.alias("x"), (x < _DAYS).alias("done")))[0]
        ),
    )["x"]


def _date(value: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for form, like in (("yyyy-MM-dd", "^[0-9]{4}-"), ("dd/MM/yyyy", "/"), ("dd.MM.yyyy", r"\.")):
        day = F.try_to_date(value, form)
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _day(number, key)), form)
        valid = day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
        out = F.when(value.rlike(like) & valid, new).otherwise(out)
    return out


def _social(value: Column, key: str) -> Column:
    valid = ~value.rlike("^(000|666|9)|-00-|-0000$")
    digits = permuted(_digits(value), key, "social")
    # walk until the pseudonym is valid too; a walk of this length stays outside about once in 10**60
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), _refilled(value, digits),
        lambda v, _: F.when(v.rlike("^(000|666|9)|-00-|-0000$"), _refilled(v, permuted(_digits(v), key, "social"))).otherwise(v),
    )
    return F.when(valid, walked)


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    land = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    land = F.when(land == "", F.substring(value, 1, 2)).otherwise(land)
    rest = F.substring(value, F.length(land) + 1, F.length(value))
    n = F.length(_digits(value))
    return F.when(n.between(8, 15), F.concat(land, _refilled(rest, permuted(_digits(rest), key, "phone"))))


def _mail(value: Column, key: str) -> Column:
    at = F.locate("@", value)
    return F.concat(permuted(F.substring(value, F.lit(1), at - 1), key, "mail"), F.substring(value, at, F.length(value)))


_MAKERS: dict[str, Callable[[Column, str], Column]] = {
    "mail": _mail, "iban": _iban, "address": _address, "address6": _address6, "date": _date, "social": _social, "phone": _phone, "card": _card,
}


def pseudonyms(found: Column, key: str) -> Column:
    """For each found value (kind, old, new); new is null where the value fails its check."""
    def made(value: Column) -> Column:
        new, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, pattern in reversed(PATTERNS.items()):
            is_kind = value.rlike(f"^(?:{pattern})$")
            new = F.when(is_kind, _MAKERS[name](value, key)).otherwise(new)
            kind = F.when(is_kind, F.lit(name)).otherwise(kind)
        return F.struct(kind.alias("kind"), value.alias("old"), new.alias("new"))

    return F.transform(found, made)


def replace_personal(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and a column ``personal``: an array of (kind, old, new) in order.

    Every other column stays as it is, a column named ``personal`` is replaced. ``new`` is null
    for values that fail their check; those stay in the text. A null text stays null and an empty one empty,
    with an empty array. Whole texts of any length; rows are independent, so repeated rows
    and ties need no rule; an empty table gives an empty one.
    """
    text = F.col(text_col).cast("string")
    # each kind needs a digit or an @: other texts skip the search
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = docs.withColumn("personal", F.coalesce(found, F.array().cast("array<string>")))
    step = step.withColumn("personal", F.when(F.size("personal") > 0, pseudonyms(F.col("personal"), key)).otherwise(
        F.array().cast("array<struct<kind:string,old:string,new:string>>")))
    between = F.split(text, ANY, -1)
    fill = F.concat(F.transform("personal", lambda p: F.coalesce(p["new"], p["old"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, fill, lambda a, b: F.concat(a, b)), "")
    return step.withColumn(text_col, F.when(F.size("personal") > 0, joined).otherwise(text))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, rewritten text, number of replaced values, and the new values by kind as text."""
    done = replace_personal(id_text(docs), key)
    changed = F.filter("personal", lambda p: p["new"].isNotNull())
    return done.select(
        "doc_id", "text", F.size(changed).cast("long").alias("n_replaced"),
        F.array_join(F.transform(changed, lambda p: F.concat_ws(":", p["kind"], p["new"])), ",").alias("replaced"),
    )
