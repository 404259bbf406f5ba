r"""Format-preserving Feistel pseudonyms for personal data [DataFrame functions only].

One pattern finds candidates; each is validated (Luhn, mod 97, octets, calendar, numbering plan) and then
permuted by a keyed Feistel network inside the set of valid values of its format: a card stays a card with a
correct check digit, a date a date, a phone number keeps its punctuation. The permutation depends on the key
and the value alone, so equal values get equal pseudonyms in every document, different ones different, and
the holder of the key can go back. Candidates that do not validate stay as they are.

A domain of a * b values is split into halves in [0, a) and [0, b), which take turns in adding a keyed hash
of the other modulo their size. That is a bijection for any a and b, so no cycle walking is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date", "secret")
#: Groups of digits that are walked in one step, so that a run of a million of them is not copied at each.
STRIDE = 256

# No group is repeated but possessively or a few times: others take a stack frame for each turn, and long texts would overflow it.
LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
EMAIL = rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}+@{LABEL}(?:\.{LABEL})++"
#: Lengths of account numbers by country; one of an unknown country takes what looks like it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI BJ DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV SN ML CI BF", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"[ ]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()]
IBAN = rf"(?:{'|'.join(_KNOWN)})(?![A-Za-z0-9_])|[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?"
NATIONAL = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2}"
#: Full addresses of eight groups, and shortened ones of three groups or more.
_HEX = r"[0-9A-Fa-f]{1,4}"
IP6 = rf"{_HEX}(?::{_HEX}){{7}}+|{_HEX}::{_HEX}(?::{_HEX}){{1,5}}+|{_HEX}(?::{_HEX}){{1,5}}+::(?:{_HEX}(?::{_HEX}){{0,4}}+)?"
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
WRITTEN = rf"[0-3]?[0-9] (?:{MONTH}) (?:19|20)[0-9]{{2}}|(?:{MONTH}) [0-3]?[0-9], (?:19|20)[0-9]{{2}}"
SECRET = r"[0-9a-f]{32,128}|[0-9A-F]{32,128}"
#: Keys that name their issuer, and values that are called secret; what comes before the value stays.
_NAMED = r"(?:sk|pk|rk)_(?:live|test)_|AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|(?:[Pp]assword|PASSWORD|passwd|pwd|api_?key|API_?KEY|access_?token|secret)[=:]"
TOKEN = rf"(?:{_NAMED})[A-Za-z0-9!#$%*+./@^_~-]{{6,256}}+"
#: What a run of digits does not go on into, as it is a candidate itself.
_NEXT = rf"(?!(?:{SSN}|{DATE}|{IP}|{NATIONAL}|{SECRET})(?![A-Za-z0-9_]))"
_CARD_NEXT = r"(?![0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -]|[0-9]{13})"
#: After a plus sign any country's number, of 8 to 15 digits; the trunk zero may stand in brackets.
PHONE = rf"{NATIONAL}|\+[1-9][0-9]{{0,2}}(?:[ ./-]?\([0-9]{{1,5}}\))?(?:(?:[ ./-]{_NEXT}{_CARD_NEXT})?[0-9]){{6,13}}"
#: All groups of digits parted by single spaces or dashes; cards are looked for inside, at the bounds of groups.
CARD = rf"(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z_@])(?:[ -]{_NEXT}[0-9]++(?![A-Za-z_@]))*+"
#: How cards are written, in the order of trial, and last a run of digits with any breaks.
CARD_FORMS = (
    r"[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", r"3[0-9]{3}([ -])[0-9]{6}\1[0-9]{4,5}", r"[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}",
    r"[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}", r"[2-6][0-9]{12,18}",
)
CARD_RUN = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Candidates in this order at each place; none begins or ends inside a longer run of letters and digits.
CANDIDATE = rf"(?<![A-Za-z0-9_+.-])(?:{EMAIL}|{TOKEN}|{SECRET}|{IBAN}|{SSN}|{DATE}|{WRITTEN}|(?<!:)(?:{IP6})(?!:)|{IP}(?!\.?[0-9])|{PHONE}|{CARD})(?![A-Za-z0-9_])"

#: 1900-01-01 to 2099-12-31 is 73,049 = 17 * 4,297 days.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)


def _let(value: Column, use) -> Column:
    """Binds a value so that its expression is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """struct(left, right) after the rounds; left in [0, a), right in [0, b)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(acc: Column, turn: Column) -> Column:
        hashed = lambda v: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}\x1f{kind}\x1f"), turn.cast("string"), F.lit("\x1f"), v.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")
        even = turn % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["left"] + hashed(acc["right"]) % a, a)).otherwise(acc["left"]).alias("left"),
            F.when(even, acc["right"]).otherwise(F.pmod(acc["right"] + hashed(acc["left"]) % b, b)).alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _zeros(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits; 1 to 36 of them."""

    def run(d: Column) -> Column:
        n = F.length(d)
        lefts = F.floor(n / 2).cast("int")
        rights = n - lefts
        size = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
        halves = feistel(F.substring(F.concat(F.lit("0"), d), F.lit(1), lefts + 1).cast("long"), F.substring(d, lefts + 1, rights).cast("long"), size(lefts), size(rights), key, kind)
        return _let(halves, lambda h: F.substring(F.concat(F.when(lefts > 0, _zeros(h["left"], lefts)).otherwise(F.lit("")), _zeros(h["right"], rights)), F.lit(1), n))

    return _let(digits, run)


def put_digits(shape: Column, digits: Column, which: str = "[0-9]") -> Column:
    """The digits of shape replaced in order; everything else stays."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike(which)
        return F.struct((acc["at"] + F.when(digit, 1).otherwise(0)).alias("at"), F.concat(acc["out"], F.when(digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum in which every second digit from the right, the last excepted, is doubled."""
    numbers = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(numbers, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def _valid_card(digits: Column) -> Column:
    return digits.rlike("^[2-6]") & (luhn_sum(digits) % 10 == 0)


def _one_card(match: Column, key: str) -> Column:
    """The first digit (the network's, 2 to 6) stays, the others are permuted, and the last makes the Luhn sum right."""

    def run(d: Column) -> Column:
        moved = permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")
        return _let(F.concat(F.substring(d, 1, 1), moved), lambda p: put_digits(match, F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string"))))

    return _let(digits_of(match), run)


def card(match: Column, key: str) -> Column:
    """struct(new, n): the run of digits with its n cards replaced; new is null if there is none.

    From group to group, what is written like a card and validates is one; so an expiry date or a code beside
    it does not matter. Only where no group begins such a card, stretches of up to 19 digits count whole.
    """

    def walk(pieces: Column, forms: tuple[str, ...], passing: bool) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))

        def step(acc: Column, i: Column) -> Column:
            head = F.regexp_replace(F.array_join(F.slice(pieces, i, F.lit(19)), ""), "^[ -]", "")
            lead = F.regexp_extract(F.element_at(pieces, i), "^[ -]?", 0)

            def found(h: Column) -> Column:
                made = F.array(*[F.regexp_extract(h, f"^(?:{f})(?![0-9])", 0) for f in forms])
                return F.get(F.filter(made, lambda m: (m != "") & (F.lit(passing) | _valid_card(digits_of(m)))), 0)

            def put(m: Column) -> Column:
                ok = _valid_card(digits_of(m)) if passing else F.lit(True)
                return F.when(m.isNull(), F.struct((i + 1).alias("at"), F.concat(acc["out"], F.element_at(pieces, i)).alias("out"), acc["n"].alias("n"))).otherwise(
                    _let(ok, lambda o: F.struct((i + F.size(F.split(m, "[ -]"))).alias("at"), F.concat(acc["out"], lead, F.when(o, _one_card(m, key)).otherwise(m)).alias("out"), (acc["n"] + F.when(o, 1).otherwise(0)).alias("n")))
                )

            return F.when(i < acc["at"], acc).otherwise(_let(_let(head, found), put))

        def stride(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.sequence(k, F.least(k + (STRIDE - 1), F.size(pieces))), F.struct(acc["at"].alias("at"), F.lit("").alias("out"), acc["n"].alias("n")), step)
            return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out"), r["n"].alias("n")))

        return F.aggregate(F.sequence(F.lit(1), F.size(pieces), F.lit(STRIDE)), start, stride, lambda acc: F.struct(F.when(acc["n"] > 0, acc["out"]).alias("new"), acc["n"].alias("n")))

    pieces = F.regexp_extract_all(match, F.lit("[ -]?[0-9]+"), F.lit(0))
    return _let(pieces, lambda p: _let(walk(p, CARD_FORMS, False), lambda w: F.when(w["n"] > 0, w).otherwise(walk(p, (CARD_RUN,), True))))


def _mod97(text: Column) -> Column:
    """Of an account number whose letters count as 10 to 35."""
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))


def iban(match: Column, key: str) -> Column:
    """The digits of the account are permuted, letters stay, and the check digits are made right again."""

    def run(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, 5, 60)
        moved = _let(digits_of(account), lambda d: F.when(F.length(d) > 0, put_digits(account, permute_digits(d, key, "iban"))).otherwise(account))
        checked = lambda m: put_digits(match, digits_of(F.concat(_zeros(98 - _mod97(F.concat(m, country, F.lit("00"))), 2), m)))
        valid = _mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
        return F.when(valid & F.length(plain).between(15, 34), _let(moved, checked))

    return _let(F.replace(match, F.lit(" "), F.lit("")), run)


def phone(match: Column, key: str) -> Column:
    """The digits after the country code, without one all ten; the code, a trunk zero in brackets and all punctuation stay."""

    def run(d: Column) -> Column:
        code = F.length(F.regexp_extract(d, COUNTRY, 0)) + F.when(F.contains(match, F.lit("(0)")), 1).otherwise(0)
        fixed = F.when(F.startswith(match, F.lit("+")), code).otherwise(F.length(d) - 10)
        return _let(fixed, lambda n: put_digits(match, F.concat(F.substring(d, F.lit(1), n), permute_digits(F.substring(d, n + 1, F.length(d)), key, "phone"))))

    return _let(digits_of(match), run)


def ssn(match: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""

    def run(d: Column) -> Column:
        area, group, serial = (F.substring(d, *x).cast("long") for x in ((1, 3), (4, 2), (6, 4)))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        halves = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        back = lambda h: F.concat(_zeros(h["left"] + F.when(h["left"] >= 665, 2).otherwise(1), 3), _zeros(F.floor(h["right"] / 9999) + 1, 2), _zeros(h["right"] % 9999 + 1, 4))
        return F.when(ok, _let(halves, lambda h: put_digits(match, back(h))))

    return _let(digits_of(match), run)


def ip(match: Column, key: str) -> Column:
    """Any of the 2 ** 32 addresses, written without leading zeros. Of long addresses the hexadecimal digits move, the colons stay."""

    def run(p: Column) -> Column:
        part = lambda i: F.element_at(p, i).cast("long")
        ok = F.forall(p, lambda x: x.cast("int") <= 255)
        halves = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ip")
        octets = lambda h: F.concat_ws(".", *[f(h[s]).cast("string") for s in ("left", "right") for f in (lambda v: F.floor(v / 256), lambda v: v % 256)])
        return F.when(ok, _let(halves, octets))

    def long(digits: Column) -> Column:
        return put_digits(match, permute_text(digits, key, "secret"), "[0-9A-Fa-f]")

    return F.when(F.contains(match, F.lit(":")), _let(F.lower(F.replace(match, F.lit(":"), F.lit(""))), long)).otherwise(_let(F.split(match, r"\."), run))


def date(match: Column, key: str) -> Column:
    """A day of the two centuries, in the format it came in: year first, or day before month, or month before day.

    With slashes the first number is the month if it can be, with dots it is the day; a value that is no day
    of the calendar is not a date. Written dates have the month's English name.
    """
    worded, name_first = match.rlike("[A-Z]"), match.rlike("^[A-Z]")
    iso = F.substring(match, 5, 1) == "-"
    dotted = F.substring(match, 3, 1) == "."
    one, two, year = F.substring(match, 1, 2), F.substring(match, 4, 2), F.substring(match, 7, 4)
    day_first = dotted | (one.cast("int") > 12)
    plain = F.when(iso, match).when(day_first, F.concat_ws("-", year, two, one)).otherwise(F.concat_ws("-", year, one, two))

    def run(day: Column) -> Column:
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        halves = feistel(F.floor(number / DAY_PARTS[1]), number % DAY_PARTS[1], *DAY_PARTS, key, "date")
        new = _let(halves, lambda h: F.date_add(F.lit(FIRST_DAY).cast("date"), (h["left"] * DAY_PARTS[1] + h["right"]).cast("int")))
        sep = F.substring(match, 3, 1)
        both = lambda a, b: lambda d: F.concat(F.date_format(d, a), sep, F.date_format(d, b), sep, F.date_format(d, "yyyy"))
        written = lambda d: F.when(name_first, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "d MMMM yyyy"))
        return _let(new, lambda d: F.when(worded, written(d)).when(iso, F.date_format(d, "yyyy-MM-dd")).when(day_first, both("dd", "MM")(d)).otherwise(both("MM", "dd")(d)))

    read = F.when(name_first, F.try_to_date(match, "MMMM d, yyyy")).when(worded, F.try_to_date(match, "d MMMM yyyy")).otherwise(F.try_to_date(plain, "yyyy-MM-dd"))
    return _let(read, lambda d: F.when(d.isNotNull(), run(d)))


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A string of the same length and classes of characters: digits, lower- and upper-case letters move
    within their class, others stay (of a secret, hexadecimal digits among each other). Its halves take turns in shifting by a key stream made from the other."""
    move = lambda c, by, low, n: F.char(F.pmod(F.ascii(c) - low + by, F.lit(n)) + low)

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        stream = lambda block: F.sha2(F.concat(F.lit(f"{key}\x1f{kind}\x1f"), turn.cast("string"), F.lit("\x1f"), block.cast("string"), F.lit("\x1f"), other).cast("binary"), 256)
        blocks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(part) / 16).cast("int")), stream), "")
        chars = F.filter(F.split(part, ""), lambda c: c != "")

        def one(hexed: Column):
            def go(c: Column, i: Column) -> Column:
                by = F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
                if kind == "secret":
                    return F.lower(F.hex(F.pmod(F.conv(c, 16, 10).cast("int") + by, F.lit(16))))
                return F.when(c.rlike("[0-9]"), move(c, by, 48, 10)).when(c.rlike("[a-z]"), move(c, by, 97, 26)).when(c.rlike("[A-Z]"), move(c, by, 65, 26)).otherwise(c)

            return go

        return F.when(F.length(part) == 0, part).otherwise(_let(blocks, lambda h: F.array_join(F.transform(chars, one(h)), "")))

    def run(t: Column) -> Column:
        lefts = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substring(t, F.lit(1), lefts).alias("left"), F.substring(t, lefts + 1, F.length(t)).alias("right"))

        def step(acc: Column, turn: Column) -> Column:
            even = turn % 2 == 0
            return F.struct(F.when(even, shifted(acc["left"], acc["right"], turn)).otherwise(acc["left"]).alias("left"), F.when(even, acc["right"]).otherwise(shifted(acc["right"], acc["left"], turn)).alias("right"))

        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda acc: F.concat(acc["left"], acc["right"]))

    return _let(text, run)


def email(match: Column, key: str) -> Column:
    """The local part moves; the domain stays, as it tells a provider and not a person."""
    local = F.substring_index(match, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(match, F.length(local) + 1, F.length(match)))


def secret(match: Column, key: str) -> Column:
    """Hexadecimal keys: every digit moves among the sixteen, the case stays. Of named ones the value's letters and
    digits move within their classes."""
    lead = F.regexp_extract(match, f"^(?:{_NAMED})", 0)
    moved = permute_text(F.lower(match), key, "secret")
    named = F.concat(lead, permute_text(F.substring(match, F.length(lead) + 1, F.length(match)), key, "token"))
    return F.when(lead != "", named).when(match.rlike("[A-F]"), F.upper(moved)).otherwise(moved)


def classify(match: Column) -> Column:
    tests = [("email", EMAIL), ("secret", f"{TOKEN}|{SECRET}"), ("iban", IBAN), ("ssn", SSN), ("date", f"{DATE}|{WRITTEN}"), ("ip", f"{IP6}|{IP}"), ("phone", PHONE), ("card", CARD)]
    return reduce(lambda rest, t: F.when(match.rlike(f"^(?:{t[1]})$"), F.lit(t[0])).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """struct(new, n): the pseudonym of a candidate, or null if nothing in it validates, and how many values it replaces."""
    made = {"email": email, "secret": secret, "iban": iban, "ssn": ssn, "date": date, "ip": ip, "phone": phone}
    one = reduce(lambda rest, k: F.when(kind == k, made[k](match, key)).otherwise(rest), made, F.lit(None).cast("string"))
    counted = _let(one, lambda v: F.struct(v.alias("new"), F.when(v.isNull(), 0).otherwise(1).alias("n")))
    return F.when(kind == "card", card(match, key)).otherwise(counted)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text with pseudonyms, n_found, one count n_<kind> for each kind, and
    n_invalid (candidates left alone).

    A null text stays null with counts of 0, an empty one empty; repeated rows are treated alike; an empty
    table gives no rows. Other columns are not read.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = text.rlike("[0-9@=:]")
    rows = rows.withColumn("__found", F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    values = F.transform(F.col("__found"), lambda m: _let(classify(m), lambda k: _let(pseudonym(m, k, key), lambda v: F.struct(m.alias("old"), k.alias("kind"), v["new"].alias("new"), v["n"].alias("n")))))
    rows = rows.withColumn("__values", F.when(F.size("__found") > 0, values).otherwise(F.array().cast("array<struct<old:string,kind:string,new:string,n:int>>")))
    parts = F.split(text, CANDIDATE)
    pieces = F.zip_with(parts, F.col("__values"), lambda p, v: F.concat(p, F.coalesce(v["new"], v["old"], F.lit(""))))
    count = lambda test: F.size(F.filter(F.col("__values"), test)).cast("long")
    of_kind = lambda k: lambda v: v["kind"] == k
    total = lambda test: F.aggregate(F.filter(F.col("__values"), test), F.lit(0), lambda a, v: a + v["n"]).cast("long")
    return rows.select(
        "doc_id", F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text).alias("text"),
        total(lambda v: v["new"].isNotNull()).alias("n_found"),
        *[total(of_kind(k)).alias(f"n_{k}") for k in KINDS],
        count(lambda v: v["new"].isNull()).alias("n_invalid"),
    )
