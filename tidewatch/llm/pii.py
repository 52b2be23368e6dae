"""Format-preserving pseudonyms for personal data, in DataFrame functions.

Personal data are found by pattern, validated (check digits, calendar dates,
octets), and permuted inside their own format by a keyed Feistel network, so the
result is valid again, and equal values stay equal in every document while
different ones stay different.

The network works on strings of any length: each character has an alphabet (its
*mask* letter), the characters that may change are dealt in two halves, and in
each round one half is shifted, character by character and modulo its alphabet,
by a key stream drawn from the other half.  Each round can be undone, so the
whole is a permutation of the strings of one mask.  Dates are permuted by their
day in a 400-year cycle, addresses by their octets, social security numbers by
their place among the valid ones.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KEY_SETTING = "spark.tidewatch.pii.key"


@lru_cache(1)
def _own_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The secret key of a session: its setting ``spark.tidewatch.pii.key``.

    Where that is unset, a random key that holds for this driver process and is
    kept nowhere: values stay linked within an application, and the next one gives
    others.
    """
    return spark.conf.get(KEY_SETTING, None) or _own_key()

#: Mask letters and their alphabets; any other mask letter leaves its character as it is.
ALPHABETS = {
    "d": "0123456789",
    "n": "23456789",
    "b": "01",
    "l": "abcdefghijklmnopqrstuvwxyz",
    "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "h": "0123456789abcdef",
    "H": "0123456789ABCDEF",
    "a": "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß",
    "A": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
}

# Patterns; each is a whole value between characters that can't continue it.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Each starts at few places and looks a bounded way ahead, so time is linear in the text (names up to 256 characters, domains of up to 126 labels of 63).
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,255}+@(?:[\p{L}\p{N}][\p{L}\p{N}\-]{0,62}+(?<!-)\.){1,126}\p{L}{2,63}"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
DATE = r"(?<![\d./\-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/\-]|\.\d)"
SSN = r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])\+?1?[ .\-]?\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+\-.])(?:\+?1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}(?![\d\-])|(?<![\d+])\+[1-9](?:[ .\-]?\d){7,13}(?!\d)"
CARD = r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-]|\.\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])"

#: Kinds in order of precedence.  SSN, IP and date come before phone, whose pattern is wider.
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "ssn": SSN, "secret": SECRET, "iban": IBAN, "phone": PHONE, "card": CARD}


def _combined() -> str:
    parts, groups = [], 0
    for p in KINDS.values():
        own = p.replace("\\1", f"\\{groups + 1}") if "\\1" in p else p
        groups += "([.\\-])" in p
        parts.append(f"(?:{own})")
    return "|".join(parts)


PATTERN = _combined()


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _stream(secret: Column, n: Column) -> Column:
    """``n`` numbers below 2**16 from a secret string."""
    blocks = F.transform(F.sequence(F.lit(0), (F.greatest(n - 1, F.lit(0)) / 32).cast("int")), lambda k: F.sha2(F.concat(secret, F.lit("|"), k.cast("int").cast("string")), 512))
    return F.array_join(blocks, "")


def _shift(half: Column, alphabets: Column, stream: Column) -> Column:
    """Each symbol number of a half moved by the stream, modulo its alphabet."""
    return F.transform(
        half, lambda v, i: ((v + F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")) % F.element_at(alphabets, i + 1)).cast("int")
    )


def _round(key: Column, mask: Column, state: Column, sizes: tuple[Column, Column], r: Column) -> Column:
    """One Feistel round on struct(x, y): x moves by what y gives, then they swap."""
    even = (r % 2) == 0
    x, y = state["x"], state["y"]
    alphabets = F.when(even, sizes[0]).otherwise(sizes[1])
    secret = F.concat(key, F.lit("|"), mask, F.lit("|"), r.cast("string"), F.lit("|"), F.array_join(F.transform(y, lambda v: v.cast("string")), ","))
    return _let(_stream(secret, F.size(x)), lambda s: F.struct(y.alias("x"), _shift(x, alphabets, s).alias("y")))


def permute(value: Column, mask: Column, key: Column) -> Column:
    """The keyed permutation of ``value`` among the strings of ``mask``.

    ``mask`` is as long as ``value``, one letter of :data:`ALPHABETS` for each
    character that may change and anything else for one that stays.  With one
    changeable character or none the first half is empty; the permutation is then
    a shift, or the value itself.
    """
    names = F.lit("".join(ALPHABETS))
    books = F.array(*[F.lit(a) for a in ALPHABETS.values()])

    def run(m: Column) -> Column:
        places = F.transform(F.split(m, ""), lambda c, i: F.struct(F.instr(names, c).alias("book"), i.alias("at")))

        def with_free(fr: Column) -> Column:
            numbers = F.transform(fr, lambda s: (F.instr(F.element_at(books, s["book"]), F.substr(value, s["at"] + 1, F.lit(1))) - 1).cast("int"))
            sizes = F.transform(fr, lambda s: F.char_length(F.element_at(books, s["book"])))
            half = (F.size(fr) / 2).cast("int")

            def with_numbers(p: Column) -> Column:
                left, right = F.slice(p["numbers"], F.lit(1), half), F.slice(p["numbers"], half + 1, F.size(fr) - half)
                a, b = F.slice(p["sizes"], F.lit(1), half), F.slice(p["sizes"], half + 1, F.size(fr) - half)
                rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
                done = F.reduce(rounds, F.struct(left.alias("x"), right.alias("y")), lambda acc, r: _round(key, m, acc, (a, b), r))
                return F.concat(done["x"], done["y"])  # an even number of rounds: the halves are back in place

            def put_back(moved: Column) -> Column:
                chars = F.transform(fr, lambda s, i: F.struct(s["at"].alias("at"), F.substr(F.element_at(books, s["book"]), F.element_at(moved, i + 1) + 1, F.lit(1)).alias("c")))
                lookup = F.map_from_entries(chars)
                return _let(lookup, lambda mp: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.coalesce(F.try_element_at(mp, i), c)), ""))

            return F.when(F.size(fr) == 0, value).otherwise(_let(_let(F.struct(numbers.alias("numbers"), sizes.alias("sizes")), with_numbers), put_back))

        return _let(F.filter(places, lambda s: s["book"] > 0), with_free)

    return _let(mask, run)


def class_mask(value: Column) -> Column:
    """The mask that lets each letter and digit move among its own kind."""
    out = F.translate(value, ALPHABETS["l"], "l" * 26)
    out = F.translate(out, ALPHABETS["u"], "u" * 26)
    out = F.translate(out, ALPHABETS["a"], "a" * len(ALPHABETS["a"]))
    out = F.translate(out, ALPHABETS["A"], "A" * len(ALPHABETS["A"]))
    return F.translate(out, ALPHABETS["d"], "d" * 10)


def permute_pair(x: Column, y: Column, sizes: tuple[int | Column, int | Column], key: str) -> Column:
    """struct(x, y): the keyed permutation of the pairs with x < sizes[0] and
    y < sizes[1], by a Feistel network over the two numbers."""

    def step(acc: Column, r: Column) -> Column:
        even = (r % 2) == 0
        secret = F.concat(F.lit(key + "|"), r.cast("string"), F.lit("|"), F.when(even, acc["y"]).otherwise(acc["x"]).cast("string"))
        by = F.conv(F.substr(F.sha2(secret, 256), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.struct(
            F.when(even, (acc["x"] + by) % sizes[0]).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise((acc["y"] + by) % sizes[1]).alias("y")
        )

    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _email_mask(v: Column) -> Column:
    head = F.regexp_replace(v, r"[^.@]+\.[^.@]+$", "")  # all but the registered domain
    return F.concat(class_mask(head), F.repeat(F.lit("="), F.char_length(v) - F.char_length(head)))


def _ip(v: Column, key: str) -> Column:
    """Each octet keeps its number of digits: 0-9, 10-99 or 100-255."""

    def of(parts: Column) -> Column:
        digits = [F.char_length(parts[k]) for k in range(4)]
        low = [F.when(n == 1, 0).when(n == 2, 10).otherwise(100) for n in digits]
        count = [F.when(n == 1, 10).when(n == 2, 90).otherwise(156) for n in digits]
        at = [parts[k].cast("int") - low[k] for k in range(4)]
        pair = permute_pair(at[0] * count[1] + at[1], at[2] * count[3] + at[3], (count[0] * count[1], count[2] * count[3]), f"{key}|ip")
        octets = lambda q: [F.floor(q["x"] / count[1]) + low[0], q["x"] % count[1] + low[1], F.floor(q["y"] / count[3]) + low[2], q["y"] % count[3] + low[3]]
        return _let(pair, lambda q: F.concat_ws(".", *[n.cast("int").cast("string") for n in octets(q)]))

    return _let(F.split(v, "\\."), of)


#: Days of the 400-year cycle of the calendar, as two factors; the cycle the dates of our time lie in.
CYCLE, CYCLE_START = (189, 773), "1800-01-01"


def _ssn(v: Column, key: str) -> Column:
    """Another valid number: its place among the 898 areas (1 to 899 but 666)
    times 99 groups, and among the 9,999 serials."""

    def of(parts: Column) -> Column:
        area, group, serial = (parts[k].cast("int") for k in range(3))
        pair = permute_pair((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, (898 * 99, 9999), f"{key}|ssn")

        def put(q: Column) -> Column:
            at = F.floor(q["x"] / 99) + 1
            moved = at + F.when(at >= 666, 1).otherwise(0)
            numbers = ((moved, 3), (q["x"] % 99 + 1, 2), (q["y"] + 1, 4))
            return F.concat_ws("-", *[F.lpad(n.cast("string"), width, "0") for n, width in numbers])

        return _let(pair, put)

    return _let(F.split(v, "-"), of)


def _date_as(v: Column, form: str, key: str) -> Column:
    """The date of another day of its 400-year cycle, or null if ``v`` is none."""
    days = CYCLE[0] * CYCLE[1]
    since = F.date_diff(F.try_to_date(v, form), F.to_date(F.lit(CYCLE_START)))
    at = F.pmod(since, F.lit(days))
    pair = permute_pair((at / CYCLE[1]).cast("long"), at % CYCLE[1], CYCLE, f"{key}|date")
    return _let(pair, lambda q: F.date_format(F.date_add(F.to_date(F.lit(CYCLE_START)), (since - at + q["x"] * CYCLE[1] + q["y"]).cast("int")), form))


def _date(v: Column, key: str) -> Column:
    """Slash dates are read month first, else day first; what is no date stays."""
    forms = [(r"^\d{4}-", "yyyy-MM-dd"), (r"\.", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy")]
    return F.coalesce(*[F.when(v.rlike(like), _date_as(v, form, key)) for like, form in forms], v)


def _secret_mask(v: Column) -> Column:
    lead = F.regexp_extract(v, "^(AKIA|ASIA|gh[pousr]_|sk-)", 1)
    named = F.concat(F.repeat(F.lit("="), F.char_length(lead)), class_mask(F.substr(v, F.char_length(lead) + 1)))
    return F.when(lead != "", named).otherwise(F.repeat(F.when(v.rlike("[a-f]"), "h").otherwise("H"), F.char_length(v)))


def _remainder_97(v: Column) -> Column:
    """An account number (letters as 10 to 35) modulo 97."""
    chars = F.split(v, "")
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.reduce(F.transform(chars, digit), F.lit(0), lambda acc, d: ((acc * F.when(d > 9, 100).otherwise(10) + d) % 97).cast("int"))


def _phone_mask(v: Column) -> Column:
    """North American numbers stay valid, and of area code and exchange a first
    digit 0 or 1 stays one of the two; of others the country's digits stay."""
    american = r"^((?:\+1|1(?=[ .\-(])|\+(?=[ .\-]?\())?[ .\-]?\(?)(\d)\d\d(\)? ?[ .\-]?)(\d)\d\d([ .\-])\d{4}$"
    part = lambda k: F.regexp_extract(v, american, k)
    first = lambda c: F.when(c < "2", "b").otherwise("n")
    other = F.concat(F.lit("==="), F.regexp_replace(F.substr(v, F.lit(4)), r"\d", "d"))
    masked = F.concat(part(1), first(part(2)), F.lit("dd"), part(3), first(part(4)), F.lit("dd"), part(5), F.lit("dddd"))
    return F.when(v.rlike(american), masked).otherwise(other)


def _card_mask(v: Column) -> Column:
    """All digits but the first, and the check digit, which follows."""
    return F.concat(F.lit("="), F.regexp_replace(F.substr(v, F.lit(2), F.char_length(v) - 2), r"\d", "d"), F.lit("="))


def _card_valid(v: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(v, r"\D", F.lit("")))


def _card_closed(moved: Column) -> Column:
    """A card number with the check digit its other digits ask for."""
    head = F.left(moved, F.char_length(moved) - 1)
    digits = F.transform(F.split(F.reverse(F.regexp_replace(head, r"\D", "")), ""), lambda c: c.cast("int"))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    total = F.reduce(each, F.lit(0), lambda acc, d: acc + d)
    return F.concat(head, ((10 - total % 10) % 10).cast("string"))


def _iban_body(v: Column) -> Column:
    return F.substr(F.replace(v, F.lit(" "), F.lit("")), F.lit(5))


def _iban_valid(v: Column) -> Column:
    return _remainder_97(F.concat(_iban_body(v), F.left(v, F.lit(4)))) == 1


def _iban_closed(moved: Column) -> Column:
    """An account number with the check digits its other characters ask for."""
    country = F.left(moved, F.lit(2))
    check = (98 - _remainder_97(F.concat(_iban_body(moved), country, F.lit("00")))).cast("string")
    return F.concat(country, F.lpad(check, 2, "0"), F.substr(moved, F.lit(5)))


def pseudonym(match: Column, key: str) -> Column:
    """struct(kind, value): a found value under its pseudonym.  What fails the
    check of its kind keeps its value."""
    named = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        named = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(named)

    def of_kind(kind: Column) -> Column:
        mask = (
            F.when(kind == "email", _email_mask(match))
            .when(kind == "secret", _secret_mask(match))
            .when((kind == "iban") & _iban_valid(match), F.concat(F.lit("===="), class_mask(F.substr(match, F.lit(5)))))
            .when(kind == "phone", _phone_mask(match))
            .when((kind == "card") & _card_valid(match), _card_mask(match))
        )

        def masked(m: Column) -> Column:
            moved = permute(match, m, F.concat(F.lit(key + "|"), kind))
            return _let(moved, lambda v: F.when(kind == "card", _card_closed(v)).when(kind == "iban", _iban_closed(v)).otherwise(v))

        value = F.when(kind == "ip", _ip(match, key)).when(kind == "date", _date(match, key)).when(kind == "ssn", _ssn(match, key)).otherwise(_let(mask, lambda m: F.when(m.isNull(), match).otherwise(masked(m))))
        return F.struct(kind.alias("kind"), value.alias("value"))

    return _let(named, of_kind)


def pseudonymise_text(text: Column, key: str) -> Column:
    """struct(text, kinds): the text with its personal data under pseudonyms, and
    the kind of each value that changed, in order."""
    found = F.when(text.rlike("[0-9@]|AKIA|ASIA|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))

    def put(ms: Column) -> Column:
        made = F.transform(ms, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
        both = F.struct(made.alias("made"), F.split(text, PATTERN, -1).alias("between"))

        def join(b: Column) -> Column:
            q, between = b["made"], b["between"]
            whole = F.concat(between[0], F.array_join(F.transform(q, lambda m, i: F.concat(m["new"]["value"], F.element_at(between, i + 2))), ""))
            changed = F.filter(q, lambda m: m["old"] != m["new"]["value"])
            return F.struct(whole.alias("text"), F.transform(changed, lambda m: m["new"]["kind"]).alias("kinds"))

        return F.when(F.size(ms) == 0, nothing).otherwise(_let(both, join))

    return _let(found, put)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` under pseudonyms.

    All other columns stay as they are, whatever their names.  Null text stays
    null; a text without personal data stays as it is; equal values get equal
    pseudonyms in every row; an empty table stays empty.  Time is linear in the
    text, and a row is one value, so a very long text is worked on in one task.
    The ``key`` must be kept secret (see :func:`session_key`): whoever has it can
    undo the permutation.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    return docs.withColumn(text_col, pseudonymise_text(F.col(text_col), key)["text"])


def pseudonym_report(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_found, kinds`` of every document; kinds is the sorted
    list of what was found, comma-separated (empty: nothing).

    Null text stays null with nothing found; null and repeated ids are rows each;
    columns besides doc_id and text are ignored; an empty table gives no row.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    done = docs.select("doc_id", pseudonymise_text(F.col("text"), key).alias("done"))
    kinds = F.coalesce(F.col("done.kinds"), F.array().cast("array<string>"))
    return done.select("doc_id", F.col("done.text").alias("text"), F.size(kinds).cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))
