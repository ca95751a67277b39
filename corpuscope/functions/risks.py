"""Sensitive-data counters. Only counts leave these expressions, never the text.

Every counter runs behind a cheap test (a substring or one digit-run scan), so
ordinary documents pay for the tests and not for the patterns.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rulepack import (
    CARD_CONTEXT,
    CONTRACT_TERMS,
    DISTRIBUTION_BANS,
    HIGH_IMPACT,
    ID_CHECKS,
    ID_WEIGHTS,
    RISK_ORDER,
    SALARY_TERMS,
    SECRECY_LABELS,
    SECRECY_LEVELS,
)
from .normalize import SPACE_CLASS

# \d means any Unicode decimal digit, hence (?U); (?d) keeps ^ and $ at \n only.
# Each pattern starts with what few positions hold; what must precede is looked at after that.
PHONE = r"(?U)1(?<!\d1)[3-9]\d{9}(?!\d)"
ID_NUMBER = r"(?U)(?=\d)(?<!\d)(?:\d{17}[0-9Xx]|\d{15})(?!\d)"
BANK_CARD = r"(?U)(?=\d)(?<!\d)(?:\d[ -]?){15,19}(?!\d)"
CARD_WORDS = CARD_CONTEXT
CARD_WINDOW = 18

# The letters a case-insensitive [A-Z] accepts in Unicode text.
_AZ = r"A-Za-z\u0130\u0131\u017f\u212a"
# An address is told by its at sign and what follows. Before that sign stands a character of a
# local part that no earlier address has taken, so the sign does not stand where one ended.
EMAIL = rf"@(?<=[{_AZ}0-9._%+-]@)(?<!\G@)[{_AZ}0-9.-]+\.[{_AZ}]{{2,}}(?![{_AZ}0-9_.-])"

_S = f"[{SPACE_CLASS}]*"
_LINE_S = "[" + SPACE_CLASS.replace(r"\t-\r", r"\t\x0b-\r") + "]*"
_LEVEL = f"(?:{'|'.join(SECRECY_LEVELS)})"
SECRECY = (
    "(?Udm)"
    + f"(?:{SECRECY_LABELS}){_S}[:：]{_S}{_LEVEL}"
    + rf"|^{_LINE_S}[【\[]?{_LEVEL}[】\]]?{_S}[★☆]{_S}(?:\d+年)?{_S}$"
    + f"|^{_LINE_S}(?:{DISTRIBUTION_BANS}){_S}$"
)
_RMB = "[Rr][Mm][Bb]"
SALARY = (
    f"(?U)(?:{SALARY_TERMS})"
    + rf"[^\n。；;]{{0,20}}(?:\d[\d,.]*{_S}(?:元|万元|人民币|{_RMB}|￥|¥))"
)
# Possessive white space: neighbouring runs would otherwise retry each other.
_P = _S + "+"
CONTRACT = (
    f"(?U)(?:{CONTRACT_TERMS})"
    + rf"{_P}(?:为|是|[:：=]){_P}(?:人民币{_P})?(?:{_RMB}{_P})?[￥¥]?{_P}"
    + rf"(?:\d[\d,.]*{_P}(?:万元|元)|[￥¥]{_P}\d[\d,.]*)"
)

_DIGITS = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd" and c > 0x7F]
_DIGIT_FROM = "".join(_DIGITS)
_DIGIT_TO = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)


def ascii_digits(value: Column) -> Column:
    """Any Unicode decimal digit to 0-9."""
    return F.when(value.rlike(r"\A[\x00-\x7f]*\z"), value).otherwise(
        F.translate(value, _DIGIT_FROM, _DIGIT_TO)
    )


def _guarded(guard: Column, count: Column) -> Column:
    return F.when(guard, count).otherwise(F.lit(0))


def _any_of(text: Column, *words: str) -> Column:
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def has_digit_run(text: Column, odd: Column | None = None, far: Column | None = None) -> Column:
    """Eleven digits in a row. Text that is not odd has no digits but the ASCII and
    full-width ones, which makes a cheaper class; with ``far``, the far residue, any text
    with a full-width digit passes the test."""
    any_script = text.rlike(r"[[^\x00-/:-\x7f]&&[[^\x{3400}-\x{9fff}]&&\p{Nd}]]{11}")
    if odd is None:
        return any_script
    wide = r"\x{ff10}-\x{ff19}"
    if far is None:
        return F.when(odd, any_script).otherwise(text.rlike(f"[0123456789{wide}]{{11}}"))
    return F.when(odd, any_script).otherwise(text.rlike("[0123456789]{11}") | far.rlike(f"[{wide}]"))


def phone_count(text: Column, digit_run: Column | None = None) -> Column:
    guard = has_digit_run(text) if digit_run is None else digit_run
    return _guarded(guard, F.regexp_count(text, F.lit(PHONE)))


def valid_id(value: Column) -> Column:
    """15 digits, or 18 characters whose weighted mod-11 check character agrees."""
    plain = ascii_digits(value)
    weights = F.array(*[F.lit(w) for w in ID_WEIGHTS])
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(17)),
        F.lit(0),
        lambda acc, i: acc + F.substr(plain, i, F.lit(1)).cast("int") * F.element_at(weights, i),
    )
    expected = F.substr(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1))
    return F.when(F.length(value) == 15, F.lit(True)).otherwise(F.upper(F.right(value, F.lit(1))) == expected)


def id_count(text: Column, digit_run: Column | None = None) -> Column:
    guard = has_digit_run(text) if digit_run is None else digit_run
    found = F.regexp_extract_all(text, F.lit(ID_NUMBER), F.lit(0))
    return _guarded(guard, F.size(F.filter(found, valid_id)))


def valid_card(value: Column) -> Column:
    """16-19 digits, not all the same, with a correct Luhn sum."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    return (
        F.length(digits).between(16, 19)
        & ~digits.rlike(r"\A(.)\1*\z")
        & F.call_function("luhn_check", ascii_digits(digits))
    )


def card_count(text: Column, rest: Column | None = None) -> Column:
    """Valid card numbers with a card word within 18 characters on either side.

    The text between the numbers comes from splitting at the same pattern. A
    number has 15 or more characters, so its 18-character surroundings reach at
    most over one neighbouring number into the piece beyond it."""
    numbers = F.regexp_extract_all(text, F.lit(BANK_CARD), F.lit(0))
    pieces = F.split(text, BANK_CARD)

    def at(array: Column, i: Column) -> Column:
        return F.coalesce(F.get(array, i), F.lit(""))

    def near(cut: Column, i: Column) -> Column:
        numbers, pieces = cut["numbers"], cut["pieces"]
        before = F.concat(at(pieces, i - 1), at(numbers, i - 1), at(pieces, i))
        after = F.concat(at(pieces, i + 1), at(numbers, i + 1), at(pieces, i + 2))
        return F.right(before, F.lit(CARD_WINDOW)).rlike(CARD_WORDS) | F.left(
            after, F.lit(CARD_WINDOW)
        ).rlike(CARD_WORDS)

    # The text is cut once, in an array of one; inside the lambda of the numbers it would be
    # cut again for each of them.
    cuts = F.array(F.struct(numbers.alias("numbers"), pieces.alias("pieces")))
    valid = F.transform(
        cuts,
        lambda cut: F.size(
            F.filter(F.transform(cut["numbers"], lambda n, i: valid_card(n) & near(cut, i)), lambda hit: hit)
        ),
    )
    # The residue keeps all ideographs in their order, so a text has no card word that it lacks.
    seen = text if rest is None else rest
    guard = _any_of(seen, "卡", "账") & seen.rlike(CARD_WORDS) & text.rlike(BANK_CARD)
    return _guarded(guard, F.get(valid, F.lit(0)))


def email_count(text: Column, rest: Column | None = None) -> Column:
    return _guarded(_any_of(text if rest is None else rest, "@"), F.regexp_count(text, F.lit(EMAIL)))


def secrecy_count(text: Column, rest: Column | None = None) -> Column:
    return _guarded(_any_of(text if rest is None else rest, "密", "外传", "仅限内部"), F.regexp_count(text, F.lit(SECRECY)))


def salary_count(text: Column, rest: Column | None = None) -> Column:
    return _guarded(_any_of(text if rest is None else rest, "薪", "工资"), F.regexp_count(text, F.lit(SALARY)))


def contract_count(text: Column, rest: Column | None = None) -> Column:
    return _guarded(_any_of(text if rest is None else rest, "金额", "总价"), F.regexp_count(text, F.lit(CONTRACT)))


def risk_counts(
    text: Column, digit_run: Column | None = None, rest: Column | None = None, far: Column | None = None
) -> Column:
    """``ARRAY<INT>`` of the seven counters in report order. Pass ``has_digit_run``
    as a column of its own to test it once, and the text's residue to look for the
    patterns' words in it: it keeps every word of the text without letters and spaces.
    ``far``, the far residue, keeps all of those words that are not ASCII."""
    far = rest if far is None else far
    return F.array(
        phone_count(text, digit_run),
        id_count(text, digit_run),
        card_count(text, far),
        email_count(text, rest),
        secrecy_count(text, far),
        salary_count(text, far),
        contract_count(text, far),
    )


def _labelled(counts: Column) -> Column:
    labels = F.array(*[F.lit(r) for r in RISK_ORDER])
    pairs = F.transform(
        counts, lambda n, i: F.struct(F.get(labels, i).alias("label"), n.alias("n"))
    )
    return F.filter(pairs, lambda p: p["n"] > 0)


def risk_map(counts: Column) -> Column:
    """Category to count, zero entries dropped."""
    return F.map_from_entries(_labelled(counts))


def risk_text(counts: Column) -> Column:
    return F.array_join(
        F.transform(_labelled(counts), lambda p: F.concat(p["label"], F.lit("（"), p["n"], F.lit("处）"))),
        "；",
    )


def risk_total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)


def has_high_impact(counts: Column) -> Column:
    hits = [F.get(counts, F.lit(RISK_ORDER.index(r))) > 0 for r in HIGH_IMPACT]
    test = hits[0]
    for hit in hits[1:]:
        test = test | hit
    return test
