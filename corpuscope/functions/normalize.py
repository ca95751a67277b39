"""Unicode folding (NFKC, then full case folding) that stays in the JVM.

Spark has no NFKC or casefold function. For text made only of characters in
``JVM_RANGES`` the folding equals ``lower`` plus a one-to-one mapping of the
full-width block plus ss for the German sharp s (the test suite checks every
code point); only text with any other character goes through an Arrow UDF.
"""

from __future__ import annotations

import hashlib
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Everything str.isspace() accepts, which is also what \s means for Python text.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
REPLACEMENT = "\ufffd"

# Assigned characters only; U+FFFD is the only one that counts as garbled.
JVM_RANGES = (
    (0x20, 0x7E),
    (0x4E00, 0x9FA5),
    (0x09, 0x0D),
    (0xC0, 0xFF),
    (0x3000, 0x3029),
    (0xFF01, 0xFF5E),
    (0x3400, 0x4DB5),
    (0x2012, 0x2016),
    (0x2018, 0x2022),
    (0xFFFD, 0xFFFD),
    (0xFFE5, 0xFFE5),
    (0xA1, 0xA7),
    (0xAB, 0xAC),
    (0xB0, 0xB1),
    (0xB6, 0xB7),
    (0xBB, 0xBB),
    (0xBF, 0xBF),
    (0x20AC, 0x20AC),
    (0x400, 0x45F),
    (0x2190, 0x21FF),
    (0x2500, 0x27BF),
    (0x3041, 0x3096),
    (0x30A1, 0x30FE),
    (0xAC00, 0xD7A3),
    (0x1F300, 0x1F64F),
)
# The only white space inside JVM_RANGES.
JVM_SPACES = (" ", "\n", "\r", "\t", "\x0b", "\x0c", "\u3000")
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\uffe5"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " \u00a5"


def _java_class(ranges) -> str:
    return "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges)


def _outside(ranges) -> str:
    """Class of the characters outside all ranges. Nesting to the right makes the
    first range the first test, so a frequent character costs one."""
    head, rest = ranges[:1], ranges[1:]
    own = f"[^{_java_class(head)}]"
    if len(ranges) <= 6:
        return f"[^{_java_class(ranges)}]"
    return f"[{own}&&{_outside(rest)}]"


ODD_PATTERN = _outside(JVM_RANGES)
#: White space of JVM_RANGES that few texts have.
RARE_SPACES = r"[\t\x0b-\r\x{3000}]"
SPACE_PATTERN = rf"[[^!-~]&&[[^\x{{3400}}-\x{{d7ff}}]&&[{SPACE_CLASS}]]]"
#: ASCII letters and the space, each on its own: the engine looks a character of such a class
#: up in one table, while ranges are tested one by one through calls that other patterns slow down.
PLAIN = " " + string.ascii_letters
VISIBLE = "\\n" + "".join(rf"\x{c:02x}" for c in range(0x21, 0x7F))
_FULL_WORD = r"[\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]"


def python_fold(value: str) -> str:
    """NFKC and casefold of one string (also used for literals of the rule pack)."""
    return unicodedata.normalize("NFKC", value).casefold()


@F.pandas_udf(StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(python_fold, na_action="ignore")


def is_odd(text: Column) -> Column:
    """True where folding needs the Arrow UDF."""
    return text.rlike(ODD_PATTERN)


def residue(text: Column) -> Column:
    """``text`` without its ASCII letters and spaces, most of many a text: one scan by long
    runs. A character of another kind is in the text exactly if it is in the residue, so
    the tests for such characters take it instead of the text."""
    return F.regexp_replace(text, f"[{PLAIN}]+", "")


def far_residue(rest: Column) -> Column:
    """The residue without visible ASCII and line feeds: little or nothing of most texts, so
    that each test for any other character costs next to nothing. It is only good for
    single characters, and to rule words out, since it joins what stood apart."""
    return F.regexp_replace(rest, f"[{VISIBLE}]+", "")


def _has_full_width(text: Column) -> Column:
    """Byte search for the two UTF-8 prefixes of the full-width block, the
    ideographic space and the full-width yen sign."""
    raw = text.cast("binary")
    hits = [F.contains(raw, F.unhex(F.lit(p))) for p in ("EFBC", "EFBD", "E38080", "EFBFA5")]
    return hits[0] | hits[1] | hits[2] | hits[3]


def to_half_width(text: Column, rest: Column | None = None) -> Column:
    """Full-width forms to ASCII, one character for one. ``rest``, here and below: the
    text's residue, if it is known."""
    wide = _has_full_width(text if rest is None else rest)
    return F.when(wide, F.translate(text, _FULL, _HALF)).otherwise(text)


def words_to_half_width(text: Column, rest: Column | None = None) -> Column:
    """``to_half_width`` only where it matters for words: full-width letters or digits."""
    seen = text if rest is None else rest
    wide = _has_full_width(seen) & seen.rlike(_FULL_WORD)
    return F.when(wide, F.translate(text, _FULL, _HALF)).otherwise(text)


def spell_out(lower: Column, rest: Column | None = None) -> Column:
    """The only character of JVM_RANGES whose folding is longer than one."""
    spelled = F.replace(lower, F.lit("ß"), F.lit("ss"))
    return spelled if rest is None else F.when(rest.contains("ß"), spelled).otherwise(lower)


def drop_jvm_spaces(text: Column, rest: Column | None = None, far: Column | None = None) -> Column:
    """``drop_spaces`` for text inside JVM_RANGES, by byte searches; with ``rest``, the
    spaces proper are gone already. ``far``: the far residue, if it is known."""
    bare = text
    for space in JVM_SPACES:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    if rest is None:
        return bare
    usual = F.replace(text, F.lit("\n"), F.lit(""))
    return F.when((rest if far is None else far).rlike(RARE_SPACES), bare).when(rest.contains("\n"), usual).otherwise(text)


def fold_jvm(text: Column) -> Column:
    """Folding of text for which ``is_odd`` is false."""
    return spell_out(to_half_width(F.lower(text)))


def fold_odd(odd_text: Column) -> Column:
    """Arrow folding; pass null for the rows the JVM already handled."""
    return _fold_udf(odd_text)


def fold(text: Column) -> Column:
    """Folding of any text: JVM where possible, Arrow UDF elsewhere."""
    odd = is_odd(text)
    return F.when(odd, fold_odd(F.when(odd, text))).otherwise(fold_jvm(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def drop_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_PATTERN + "+", "")


def digest_of_bare(bare: Column) -> Column:
    """SHA-256 of folded text that holds no white space; '' when it is empty."""
    return F.replace(F.sha2(bare, 256), F.lit(EMPTY_DIGEST), F.lit(""))


def digest_of_folded(folded: Column) -> Column:
    return digest_of_bare(drop_spaces(folded))
