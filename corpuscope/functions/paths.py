"""File name, extension and folder expressions over ``/`` separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rulepack import ATTACHMENT_PATTERN, BAD_STEMS, COPY_MARKERS, NO_EXTENSION, VERSION_WORDS
from .normalize import SPACE_CLASS, strip

_SUFFIX = r"(?s)\A.+(\.[^.]+)\z"

_OPEN = rf"[{SPACE_CLASS}_\-（(\[]*"
_CLOSE = rf"[{SPACE_CLASS}_\-）)\]]*"
_S = f"[{SPACE_CLASS}]*"
# Version markers inside a folded title: a version word, v1.2, a date or year, "3版".
VERSION_MARKER = (
    "(?U)(?:"
    + rf"{_OPEN}(?:{VERSION_WORDS}){_S}\d*"
    + rf"|{_OPEN}v(?:er(?:sion)?)?\.?{_S}\d+(?:\.\d+)*"
    + rf"|{_OPEN}(?:19|20)\d{{2}}(?:[-_.年]\d{{1,2}})?(?:[-_.月]\d{{1,2}})?日?版?"
    + rf"|{_OPEN}第?\d+(?:\.\d+)*版"
    + f"){_CLOSE}"
)


def parts_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def name_of(path: Column) -> Column:
    return F.element_at(parts_of(path), -1)


def folders_of(path: Column) -> Column:
    parts = parts_of(path)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def raw_suffix(name: Column) -> Column:
    """Last dot and what follows, unless the dot is the first or last character."""
    return F.regexp_extract(name, _SUFFIX, 1)


def suffix(name: Column) -> Column:
    return F.lower(raw_suffix(name))


def extension(name: Column) -> Column:
    return F.coalesce(F.nullif(suffix(name), F.lit("")), F.lit(NO_EXTENSION))


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(raw_suffix(name)))


def parent_key(path: Column) -> Column:
    return F.lower(F.array_join(folders_of(path), "/"))


def bad_name(name: Column, folders: Column, bad_folders: tuple[str, ...]) -> Column:
    """The stem says nothing, or any folder above is a dumping place."""
    pattern = rf"(?iUd)\A(?:{'|'.join(BAD_STEMS)})\z"
    known = F.array(*[F.lit(b.casefold()) for b in bad_folders])
    cleaned = F.transform(folders, lambda f: F.lower(strip(f)))
    return strip(stem(name)).rlike(pattern) | F.arrays_overlap(cleaned, known)


def attachment_or_template(folded_stem: Column) -> Column:
    return folded_stem.rlike(ATTACHMENT_PATTERN)


def looks_like_copy(name: Column) -> Column:
    return F.lower(stem(name)).rlike("|".join(COPY_MARKERS))


def version_key(folded_stem: Column) -> Column:
    bare = F.regexp_replace(folded_stem, VERSION_MARKER, "")
    return F.regexp_replace(bare, r"[^A-Za-z0-9\x{3400}-\x{9fff}]+", "")


def has_version_marker(folded_stem: Column) -> Column:
    return folded_stem.rlike(VERSION_MARKER)
