"""Invisible characters: strip, count by kind, detect, reject. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (first, last, label); fixed values.
RANGES = (
    (0x0000, 0x001F, "C0-control"),
    (0x007F, 0x007F, "DEL"),
    (0x00AD, 0x00AD, "soft-hyphen"),
    (0x061C, 0x061C, "arabic-letter-mark"),
    (0x180E, 0x180E, "mongolian-vowel-separator"),
    (0x200B, 0x200F, "zero-width+bidi-mark"),
    (0x202A, 0x202E, "bidi-override"),
    (0x2060, 0x206F, "word-joiner+invisible-operator"),
    (0xFE00, 0xFE0F, "variation-selector"),
    (0xFEFF, 0xFEFF, "BOM/ZWNBSP"),
    (0xE0000, 0xE007F, "unicode-tag-block"),
    (0xE0100, 0xE01EF, "variation-selector-supplement"),
)
OTHER = "other-Cf-category"
#: Tab, line feed and carriage return stay; fixed values.
ALLOWED = (0x09, 0x0A, 0x0D)
#: Format characters that the JVM's Unicode tables don't know yet.
_NEWER_CF = "\\x{890}\\x{891}\\x{13430}-\\x{1343F}"


def _spans(first: int, last: int) -> str:
    """A class body for a range without the allowed characters."""
    out, start = "", first
    for cp in [*(a for a in ALLOWED if first <= a <= last), last + 1]:
        if start < cp:
            out += f"\\x{{{start:X}}}-\\x{{{cp - 1:X}}}"
        start = cp + 1
    return out


CLASSES = {label: f"[{_spans(a, b)}]" for a, b, label in RANGES}
_LISTED = "".join(_spans(a, b) for a, b, _ in RANGES)
CLASSES[OTHER] = f"[\\p{{Cf}}{_NEWER_CF}&&[^{_LISTED}]]"
ANY = f"[{_LISTED}\\p{{Cf}}{_NEWER_CF}]"
TAG_BLOCK = "[\\x{E0000}-\\x{E007F}]"
BIDI = "[\\x{202A}-\\x{202E}]"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, ANY, "")


def contains_invisible(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(ANY)), F.lit(False))


def removed_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY)), F.lit(0)).cast("long")


def removed_by_label(text: Column) -> Column:
    """map<label, count> of what stripping removes; labels with nothing are left out."""
    pairs = [x for label, cls in CLASSES.items() for x in (F.lit(label), F.coalesce(F.regexp_count(text, F.lit(cls)), F.lit(0)).cast("long"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def sanitize(text: Column) -> Column:
    """struct<cleaned, removed_count, removed_by_reason>"""
    return F.struct(strip_invisible(text).alias("cleaned"), removed_count(text).alias("removed_count"), removed_by_label(text).alias("removed_by_reason"))


def injection_label(text: Column) -> Column:
    """'tag-block' or 'bidi' if the text holds such characters, the first before the second; else null."""
    return F.when(F.rlike(text, F.lit(TAG_BLOCK)), "tag-block").when(F.rlike(text, F.lit(BIDI)), "bidi")


def injection_reason(*fields: Column) -> Column:
    """inject:<label> by the first field with any such character; else null."""
    return F.concat(F.lit("inject:"), F.coalesce(*map(injection_label, fields)))


#: Phrases that address a model; fixed value. (?iuU): letters and spaces as Unicode has them.
PHRASES = (
    r"(?iuU)(?:(?:ignore|disregard|forget)\s+(?:all\s+|any\s+)?(?:your\s+|the\s+)?(?:previous|prior|above|earlier|preceding|system)\s+(?:instructions?|prompts?|messages?|context|rules?)"
    r"|you\s+are\s+now\s+(?:a|an|in|the)\b|reveal\s+(?:your|the)\s+(?:system\s+)?prompt|(?:print|output|repeat)\s+(?:your|the)\s+(?:system\s+)?prompt)"
)


def visible_injection(body: Column) -> Column:
    """Whether a phrase stands in the text once invisible characters are gone."""
    return F.coalesce(F.rlike(strip_invisible(body), F.lit(PHRASES)), F.lit(False))


def log_line(id_: Column, field: Column, text: Column, escaped: Column | None = None) -> Column:
    """One line on what stripping removes; `escaped` is the id as a quoted literal."""
    by_label = F.map_entries(removed_by_label(text))
    parts = F.array_join(F.transform(F.array_sort(by_label), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    shown = F.concat(F.lit("'"), id_.cast("string"), F.lit("'")) if escaped is None else escaped
    return F.concat(F.lit("[sanitize] skill_id="), shown, F.lit(" field="), field, F.lit(" removed="), removed_count(text).cast("string"), F.lit(" ranges="), parts)
