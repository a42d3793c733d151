"""Text expressions: tokens, front matter, prose length, keys. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing sees it, for Java patterns; fixed values.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: The same code points one by one, for trimming; fixed values.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: A fenced block, closed or running to the end of the text; fixed value.
FENCE = r"(?s)```.*?(?:```|\z)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z0-9]+)"), 1)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased after they are found."""
    return F.transform(words(text), F.lower)


def indexed_text(name: Column, description: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def strip_front_matter(text: Column) -> Column:
    """The text after a closed `---` block that it starts with, without leading line feeds; else the text."""
    end = F.locate("\n---", text, 5)
    rest = F.ltrim(F.substring(text, end + 4, F.length(text)), F.lit("\n"))
    return F.when(text.startswith("---\n") & (end > 0), rest).otherwise(text)


def prose_chars(body: Column) -> Column:
    """Characters outside of fenced blocks, runs of white space counted once, ends not at all."""
    open_text = F.regexp_replace(F.coalesce(body, F.lit("")), FENCE, " ")
    return F.length(F.btrim(F.regexp_replace(open_text, SPACE + "+", " "), F.lit(" "))).cast("long")


def fingerprint(name: Column, description: Column) -> Column:
    """Entries are the same if both fields agree but for case and outer white space."""
    return F.struct(F.lower(strip(F.coalesce(name, F.lit("")))).alias("name"), F.lower(strip(F.coalesce(description, F.lit("")))).alias("description"))


def source_of(id_: Column) -> Column:
    """What stands before the first __, or the whole id."""
    return F.substring_index(id_, "__", 1)


def leaf_of(id_: Column) -> Column:
    """What stands after the last __, or the whole id."""
    return F.substring_index(id_, "__", -1)


def file_order(id_: Column) -> Column:
    """Sorts ids the way their files sort."""
    return F.concat(id_, F.lit(".md"))
