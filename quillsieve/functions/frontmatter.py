"""The header block of a document, parsed on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"([a-zA-Z_][\w-]*):\s*(.*)")
_QUOTES = ("'", '"')


def parse(text: str | None) -> dict[str, str]:
    """Keys and values of the block at the start of the text; {} without a closed one.

    A value `>` or `|` takes the indented lines that follow, joined by spaces or
    line feeds. One pair of equal quotes around a value is dropped. The last of
    repeated keys wins; lines of another form are skipped.
    """
    text = text or ""
    if not text.startswith(("---\n", "---\r\n")):
        return {}
    text = text.replace("\r\n", "\n")
    end = text.find("\n---", 4)
    if end < 0:
        return {}
    found: dict[str, str] = {}
    lines = iter(text[4:end].split("\n"))
    line = next(lines, None)
    while line is not None:
        match, line = _KEY.fullmatch(line), None
        if match:
            key, value = match[1], match[2].strip()
            if value in (">", "|"):
                parts = []
                for line in lines:
                    if line and not line[0] in " \t":
                        break
                    parts.append(line.strip())
                else:
                    line = None
                found[key] = ("\n" if value == "|" else " ").join(filter(None, parts))
                if line is not None:
                    continue
            else:
                found[key] = value[1:-1] if value[:1] in _QUOTES and value[-1:] == value[:1] else value
        line = next(lines, None)
    return found


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def front_matter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(parse)


@F.pandas_udf(T.StringType())
def quoted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ids as literals with line breaks and unprintable characters escaped."""
    for ids in batches:
        yield ids.map(lambda x: repr(str(x)))
