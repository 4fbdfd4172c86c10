"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JVM regular expression of index tokens.
TOKEN = "[a-z0-9]+"


def terms(text: Column | str) -> Column:
    """array<string>: lower-case ASCII words and numbers, in order, repeats included."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def identifier_tokens(text: Column | str) -> Column:
    """As ``terms``, with camelCase, _ and - parting words."""
    parted = F.regexp_replace(_col(text), "([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(F.regexp_replace(parted, "[_-]", " ")), F.lit(TOKEN), F.lit(0))


def collapsed(text: Column | str) -> Column:
    """Trimmed, with each run of white space as one blank."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def chunk_hash(text: Column | str) -> Column:
    """Identity of a chunk's content: half a SHA-256 of the collapsed text."""
    return F.substring(F.sha2(collapsed(text), 256), 1, 32)


def trimmed_lines(text: Column | str) -> Column:
    """Without blank lines at either edge; lines inside and their indents stay."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"\A(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+\z", "")


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded half up."""
    return F.floor(F.length(_col(text)) / 4 + 0.5).cast("long")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
