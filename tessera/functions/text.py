"""Text cleaning as columns: Python only where Spark has no function, in Arrow batches, and only for texts that need it."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What cleaning strips; the joiners U+200C and U+200D stay: zero-width blanks, marks and embeddings of direction, the byte
# order mark, the replacement character, and control characters but tab and the ends of lines.
NOISE = r"[\x{200B}\x{200E}\x{200F}\x{FEFF}\x{FFFD}\x{202A}-\x{202E}\x{2066}-\x{2069}\x00-\x08\x0B\x0C\x0E-\x1F]"
# Chat markers that have no place in plain text.
GHOST = r"(?i)\[/?(?:USER|ASSISTANT|SYSTEM|INST)\]|<\|[a-z_]+\|>|<<SYS>>"
BLANKS = r"(?U)[^\S\n]+"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else None)


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def nfc(text: Column) -> Column:
    """Unicode's composed form. ASCII and Latin-1 texts are in it already and don't leave the JVM's row for a result of their own."""
    return F.when(text.rlike(r"[^\x00-\x{FF}]"), _composed(F.when(text.rlike(r"[^\x00-\x{FF}]"), text))).otherwise(text)


def unescape(text: Column) -> Column:
    """HTML entities as characters."""
    return F.when(text.contains("&"), _unescaped(F.when(text.contains("&"), text))).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def cleaned(text: Column) -> Column:
    """Composed, unescaped, without tags of up to 40 characters, noise, runs of blanks and of empty lines; chat markers stay."""
    x = F.regexp_replace(unescape(nfc(text)), "<[^>]{1,40}>", " ")
    x = F.regexp_replace(F.regexp_replace(x, NOISE, ""), BLANKS, " ")
    return stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def without_ghosts(before: Column, clean: Column) -> Column:
    """``clean`` without chat markers where the text before cleaning had any."""
    bare = F.regexp_replace(stripped(F.regexp_replace(clean, GHOST, "")), BLANKS, " ")
    return F.when(before.rlike(GHOST), bare).otherwise(clean)


def overflow_checksum(text: Column, size: int) -> Column:
    """UTF-8 in ``size`` bytes: longer texts give their last byte to a checksum of what is cut."""
    h = F.hex(text.cast("binary"))
    rest = F.crc32(F.unhex(F.substring(h, 2 * size - 1, 1 << 30))).bitwiseAND(255)
    return F.when(F.octet_length(text) <= size, h).otherwise(F.concat(F.substring(h, 1, 2 * size - 2), F.lpad(F.hex(rest), 2, "0")))


def ends_checksum(text: Column, size: int) -> Column:
    """Both ends and a checksum of the middle in ``size`` bytes."""
    h, n = F.hex(text.cast("binary")), F.octet_length(text)
    back = (size - 1) // 2
    front = size - 1 - back
    middle = F.substr(h, F.lit(2 * front + 1), 2 * (n - front - back))
    rest = F.lpad(F.hex(F.crc32(F.unhex(middle)).bitwiseAND(255)), 2, "0")
    return F.when(n <= size, h).otherwise(F.concat(F.substring(h, 1, 2 * front), F.substr(h, 2 * (n - back) + 1, F.lit(2 * back)), rest))
