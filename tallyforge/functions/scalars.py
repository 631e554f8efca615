"""Scalar functions on text and numbers, each with the SQL of the same name for the oracle."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _decomposed() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition, without marks and in lower case, makes of characters: single letters and digits, characters that go, and those that become several.

    From the Unicode database, for all of the basic plane; what gives no ASCII letter or digit is left out, as it becomes a blank anyway.
    """
    one, several = {}, {}
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code <= 0xDFFF:  # Korean syllables and surrogates
            continue
        x = chr(code)
        kept = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
        if len(kept) == 1 and kept.isascii() and kept.isalnum():
            one[x] = kept
        elif len(kept) > 1 and any(c.isascii() and c.isalnum() for c in kept):
            several[x] = re.sub("[^a-z0-9]", " ", kept)
    gone = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(one) + gone, "".join(one.values()), several


DECOMPOSED, PLAIN, SEVERAL = _decomposed()


def normal_label(text: Column) -> Column:
    """Compatibility forms decomposed, accents off, lower case, everything but letters and digits to one space.

    Characters that become several (ligatures, fractions, units) are looked up piece by piece, and only in texts that hold one.
    """
    lookup = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(lookup, c), c)), "")
    plain = F.translate(F.lower(F.translate(F.when(text.rlike("[" + "".join(SEVERAL) + "]"), spread).otherwise(text), DECOMPOSED, PLAIN)), DECOMPOSED, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normal_label_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(nfc_normalize({x}))), '[^a-z0-9]+', ' ', 'g'))"


def parse_number(text: Column) -> Column:
    """Number with blanks (also hard ones) as group marks and a decimal comma or point; null if it is none."""
    return F.regexp_replace(F.regexp_replace(text, "[\\s  ]+", ""), ",", ".").try_cast("double")


def parse_number_sql(x: str) -> str:
    return f"TRY_CAST(replace(regexp_replace({x}, '[\\s  ]+', '', 'g'), ',', '.') AS DOUBLE)"


def normal_code(x: Column) -> Column:
    """Code as text: integral numbers without decimals, trimmed, empty is null."""
    text = F.trim(x.cast("string"))
    return F.nullif(F.when(text.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text), F.lit(""))


def first_digit(x: Column) -> Column:
    """First significant digit of a positive number, from its scientific notation."""
    return F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)).cast("double"))).cast("int")


def first_digit_sql(x: str) -> str:
    return f"CAST(floor({x} / pow(10, floor(log10({x})))) AS INT)"


def truthy(x: Column) -> Column:
    """yes, true, 1 and the like."""
    return F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y", "oui")


def level_of_key(key: Column, mark: str = "-") -> Column:
    """Depth of a key: its marks plus one."""
    return F.size(F.split(key, mark))
