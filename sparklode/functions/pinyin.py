"""Initials of Han characters, for matching Latin letters against Chinese names.

The operating system's transliteration table isn't at hand. The 3 755 common characters of GB 2312 are ordered by their reading, so where
an initial begins in that order gives the initial of each; other characters are kept as they are. A character with several readings has
the one it is filed under.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"
# The GB 2312 codes at which the readings with an initial begin, and the last code.
BEGINS = {
    "a": 0xB0A1, "b": 0xB0C5, "c": 0xB2C1, "d": 0xB4EE, "e": 0xB6EA, "f": 0xB7A2, "g": 0xB8C1, "h": 0xB9FE, "j": 0xBBF7, "k": 0xBFA6, "l": 0xC0AC, "m": 0xC2E8,
    "n": 0xC4C3, "o": 0xC5B6, "p": 0xC5BE, "q": 0xC6DA, "r": 0xC8BB, "s": 0xC8F6, "t": 0xCBFA, "w": 0xCDDA, "x": 0xCEF4, "y": 0xD1B9, "z": 0xD4D1,
}
LAST = 0xD7F9


@lru_cache
def table() -> tuple[str, str]:
    """(characters, their initials)."""
    begins = sorted((code, letter) for letter, code in BEGINS.items())
    found = {}
    for high in range(0xB0, 0xD8):
        for low in range(0xA1, 0xFF):
            code = high << 8 | low
            if code <= LAST:
                found[bytes((high, low)).decode("gb2312")] = begins[bisect_right(begins, (code, "~")) - 1][1]
    return "".join(found), "".join(found.values())


def initials(column: Column) -> Column:
    return F.lower(F.translate(column, *table()))
