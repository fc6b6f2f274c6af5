"""Repair of text whose UTF-8 bytes were once read as Windows-1250.

Everything here is a Spark expression: the code page is a character map handed
to ``translate``, and the bytes behind the mapped text come from ``encode``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorleaf.functions.text import as_col, bind

# Fixed value: characters that start most broken pairs (Ă, Ä, Ĺ, Â).
MARKERS = "\u0102\u00c4\u0139\u00c2"

_BYTES = [b for b in range(0x80, 0x100) if bytes([b]).decode("cp1250", "ignore")]
CP1250 = "".join(bytes([b]).decode("cp1250") for b in _BYTES)
LATIN1 = "".join(chr(b) for b in _BYTES)


def marker_count(text: Column | str) -> Column:
    """Pairs of a marker and another character; a pair is two characters long."""
    text = as_col(text)
    without = F.regexp_replace(text, f"[{MARKERS}][^\\n]", "")
    return F.floor((F.length(text) - F.length(without)) / 2)


def decode_legacy(text: Column | str) -> Column:
    """Read a value that is not valid UTF-8 as Windows-1250."""
    text = as_col(text)
    as_bytes = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(as_bytes, LATIN1, CP1250))


def undo_cp1250(text: Column) -> Column:
    """The text whose UTF-8 bytes read as Windows-1250 give ``text``, else NULL."""
    # dropping the mapped characters and looking for others beats one large regex class
    mappable = ~F.translate(text, CP1250, "").rlike(r"[^\x00-\x7F]")
    candidate = F.encode(F.translate(text, CP1250, LATIN1), "ISO-8859-1").cast("string")
    return F.when(mappable, candidate)


# A character beyond ASCII between ASCII neighbours: one byte that is no UTF-8.
ALONE = r"(?<![^\x00-\x7F])[^\x00-\x7F](?![^\x00-\x7F])"


def undo_misreading(text: Column | str) -> Column:
    """Undo a wrong reading if the result is valid and holds fewer markers.

    Misread text shows its characters beyond ASCII in groups. Honest text soon
    shows one alone, which settles the matter without building the candidate.
    """
    text = as_col(text)
    # four plain searches are faster than one character class
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in MARKERS])
    suspect = marked & ~text.rlike(ALONE)

    def better_of(candidate: Column) -> Column:
        better = F.is_valid_utf8(candidate) & (marker_count(candidate) < marker_count(text))
        return F.when(better, candidate).otherwise(text)

    return F.when(suspect, bind(undo_cp1250(text), better_of)).otherwise(text)


def repair_text(text: Column | str) -> Column:
    """Valid, repaired text. Clean rows leave after two cheap tests."""
    return bind(bind(as_col(text), decode_legacy), undo_misreading)
