"""Text normalisers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: the Unicode separators, the ASCII controls treated as space, and two invisible marks.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{200b}\x{feff}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """``c`` without surrounding white space of any kind."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column | str) -> Column:
    """Stripped, and inner runs of white space replaced by one space."""
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def ticker(c: Column | str) -> Column:
    """Trimmed and in upper case; blank becomes null."""
    return F.nullif(F.upper(strip(c)), F.lit(""))
