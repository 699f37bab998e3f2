"""Column expressions that bring names, numbers and labels to one written form.

All are built-in Catalyst expressions, so they stay inside whole-stage code generation.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any kind: ASCII white space and every Unicode separator.
BLANK = r"[\s\p{Z}\x{85}\x{FEFF}]"


def strip_blanks(c: Column) -> Column:
    """Drops blanks of any kind at both ends; null stays null."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def host_form(c: Column) -> Column:
    """Host name clean-up: outer blanks, then all trailing dots, then lower case.

    The common case (no blank, no trailing dot) skips both regular expressions.
    """
    dirty = c.rlike(rf"^{BLANK}|{BLANK}$|\.$")
    clean = F.regexp_replace(strip_blanks(c), r"\.+$", "")
    return F.lower(F.when(dirty, clean).otherwise(c))


def label_form(c: Column) -> Column:
    """Free-text label: lower case, trimmed, inner blanks reduced to one space."""
    return F.regexp_replace(F.lower(strip_blanks(c)), f"{BLANK}+", " ")


def hex_form(c: Column) -> Column:
    """Hexadecimal number, however written: no separators, no 0x, no leading zeros, upper case.

    Text without any hexadecimal digit gives null: it denotes no number.
    """
    digits = F.regexp_replace(F.upper(c), rf"^{BLANK}*0X|[^0-9A-F]", "")
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits != "", short)
