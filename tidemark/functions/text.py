"""Text helpers with JavaScript string semantics, as Spark expressions.

Patterns are written in the common subset of Java regex and RE2 (``\\x{..}``
escapes, ``\\A``/``\\z`` anchors), so the DuckDB oracle can state the same
rules verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's String.prototype.trim and \s treat
# as white space (ECMAScript WhiteSpace + LineTerminator).
JS_WS = (r"[\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
TRIM_RE = rf"\A{JS_WS}+|{JS_WS}+\z"


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``: strips JS white space at both ends."""
    return F.regexp_replace(c, TRIM_RE, "")


def js_collapse_ws(c: Column) -> Column:
    """``s.replace(/\\s+/g, ' ')``."""
    return F.regexp_replace(c, f"{JS_WS}+", " ")


def replace_first(text: Column, needle: Column) -> Column:
    """``text.replace(needle, '')`` for a literal needle: first occurrence only.

    NULL needle leaves the text unchanged.
    """
    pos = F.call_function("instr", text, needle)
    cut = F.concat(F.call_function("substr", text, F.lit(1), pos - 1),
                   F.call_function("substr", text, pos + F.length(needle)))
    return F.when(needle.isNull() | (pos == 0), text).otherwise(cut)
