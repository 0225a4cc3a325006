"""Row expressions on text (all JVM-side, no Python UDF).

Every function takes and returns a ``Column`` so Catalyst can fuse them into one
whole-stage-codegen projection next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simcat import params as P

# The code points Python's str.strip()/str.isspace() and re's \s treat
# as whitespace (U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680, U+2000-200A,
# U+2028, U+2029, U+202F, U+205F, U+3000). Written with \x{...} escapes, which Java
# regex and RE2 (DuckDB) read the same way.
PY_SPACE_CLASS = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = rf"\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\z"
# The same set as plain characters, for btrim (trims both ends without a regex scan).
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                  "\u2028\u2029\u202f\u205f\u3000")
SPACE_RUN_PATTERN = rf"{PY_SPACE_CLASS}+"
HTML_TAG_PATTERN = r"<[^>]+>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """P-1: Python ``str.strip()`` (all Unicode whitespace plus U+001C..U+001F).

    ``btrim`` only inspects the ends, so long texts cost nothing extra."""
    return F.btrim(_c(c), F.lit(PY_SPACE_CHARS))


def collapse_spaces(c) -> Column:
    """P-3: every whitespace run becomes one blank, then strip."""
    return py_strip(F.regexp_replace(_c(c), SPACE_RUN_PATTERN, " "))


def strip_html(c) -> Column:
    """P-2: each tag ``<...>`` becomes one blank; entities and script bodies stay."""
    return F.regexp_replace(_c(c), HTML_TAG_PATTERN, " ")


def clean_description(c, cap: int = P.DESCRIPTION_CAP) -> Column:
    """P-2 + P-3 + P-4: tags out, whitespace collapsed, first ``cap`` code points.

    Empty string when nothing is left (the part is then omitted)."""
    return F.substring(collapse_spaces(strip_html(py_strip(c))), 1, cap)


def empty_to_null(c) -> Column:
    """'' -> null, evaluating ``c`` once (``nullif`` would evaluate it twice)."""
    return F.try_element_at(F.filter(F.array(_c(c)), lambda x: x != ""), F.lit(1))


def category_path(*levels) -> Column:
    """P-5: outermost first, null/empty dropped, later exact duplicates dropped."""
    arr = F.filter(F.array(*[_c(x) for x in levels]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(arr), P.CATEGORY_SEPARATOR)


def attribute_list(arr, cap: int = P.ATTRIBUTE_CAP) -> Column:
    """P-6: first ``cap`` elements of a non-empty list, null rendered ``None``."""
    a = _c(arr)
    items = F.transform(F.slice(a, 1, cap), lambda x: F.coalesce(x, F.lit("None")))
    return F.when(F.size(a) > 0, F.array_join(items, P.ATTRIBUTE_SEPARATOR))


def rating_text(raw) -> Column:
    """P-7: keep a rating only when it is a number > 0 (NaN excluded).

    Integers keep their literal text; other numbers print through double->string."""
    r = _c(raw).cast("string")
    num = r.try_cast("double")
    shown = F.when(r.rlike(r"^-?[0-9]+$"), r).otherwise(num.cast("string"))
    return F.when(num.isNotNull() & ~F.isnan(num) & (num > 0), shown)


def product_text(title, categories, description, attributes, seller, rating,
                 labels: tuple = None) -> Column:
    """P-8: labelled parts joined by `` | ``, missing (null or empty) parts skipped.

    Inputs are already-rendered parts (see the functions above); ``title`` and
    ``seller`` are stripped here. Every part expression appears exactly once (as an
    array element), so the regex work per part runs once per row."""
    lt, lc, ld, la, ls, lr = labels or P.DEFAULT.labels
    parts = F.array(
        F.struct(F.lit(lt).alias("l"), py_strip(title).alias("v")),
        F.struct(F.lit(lc).alias("l"), _c(categories).alias("v")),
        F.struct(F.lit(ld).alias("l"), _c(description).alias("v")),
        F.struct(F.lit(la).alias("l"), _c(attributes).alias("v")),
        F.struct(F.lit(ls).alias("l"), py_strip(seller).alias("v")),
        F.struct(F.lit(lr).alias("l"), _c(rating).alias("v")),
    )
    present = F.filter(parts, lambda p: p["v"].isNotNull() & (p["v"] != ""))
    return F.array_join(F.transform(present, lambda p: F.concat(p["l"], p["v"])), P.PART_SEPARATOR)


def preview(c, n: int) -> Column:
    """P-9: first ``n`` characters with ``...`` always appended."""
    return F.concat(F.substring(_c(c), 1, n), F.lit("..."))


def ack_message(id_col, action_col) -> Column:
    """P-14: ``Upserted (ID: {id}, {action})``."""
    return F.format_string("Upserted (ID: %d, %s)", _c(id_col), _c(action_col))


def is_blank(c) -> Column:
    """V-7: empty after Python strip (null counts as blank)."""
    return F.coalesce(py_strip(c) == "", F.lit(True))


def integral_id(raw: Column) -> Column:
    """A raw id as bigint; a number written with a zero fraction (4.0) counts, as it does for
    an integer field of the service; anything else is null. The pattern is matched only where
    the plain number can't be read."""
    plain = F.trim(raw.cast("string"))
    return F.coalesce(plain.try_cast("bigint"), F.regexp_replace(plain, r"^([+-]?\d+)\.0+$", "$1").try_cast("bigint"))
