"""Column expressions for names, numbers and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import alias_map

#: What Python's float() accepts, white space stripped.
FLOAT_RE = r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
ANSI_RE = r"\x1B(\[[\x30-\x3F]*[\x20-\x2F]*[\x40-\x7E]|[\x40-\x5A\x5C-\x5F])"
#: Where str.splitlines() breaks.
LINE_RE = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Breaks other than \n.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def canonical(name: Column, overrides: dict[str, str] | None = None) -> Column:
    """Canonical name of a source column, null for none: exact, case-insensitive, never by substring."""
    pairs = [F.lit(x) for kv in alias_map(overrides).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def as_float(text: Column) -> Column:
    """float() of a text; null where it would raise."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(t.rlike(FLOAT_RE), F.regexp_replace(t, r"(?<=\d)_(?=\d)", "").try_cast("double"))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def normal_tag(tag: Column) -> Column:
    """An event-file tag as a column name: section prefixes become '' (train) or 'val_' (eval, valid, test)."""
    t = F.lower(F.trim(tag))
    prefix = F.substring_index(t, "/", 1)
    rest = F.regexp_replace(F.substring(t, F.length(prefix) + 2, F.length(t)), "/", "_")
    rest = F.when(rest.startswith("avg_"), F.substring(rest, F.lit(5), F.length(rest))).otherwise(rest)
    section = F.when(prefix.contains("eval") | prefix.contains("valid") | prefix.startswith("val") | prefix.contains("test"), "val_").when(prefix.contains("train") | prefix.isin("tr", "fit"), "")
    split = F.when(section.isNotNull(), F.concat(section, rest)).otherwise(F.regexp_replace(t, "/", "_"))
    return F.when(t.startswith("lr-") | t.startswith("lr/") | t.isin("lr", "learning_rate"), "lr").when(t.contains("/"), split).otherwise(t)
