"""Text work as column expressions: normalising, chunking, names, citations, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blank characters that trimming removes, and the defaults of the data model.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CHUNK_CHARS = 1500
ROW_NAME = r"^([^:]+)::([^:]+)::row::([0-9]+)$"
ELLIPSIS = "…"


def let(value: Column, body) -> Column:
    """Bind an expression to a name so that ``body`` may use it many times for one evaluation."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Without blanks at either end; looks at the ends only."""
    return F.btrim(col, F.lit(BLANKS))


def has_text(col: Column) -> Column:
    """Whether anything is left after stripping, found at the first character that is not blank."""
    return col.rlike(f"[^{BLANKS}]")


def normalize(col: Column) -> Column:
    """Line ends to LF, no blanks at line ends, no blanks around the text."""
    unix = F.replace(F.replace(strip(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(unix, "\n"), lambda line: F.rtrim(line, F.lit(BLANKS)))
    return strip(F.array_join(lines, "\n"))


def pieces(col: Column, size: int = CHUNK_CHARS, keep_empty: bool = False) -> Column:
    """The stripped text cut every ``size`` characters, in one pass over the text."""
    cut = F.regexp_extract_all(strip(col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    if keep_empty:
        return let(cut, lambda parts: F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts))
    return cut


def preview(col: Column, n: int = 200) -> Column:
    flat = F.replace(col, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) <= n, flat).otherwise(
        F.concat(F.substring(flat, 1, n - 1), F.lit(ELLIPSIS))
    )


def row_name(kind: Column, dataset: Column, row_ix: Column) -> Column:
    return F.concat_ws("::", kind, dataset, F.lit("row"), row_ix.cast("string"))


def row_index(name: Column, dataset: Column) -> Column:
    """Position held in a row name, or null when the name or its dataset does not fit."""
    fits = name.rlike(ROW_NAME) & (F.regexp_extract(name, ROW_NAME, 2) == dataset)
    return F.when(fits, F.regexp_extract(name, ROW_NAME, 3).try_cast("long"))


def citation(kind: Column, name: Column, chunk_ix: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit(":"), name, F.lit("#"), chunk_ix.cast("string"), F.lit("]"))


def csv_cell(col: Column) -> Column:
    """Quote a cell holding a quote, comma or line feed; null becomes empty."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(
        text.rlike('[",\n]'),
        F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(text)


def to_int(col: Column) -> Column:
    return F.trim(col.cast("string")).try_cast("int")


def split_list(col: Column) -> Column:
    """A comma-separated list as an array, trimmed, without blanks."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda x: x != "")


def clean_sql(col: Column) -> Column:
    """A model's reply reduced to its statement: no code fence, no ``sql:`` prefix.

    Backticks around the whole reply go; one that closes a quoted name at the end stays.
    """
    text = strip(col)
    bare = F.when(text.startswith("`"), F.regexp_replace(text, r"^`+|`+\z", "")).otherwise(
        F.regexp_replace(text, r"```\z", "")
    )
    return strip(F.regexp_replace(strip(bare), r"^(?i)sql(?:[ \t\r\n]*:|[ \t\r\n])", ""))


def first_select(col: Column) -> Column:
    """Everything up to the first semicolon when that is a SELECT, else a harmless SELECT."""
    head = strip(F.split_part(col, F.lit(";"), F.lit(1)))
    return F.when(F.lower(head).startswith("select"), F.concat(head, F.lit(";"))).otherwise(F.lit("SELECT 1;"))


def utc_stamp(ts: Column) -> Column:
    """Compact UTC stamp of a zone-free timestamp that already holds UTC."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def utc_time(ts: Column) -> Column:
    """The same in the longer form."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
