"""Line tools over text files or columns, as DataFrame plans that chain like a pipe."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, line): the numbered lines of each text (cat -n)."""
    return df.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def head(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    return rows.filter(F.col("n") <= n)


def tail(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    last = rows.groupBy(key).agg(F.max("n").alias("_last"))
    return rows.join(last, key).filter(F.col("n") > F.col("_last") - n).drop("_last")


def last_lines(df: DataFrame, key: str, n: int = 10, text: str = "text") -> DataFrame:
    """(key, n, line): the last n lines of each text, numbered from its beginning; no other line leaves its row."""
    all_ = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    before = F.greatest(F.size(all_) - n, F.lit(0))
    return df.select(F.col(key), before.alias("_before"), F.posexplode(F.slice(all_, before + 1, F.lit(n))).alias("n", "line")).select(key, (F.col("n") + F.col("_before") + 1).alias("n"), "line")


def wc(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Newlines, words, bytes and characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return df.select(key, (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"), words.cast("long").alias("n_words"), F.octet_length(t).cast("long").alias("n_bytes"), F.char_length(t).cast("long").alias("n_characters"))


def grep(rows: DataFrame, pattern: str, *, fixed: bool = False, ignore_case: bool = False, invert: bool = False, column: str = "line") -> DataFrame:
    c = F.col(column)
    if fixed:
        found = F.contains(F.lower(c), F.lit(pattern.lower())) if ignore_case else F.contains(c, F.lit(pattern))
    else:
        found = c.rlike(("(?i)" if ignore_case else "") + pattern)
    return rows.filter(~found if invert else found)


def grep_count(rows: DataFrame, key: str, pattern: str, **options) -> DataFrame:
    return grep(rows, pattern, **options).groupBy(key).agg(F.count("*").alias("n"))


def sort(rows: DataFrame, *, column: str = "line", numeric: bool = False, reverse: bool = False, unique: bool = False) -> DataFrame:
    """Numeric sorting fails on what is not a number."""
    if unique:
        rows = rows.select(column).distinct()
    c = F.col(column).cast("double") if numeric else F.col(column)
    return rows.orderBy(c.desc() if reverse else c.asc())


def cut(rows: DataFrame, fields: list[int], *, delimiter: str = ",", column: str = "line") -> DataFrame:
    """Fields from 1, joined by the delimiter again; missing ones are empty."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    parts = F.split(F.col(column), "\\" + delimiter if not delimiter.isalnum() else delimiter, -1)
    return rows.withColumn(column, F.array_join(F.array(*[F.coalesce(F.get(parts, F.lit(f - 1)), F.lit("")) for f in fields]), delimiter))


#: Names of characters, from Python's own table; those that end in a semicolon.
ENTITIES = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _character(entity):
    """The text of `&name;`, `&#10;` or `&#xa;`; what has no meaning stays as it is."""
    name = F.substring(entity, F.lit(2), F.char_length(entity) - 2)
    number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.lit(6)), 16, 10)).when(name.startswith("#"), F.substring(name, F.lit(2), F.lit(7))).cast("long")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(63))), 8, "0")), "UTF-32")
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), name)
    return F.when(valid, coded).otherwise(F.coalesce(named, entity))


def entities(t):
    """Text with character references resolved, once each."""
    found, parts = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)), F.split(t, _ENTITY, -1)
    both = F.zip_with(parts, F.transform(found, _character), lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit(""))))
    return F.when(F.contains(t, F.lit("&")), F.array_join(both, "")).otherwise(t)


def html_text(c):
    """Visible text of HTML: scripts, styles and comments dropped, tags as line breaks, character references resolved."""
    t = F.regexp_replace(c, r"(?is)<(script|style|svg|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    t = entities(F.regexp_replace(t, r"(?s)<[^>]*>", "\n"))
    return F.array_join(F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(F.replace(x, F.lit("\u00a0"), F.lit(" ")))), lambda x: x != ""), "\n")


def number_lines(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("n")))
