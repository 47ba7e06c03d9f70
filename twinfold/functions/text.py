"""Text clean-up as Spark column expressions.

Whitespace, line ends and lengths follow Unicode: lengths count code points,
and whitespace includes the information separators U+001C to U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The characters that end a line.
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"

# Limits of the title and text rules.
MAX_TITLE = 120
CUT_TITLE = 117
MAX_TEXT = 200_000

_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def full_text(title: Column | str = "title", content: Column | str = "content") -> Column:
    return F.concat(F.col(title) if isinstance(title, str) else title, F.lit(" "),
                    F.col(content) if isinstance(content, str) else content)


def normalize_text(text: Column) -> Column:
    return F.lower(strip(text))


def words(text: Column) -> Column:
    """Whitespace-separated tokens; an empty list for blank text."""
    clean = strip(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, _SPACE_RUN))


def sanitize_text(text: Column, max_length: int = MAX_TEXT) -> Column:
    clean = strip(F.regexp_replace(text, _SPACE_RUN, " "))
    return F.substring(F.coalesce(clean, F.lit("")), 1, max_length)


def derive_title(text: Column, fallback: Column) -> Column:
    """First non-blank line, shortened to 117 characters and ``...`` when over 120."""
    start = F.ltrim(text, F.lit(WHITESPACE))

    def line(part: Column) -> Column:
        return F.regexp_extract(part, f"^[^{LINE_ENDS}]*", 0)

    def shorten(title: Column) -> Column:
        return F.when(F.length(title) > MAX_TITLE, F.concat(F.substring(title, 1, CUT_TITLE), F.lit("..."))).otherwise(title)

    def title(head: Column) -> Column:
        # The first characters decide unless the last of them is a blank within the line: then the whole line does.
        open_end = (F.length(head) > MAX_TITLE) & (F.length(strip(head)) <= MAX_TITLE)
        return F.when(open_end, strip(line(start))).otherwise(strip(head))

    # One-element arrays bind values to names, so that they are made once.
    head = F.array(line(F.substring(start, 1, MAX_TITLE + 1)))
    return F.get(F.transform(F.transform(head, title), lambda l: shorten(F.when(l == "", fallback).otherwise(l))), F.lit(0))


def normalize_source(source: Column) -> Column:
    name = F.regexp_replace(F.lower(strip(source)), r"[ .\-_]+", "_")
    return F.when(source.isNull() | (source == ""), F.lit("unknown")).otherwise(name)


def is_language_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^\p{L}{2}(-\p{L}{2})?\z"), F.lit(False))


def is_article_id(article_id: Column) -> Column:
    return F.coalesce(strip(article_id) != "", F.lit(False))


def is_cluster_id(cluster_id: Column) -> Column:
    return F.coalesce(cluster_id.startswith("cluster_") & (F.length(cluster_id) > 8), F.lit(False))


def is_date_range(start: Column, end: Column) -> Column:
    return start.isNull() | end.isNull() | (start <= end)


def title_tokens(text: Column) -> Column:
    """Distinct search tokens: letter/digit runs in lower case; Han and kana runs as 2-grams."""
    spaced = F.regexp_replace(F.lower(text), f"([{_HAN}]+)", " $1 ")
    runs = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != "")

    def grams(token: Column) -> Column:
        pairs = F.regexp_extract_all(token, F.lit(r"(?s)(?=(..))."), F.lit(1))
        return F.when(token.rlike(f"^[{_HAN}]{{3,}}"), pairs).otherwise(F.array(token))

    return F.array_distinct(F.flatten(F.transform(runs, grams)))
