"""Text cleaning and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Display widths and marks.
ELLIPSIS = "…"
NO_TIME = "—"
PAGE_TEXT_CHARS = 10_000
# Fixed value: white space as web pages know it, as a character class.
SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
UNSAFE_IN_FILENAME = "[^a-zA-Z0-9_.-]"


def fmt_money(c: Column) -> Column:
    """``$1,234.56`` below ten thousand, whole dollars from there on, ``$0`` for NULL."""
    v = c.cast("double")
    shown = F.when(v < 10000, F.format_number(v, 2)).otherwise(F.format_number(v, 0))
    return F.when(v.isNull(), F.lit("$0")).otherwise(F.concat(F.lit("$"), shown))


def fmt_age(then: Column, now: Column) -> Column:
    secs = F.timestamp_diff("SECOND", then, now)

    def in_units(size: int, unit: str) -> Column:
        n = F.call_function("div", secs, F.lit(size).cast("bigint"))
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(secs.isNull(), F.lit(NO_TIME))
        .when(secs < 60, in_units(1, "s"))
        .when(secs < 3600, in_units(60, "m"))
        .when(secs < 86400, in_units(3600, "h"))
        .otherwise(in_units(86400, "d"))
    )


def cut(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def shorten(c: Column, width: int) -> Column:
    """Cut to ``width`` characters and mark the cut."""
    return F.when(F.char_length(c) > width, F.concat(cut(c, width), F.lit(ELLIPSIS))).otherwise(c)


def day_label(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def html_to_text(html: Column) -> Column:
    """All text of a page: tags out, runs of space collapsed."""
    no_tags = F.regexp_replace(html, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(no_tags, f"{SPACE}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def page_excerpt(html: Column, chars: int = PAGE_TEXT_CHARS) -> Column:
    """The opening of the page text that is handed on to a reader."""
    return cut(html_to_text(html), chars)


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, UNSAFE_IN_FILENAME, "_")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def bracketed(text: Column) -> Column:
    """From the first opening to the last closing bracket; NULL without such a pair."""
    start = F.instr(text, "[")
    end = F.char_length(text) - F.char_length(F.substring_index(text, "]", -1))
    return F.when((start > 0) & (end > start), text.substr(start, end - start + 1))


def prompt_list(text: Column) -> Column:
    """The JSON array in a model's answer: the whole text, else its outermost brackets, else empty."""
    items = "array<struct<title: string, prompt: string>>"
    whole = F.when(text.rlike(r"^\s*\["), F.from_json(text, items))
    inner = F.from_json(bracketed(text), items)
    return F.coalesce(whole, inner, F.array().cast(items))


def payload_field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def not_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
