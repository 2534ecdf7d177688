"""Sections of posts, Markdown records and embedded videos, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_to_text

@dataclass(frozen=True)
class Section:
    """How a site writes a list within a text, as patterns of lines: what opens it (group 1 may hold a title), what closes it, what marks its second kind of lines, and addresses that say it stands elsewhere."""

    opens: str
    closes: str
    marked: str = r"^[-*\x{2022}]\s*"
    elsewhere: str | None = None


# Headings of a Markdown record's item table and of its steps, and the table's own heading row.
ITEM_HEADINGS, STEP_HEADINGS, HEADING_ROW = "食材|配料", "做法|步骤|烹饪", "---|食材"
# Addresses of videos in embeds of all years, and the elements that embed.
YOUTUBE = r"(?:youtube(?:-nocookie)?\.com/(?:embed/|watch\?v=|v/)|youtu\.be/)([\w-]{11})"
VIMEO = r"(?:player\.vimeo\.com/video/|vimeo\.com/moogaloop\.swf\?clip_id=|vimeo\.com/)(\d{5,})"
EMBED = r"(?i)<(?:iframe|embed|object)\b"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def section(html: Column, form: Section) -> Column:
    """(title, plain, marked, reason): the lines of a page's section, plain and marked ones apart; `reason` is why there are none.

    The section begins after what opens it, within that line, and ends before the first line that closes it; without such a line it is the rest of the
    page. Lines without letter or digit go. Null html is an empty page.
    """
    html = F.coalesce(html, F.lit(""))
    lines = _lines(html_to_text(html))
    first = F.array_position(F.transform(lines, lambda x: x.rlike(form.opens)), True).cast("int")
    opening = F.get(lines, first - 1)
    after = F.concat(F.array(F.regexp_replace(opening, f"^.*?(?:{form.opens})", "")), F.slice(lines, first + 1, F.size(lines)))
    last = F.array_position(F.transform(after, lambda x: x.rlike(form.closes)), True).cast("int")
    held = F.filter(F.when(last > 0, F.slice(after, F.lit(1), last - 1)).otherwise(after), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    held = F.when(first > 0, F.transform(held, lambda x: F.btrim(x))).otherwise(F.array().cast("array<string>"))
    plain = F.filter(held, lambda x: ~x.rlike(form.marked))
    marked = F.transform(F.filter(held, lambda x: x.rlike(form.marked)), lambda x: F.regexp_replace(x, form.marked, ""))
    away = html.rlike(form.elsewhere) if form.elsewhere else F.lit(False)
    reason = F.when(first > 0, F.when(F.size(plain) == 0, "empty_section")).when(away, "elsewhere").otherwise("no_section")
    return F.struct(F.btrim(F.coalesce(F.regexp_extract(opening, form.opens, 1), F.lit(""))).alias("title"), plain.alias("plain"), marked.alias("marked"), reason.alias("reason"))


def markdown_record(text: Column, name: Column) -> Column:
    """(title, ingredients, steps) of a Markdown text, null where it has neither: table rows of three cells under item headings, listed lines under step
    headings; a heading of the third level stays in its section. Without a title, the file's name without ending."""
    title = F.coalesce(_found(text, r"(?m)^# +(.+?)\s*$", 1), F.regexp_replace(name, r"\.[^.]*$", ""))
    parts = F.filter(F.split(text, r"(?m)^(?=[ \t]*##(?!#))"), lambda p: p.rlike(r"^[ \t]*##(?!#)"))
    heading = lambda p: F.regexp_extract(p, r"^([^\n]*)", 1)
    under = lambda words: F.flatten(F.transform(F.filter(parts, lambda p: heading(p).rlike(words)), _lines))
    row = r"^\|([^|]+)\|([^|]+)\|([^|]*)\|$"
    rows = F.filter(under(ITEM_HEADINGS), lambda x: x.rlike(row) & ~x.rlike(HEADING_ROW) & (F.btrim(F.regexp_extract(x, row, 1)) != ""))
    cell = lambda x, i: F.nullif(F.btrim(F.regexp_extract(x, row, i)), F.lit(""))
    items = F.transform(rows, lambda x: F.concat_ws(" ", cell(x, 2), cell(x, 1)))
    listed = F.filter(under(STEP_HEADINGS), lambda x: x.rlike(r"^([-*]|\d+[.)])"))
    steps = F.filter(F.transform(listed, lambda x: F.btrim(F.regexp_replace(x, r"^([-*]|\d+[.)])", ""))), lambda x: x != "")
    return F.when((F.size(items) > 0) | (F.size(steps) > 0), F.struct(title.alias("title"), items.alias("ingredients"), steps.alias("steps")))


def video_url(html: Column, page: Column | None = None) -> Column:
    """The first YouTube video of a post, else the first Vimeo one, else its own address if it embeds anything; else null."""
    youtube = F.concat(F.lit("https://www.youtube.com/watch?v="), _found(html, YOUTUBE, 1))
    vimeo = F.concat(F.lit("https://vimeo.com/"), _found(html, VIMEO, 1))
    return F.coalesce(youtube, vimeo, *([F.when(html.rlike(EMBED), page)] if page is not None else []))


def post_key(file: Column) -> Column:
    """`2007_02_name.json` as `2007/02/name`; null for other names."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.json$", ""), "_", 3)
    return F.when(F.size(parts) == 3, F.array_join(parts, "/"))
