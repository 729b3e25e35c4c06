"""Column functions over items of a reference library: paths, people, state, pages and annotations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T

# What an annotation without text is called.
NO_TEXT = {"image": "（图片批注）", "ink": "（手写批注）"}
OTHER_TEXT = "（无文字批注）"
CREATORS = "array<struct<name:string,firstName:string,lastName:string>>"
POSITION = "pageIndex int, rects array<array<double>>"


def path(text: Column) -> Column:
    """A path to compare: percent escapes read (as they are where broken), slashes one way, spaces folded, lower case."""
    t = T.trimmed(F.coalesce(text, F.lit("")))
    plain = F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    return F.lower(F.regexp_replace(F.replace(plain, F.lit("\\"), F.lit("/")), f"[{T.BLANK}]+", " "))


def file_url(href: Column) -> Column:
    """struct(file_path, file_name, storage_key) of a file's address; the key keeps its case."""
    file = F.regexp_replace(path(href), "^file:///?", "")
    parts = F.filter(F.split(file, "/"), lambda p: p != "")
    raw = F.filter(F.split(F.coalesce(href, F.lit("")), r"[\\/]"), lambda p: p != "")
    after = lambda a: F.get(a, (F.size(a) - F.array_position(F.reverse(a), "storage") + 1).cast("int"))
    key = lambda a: F.when(F.array_contains(a, "storage"), after(a))
    return F.struct(file.alias("file_path"), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")).alias("file_name"), F.coalesce(key(raw), key(parts), F.lit("")).alias("storage_key"))


def creator_names(creators: Column) -> Column:
    """Names of creators: the whole one, else family and given name."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    name = lambda c: F.when(F.coalesce(c["name"], F.lit("")) != "", c["name"]).otherwise(F.trim(F.concat_ws(" ", t(c["lastName"]), t(c["firstName"]))))
    return F.filter(F.transform(creators, name), lambda n: n != "")


def filled(*columns: Column) -> Column:
    """The first that isn't empty, else an empty text."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def summary(authors: Column, year: Column, venue: Column) -> Column:
    return F.array_join(F.filter(F.array(authors, year, venue), lambda x: x != ""), " · ")


def title(own: Column, attachment: Column, file: Column) -> Column:
    """The parent's title, else the attachment's if it says something, else the file's name."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return filled(t(own), F.when(T.placeholder_title(attachment), F.lit("")).otherwise(t(attachment)), F.trim(F.regexp_replace(F.coalesce(file, F.lit("")), r"(?i)\.pdf$", "")))


def library_state(status: Column, body: Column) -> Column:
    """available, api-disabled, not-running or error, from the answer to a probe."""
    off = (status == 403) & F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("not enabled"))
    return F.when((status >= 200) & (status < 300), "available").when(off, "api-disabled").when(status == 0, "not-running").otherwise("error")


def preference(text: Column, name: str) -> Column:
    """A boolean preference; null where it isn't set."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), rf"""user_pref\(\s*["']{re.escape(name)}["']\s*,\s*(true|false)\s*\)""", 1)
    return F.when(found != "", found == "true")


def pages(content: Column) -> Column:
    """Pages of a full text that form feeds part, without blank ones at the end."""
    every = F.split(F.coalesce(content, F.lit("")), "\f", -1)
    last = F.aggregate(F.transform(every, lambda p, i: F.when(T.trimmed(p) != "", i + 1).otherwise(1)), F.lit(1), lambda a, x: F.greatest(a, x))
    return F.slice(every, 1, last)


def parent_key(up: Column, parent: Column) -> Column:
    """The parent's key from the link upwards, else as the item names it."""
    found = F.try_url_decode(F.regexp_extract(F.coalesce(up, F.lit("")), r"/items/([^/?#]+)", 1))
    return F.coalesce(F.when(found != "", found), F.when(parent != "", parent))


def annotation_boxes(position: Column, height: Column) -> Column:
    """Top-down rectangles of a position, without those of hardly any width or height."""
    flip = lambda r: T.flipped(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(2)), F.get(r, F.lit(3)), height)
    return F.filter(F.transform(F.filter(position["rects"], lambda r: F.size(r) >= 4), flip), lambda b: (b["w"] > 0.5) & (b["h"] > 0.5))


def annotation_text(text: Column, comment: Column, kind: Column) -> Column:
    other = F.when(kind == "image", NO_TEXT["image"]).when(kind == "ink", NO_TEXT["ink"]).otherwise(OTHER_TEXT)
    return F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)) for c in (text, comment)), other)
