"""Text rules as columns; a Python function only where no built-in has the semantics."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: fixed values: accents and the letters they fold to
ACCENTS = ("àâäáãéèêëíìîïóòôöõúùûüçñÿ", "aaaaaeeeeiiiiooooouuuucny")
#: fixed values: Arabic letter variants, marks and aliases
LETTER_VARIANTS = ("أإآة", "اااه")
DIACRITICS = "[ؐ-ًؚ-ْٰۖ-ۭـ]"
GOVERNORATE_ALIASES = {"el kef": "le kef", "sidi bou zid": "sidi bouzid", "manubah": "manouba"}
TITLE_MARKER = "إشعار بانقطاع الكهرباء"
TITLE = r"إشعار بانقطاع الكهرباء\s*-\s*(.+?)\s*-\s*(\d{1,2}:\d{2})\s+(\d{2}/\d{2}/\d{4})"
SUBREGION = r"^(?:جهة|ولاية)\s+\S"
FUZZY_THRESHOLD = 90.0


def composed(text: Column) -> Column:
    """NFC form; Spark has no built-in for it."""

    @arrow_udf("string")
    def nfc(column: pa.Array) -> pa.Array:
        return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in column.to_pylist()], pa.string())

    return nfc(text)


def normalized(text: Column) -> Column:
    """Trimmed, single spaces, without marks and with letter variants folded; for text in NFC already."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.translate(F.regexp_replace(text, DIACRITICS, ""), *LETTER_VARIANTS)


#: fixed values
TIME_WINDOW = r"(?s)خلال\s+(.+?)(?:،|,)?\s*على مستوى المناطق التالية"


def time_window(raw_text: Column) -> Column:
    """The sentence on the hours of an outage, or null."""
    return F.nullif(F.trim(F.regexp_extract(raw_text, TIME_WINDOW, 1)), F.lit(""))


def json_text(value: Column) -> Column:
    """A string as JSON, null as null; characters beyond ASCII stay."""
    inner = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def raw_snapshot(raw_html: Column, title: Column, notice_date: Column, zones: Column, raw_text: Column) -> Column:
    """The page itself, or where it is missing a JSON object of what is known, keys in order."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(zones, json_text), ", "), F.lit("]"))
    parts = [("notice_date", json_text(notice_date)), ("raw_text", json_text(raw_text)), ("subregions", F.lit("[]")), ("title", json_text(title)), ("zones", listed)]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts]), F.lit("}"))
    return F.coalesce(F.nullif(raw_html, F.lit("")), body)


def token_sort_key(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(text), r"\s+")), " ")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def cleaned_zone(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^[\s\-–—ـ]+", ""), r"\s+$", "")


def title_parts(title: Column) -> Column:
    """Struct of region, time and date of a notice title; nulls where it does not match."""
    part = lambda i: F.nullif(F.regexp_extract(title, TITLE, i), F.lit(""))
    return F.struct(part(1).alias("region"), part(2).alias("time"), part(3).alias("date"))


def page_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)
    plain = F.replace(F.replace(F.replace(inner, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.trim(F.get(F.split(F.replace(plain, F.lit("&amp;"), F.lit("&")), r" \| "), F.lit(0)))


def slug(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def iso_date(raw: Column) -> Column:
    return F.try_to_date(raw, "dd/MM/yyyy").cast("string")


def governorate_key(raw: Column) -> Column:
    key = F.regexp_replace(F.translate(F.lower(F.trim(raw)), *ACCENTS), r"\s+", " ")
    aliases = F.create_map(*[F.lit(x) for kv in GOVERNORATE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, key), key)


def list_items(html: Column) -> Column:
    """Texts of the li elements, tags removed, empty ones left out."""
    inner = F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1)
    return F.filter(F.transform(inner, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


class _Cells(HTMLParser):
    """Lines of the cells of the first table, and of the list items."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[list[str]] = []
        self.items: list[list[str]] = []
        self.tables = self.done = 0
        self.into: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and not self.done:
            self.tables += 1
        elif tag == "td" and self.tables:
            self.cells.append([])
            self.into.append(self.cells[-1])
        elif tag == "li":
            self.items.append([])
            self.into.append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self.tables -= 1
            self.done = not self.tables
        elif tag in ("td", "li") and self.into:
            self.into.pop()

    def handle_data(self, data: str) -> None:
        if self.into:
            self.into[-1].append(data)


def zones(html: str) -> list[tuple[int | None, str | None, int, str]]:
    """(scope ordinal, header, ordinal, zone) of a notice: cells of the first table, else list items."""
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    rows, scope = [], 0
    for cell in parser.cells:
        lines = [re.sub(r"^[\s\-–—ـ]+", "", line).strip() for piece in cell for line in piece.split("\n")]
        lines = [x for x in lines if x]
        header = lines.pop(0) if lines and re.match(SUBREGION, lines[0]) else None
        if header or lines:
            rows += [(scope, header, i, z) for i, z in enumerate(lines)]
            scope += 1
    if rows:
        return rows
    items = [x for x in ("".join(parts).strip() for parts in parser.items) if x]
    return [(None, None, i, z) for i, z in enumerate(items)]


def zones_column(html: Column) -> Column:
    kind = pa.list_(pa.struct([("scope", pa.int32()), ("header", pa.string()), ("ordinal", pa.int32()), ("zone", pa.string())]))

    @arrow_udf("array<struct<scope: int, header: string, ordinal: int, zone: string>>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("scope", "header", "ordinal", "zone"), r)) for r in zones(x)] for x in column.to_pylist()], kind)

    return of(html)
