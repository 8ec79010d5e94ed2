"""Text functions: native columns where SQL has the semantics, Arrow-batched kernels where it hasn't."""

from __future__ import annotations

import difflib
import html
import json
import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from typing import Iterator, Tuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

# kernels over Arrow batches

#: Characters after which results go back to Spark. A batch may hold 64 MB of texts; only the batch itself is held whole.
PIECE = 1 << 20


def pieces(batches: Iterable[tuple[pa.Array, ...]], fn: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """Results of fn for the rows of batches, taken one by one; as many rows in all, in arrays of about PIECE characters."""
    for columns in batches:
        made, size = [], 0
        for row in zip(*columns):
            made.append(fn(*(v.as_py() for v in row)))
            size += len(made[-1]) if isinstance(made[-1], str) else 8
            if size >= PIECE:
                yield pa.array(made, kind)
                made, size = [], 0
        yield pa.array(made, kind)


def each(fn, kind=StringType()):
    """A string function as an Arrow-batched column function; null stays null."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from pieces(((b,) for b in batches), lambda v: None if v is None else fn(v), arrow)

    return run


def each_pair(fn):
    """A function of two strings, null included, as an Arrow-batched column function that returns a string."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from pieces(batches, fn, pa.string())

    return run


def split(text: Column, by: str = " ") -> Column:
    """A single space splits at runs of white space; an empty separator into characters."""
    if by == " ":
        return F.split(F.trim(text), r"\s+")
    return F.filter(F.split(text, re.escape(by) if by else ""), lambda x: x != "") if not by else F.split(text, re.escape(by))


def sha1_base64(text: Column) -> Column:
    return F.base64(F.unhex(F.sha1(text)))


def quote(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def blank_node(*parts: Column) -> Column:
    """A blank node label: fixed by its parts, or fresh."""
    return F.concat(F.lit("bnode:x"), F.sha1(F.concat_ws("\x01", *parts)) if parts else F.replace(F.uuid(), F.lit("-"), F.lit("")))


def epoch(at: Column) -> Column:
    """Epoch seconds with three decimals, as text."""
    return F.format_string("%.3f", F.unix_micros(at) / 1e6)


FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD"}


def pattern(fmt: str) -> str:
    """A strftime format as a Spark one."""
    return re.sub(r"%.|[A-Za-z]+", lambda m: FORMATS.get(m[0], m[0]) if m[0][0] == "%" else f"'{m[0]}'", fmt)


def parse_date(text: Column, fmt: str) -> Column:
    return F.format_string("%.3f", F.unix_timestamp(text, pattern(fmt)).cast("double"))


def format_time(seconds: Column, fmt: str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds.cast("double")), pattern(fmt))


def bits_alike(a: Column, b: Column) -> Column:
    """128 minus the differing bits of two 256-bit digests in hex, as fuzzy digests are compared."""
    differ = sum((F.bit_count(F.conv(F.substring(a, i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, 8), 16, 10).cast("long"))) for i in range(1, 65, 8)), F.lit(0))
    return F.lit(128) - differ


# line diffs


def line_diff(old: str, new: str, most: float | None = None) -> list | None:
    """Operations (kind, start, end, lines) with kind r, d or i; None if they are longer than most of the new text."""
    a, b = old.splitlines(True), new.splitlines(True)
    kinds = {"replace": "r", "delete": "d", "insert": "i"}
    ops = [(kinds[tag], i, j, b[x:y]) for tag, i, j, x, y in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
    if most is not None and sum(len(x) for o in ops for x in o[3]) > most * len(new):
        return None
    return ops


def line_patch(old: str, ops: list) -> str:
    lines, shift = old.splitlines(True), 0
    for kind, i, j, new in ops:
        lines[i + shift : j + shift] = new
        shift += len(new) - (j - i)
    return "".join(lines)


diff_json = each_pair(lambda old, new: None if old is None or new is None else json.dumps(line_diff(old, new)))
patch_json = each_pair(lambda old, ops: None if old is None or ops is None else line_patch(old, json.loads(ops)))
html_diff = each_pair(lambda old, new: difflib.HtmlDiff(wrapcolumn=80).make_table((old or "").splitlines(), (new or "").splitlines()))


# HTML

VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "param"}
BANNED = {"script", "iframe", "object", "embed", "applet", "frame", "frameset", "base", "meta", "link", "style"}
ALLOWED = {"a", "abbr", "b", "blockquote", "br", "code", "div", "em", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "ol", "p", "pre", "span", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tr", "u", "ul"}
URLS = {"href", "src", "action", "background", "cite", "data", "longdesc"}
SCHEMES = {"http", "https", "mailto", "ftp", "site", "data-image", ""}


def scheme(url: str) -> str:
    plain = re.sub(r"[\x00-\x20\xa0]+", "", html.unescape(html.unescape(url))).lower()
    m = re.match(r"([^/?#:]*):", plain)
    return m[1] if m else ""


class Cleaner(HTMLParser):
    """Writes HTML again without what may run: banned elements with their content, event attributes, script URLs."""

    def __init__(self, allowed: set[str] | None = None, fix=None, nofollow: bool = False):
        super().__init__(convert_charrefs=False)
        self.out, self.skip, self.allowed, self.fix, self.nofollow = [], [], allowed, fix, nofollow

    def keeps(self, tag: str) -> bool:
        return tag in self.allowed if self.allowed is not None else tag not in BANNED

    def handle_starttag(self, tag, attrs, closed=False):
        if self.skip or tag in BANNED and tag not in VOID and not self.keeps(tag):
            if tag not in VOID and not closed:
                self.skip.append(tag)
            return
        if not self.keeps(tag):
            return
        text = ""
        for name, value in attrs:
            value = value or ""
            if name.startswith("on") or name == "style" and re.search(r"expression|javascript|url\s*\(", html.unescape(value), re.I):
                continue
            if name in URLS:
                value = self.fix(value) if self.fix else value
                if scheme(value) not in SCHEMES:
                    value = ""
            text += f' {name}="{html.escape(value, quote=True)}"'
        if self.nofollow and tag == "a":
            text += ' rel="nofollow"'
        self.out.append(f"<{tag}{text}{' /' if closed else ''}>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif self.keeps(tag) and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def done(self, text: str) -> str:
        self.feed(text)
        self.close()
        return "".join(self.out)


class Truncator(HTMLParser):
    """Keeps the first words of a body and closes what is open; text of the head is no text."""

    def __init__(self, words: int):
        super().__init__(convert_charrefs=False)
        self.left, self.open, self.out, self.head = words, [], [], 0

    def handle_starttag(self, tag, attrs):
        if self.left > 0:
            self.head += tag in ("head", "title", "script", "style")
            self.out.append(self.get_starttag_text())
            if tag not in VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if self.left > 0:
            self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if self.left > 0 and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.head -= last in ("head", "title", "script", "style")
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if self.left <= 0:
            return
        if self.head:
            self.out.append(data)
            return
        spots = list(re.finditer(r"\S+", data))
        if len(spots) > self.left:
            data = data[: spots[self.left - 1].end()]
        self.left -= min(len(spots), self.left)
        self.out.append(data)

    def handle_entityref(self, name):
        if self.left > 0:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.handle_entityref(f"#{name}")

    def done(self, text: str) -> str:
        self.feed(text)
        self.close()
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def html_truncate(text: str, words: int) -> str:
    """The ``div`` of class summary if there is one, else the first words."""
    m = re.search(r"<div[^>]*class=[\"']?summary[\"']?[^>]*>(.*?)</div>", text, re.S | re.I)
    return m[1] if m else Truncator(words).done(text)


def truncate_text(text: Column, words: int) -> Column:
    """The first words of a plain text, with the white space between them."""
    return F.regexp_extract(text, rf"^(\s*(?:\S+\s+){{0,{words - 1}}}\S+)", 1)


def fix_links(text: str, scheme_: str = "site:", base: str = "/", nofollow: bool = False) -> str:
    """Internal links point below base; outside ones may get nofollow."""
    return Cleaner(fix=lambda u: base + u[len(scheme_) :].lstrip("/") if u.startswith(scheme_) else u, nofollow=nofollow).done(text)


def sanitised(text: Column) -> Column:
    return each(lambda v: Cleaner().done(v))(text)


def whitelisted(text: Column) -> Column:
    return each(lambda v: Cleaner(ALLOWED).done(v))(text)


def truncated(text: Column, words: int) -> Column:
    return each(lambda v: html_truncate(v, words))(text)


def fixed_links(text: Column, scheme_: str, base: str) -> Column:
    return each(lambda v: fix_links(v, scheme_, base))(text)
