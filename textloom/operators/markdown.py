"""Markdown structure in one Arrow stage: lines with kinds and blocks, opaque spans, and visible text.

The scanner follows the block rules of CommonMark and GFM as far as line kinds need them: containers first, then
fences, HTML, headings, breaks, tables, lists, quotes and paragraphs; a setext underline and a table delimiter change
the kind of lines before them.  Inline spans are found per block, so none crosses a block.  A document is scanned by
one task in one pass over its lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_SCHEMA = "line int, raw string, start long, kind string, quote_depth int, list_item boolean, block int, visible string, unquoted string"
SPAN_SCHEMA = "s long, e long, kind string"

_QUOTE = re.compile(r" {0,3}>[ \t]?")
_ITEM = re.compile(r"([ \t]*)([-+*]|[0-9]{1,9}[.)])(?:[ \t]+|$)")
_FENCE = re.compile(r" {0,3}(`{3,})[^`]*$| {0,3}(~{3,}).*$")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_RAW = re.compile(r" {0,3}<(script|pre|style|textarea)(?=[\s>]|$)", re.I)
#: HTML elements that open a block, as CommonMark lists them.
_HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_HTML_BLOCK = re.compile(r" {0,3}</?(?:" + "|".join(_HTML_BLOCKS) + r")(?=[\s/>]|$)", re.I)
_TAG = re.compile(r"<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?)>")
_TOKEN = re.compile(r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>")
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
def _nested(depth: int) -> str:
    """Characters of a destination with balanced parentheses down to ``depth``; nothing is given back once it is taken."""
    plain = r"(?:\\[()]|[^\s()<>])*+"
    return rf"{plain}(?:\({_nested(depth - 1)}\){plain})*+" if depth else plain


_DESTINATION = re.compile(rf"\(\s*(?:<[^<>\n]*>|{_nested(32)})(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")  # 32: a fixed value
_BARE_URL = re.compile(r"(?:https?://|(?<![A-Za-z0-9/.:_-])www\.)[^\s<>]+")
_REFERENCE = re.compile(r" {0,3}\[(?!\s*\])(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_PLAIN = ("paragraph", "list", "quote")


@dataclass
class Line:
    line: int
    raw: str
    start: int
    kind: str = "paragraph"
    depth: int = 0
    item: bool = False
    prefix: int = 0
    block: int = 0


@dataclass
class _State:
    fence: tuple[str, int, int] | None = None  # character, width, quote depth
    html: re.Pattern | None = None  # what ends the open HTML block; None where a blank line does
    in_html: bool = False
    indent: int = 0  # content column of the open list item
    lines: list[Line] = field(default_factory=list)
    block: int = 0


def _columns(text: str) -> int:
    """Columns of blank before the first other character; tabs stop every 4."""
    n = 0
    for c in text:
        if c == "\t":
            n += 4 - n % 4
        elif c == " ":
            n += 1
        else:
            break
    return n


def _cells(text: str) -> int:
    body = text.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return len(re.findall(r"(?<!\\)\|", body)) + 1


def _lines(text: str) -> list[Line]:
    out, at = [], 0
    for n, raw in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        out.append(Line(n, raw, at))
        at += len(raw) + (2 if text.startswith("\r\n", at + len(raw)) else 1)
    return out


def _front_matter(lines: list[Line]) -> int:
    """Lines of the front matter, 0 where there is none."""
    if lines[0].raw != "---":
        return 0
    return next((x.line for x in lines[1:] if x.raw == "---"), 0)


def _open_html(body: str, inside: bool) -> tuple[bool, re.Pattern | None]:
    """Whether an HTML block opens, and what closes it (None: a blank line)."""
    if found := _HTML_RAW.match(body):
        return True, re.compile(rf"</{found[1]}>", re.I)
    for opener, closer in ((r" {0,3}<!--", "-->"), (r" {0,3}<\?", r"\?>"), (r" {0,3}<!\[CDATA\[", r"\]\]>"), (r" {0,3}<![A-Za-z]", ">")):
        if re.match(opener, body):
            return True, re.compile(closer)
    if _HTML_BLOCK.match(body):
        return True, None
    whole = body.strip()
    return (not inside and bool(_TAG.fullmatch(whole))), None


def _containers(x: Line, s: _State, before: Line | None) -> str:
    """Takes quote and list marks off a line; the rest of it."""
    at = 0
    while found := _QUOTE.match(x.raw, at):
        x.depth, at = x.depth + 1, found.end()
    rest = x.raw[at:]
    if s.fence:
        x.prefix = at
        return rest
    para = before is not None and before.kind in _PLAIN and before.depth == x.depth
    broken = _BREAK.match(rest) or (para and _SETEXT.match(rest))
    found = None if broken else _ITEM.match(rest)
    if found and _columns(rest) < s.indent + 4:
        x.item = True
        s.indent = _columns(found[1]) + len(found[2]) + 1
        at += found.end()
    elif rest.strip() and s.indent:
        if _columns(rest) >= s.indent:
            at += len(rest) - len(rest.lstrip(" \t"))
        elif not (before is not None and before.kind == "list"):
            s.indent = 0
    x.prefix = at
    return x.raw[at:]


def _kind(x: Line, rest: str, s: _State) -> str:
    before = s.lines[-1] if s.lines else None
    if s.fence and x.depth < s.fence[2]:
        s.fence = None
    if s.fence:
        close = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*$", rest)
        if close and close[1][0] == s.fence[0] and len(close[1]) >= s.fence[1]:
            s.fence = None
        return "code"
    if s.in_html:
        if s.html is None and not rest.strip():
            s.in_html = False
        else:
            s.in_html = not (s.html and s.html.search(rest))
            return "html_block"
    open_text = before is not None and before.kind in _PLAIN and before.depth == x.depth
    if found := _FENCE.match(rest):
        mark = found[1] or found[2]
        s.fence = (mark[0], len(mark), x.depth)
        return "code"
    if _columns(rest) >= 4 and rest.strip() and not open_text and not x.item:
        return "code"
    if not rest.strip():
        return "blank"
    if _ATX.match(rest):
        return "heading"
    if open_text and not x.item and before.kind != "list" and _SETEXT.match(rest):
        for y in reversed(s.lines):
            if y.block != before.block:
                break
            y.kind = "heading"
        return "heading_underline"
    if _BREAK.match(rest):
        return "thematic_break"
    if open_text and _DELIMITER.match(rest) and "|" in before.raw and _cells(rest) == _cells(before.raw[before.prefix :]):
        before.kind = "table"
        s.block += 1
        before.block = s.block
        return "table"
    if before is not None and before.kind == "table" and "|" in rest:
        return "table"
    opens, closer = _open_html(rest, open_text)
    if opens:
        s.html, s.in_html = closer, not (closer and closer.search(rest, rest.find("<") + 2))
        return "html_block"
    if x.depth:
        return "quote"
    if x.item or (s.indent and open_text and before.kind == "list"):
        return "list"
    if before is not None and before.kind == "quote" and not x.depth:
        x.depth = before.depth
        return "quote"  # a paragraph line goes on in the quote above it
    return "list" if s.indent and _columns(x.raw) >= s.indent else "paragraph"


def scan_lines(text: str) -> list[Line]:
    lines = _lines(text)
    s, skip = _State(), _front_matter(lines)
    for x in lines:
        if x.line <= skip:
            x.kind = "frontmatter"
        else:
            rest = _containers(x, s, s.lines[-1] if s.lines else None)
            x.kind = _kind(x, rest, s)
        before = s.lines[-1] if s.lines else None
        joins = before is not None and before.kind == x.kind and before.depth == x.depth and x.kind not in ("heading", "table", "thematic_break") and not (x.kind == "list" and x.item)
        if not joins and not (x.kind == "heading_underline" and before is not None):
            s.block += 1
        x.block = s.block
        s.lines.append(x)
    _references(lines)
    return lines


def _references(lines: list[Line]) -> None:
    """Link reference definitions at the start of text blocks."""
    seen = None
    for x in lines:
        if x.kind in (*_PLAIN, "heading") and x.block != seen and _REFERENCE.match(x.raw[x.prefix :]):
            x.kind = "reference_definition"
        elif x.kind != "blank":
            seen = x.block


def inline_spans(text: str) -> list[tuple[int, int, str]]:
    """Opaque spans of one block's text: the earliest start wins, scanning goes on after its end."""
    out, at, opened = [], 0, []
    event = re.compile(r"[\\`<\[\]]|https?://|www\.")
    while found := event.search(text, at):
        p, c = found.start(), found[0]
        if c == "\\":
            if p + 1 < len(text) and text[p + 1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                out.append((p, p + 2, "escape"))
                at = p + 2
            else:
                at = p + 1
        elif c == "`":
            width = len(text) - p - len(text[p:].lstrip("`"))
            close = re.compile(rf"(?<!`)`{{{width}}}(?!`)").search(text, p + width)
            if close:
                out.append((p, close.end(), "inline_code"))
            at = close.end() if close else p + width
        elif c == "<":
            for pattern, kind in ((_AUTOLINK, "autolink"), (_TOKEN, "html_token"), (_TAG, "html_token")):
                if hit := pattern.match(text, p):
                    out.append((p, hit.end(), kind))
                    at = hit.end()
                    break
            else:
                at = p + 1
        elif c == "[":
            opened.append((p, p > 0 and text[p - 1] == "!" and not (p > 1 and text[p - 2] == "\\")))
            at = p + 1
        elif c == "]":
            start = opened.pop() if opened else None
            hit = _DESTINATION.match(text, p + 1) if start else None
            if hit and start[1]:
                out = [x for x in out if x[0] < start[0]]
                out.append((start[0] - 1, hit.end(), "image"))
            elif hit:
                out.append((p + 1, hit.end(), "link_destination"))
            at = hit.end() if hit else p + 1
        else:
            hit = _BARE_URL.match(text, p)
            end = p
            if hit:
                url = re.sub(r"[?!.,:*_~]+$", "", hit[0])
                while url.endswith(")") and url.count(")") > url.count("("):
                    url = url[:-1]
                url = re.split(r"[　、。「」『』（）]", url)[0]
                host = re.match(r"www\.([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", url)
                if not url.startswith("www.") or host:
                    out.append((p, p + len(url), "bare_url"))
                    end = p + len(url)
            at = max(end, p + len(c))
    return out


_OPENERS = {"」": "「", "』": "『", "]": "["}
_ANY_CLOSER = re.compile("[」』\\]]")


def blank_quotes(text: str) -> str:
    """text with balanced 「」, 『』 and [] blanked, whatever stands in them; unclosed ones stay."""
    if not _ANY_CLOSER.search(text):
        return text
    waiting: dict[str, list[int]] = {opener: [] for opener in _OPENERS.values()}
    out = list(text)
    for i, c in enumerate(text):
        if c in waiting:
            waiting[c].append(i)
        elif c in _OPENERS and waiting[_OPENERS[c]]:
            start = waiting[_OPENERS[c]].pop()
            out[start : i + 1] = " " * (i + 1 - start)
    return "".join(out)


def parse(text: str) -> tuple[list[dict], list[dict]]:
    """(lines, spans) of a document; offsets are code points."""
    lines, spans = scan_lines(text), []
    for x in lines:
        if x.kind in ("code", "frontmatter", "html_block", "reference_definition"):
            spans.append((x.start, x.start + len(x.raw), x.kind))
        elif x.prefix:
            spans.append((x.start, x.start + x.prefix, "container_prefix"))
    low = 0
    while low < len(lines):
        high = low
        while high < len(lines) and lines[high].block == lines[low].block:
            high += 1
        own = [x for x in lines[low:high] if x.kind in (*_PLAIN, "heading", "table")]
        if own:
            base = own[0].start
            body = list(text[base : own[-1].start + len(own[-1].raw)])
            for x in own:
                body[x.start - base : x.start - base + x.prefix] = " " * x.prefix
            spans += [(base + s, base + e, k) for s, e, k in inline_spans("".join(body))]
        low = high
    spans.sort()
    shown, hidden = list(text), {"escape"}
    for s, e, kind in spans:
        if kind not in hidden:
            shown[s:e] = [c if c in "\r\n" else " " for c in shown[s:e]]
    shown = "".join(shown)
    rows = [{"line": x.line, "raw": x.raw, "start": x.start, "kind": x.kind, "quote_depth": x.depth, "list_item": x.item, "block": x.block, "visible": (v := shown[x.start : x.start + len(x.raw)]), "unquoted": blank_quotes(v)} for x in lines]
    return rows, [{"s": s, "e": e, "kind": k} for s, e, k in spans]


def _stage(batches):
    line = pa.struct([("line", pa.int32()), ("raw", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("quote_depth", pa.int32()), ("list_item", pa.bool_()), ("block", pa.int32()), ("visible", pa.string()), ("unquoted", pa.string())])
    span = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string())])
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            got = [parse(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.list_(line)), pa.array([g[1] for g in got], pa.list_(span))], ["doc_id", "lines", "spans"])


def parse_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lines, spans of every row of docs (doc_id, text): the only Python stage of the lint plan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_stage, f"doc_id long, lines array<struct<{_typed(LINE_SCHEMA)}>>, spans array<struct<{_typed(SPAN_SCHEMA)}>>")


def _typed(schema: str) -> str:
    return ", ".join(x.strip().replace(" ", ":", 1) for x in schema.split(","))


def lines_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("lines"))


def spans_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("spans"))
