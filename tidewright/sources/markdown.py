"""Prose spans of a Markdown text, by a line scanner over nested containers.

The scanner walks the lines once. For every line it strips the containers that are
still open (block quotes, list items, footnotes), then decides what the rest is. Only
paragraphs and headings become spans; whatever is not recognised stays outside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import NamedTuple

# Markers that may stand before prose, a footnote's label.
MARKER = re.compile(r"(?:[ \t]*>)*[ \t]*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+)?")
FOOTNOTE = re.compile(r"\[\^[^\]]*\]:[ \t]*")

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)(.*)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
_NOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
_DEFINITION = re.compile(r" {0,3}\[(?!\^)(?:[^\[\]\\]|\\.)+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_HTML = re.compile(r" {0,3}(?:<!--|<\?|<![A-Za-z]|</?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_HTML_RAW = re.compile(r" {0,3}<(script|pre|style|textarea)\b", re.I)
# an element alone on its line; other inline elements may begin a paragraph
_HTML_BLOCK = re.compile(
    r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
    re.I,
)
_ALONE = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$")
_TABLE_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_IMAGES = re.compile(r"(?:!\[(?:[^\[\]]|\[[^\]]*\])*\]\((?:[^()]|\([^)]*\))*\)\s*)+")


@dataclass
class Span:
    start: int
    end: int
    block: str
    heading: bool = False
    indent: str = ""


class _Line(NamedTuple):
    """A line of a paragraph: where it begins, its text begins (past its containers), it ends; how many characters before its
    first word are blanks and quote marks; where its words end if a hard line break follows, -1 if none does."""

    at: int
    text: int
    end: int
    lead: int
    stop: int


def unprefixed(text: str, prefix: str | None) -> str:
    """Without the container's prefix on every line but the first; a line without it is left-stripped."""
    if not prefix or "\n" not in text:
        return text
    first, *rest = text.split("\n")
    return "\n".join([first, *(x[len(prefix) :] if x.startswith(prefix) else x.lstrip("> \t") for x in rest)])


@dataclass
class _Box:
    kind: str  # quote, item or note
    width: int = 0


def _indent(s: str) -> int:
    return len(s) - len(s.lstrip(" ")) if "\t" not in s[:4] else len(s.expandtabs(4)) - len(s.expandtabs(4).lstrip(" "))


class _Scanner:
    def __init__(self, source: str):
        self.source = source
        self.spans: list[Span] = []
        self.boxes: list[_Box] = []
        self.paragraph: list[_Line] = []
        self.fence = self.raw = ""
        self.table = self.math = False
        self.blank = True

    def take(self, at: int, text: int, end: int) -> None:
        """Adds a line to the paragraph. Two blanks or a backslash at its end break it for good if another line follows."""
        line = self.source[at:end]
        words = len(line.rstrip(" \t"))
        stop = end - 1 if line.endswith("\\") else at + words if len(line) - words >= 2 else -1
        self.paragraph.append(_Line(at, text, end, len(line) - len(line.lstrip(" \t>")), stop))

    def close(self) -> None:
        lines, self.paragraph = self.paragraph, []
        if not lines or _IMAGES.fullmatch(self.source[lines[0].text : lines[-1].end].strip()):
            return
        start = lines[0].at + MARKER.match(self.source[lines[0].at : lines[0].end]).end()
        note = FOOTNOTE.match(self.source, start, lines[0].end)
        start = note.end() if note else start
        # later lines begin as the second one does, or with the first one's marks but for quote marks blanked
        shown = self.source[lines[1].at : lines[1].at + lines[1].lead] if len(lines) > 1 else ""
        self.emit(start, lines, Span(0, 0, "paragraph_open", False, shown or re.sub("[^>]", " ", self.source[lines[0].at : start])))

    def emit(self, start: int, lines: list[_Line], like: Span) -> None:
        """Spans of lines from ``start`` on, one for each stretch without a hard line break."""
        last = len(lines) - 1
        for k, line in enumerate(lines):
            stop = line.end if k == last else line.stop
            if stop < 0:
                continue
            if self.source[start:stop].strip():
                self.spans.append(replace(like, start=start, end=stop))
            start = lines[k + 1].at + lines[k + 1].lead if k < last else stop

    def heading(self, content: str, lines: list[_Line]) -> None:
        """The words of a heading of one or more lines, if they stand in the text as they are."""
        content = content.strip()
        at = self.source.find(content, lines[0].at, lines[-1].end) if content else -1
        if at >= 0 and not _IMAGES.fullmatch(content):
            end = at + len(content)
            self.emit(at, [*(x for x in lines[:-1] if x.end < end), lines[-1]._replace(end=end)], Span(0, 0, "heading_open", True, ""))

    def enter(self, line: str) -> tuple[str, int]:
        """(rest of the line after the containers still open, how many of them it continues)"""
        at, k = 0, 0
        for box in self.boxes:
            rest = line[at:]
            if box.kind == "quote":
                m = re.match(r" {0,3}>[ \t]?", rest)
                if not m:
                    break
                at += m.end()
            elif not rest.strip():
                pass
            elif _indent(rest) >= box.width:
                cut = 0
                while cut < len(rest) and cut < box.width and rest[cut] == " ":
                    cut += 1
                at += cut if cut else 1
            else:
                break
            k += 1
        return line[at:], k

    def feed(self, at: int, line: str) -> None:
        end = at + len(line)
        rest, depth = self.enter(line)
        if depth < len(self.boxes):
            if self.paragraph and rest.strip() and not self.starts(rest, any(b.kind == "item" for b in self.boxes[depth:])):  # a lazy line
                self.take(at, end - len(rest), end)
                return
            self.close()
            self.fence = self.raw = ""
            self.table = self.math = False
            del self.boxes[depth:]
        if self.fence:
            if re.fullmatch(rf" {{0,3}}{re.escape(self.fence[0])}{{{len(self.fence)},}}[ \t]*", rest):
                self.fence = ""
            return
        if self.math:
            self.math = "$$" not in rest
            return
        if self.raw:
            if self.raw == "\n" and not rest.strip() or self.raw != "\n" and self.raw in rest.lower():
                self.raw = ""
            return
        while True:
            if not rest.strip():
                self.close()
                self.table = False
                self.blank = True
                return
            if not self.paragraph and _indent(rest) >= 4:
                self.blank = False
                return  # indented code
            quote = re.match(r" {0,3}>[ \t]?", rest)
            item = _ITEM.match(rest)
            note = _NOTE.match(rest)
            if quote:
                self.close()
                self.boxes.append(_Box("quote"))
                rest = rest[quote.end() :]
                self.table = False
                continue
            if item and not _RULE.match(rest) and _indent(rest) < 4 and not (self.paragraph and (not item.group(4) or item.group(3) not in (None, "1"))):
                self.close()
                gap = item.group(4) or " "
                self.boxes.append(_Box("item", len(item.group(1)) + len(item.group(2)) + (len(gap) if len(gap) < 5 else 1)))
                rest = rest[item.end() :] if len(gap) < 5 else rest[item.start(4) + 1 :]
                self.table = False
                continue
            if note and not any(b.kind == "note" for b in self.boxes):
                self.close()
                self.boxes.append(_Box("note", 4))
                rest = rest[note.end() :]
                continue
            break
        self.block(at, end, rest)
        self.blank = False

    def starts(self, rest: str, listed: bool) -> bool:
        """Whether a line begins a block that ends a paragraph; in a list, an item of any number does."""
        item = _ITEM.match(rest)
        return bool(_FENCE.match(rest) or _HEADING.match(rest) or _RULE.match(rest) or re.match(r" {0,3}>", rest) or _HTML_BLOCK.match(rest) or item and (listed or item.group(4) and item.group(3) in (None, "1")) or _NOTE.match(rest))

    def block(self, at: int, end: int, rest: str) -> None:
        text = end - len(rest)
        fence = _FENCE.match(rest)
        if fence:
            self.close()
            self.fence = fence.group(1)
            return
        if _HTML_RAW.match(rest) or not self.paragraph and _HTML.match(rest) and (rest.lstrip().startswith(("<!--", "<?", "<!")) or _HTML_BLOCK.match(rest) or _ALONE.match(rest)) or self.paragraph and (_HTML_BLOCK.match(rest) or rest.lstrip().startswith("<!--")):
            self.close()
            s = rest.strip()
            stop = "-->" if s.startswith("<!--") else "?>" if s.startswith("<?") else f"</{_HTML_RAW.match(rest).group(1).lower()}>" if _HTML_RAW.match(rest) else ">" if s.startswith("<!") else "\n"
            self.raw = "" if stop != "\n" and stop in s.lower() else stop
            return
        heading = _HEADING.match(rest)
        if heading:
            self.close()
            self.heading(re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", heading.group(2)), [_Line(at, text, end, 0, -1)])
            return
        setext = _SETEXT.match(rest)
        if setext and self.paragraph:
            lines, self.paragraph = self.paragraph, []
            self.heading("\n".join(self.source[x.text : x.end] for x in lines), lines)
            return
        if _RULE.match(rest):
            self.close()
            return
        if self.table:
            if "|" in rest:
                return
            self.table = False
        if len(self.paragraph) == 1 and "-" in rest and _TABLE_ROW.match(rest):
            head = self.source[self.paragraph[0].text : self.paragraph[0].end]
            cells = lambda s: len(re.split(r"(?<!\\)\|", s.strip().strip("|")))
            if "|" in head + rest and cells(head) == cells(rest):
                self.paragraph, self.table = [], True
                return
        if not self.paragraph:
            if rest.lstrip().startswith("$$"):
                body = rest.strip()[2:]
                self.math = "$$" not in body
                if self.math or re.search(r"\$\$\s*(?:\([^)]*\))?\s*$", body):
                    return
                self.math = False
            if _DEFINITION.match(rest):
                return
        self.take(at, text, end)


def prose(source: str) -> list[Span]:
    """Spans of prose, in order. Offsets are code points; lines end at line feeds only."""
    s = _Scanner(source)
    at = 0
    lines = source.split("\n")
    k = 0
    if lines and lines[0].rstrip() == "---" and any(x.rstrip() in ("---", "...") for x in lines[1:]):  # front matter
        k = next(i for i in range(1, len(lines)) if lines[i].rstrip() in ("---", "...")) + 1
        at = sum(len(x) + 1 for x in lines[:k])
    for line in lines[k:]:
        s.feed(at, line)
        at += len(line) + 1
    s.close()
    return sorted(s.spans, key=lambda x: x.start)
