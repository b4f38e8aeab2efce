"""Markdown as sections of plain text.

A block reader tells headings, paragraphs, fenced and indented code, quotes, lists, tables,
rules, HTML blocks, link definitions; quotes and list items are read again from their
inner lines. An inline reader then takes marks away: emphasis, strong and struck-out
text, code spans, links and images (their text stays), automatic links, escapes and
entities; HTML stays as it is. A section is a heading with all up to the next one, its
blocks parted by blank lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +|\t)(.*)|)$")
QUOTE = re.compile(r" {0,3}> ?")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r""" {0,3}\[([^\]]+)\]:[ \t]*(\S+)(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*$""")
HTML_BLOCK = re.compile(r" {0,3}<(?:!--|[?]|/?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b)", re.I)


def _cells(line: str) -> list[str]:
    bare = line.strip().removeprefix("|")
    bare = bare[:-1] if bare.endswith("|") and not bare.endswith("\\|") else bare
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", bare)]


INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n)|(?P<code>(?<!`)(`+)(?!`)(?P<inner>.+?)(?<!`)\4(?!`))|(?P<auto><(?:[A-Za-z][\w+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>)"
    r"|(?P<comment><!--.*?-->)|(?P<tag></?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>)|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w*);)|(?P<link>!?\[)|(?P<mark>\*+|_+|~~)",
    re.S,
)
TARGET = re.compile(r"""\(\s*(?:<[^<>\n]*>|(?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*)(?:\s+(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?\s*\)""")


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one before ``at``, or -1."""
    depth = 1
    for found in re.compile(r"\\.|`+|[\[\]]", re.S).finditer(text, at):
        depth += {"[": 1, "]": -1}.get(found[0], 0)
        if not depth:
            return found.start()
    return -1


def _flanks(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a run of marks can open, and can close."""
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "

    def mark(c: str) -> bool:
        return not c.isalnum() and not c.isspace()

    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    if text[start] == "_":
        return left and (not right or mark(before)), right and (not left or mark(after))
    return left, right


def plain(text: str, known: frozenset[str] = frozenset()) -> str:
    """Inline text without its marks; ``known`` are the labels that links may refer to."""
    out: list[str] = []
    open_: list[list] = []  # [mark, runs left, place in out]
    at = 0
    while found := INLINE.search(text, at):
        out.append(text[at : found.start()])
        at = found.end()
        kind = next(k for k in ("escape", "hard", "code", "auto", "comment", "tag", "entity", "link", "mark") if found[k])
        if kind == "escape":
            out.append(found[0][1])
        elif kind == "hard":
            out.append("\n")
        elif kind == "code":
            inner = found["inner"].replace("\n", " ")
            out.append(inner[1:-1] if inner.strip() and inner[0] == inner[-1] == " " else inner)
        elif kind == "auto":
            out.append(found[0][1:-1])
        elif kind == "entity":
            out.append(html.unescape(found[0]))
        elif kind == "link":
            close = _closing(text, at)
            inner = text[at:close] if close >= 0 else None
            target = TARGET.match(text, close + 1) if inner is not None else None
            label = re.compile(r"\[([^\[\]]*)\]").match(text, close + 1) if inner is not None and not target else None
            named = " ".join(((label and label[1]) or inner or "").lower().split())
            if target or inner is not None and named in known:
                out.append(plain(inner, known))
                at = target.end() if target else label.end() if label else close + 1
            else:
                out.append(found[0])
        elif kind == "mark":
            opens, closes = _flanks(text, found.start(), found.end())
            sign, left = found[0][0], len(found[0])
            while closes and left:
                match = next((o for o in reversed(open_) if o[0] == sign and o[1]), None)
                if not match:
                    break
                used = 2 if min(match[1], left) >= 2 else 1
                if sign == "~" and used < 2:
                    break
                match[1] -= used
                left -= used
                out[match[2]] = out[match[2]][used:]
                del open_[open_.index(match) + 1 :]
                if not match[1]:
                    open_.remove(match)
            if left and opens:
                open_.append([sign, left, len(out)])
            out.append(sign * left)
        else:
            out.append(found[0])
    return "".join([*out, text[at:]])


def _blocks(lines: list[str], known: frozenset[str]) -> Iterator[tuple[str, int, str]]:
    """(kind, level, plain text) of each block."""
    paragraph: list[str] = []
    i = 0

    def closed() -> Iterator[tuple[str, int, str]]:
        if paragraph:
            yield "text", 0, plain("\n".join(x.lstrip() for x in paragraph).rstrip(), known)
            paragraph.clear()

    while i < len(lines):
        line = lines[i].expandtabs(4)
        fence, heading, item = FENCE.match(line), HEADING.match(line), ITEM.match(line)
        if not line.strip():
            yield from closed()
        elif fence and not (fence[1][0] == "`" and "`" in fence[2]):
            yield from closed()
            indent, body = len(line) - len(line.lstrip()), []
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[i]):
                body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            yield "code", 0, "\n".join(body)
        elif heading:
            yield from closed()
            yield "heading", len(heading[1]), plain(heading[2] or "", known).strip()
        elif paragraph and UNDERLINE.match(line):
            title = plain("\n".join(x.strip() for x in paragraph), known)
            paragraph.clear()
            yield "heading", 1 if line.strip()[0] == "=" else 2, title
        elif RULE.match(line):
            yield from closed()
        elif QUOTE.match(line):
            yield from closed()
            inner = []
            while i < len(lines) and lines[i].strip() and (QUOTE.match(lines[i]) or inner[-1].strip() and not (FENCE.match(lines[i]) or HEADING.match(lines[i]) or ITEM.match(lines[i]) or RULE.match(lines[i]))):
                inner.append(QUOTE.sub("", lines[i], count=1))
                i += 1
            i -= 1
            yield "text", 0, "\n".join(t for _, _, t in _blocks(inner, known) if t)
        elif item and not (paragraph and (not (item[4] or "").strip() or item[2][0].isdigit() and item[2][:-1] != "1")):
            yield from closed()
            parts = []
            while i < len(lines) and (item := ITEM.match(lines[i].expandtabs(4))) and not RULE.match(lines[i]):
                width = len(item[1]) + len(item[2]) + (len(item[3]) if item[3] and len(item[3]) <= 4 else 1)
                inner = [" " * (len(item[3] or " ") - 1) * (len(item[3] or "") > 4) + (item[4] or "")]
                i += 1
                while i < len(lines):
                    next_ = lines[i].expandtabs(4)
                    if not next_.strip():
                        if i + 1 < len(lines) and lines[i + 1].strip() and len(lines[i + 1].expandtabs(4)) - len(lines[i + 1].expandtabs(4).lstrip()) >= width:
                            inner.append("")
                        else:
                            break
                    elif len(next_) - len(next_.lstrip()) >= width:
                        inner.append(next_[width:])
                    elif inner[-1].strip() and not (ITEM.match(next_) or FENCE.match(next_) or HEADING.match(next_) or QUOTE.match(next_) or RULE.match(next_)):
                        inner.append(next_.lstrip())
                    else:
                        break
                    i += 1
                parts += [t for _, _, t in _blocks(inner, known) if t]
                if i + 1 < len(lines) and not lines[i].strip() and ITEM.match(lines[i + 1].expandtabs(4)):
                    i += 1
            i -= 1
            yield "text", 0, "\n".join(parts)
        elif "|" in line and i + 1 < len(lines) and TABLE_RULE.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            yield from closed()
            rows, width = [_cells(line)], len(_cells(line))
            i += 2
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                rows.append((_cells(lines[i]) + [""] * width)[:width])
                i += 1
            i -= 1
            yield "text", 0, "\n".join(" | ".join(plain(c, known) for c in row) for row in rows)
        elif not paragraph and line.startswith("    "):
            body = []
            while i < len(lines) and (not lines[i].strip() or lines[i].expandtabs(4).startswith("    ")):
                body.append(lines[i].expandtabs(4)[4:])
                i += 1
            i -= 1
            yield "code", 0, "\n".join(body).strip("\n")
        elif not paragraph and DEFINITION.match(line):
            pass
        elif not paragraph and HTML_BLOCK.match(line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            i -= 1
            yield "html", 0, "\n".join(body)
        else:
            paragraph.append(line)
        i += 1
    yield from closed()


def sections_of(text: str) -> Iterator[dict]:
    """Sections with heading_path and heading_level; what stands before the first heading has none."""
    lines = re.split(r"\r\n|\r|\n", text)
    known = frozenset(" ".join(m[1].lower().split()) for m in map(DEFINITION.match, lines) if m)
    trail: list[str] = []
    path, level, body = None, None, []
    for kind, rank, content in _blocks(lines, known):
        if kind == "heading":
            if body:
                yield {"text": "\n\n".join(body), "heading_path": path, "heading_level": level}
            trail[rank - 1 :] = [content]
            path, level, body = " > ".join(trail), rank, [content] if content else []
        elif content.strip():
            body.append(content.strip("\n") if kind == "code" else content.strip())
    if body:
        yield {"text": "\n\n".join(body), "heading_path": path, "heading_level": level}
