"""Office files as sections: paragraphs, headings and tables of .docx, slides of .pptx.

Both are zipped XML. A section is a heading with all up to the next one, as in Markdown; its
text begins with the path of headings to it. Tables are lines of cells parted by
pipes. A slide is a section with its number as page, its title as heading, and its notes.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: XML namespaces of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Bytes that one part may unpack to: a small file can't fill a task.
MAX_PART = 256 << 20


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} unpacks to more than {MAX_PART} bytes")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def _related(archive: zipfile.ZipFile, name: str) -> dict[str, tuple[str, str]]:
    """Of a part, its relations: id -> (kind, part)."""
    folder, base = posixpath.split(name)
    rels = f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"
    if rels not in archive.namelist():
        return {}
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in _part(archive, rels).iter(f"{PACKAGE}Relationship")}


def _runs(node: ElementTree.Element, space: str) -> str:
    """The text of a paragraph; what was deleted in tracked changes isn't there."""
    out = []
    for child in node.iter():
        if child.tag == f"{space}t":
            out.append(child.text or "")
        elif child.tag == f"{space}tab":
            out.append("\t")
        elif child.tag in (f"{space}br", f"{space}cr"):
            out.append("\n")
    return "".join(out).strip()


def _levels(archive: zipfile.ZipFile) -> dict[str, int]:
    """Heading levels of the paragraph styles, from 1, along the styles that they are based on."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    own, base = {}, {}
    for style in _part(archive, "word/styles.xml").iter(f"{WORD}style"):
        key, name = style.get(f"{WORD}styleId"), style.find(f"{WORD}name")
        outline, above = style.find(f"{WORD}pPr/{WORD}outlineLvl"), style.find(f"{WORD}basedOn")
        named = re.fullmatch(r"heading (\d)", (name.get(f"{WORD}val", "") if name is not None else "").lower())
        if named:
            own[key] = int(named[1])
        elif name is not None and name.get(f"{WORD}val", "").lower() == "title":
            own[key] = 1
        elif outline is not None and int(outline.get(f"{WORD}val", "9")) < 9:
            own[key] = int(outline.get(f"{WORD}val")) + 1
        if above is not None:
            base[key] = above.get(f"{WORD}val")
    for key in list(base):
        seen, at = set(), key
        while at is not None and at not in own and at not in seen:
            seen.add(at)
            at = base.get(at)
        if at in own:
            own[key] = own[at]
    return own


def _word_blocks(body: ElementTree.Element, levels: dict[str, int]) -> Iterator[tuple[int, str]]:
    """(heading level or 0, text) of paragraphs and tables in order."""
    for node in body:
        if node.tag == f"{WORD}p":
            style, outline = node.find(f"{WORD}pPr/{WORD}pStyle"), node.find(f"{WORD}pPr/{WORD}outlineLvl")
            level = levels.get(style.get(f"{WORD}val"), 0) if style is not None else 0
            if style is not None and not level and (plain := re.fullmatch(r"[Hh]eading\s?(\d)", style.get(f"{WORD}val", ""))):
                level = int(plain[1])
            if outline is not None and int(outline.get(f"{WORD}val", "9")) < 9:
                level = int(outline.get(f"{WORD}val")) + 1
            yield level, _runs(node, WORD)
        elif node.tag == f"{WORD}tbl":
            rows = ([" ".join(filter(None, (_runs(p, WORD) for p in cell.iter(f"{WORD}p")))) for cell in row.findall(f"{WORD}tc")] for row in node.iter(f"{WORD}tr"))
            yield 0, "\n".join(" | ".join(row) for row in rows)
        elif node.tag in (f"{WORD}sdt", f"{WORD}sdtContent", f"{WORD}ins"):
            yield from _word_blocks(node, levels)


def word_sections(archive: zipfile.ZipFile) -> Iterator[dict]:
    body = _part(archive, "word/document.xml").find(f"{WORD}body")
    trail: list[str] = []
    level, texts = None, []

    def closed(rank: int) -> Iterator[dict]:
        """The section so far; one of a heading alone is told by the paths below it, if there are any."""
        if texts or level and rank <= level:
            head = list(trail) if level else []
            yield {"text": "\n".join(head + texts), "heading_path": " > ".join(head) or None, "heading_level": level}

    for rank, text in _word_blocks(body if body is not None else [], _levels(archive)):
        if rank and text:
            yield from closed(rank)
            texts, level = [], rank
            trail[rank - 1 :] = [text]
        elif text:
            texts.append(text)
    yield from closed(0)


def slide_sections(archive: zipfile.ZipFile) -> Iterator[dict]:
    relations = _related(archive, "ppt/presentation.xml")
    order = [relations[s.get(f"{RELATION}id")][1] for s in _part(archive, "ppt/presentation.xml").iter(f"{SLIDE}sldId") if s.get(f"{RELATION}id") in relations]
    for number, name in enumerate(order, 1):
        title, texts = None, []
        for shape in _part(archive, name).iter():
            if shape.tag == f"{SLIDE}sp":
                kind = shape.find(f"{SLIDE}nvSpPr/{SLIDE}nvPr/{SLIDE}ph")
                lines = [t for p in shape.iter(f"{DRAWING}p") if (t := _runs(p, DRAWING))]
                if kind is not None and kind.get("type") in ("title", "ctrTitle") and lines and title is None:
                    title = " ".join(lines)
                elif kind is None or kind.get("type") not in ("sldNum", "dt", "ftr"):
                    texts += lines
            elif shape.tag == f"{DRAWING}tbl":
                texts += [" | ".join(" ".join(filter(None, (_runs(p, DRAWING) for p in cell.iter(f"{DRAWING}p")))) for cell in row.findall(f"{DRAWING}tc")) for row in shape.iter(f"{DRAWING}tr")]
        for kind, notes in _related(archive, name).values():
            if kind == "notesSlide" and notes in archive.namelist():
                for shape in _part(archive, notes).iter(f"{SLIDE}sp"):
                    holder = shape.find(f"{SLIDE}nvSpPr/{SLIDE}nvPr/{SLIDE}ph")
                    if holder is not None and holder.get("type") == "body":
                        texts += [t for p in shape.iter(f"{DRAWING}p") if (t := _runs(p, DRAWING))]
        if title or texts:
            yield {"text": "\n".join(([title] if title else []) + texts), "heading_path": title, "heading_level": 1 if title else None, "page_number": number, "total_pages": len(order)}


def sections_of(data: bytes) -> Iterator[dict]:
    """Sections of a .docx or .pptx file, told apart by their parts."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        if "word/document.xml" in names:
            yield from word_sections(archive)
        elif "ppt/presentation.xml" in names:
            yield from slide_sections(archive)
        else:
            raise ValueError("neither a text document nor a presentation")
