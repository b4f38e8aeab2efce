"""The encoding of the bytes of a text file.

In this order: a byte-order mark; valid UTF-8; UTF-16 or UTF-32 without a mark, by the
places of zero bytes; and, among ``PAGES``, the one in which the bytes above 127 read most
like writing. Each page decodes a sample of the file around such bytes; a letter speaks for a
page if its neighbours are letters of its script and case, a rare letter for less, a
letter alone between blanks for little, and what isn't a letter against it where it
stands inside a word. Equal pages go to the earlier one.
"""

from __future__ import annotations

import codecs
import re
import unicodedata

#: Marks, longer ones first, and the encodings that they announce and strip.
MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
PAGES = ["cp1252", "cp1250", "cp1251", "koi8-r", "iso8859-7", "mac-roman", "cp850", "cp866"]
#: Letters that are frequent in the languages of a script; others are rarer and say less.
FREQUENT = frozenset("éèêëàâçîïôûùüöäßñáíóúãõåøæœ" "ąćęłńóśźżčďěňřšťůýžőű" "абвгдежзийклмнопрстуфхцчшщъыьэюяё" "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ")
SAMPLE = 1 << 16
HIGH_SAMPLE = 1 << 12
HIGH = re.compile(rb"[\x80-\xff]")


def kind_of(char: str) -> tuple[str, bool]:
    """(script, whether it is upper case) of a letter; no script for anything else."""
    if not char.isalpha():
        return "", False
    return unicodedata.name(char, " ").partition(" ")[0], char.isupper()


def plausible(before: str, char: str, after: str) -> float:
    """How well a character that isn't ASCII stands between two others."""
    script, upper = kind_of(char)
    sides = [kind_of(x) for x in (before, after)]
    if not script:
        if unicodedata.category(char) in ("Cc", "Cn", "Co"):
            return -3.0
        inside = all(s for s, _ in sides)
        if char in "¿¡" and not sides[0][0] and sides[1][0] or char == "’" and inside:
            return 1.2
        typical = char in "’‘“”«»„–—…¿¡°§©®€£"
        return (-0.5 if inside else 0.3) if typical else (-1.5 if any(s for s, _ in sides) else -0.4)
    weight = 1.0 if char.lower() in FREQUENT else 0.4
    near = [(s, u) for s, u in sides if s]
    if not near:
        return 0.1 * weight
    if any(s != script for s, _ in near):
        return -1.0
    if upper and kind_of(before)[0] and not kind_of(before)[1]:
        return -0.8  # upper case after lower case
    if not upper and kind_of(after)[1]:
        return -0.8
    return weight


def page_of(data: bytes) -> str:
    """The single-byte page under which a sample of the bytes reads best."""
    spans: list[list[int]] = []
    seen = 0
    for hit in HIGH.finditer(data):
        if spans and hit.start() <= spans[-1][1]:
            spans[-1][1] = hit.end() + 1
        else:
            spans.append([max(0, hit.start() - 1), hit.end() + 1])
        seen += 1
        if seen >= HIGH_SAMPLE:
            break
    pieces = [data[a:b] for a, b in spans]
    known: dict[str, float] = {}
    best, name = float("-inf"), PAGES[0]
    for page in PAGES:
        score = 0.0
        for piece in pieces:
            text = f" {piece.decode(page, 'replace')} "
            for i in range(1, len(text) - 1):
                if text[i] > "\x7f":
                    three = text[i - 1 : i + 2]
                    if three not in known:
                        known[three] = plausible(*three)
                    score += known[three]
        if score > best:
            best, name = score, page
    return name


def detected(data: bytes) -> str:
    """The name of an encoding, as Python's codecs know it."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    zeros = data[:SAMPLE].count(0)
    if zeros * 5 >= len(data[:SAMPLE]) > 0:
        at = [data[i:SAMPLE:4].count(0) * 4 / max(1, len(data[:SAMPLE])) for i in range(4)]
        if len(data) % 4 == 0 and (min(at[1:]) > 0.9 or min(at[:2]) > 0.9):
            return "utf-32-le" if at[0] < 0.5 else "utf-32-be"
        if len(data) % 2 == 0:
            return "utf-16-le" if at[1] + at[3] > at[0] + at[2] else "utf-16-be"
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return page_of(data)
    return "utf-8"


def decoded(data: bytes) -> tuple[str, str]:
    """(text, encoding); what the encoding can't read is replaced."""
    name = detected(data)
    return data.decode(name, "replace"), name
