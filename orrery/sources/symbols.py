"""Symbols of source files: named classes, functions and methods with their lines, nested ones too.

Python has a grammar in its standard library. The brace languages are read by a lexer,
which takes comments, strings, templates, and regular expressions as wholes, and by a
stack of open brackets: what stands between two statement ends, its *head*, with
bracketed groups taken as single words, tells what the braces after it are. Broken
files give what can be told of them; a bracket that is never closed ends with the file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from orrery.functions.text import CLASS_PARTS, METHOD_PARTS


def kind_of(node: str) -> str:
    """method, class or function."""
    return "method" if any(p in node for p in METHOD_PARTS) else "class" if any(p in node for p in CLASS_PARTS) else "function"


@dataclass
class Word:
    """A word of a head; a bracketed group is its two brackets."""

    text: str
    start: int
    first: bool  # on its line
    name: bool = False


@dataclass
class Frame:
    """An open bracket: what it is, the symbol it ends, and the head that grows in it."""

    kind: str
    word: Word | None = None
    symbol: tuple[str, str | None, int] | None = None
    closes: bool = True  # the statement, when it is closed
    name: str | None = None
    constants: bool = False  # of an enumeration are still being listed
    head: list[Word] = field(default_factory=list)


COMMON = r"(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<open>[(\[{])|(?P<close>[)\]}])"
STRING = r'"(?:\\.|[^"\\\n])*"?'
LEXERS = {
    "javascript": rf"(?P<string>{STRING}|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)|(?P<private>\#[A-Za-z_$][\w$]*)|{COMMON}|(?P<other>=>|\?\?|&&|\|\||.)",
    "go": rf"(?P<string>{STRING}|`[^`]*`?|'(?:\\.[^']*|[^'\\\n])')|{COMMON}|(?P<other>.)",
    "rust": rf"(?P<raw>b?r(?P<hashes>#*)\")|(?P<string>b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]+?|[^'\\\n])')|(?P<lifetime>'[A-Za-z_]\w*)|{COMMON}|(?P<other>.)",
    "java": rf"(?P<string>\"\"\".*?(?:\"\"\"|\Z)|{STRING}|'(?:\\.[^']*|[^'\\\n])')|{COMMON}|(?P<other>.)",
}
LEXERS["typescript"] = LEXERS["tsx"] = LEXERS["javascript"]
LEXERS = {k: re.compile(v, re.S) for k, v in LEXERS.items()}
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
BEFORE_PATTERN = frozenset("(,=:[!&|?{};+-*%~^<>") | {"=>", "&&", "||", "??", "return", "typeof", "case", "in", "of"}


def after_template(text: str, at: int) -> int:
    """The place after a template that begins at ``at``; templates nest in its ``${}``."""
    at, depth = at + 1, 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == "`":
            if not depth:
                return at + 1
            at = after_template(text, at) - 1
        elif depth and c in "\"'":
            end = re.compile(rf"(?:\\.|[^\\{c}])*{c}", re.S).match(text, at + 1)
            at = end.end() - 1 if end else at
        elif text.startswith("${", at):
            depth, at = depth + 1, at + 1
        elif depth and c in "{}":
            depth += 1 if c == "{" else -1
        at += 1
    return len(text)


def after_comment(text: str, at: int, nested: bool) -> int:
    depth = 0
    for mark in re.compile(r"/\*|\*/").finditer(text, at):
        if mark[0] == "*/":
            depth -= 1
        elif nested or not depth:
            depth += 1
        if not depth:
            return mark.end()
    return len(text)


def lexed(text: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of what isn't a blank or a comment; a line feed is a word of its own."""
    lexer, at, last = LEXERS[language], 0, None
    script = language in ("javascript", "typescript", "tsx")
    while at < len(text):
        found = lexer.match(text, at)
        kind, end = found.lastgroup, found.end()
        if kind == "hashes" or found.groupdict().get("raw"):
            kind = "raw"
        if script and text[at] == "/" and kind == "other" and (last is None or last in BEFORE_PATTERN):
            pattern = PATTERN.match(text, at)
            if pattern:
                kind, end = "string", pattern.end()
        if kind == "block":
            end = after_comment(text, at, language == "rust")
        elif kind == "template":
            kind, end = "string", after_template(text, at)
        elif kind == "raw":
            close = text.find('"' + found["hashes"], end)
            kind, end = "string", len(text) if close < 0 else close + 1 + len(found["hashes"])
        if kind not in ("space", "comment", "block"):
            if kind != "line":
                last = text[at:end]
            yield kind, text[at:end], at, end
        at = end


Found = tuple[str, str | None, int]
SCRIPT_MODIFIERS = frozenset("static async get set public private protected readonly override abstract declare accessor *".split())
RUST_MODIFIERS = frozenset("pub async unsafe const extern default () ".split())


def script_head(head: list[Word], frame: Frame, language: str) -> tuple[str, Found | None, bool]:
    """What the braces after a head of JavaScript or TypeScript are: (kind, symbol, whether they end the statement)."""
    texts = [w.text for w in head]
    for i in range(len(head) - 1, -1, -1):
        word = texts[i]
        if word in ("class", "function") or word == "interface" and language != "javascript":
            first = i
            while first and texts[first - 1] in ("export", "default", "async", "abstract", "declare") and not head[first].first:
                first -= 1
            declared = (not first or head[first].first) and frame.kind in ("top", "block")
            rest = [w for w in head[i + 1 :] if w.text != "*"]
            name = rest[0].text if rest and rest[0].name and rest[0].text not in ("extends", "implements") else None
            start = i - 1 if i and texts[i - 1] in ("abstract", "async") and declared else i
            if word == "function":
                node = "generator_function_declaration" if i + 1 < len(texts) and texts[i + 1] == "*" else "function_declaration"
                wanted = declared and name and "()" in texts[i:] and (node == "function_declaration" or language == "javascript")
                return "block", (node, name, head[start].start) if wanted else None, declared
            node = f"{word}_declaration" if start == i or word == "interface" else "abstract_class_declaration"
            return "class" if word == "class" else "object", (node, name, head[start].start) if declared and name else None, declared
        if head[i].first and i and word not in SCRIPT_MODIFIERS and frame.kind in ("top", "block"):
            break
    if frame.kind in ("class", "object") and "()" in texts and texts[-1] not in ("<", ",", "|", "&", ":", "="):
        at = len(texts) - 1 - texts[::-1].index("()")
        name = at - 1
        if texts[name] == ">":  # type parameters
            depth = 0
            for name in range(at - 1, -1, -1):
                depth += (texts[name] == ">") - (texts[name] == "<")
                if not depth:
                    break
            name -= 1
        if name >= 0 and (at == len(texts) - 1 or texts[at + 1] == ":") and (head[name].name or texts[name][0] in "\"'[#"):
            first = name
            while first and texts[first - 1] in SCRIPT_MODIFIERS:
                first -= 1
            if "=>" not in texts[first:] and (not first or head[first].first or texts[first - 1] in (",", ";")):
                return "block", ("method_definition", texts[name], head[first].start), True
    before = texts[-1] if texts else None
    if before in ("=", ",", ":", "[", "return", "?", "&&", "||", "??", "(", "default", "<", "|", "&") or not head and frame.kind in ("()", "[]"):
        return "object", None, False
    return "block", None, before != "=>" and frame.kind in ("top", "block", "class")


def rust_head(head: list[Word], ended: bool) -> tuple[str, Found | None, bool]:
    for i, word in enumerate(head):
        if word.text in ("fn", "struct", "enum", "trait", "impl"):
            first = i
            while first and (head[first - 1].text in RUST_MODIFIERS or head[first - 1].text[0] == '"'):
                first -= 1
            if first and not (head[first - 1].text == "[]" and head[first - 2].text in "#!"):
                continue
            if ended and word.text != "struct":
                return "block", None, True
            node = "function_item" if word.text == "fn" else f"{word.text}_item"
            name = head[i + 1].text if word.text != "impl" and i + 1 < len(head) else None
            return "block", (node, name, head[first].start), True
    return "block", None, True


def java_head(head: list[Word], frame: Frame, ended: bool) -> tuple[str, Found | None, bool, str | None]:
    texts = [w.text for w in head]
    equals = texts.index("=") if "=" in texts else len(texts)
    for i, word in enumerate(texts[:equals]):
        if word in ("class", "interface", "enum", "record") and i + 1 < len(head) and head[i + 1].name and (not i or texts[i - 1] != "."):
            if ended:
                return "block", None, True, None
            if i and texts[i - 1] == "@":
                return "block", None, True, None
            wanted = word in ("class", "interface")
            return "enum" if word == "enum" else "class", (f"{word}_declaration", texts[i + 1], head[0].start) if wanted else None, True, texts[i + 1]
    if frame.kind in ("class", "enum") and not frame.constants:
        for k in range(1, equals):
            if texts[k] == "()" and head[k - 1].name and "new" not in texts[:k]:
                j = k - 1
                while j >= 2 and texts[j - 1] == "." and head[j - 2].name:
                    j -= 2
                if j and texts[j - 1] == "@":
                    continue
                typed = [w for w in head[:j] if w.text not in JAVA_MODIFIERS]
                node = "method_declaration" if any(w.name for w in _unannotated(typed)) else "constructor_declaration" if texts[k - 1] == frame.name and not ended else None
                return "block", (node, texts[k - 1], head[0].start) if node else None, True, None
    if "new" in texts and not ended and texts[-1] == "()":
        return "class", None, False, None
    if frame.kind == "enum" and frame.constants:
        return "class", None, False, None
    return "block", None, equals == len(texts), None


JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())


def _unannotated(head: list[Word]) -> list[Word]:
    """A head without annotations (``@a.b`` and their group)."""
    out, i = [], 0
    while i < len(head):
        if head[i].text == "@":
            i += 2
            while i + 1 < len(head) and head[i].text == ".":
                i += 2
            i += i < len(head) and head[i].text == "()"
        else:
            out.append(head[i])
            i += 1
    return out


def go_head(head: list[Word], frame: Frame, ended: bool) -> tuple[str, Found | None, bool]:
    texts = [w.text for w in head]
    if texts[:1] == ["type"] and len(texts) > 1:
        return "object", ("type_declaration", None, head[0].start), True
    if texts[:1] == ["func"] and frame.kind == "top" and not ended and len(texts) > 2:
        method = texts[1] == "()"
        return "block", ("method_declaration" if method else "function_declaration", texts[2 if method else 1], head[0].start), True
    return "block", None, bool(texts) and texts[0] in ("if", "for", "switch", "select", "else") or not texts


def spans(text: str, language: str) -> list[tuple[str, str | None, int, int]]:
    """(node, name, start, end) of the symbols of a brace language, in the order of their starts."""
    found: list[tuple[str, str | None, int, int]] = []
    stack = [Frame("top")]
    first, last_end = True, 0

    def ended(frame: Frame) -> None:
        """A statement ends without braces."""
        if frame.head and language == "rust":
            symbol = rust_head(frame.head, True)[1]
        elif frame.head and language == "java":
            symbol = java_head(frame.head, frame, True)[1]
        elif frame.head and language == "go":
            symbol = go_head(frame.head, frame, True)[1]
        else:
            symbol = None
        if symbol:
            found.append((*symbol, last_end))
        frame.head = []

    for kind, word, start, end in lexed(text, language):
        frame = stack[-1]
        if kind == "line":
            first = True
            if language == "go" and frame.kind not in ("()", "[]") and frame.head and (frame.head[-1].name or frame.head[-1].text[-1] in ")]}\"'`" or frame.head[-1].text[0].isdigit()):
                ended(frame)
            continue
        if kind == "open":
            opened = Word(word, start, first)
            if word != "{":
                stack.append(Frame(word + (")" if word == "(" else "]"), opened))
            else:
                name = None
                if language == "rust":
                    inside, symbol, closes = rust_head(frame.head, False)
                elif language == "java":
                    inside, symbol, closes, name = java_head(frame.head, frame, False)
                elif language == "go":
                    inside, symbol, closes = go_head(frame.head, frame, False)
                else:
                    inside, symbol, closes = script_head(frame.head, frame, language)
                stack.append(Frame(inside, opened, symbol, closes, name, inside == "enum"))
        elif kind == "close":
            wanted = {")": ("()",), "]": ("[]",), "}": ("top", "block", "class", "object", "enum")}[word]
            if len(stack) > 1 and frame.kind in wanted:
                if language == "go" and word == "}":
                    ended(frame)
                stack.pop()
                outer = stack[-1]
                if frame.symbol:
                    found.append((*frame.symbol, end))
                if word == "}" and frame.closes:
                    outer.head = []
                else:
                    outer.head.append(Word("{}" if word == "}" else frame.kind, frame.word.start, frame.word.first))
        elif word == ";":
            if frame.constants:
                frame.constants, frame.head = False, []
            else:
                ended(frame)
        else:
            frame.head.append(Word(word, start, first, kind in ("name", "private")))
        first, last_end = False, end
    for frame in reversed(stack):
        if frame.symbol:
            found.append((*frame.symbol, last_end))
    if stack[-1].kind == "top":
        ended(stack[-1])
    return sorted(found, key=lambda s: (s[2], -s[3]))


def python_symbols(text: str) -> Iterator[dict]:
    lines = text.splitlines()

    def walk(node: ast.AST) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                yield {"text": "\n".join(lines[child.lineno - 1 : child.end_lineno]), "symbol_name": child.name, "symbol_type": kind, "start_line": child.lineno, "end_line": child.end_lineno}
            yield from walk(child)

    try:
        yield from walk(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError):
        return


def symbols_of(text: str, language: str) -> Iterator[dict]:
    """Sections with symbol_name, symbol_type, start_line, end_line; none if the file has no symbol."""
    if language == "python":
        yield from python_symbols(text)
        return
    line, at = 1, 0
    for node, name, start, end in spans(text, language):
        line, at = line + text.count("\n", at, start), start
        yield {"text": text[start:end], "symbol_name": name, "symbol_type": kind_of(node), "start_line": line, "end_line": line + text.count("\n", start, end)}
