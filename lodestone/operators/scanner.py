"""Definitions of source files with exact spans and nesting.

A file is first masked: strings, templates and literal patterns become quotes and comments become blanks, character for character, so that
everything left is code. Brackets are then paired, definitions are found where their keywords stand, and each ends where its body closes
(Python: before the first line that is indented no deeper). Spans that lie in others are their children, to a depth of three.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import regex

#: Strings and comments by language; ``s`` is filled with quotes, ``c`` with blanks. What isn't closed is left as it is.
_QUOTED = r""""(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'"""
_BLOCK = r"/\*(?s:.)*?\*/"
_TEMPLATE = r"""(?P<t>`(?:\\(?s:.)|[^`\\$]|\$(?!\{)|\$\{(?P<e>(?:[^{}`"']|""" + _QUOTED + r"""|(?&t)|\{(?&e)\})*+)\})*+`)"""
_LITERAL = r"""(?<=(?:^|[=(,:;!&|?{}\[~^%*+<>\n-]|\b(?:return|typeof|case|in|of))[ \t]*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*"""
MASKS = {
    "script": regex.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>{_QUOTED}|{_TEMPLATE}|{_LITERAL})"),
    "python": regex.compile(r"""(?P<c>\#[^\n]*)|(?P<s>\"{3}(?:\\(?s:.)|(?!\"{3})(?s:[^\\]))*+\"{3}|'{3}(?:\\(?s:.)|(?!'{3})(?s:[^\\]))*+'{3}|""" + _QUOTED + ")"),
    "go": regex.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>{_QUOTED}|`[^`]*`)"),
    "rust": regex.compile(r"""(?P<c>//[^\n]*|(?P<b>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&b))*+\*/))|(?P<s>\br(?P<h>\#*)"(?s:.)*?"(?P=h)|"(?:\\(?s:.)|[^"\\])*+"|'(?:\\[^\n]{1,8}?|[^'\\\n])')"""),
    "java": regex.compile(rf"""(?P<c>//[^\n]*|{_BLOCK})|(?P<s>\"{{3}}(?:\\(?s:.)|(?!\"{{3}})(?s:[^\\]))*+\"{{3}}|{_QUOTED})"""),
}
LANGUAGES = {"ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "mts": "script", "cts": "script", "py": "python", "go": "go", "rs": "rust", "java": "java"}
#: Words before a bracket that are no method's name.
_NO_METHOD = r"(?!(?:if|for|while|switch|catch|with|return|function|do|else|await|super|new|typeof|constructor\s*;)\b)"
_START = r"(?<![\w$.])"
_JAVA = r"(?:(?:public|private|protected|static|final|abstract|default|synchronized|native|strictfp|sealed|non-sealed)\s+)*+"
#: What a definition looks like in masked text: pattern with the group ``n`` for its name, and its kind.
DEFINITIONS: dict[str, list[tuple[regex.Pattern, str]]] = {
    "script": [(regex.compile(p), k) for p, k in (
        (_START + r"(?P<x>export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<n>[\w$]+)\s*(?=[<(])", "function"),
        (_START + r"(?P<x>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)(?=[\s<{])", "class"),
        (_START + r"(?P<x>export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(?P<n>[\w$]+)(?=[\s<{])", "interface"),
        (_START + r"(?P<x>export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)(?=\s*\{)", "enum"),
        (_START + r"(?P<x>export\s+)?(?:declare\s+)?type\s+(?P<n>[\w$]+)\s*(?:<[^={}]*>)?\s*(?==)", "type"),
        (_START + r"(?P<x>export\s+)?(?:declare\s+)?(?:const|let|var)\s+(?!enum\b)(?P<n>[\w$]+)(?=\s*[:=!;])", "const"),
        (r"(?<=[{};,\n]\s*)(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+|\*\s*)*+" + _NO_METHOD + r"(?P<n>\#?[\w$]+)\s*(?:<[^{}()]*>)?(?=\()", "method"),
    )],
    "go": [(regex.compile(p, regex.M), k) for p, k in ((r"^func\s+(?P<n>\w+)\s*(?=[(\[])", "function"), (r"^func\s*\([^)]*\)\s*(?P<n>\w+)\s*(?=\()", "method"), (r"^type\s+(?P<n>\w+)(?=[\s\[])", "type"))],
    "rust": [(regex.compile(p), k) for p, k in (
        (_START + r"(?P<x>pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default)\s+)*+(?:extern\s+\S+\s+)?fn\s+(?P<n>\w+)", "function"), (_START + r"(?P<x>pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)", "struct"),
        (_START + r"(?P<x>pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)", "enum"), (_START + r"(?P<x>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)", "trait"),
        (r"(?<=^|[\s};])(?:unsafe\s+)?impl\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>,&' ]+?\s+for\s+)?(?P<n>\w+)(?=[^;{]*\{)", "class"),
    )],
    "java": [(regex.compile(p), k) for p, k in (
        (_START + _JAVA + r"(?P<k>class|record)\s+(?P<n>\w+)(?=[\s<{(])", "class"), (_START + _JAVA + r"@?interface\s+(?P<n>\w+)(?=[\s<{])", "interface"), (_START + _JAVA + r"enum\s+(?P<n>\w+)(?=[\s{])", "enum"),
        (r"(?<=[{};]\s*(?:@\w+(?:\([^()]*\))?\s*)*)(?P<x>)" + _JAVA + r"(?:<[^{}()]*?>\s*)?(?!(?:return|throw|new|else|case|assert|yield|class|record|interface|enum)\b)[\w.]+(?:<[^{}()]*>)?(?:\[\])*\s+(?P<n>\w+)\s*(?=\()", "method"),
    )],
}
_PYTHON = regex.compile(r"^(?P<i>[ \t]*)(?:async[ \t]+)?(?P<k>def|class)[ \t]+(?P<n>\w+)", regex.M)
_BRACKET = regex.compile(r"[][{}();]")
#: Compiled once, as the module's functions look a pattern up at each call, and a file takes a dozen.
_FILLED = regex.compile(r"[^\n]")
_BREAK = regex.compile("\n")
#: The end of a line that isn't continued.
_STOP = regex.compile(r"(?<![=|&?:,+*<>(.-]\s*)\n(?!\s*[|&?:.=+*)\]},-])")
_GO_BODY = regex.compile(r"\s*(?:\[[^\]]*\]\s*)?(?:struct|interface)\b")
DEEPEST = 3


@dataclass(frozen=True)
class Definition:
    """A definition: lines from 1, the name of the one it lies in, and how many it lies in."""

    name: str
    kind: str
    start_line: int
    end_line: int
    signature: str
    parent: str | None
    depth: int
    exported: bool


def masked(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with strings and comments filled, and the spans of its strings."""
    strings: list[tuple[int, int]] = []

    def fill(m: regex.Match) -> str:
        if m["c"] is not None:
            return _FILLED.sub(" ", m[0])
        strings.append(m.span())
        return _FILLED.sub('"', m[0])

    return MASKS[language].sub(fill, text), strings


def pairs(code: str) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Brackets and semicolons of masked text in order, and where each bracket closes; one that nothing closes reaches to the end."""
    marks, open_, close = [(m.start(), m[0]) for m in _BRACKET.finditer(code)], [], {}
    for at, c in marks:
        if c in "([{":
            open_.append((at, c))
        elif c != ";":
            while open_ and (open_[-1][1] + c) not in ("()", "[]", "{}"):
                close[open_.pop()[0]] = at
            if open_:
                close[open_.pop()[0]] = at
    return marks, close | {at: len(code) - 1 for at, _ in open_}


def end_of(code: str, at: int, kind: str, marks: list[tuple[int, str]], close: dict[int, int], whole: bool) -> tuple[int, bool]:
    """Where a definition ends whose name ends at a place, and whether it has a body. Braces behind a colon or an operator are types; a ``whole`` statement
    runs over its braces to a semicolon, or to the end of a line that isn't continued."""
    k, last = bisect.bisect_left(marks, (at, "")), at
    while k < len(marks):
        place, c = marks[k]
        if whole and (m := _STOP.search(code, pos=last, endpos=place + 1)):
            return m.start(), True
        if c in ")]}":
            return place - 1, False  # what holds the definition closes first
        if c == ";":
            return place, whole
        before = code[last:place].rstrip()[-1:] or code[:place].rstrip()[-1:]
        if c == "{" and not whole and before not in ":|&<,=":
            return close[place], True
        last = close[place] + 1
        k = bisect.bisect_left(marks, (last, ""))
    if whole and (m := _STOP.search(code, pos=last)):
        return m.start(), True
    return len(code.rstrip()) - 1, whole


def _braced(code: str, language: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, name, kind, exported) of a language with braces."""
    marks, close = pairs(code)
    out = []
    for pattern, kind in DEFINITIONS[language]:
        for m in pattern.finditer(code):
            statement = kind in ("const",) or (language == "script" and kind == "type") or (language == "go" and kind == "type" and not _GO_BODY.match(code, pos=m.end()))
            end, body = end_of(code, m.end(), kind, marks, close, statement)
            if kind == "method" and language == "script" and not body:
                continue  # a call or a signature
            if kind == "method" and language == "java" and not body and code[end] != ";":
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            named = m["n"][0].isupper() if language == "go" else bool(m.groupdict().get("x")) or (language == "java" and m[0].lstrip().startswith("public"))
            out.append((start, end, m["n"], kind, named))
    return out


def _indented(code: str, strings: list[tuple[int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, name, kind, exported) of Python: a definition ends before the first line that is indented no deeper, lines within brackets and strings aside."""
    marks, close = pairs(code)
    inside = sorted([(a, close[a]) for a, c in marks if c in "([{"] + [(a, b - 1) for a, b in strings])
    starts = [0, *(m.end() for m in _BREAK.finditer(code))]
    lines, reach, k = [], -1, 0  # (place, indentation, end) of the lines that begin a statement
    for n, at in enumerate(starts):
        while k < len(inside) and inside[k][0] < at:
            reach, k = max(reach, inside[k][1]), k + 1
        stop = (starts[n + 1] - 1) if n + 1 < len(starts) else len(code)
        text = code[at:stop]
        if text.strip():
            lines.append((at, len(text) - len(text.lstrip()) if reach < at else None, at + len(text.rstrip()) - 1))
    places, out = [x[0] for x in lines], []
    for m in _PYTHON.finditer(code):
        own = bisect.bisect_right(places, m.start()) - 1
        if own < 0 or lines[own][1] is None:
            continue
        end = own
        while end + 1 < len(lines) and (lines[end + 1][1] is None or lines[end + 1][1] > lines[own][1]):
            end += 1
        out.append((m.end("i"), lines[end][2], m["n"], "class" if m["k"] == "class" else "function", not m["n"].startswith("_")))
    return out


def definitions(text: str, extension: str) -> list[Definition]:
    """The definitions of a file in order; none for languages that aren't known."""
    language = LANGUAGES.get(extension.lower().lstrip("."))
    if language is None:
        return []
    code, strings = masked(text, language)
    found = _indented(code, strings) if language == "python" else _braced(code, language)
    starts = [0, *(m.end() for m in _BREAK.finditer(text))]
    line = lambda at: bisect.bisect_right(starts, at)
    out, above = [], []  # above: (end, name) of the definitions that hold the next one
    for start, end, name, kind, exported in sorted(found, key=lambda x: (x[0], -x[1])):
        while above and above[-1][0] < end:
            above.pop()
        if len(above) <= DEEPEST:
            first = text[start : end + 1].split("\n", 1)[0].strip()
            out.append(Definition(name, kind, line(start), line(max(start, end)), first if len(first) <= 150 else first[:150] + "...", above[-1][1] if above else None, len(above), exported))
        above.append((end, name))
    return out
