"""Symbols, imports and calls of a JavaScript or TypeScript file, by a tolerant scan of braces.

Strings, templates, comments and regular expressions are blanked first, of the same length, so that names and places
are found in code alone; a scope is the span of its braces.
"""

from __future__ import annotations

import re
from bisect import bisect_right

SUFFIX = re.compile(r"\.(?:d\.ts|tsx|ts|jsx|mjs|cjs|js)$")
HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S)
NAME = r"[A-Za-z_$][\w$]*"
CLASS = re.compile(rf"\b(?:abstract\s+)?(class|interface|enum)\s+({NAME})([^{{;]*)\{{")
FUNCTION = re.compile(rf"\b(?:async\s+)?function\s*\*?\s*({NAME})\s*(?:<[^({{]*>)?\(")
ARROW = re.compile(rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^(]*>\s*)?(?:\(|{NAME}\s*=>|function\b)")
METHOD = re.compile(rf"(?:^|[;{{}}])[\s]*((?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?{NAME})\s*(?:<[^({{]*>)?\()", re.M)
FIELD = re.compile(rf"(?:^|[;{{}}])[\s]*((?:(?:public|private|protected|static|readonly|override)\s+)*({NAME})\s*(?::[^=;(]+)?=\s*(?:async\s*)?(?:\(|{NAME}\s*=>))", re.M)
CALL = re.compile(rf"(new\s+)?((?:this|super|{NAME})(?:\s*\??\.\s*#?{NAME})*)\s*(?:<[\w\s,\[\]|.]*>)?\(")
IMPORT = re.compile(r"\bimport\s+(?:type\s+)?([^'\";()]*?)\s*(?:from\s*)?(['\"])([^'\"]+)\2")
EXPORT = re.compile(r"\bexport\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*(['\"])([^'\"]+)\2")
REQUIRE = re.compile(rf"\b(?:const|let|var)\s+({NAME}|\{{[^}}]*\}})\s*=\s*require\(\s*(['\"])([^'\"]+)\2\s*\)")
NOT_CALLED = frozenset("if for while switch catch return typeof function await constructor require import super with throw yield in of do else case void delete".split())


def module_name(path: str) -> str:
    return re.sub(r"/index$", "", SUFFIX.sub("", path)).replace("/", ".")


def specifier(importer: str, spec: str) -> str | None:
    """Module of a relative specifier, else None."""
    if not spec.startswith("."):
        return None
    at = importer.split("/")[:-1]
    for part in re.sub(r"/index$", "", SUFFIX.sub("", spec)).split("/"):
        if part == "..":
            at = at[:-1]
        elif part not in ("", "."):
            at = [*at, part]
    return ".".join(at)


def _blank(m: re.Match) -> str:
    return "".join(c if c == "\n" else " " for c in m[0])


def _close(code: str, at: int, pair: str) -> int:
    """Place after the bracket that closes the one at at."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(code)


def _doc(text: str, at: int) -> str | None:
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:export\s+|default\s+|declare\s+|abstract\s+)*$", text[:at], re.S)
    return " ".join(line.strip().lstrip("*").strip() for line in m[1].split("\n")).strip() or None if m else None


def _arrow_end(code: str, at: int) -> int | None:
    """End of the arrow function that begins at at, or None if it is none."""
    stop = _close(code, at, "()") if code[at] == "(" else re.compile(NAME).match(code, at).end()
    m = re.compile(r"\s*(?::[^=;{]+?)?\s*=>\s*").match(code, stop)
    if not m:
        return None
    if code[m.end() : m.end() + 1] == "{":
        return _close(code, m.end(), "{}")
    if code[m.end() : m.end() + 1] == "(":
        return _close(code, m.end(), "()")
    end = re.compile(r"[;\n]").search(code, m.end())
    return end.start() if end else len(code)


def extract_js(path: str, content: bytes) -> dict:
    text = content.decode("utf-8", "replace")
    code = HIDDEN.sub(_blank, text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    module, rows = module_name(path), text.split("\n")
    found: list[tuple[int, int, str, str, str | None, list[str]]] = []  # start, end, kind, name, signature, bases
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()

    for m in CLASS.finditer(code):
        bases = []
        if m[1] == "class" and (b := re.search(rf"\bextends\s+({NAME}(?:\.{NAME})*)", m[3])):
            bases = [b[1]]
        found.append((m.start(), _close(code, m.end() - 1, "{}"), "class", m[2], squeeze(m[0][:-1]), bases))
    classes = list(found)
    for m in FUNCTION.finditer(code):
        args = _close(code, m.end() - 1, "()")
        body = re.compile(r"[^;{]*\{").match(code, args)
        found.append((m.start(), _close(code, body.end() - 1, "{}") if body else args, "function", m[1], squeeze(text[m.start() : body.end() - 1 if body else args]), []))
    for m in ARROW.finditer(code):
        at = re.compile(r"=\s*(?:async\s*)?(?:<[^(]*>\s*)?").search(code, m.start(1) + len(m[1]) + (len(m[0]) - len(m[0][m[0].rindex("=") :]) - (m.start(1) - m.start()) - len(m[1]) if m[0].count("=") == 1 else 0))
        begin = at.end() if at else m.end() - 1
        if code[begin : begin + 8] == "function":
            body = code.find("{", begin)
            end = _close(code, body, "{}") if body >= 0 else None
        else:
            end = _arrow_end(code, begin) if begin < len(code) and (code[begin] == "(" or re.match(NAME, code[begin:])) else None
        if end:
            found.append((m.start(), end, "function", m[1], squeeze(text[m.start() : end].split("=>")[0].split("{")[0]), []))
    for first, last, _, _, sig, _ in classes:
        if sig and re.match(r"(interface|enum)\b", sig):
            continue
        brace = code.index("{", first)
        inner = [x for x in found if x[0] > brace and x[1] <= last]
        for kind, pattern in (("call", METHOD), ("field", FIELD)):
            for m in pattern.finditer(code, brace, last):
                at = m.start(2)
                depth = code.count("{", brace, at) - code.count("}", brace, at)
                if depth != 1 or m[2] in NOT_CALLED - {"constructor", "of"} or any(x[0] <= at < x[1] for x in inner):
                    continue
                if kind == "call":
                    args = _close(code, m.end(1) - 1, "()")
                    body = re.compile(r"[^;{}]*\{").match(code, args)
                    end = _close(code, body.end() - 1, "{}") if body else None
                else:
                    end = _arrow_end(code, m.end(1) - 1) if code[m.end(1) - 1] == "(" else None
                if end:
                    found.append((m.start(1), end, "method", m[2], squeeze(text[m.start(1) : end].split("{")[0].split("=>")[0]), []))
    found = sorted({(x[0], x[3]): x for x in found}.values(), key=lambda x: (x[0], -x[1]))

    symbols = [{"kind": "file", "fqname": module, "name": module.rsplit(".", 1)[-1], "start_line": 1, "end_line": len(rows), "signature": None, "docstring": None, "parent": None, "source": text, "bases": []}]
    stack: list[tuple[int, str]] = []
    scopes: list[tuple[int, int, str]] = []
    for first, last, kind, name, sig, bases in found:
        while stack and stack[-1][0] <= first:
            stack.pop()
        parent = stack[-1][1] if stack else module
        fqname = f"{parent}.{name}"
        a, b = line(first), line(max(last - 1, first))
        symbols.append({"kind": kind, "fqname": fqname, "name": name, "start_line": a, "end_line": b, "signature": sig, "docstring": _doc(text, first), "parent": parent, "source": "\n".join(rows[a - 1 : b]), "bases": bases})
        stack.append((last, fqname))
        scopes.append((first, last, fqname))

    imports: list[dict] = []

    def add(at: int, spec: str, imported: str | None, alias: str | None) -> None:
        imports.append({"module": specifier(path, spec) or spec, "imported": imported, "alias": alias, "line": line(at), "relative": False, "level": 0})

    shown = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S).sub(_blank, text)
    for pattern in (IMPORT, EXPORT, REQUIRE):
        for m in pattern.finditer(shown):
            clause = m[1].strip()
            if pattern is EXPORT or not clause:
                add(m.start(), m[3], None, None)
                continue
            if pattern is REQUIRE and not clause.startswith("{"):
                add(m.start(), m[3], None, clause)
                continue
            names = re.search(r"\{([^}]*)\}", clause)
            for part in re.sub(r"\{[^}]*\}", "", clause).split(","):
                if part := part.strip():
                    add(m.start(), m[3], *(("*", part.split()[-1]) if part.startswith("*") else ("default", part)))
            for part in names[1].split(",") if names else []:
                pair = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^type\s+", "", part.strip()))
                if pair[0]:
                    add(m.start(), m[3], pair[0], pair[1] if len(pair) > 1 else None)

    calls = []
    heads = {first for first, *_ in found} | {m.start(2) for m in METHOD.finditer(code)}
    for m in CALL.finditer(code):
        callee = re.sub(r"\s*\??\.\s*", ".", m[2])
        if callee.split(".")[0] in NOT_CALLED or re.search(r"\bfunction\s*\*?\s*$", code[: m.start(2)][-24:]):
            continue
        if any(x[2].rsplit(".", 1)[-1] == callee and x[0] <= m.start(2) < x[0] + 200 and code[x[0] : m.start(2)].count("{") == 0 and m.start(2) in heads | {x[0]} for x in scopes):
            continue
        owner = max((x for x in scopes if x[0] <= m.start() < x[1]), default=(0, 0, module))[2]
        calls.append({"caller": owner, "callee": callee, "line": line(m.start(2))})
    return {"path": path, "language": "tsx" if path.endswith(".tsx") else "typescript" if path.endswith(".ts") else "javascript", "symbols": symbols, "imports": sorted(imports, key=lambda x: x["line"]), "calls": calls, "had_errors": code.count("{") != code.count("}")}
