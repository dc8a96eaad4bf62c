"""Symbols, imports and calls of a Python file, by the standard ast module."""

from __future__ import annotations

import ast
import re


def module_name(path: str) -> str:
    return re.sub(r"(^|/)__init__$", "", re.sub(r"\.pyi?$", "", path)).replace("/", ".")


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{base}.{node.attr}" if (base := _dotted(node.value)) else None
    return None


def extract_python(path: str, content: bytes) -> dict:
    text = content.decode("utf-8", "replace")
    rows = text.split("\n")
    module = module_name(path)
    out: dict = {"path": path, "language": "python", "symbols": [], "imports": [], "calls": [], "had_errors": False}

    def symbol(kind: str, fqname: str, first: int, last: int, parent: str | None, signature: str | None = None, docstring: str | None = None, bases: list[str] | None = None) -> None:
        out["symbols"].append({"kind": kind, "fqname": fqname, "name": fqname.rsplit(".", 1)[-1], "start_line": first, "end_line": last, "signature": signature, "docstring": docstring, "parent": parent, "source": "\n".join(rows[first - 1 : last]), "bases": bases or []})

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out["had_errors"] = True
        symbol("file", module, 1, len(rows), None)
        return out
    symbol("file", module, 1, len(rows), None, docstring=ast.get_docstring(tree))

    def imports(node: ast.Import | ast.ImportFrom) -> None:
        relative = isinstance(node, ast.ImportFrom) and node.level > 0
        level = node.level if relative else 0
        for a in node.names:
            if isinstance(node, ast.Import):
                row = (a.name, None)
            elif node.module:
                row = (node.module, a.name)
            else:
                row = (a.name, None)
            out["imports"].append({"module": row[0], "imported": row[1], "alias": a.asname, "line": node.lineno, "relative": relative, "level": level})

    def head(node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> str:
        first = min([x.lineno for x in node.body] or [node.lineno])
        stop = node.body[0].col_offset if first == node.lineno else None
        lines = rows[node.lineno - 1 : max(first - 1, node.lineno)]
        if stop is not None:
            lines = [rows[node.lineno - 1][:stop]]
        return re.sub(r"\s+", " ", " ".join(lines)).strip().rstrip(":").rstrip()

    def visit(node: ast.AST, parent: str, owner: str, in_class: bool) -> None:
        if isinstance(node, ast.Import | ast.ImportFrom):
            imports(node)
        elif isinstance(node, ast.ClassDef):
            name = f"{parent}.{node.name}"
            symbol("class", name, node.lineno, node.end_lineno or node.lineno, parent, head(node), ast.get_docstring(node), [b for x in node.bases if (b := _dotted(x))])
            for x in [*node.decorator_list, *node.bases, *node.keywords]:
                visit(x, parent, owner, in_class)
            for x in node.body:
                visit(x, name, name, True)
            return
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            name = f"{parent}.{node.name}"
            symbol("method" if in_class else "function", name, node.lineno, node.end_lineno or node.lineno, parent, head(node), ast.get_docstring(node))
            for x in [*node.decorator_list, node.args, *([node.returns] if node.returns else [])]:
                visit(x, parent, owner, in_class)
            for x in node.body:
                visit(x, name, name, False)
            return
        elif isinstance(node, ast.Call) and (callee := _dotted(node.func)):
            out["calls"].append({"caller": owner, "callee": callee, "line": node.lineno})
        for x in ast.iter_child_nodes(node):
            visit(x, parent, owner, in_class)

    for x in tree.body:
        visit(x, module, module, False)
    return out
