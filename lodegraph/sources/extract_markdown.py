"""Document symbols of one Markdown file; operators.markdown does the same for tables of lines."""

from __future__ import annotations

import re


def slugify(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "section"


def paragraph(rows: list[str]) -> str | None:
    out: list[str] = []
    for line in map(str.strip, rows):
        if line and not line.startswith("#"):
            out.append(line)
        elif out:
            break
    return " ".join(out) or None


def extract_markdown(path: str, content: bytes) -> dict:
    rows = content.decode("utf-8", "replace").split("\n")
    base = re.sub(r"\.md$", "", path).replace("/", ".")
    heads, fenced = [], False
    for at, line in enumerate(map(str.strip, rows)):
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,3})[ \t]+(\S.*?)(?:[ \t]+#+)?$", line)):
            heads.append((at, len(m[1]), m[2]))

    def row(fqname: str, name: str, first: int, last: int, parent: str | None) -> dict:
        return {"kind": "doc", "fqname": fqname, "name": name, "start_line": first, "end_line": last, "signature": name, "docstring": paragraph(rows[first - 1 : last]), "parent": parent, "source": "\n".join(rows[first - 1 : last]), "bases": []}

    symbols, seen = [row(base, path.rsplit("/", 1)[-1], 1, len(rows), None)], {}
    latest: dict[int, str] = {}
    for i, (at, level, title) in enumerate(heads):
        slug = slugify(title)
        n = seen[slug] = seen.get(slug, -1) + 1
        name = f"{base}.{slug}" + (f"-{n}" if n else "")
        parent = next((latest[k] for k in range(level - 1, 0, -1) if k in latest), base)
        latest = {k: v for k, v in latest.items() if k < level} | {level: name}
        symbols.append(row(name, title, at + 1, heads[i + 1][0] if i + 1 < len(heads) else len(rows), parent))
    return {"path": path, "language": "markdown", "symbols": symbols, "imports": [], "calls": [], "had_errors": False}
