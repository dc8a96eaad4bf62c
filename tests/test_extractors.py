"""Extraction of Python, JavaScript/TypeScript and Markdown, on samples written for these tests."""

import pytest

from lodegraph.sources.extract_js import extract_js, module_name, specifier
from lodegraph.sources.extract_markdown import extract_markdown
from lodegraph.sources.extract_python import extract_python
from lodegraph.sources.extract_python import module_name as py_module
from lodegraph.sources.files import SKIPPED_ENDINGS, SKIPPED_FOLDERS, extract, measure, scan
from lodegraph.sources.tree import tree

PY = b'''import json, gzip as gz
from collections import Counter as Bag
from .. import shelf
from .paths import *
from ...root.core import engine


def weigh(crate, *, unit="kg"):
    return Bag(crate).most_common(1)


class Crate(shelf.Box, Sized):
    size: int = 0

    @property
    def heavy(self) -> bool:
        "Over the limit."
        return weigh(self) > json.loads("9")

    class Lid:
        async def shut(self):
            await engine.stop()
'''

TS = b"""import type { Port } from "../net/port.ts";
import Fastify, { plugin } from "fastify";
export * from "./wires/index";
const legacy = require("legacy-bus");

enum Phase { Idle, Busy }

type Handler = (port: Port) => void;

function relay(port: Port) {
  const send = (msg: string) => port.write(msg);
  return send(legacy.encode(port));
}

/** Keeps ports open. */
export default class Switchboard extends Panel implements Closable {
  private lines = 3;
  static of(n: number): Switchboard {
    return new Switchboard(n);
  }
  async close(): Promise<void> {
    await relay(this.first());
  }
  ring = async () => plugin(this.lines);
}

export const dial = async function (port: Port) {
  return relay(port);
};
"""


def kinds(out):
    return {s["fqname"]: s["kind"] for s in out["symbols"]}


def one(out, fqname):
    return next(s for s in out["symbols"] if s["fqname"] == fqname)


def test_python_symbols():
    out = extract_python("depot/store/crate.py", PY)
    m = "depot.store.crate"
    assert kinds(out) == {m: "file", f"{m}.weigh": "function", f"{m}.Crate": "class", f"{m}.Crate.heavy": "method", f"{m}.Crate.Lid": "class", f"{m}.Crate.Lid.shut": "method"}
    crate, heavy, shut = one(out, f"{m}.Crate"), one(out, f"{m}.Crate.heavy"), one(out, f"{m}.Crate.Lid.shut")
    assert crate["bases"] == ["shelf.Box", "Sized"] and crate["docstring"] is None and (crate["start_line"], crate["end_line"]) == (12, 22)
    assert heavy["signature"] == "def heavy(self) -> bool" and heavy["docstring"] == "Over the limit." and heavy["start_line"] == 16
    assert shut["parent"] == f"{m}.Crate.Lid" and shut["signature"] == "async def shut(self)" and one(out, f"{m}.weigh")["source"].startswith("def weigh(crate")


def test_python_imports_and_calls():
    out = extract_python("depot/store/crate.py", PY)
    rows = {(i["module"], i["imported"], i["alias"], i["level"]) for i in out["imports"]}
    assert rows == {("json", None, None, 0), ("gzip", None, "gz", 0), ("collections", "Counter", "Bag", 0), ("shelf", None, None, 2), ("paths", "*", None, 1), ("root.core", "engine", None, 3)}
    assert {i["line"] for i in out["imports"] if i["relative"]} == {3, 4, 5}
    m = "depot.store.crate"
    assert {(f"{m}.weigh", "Bag"), (f"{m}.Crate.heavy", "weigh"), (f"{m}.Crate.heavy", "json.loads"), (f"{m}.Crate.Lid.shut", "engine.stop")} <= {(c["caller"], c["callee"]) for c in out["calls"]}


def test_python_nested_and_bad():
    out = extract_python("m.py", b"class A:\n    if True:\n        def f(self):\n            def g(): pass\n            return g(h(1))\n")
    assert kinds(out)["m.A.f"] == "method" and kinds(out)["m.A.f.g"] == "function"
    assert {("m.A.f", "g"), ("m.A.f", "h")} <= {(c["caller"], c["callee"]) for c in out["calls"]}
    bad = extract_python("broken.py", b"def f(:\n  x = ")
    assert bad["had_errors"] and kinds(bad) == {"broken": "file"}


@pytest.mark.parametrize(("path", "name"), [("app/auth/jwt.py", "app.auth.jwt"), ("app/__init__.py", "app"), ("run.py", "run")])
def test_python_module(path, name):
    assert py_module(path) == name


def test_js_symbols():
    out = extract_js("lib/exchange/board.ts", TS)
    k, m = kinds(out), "lib.exchange.board"
    assert k[m] == "file" and k[f"{m}.Phase"] == k[f"{m}.Switchboard"] == "class" and not out["had_errors"] and out["language"] == "typescript"
    assert {n for n, kind in k.items() if kind == "method"} == {f"{m}.Switchboard.{x}" for x in ("of", "close", "ring")}
    assert k[f"{m}.relay"] == k[f"{m}.relay.send"] == k[f"{m}.dial"] == "function" and f"{m}.Switchboard.lines" not in k
    board, relay = one(out, f"{m}.Switchboard"), one(out, f"{m}.relay")
    assert board["docstring"] == "Keeps ports open." and board["parent"] == m and board["bases"][0] == "Panel" and board["start_line"] == 16
    assert relay["signature"] == "function relay(port: Port)" and (relay["start_line"], relay["end_line"]) == (10, 13)


def test_js_imports_and_calls():
    out = extract_js("lib/exchange/board.ts", TS)
    rows = {(i["module"], i["imported"], i["alias"]) for i in out["imports"]}
    assert {("lib.net.port", "Port", None), ("fastify", "default", "Fastify"), ("fastify", "plugin", None)} <= rows
    assert any(r[0] == "lib.exchange.wires" for r in rows) and any(r[0] == "legacy-bus" and r[2] == "legacy" for r in rows)
    m = "lib.exchange.board"
    calls = {(c["caller"], c["callee"]) for c in out["calls"]}
    assert {(f"{m}.relay", "legacy.encode"), (f"{m}.relay.send", "port.write"), (f"{m}.Switchboard.of", "Switchboard"), (f"{m}.Switchboard.close", "relay"), (f"{m}.Switchboard.ring", "plugin"), (f"{m}.dial", "relay")} <= calls


def test_tsx_and_commonjs():
    tsx = extract_js("ui/Gauge.tsx", b'import { useMemo } from "react";\nexport function Gauge({ level }) {\n  const [low, high] = useMemo(() => bounds(level), [level]);\n  return <meter min={low} onClick={() => reset(high)} />;\n}\n')
    assert tsx["language"] == "tsx" and kinds(tsx)["ui.Gauge.Gauge"] == "function"
    assert {("ui.Gauge.Gauge", "useMemo"), ("ui.Gauge.Gauge", "bounds"), ("ui.Gauge.Gauge", "reset")} <= {(c["caller"], c["callee"]) for c in tsx["calls"]}
    cjs = extract_js("jobs/nightly.cjs", b'const { sweep } = require("../tools/broom");\nconst os = require("os");\nmodule.exports = function nightly() {\n  sweep(os.cpus());\n};\n')
    modules = {i["module"] for i in cjs["imports"]}
    assert {"tools.broom", "os"} <= modules and all(c["callee"] != "require" for c in cjs["calls"])
    assert {"sweep", "os.cpus"} <= {c["callee"] for c in cjs["calls"]}


def test_js_paths_and_bad():
    assert [specifier("src/a/b.ts", s) for s in ("./c", "../c", "./d/index.ts", "./c.js", "react", "@/lib/x")] == ["src.a.c", "src.c", "src.a.d", "src.a.c", None, None]
    assert [module_name(p) for p in ("src/lib/api.ts", "src/utils/index.ts", "app.tsx", "scripts/run.cjs")] == ["src.lib.api", "src.utils", "app", "scripts.run"]
    bad = extract_js("src/broken.ts", b"export class {{{ nope ===")
    assert bad["had_errors"] and "file" in kinds(bad).values()


def test_markdown():
    text = b"# Title\n\nWords here\nand here.\n\n## Setup\n\n### First Step\n\n```\n# not a heading\n```\n\n## Setup\n"
    out = extract_markdown("docs/guide.md", text)
    rows = {s["fqname"]: (s["start_line"], s["end_line"], s["parent"]) for s in out["symbols"]}
    assert rows == {
        "docs.guide": (1, 15, None), "docs.guide.title": (1, 5, "docs.guide"), "docs.guide.setup": (6, 7, "docs.guide.title"),
        "docs.guide.first-step": (8, 13, "docs.guide.setup"), "docs.guide.setup-1": (14, 15, "docs.guide.title"),
    }
    assert one(out, "docs.guide")["docstring"] == "Words here and here."
    assert {"t.hello-world-2024", "t.faq-how-do-i"} <= set(kinds(extract_markdown("t.md", b"# Hello, World! (2024)\n## FAQ: How do I?\n")))
    assert len(extract_markdown("plain.md", b"no heading\n")["symbols"]) == 1


def test_scan_and_extract(spark, tmp_path):
    for name, body in {"app/__init__.py": "", "app/base.py": "class Base:\n    def describe(self): ...\n", "node_modules/x.js": "f()", "web/a.min.js": "f()", "notes.txt": "x", "README.md": "# A\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    files = scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"app/__init__.py", "app/base.py", "README.md"}
    rows = {r.path: r for r in extract(files).collect()}
    assert [s.fqname for s in rows["app/base.py"].symbols] == ["app.base", "app.base.Base", "app.base.Base.describe"]
    caps = measure(spark, str(tmp_path), max_files=3).first()
    assert caps.n_files == 6 and not caps.fits


def test_tree_source_prunes_before_it_reads(spark, tmp_path):
    files = {"a.py": "x", "empty.py": "", "README.md": "# t", "big.bin": "b", "node_modules/dep/i.js": "no", "src/deep/er/still/b.ts": "y", "src/a.min.js": "no", "src/node_modules/z.js": "no", "src/.git/config.py": "no", "src/Upper.PY": "z"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "node_modules" / "dep").chmod(0)  # cannot be listed: would raise if it were entered by another user
    want = {"a.py": "x", "empty.py": "", "README.md": "# t", "src/deep/er/still/b.ts": "y", "src/Upper.PY": "z"}
    for folders in (1, 3, 64):
        rows = tree(spark, str(tmp_path), SKIPPED_FOLDERS, SKIPPED_ENDINGS, [".py", ".md", ".ts", ".js"], folders=folders).collect()
        assert {r.path: r.content.decode() for r in rows} == want and len(rows) == len(want)
    sizes = tree(spark, str(tmp_path), ["node_modules"], content=False).collect()
    assert {r.path: r.size for r in sizes} == {k: len(v) for k, v in files.items() if "node_modules" not in k} and all(r.content is None for r in sizes)
    assert {r.path for r in scan(spark, str(tmp_path)).collect()} == set(want)
