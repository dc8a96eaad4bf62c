"""Module names out of paths, and imports out of specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JS_SUFFIX = r"\.(?:d\.ts|tsx|ts|jsx|mjs|cjs|js)$"


def python_module(path: Column) -> Column:
    """app/auth/jwt.py is app.auth.jwt; a package's __init__ is the package."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"(^|/)__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def js_module(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, JS_SUFFIX, ""), r"/index$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def js_specifier(importer: Column, spec: Column) -> Column:
    """The module that a relative specifier names, from the importing file's path; null for any other."""
    bare = F.regexp_replace(F.regexp_replace(spec, JS_SUFFIX, ""), r"/index$", "")
    folder = F.filter(F.split(F.regexp_replace(importer, r"/?[^/]*$", ""), "/"), lambda p: p != "")

    def step(at: Column, part: Column) -> Column:
        up = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        return F.when(part.isin("", "."), at).when(part == "..", up).otherwise(F.concat(at, F.array(part)))

    return F.when(spec.startswith("."), F.array_join(F.aggregate(F.split(bare, "/"), folder, step), "."))


def relative_module(importer: Column, module: Column, level: Column) -> Column:
    """A Python relative import: the importer's last part goes, level - 1 more go, the module follows."""
    parts = F.split(importer, r"\.")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0)))
    tail = F.when(F.coalesce(module, F.lit("")) != "", F.array(module)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(base, tail), ".")
