"""Extraction queries over documents, pages and sources made of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import paths, text
from lodegraph.operators import markdown
from lodegraph.plans.registry import query
from lodegraph.sources.files import clone_error, allowed_url, extract, wanted
from lodegraph.sources.tables import doc_lines, table

LINES = "l AS (SELECT doc_id, source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)"


@query(f"WITH {LINES} SELECT path, max(n) AS loc, count(*) FILTER (trim(t) <> '') AS filled FROM l GROUP BY path")
def document_lines_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir)
    return rows.groupBy("path").agg(F.max("line").cast("long").alias("loc"), F.count_if(F.trim("text") != "").alias("filled"))


#: Documents have no headings, so every third line is read as one, and every eleventh as a fence.
MARKED = f"""{LINES}, m AS (SELECT path, n AS line, CASE WHEN (doc_id + n) % 11 = 0 THEN '```' WHEN (doc_id + n) % 3 = 0 THEN repeat('#', CAST(1 + (doc_id * 7 + n) % 4 AS INTEGER)) || ' ' || substr(t, 1, 9) ELSE t END AS x FROM l),
f AS (SELECT *, trim(x) LIKE '```%' OR trim(x) LIKE '~~~%' AS fence FROM m), g AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY path ORDER BY line) % 2 AS o, max(line) OVER (PARTITION BY path) AS nl FROM f),
hd AS (SELECT path, line, nl, length(regexp_extract(trim(x), '^(#{{1,3}})', 1)) AS level, trim(regexp_replace(regexp_replace(trim(x), '^#{{1,3}}[ \\t]+', ''), '[ \\t]+#+$', '')) AS title FROM g WHERE o = 0 AND NOT fence AND regexp_matches(trim(x), '^#{{1,3}}[ \\t]+\\S')),
sl AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS base FROM hd),
nm AS (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line) - 1 AS k FROM sl), ns AS (SELECT *, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS slug FROM nm),
h1 AS (SELECT *, last_value(CASE WHEN level = 1 THEN slug END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p1, sum(CAST(level = 1 AS INTEGER)) OVER (PARTITION BY path ORDER BY line) AS part FROM ns),
h2 AS (SELECT *, last_value(CASE WHEN level = 2 THEN slug END IGNORE NULLS) OVER (PARTITION BY path, part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p2 FROM h1)
SELECT path, CAST(level AS INTEGER) AS level, title, slug, CASE level WHEN 1 THEN NULL WHEN 2 THEN p1 ELSE coalesce(p2, p1) END AS parent, line AS start_line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, nl) AS end_line FROM h2
UNION ALL SELECT path, 0, NULL, NULL, NULL, 1, max(line) FROM m GROUP BY path"""


@query("WITH " + MARKED)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("line")
    marked = F.when((d + n) % 11 == 0, F.lit("```")).when((d + n) % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + (d * 7 + n) % 4).cast("int")), F.lit(" "), F.substring("text", 1, 9))).otherwise(F.col("text"))
    return markdown.sections(doc_lines(spark, sf_dir).select("path", "line", marked.alias("text")))


@query(r"""WITH s AS (SELECT doc_id, source, coalesce(nullif(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS base FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) - 1 AS k FROM s) SELECT doc_id, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS slug FROM n""")
def slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", text.slug(F.element_at(text.lines(F.col("text")), 1)).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("doc_id")) - 1
    return d.withColumn("k", k).select("doc_id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("slug"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS n FROM t),
a AS (SELECT *, trim(t) <> '' AND trim(t) NOT LIKE '#%' AS is_text FROM x), f AS (SELECT doc_id, min(n) AS s FROM a WHERE is_text GROUP BY doc_id), e AS (SELECT a.doc_id, min(a.n) AS e FROM a JOIN f USING (doc_id) WHERE NOT is_text AND a.n > f.s GROUP BY a.doc_id)
SELECT CAST(a.doc_id AS VARCHAR) AS path, string_agg(trim(t), ' ' ORDER BY n) AS paragraph FROM a JOIN f USING (doc_id) LEFT JOIN e USING (doc_id) WHERE a.n >= f.s AND (e.e IS NULL OR a.n < e.e) GROUP BY a.doc_id""")
def first_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.first_paragraph(doc_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "line", "text"))


SPECIFIERS = ["./c", "../c", "./d/index.ts", "./c.js", "react", "@/lib/x", "../../x", "../../../../y.mjs", "./index"]


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'index.ts' WHEN 1 THEN 'lib/index.tsx' ELSE 'src/p' || page_id || '/b.ts' END AS importer, ['./c', '../c', './d/index.ts', './c.js', 'react', '@/lib/x', '../../x', '../../../../y.mjs', './index'][page_id % 9 + 1] AS spec FROM pages),
x AS (SELECT *, string_split(regexp_replace(importer, '\.tsx?$', ''), '/') AS own, string_split(regexp_replace(regexp_replace(spec, '\.(ts|js|mjs)$', ''), '/index$', ''), '/') AS parts FROM p),
y AS (SELECT *, own[1 : greatest(len(own) - 1 - len(list_filter(parts, lambda q: q = '..')), 0)] || list_filter(parts, lambda q: q NOT IN ('.', '..')) AS target FROM x)
SELECT page_id, importer, spec, CASE WHEN spec LIKE '.%' THEN array_to_string(target, '.') END AS target, array_to_string(CASE WHEN len(own) > 1 AND own[-1] = 'index' THEN own[1 : len(own) - 1] ELSE own END, '.') AS module FROM y""".replace("\\\\", "\\"))
def js_specifier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a module that imports another by one of several specifiers."""
    i = F.col("page_id")
    importer = F.when(i % 4 == 0, "index.ts").when(i % 4 == 1, "lib/index.tsx").otherwise(F.concat(F.lit("src/p"), i.cast("string"), F.lit("/b.ts")))
    spec = F.element_at(F.array(*[F.lit(x) for x in SPECIFIERS]), (i % len(SPECIFIERS)).cast("int") + 1)
    df = table(spark, sf_dir, "pages").select("page_id", importer.alias("importer"), spec.alias("spec"))
    return df.select("page_id", "importer", "spec", paths.js_specifier(F.col("importer"), F.col("spec")).alias("target"), paths.js_module(F.col("importer")).alias("module"))


@query("""WITH c AS (SELECT c_custkey, 'n' || c_nationkey || '.' || lower(c_mktsegment) || '.c' || c_custkey AS importer, ['', 'pkg', 'pkg.deep'][c_custkey % 3 + 1] AS module, CAST(c_custkey % 5 + 1 AS INTEGER) AS level FROM customer)
SELECT c_custkey, importer, module, level, array_to_string(string_split(importer, '.')[1 : greatest(3 - level, 0)] || CASE WHEN module = '' THEN [] ELSE [module] END, '.') AS target FROM c""")
def relative_import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a module three names deep with a relative import of one to five levels."""
    k = F.col("c_custkey")
    importer = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("."), F.lower("c_mktsegment"), F.lit(".c"), k.cast("string"))
    module = F.element_at(F.array(F.lit(""), F.lit("pkg"), F.lit("pkg.deep")), (k % 3).cast("int") + 1)
    df = table(spark, sf_dir, "customer").select("c_custkey", importer.alias("importer"), module.alias("module"), (k % 5 + 1).cast("int").alias("level"))
    return df.withColumn("target", paths.relative_module(F.col("importer"), F.col("module"), F.col("level")))


@query(r"""WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS x, url FROM pages) SELECT url, regexp_matches(lower(url), '^https?://github\.com([:/?#]|$)') AS allowed,
NOT regexp_matches(x, '(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build|\.mypy_cache|\.pytest_cache|\.ruff_cache|site-packages|\.next|\.turbo|coverage|vendor)(/|$)') AND regexp_matches(lower(x), '\.(py|js|jsx|mjs|cjs|ts|tsx|md)$') AND NOT regexp_matches(x, '\.(min\.js|min\.mjs|bundle\.js)$') AS indexed FROM p""")
def source_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("url", allowed_url(F.col("url")).alias("allowed"), wanted(path).alias("indexed"))


SAID = ["fatal: Authentication failed for ", "remote: Repository not found. ", "fatal: unable to access: timed out ", "The requested URL returned error: 403 ", "error: RPC failed "]


@query("""WITH s AS (SELECT conv_id, turn, ['fatal: Authentication failed for ', 'remote: Repository not found. ', 'fatal: unable to access: timed out ', 'The requested URL returned error: 403 ', 'error: RPC failed '][(conv_id + turn) % 5 + 1] || text AS stderr FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(stderr), 'authentication failed|could not read username|terminal prompts disabled|repository not found|fatal: could not read|403|404') THEN 'private' ELSE 'generic' END AS outcome FROM s""")
def clone_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation behind one of the things that a clone says when it fails."""
    head = F.element_at(F.array(*[F.lit(x) for x in SAID]), ((F.col("conv_id") + F.col("turn")) % len(SAID)).cast("int") + 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clone_error(F.concat(head, "text")).alias("outcome"))


BASE = "class Base{n}:\n    def describe(self):\n        return '{n}'\n"
PYTHON = "from .base import Base{n}\n\n\nclass S{k}(Base{n}):\n    def run(self):\n        return ship{k}(1)\n\n\ndef ship{k}(x):\n    return x\n"
SCRIPT = "import {{ Base as B }} from './base'\n\nexport class View{k} extends B {{\n  show(id) {{\n    return draw{k}(id)\n  }}\n}}\n\nexport function draw{k}(x) {{\n  return x\n}}\n"


def _filled(form: str) -> Column:
    """A source text with a nation's and a supplier's key put in."""
    text = F.replace(F.lit(form.replace("{{", "{").replace("}}", "}")), F.lit("{n}"), F.col("n").cast("string"))
    return (F.replace(text, F.lit("{k}"), F.col("k").cast("string")) if "{k}" in form else text).cast("binary")


def source_files(spark: SparkSession, sf_dir: str, python_only: bool = False) -> DataFrame:
    """path and content: of each nation a Python file with a base class, of each supplier one with a class of that base and
    a function, and one in JavaScript."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))
    files = nation.select(F.concat(F.lit("n"), "n", F.lit("/base.py")).alias("path"), _filled(BASE).alias("content"))
    files = files.unionByName(supplier.select(F.concat(F.lit("n"), "n", F.lit("/s"), "k", F.lit(".py")).alias("path"), _filled(PYTHON).alias("content")))
    return files if python_only else files.unionByName(supplier.select(F.concat(F.lit("web/s"), "k", F.lit(".js")).alias("path"), _filled(SCRIPT).alias("content")))


#: What the extractors find in these files, by the files' form.
SYMBOLS = """sy AS (SELECT 'n' || n_nationkey || '/base.py' AS path, 'n' || n_nationkey || '.base' || x AS fqname, replace(kind, '#', '') AS kind, s AS start_line, e AS end_line, 0 AS fan_in, 0 AS fan_out, CASE WHEN x <> '' THEN 'n' || n_nationkey || '.base' || p END AS parent
 FROM nation, (VALUES ('', 'file', 1, 4, ''), ('.Base#', 'class', 1, 3, ''), ('.Base#.describe', 'method', 2, 3, '.Base#')) v(x0, kind, s, e, p0), LATERAL (SELECT replace(x0, '#', n_nationkey::VARCHAR) AS x, replace(p0, '#', n_nationkey::VARCHAR) AS p)
 UNION ALL SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.py', 'n' || s_nationkey || '.s' || s_suppkey || x, kind, s, e, i, o, CASE WHEN x <> '' THEN 'n' || s_nationkey || '.s' || s_suppkey || p END
 FROM supplier, (VALUES ('', 'file', 1, 11, 0, 0, ''), ('.S#', 'class', 4, 6, 0, 0, ''), ('.S#.run', 'method', 5, 6, 0, 1, '.S#'), ('.ship#', 'function', 9, 10, 1, 0, '')) v(x0, kind, s, e, i, o, p0), LATERAL (SELECT replace(x0, '#', s_suppkey::VARCHAR) AS x, replace(p0, '#', s_suppkey::VARCHAR) AS p))"""


@query(f"""WITH {SYMBOLS} SELECT path, kind, fqname, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, parent FROM sy
UNION ALL SELECT 'web/s' || s_suppkey || '.js', kind, 'web.s' || s_suppkey || x, s, e, CASE WHEN x <> '' THEN 'web.s' || s_suppkey || p END
FROM supplier, (VALUES ('', 'file', 1, 12, ''), ('.View#', 'class', 3, 7, ''), ('.View#.show', 'method', 4, 6, '.View#'), ('.draw#', 'function', 9, 11, '')) v(x0, kind, s, e, p0), LATERAL (SELECT replace(x0, '#', s_suppkey::VARCHAR) AS x, replace(p0, '#', s_suppkey::VARCHAR) AS p)""")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(source_files(spark, sf_dir)).selectExpr("path", "inline(symbols)").select("path", "kind", "fqname", "start_line", "end_line", "parent")


@query("""SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.py' AS path, 'n' || s_nationkey || '.s' || s_suppkey || '.S' || s_suppkey || '.run' AS caller, 'ship' || s_suppkey AS callee, CAST(6 AS INTEGER) AS line FROM supplier
UNION ALL SELECT 'web/s' || s_suppkey || '.js', 'web.s' || s_suppkey || '.View' || s_suppkey || '.show', 'draw' || s_suppkey, 5 FROM supplier""")
def source_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(source_files(spark, sf_dir)).selectExpr("path", "inline(calls)")


@query("""SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.py' AS path, 'base' AS module, 'Base' || s_nationkey AS imported, NULL AS alias, CAST(1 AS INTEGER) AS line, true AS relative, CAST(1 AS INTEGER) AS level FROM supplier
UNION ALL SELECT 'web/s' || s_suppkey || '.js', 'web.base', 'Base', 'B', 1, false, 0 FROM supplier""")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(source_files(spark, sf_dir)).selectExpr("path", "inline(imports)")
