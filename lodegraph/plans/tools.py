"""Sessions, tools and evaluation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import fnv1a, iso, latency_ms, mulberry32
from lodegraph.operators import evals, sessions, tools
from lodegraph.operators.graph import with_ids
from lodegraph.operators.views import walkthrough
from lodegraph.plans.registry import query
from lodegraph.session import shared_folder
from lodegraph.sources.files import capped
from lodegraph.sources.manifest import ManifestTable
from lodegraph.sources.tables import doc_chunks, doc_lines, table


@query("SELECT conv_id, min(turn) AS first_at, max(turn) AS last_at, count(*) AS n, min(text) AS first_question, arg_min(text, turn) AS opening_question FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rollup(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn", "text")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, 'Previous conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'You: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) || chr(10) || '---' AS context FROM r WHERE n <= 10 GROUP BY conv_id""")
def session_last5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.context(table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')"), "conv_id", "turn", "role", "text")


@query("SELECT c_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderdate = m) AS latest FROM (SELECT c_custkey, o.*, max(o_orderdate) OVER (PARTITION BY c_custkey) AS m FROM customer LEFT JOIN orders o ON o_custkey = c_custkey) GROUP BY c_custkey")
def latest_child_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return sessions.latest_child(c, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS status_rank FROM orders")
def status_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sessions.status_rank(F.col("o_orderstatus"), "F", "O").alias("status_rank")).orderBy("status_rank", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING'")
def row_visibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("owner", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return sessions.visible(rows, "owner", "BUILDING").select("c_custkey")


@query(r"""WITH l AS (SELECT source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT path, CAST(n AS INTEGER) AS line, substr(trim(t), 1, 200) AS text FROM l WHERE regexp_matches(t, '\b[Ll]icensed under\b') ORDER BY path, n LIMIT 40""")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.grep(doc_lines(spark, sf_dir), r"\b[Ll]icensed under\b")


@query("SELECT source || '/' || doc_id AS path, sha256(substr(text, 1, 16000)) AS text_hash, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line FROM documents")
def file_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.read_file(doc_chunks(spark, sf_dir)).select("path", F.sha2("text", 256).alias("text_hash"), "start_line", "end_line")


@query("SELECT source || '/' || doc_id AS path, sha256(substr(text, 1, 16000)) AS text_hash FROM documents")
def file_maximal_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and, inside them, their first lines again: the inner ones are left out."""
    chunks = doc_chunks(spark, sf_dir).select("path", "start_line", "end_line", "text")
    inner = chunks.where("end_line > start_line").select("path", "start_line", F.col("start_line").alias("end_line"), F.element_at(F.split("text", "\n"), 1).alias("text"))
    return tools.read_file(chunks.unionByName(inner), maximal=True).select("path", F.sha2("text", 256).alias("text_hash"))


@query("WITH d AS (SELECT p_partkey, p_name, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) SELECT p_partkey, p_name, degree FROM d WHERE contains(lower(p_name), 're') ORDER BY degree DESC, p_name LIMIT 8")
def fqname_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("degree"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(n, "p_partkey", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return tools.search_names(parts, "p_name", " Re ", "degree")


@query("WITH l AS (SELECT source || '/' || doc_id AS path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS loc FROM documents) SELECT path, loc FROM l ORDER BY path LIMIT 80")
def skeleton_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).groupBy("path").agg(F.max("line").cast("long").alias("loc")).orderBy("path").limit(80)


CASES = """c AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN [] WHEN doc_id % 2 = 0 THEN ['src/a' || (doc_id % 5) || '.py', 'src/b.py'] ELSE ['./SRC/A' || (doc_id % 5) || '.py'] END AS expected, CASE WHEN doc_id % 3 = 0 THEN ['README.md'] ELSE [] END AS optional,
 CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['The', 'zzz', lang] END AS keywords, text || ' ' || lang AS answer, doc_id % 11 = 0 AS bad,
 list_filter([{'p': 'src/a' || (doc_id % 5) || '.py', 'v': doc_id % 2 = 0}, {'p': 'readme.md', 'v': true}, {'p': 'src/B.py', 'v': doc_id % 3 > 0}, {'p': 'src/a' || (doc_id % 5) || '.py', 'v': doc_id % 5 = 0}], lambda x: x.v) AS cites FROM documents),
n AS (SELECT *, list_distinct(list_transform(expected, lambda p: lower(ltrim(trim(p), './')))) AS ex, list_distinct(list_transform(list_concat(expected, optional), lambda p: lower(ltrim(trim(p), './')))) AS al, list_transform(cites, lambda x: lower(ltrim(trim(x.p), './'))) AS ci FROM c),
sc AS (SELECT id, bad, round(CASE WHEN len(ci) = 0 THEN 0 ELSE len(list_filter(ci, lambda p: list_contains(al, p))) / len(ci) END, 6) AS precision, round(CASE WHEN len(ex) = 0 THEN 1 ELSE len(list_intersect(ex, ci)) / len(ex) END, 6) AS recall,
 round(CASE WHEN len(keywords) = 0 THEN 1 ELSE len(list_filter(keywords, lambda k: contains(lower(answer), lower(k)))) / len(keywords) END, 6) AS coverage, array_to_string(list_filter(keywords, lambda k: NOT contains(lower(answer), lower(k))), ',') AS missing FROM n)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    a = lambda pre: F.concat(F.lit(pre), (i % 5).cast("string"), F.lit(".py"))
    none = F.array().cast("array<string>")
    cite = lambda p, v: F.struct(p.alias("path"), v.alias("verified"))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.when(i % 7 == 0, none).when(i % 2 == 0, F.array(a("src/a"), F.lit("src/b.py"))).otherwise(F.array(a("./SRC/A"))).alias("expected"), F.when(i % 3 == 0, F.array(F.lit("README.md"))).otherwise(none).alias("optional"),
        F.when(i % 4 == 0, none).otherwise(F.array(F.lit("The"), F.lit("zzz"), "lang")).alias("keywords"), F.concat_ws(" ", "text", "lang").alias("answer"), F.when(i % 11 == 0, F.lit("failed")).alias("error"),
        F.array(cite(a("src/a"), i % 2 == 0), cite(F.lit("readme.md"), F.lit(True)), cite(F.lit("src/B.py"), i % 3 > 0), cite(a("src/a"), i % 5 == 0)).alias("citations"),
    )


@query(f"WITH {CASES} SELECT id, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall FROM sc")
def eval_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.score(_cases(spark, sf_dir)).select("id", "precision", "recall")


@query(f"WITH {CASES} SELECT id, CAST(coverage AS DOUBLE) AS coverage, missing FROM sc")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.score(_cases(spark, sf_dir)).select("id", "coverage", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {CASES} SELECT round(avg(precision) FILTER (NOT bad), 6) AS precision, round(avg(recall) FILTER (NOT bad), 6) AS recall, round(avg(coverage) FILTER (NOT bad), 6) AS coverage, count(*) FILTER (NOT bad) AS n_scored, count(*) FILTER (bad) AS n_errors FROM sc")
def eval_macro_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.macro(evals.score(_cases(spark, sf_dir)))


@query("SELECT source AS workspace, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) <= 5000 AND sum(strlen(text)) <= 100000 AS fits FROM documents GROUP BY source")
def workspace_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a workspace, against the cap of files and one of bytes that some of them pass."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.octet_length("text").alias("length"))
    return capped(d, ["workspace"], max_bytes=100_000)


@query("SELECT conv_id, turn, text, strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + turn), '%Y-%m-%dT%H:%M:%SZ') AS asked_at FROM conversations WHERE role = 'user' ORDER BY conv_id * 100 + turn DESC, conv_id, turn LIMIT 50")
def latest_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("conv_id") * 100 + F.col("turn"))
    q = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("at", at)
    return sessions.latest(q, "at", "conv_id", "turn").select("conv_id", "turn", "text", iso(F.col("at")).alias("asked_at"))


@query("WITH s AS (SELECT conv_id, max(turn) AS last_at, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT * FROM s ORDER BY last_at DESC, conv_id LIMIT 50")
def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sessions.rollup(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn", "text")
    return sessions.latest(r, "last_at", "conv_id").select("conv_id", "last_at", "n")


@query("SELECT c_custkey, m AS latest, row_number() OVER (ORDER BY m DESC NULLS LAST, c_custkey DESC) AS at FROM (SELECT c_custkey, max(o_orderdate) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def repos_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their latest order, those without one last, then the newest customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    last = sessions.latest_child(c, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderdate", "o_orderdate", "o_orderkey")
    return with_ids(last, F.col("latest").desc_nulls_last(), F.col("c_custkey").desc()).select("c_custkey", "latest", F.col("id").alias("at"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def run_belongs_to_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return sessions.belonging(table(spark, sf_dir, "events"), own, "user_id").select("event_id", "user_id")


@query("""WITH RECURSIVE b AS (SELECT doc_id, encode(source || '/' || doc_id) AS s FROM documents), f(doc_id, s, i, h) AS (SELECT doc_id, s, 0, CAST(2166136261 AS BIGINT) FROM b
 UNION ALL SELECT doc_id, s, i + 1, (xor(h, CAST(('0x' || substr(hex(s), 2 * i + 1, 2)) AS BIGINT)) * CAST(16777619 AS HUGEINT)) % 4294967296 FROM f WHERE i < octet_length(s))
SELECT doc_id, CAST(h AS BIGINT) AS placed FROM f WHERE i = octet_length(s)""")
def fnv1a_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path's 32-bit FNV-1a."""
    return table(spark, sf_dir, "documents").select("doc_id", fnv1a(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("placed"))


@query("WITH o AS (SELECT o_orderkey, o_orderdate, min(l_shipdate) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY ALL) SELECT o_orderkey, coalesce(strftime(s, '%Y-%m-%dT%H:%M:%SZ'), '') AS shipped_at, CAST(coalesce(epoch_ms(s) - epoch_ms(o_orderdate), 0) AS BIGINT) AS latency_ms FROM o")
def latency_and_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an order's first large item was shipped, empty and 0 if none was, and how long that took."""
    first = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(first, "o_orderkey", "left")
    return o.select("o_orderkey", iso(F.col("s")).alias("shipped_at"), F.coalesce(latency_ms(F.col("o_orderdate"), F.col("s")), F.lit(0)).alias("latency_ms"))


@query("""WITH t AS (SELECT source || '/' || doc_id AS path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS loc, lang FROM documents), f AS (SELECT 'file' AS part, path AS name, loc AS n FROM t ORDER BY path LIMIT 80),
dg AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT 'symbol', p_name, coalesce(n, 0) FROM part LEFT JOIN dg ON l_partkey = p_partkey ORDER BY 3 DESC, 2 LIMIT 40), d AS (SELECT 'doc', path, loc FROM t WHERE lang = 'de' ORDER BY path LIMIT 20)
SELECT * FROM f UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def repo_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner sees: files with their lines, central symbols, documents."""
    files = doc_lines(spark, sf_dir).groupBy("path", "doc_id").agg(F.max("line").cast("long").alias("n"))
    kinds = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", "doc").otherwise("file").alias("kind"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    symbols = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")).join(n, "p_partkey", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    docs = files.join(kinds.where("kind = 'doc'"), "doc_id")
    return tools.skeleton(files.select(F.col("path").alias("name"), "n"), symbols, docs.select(F.col("path").alias("name"), "n"))


@query("""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, lang, n_chars + CASE WHEN source = 'src1' AND lang = 'en' THEN 1000000 ELSE 0 END AS n_chars FROM documents)
SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT doc_id) AS ids, CAST(count_if(lang = 'broken') AS BIGINT) AS broken FROM d GROUP BY source""")
def store_after_failed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written, updated by key, and written again by a run that fails half way, of which nothing is seen."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.coalesce("source", F.lit("none")).alias("source"))
    kept = ManifestTable(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "source")
    kept.replace(rows)
    kept.replace(rows)  # as good as once
    kept.update(rows.where("source = 'src1' and lang = 'en'").select("doc_id", (F.col("n_chars") + 1_000_000).alias("n_chars")), "doc_id")
    fails = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(7)) == 0, F.raise_error(F.lit("lost half way")).cast("string")).otherwise("broken")
    try:
        kept.replace(rows.withColumn("lang", fails))
    except Exception as error:
        if "lost half way" not in str(error):
            raise
    return kept.read().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("lang") == "broken").alias("broken"))


LOW = "(({a} // 65536 * ({b})) % 65536 * 65536 + {a} % 65536 * ({b})) % 4294967296"


@query(f"""WITH a AS (SELECT c_custkey, n, (c_custkey * 2654435761 + CAST(n AS BIGINT) * 1831565813) % 4294967296 AS a FROM customer, (VALUES (1), (2)) v(n)),
t AS (SELECT *, {LOW.format(a="xor(a, a >> 15)", b="a | 1")} AS t FROM a),
u AS (SELECT *, xor((t + {LOW.format(a="xor(t, t >> 7)", b="t | 61")}) % 4294967296, t) AS u FROM t)
SELECT c_custkey, n, CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296 AS draw FROM u""")
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws of a generator seeded by each customer's key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return c.select("c_custkey", "n", mulberry32(F.col("c_custkey") * 2654435761, F.col("n")).alias("draw"))


@query("""SELECT doc_id, turn, text FROM (SELECT conv_id AS doc_id, turn, text, row_number() OVER (ORDER BY turn DESC, conv_id * 1000 + turn) AS r FROM conversations WHERE role = 'user' AND conv_id = 3 AND (conv_id % 4 = 0 OR conv_id % 4 = 3)) WHERE r <= 50""")
def session_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of one session that a user may see: the filter on the session is there because one is given."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'")
    owner = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string")))
    rows = q.select(F.lit("r").alias("repo_id"), owner.alias("user_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sessions.questions_of(rows, "r", "u3", 3).select(F.col("session_id").alias("doc_id"), F.col("created_at").alias("turn"), "text")


@query("""WITH t AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS step FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(step AS INTEGER) AS step, 'See ' || n_name AS title, lower(r_name) || '.' || lower(replace(n_name, ' ', '_')) AS fqname, CASE WHEN step <> 2 THEN lower(r_name) || '/' || lower(n_name) END AS path, n_name || ' of ' || r_name AS text FROM t WHERE r_name = 'ASIA'""")
def walkthrough_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tour of a region's nations, the third of which is not among the known nodes."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    name = F.concat_ws(".", F.lower("r_name"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    stop = F.struct("n_nationkey", F.concat(F.lit("See "), "n_name").alias("title"), name.alias("fqname"), F.concat("n_name", F.lit(" of "), "r_name").alias("text"))
    tour = n.agg(F.array_sort(F.collect_list(stop)).alias("t")).select(F.transform("t", lambda x: F.struct(x["title"].alias("title"), x["fqname"].alias("fqname"), x["text"].alias("text"))).alias("tour"))
    third = n.agg(F.element_at(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), 3)["n_name"].alias("third"))  # of five nations
    nodes = n.join(F.broadcast(third), n.n_name != F.col("third")).select(name.alias("fqname"), F.concat_ws("/", F.lower("r_name"), F.lower("n_name")).alias("path"))
    return walkthrough(tour, nodes)
