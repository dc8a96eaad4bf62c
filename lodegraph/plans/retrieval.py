"""Retrieval, verification and routing queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import words
from lodegraph.operators import index
from lodegraph.operators import questions as Q
from lodegraph.operators import retrieval as R
from lodegraph.operators.enrich import context_block
from lodegraph.operators.evals import evaluate
from lodegraph.operators.verify import verify
from lodegraph.operators.views import search_graph
from lodegraph.plans.registry import query
from lodegraph.session import shared_folder
from lodegraph.sources.tables import doc_chunks, doc_lines, table

TERMS = ["licensed", "version", "idiot", "public"]
WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
BM25 = f"""
w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
z AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT doc_id, nw, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS nw, unnest(ws) AS term FROM w) WHERE term IN ('licensed', 'version', 'idiot', 'public') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * nw / mean))), 6) AS score, count(*) AS n_terms FROM tf JOIN df USING (term), z GROUP BY doc_id),
bmtop AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank0 FROM bm ORDER BY score DESC, doc_id LIMIT 20)"""
DENSE = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
dn AS (SELECT vec_id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))), 6) + 0.0 AS distance FROM embeddings, q),
dntop AS (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank0 FROM dn ORDER BY distance, vec_id LIMIT 20)"""
FUSED = f"""{BM25},{DENSE},
u AS (SELECT doc_id, 0 AS at_, 'bm25' AS signal, 1 / (60 + rank0 + 1) AS part FROM bmtop UNION ALL SELECT vec_id, 1, 'dense', 1 / (60 + rank0 + 1) FROM dntop),
fu AS (SELECT doc_id, round(sum(part), 9) AS score, list(signal ORDER BY at_) AS signals FROM u GROUP BY doc_id)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]  # the question's vector, one row


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS), "doc_id", "score")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(R.dense(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir)), "vec_id", "distance", ascending=True)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse({"bm25": _bm25(spark, sf_dir), "dense": _dense(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")}, "doc_id")


@query(f"WITH {BM25} SELECT doc_id, score, CAST(rank0 AS INTEGER) AS rank0 FROM bmtop")
def keyword_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents) SELECT doc_id FROM w WHERE list_contains(ws, 'licensed') AND list_contains(ws, 'version')")
def keyword_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["licensed", "version"], all_terms=True).select("doc_id")


@query(f"WITH {DENSE} SELECT vec_id, distance, CAST(rank0 AS INTEGER) AS rank0 FROM dntop")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query(f"WITH {FUSED} SELECT doc_id, score, array_to_string(signals, ',') AS signals FROM fu ORDER BY score DESC, doc_id LIMIT 20")
def rrf_fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).orderBy(F.col("score").desc(), "doc_id").limit(20).withColumn("signals", F.array_join("signals", ","))


EDGES = "e AS (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS dst FROM documents)"


def _reading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document to the next of its source and language; source and language are split by ranges of ids first, so
    that a large source is ordered in parts: the next of a part's last one is the least of the parts after it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").withColumn("part", F.floor(F.col("doc_id") / 4096))
    inside = Window.partitionBy("source", "lang", "part").orderBy("doc_id")
    least = d.groupBy("source", "lang", "part").agg(F.min("doc_id").alias("first"))
    after = least.withColumn("next_first", F.lead("first").over(Window.partitionBy("source", "lang").orderBy("part"))).drop("first")
    rows = d.withColumn("own", F.lead("doc_id").over(inside)).join(after, ["source", "lang", "part"])
    return rows.select(F.col("doc_id").alias("src"), F.coalesce("own", "next_first").alias("dst"), F.lit("imports").alias("kind")).where("dst is not null")


@query(f"""WITH {FUSED}, {EDGES}, seeds AS (SELECT doc_id FROM fu ORDER BY score DESC, doc_id LIMIT 45),
nb AS (SELECT dst AS doc_id FROM e WHERE src IN (SELECT doc_id FROM seeds) AND dst IS NOT NULL UNION SELECT src FROM e WHERE dst IN (SELECT doc_id FROM seeds)),
al AS (SELECT doc_id, score, array_to_string(signals, ',') AS signals FROM fu UNION ALL SELECT doc_id, round(1.0::DOUBLE / 240, 9), 'graph' FROM nb WHERE doc_id NOT IN (SELECT doc_id FROM fu))
SELECT * FROM al ORDER BY score DESC, doc_id LIMIT 45""")
def expanded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand(_fused(spark, sf_dir), _reading_edges(spark, sf_dir), "doc_id", 45).withColumn("signals", F.array_join("signals", ","))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
s AS (SELECT doc_id, n, len(list_filter(regexp_split_to_array(lower(line), '[^\p{L}\p{N}]+'), lambda w: w = 'the')) AS hits FROM l),
t AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id, n) - 1 AS rank0 FROM s WHERE hits > 0 ORDER BY hits DESC, doc_id, n LIMIT 60)
SELECT doc_id, min(rank0) AS best_rank, count(*) AS hits FROM t GROUP BY doc_id""")
def retrieve_dedup_best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the dedup, so fewer documents than chunks come out."""
    hits = doc_lines(spark, sf_dir).withColumn("hits", F.size(F.filter(words(F.col("text")), lambda w: w == "the"))).where("hits > 0")
    order = [F.col("hits").desc(), F.col("doc_id"), F.col("line")]
    top = hits.select("doc_id", "line", "hits").orderBy(*order).limit(60)
    return R.best_rank(top.withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1), "doc_id")


@query(f"""WITH {FUSED}, tp AS (SELECT doc_id, score FROM fu ORDER BY score DESC, doc_id LIMIT 10)
SELECT tp.doc_id, tp.score, d.lang, array_to_string(string_split(d.text, chr(10))[1:5], chr(10)) AS snippet FROM tp JOIN documents d USING (doc_id)""")
def hydrate_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _fused(spark, sf_dir).orderBy(F.col("score").desc(), "doc_id").limit(10)
    return R.hydrate(top, table(spark, sf_dir, "documents").select("doc_id", "lang"), doc_chunks(spark, sf_dir), "doc_id").select("doc_id", "score", "lang", "snippet")


CITED = """ci AS (SELECT item_id, k, item_id * 3 + k AS cid, (item_id * 37 + k * 411) % 1100 AS doc, item_id % 5 + 1 + k * (item_id % 4) AS s, item_id % 5 + 4 + k * (item_id % 4) AS e, text AS item FROM benchmark, (VALUES (0), (1), (2)) v(k)),
cit AS (SELECT cid, 'src' || (doc % 20) || '/' || doc AS path, s, e, CASE WHEN k = 0 THEN item WHEN k = 2 THEN substr(d.text, 1, 60) END AS quote FROM ci LEFT JOIN documents d ON d.doc_id = ci.doc),
ch0 AS (SELECT source || '/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents),
ch AS (SELECT path, b + 1 AS cs, least(b + 5, len(ls)) AS ce, array_to_string(ls[b + 1 : b + 5], chr(10)) AS t FROM (SELECT path, ls, unnest(range(0, len(ls), 5)) AS b FROM ch0)),
jn AS (SELECT cit.*, cs, ce, t FROM cit LEFT JOIN ch USING (path)),
gr AS (SELECT cid, path, s, e, quote, count(cs) AS n_path, count(*) FILTER (cs <= e AND ce >= s) AS n_overlap, string_agg(t, chr(10) ORDER BY cs, ce) FILTER (cs <= e + 5 AND ce >= s - 5) AS hay FROM jn GROUP BY ALL),
vr AS (SELECT cid, n_path, n_overlap, CASE WHEN n_path = 0 THEN 'path ''' || path || ''' not in repo' WHEN n_overlap = 0 THEN 'no source at ' || path || ':' || s || '-' || e
 WHEN trim(coalesce(quote, '')) <> '' AND NOT contains(trim(regexp_replace(coalesce(hay, ''), '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 'quoted snippet not found near cited lines' ELSE 'ok' END AS reason FROM gr)""".replace("\\\\", "\\")


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = spark.range(3).select(F.col("id").cast("int").alias("k"))
    c = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(ks))
    i = F.col("item_id")
    c = c.select((i * 3 + F.col("k")).alias("cid"), "k", ((i * 37 + F.col("k") * 411) % 1100).alias("doc"), (i % 5 + 1 + F.col("k") * (i % 4)).alias("start_line"), (i % 5 + 4 + F.col("k") * (i % 4)).alias("end_line"), F.col("text").alias("item"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.substring("text", 1, 60).alias("head"))
    quote = F.when(F.col("k") == 0, F.col("item")).when(F.col("k") == 2, F.col("head"))
    return c.join(d, "doc", "left").select("cid", F.concat(F.lit("src"), (F.col("doc") % 20).cast("string"), F.lit("/"), F.col("doc").cast("string")).alias("path"), "start_line", "end_line", quote.alias("quote"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(_citations(spark, sf_dir), doc_chunks(spark, sf_dir))


@query(f"WITH {CITED} SELECT cid, n_path > 0 AS in_repo FROM vr")
def citation_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("cid", (F.col("n_path") > 0).alias("in_repo"))


@query(f"WITH {CITED} SELECT cid, n_path, n_overlap FROM vr")
def citation_line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("cid", "n_path", "n_overlap")


@query(f"WITH {CITED} SELECT cid, reason = 'ok' AS verified, reason FROM vr")
def citation_snippet_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("cid", "verified", "reason")


@query(f"WITH {CITED} SELECT CASE WHEN reason LIKE 'path%' THEN 'path' WHEN reason LIKE 'no source%' THEN 'lines' WHEN reason = 'ok' THEN 'ok' ELSE 'snippet' END AS outcome, count(*) AS n FROM vr GROUP BY 1")
def citation_reason_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reason")
    outcome = F.when(r.startswith("path"), "path").when(r.startswith("no source"), "lines").when(r == "ok", "ok").otherwise("snippet")
    return _verified(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


TYPE = r"""CASE WHEN regexp_matches(lower(coalesce(text, '')), '\b(differ|versus|vs|compare[ds]?|than)\b') THEN 'comparison' WHEN regexp_matches(lower(coalesce(text, '')), '\b(architecture|structure|design|overview|components?)\b') THEN 'architecture'
WHEN regexp_matches(lower(coalesce(text, '')), '\b(start|begin|onboard\w*|new here|learn)\b') THEN 'onboarding' WHEN regexp_matches(lower(coalesce(text, '')), '\b(how (do|to|can)|use|usage|example)\b') THEN 'how_to'
WHEN regexp_matches(lower(coalesce(text, '')), '\b(what does|where is|function|class|method)\b|\w+\(\)|\w+_\w+') THEN 'specific_symbol' ELSE 'general' END"""


@query(f"SELECT conv_id, turn, kind, CAST(CASE kind WHEN 'architecture' THEN 15 WHEN 'onboarding' THEN 15 WHEN 'specific_symbol' THEN 8 WHEN 'comparison' THEN 12 ELSE 10 END AS INTEGER) AS k FROM (SELECT conv_id, turn, {TYPE} AS kind FROM conversations WHERE role = 'user')")
def question_type_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("kind", Q.question_type(F.col("text")))
    return q.select("conv_id", "turn", "kind", Q.top_k(F.col("kind")).alias("k"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TYPE} AS kind FROM conversations WHERE role = 'user'), r AS (SELECT *, CASE WHEN kind IN ('architecture', 'onboarding') AND (conv_id % 2 = 0 OR conv_id % 3 > 0) THEN 'global' ELSE 'local' END AS route FROM t)
SELECT conv_id, turn, kind, CASE WHEN turn % 4 = 0 AND conv_id % 5 > 1 THEN 'escalate' ELSE route END AS route FROM r""")
def router_route_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("kind", Q.question_type(F.col("text")))
    first = Q.route(F.col("kind"), F.col("conv_id") % 2 == 0, F.col("conv_id") % 3)
    return q.select("conv_id", "turn", "kind", Q.final_route(first, F.col("turn") % 4 != 0, F.greatest(F.col("conv_id") % 5 - 1, F.lit(0))).alias("route"))


@query(f"""WITH {FUSED}, tp AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT f.doc_id, f.score FROM fu f JOIN documents d ON d.doc_id = f.doc_id ORDER BY score DESC, f.doc_id LIMIT 10)),
h AS (SELECT r, d.doc_id, d.source, d.lang, string_split(d.text, chr(10)) AS ls FROM tp JOIN documents d USING (doc_id))
SELECT string_agg('[' || (r + 1) || '] ' || source || '.' || doc_id || ' (doc) — ' || source || '/' || doc_id || ':1-' || least(5, len(ls)) || chr(10) || array_to_string(ls[1:5], chr(10)), chr(10) || chr(10) ORDER BY r) AS context FROM h""")
def context_block_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").select("doc_id", "source")
    chunks = doc_chunks(spark, sf_dir)
    top = _fused(spark, sf_dir).join(nodes.select("doc_id"), "doc_id", "left_semi").orderBy(F.col("score").desc(), "doc_id").limit(10)
    items = R.hydrate(top, nodes, chunks, "doc_id").join(chunks.where("start_line = 1").select("doc_id", "end_line"), "doc_id")
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")) - 1  # ten rows
    return context_block(items.select(rank.alias("rank"), F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("fqname"), F.lit("doc").alias("kind"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), "end_line", "snippet", F.lit(None).cast("string").alias("summary")))


def _index(spark: SparkSession, sf_dir: str, of: str, english: bool = True) -> index.TextIndex:
    """The stored index of the documents or their chunks: written once for the files that the table has now, then read. That
    of plain words serves BM25 alone and has no positions."""
    t = table(spark, sf_dir, "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    files = "\n".join([f"{at.getPath()} {at.getModificationTime()} {at.getLen()}", *sorted(t.inputFiles())])
    kept = index.TextIndex(spark, f"{shared_folder(spark)}/runs-{of}-{english}-{hashlib.sha256(files.encode()).hexdigest()[:16]}", english, positions=english)
    if kept.segments == 0:
        kept.add(t if of == "documents" else _chunks(spark, sf_dir), "doc_id" if of == "documents" else "chunk_id", "text")
    return kept


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_chunks(spark, sf_dir).withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("start_line"))


QUESTION = "Which works are licensed under the public versions?"
# the forms of the question's words, written out by hand
FORMS = {"licens": "licens(e|es|ed|ing)", "version": "versions?", "work": "work(s|ed|ing|ings)?", "public": "public(s|ly)?"}


def _forms(word: str, *terms: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({word}, '{FORMS[t]}') THEN '{t}'" for t in terms or FORMS) + " END"


STEMMED = f"""w AS (SELECT doc_id, {WORDS} AS ws FROM documents), tw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM w), sx AS (SELECT doc_id, p, {_forms("w")} AS term FROM tw)"""


@query(f"WITH {STEMMED} SELECT doc_id FROM sx WHERE term IN ('licens', 'version') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def keyword_stemmed_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every word of the question, stop words left out, by stem."""
    return _index(spark, sf_dir, "documents").search(index.terms_of("What is licensing by versions?"), all_terms=True).select(F.col("key").alias("doc_id"))


@query(f"""WITH {STEMMED}, x AS (SELECT * FROM sx WHERE term IN ('licens', 'version')), ok AS (SELECT doc_id FROM x GROUP BY doc_id HAVING count(DISTINCT term) = 2),
pr AS (SELECT a.doc_id, abs(a.p - b.p) AS d FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.term < b.term AND abs(a.p - b.p) <= 100),
s AS (SELECT doc_id, 1 - exp(sum(ln(1 - 0.1 / sqrt(1.005 + 0.05 * exp(d / 1.5::DOUBLE - 2))))) AS rank FROM pr GROUP BY doc_id)
SELECT doc_id, round(coalesce(rank, 0), 6) AS rank FROM ok LEFT JOIN s USING (doc_id)""")
def keyword_proximity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents by how near the words stand to each other."""
    return _index(spark, sf_dir, "documents").proximity(index.terms_of("What is licensing by versions?")).withColumnRenamed("key", "doc_id")


ASKED = f"""w AS (SELECT doc_id, {WORDS} AS ws FROM documents), z AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT doc_id, nw, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS nw, unnest(ws) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT conv_id, turn, unnest(list_distinct({WORDS})) AS term FROM conversations WHERE role = 'user'),
sc AS (SELECT conv_id, turn, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * nw / mean))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), z GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id) - 1 AS rank0 FROM sc QUALIFY rank0 < 20)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every turn of a user, all in one plan."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select(F.struct("conv_id", "turn").alias("question"), index.question_terms(F.col("text"), english=False).alias("terms"))
    found = _index(spark, sf_dir, "documents", english=False).search_many(asked, 20)
    return found.select("question.conv_id", "question.turn", F.col("key").alias("doc_id"), "score", "rank0")


@query(f"WITH {ASKED} SELECT conv_id, turn, doc_id, score, CAST(rank0 AS INTEGER) AS rank0 FROM top")
def questions_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir)


@query(f"""WITH {ASKED}, cs AS (SELECT q.conv_id, q.turn, q.text, list_distinct([d.source || '/' || d.doc_id]) AS expected FROM conversations q LEFT JOIN documents d ON d.doc_id = q.conv_id WHERE role = 'user'),
got AS (SELECT t.conv_id, t.turn, list(d.source || '/' || d.doc_id) AS cited, string_agg(string_split(d.text, chr(10))[1], ' ' ORDER BY rank0) AS answer FROM top t JOIN documents d USING (doc_id) WHERE rank0 < 5 GROUP BY ALL),
kw AS (SELECT conv_id, turn, list_sort(list_distinct({WORDS}))[1:3] AS keywords FROM conversations WHERE role = 'user'),
r AS (SELECT cs.conv_id, cs.turn, list_filter(expected, lambda x: x IS NOT NULL) AS expected, coalesce(cited, []) AS cited, keywords, coalesce(answer, '') AS answer FROM cs LEFT JOIN got USING (conv_id, turn) JOIN kw USING (conv_id, turn)),
m AS (SELECT conv_id, turn, CASE WHEN len(cited) = 0 THEN 0 ELSE len(list_filter(cited, lambda c: list_contains(expected, lower(c)))) / len(cited) END AS p,
 CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_filter(expected, lambda e: list_contains(cited, e))) / len(expected) END AS r,
 CASE WHEN len(keywords) = 0 THEN 1 ELSE len(list_filter(keywords, lambda k: contains(lower(answer), k))) / len(keywords) END AS k FROM r)
SELECT conv_id, turn, round(CAST(p AS DOUBLE), 6) AS "precision", round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(k AS DOUBLE), 6) AS coverage FROM m""")
def questions_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation run over all turns of users in one plan: what is expected is the document of the conversation's number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.element_at(F.split("text", "\n"), 1).alias("head"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    id_ = F.struct("conv_id", "turn").alias("id")
    expected = turns.join(d.select("doc_id", "path"), F.col("conv_id") == F.col("doc_id"), "left")
    cases = expected.select(id_, F.array_compact(F.array("path")).alias("expected"), F.array().cast("array<string>").alias("optional"), F.slice(F.sort_array(F.array_distinct(words(F.col("text")))), 1, 3).alias("keywords"))
    hits = _asked(spark, sf_dir).where("rank0 < 5").join(d, "doc_id").select(id_, "rank0", "path", F.lit(True).alias("verified"), F.col("head").alias("snippet"))
    return evaluate(cases, hits).select("id.conv_id", "id.turn", "precision", "recall", "coverage")


@query(f"""WITH {ASKED}, t2 AS (SELECT conv_id, turn, doc_id, rank0, string_split(d.text, chr(10))[1] AS head FROM top JOIN documents d USING (doc_id) WHERE rank0 < 2),
q AS (SELECT conv_id, turn, (conv_id + turn) % 3 = 0 AS bad FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY rank0) AS ids FROM t2 GROUP BY ALL)
SELECT conv_id, turn, n IS NOT NULL AS answerable, CASE WHEN n IS NULL THEN '' WHEN bad THEN 'again ' || string_split(ids, ',')[1] ELSE 'first ' || ids END AS answer,
CAST(CASE WHEN n IS NULL THEN 0 WHEN bad THEN 1 ELSE n END AS INTEGER) AS n_citations, true AS fully_verified FROM q LEFT JOIN a USING (conv_id, turn)""")
def questions_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a user answered in one plan from its two best documents; a third of the drafts cites a line that is
    not there, and is written again without it."""
    hits = _asked(spark, sf_dir).where("rank0 < 2").join(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")), "doc_id")
    name = F.concat_ws(":", "conv_id", "turn")
    items = hits.select(name.alias("question"), "rank0", "doc_id", "path")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(name.alias("question"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "bad").otherwise("good").alias("text"))

    def synthesize(kind: str, found: list[dict], reasons: list[str]) -> tuple[str, list[tuple]]:
        cited = [(x["path"], 1, 1, None) for x in found]
        if reasons:
            return f"again {found[0]['doc_id']}", cited[:1]
        return "first " + ",".join(str(x["doc_id"]) for x in found), [*cited, (cited[0][0], 90_000_000, 90_000_001, None)] if kind == "bad" else cited

    parts = F.split("question", ":")
    out = Q.answer_all(turns, items, doc_chunks(spark, sf_dir), synthesize)
    return out.select(parts[0].cast("long").alias("conv_id"), parts[1].cast(table(spark, sf_dir, "conversations").schema["turn"].dataType).alias("turn"), "answerable", "answer", F.size("citations").alias("n_citations"), "fully_verified")


RETRIEVED = f"""
ch0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), ch AS (SELECT doc_id, doc_id * 1000000 + b + 1 AS chunk_id, array_to_string(ls[b + 1 : b + 5], chr(10)) AS text FROM (SELECT doc_id, ls, unnest(range(0, len(ls), 5)) AS b FROM ch0)),
cw AS (SELECT doc_id, chunk_id, {WORDS} AS ws FROM ch), cz AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM cw),
cs AS (SELECT doc_id, chunk_id, nw, {_forms("w")} AS term FROM (SELECT doc_id, chunk_id, len(ws) AS nw, unnest(ws) AS w FROM cw)), ctf AS (SELECT doc_id, chunk_id, nw, term, count(*) AS tf FROM cs WHERE term IS NOT NULL GROUP BY ALL),
cdf AS (SELECT term, count(*) AS df FROM ctf GROUP BY term), cbm AS (SELECT doc_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * nw / mean))), 6) AS score FROM ctf JOIN cdf USING (term), cz GROUP BY ALL),
ctop AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank0 FROM cbm ORDER BY score DESC, chunk_id LIMIT 20), own AS (SELECT doc_id, min(rank0) AS best FROM ctop GROUP BY doc_id), kw AS (SELECT doc_id, row_number() OVER (ORDER BY best, doc_id) - 1 AS rank0 FROM own),
{DENSE.strip()}, dnn AS (SELECT doc_id, distance FROM dn JOIN documents ON vec_id = doc_id ORDER BY distance, doc_id LIMIT 20), dnr AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) - 1 AS rank0 FROM dnn),
u AS (SELECT doc_id, 0 AS at_, 'bm25' AS signal, 1 / (60 + rank0 + 1) AS part FROM kw UNION ALL SELECT doc_id, 1, 'dense', 1 / (60 + rank0 + 1) FROM dnr), fu AS (SELECT doc_id, round(sum(part), 9) AS score, array_to_string(list(signal ORDER BY at_), ',') AS signals FROM u GROUP BY doc_id),
{EDGES}, seeds AS (SELECT doc_id FROM fu ORDER BY score DESC, doc_id LIMIT 45), nb AS (SELECT dst AS doc_id FROM e WHERE src IN (SELECT doc_id FROM seeds) AND dst IS NOT NULL UNION SELECT src FROM e WHERE dst IN (SELECT doc_id FROM seeds)),
al AS (SELECT * FROM fu UNION ALL SELECT doc_id, round(1.0::DOUBLE / 240, 9), 'graph' FROM nb WHERE doc_id NOT IN (SELECT doc_id FROM fu)), tp AS (SELECT * FROM al ORDER BY score DESC, doc_id LIMIT 45),
rt AS (SELECT tp.doc_id, source, score, signals, text AS snippet FROM tp JOIN documents d ON d.doc_id = tp.doc_id LEFT JOIN (SELECT doc_id AS id, text FROM ch WHERE chunk_id % 1000000 = 1) c ON c.id = tp.doc_id)"""
RETRIEVED = RETRIEVED.replace("SELECT tp.doc_id, source, score, signals, text AS snippet", "SELECT tp.doc_id, source, score, signals, c.text AS snippet")


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    nodes = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    chunks = _chunks(spark, sf_dir)
    hits = _index(spark, sf_dir, "chunks").search(index.terms_of(QUESTION)).withColumnRenamed("key", "chunk_id")
    found = R.retrieve(hits, _query_vector(spark, sf_dir), nodes, chunks, _reading_edges(spark, sf_dir), "doc_id", "embedding", top_k=45)
    return found.select("doc_id", "source", "score", F.array_join("signals", ",").alias("signals"), "snippet")


@query(f"WITH {RETRIEVED} SELECT * FROM rt")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir)


@query(f"WITH {RETRIEVED} SELECT doc_id, source, score, signals, substr(coalesce(snippet, ''), 1, 600) AS snippet FROM rt ORDER BY score DESC, doc_id LIMIT 12")
def search_graph_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_graph(_retrieved(spark, sf_dir))
