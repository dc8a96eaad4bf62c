"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns, kept if long enough. The scan then adds "token"
candidates (long runs that mix capitals, small letters and digits). Every candidate value is hashed, and hashes are
aggregated over the corpus by distinct repositories and owners: a value found with one owner alone, and not in as many
as MANY_REPOSITORIES of its repositories, is owner-specific and looks live; one with MANY_OWNERS owners or in
MANY_REPOSITORIES repositories is a widely copied example. Token candidates become spans only if owner-specific; base
spans always stay.

Places: splitting a text at a pattern gives the pieces between its matches, so lengths of pieces and matches, summed,
are offsets in code points.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; rows repeated with the same id
and text count once in the statistics and get the same result; texts of any length are scanned in time that grows in
proportion; ties of place go by kind; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import row_key, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as AKIA[A-Z0-9]+ of 18 or more: either takes whole runs
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
MANY_OWNERS, MANY_REPOSITORIES, BLOCK = 3, 10, 64


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks, so that the work grows in proportion to its size and not to its square."""
    add = lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, -1), F.lit(0)) + x))
    none = F.array().cast("array<int>")
    sums = lambda xs: F.aggregate(xs, none, lambda a, x: F.when(F.size(a) > 0, add(a, x)).otherwise(F.array(x)))
    within = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(BLOCK)), lambda i: sums(F.slice(xs, i + 1, F.lit(BLOCK))))

    def shifted(blocks: Column) -> Column:
        before = F.transform(F.array(sums(F.transform(blocks, lambda b: F.element_at(b, -1)))), lambda t: F.concat(F.array(F.lit(0)), F.slice(t, 1, F.size(t) - 1)))[0]
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b, lambda x: x + at)))

    return F.transform(F.array(within(lengths)), shifted)[0]


def _matches(text: Column, pattern: str, value_group: int, least: int) -> Column:
    """array<struct<s, e, v>> of the matches whose value is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def spans(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["pieces"], 1, F.size(x["m"])), x["m"], lambda p, m: F.length(p) + F.length(m))
        ends = F.transform(F.array(lengths), _running)[0]
        sized = F.zip_with(x["m"], x["v"], lambda m, v: F.struct(F.length(m).alias("n"), v.alias("v")))
        return F.zip_with(sized, ends, lambda y, e: F.struct((e - y["n"]).alias("s"), e.alias("e"), y["v"].alias("v")))

    # bound to a variable, so that the text is matched and split once
    once = F.array(F.struct(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("pieces")))
    all_spans = F.transform(once, lambda x: F.when(F.size(x["m"]) > 0, spans(x)).otherwise(none))[0]
    return F.filter(all_spans, lambda x: F.length(x["v"]) >= least)


def scan(documents: DataFrame, doc_id: str, text: str, repository: str, owner: str) -> DataFrame:
    """key, doc_id, repository, owner and cands: array<struct<s, k, e, v>>, k the kind's place in KINDS."""
    base = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    t = F.col("t")
    mixed = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    kinds = [_matches(t, ASSIGN, 2, 12), _matches(t, ACCESS, 0, 18), _matches(t, HEX, 0, 16), F.filter(_matches(t, TOKEN, 0, 20), lambda x: mixed(x["v"]))]

    def tag(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    tagged = [tag(spans, k) for k, spans in enumerate(kinds)]
    return base.select("doc_id", row_key(F.col("doc_id"), t).alias("key"), "repository", "owner", F.array_sort(F.concat(*tagged)).alias("cands"))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source", many: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES) -> DataFrame:
    """Per row: doc_id, cands (the base candidates), base_spans and spans (kind:start:end lists), and counts of values
    that are owner-specific (n_live) or copied by many owners (n_example)."""
    seen = written(scan(documents, doc_id, text, repository, owner), "secrets-scan")
    each = seen.where(F.size("cands") > 0).select("key", "repository", "owner", F.explode("cands").alias("c")).select("key", "repository", "owner", "c.*").withColumn("h", F.sha2("v", 256))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    # repositories and owners apart, so that a value with many repositories meets its few owners in partial sums
    repos = each.select("h", mark("repository").alias("r")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_repositories"))
    owners = each.select("h", mark("owner").alias("o")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"))
    freq = written(owners.join(repos, "h"), "secrets-owners")
    judged = each.dropDuplicates(["key", "s", "k"]).join(freq, "h")
    copied = F.col("n_repositories") >= many_repositories
    live, example = (F.col("n_owners") == 1) & ~copied, (F.col("n_owners") >= many) | copied
    per_doc = judged.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when((F.col("k") < 3) | live, F.struct("s", "k", "e")))).alias("kept"),
        F.count_if(live).alias("n_live"), F.count_if(example).alias("n_example"), F.max("n_repositories").alias("most_repositories"),
    )
    out = seen.select("doc_id", "key", F.filter("cands", lambda x: x["k"] < 3).alias("cands")).join(per_doc, "key", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "cands", _joined(F.col("cands")).alias("base_spans"), F.coalesce(_joined(F.col("kept")), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"), F.coalesce("most_repositories", zero).alias("most_repositories"),
    )
