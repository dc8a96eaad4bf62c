"""Line dedup by a log-template tree, in DataFrame functions only.

A line's variable fields (words with a digit) become <*>; its place in the tree, of fixed depth, is its word count and
first LEADING words. In a leaf that several distinct lines reach, the commonest line (ties: the earliest) is a template
and takes in each line that agrees with it in at least SIMILARITY of its places; the commonest line not yet placed is
the next template, until none is left. First templates are met one a leaf; what then remains meets the commonest lines
that share a segment with it, of which two lines that agree enough have one, and is settled in rounds. A template found
in more than one document is recurring: its lines stay in the first document that has it (smallest doc_id) and are
dropped from all others. Lines of fewer than SHORT_WORDS words recur by chance too, so they are dropped only if at least
SHORT_DOCUMENTS documents have them.

Only line hashes are counted over the corpus; words are compared for leaves with several lines in several documents
alone, and of one line of each kind.

Defined cases: a null text stays null; empty texts and tables stay as they are; rows with a null doc_id stay as they are
and count nowhere; rows repeated with the same id and text are one document; lines repeated inside one document do not
recur by that; blank lines stay; very long texts are read to their end, in time in proportion to their lines; other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import row_key, written

SHORT_WORDS, SHORT_DOCUMENTS, LEADING, SIMILARITY = 5, 10, 4, 0.8
BROADCAST_BYTES, BESIDE = 64 << 20, 8


def _masked(line: Column) -> Column:
    """Words of a line, those with a digit as <*>."""
    bare = F.trim(F.regexp_replace(line, r"[\t-\r]", " "))
    return F.array_remove(F.split(F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, r"[^\s]*[0-9][^\s]*", "<*>")).otherwise(bare), " +"), "")


def _lines(docs: DataFrame) -> DataFrame:
    """key, at, n (words), leaf and h of every line that has words."""
    line = docs.select("key", F.posexplode(F.split("t", "\n")).alias("at", "line")).where(F.length("line") > 0)
    line = line.select("key", "at", _masked(F.col("line")).alias("words")).where(F.size("words") > 0)
    return line.select("key", "at", F.size("words").alias("n"), F.xxhash64(F.size("words"), F.slice("words", 1, LEADING)).alias("leaf"), F.xxhash64("words").alias("h"))


def _agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _next_templates(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaf, h, rep of the lines that each leaf's commonest line takes in, and the lines still to be compared."""
    tops = left.groupBy("leaf").agg(F.min("order").alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("leaf", "top")
    models = left.join(tops, "leaf").where("order = top").select("leaf", F.col("h").alias("rep"), F.col("words").alias("model"))
    near = _agreement(F.col("words"), F.col("model")) >= SIMILARITY * F.size("words")
    tested = written(left.join(models, "leaf").where("h <> rep").withColumn("near", near).drop("model"), "lines-tested")
    return tested.where("near").select("leaf", "h", "rep"), tested.where("not near").drop("near", "rep")


def _segments(words: Column) -> Column:
    """Hashes of one segment more, after the leading words, than two lines that agree enough can differ in places."""
    n, body = F.floor(F.size(words) * (1 - SIMILARITY) + 1e-6) + 1, F.size(words) - LEADING
    cut = lambda i: F.floor(body * i / n).cast("int")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.xxhash64(i, F.slice(words, cut(i) + LEADING + 1, cut(i + 1) - cut(i))))


def _near(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """Those of pairs (leaf, h, rep, ...) that agree enough; left has the words of each line."""
    both = pairs.join(left.select("leaf", "h", "words"), ["leaf", "h"]).join(left.select("leaf", F.col("h").alias("rep"), F.col("words").alias("model")), ["leaf", "rep"])
    return both.where(_agreement(F.col("words"), F.col("model")) >= SIMILARITY * F.size("words")).drop("words", "model")


def _templates_of(pairs: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaf, h of lines proven to be templates, and of all that are settled. pairs: leaf, h and the rep, a commoner line
    not yet settled, that agrees with it; whole: the lines that have met all commoner ones."""
    found, settled = [], []
    while True:  # a line with no commoner one beside it is a template, those it takes in are none
        lead = written(whole.join(pairs, ["leaf", "h"], "left_anti").select("leaf", "h"), "lines-lead")
        if lead.isEmpty():
            break
        gone = written(pairs.join(lead.withColumnRenamed("h", "rep"), ["leaf", "rep"]).select("leaf", "h").distinct(), "lines-gone")
        found.append(lead)
        settled += [lead, gone]
        whole = written(whole.join(lead.unionByName(gone), ["leaf", "h"], "left_anti"), "lines-open")
        pairs = written(pairs.join(gone, ["leaf", "h"], "left_anti").join(gone.withColumnRenamed("h", "rep"), ["leaf", "rep"], "left_anti"), "lines-todo")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, settled)


def _remaining_templates(left: DataFrame) -> DataFrame:
    """leaf, h, rep as by taking each leaf's commonest line again and again.

    Each round, a line meets the commonest lines that share a segment with it, BESIDE of each segment at first and twice
    as many each time, so that families of like lines meet their template and not one another."""
    every = written(left.select("leaf", "h", "order", F.explode(_segments(F.col("words"))).alias("segment")), "lines-segments")
    of, templates, beside = every, [], BESIDE
    while not of.isEmpty():
        ranked = of.withColumn("rank", F.row_number().over(Window.partitionBy("leaf", "segment").orderBy("order")))
        ranked = written(ranked, "lines-ranked")
        commonest = ranked.where(F.col("rank") <= beside).select("leaf", "segment", F.col("h").alias("rep"), F.col("order").alias("rep_order"))
        met = ranked.join(commonest, ["leaf", "segment"]).where("rep_order < order").select("leaf", "h", "rep").distinct()
        whole = written(ranked.groupBy("leaf", "h").agg(F.max("rank").alias("last")).where(F.col("last") <= beside).select("leaf", "h"), "lines-whole")
        new, settled = _templates_of(written(_near(met, left), "lines-pairs"), whole)
        templates.append(new)
        of = written(of.join(settled, ["leaf", "h"], "left_anti"), "lines-segments")
        beside *= 2
    if not templates:
        return left.select("leaf", "h", F.col("h").alias("rep")).limit(0)
    models = every.join(reduce(DataFrame.unionByName, templates), ["leaf", "h"]).select("leaf", "segment", F.col("h").alias("rep"), F.col("order").alias("rep_order"))
    met = every.join(models, ["leaf", "segment"]).where("rep_order < order").select("leaf", "h", "rep", "rep_order").distinct()
    return _near(met, left).groupBy("leaf", "h").agg(F.min_by("rep", "rep_order").alias("rep"))


def _placed(in_leaf: DataFrame) -> DataFrame:
    """leaf, h, rep of every line that a template takes in; in_leaf: leaf, h, words, order."""
    found, left = [], in_leaf
    while True:
        hits, left = _next_templates(left)
        n_hits, n_left = hits.count(), left.count()
        found.append(hits)
        if not n_left:
            break
        if 8 * n_hits < n_left:  # few lines a template: all leaves' templates at once
            found.append(written(_remaining_templates(left), "lines-placed"))
            break
    return reduce(DataFrame.unionByName, found)


def _beside(whole: DataFrame, few: DataFrame, n_bytes: int, how: str = "inner") -> DataFrame:
    """Documents joined to a table with at most one row for each; it is broadcast if its measured size allows it."""
    return whole.join(F.broadcast(few) if n_bytes <= BROADCAST_BYTES else few, "key", how)


def dropped_lines(documents: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """key and drop: the places (from 0, ascending) of the lines that go, for each document that loses any; and its size."""
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    docs = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("t"))
    lines = written(_lines(docs), "lines")
    stats = lines.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n").alias("n"), F.min(F.struct("key", "at")).alias("first"), F.max("key").alias("key_b"))
    stats = written(stats.withColumn("key_a", F.col("first.key")), "lines-stats")
    order = F.struct((-F.col("n_lines")).alias("n"), "first", "h").alias("order")
    leaves = stats.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.min("key_a").alias("a"), F.max("key_b").alias("b")).where("kinds > 1 and a <> b").select("leaf")
    # the words of one line of each kind in such a leaf, read where it first stands
    wanted = stats.join(leaves, "leaf").groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("first.at", "leaf", "h", order)).alias("lines"))
    wanted = written(wanted, "lines-wanted")
    n_bytes = wanted.agg(F.sum(F.size("lines") * 80 + 40)).first()[0] or 0
    # a text is split once, and its lines taken out of it before they become rows
    once = F.array(F.struct(F.split("t", "\n").alias("all"), "lines"))
    taken = F.transform(once, lambda d: F.transform(d["lines"], lambda x: F.struct(x["leaf"].alias("leaf"), x["h"].alias("h"), x["order"].alias("order"), F.get(d["all"], x["at"]).alias("line"))))[0]
    texts = _beside(docs, wanted, n_bytes).dropDuplicates(["key"]).select(F.explode(taken).alias("x"))
    in_leaf = written(texts.select("x.leaf", "x.h", "x.order", _masked(F.col("x.line")).alias("words")), "lines-in-leaves")
    known = stats.join(_placed(in_leaf), ["leaf", "h"], "left").withColumn("template", F.coalesce("rep", "h"))
    merged = known.groupBy("leaf", "template").agg(F.max("n").alias("n"), F.min("key_a").alias("a"), F.max("key_b").alias("b")).where("a <> b")
    short = lines.where(F.col("n") < SHORT_WORDS).select("leaf", "h", "key").distinct().groupBy("leaf", F.col("h").alias("template")).agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= SHORT_DOCUMENTS)
    recurring = merged.where(F.col("n") >= SHORT_WORDS).unionByName(merged.where(F.col("n") < SHORT_WORDS).join(short.drop("found"), ["leaf", "template"], "left_semi"))
    verdicts = written(known.select("leaf", "h", "template").join(recurring.select("leaf", "template", F.col("a").alias("keeper")), ["leaf", "template"]).select("leaf", "h", "keeper"), "lines-recurring")
    gone = lines.select("key", "at", "leaf", "h").join(verdicts, ["leaf", "h"]).where("key <> keeper")
    gone = written(gone.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("drop")), "lines-dropped")
    return gone, gone.agg(F.sum(F.size("drop") * 4 + 40)).first()[0] or 0


def _kept(text: Column, drop: Column) -> Column:
    """text without the lines in drop (ascending): the stretches between them, joined."""

    def stretches(x: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(x["drop"], lambda at: at + 1))
        ends = F.concat(x["drop"], F.array(F.size(x["all"])))
        return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(x["all"], b + 1, e - b)))

    once = F.array(F.struct(F.split(text, "\n").alias("all"), drop.alias("drop")))  # bound to a variable, so that it is split once
    return F.array_join(F.transform(once, stretches)[0], "\n")


def line_dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", counts: bool = False) -> DataFrame:
    """documents with the recurring lines gone from text (and n_chars, if there is such a column, counted anew);
    with counts, also lines_total and lines_dropped."""
    gone, n_bytes = dropped_lines(documents, doc_id, text)
    key = F.when(F.col(doc_id).isNotNull() & F.col(text).isNotNull(), row_key(F.col(doc_id), F.col(text)))
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), key.alias("key"))
    both = _beside(whole, gone, n_bytes, "left")
    old = F.col("row")[text]
    new = F.when(F.col("drop").isNull(), old).otherwise(_kept(old, F.col("drop")))
    columns = [new.alias(c) if c == text else F.length(new).cast(documents.schema[c].dataType).alias(c) if c == n_chars else F.col("row")[c].alias(c) for c in documents.columns]
    extra = [F.coalesce(F.size(F.split(old, "\n")), F.lit(0)).cast("long").alias("lines_total"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("lines_dropped")] if counts else []
    return both.select(*columns, *extra)
