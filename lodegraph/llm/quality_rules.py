"""Quality rules as a ledger of bits, in DataFrame functions only.

ledger() evaluates every rule once a row: it holds the measurements and one bit a failed rule. Policies are versioned
masks over those bits, so that a policy is applied, changed or compared without reading a text again (apply), and
ablations() tells from sums over the distinct bit sets what each rule drops by itself and with others. A ledger is
stored by store() and read by any later job; bits keep their places, new rules take new ones.

Words found in a 5-word window that stands twice or more are counted from the window's 64-bit hashes, sorted beside
their places within the row's own array, so no row is shuffled and no text is multiplied; the sort is done only for rows
in which a hash is found twice. Chance equality of two windows of one text is below one in 10^7 for a million words.

Defined cases: a null or empty text has no words and fails few_words; a null id stays; rows repeated have a row each;
very long texts are read whole, their work grows by n log n; an empty table gives an empty ledger and no ablation
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE, WHITE_SPACE, A_WORD = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS, CAPITALS, WINDOW = r"[#*$%&|<>]", r"\p{Lu}", 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules by bit, as SQL over MEASURES; true means failed. A rule's place never changes.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "10 * n_capitals > 3 * word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A row is kept if it fails none of these rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, (*BASE.rules, "symbols", "capitals", "repeated_lines"))
STRICT = Policy("strict", 1, tuple(RULES))
POLICIES = (BASE, STANDARD, STRICT)


def _matches(text: Column, one_character: str) -> Column:
    return (F.size(F.split(text, one_character, -1)) - 1).cast("long")


def _repeated(windows: Column) -> Column:
    """How many words stand in windows whose hash is found twice or more; windows: array<long>."""

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.size(places)), F.slice(places, 1, F.size(places) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda n, gap: n + gap)

    def places(by_hash: Column) -> Column:
        same = lambda a, b: F.get(by_hash, a)["h"] == F.get(by_hash, b)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(by_hash) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda j: F.get(by_hash, j)["i"]))

    # each step is bound to a variable, so that it is worked out once and not for every element
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = F.transform(F.transform(F.array(by_hash), places), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0)).cast("long")


def measures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and MEASURES of each row."""
    t, none = F.col("t"), F.array().cast("array<string>")
    trimmed = F.btrim(t, F.lit(WHITE))
    base = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = base.select("doc_id", "t", F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_SPACE)).otherwise(none).alias("words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(A_WORD)).alias("lines"))
    words, lines = F.col("words"), F.col("lines")
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _matches(t, SYMBOLS).alias("n_symbols"), _matches(t, CAPITALS).alias("n_capitals"),
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    return counted.select("doc_id", *MEASURES[:-1], _repeated(F.col("windows")).alias("n_repeat_words"))


def ledger(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, MEASURES and failed: the bits of the rules that a row fails."""
    bits = [F.when(F.expr(sql), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, sql in enumerate((rules or RULES).values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measures(documents, doc_id, text).withColumn("failed", failed)


def store(book: DataFrame, path: str) -> DataFrame:
    """Writes a ledger and gives it back as read from there."""
    book.write.mode("overwrite").parquet(path)
    return book.sparkSession.read.schema(book.schema).parquet(path)


def apply(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger's rows with kept by a policy, and the bits that spoke against them."""
    against = F.col("failed").bitwiseAND(F.lit(policy.mask))
    return book.withColumns({"against": against, "kept": against == 0})


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: n_rows, n_failed (rows that fail the rule), n_only (rows that only this rule
    drops), n_kept, and n_kept_without, were the rule left out. The ledger is summed by its bit sets first, of which there
    are at most 2 to the number of rules, however many rows it has."""
    sets = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for p in policies for r in p.rules]
    met = sets.select("failed", "n", F.inline(F.array(*cases)))
    hit = lambda c: F.col("failed").bitwiseAND(F.col(c))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    return met.groupBy("policy", "version", "rule").agg(
        F.sum("n").cast("long").alias("n_rows"), total(hit("bit") != 0).alias("n_failed"),
        total(hit("mask") == F.col("bit")).alias("n_only"), total(hit("mask") == 0).alias("n_kept"),
        total((hit("mask") == 0) | (hit("mask") == F.col("bit"))).alias("n_kept_without"),
    )


def rules_seen(book: DataFrame, by: str) -> DataFrame:
    """For each value of a ledger's column: the bits that any of its rows fails and those that all of them fail."""
    return book.groupBy(by).agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.count(F.lit(1)).alias("n_rows"))


def quality_rules(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", policy: Policy = STANDARD) -> DataFrame:
    """The ledger of documents with base_failed and a policy's verdict; what base fails, no policy keeps."""
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return apply(ledger(documents, doc_id, text), policy).withColumn("base_failed", base_failed).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
