"""Quality rules, collocations and token alignment, held to plain loops."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import quality_rules as rules
from lodegraph.llm import sorted_counts
from lodegraph.llm.collocations import collocations, grams
from lodegraph.llm.common import filesystem
from lodegraph.llm.token_alignment import Aligner, token_alignment

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
random.seed(7)
WORDS = ["the", "of", "sea", "Ebb", "tide", "naïve", "漢字", "a#b", "x|y", "<p>", "🌊"]
LONG = " ".join(random.choice(WORDS) + str(i % 5000) for i in range(60_000))
TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "z " * 400, "a b c d a b c d", "same line\nsame line\n\n \nsame line", "x\x0by\x0cz\r\nq",
    "  nbsp stays  ", "SHOUT " * 12, "### $$$ %% && || <<>> ** ok", LONG, *[" ".join(random.choices(WORDS, k=random.randint(1, 120))) for _ in range(60)],
    *["\n".join(" ".join(random.choices(WORDS[:4], k=random.randint(0, 6))) for _ in range(12)) for _ in range(20)],
]


def table(spark, texts, langs=None):
    """Texts with ids, and columns named as the operators name their own."""
    rows = [(i, t, langs[i] if langs else "en", i, -1, "w", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, failed long, words string, n string").repartition(5)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    stand = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(stand)


def test_quality_rules_by_brute_force(spark):
    got = {r.doc_id: r for r in rules.quality_rules(table(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n_words, word_chars, n_symbols, n_dup, n_repeat = plain_measures(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup, n_repeat), (i, (t or "")[:60])
        assert r.base_failed == (n_words < 10 or 100 * n_repeat > 20 * n_words)
        assert r.kept == (r.failed & rules.STANDARD.mask == 0) and not (r.kept and r.base_failed)


def test_ledger_is_stored_and_policies_read_it(spark, tmp_path):
    book = rules.store(rules.ledger(table(spark, TEXTS)), str(tmp_path / "ledger"))
    failed = [r.failed for r in book.collect()]
    for policy in rules.POLICIES:
        kept = {r.doc_id for r in rules.apply(book, policy).where("kept").collect()}
        assert len(kept) == sum(f & policy.mask == 0 for f in failed)
    for r in rules.ablations(book).collect():
        policy = next(p for p in rules.POLICIES if p.name == r.policy)
        bit = 1 << list(rules.RULES).index(r.rule)
        assert r.n_rows == len(failed) and r.n_failed == sum(f & bit != 0 for f in failed)
        assert r.n_only == sum(f & policy.mask == bit for f in failed)
        assert r.n_kept == sum(f & policy.mask == 0 for f in failed) and r.n_kept_without == sum(f & policy.mask & ~bit == 0 for f in failed)
    seen = rules.rules_seen(book.withColumn("all", F.lit(1)), "all").first()
    assert seen.any_failed == np.bitwise_or.reduce(failed) and seen.all_failed == np.bitwise_and.reduce(failed)


def test_quality_rules_of_nothing(spark):
    empty = table(spark, TEXTS).where("doc_id < 0")
    assert rules.quality_rules(empty).collect() == [] and rules.ablations(rules.ledger(empty)).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_words, r.kept) for r in rules.quality_rules(nulls).collect()] == [(None, 0, False)] * 2


def test_quality_rules_stay_in_the_jvm(spark):
    plan = rules.quality_rules(table(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Python" not in plan and "Arrow" not in plan


def plain_collocations(texts, langs, min_count, top):
    f, total = Counter(), Counter()
    for t, lang in zip(texts, langs):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= min_count:
            cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    kept = {key: x for key, x in found.items() if not any(lang == key[0] and len(q) > len(key[1]) and y[1] >= x[1] and inside(key[1], q) for (lang, q), y in found.items())}
    out = set()
    for lang in total:
        mine = sorted(((-x[0], -x[1], " ".join(p).encode(), x) for (at, p), x in kept.items() if at == lang))
        out |= {(lang, i + 1, p.decode(), x[1], x[2], x[3], total[lang], x[0]) for i, (_, _, p, x) in enumerate(mine[:top])}
    return out


PHRASES = [None, "", "...", "A  b\tc. a b c d e f; A B", "deep sea deep sea, deep\x0bsea deep sea", "x" * 5000 + " y", "naïve one two Ärger ärger two"] + [
    " ".join(random.choices(["the", "deep", "Sea", "of", "green,", "tide", "漢字", "🌊", "end."], k=random.randint(1, 90))) for _ in range(120)
]


@pytest.mark.parametrize("least, top", [(2, 2000), (3, 7)])
def test_collocations_by_brute_force(spark, least, top):
    langs = [random.choice(["en", None, "zh", "und"]) for _ in PHRASES]
    got = collocations(table(spark, PHRASES, langs), min_count=least, top=top).collect()
    assert {tuple(r) for r in got} == plain_collocations(PHRASES, langs, least, top) and len(got) > 20


def test_collocations_of_nothing_and_of_few_words(spark):
    assert collocations(table(spark, [None, "", " \t", "..."])).collect() == []
    assert collocations(table(spark, ["a", "b"]), min_count=1).collect() == []
    assert [(r.phrase, r.a) for r in collocations(table(spark, ["a b", "a b", "c"]), min_count=2, longest=2).collect()] == [("a b", 2)]


def test_suffix_intervals_count_every_gram():
    for _ in range(20):
        seq = np.array([random.randint(0, 4) for _ in range(random.randint(1, 200))])
        for k, at, n in grams(seq, 1, 5):
            windows = [tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)]
            assert {tuple(seq[i : i + k]): c for i, c in zip(at.tolist(), n.tolist())} == {w: c for w, c in Counter(windows).items() if 0 not in w}


ALIGNED = [
    None, "", " ", "\n", "plain words here", "two  spaces", " leads", "trails ", "line\nline two\n\nlast\n", "tab\there\r\nthere", "naïve Ärger 漢字かな 🌊🌊 é", "<|endoftext|> <s> </s> <0x41> <unk>",
    "mark ▁ here", "a b", "nul\x00byte", "1234567 3.14 don't we'll", "ﬁ ligature", "plain words here", "ééé " * 30, "z" * 3000, LONG[:40_000],
]


def plain_alignment(texts):
    """Both libraries on whole texts, and byte ends compared one by one."""
    aligner, rows, times = Aligner(BPE, PIECES), [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = ([], []) if not t else (aligner.a.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t))
        if b"".join(aligner.a_bytes[i] for i in a) != raw or b"".join(aligner.b_bytes[i] for i in b) != raw:
            a, b = [], []
        ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
        x, y = ends(a, aligner.a_bytes), ends(b, aligner.b_bytes)
        links = [(a[i], b[y.index(e)]) for i, e in enumerate(x) if e in set(y)]
        groups, p, q = [], 0, 0
        for i, e in enumerate(x):
            if e in set(y):
                j = y.index(e)
                groups.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
                p, q = i + 1, j + 1
        rows.append((a, b, groups, links))
        times.update(links)
    most = {}
    for (_, b), n in times.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (len(a), len(b), len(g), len(pairs), sum(times[p] == most[p[1]] for p in pairs), sum(times[p] for p in pairs), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, pairs in rows
    ]


def test_alignment_by_brute_force(spark):
    got = {r.doc_id: r for r in token_alignment(table(spark, ALIGNED), BPE, PIECES, groups=True).collect()}
    for i, want in enumerate(plain_alignment(ALIGNED)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, ALIGNED[i][:60]
    assert sum(r.n_a > 0 for r in got.values()) > 12 and got[0].groups_sha256 == got[12].groups_sha256 == ""


def test_alignment_of_nothing(spark):
    assert token_alignment(table(spark, ALIGNED).where("doc_id < 0"), BPE, PIECES).collect() == []
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links) for r in token_alignment(nulls, BPE, PIECES).collect()) == [(None, 0), (None, 2)]


def test_sorted_counts_raise_for_lost_files(spark):
    made = sorted_counts.write(spark.range(5000).selectExpr("id % 700 - 300 as key", "1L as n"), "counts")
    got = made(np.array([-301, -300, 0, 399, 400]))
    assert got.tolist() == [0, 8, 7, 7, 0]
    name, rows, _, _ = made.files[0]
    sorted_counts.Counts.opened.clear()
    os.truncate(filesystem(name)[1], 16 * rows - 8)
    with pytest.raises(OSError):
        made(np.array([-300]))
    os.remove(filesystem(name)[1])
    with pytest.raises(OSError):
        made(np.array([-300]))
