"""SimHash, components, decontamination and line dedup against brute force, on small and odd inputs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodegraph.llm.components import components
from lodegraph.llm.decontaminate import decontaminate, without_contaminated
from lodegraph.llm.line_dedup import line_dedup
from lodegraph.llm.simhash import SEGMENTS, _chain_mask, fingerprint, links, near_duplicates, segments_for, without_near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, drop string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7, "d") for i, t in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_print(text):
    ws = re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    ws = [w for w in ws if w]
    grams = [" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", None, " \t\n", "one", "One two", "É a b c", "a\x0bb\x1cc d", *[" ".join(rng.choices("ab cd ef gh Ij é".split(), k=n)) for n in (3, 50, 400, 1500)]]:
        assert fingerprint(text) % (1 << 64) == slow_print(text)


def test_chains_reach_every_near_pair():
    rng = random.Random(2)
    length = 2
    for _ in range(2000):
        x = rng.getrandbits(64)
        flips = rng.sample(range(64), rng.randint(0, 2))
        d = sum(1 << f for f in flips)
        masks = [[_chain_mask(i, n, SEGMENTS) % (1 << 64) for n in range(1, SEGMENTS + 1)] for i in range(SEGMENTS)]
        assert any(all(bin(d & chain[n - 1]).count("1") <= n * 2 // SEGMENTS for n in range(1, SEGMENTS + 1)) for chain in masks), x
    assert length == max(n for n in range(1, SEGMENTS + 1) if n * 2 // SEGMENTS == 0)


def test_more_segments_for_more_fingerprints():
    assert [segments_for(10**k) for k in (0, 6, 8, 9, 10, 12)] == [5, 5, 5, 9, 31, 31]
    assert all(64 * ((n - 1) // 2) // n >= 25 for n in range(5, 33, 2))


@pytest.mark.parametrize(("bucket", "n"), [(0, 5), (3, 5), (1000, 5), (1000, 7), (5, 19)])
def test_links_by_brute_force(spark, bucket, n):
    rng = random.Random(3)
    prints = {0, (1 << 63) | 5}
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        prints |= {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(25)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 2]
    got = links(spark.createDataFrame([(p,) for p in signed], "fp long"), n=n, bucket=bucket).collect()
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2 for r in got)
    assert union_find(signed, [(r.a, r.b) for r in got]) == union_find(signed, near)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (101, 102), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {n: c for n, c in want.items() if n != 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies():
    rng = random.Random(4)
    base = " ".join(rng.choices([f"w{i}" for i in range(300)], k=600))
    rows = [(10, base), (11, base + " tail"), (12, base), (3, "other text of its own"), (4, None), (5, ""), (6, " \n"), (None, base), (12, base), (13, base.replace("w1 ", "w2 ", 1))]
    return rows


def test_near_duplicates_by_brute_force(spark):
    rows = near_copies()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in near_duplicates(docs(spark, rows)).collect())
    prints = [slow_print(t) for _, t in rows]
    comp = union_find(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {c: min((rows[i][0] for i in comp if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp.values())}
    assert got == sorted((i is None, i or 0, f"{prints[n]:016x}", least[comp[n]]) for n, (i, _) in enumerate(rows))
    kept = without_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert near_duplicates(docs(spark, [])).count() == 0 and without_near_duplicates(docs(spark, [])).count() == 0


def slow_contamination(rows, items):
    out = []
    for i, text in rows:
        ws, hit, found = words_of(text), set(), set()
        for item, passage in items:
            iw = words_of(passage)
            n = min(len(iw), 13)
            for window in {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else ():
                for at in range(len(ws) - n + 1):
                    if tuple(ws[at : at + n]) == window:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((i is None, i or 0, len(ws), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_decontamination_by_brute_force(spark, broadcast_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "x1", "été"]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, some(20)), (2, some(13)), (10, "a b"), (11, "B, é!"), (12, ""), (13, None), (14, some(30)), (15, "zz"), (16, some(14)), (None, "a b")]
    items.append((17, items[0][1]))
    rows = [(i, some(60)) for i in range(8)] + [(20, f"Start, {items[0][1].upper()}. end"), (21, items[6][1] + " " + items[6][1]), (22, None), (23, ""), (24, "!!"), (None, items[1][1]), (25, "zz ZZ"), (25, "zz ZZ"), (26, some(3000) + " " + items[8][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    got = decontaminate(docs(spark, rows), bench, broadcast_bytes=broadcast_bytes).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in got) == slow_contamination(rows, [x for x in items if x[0] is not None])


def test_a_window_that_many_items_share(spark):
    text = " ".join(f"w{i}" for i in range(13))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs(spark, [(1, f"a {text} b"), (2, f"{text} {text}"), (3, "clean")]), items).collect()}
    assert got == {1: (13, 10_000, True), 2: (26, 10_000, True), 3: (0, 0, False)}


def test_decontamination_without_items_or_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in decontaminate(docs(spark, [(1, "a b c")]), bench).collect()] == [(0, False)]
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(docs(spark, []), some).count() == 0
    kept = without_contaminated(docs(spark, [(1, "a b c"), (2, "x"), (None, "a b c")]), some)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == docs(spark, []).columns


LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def test_line_dedup(spark):
    rows = [
        (1, f"own line one of the first doc\n{LONG}\nshort"), (2, f"{LONG}\nshort\nown line two of the second"), (3, f"lead in words here are five\n{LONG.replace('wordaa', 'changed', 1)[:-6] + 'wordzz'}"),
        (4, "value 17 was set at 12:30 by bot"), (5, "value 99 was set at 08:01 by bot\nvalue 5 was set at 01:01 by bot"), (6, None), (7, ""), (None, LONG), (2, f"{LONG}\nshort\nown line two of the second"), (8, "same again and again here\nsame again and again here"),
    ]
    out = line_dedup(docs(spark, rows), counts=True)
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    want = {1: rows[0][1], 2: "short\nown line two of the second", 3: rows[2][1], 4: rows[3][1], 5: "", 6: None, 7: "", 8: rows[9][1], None: LONG}
    assert got == {(i, t, len(t) if t is not None else None) for i, t in want.items()}
    assert out.count() == len(rows) and out.columns[: len(DOCS.split(","))] == docs(spark, []).columns
    assert line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_generalises_by_similarity(spark):
    head = LONG.split(" ")
    near = " ".join([*head[:10], "other", *head[11:]])
    far = " ".join([*head[:4], *[w + "x" for w in head[4:]]])
    out = {r.doc_id: r.text for r in line_dedup(docs(spark, [(1, LONG), (2, near), (3, far)])).collect()}
    assert out == {1: LONG, 2: "", 3: far}


def test_copies_keep_one_text(spark):
    rows = [(i, LONG + "\nmore words that are on a second line") for i in range(1, 40)]
    out = line_dedup(docs(spark, rows)).where(F.col("text") != "").collect()
    assert [r.doc_id for r in out] == [1]


def test_stages_take_documents_with_names_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "a", "b", "c", "d"), (2, "clean text of its own", "a", "b", "c", "d"), (3, None, None, None, None, None), (2, "clean text of its own", "e", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _key string, _kept string, `row` string")
    items = spark.createDataFrame([(7, long)], "item_id long, text string")
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id, r._gone or "") for r in left.collect()) == [(2, "a"), (2, "e"), (3, "")]
    assert without_near_duplicates(docs).columns == docs.columns and without_near_duplicates(docs).count() == 3
