"""Operators where a cut once stood: the whole input counts."""

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from lodegraph.llm import packing, telephony, toxicity
from lodegraph.llm.common import filesystem
from lodegraph.llm.line_dedup import line_dedup


def toxic_table(spark, rows, parts):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(parts)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if y is not None], "doc_id long, toxic int")
    return {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(d, labels).collect()}


def grams_of(word, order):
    """A word's grams in letters, "\0" for its beginning and end."""
    s = "\0" + word + "\0"
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def class_models(texts, part, order):
    """Log-likelihoods of a word's letters by class (labels of both folds), counted in plain dicts."""
    n = {}
    for t, p in zip(texts, part):
        for w in t.split():
            for pair in ([w] if w[0] < "一" else [w[i : i + 2] for i in range(max(1, len(w) - 1))]):
                for g in grams_of(pair, order):
                    n.setdefault(g, np.zeros(5))[0] += 1
                    if p == p:
                        n[g][1 + int(p)] += 1
    tails = [g[-2:] for g in n]

    def spread(g, of, back):
        beside = [of(v) for k, v in n.items() if k[:-1] == g[:-1]]
        total = sum(beside)
        return (max(of(n[g]) - 0.75, 0) + 0.75 * sum(x > 0 for x in beside) * back) / total if total else back

    def letter(g, label):
        tail = g[-2:]
        shared = spread(g, lambda v: v[0], (tails.count(tail) + 0.5) / (sum(t[0] == tail[0] for t in tails) + 128))
        return spread(g, (lambda v: v[2] + v[4]) if label else (lambda v: v[1] + v[3]), shared)

    return n, letter


TEXTS = ["the cat sat on the mat " + "x" * 40 + "a", "that cat ran " + "x" * 40 + "b naïve", "漢字仮名 the", "cat"]
PARTS = [0.0, 1.0, 3.0, np.nan]


def test_toxicity_evidence_by_brute_force(spark):
    texts = spark.createDataFrame(list(zip(TEXTS, [None if p != p else int(p) for p in PARTS])), "text string, part int").repartition(3)
    for order in (3, 6):
        look = toxicity.Lookup(*toxicity._sharded(toxicity.evidence(toxicity.counted(texts, order))), "final")
        n, letter = class_models(TEXTS, PARTS, order)
        for w in ["the", "cat", "that", "naïve", "漢字", "字仮", "x" * 40 + "b", "mat"]:
            buf = np.array([ord(c) for c in w], np.uint32)
            words, begin, _ = toxicity._distinct(buf, np.array([0]), np.array([len(buf)]))
            got = look(toxicity._grams(words, begin, order)[0]).sum() / toxicity.UNIT
            slow = sum(np.log(letter(g, 1)) - np.log(letter(g, 0)) for g in grams_of(w, order))
            assert abs(got - slow) < 1e-6, (order, w)


def test_kneser_ney_sums_to_one():
    n, letter = class_models(TEXTS, PARTS, 4)
    for context in {g[:-1] for g in n}:
        for label in (0, 1):
            assert sum(letter(g, label) for g in n if g[:-1] == context) <= 1 + 1e-9


def test_toxicity_grams_do_not_depend_on_how_texts_are_held(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["dog", "doge", "İstanbul", "naïve", "x" * 3000, "漢字仮名", "a'b", "…", "9z"], 30)) for _ in range(40)]
    pdf = pd.DataFrame({"text": [*texts, None, "", " .,"], "part": [float(i % 5) if i % 5 < 4 else np.nan for i in range(43)]})

    def total():
        out = pd.concat(toxicity._gather(6)(iter([pdf])))
        return out.groupby(["gram", "context", "pair"]).sum().sort_index()

    whole = total()
    monkeypatch.setattr(toxicity, "CHUNK", 500)
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 100)
    pd.testing.assert_frame_equal(whole, total())


def test_toxicity_reads_words_to_their_end_and_is_the_same_in_any_partitions(spark):
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abdeglmnoprst"), 5)) for _ in range(200)]
    rows = []
    for i in range(400):
        y = int(i % 4 == 0)
        rows.append((" ".join(rng.choice(stems, 20)) + " internationalisation" + ("zq" if y else "kv") + " " + " ".join(rng.choice(stems, 20)), y))
    one, other = toxic_table(spark, rows, 1), toxic_table(spark, rows, 7)
    assert one == other
    assert sum(one[i][1] == y for i, (_, y) in enumerate(rows)) > 0.98 * len(rows)


def test_line_dedup_has_several_templates_a_leaf(spark):
    """Against the step taken line by line: leaves of many unlike families, each line once or twice."""
    rng = np.random.default_rng(5)
    letters, texts = list("abcdefghij"), []
    for n in (5, 6, 10, 23):
        for _ in range(12):
            base = rng.choice(letters, n).tolist()
            for _ in range(6):
                at = rng.integers(0, n, max(1, n // 6))
                line = [str(rng.choice(letters)) if i in at else w for i, w in enumerate(base)]
                texts.append(" ".join(["w", "x", "y", "z", *line[4:]]))
    docs = [(i, t) for i, t in enumerate(rng.permutation(texts).tolist())]
    first, n = {}, {}
    for i, t in docs:
        first.setdefault(t, i)
        n[t] = n.get(t, 0) + 1
    templates, of = [], {}
    for t in sorted(n, key=lambda t: (-n[t], first[t])):
        words = t.split(" ")
        alike = [m for m in templates if len(m) == len(words) and sum(a == b for a, b in zip(m, words, strict=True)) >= 0.8 * len(words)]
        if not alike:
            templates.append(words)
        of[t] = tuple(alike[0] if alike else words)
    assert max(sum(len(m) == k for m in templates) for k in (6, 10, 23)) > 8
    kept, want = set(), {}
    for i, t in docs:
        want[i] = "" if of[t] in kept else t
        kept.add(of[t])
    got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_packing_looks_ahead_to_the_last_piece():
    assert packing.opening_size(300, [300] * 100, packing.CAPACITIES) == 4096
    assert sum(packing.best_fit([300] * 20_000)[2]) == 6_301_696


def test_telephony_gives_its_files(spark):
    texts = ["hello", None, "", "é😀" * 40, "y" * 10_000]
    rows = telephony.telephony(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        media = telephony.store((texts[r.doc_id] or "").encode())
        assert bytes(r.media) == media and bytes(r.pcm) == telephony.pcm_wav(media)
        form, rate, pcm = telephony.unwav(bytes(r.pcm))
        assert (form, rate) == (telephony.PCM, telephony.RESAMPLED)
        assert f"pcm16k={np.abs(np.frombuffer(pcm, '<i2').astype(int)).sum() // (len(pcm) // 2)};" in r.feature


def slow_features(payload):
    """The feature string, one sample at a time."""

    def mu(code):
        code = ~code & 0xFF
        size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return -size if code & 128 else size

    def a(code):
        code ^= 0x55
        part, low = code >> 4 & 7, (code & 15) << 4
        size = low + 8 if part == 0 else low + 264 << part - 1
        return size if code & 128 else -size

    pcm = [mu(c) for c in payload]
    wide = []
    for k, x in enumerate(pcm):
        wide += [x, (x + (pcm[k + 1] if k + 1 < len(pcm) else x)) >> 1]
    peaks, total, count = [], 0, 0
    for at in range(0, len(payload), 64):
        block = payload[at : at + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = telephony.STEPS[index]
                size = step * (2 * (nibble & 7) + 1) >> 3
                value = max(-32768, min(32767, value - size if nibble & 8 else value + size))
                index = max(0, min(88, index + telephony.MOVES[nibble & 7]))
                out.append(value)
        peaks.append(max(map(abs, out)))
        total, count = total + sum(map(abs, out)), count + len(out)
    n = len(payload)
    changes = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:]))
    return f"mulaw={sum(map(abs, pcm)) // n};changes={changes};alaw={sum(abs(a(c)) for c in payload) // n};pcm16k={sum(map(abs, wide)) // len(wide)};adpcm_peak={max(peaks)};adpcm={total // count}"


def test_telephony_features_by_brute_force():
    rng = np.random.default_rng(12)
    payloads = [bytes(64), "plain text, é😀 ".encode() * 64, *[rng.integers(0, 256, 64 * int(k), dtype=np.uint8).tobytes() for k in rng.integers(1, 90, 12)]]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    assert telephony.features(payloads) == [slow_features(p) for p in payloads] == [telephony.features([p])[0] for p in payloads]
    pcm = np.array([0, 3, -32768, 32767, 5], np.int16)
    assert telephony.resample(pcm).tolist() == [0, 1, 3, -16383, -32768, -1, 32767, 16386, 5, 5]


def test_telephony_of_repeated_rows_and_clashing_names(spark):
    rows = [(None, "same", b"m", "p"), (None, "same", b"x", "q"), (1, "same", None, None), (2, None, None, None)]
    out = telephony.telephony(spark.createDataFrame(rows, "doc_id long, text string, media binary, pcm string")).collect()
    assert len(out) == 4 and len({r.media_sha256 for r in out if r.doc_id != 2}) == 1
    assert sorted((r.doc_id is None, r.n_bytes) for r in out) == [(False, 0), (False, 4), (True, 4), (True, 4)]


def slow_best_fit(lengths, capacities):
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms, where, used = [], {}, []
    for k, i in enumerate(order):
        n = lengths[i]
        fits = [(room, b) for b, room in enumerate(rooms) if room >= n]
        if fits:
            b = min(fits)[1]
        else:
            costs = []
            for size in capacities:
                if size >= n:
                    room = size - n
                    for m in (lengths[j] for j in order[k + 1 :]):  # longest first
                        if m <= room:
                            room -= m
                    costs.append((room / size, size))
            b = len(rooms)
            rooms.append(min(costs)[1])
            used.append(0)
        where[i] = (b, used[b])
        rooms[b] -= n
        used[b] += n
    return [where[i][0] for i in range(len(lengths))], [where[i][1] for i in range(len(lengths))], [min(c for c in capacities if c >= u) for u in used]


def test_best_fit_by_brute_force():
    rng = np.random.default_rng(8)
    for n, top in ((1, 64), (60, 64), (200, 30), (300, 64), (80, 9)):
        lengths = rng.integers(1, top + 1, n).tolist()
        assert packing.best_fit(lengths, (16, 32, 64)) == slow_best_fit(lengths, (16, 32, 64))


def test_bins_hold_the_token_ids(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "naïve", "42"], int(rng.integers(0, 60))))) for i in range(50)] + [(50, None), (51, "word " * 200), (3, "twice"), (None, "none")]
    d = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, bin_id int")
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    out = packing.bins(d, path, capacities=(32, 64)).collect()
    assert sorted(x for r in out for x in r.ids) == sorted(x for ids in want for x in ids)
    assert all(r.n_tokens == len(r.ids) <= r.bin_length and (r.bin_length == 32 or r.n_tokens > 32) for r in out)
    short = {tuple(ids) for ids in want if len(ids) <= 64}
    held = "|".join(",".join(map(str, r.ids)) for r in out)
    assert all(",".join(map(str, ids)) in held for ids in short)
    counted = packing.pack(d, tokenizer=path, capacities=(32, 64)).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in counted} == {i: sum(len(w) for (j, _), w in zip(rows, want) if j == i) for i, _ in rows}


def test_line_dedup_of_a_very_long_text(spark):
    from pyspark.sql import functions as F

    n = 20_000
    line = lambda i: F.concat(F.lit("alpha beta gamma delta epsilon "), F.translate(F.hex(i), "0123456789", "ghijklmnop"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(line(i), F.lit("\nkeep "), F.col("id").cast("string"))), "\n")
    d = spark.range(2).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = {r.doc_id: (r.n, r.lines_dropped) for r in line_dedup(d, counts=True).select("doc_id", F.size(F.split("text", "\n")).alias("n"), "lines_dropped").collect()}
    assert got == {0: (2 * n, 0), 1: (n, n)}


def test_a_lost_shard_of_evidence_raises(spark):
    texts = spark.createDataFrame([("the cat", 0), ("the dog", 1), ("a bird", None)], "text string, part int")
    made = toxicity._sharded(toxicity.evidence(toxicity.counted(texts, 3)))
    look = toxicity.Lookup(*made, "final")
    gram = np.array([1, 2, 3])
    look(gram)
    name = f"{made[0]}/0.evidence"
    _, file = filesystem(name)
    toxicity.Lookup.opened.clear()
    Path(file).write_bytes(Path(file).read_bytes()[:-8])
    with pytest.raises(OSError):
        look(gram)
    Path(file).unlink()
    with pytest.raises(OSError):
        look(gram)


def test_fit_rows_bounds_rows_and_not_marks(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda x, y, ridge=1.0: fitted.append(len(x)) or np.zeros(x.shape[1] + 1))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 3][:8]
    docs = spark.createDataFrame([(i, f"word{i} {k}") for i in ids for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    toxicity.scorer(docs, labels, fit_rows=6)
    assert fitted == [6]
