"""Jaccard join, substring dedup and decontamination against plain Python, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_pipeline import ASCII_LOWER, WORDS, brute_components, shingles
from tidemark.llm import factors, jaccard
from tidemark.llm._words import ALNUM_WORDS, SPACE_WORDS, chunks
from tidemark.llm.contamination import decontaminate
from tidemark.llm.factors import Reference, Words, dedup_substrings
from tidemark.llm.jaccard import Bands, drop_near_duplicates, jaccard_components, postings, signature
from tidemark.llm.queries import op7_jaccard_join, op8_lz_substrings, op9_decontamination

ODD = [None, "", " ", "\n\t", "one", "one two", "One TWO", "é É", "a\x0bb\x1cc", "x" * 3000, "w " * 2000]


def test_words_of_chunks():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é\n\tZ9.-") for _ in range(rng.randrange(40))) for _ in range(300)]
    for table, pattern in ((SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, hashes = [], {}
        for c in chunks(pa.array(texts, pa.string()), table, lower=True):
            data = c.data.tobytes()
            for i in range(len(c.bounds) - 1):
                a, b = c.bounds[i], c.bounds[i + 1]
                got.append([data[s:e].decode() for s, e in zip(c.starts[a:b], c.ends[a:b], strict=True)])
                for w, h in zip(got[-1], c.hashes[a:b].tolist(), strict=True):
                    assert hashes.setdefault(w, h) == h
        assert got == [re.findall(pattern, (t or "").translate(ASCII_LOWER)) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"new{rng.randrange(999)}"
        elif kind == 1:
            out.insert(i, f"add{rng.randrange(999)}")
        elif len(out) > 3:
            del out[i]
    return out


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1024), (5, 80, 8), (1, 50, 16)])
def test_jaccard_components(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(k)
    texts = list(ODD)
    for size in (3, 6, 9, 10, 11, 20, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(4000)}" for _ in range(size)]
            texts += [" ".join(near(rng, base, rng.randrange(0, 1 + size // 6))) for _ in range(8)] + [" ".join(base)] * 2
    texts += [f"{' '.join(f'p{j}' for j in range(40))} {' '.join(f'u{i}_{j}' for j in range(60))}" for i in range(40)]  # a shared passage
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    expected = brute_components({i: shingles(t, k) for i, t, _ in rows}, percent)
    got = {r["tm_id"]: r for r in jaccard_components(docs, k=k, percent=percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingles(t, k)) for i, t, _ in rows}
    kept = drop_near_duplicates(docs, k=k, percent=percent)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in expected.items() if i == c}


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, "A B c D"), (3, None)], "doc_id long, text string")
    out = sorted(((r["tm_id"], r["component_id"]) for r in jaccard_components(docs).collect()), key=str)
    assert out == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 1), (3, 3)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_postings_and_signatures_keep_every_link():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        bands = Bands(percent)
        for size in (2, 4, 9, 10, 15, 40, 200, 900):
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                y = np.unique(np.concatenate((x[rng.random(len(x)) > rng.random() * 0.4], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 4), dtype=np.uint64))))
                if not len(y) or not bands.linked(x, y) or (len(x) == len(y) and (x == y).all()):
                    continue
                p, q = ({b: (h, e) for b, h, e in postings(s, bands)} for s in (x, y))
                b = bands.of(min(len(x), len(y)))[-1]  # where the two meet
                assert len(np.intersect1d(p[b][0], q[b][0])) >= max(1, bands.agree(b, len(x), p[b][1]), bands.agree(b, len(y), q[b][1]))
                bits = [signature(s) for s in (x, y)]
                assert list(jaccard.within_bound(np.array([len(x), len(y)]), bits, percent, None, None))


def test_unrelated_sets_share_no_tile():
    rng = np.random.default_rng(6)
    for percent, size in ((80, 250), (80, 310)):
        bands = Bands(percent)
        sets = [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(100)]
        assert any(missing > bands.parts(band)[1] for s in sets for band, _, missing in postings(s, bands))
        posted = np.concatenate([own for s in sets for _, own, _ in postings(s, bands)])
        assert len(np.unique(posted)) == len(posted)


def test_jaccard_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {d: shingles(t, 3) for d, t in docs.items()}
    expected = brute_components(sets, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7_jaccard_join(spark, sf).collect()} == {d: (len(s), expected[d]) for d, s in sets.items()}


def brute_substrings(rows, window):
    first = {}
    words = [WORDS.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if d is not None and (g not in first or d < first[g]):
                first[g] = d
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_factors(reference, stretch, seeds, window):
    """Greedy longest matches from each seed whose window is not whole in the factor before."""
    done, out = 0, []
    for at in seeds:
        if at + window <= done:
            continue
        best = (0, None)
        for source, words in reference:
            for place in range(len(words)):
                n = 0
                while at + n < len(stretch) and place + n < len(words) and stretch[at + n] == words[place + n]:
                    n += 1
                if n > best[0]:
                    best = (n, (source, place))
        if best[0] >= window:
            out.append((at, best[0], *best[1]))
            done = at + best[0]
    return out


def test_greedy_factors_of_a_block():
    rng = random.Random(3)
    for window in (2, 4, 13):
        for _ in range(20):
            word = lambda: rng.choice("abc" if window < 13 else "a")
            reference = [(i, [word() for _ in range(rng.randrange(0, 40))]) for i in range(6)]
            stretch = [word() for _ in range(rng.randrange(window, 50))]
            seeds = sorted(rng.sample(range(len(stretch) - window + 1), rng.randrange(1, len(stretch) - window + 2)))
            index = Reference([i for i, _ in reference], [" ".join(w) for _, w in reference], window)
            (c,) = chunks(pa.array([rng.choice([" ", "\n "]).join(stretch)]), SPACE_WORDS)
            own = Words(c.data.tobytes(), c.starts, c.ends, c.hashes)
            assert list(index.factors(4, own, seeds, *index.places_of(c.grams(window)[seeds]))) == brute_factors([x for x in reference if x[0] < 4], stretch, seeds, window)


@pytest.mark.parametrize("block_bytes", [200, 4 << 20])
def test_substrings(spark, sf, monkeypatch, block_bytes):
    monkeypatch.setattr(factors, "BLOCK_BYTES", block_bytes)  # many blocks, each with shares of its own, or one
    monkeypatch.setattr(factors, "SHARE_BYTES", block_bytes)
    rng = random.Random(9)
    passages = [[f"p{i}_{j}" for j in range(rng.randrange(10, 40))] for i in range(6)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(150):
        w = [f"w{rng.randrange(30 if i % 3 else 5000)}" for _ in range(rng.randrange(0, 60))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(3) :]
        rows.append((rng.randrange(100, 400) if i % 10 else None, " ".join(w)))
    rows += rows[-5:] + [(900, rows[-7][1]), (50, rows[-7][1]), (950, " ".join(passages[0]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").withColumn("odd name-of: it", F.lit(1)).repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in dedup_substrings(docs).collect()), key=str)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute_substrings(rows, 13), strict=True)), key=str)
    texts = {(d, i): WORDS.findall(t or "") for i, (d, t) in enumerate(rows)}
    whole = docs.withColumn("raw", F.col("text"))
    for r in dedup_substrings(whole).where("n_removed > 0").collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == sum(f["length"] for f in r["factors"])
        own, end = WORDS.findall(r["raw"]), 0
        for f in r["factors"]:  # with the words between them they tile the text, and each is what its source holds there
            assert f["start"] >= end and f["length"] > 0 and f["source"] < r["doc_id"]
            end = f["start"] + f["length"]
            assert any(d == f["source"] and w[f["source_start"] : f["source_start"] + f["length"]] == own[f["start"] : end] for (d, _), w in texts.items())
        assert end <= len(own)
    assert dedup_substrings(docs.limit(0)).count() == 0

    if block_bytes < 1000:
        return
    own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, k, t) in zip(own, brute_substrings(own, 13), strict=True)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op8_lz_substrings(spark, sf).collect()} == expected


def test_windows_meet_in_buckets(spark):
    rng = random.Random(11)
    passage = " ".join(f"p{j}" for j in range(400))
    rows = [(f"d{i:03}", " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + (f" {passage}" if i % 10 == 3 else "")) for i in range(100)]
    docs = spark.createDataFrame(rows, "tm_id string, tm_raw string").selectExpr("*", "7 AS tm_key", "cast(substr(tm_id, 2) AS int) % 4 AS tm_block").coalesce(2)
    found = factors.shared_windows(docs, 13, factors.shared_anchors(docs, 13), 5)
    assert found.count() <= 10 and found.selectExpr("sum(size(prints))").first()[0] >= 3880  # arrays are shuffled, not windows
    met = factors.meetings(found).collect()
    assert {r["tm_id"] for r in met if r["marks"] is None} == {"d003"}
    marks = {}
    for r in met:
        marks.setdefault(r["tm_id"], set()).update(r["marks"] or ())
    assert marks == {d: {3 << 32 | p for p in range(60, 448)} if d > "d003" else set() for d, _ in rows if d.endswith("3")}
    hits = docs.where("tm_id LIKE '%3'").selectExpr("tm_id AS hit_id", "tm_key AS hit_key")
    left = {r["tm_id"] for r in factors.with_hits(docs, hits).collect()}
    assert left >= {d for d, _ in rows if d.endswith("3")} and len(left) < 20


def test_marks_of_a_text_come_together(spark):
    """One row for each text and each source, however many buckets a text's windows are in."""
    rng = random.Random(12)
    passage = " ".join(f"p{j}" for j in range(300))
    rows = [(f"d{i:03}", " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + (f" {passage}" if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame([*rows, rows[9]], "tm_id string, tm_raw string").selectExpr("*", "7 AS tm_key", "cast(substr(tm_id, 2) AS int) % 6 AS tm_block").repartition(3)
    bitmap = factors.shared_anchors(docs, 13)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few, many = (factors.shared_windows(docs, 13, bitmap, n) for n in (2, 40))
        expected = {(f"d{i:03}", 7, tuple(1 << 32 | p for p in range(30, 318))) for i in range(3, 80, 2)} | {("d001", None, None)}
        for found in (many, few):
            for homes in (1, 3):
                # windows that straddle the words before the passage have no source
                met = [(r["tm_id"], r["tm_key"], r["marks"] and tuple(r["marks"])) for r in factors.meetings(found, homes).collect()]
                assert len(met) == 40 and set(met) == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_contamination(texts, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    index = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            index.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in index}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in index:
                    hit.update(range(i, i + k))
                    found |= {str(x) for x in index[g] if x is not None}
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize(("block_words", "segment"), [(500_000, 20_000), (120, 7)])
def test_decontamination(spark, block_words, segment):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "ab", "É", "x9", "q", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(30)] + [(5, "the of the"), (None, "é É 7 7 7"), (77, None), (78, "..."), (79, "unique words here only")]
    texts = list(ODD) + [" ".join(word() for _ in range(rng.randrange(0, 50))) for _ in range(60)]
    for _, t in items:
        texts.append(f"{word()} {(t or '').upper()}-{word()}")
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string").withColumn("odd name-of: it", F.struct(F.lit(1).alias("a b")))
    out = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, segment=segment)
    got = sorted((str(r["text"]), *(r[c] for c in COLUMNS)) for r in out.collect())
    assert got == sorted((str(t), *x) for t, x in zip(texts, brute_contamination(texts, items, 10), strict=True))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), none).count() == 0


def test_decontamination_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = dict(zip([d for d, _ in docs], brute_contamination([t for _, t in docs], items, 10), strict=True))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op9_decontamination(spark, sf).collect()} == expected
    assert any(x[4] for x in expected.values())
