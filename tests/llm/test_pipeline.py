"""Every stage of the pipeline against plain Python on its own input."""

import re
from collections import Counter

import corpus_pipeline as P
from tidemark.llm.queries import tokenizer_path
from tests.llm.test_counts_and_packing import check_packing
from tests.llm.test_rules import plain

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark, sf, tmp_path):
    sf = sf.replace("0.001", "0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = []
    for i, (_, step) in enumerate(P.STAGES):
        out = step(spark, docs, sf)
        if i < len(P.STAGES) - 1:
            assert out.columns == P.COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(({r["doc_id"]: r["text"] for r in docs.collect()}, spark.read.parquet(str(tmp_path / str(i))).collect()))
        docs = spark.read.parquet(str(tmp_path / str(i)))

    before, after = seen[0]
    kept = {r["doc_id"] for r in after}
    for d, t in before.items():
        n, _, _, _, repeats = plain(t)
        assert d not in kept or (n >= 50 and 100 * repeats <= 50 * n)
    good = [d for d, q in labels.items() if q and len(WORDS.findall(before[d])) >= 50]
    assert len(kept.intersection(good)) >= 0.95 * len(good)
    assert len(kept.intersection(d for d, q in labels.items() if not q)) <= 0.2 * sum(not q for q in labels.values())
    assert all(r["text"] == before[r["doc_id"]] for r in after)

    before, after = seen[1]
    keys = {d: [x.strip(" \t\n\r\f\v").translate(ASCII_LOWER) for x in t.split("\n")] for d, t in before.items()}
    often = {k for k, n in Counter(k for v in keys.values() for k in set(v)).items() if n >= 10 and k}
    assert {r["doc_id"]: r["text"] for r in after} == {d: "\n".join(x for x, k in zip(t.split("\n"), keys[d], strict=True) if k not in often) for d, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen[2]
    sets = {d: shingles(t, 5) for d, t in before.items()}
    assert {r["doc_id"] for r in after} == {d for d, c in brute_components(sets, 80).items() if d == c}

    before, after = seen[3]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (t or "").translate(ASCII_LOWER))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {(n, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    sizes = {n for n, _ in windows}
    clean = {d for d, t in before.items() if not any((n, tuple(words(t)[i : i + n])) in windows for n in sizes for i in range(len(words(t)) - n + 1))}
    assert {r["doc_id"] for r in after} == clean and len(clean) < len(before)

    before, after = seen[4]
    used, bound = check_packing(after, before, tokenizer_path("byte_bpe_50k.json"))
    assert used <= 1.05 * bound + 1


def shingles(text, k):
    w = WORDS.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(sets, percent):
    of = {d: d for d in sets}
    ids = sorted(sets)

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    of[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def test_stages_on_odd_rows(spark, sf):
    long = " ".join(f"w{i}" for i in range(30_000))
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text + " end"), (None, text.replace("v7 ", "u7 ")), (3, None), (4, ""), (5, long), (6, "short")]
    docs = spark.createDataFrame([(d, t, None, None, 7, 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, tm_id string")
    for name, step in P.STAGES:
        out, none = step(spark, docs, sf), step(spark, docs.limit(0), sf)
        assert none.count() == 0, name
        assert out.count() > 0 and (name == "best-fit packing" or out.columns == P.COLUMNS), name
    kept = Counter(r["doc_id"] for r in P.near_duplicates(spark, docs, sf).collect())
    assert kept == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1}


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
