"""Token counts and packing against the libraries run on whole texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.packing import best_fit, encoder, evolve, pack
from tidemark.llm.queries import op6_ga_packing, op10_token_counts, tokenizer_path
from tidemark.llm.token_cache import count_tokens, counter

ODD = ["", " ", "  ", "a ", " a", "a  b", "a\n b", "a \nb", "\n", "\t x\ty  ", "it's 12 o'clock!!", "<|endoftext|> x", "a<|endoftext|>b", "▁a▁ b", "<s> x </s>", "🙂 é  🙂", "x" * 3000, "a  b", "a  b", "\x1c a"]


def texts(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD


def test_counts_equal_whole_encoding(spark, sf):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    every, path = texts(spark, sf), tokenizer_path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    assert counter(path)(every) == [len(x) for x in model.encode(every)]
    path = tokenizer_path("word_bpe_49k.json")
    assert counter(path)(every[:20]) == [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(every[:20], add_special_tokens=False)]


def test_cache_encodes_only_misses(spark, tmp_path):
    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    rows = [(1, "one two", "x"), (2, "one two", "y"), (None, "one two", "z"), (3, None, None), (4, "", None), (1, "one two", "x"), (5, "three", "n"), (6, "six", "p"), (6, "six", "q"), (None, "none", "r"), (None, "none", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("tm_digest", F.lit("own")).repartition(3)
    out = count_tokens(docs, path, cache=cache)
    assert out.columns == ["doc_id", "text", "tm_digest", "n_bytes", "n_tokens"] and out.count() == 11 and out.where("tm_digest = 'own'").count() == 11
    assert spark.read.parquet(cache).count() == 5  # encoded once each: one two, (empty), three, six, none
    expected = {t: counter(path)([t or ""])[0] for t in {r[1] for r in rows}}
    assert all(r["n_tokens"] == expected[r["text"]] and r["n_bytes"] == len((r["text"] or "").encode()) for r in out.collect())
    stored = spark.read.parquet(cache).count()
    more = spark.createDataFrame([(9, "one two"), (8, "four")], "doc_id long, text string")
    assert count_tokens(more, path, cache=cache).count() == 2
    assert spark.read.parquet(cache).count() == stored + 1
    assert count_tokens(docs.limit(0), path).count() == 0


def test_token_query(spark, sf):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == {k: (len(t.encode()), len(model.encode(t))) for k, t in docs.items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def check_packing(rows, docs, path, capacity=2048):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(docs)
    for k, t in docs.items():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for i, r in enumerate(own):
            assert r["start"] == at and (r["length"] == capacity or i == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, bound = check_packing(op6_ga_packing(spark, sf).collect(), docs, tokenizer_path("byte_bpe_50k.json"))
    assert used <= bound * 1.05


def test_packing_many_cells_and_odd_texts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "x1", "étude"]) for _ in range(rng.randrange(0, 1500)))) for i in range(600)]
    rows += [(1000 + i, t) for i, t in enumerate([*ODD, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tidemark.llm import packing

    old, packing.CELL = packing.CELL, 100
    packing.place.__defaults__ = (1, 100)
    try:
        out = pack(docs, path).collect()
    finally:
        packing.CELL = old
        packing.place.__defaults__ = (1, old)
    used, bound = check_packing(out, dict(rows), path)
    assert used <= bound * 1.02
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in out)
    assert pack(docs.limit(0), path).count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert pack(same, path).count() == 3


def test_packed_ids_are_the_arrays_bytes(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, "a long text " * 3000])], "doc_id long, text string")
    arrays = {(r["doc_id"], r["piece"]): r for r in pack(docs, path).collect()}
    packed = pack(docs, path, packed_ids=True).collect()
    assert len(packed) == len(arrays)
    for r in packed:
        other = arrays[r["doc_id"], r["piece"]]
        assert bytes(r["ids"]) == np.array(other["ids"], "<u4").tobytes() and r["ids_crc32"] == other["ids_crc32"] == zlib.crc32(r["ids"])


def test_repeated_rows_each_keep_their_place(spark):
    same = spark.createDataFrame([(1, "a b c")] * 50, "doc_id long, text string")
    out = pack(same, tokenizer_path("byte_bpe_50k.json"), capacity=16).collect()
    assert len(out) == 50 and len({(r["sequence_id"], r["offset"]) for r in out}) == 50


@pytest.mark.parametrize("seed", range(3))
def test_genetic_search_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 2048), rng.randrange(300, 900)]) for _ in range(400)]
    bins, loads = [], []
    best_fit(bins, loads, sorted(range(400), key=lambda i: -sizes[i]), sizes, 2048)
    best = evolve(sizes, 2048, seed, [])
    assert sorted(i for b in best.bins for i in b) == list(range(400)) and max(best.loads) <= 2048
    assert len(best.bins) <= len(bins)


@pytest.mark.parametrize(("kind", "capacity"), [("uniform", 150), ("triplets", 1000)])
def test_genetic_search_beats_best_fit_on_hard_instances(kind, capacity):
    """Sizes of a fifth to two thirds of a bin, and bins of exactly three pieces: best fit leaves bins that crossover wins back."""
    saved = 0
    for seed in range(4):
        rng, sizes = random.Random(seed), []
        if kind == "uniform":
            sizes = [rng.randrange(20, 101) for _ in range(250)]
        else:
            for _ in range(40):
                a = rng.randrange(380, 491)
                b = rng.randrange(250, (1000 - a) // 2 + 1)
                sizes += [a, b, 1000 - a - b]
        bins = []
        best_fit(bins, [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)
        best = evolve(sizes, capacity, seed, [], patience=100)
        assert sorted(i for b in best.bins for i in b) == list(range(len(sizes))) and max(best.loads) <= capacity
        assert len(best.bins) <= len(bins)
        saved += len(bins) - len(best.bins)
    assert saved >= 4


def test_encoder_is_exact_on_long_runs_and_code_points():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for t in [" ".join(points[i : i + 40_000]) for i in range(0, len(points), 40_000)] + [c * 50_000 for c in (" ", "a", "\n", "é")]:
        assert np.frombuffer(encoder(path).ids(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_encoder_is_exact_on_odd_spaces():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    model, rng = Tokenizer.from_file(path), random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a", "Bc", " ", " ", "\n", "1", "!", "'s", "é", "\t", " ", "\x1c", "　"]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encoder(path).ids(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)
