"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item with fewer words is one window). A document contains a
window only if it contains all of its shingles, so one shingle is the necessary prefix: with containment of all of
them the prefix is the single rarest, by the number of documents that hold it, counted over the whole corpus. A first
pass counts the documents of each shingle of the benchmark; a second looks up every document shingle among the prefix
shingles, which leaves few (window, place) candidates. Length bound: the window must fit into the document at that
place; positional bound: the shingle stands at a known offset of the window. What is left is verified over the whole
item-sized window, by its hash and then word by word.

The benchmark is indexed in blocks of about ``BLOCK_WORDS`` item words. An item of more than ``SEGMENT`` words goes in
segments, each with the first words of the next, so that every window is in one of them; blocks are collected and
broadcast one at a time, so nothing on the driver grows with the benchmark. Each block reads the documents twice: to
count its shingles, and to look them up. Documents are never shuffled when there is one block; with several, only their
hits are.

Defined results: words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters; null or empty
texts have none; items without words match nothing; items with equal item_id count once, a null item_id is left out
of the list of items (its windows still hit); repeated documents each get their row; empty tables give no hits.
Other columns of the documents pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stage, text_key, with_fields
from tidemark.llm._words import ALNUM_WORDS, chunks, runs

#: Words of benchmark items in a broadcast index (about 60 bytes a word in the workers).
BLOCK_WORDS, SEGMENT = 500_000, 20_000
SHINGLE = 4


def words_of(data: bytes, c, at: int, n: int) -> bytes:
    """n words of a chunk from one on, joined by a space."""
    return b" ".join([data[s:e] for s, e in zip(c.starts[at : at + n].tolist(), c.ends[at : at + n].tolist(), strict=True)])


class ItemIndex:
    """Windows of a block of items, found by their prefix shingles. items: (item_id, text) of the block."""

    def __init__(self, items: list[tuple], window: int, shingle: int = SHINGLE):
        self.window, self.shingle = window, shingle
        rows: dict[tuple[int, int], set[int]] = {}  # (length, hash of the window) to its items' places
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}  # the window's shingles as (size, hash) at each offset
        self.ids = [x[0] for x in items]
        words: dict[tuple[int, int], bytes] = {}
        for c in chunks(pa.array([x[1] for x in items], pa.string()), ALNUM_WORDS, lower=True) if items else ():
            grams = {k: c.grams(k) for k in (*range(1, shingle + 1), window)}
            data = c.data.tobytes()
            for i in range(len(c.bounds) - 1):
                a, b = int(c.bounds[i]), int(c.bounds[i + 1])
                if a == b:
                    continue
                length = min(window, b - a)
                k = min(shingle, length)
                for at in range(a, b - length + 1):
                    h = int(grams[window][at]) if length == window else int(c.whole(i)[0])
                    rows.setdefault((length, h), set()).add(c.first + i)
                    words.setdefault((length, h), words_of(data, c, at, length))
                    parts.setdefault((length, h), [(k, int(grams[k][at + j])) for j in range(length - k + 1)])
        self.windows = list(rows)
        self.items = [sorted(x) for x in rows.values()]
        self.parts = list(parts.values())
        self.words = list(words.values())
        self.lengths = np.array([x[0] for x in self.windows], dtype=np.int64)
        self.hashes = np.array([x[1] for x in self.windows], dtype=np.uint64)

    def shingles(self) -> dict[int, np.ndarray]:
        """All shingle hashes by size, sorted."""
        out: dict[int, set[int]] = {}
        for p in self.parts:
            for k, h in p:
                out.setdefault(k, set()).add(h)
        return {k: np.array(sorted(v), dtype=np.uint64) for k, v in out.items()}

    def order_by_rarity(self, documents: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix: its shingle in fewest documents, ties by hash."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for w, p in enumerate(self.parts):
            offset, (k, h) = min(enumerate(p), key=lambda x: (documents.get(x[1], 0), x[1][1], x[0]))
            if documents.get((k, h), 0):  # in no document: the window is in none
                chosen.setdefault(k, []).append((h, offset, w))
        for k, x in chosen.items():
            x.sort()
            self.prefix[k] = np.array([a for a, _, _ in x], dtype=np.uint64), np.array([b for _, b, _ in x]), np.array([c for _, _, c in x])

    def hits(self, c) -> tuple[np.ndarray, np.ndarray]:
        """Places (word numbers in the chunk) and windows of all verified occurrences."""
        places, found, data = [], [], None
        by_length: dict[int, np.ndarray] = {}
        doc_end = np.repeat(c.bounds[1:], np.diff(c.bounds))
        doc_start = np.repeat(c.bounds[:-1], np.diff(c.bounds))
        for k, (keys, offsets, windows) in self.prefix.items():
            grams = c.grams(k)
            if not len(grams):
                continue
            low = np.searchsorted(keys, grams, "left")
            at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == grams)
            low, high = low[at], np.searchsorted(keys, grams[at], "right")
            each = high - low
            pos = np.repeat(at, each)
            slot = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            start, w = pos - offsets[slot], windows[slot]
            fits = (start >= doc_start[pos]) & (start + self.lengths[w] <= doc_end[pos])
            start, w = start[fits], w[fits]
            for n in np.unique(self.lengths[w]):
                own = self.lengths[w] == n
                if n not in by_length:
                    by_length[n] = c.grams(int(n))
                same = np.flatnonzero(by_length[n][start[own]] == self.hashes[w[own]])
                first, which = start[own][same], w[own][same]
                data = c.data.tobytes() if len(same) and data is None else data
                equal = np.array([words_of(data, c, x, int(n)) == self.words[y] for x, y in zip(first.tolist(), which.tolist(), strict=True)], dtype=bool)
                places.append(first[equal])
                found.append(which[equal])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, int), np.zeros(0, int))


def shingle_documents(docs: DataFrame, text: str, index) -> dict[tuple[int, int], int]:
    """Documents that hold each shingle of the index, over all documents."""
    known = docs.sparkSession.sparkContext.broadcast(index.shingles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, v in known.value.items()}
        for batch in batches:
            for c in chunks(batch.column(0), ALNUM_WORDS, lower=True):
                owner = np.repeat(np.arange(len(c.bounds) - 1), np.diff(c.bounds))
                for k, keys in known.value.items():
                    grams = c.grams(k)
                    if not len(grams):
                        continue
                    slot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    at = np.flatnonzero((keys[slot] == grams) & (owner[: len(grams)] == owner[k - 1 :]))
                    pairs = np.unique(owner[at] * len(keys) + slot[at])
                    totals[k] += np.bincount(pairs % len(keys), minlength=len(keys))
        for k, n in totals.items():
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), k, np.int32)), pa.array(known.value[k][has].view(np.int64)), pa.array(n[has])], ["size", "shingle", "documents"])

    counted = docs.select(text).mapInArrow(run, "size int, shingle long, documents long").groupBy("size", "shingle").agg(F.sum("documents").alias("documents"))
    found = {(r["size"], r["shingle"] & (1 << 64) - 1): r["documents"] for r in counted.collect()}  # at most the shingles of a block
    known.destroy()
    return found


def marked(docs: DataFrame, text: str, known, spans: bool) -> DataFrame:
    """docs with n_words and the hits of one block, a broadcast ItemIndex. spans: as (starts, ends, items), for merging, else finished."""
    at = docs.columns.index(text)
    extra = "tm_words long, tm_starts array<int>, tm_ends array<int>, tm_items array<string>" if spans else "n_words long, n_hit long, n_items long, items_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for c in chunks(batch.column(at), ALNUM_WORDS, lower=True):
                place, w = index.hits(c)
                edge = np.zeros(len(c.hashes) + 1, dtype=np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + index.lengths[w], -1)
                hit = np.cumsum(edge[:-1]) > 0
                totals = np.concatenate(([0], np.cumsum(hit)))
                owner = np.searchsorted(c.bounds, place, "right") - 1
                items: dict[int, set] = {}
                for d, x in set(zip(owner.tolist(), w.tolist(), strict=True)):
                    items.setdefault(d, set()).update(str(index.ids[i]) for i in index.items[x] if index.ids[i] is not None)
                for d in range(len(c.bounds) - 1):
                    a, b = int(c.bounds[d]), int(c.bounds[d + 1])
                    n, ids = int(totals[b] - totals[a]), sorted(items.get(d, ()))
                    out[0].append(b - a)
                    if spans:
                        s, e = runs(hit[a:b]) if n else ((), ())
                        for col, x in zip(out[1:], (list(map(int, s)), list(map(int, e)), ids), strict=True):
                            col.append(x)
                    else:
                        out[1].append(n)
                        out[2].append(len(ids))
                        out[3].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())] if spans else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in extra.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], [*batch.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs.schema, extra))


def segments_of(benchmark: DataFrame, item_id: str, text: str, window: int, segment: int = SEGMENT) -> DataFrame:
    """item_id, text, n (words) of items cut into segments of about ``segment`` words that share ``window`` - 1 words with the next."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, sizes = [], [], []
            for c in chunks(batch.column(1), ALNUM_WORDS):
                data = c.data.tobytes()
                for i in range(len(c.bounds) - 1):
                    a, b = int(c.bounds[i]), int(c.bounds[i + 1])
                    for s in range(a, max(a + 1, b - window + 1), segment):
                        e = min(b, s + segment + window - 1)
                        if s < e:
                            at.append(c.first + i)
                            texts.append(data[c.starts[s] : c.ends[e - 1]])
                            sizes.append(e - s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32())], ["item_id", "text", "n"])

    return benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, f"item_id {benchmark.schema[item_id].dataType.simpleString()}, text string, n int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = 10, block_words: int = BLOCK_WORDS, segment: int = SEGMENT) -> DataFrame:
    """docs with n_words, n_hit, n_items (long), items_sha256 and contaminated added."""
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*[c for c in own if c in docs.columns])
    context = docs.sparkSession.sparkContext
    items = stage(segments_of(benchmark, item_id, text, window, segment), "contamination-items")
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()  # about block_words words
        index = ItemIndex(sorted(map(tuple, rows), key=str), window)
        index.order_by_rarity(shingle_documents(docs, text, index) if rows else {})
        known = context.broadcast(index)
        if blocks == 1:
            return marked(docs, text, known, spans=False).withColumn("contaminated", F.col("n_hit") > 0)
        keys = docs.select(F.col(doc_id).alias("tm_id"), F.col(text)).withColumn("tm_text", text_key(F.col(text)))
        parts.append(stage(marked(keys, text, known, spans=True).drop(text), "contamination-hits"))
        known.destroy()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    spans = F.array_sort(F.flatten(F.collect_set(F.arrays_zip(F.col("tm_starts").alias("s"), F.col("tm_ends").alias("e")))))
    hits = hits.groupBy("tm_id", "tm_text").agg(F.max("tm_words").alias("tm_words"), spans.alias("tm_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tm_items")))).alias("tm_items"))
    # words in the union of intervals sorted by start
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"))
    hits = hits.select("tm_id", "tm_text", F.col("tm_words").alias("n_words"), F.aggregate("tm_spans", none, step, lambda acc: acc["n"]).alias("n_hit"), "tm_items")
    out = docs.join(hits, docs[doc_id].eqNullSafe(hits["tm_id"]) & (text_key(docs[text]) == hits["tm_text"]), "left")
    listed = hits["tm_items"]
    return out.select(*[docs[c] for c in docs.columns], hits["n_words"], hits["n_hit"], F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"))
