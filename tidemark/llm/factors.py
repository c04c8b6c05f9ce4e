"""Substring deduplication by relative Lempel-Ziv parsing against blocks of reference documents.

*Which windows can repeat.* Most windows of ``window`` words occur once, and those never leave their task. *Anchors*
thin them out: a window is represented by the smallest hash among its ``ANCHOR``-word grams, so equal windows have
equal anchors. A first pass counts the texts of each anchor and sets the bits of those found in two or more in a bitmap
of bounded size. A second pass gives the fingerprints of windows whose anchor has its bit set; for each, the smallest
doc_id that holds it is its *source*. A full bitmap would let every window through: slower, never wrong. Fingerprints
are dealt into buckets, whose number follows the input, as arrays; they meet once, in NumPy. What they find goes on as
arrays as well, to where all marks of a text come together.

*Reference blocks.* The texts of all sources are dealt by doc_id into blocks of ``BLOCK_BYTES`` at most on average. A stretch of a
document whose windows have sources goes to each block that holds one of them. There the block is indexed (sorted
window hashes with their places), and the stretch is factored greedily: at a word whose
window is in the block, the longest match with any smaller document of the block becomes a factor (source, place in the
source, length), compared word by word in the end; parsing goes on at the first window that is not whole in the factor.
So windows that straddle the boundary of two factors, or of two blocks, are looked up like any other. A block that
many documents repeat is indexed by several tasks, each of which factors a share of the stretches.

*Spans and parse.* A factor of ``window`` words or more is a duplicate span, so the spans cover exactly the words of
windows that a smaller document holds. Of all blocks' factors, those that reach farthest are laid end to end: with the
words between them they tile the text, which is its relative Lempel-Ziv parse.

Copies of whole texts are settled by a digest of the text: every copy but the one with the smallest doc_id is one
factor, if it has ``window`` words.

Defined results: a null or empty text has no words; a null doc_id is no reference and is left as it is; rows with
equal doc_id are not smaller than one another, and those with equal text as well share their result; texts shorter
than ``window`` words are left as they are; other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bitmap import COUNTED, COUNTED_BITS, bitmap_of, counted, holds, repeated
from tidemark.llm._shared import release, small, stage, trimmed, with_fields
from tidemark.llm._words import SPACE_WORDS, Chunk, as_bytes, chunks, grams

ANCHOR = 6
KEPT_DIGESTS = 200_000
#: Bytes of reference texts in a block, and of stretches that one task factors against it.
BLOCK_BYTES, SHARE_BYTES = 4 << 20, 8 << 20
#: Bytes of texts for each bucket of fingerprints, and fingerprints that a worker holds.
BUCKET_BYTES, HELD_WINDOWS = 1 << 20, 500_000
#: Bytes of texts whose marks are gathered together, and what stands for a mark where a text is a source.
HOME_BYTES, SOURCE = 8 << 20, -1
#: Rows and bytes a worker holds before it sends them on.
SENT_ROWS, SENT_BYTES = 50_000, 4 << 20


def anchors(c: Chunk, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one text: its first word, and its anchor's hash."""
    n = len(c.hashes)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    gram = min(ANCHOR, window)
    own = c.grams(gram)
    best = own[: n - window + 1].copy()
    for j in range(1, window - gram + 1):
        np.minimum(best, own[j : n - window + 1 + j], out=best)
    owner = np.repeat(np.arange(len(c.bounds) - 1), np.diff(c.bounds))
    places = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    return places, best[places]


class FirstCopies:
    """Tells which texts of a task are new, or copies with a smaller doc_id than those before."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def wanted(self, ids: list, column: pa.Array) -> np.ndarray:
        data, offsets = as_bytes(column)
        out = np.zeros(len(ids), dtype=bool)
        for i, d in enumerate(ids):
            if d is None:
                continue
            key = hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest()
            if key not in self.seen or d < self.seen[key]:
                if len(self.seen) >= KEPT_DIGESTS:
                    self.seen.clear()
                self.seen[key] = d
                out[i] = True
        return out


def shared_anchors(docs: DataFrame, window: int) -> np.ndarray:
    """The bitmap of the anchors that two or more texts have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = FirstCopies()
        for batch in batches:
            wanted = first.wanted(batch.column(0).to_pylist(), batch.column(1))
            for c in chunks(batch.column(1), SPACE_WORDS):
                places, best = anchors(c, window)
                owner = np.searchsorted(c.bounds, places, "right") - 1
                take = wanted[c.first + owner]
                owner, best = owner[take], best[take]
                new = np.ones(len(best), dtype=bool)
                new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
                yield counted(best[new][_first_in_text(best[new], owner[new])])

    return repeated(docs.select("tm_id", "tm_raw").mapInArrow(trimmed(read), COUNTED))


def _first_in_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of each hash's first occurrence in each text."""
    order = np.lexsort((owner, hashes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return order[new]


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def shared_windows(docs: DataFrame, window: int, bitmap: np.ndarray, buckets: int) -> DataFrame:
    """bucket, and arrays of the windows in it whose anchor has its bit set: ids, keys, blocks (of their texts), places (first words), prints."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = FirstCopies()
        rows: list[pa.RecordBatch] = []
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def send() -> pa.RecordBatch:
            texts = pa.concat_batches(rows)
            text, place, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            rows.clear()
            held.clear()
            bucket = prints % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
            bounds = np.append(starts, len(order))
            own = texts.take(pa.array(text[order]))
            values = [*own.columns, pa.array(place[order].astype(np.int32)), pa.array(prints[order].view(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][starts].astype(np.int32)), *(_lists(bounds, v) for v in values)], ["bucket", "ids", "keys", "blocks", "places", "prints"])

        texts = 0
        for batch in batches:
            wanted = first.wanted(batch.column(0).to_pylist(), batch.column(1))
            for c in chunks(batch.column(1), SPACE_WORDS):
                places, best = anchors(c, window)
                owner = np.searchsorted(c.bounds, places, "right") - 1
                take = np.flatnonzero(holds(bits.value, best) & wanted[c.first + owner])
                places, owner = places[take], owner[take]
                if not len(take):
                    continue
                rows.append(batch.select(["tm_id", "tm_key", "tm_block"]).slice(c.first, len(c.bounds) - 1))
                held.append((texts + owner, places - c.bounds[owner], c.grams(window)[places]))
                texts += len(c.bounds) - 1
                n += len(take)
                if n > HELD_WINDOWS:
                    yield send()
                    texts = n = 0
        if n:
            yield send()

    id_type = docs.schema["tm_id"].dataType.simpleString()
    schema = f"bucket int, ids array<{id_type}>, keys array<int>, blocks array<int>, places array<int>, prints array<long>"
    return docs.select("tm_id", "tm_raw", "tm_key", "tm_block").mapInArrow(trimmed(read), schema)


def met(ids: pa.Array, keys: np.ndarray, blocks: np.ndarray, places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """blocks, ids, keys (of texts) and marks (block of the source above the first word) of the windows that have a smaller source; then the sources, with SOURCE for a mark."""
    names = ids.unique()
    names = names.take(pc.sort_indices(names))
    rank = pc.index_in(ids, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    block_of = np.zeros(len(names), dtype=np.int64)
    block_of[rank] = blocks
    order = np.argsort(prints, kind="stable")
    starts = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1]))
    least = np.repeat(np.minimum.reduceat(rank[order], starts), np.diff(np.append(starts, len(order))))
    later = rank[order] > least
    least, order = least[later], order[later]
    sources = np.unique(least)
    marks = np.append(block_of[least] << 32 | places[order], np.full(len(sources), SOURCE))
    rank = np.append(rank[order], sources)
    return block_of[rank], names.take(pa.array(rank)), np.append(keys[order], np.zeros(len(sources), dtype=np.int32)), marks


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The flattened arrays of rows sorted by the number in their first column, whole numbers at a time: a little over HELD_WINDOWS values."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None

    def joined() -> list[pa.Array]:
        out = [pa.concat_arrays([b.column(i).flatten() for b in held]) for i in range(1, held[0].num_columns)]
        held.clear()
        return out

    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if n > HELD_WINDOWS and number[a] != last:
                yield joined()
                n = 0
            part = batch.slice(a, b - a)
            held.append(part)
            n, last = n + len(part.column(1).flatten()), number[a]
    if n:
        yield joined()


def marked(found: DataFrame, homes: int) -> DataFrame:
    """home (of a text, by its block), and arrays of what met gives for it: ids, keys, marks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def send() -> pa.RecordBatch:
            blocks, ids, keys, marks = zip(*held, strict=True)
            held.clear()
            home = np.concatenate(blocks) % homes
            order = np.argsort(home, kind="stable")
            starts = np.flatnonzero(np.diff(home[order], prepend=-1))
            bounds = np.append(starts, len(order))
            values = [pa.concat_arrays(ids).take(pa.array(order)), pa.array(np.concatenate(keys)[order]), pa.array(np.concatenate(marks)[order])]
            return pa.RecordBatch.from_arrays([pa.array(home[order][starts].astype(np.int32)), *(_lists(bounds, v) for v in values)], ["home", "ids", "keys", "marks"])

        for ids, *rest in _whole(batches):
            held.append(met(ids, *(x.to_numpy() for x in rest)))
            n += len(held[-1][0])
            if n > HELD_WINDOWS:
                yield send()
                n = 0
        if n:
            yield send()

    kind = found.schema["ids"].dataType.simpleString()
    rows = found.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(trimmed(read), f"home int, ids {kind}, keys array<int>, marks array<long>")


def by_text(ids: pa.Array, keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """tm_id, tm_key, marks: a row for each text with marks; then one for each source, with null marks."""
    coded = ids.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    sources = np.unique(code[marks == SOURCE])
    order = np.lexsort((marks, keys, code))
    order = order[marks[order] != SOURCE]
    code, keys, marks = code[order], keys[order], marks[order]
    text = np.append(True, (code[1:] != code[:-1]) | (keys[1:] != keys[:-1]))[: len(order)]
    new = text | np.append(True, marks[1:] != marks[:-1])[: len(order)]  # rows of equal doc_id and text give equal marks
    starts, marks = np.flatnonzero(text), marks[new]
    found = _lists(np.append(np.cumsum(new)[starts] - 1, len(marks)), pa.array(marks))
    found = pa.concat_arrays([found, pa.nulls(len(sources), pa.list_(pa.int64()))])
    key = pa.concat_arrays([pa.array(keys[starts]), pa.nulls(len(sources), pa.int32())])
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(np.append(code[starts], sources))), key, found], ["tm_id", "tm_key", "marks"])


def meetings(found: DataFrame, homes: int = 1) -> DataFrame:
    """tm_id, tm_key, marks of each text with windows that have a smaller source, and each source, with null marks.

    A text's windows are in as many buckets as it has windows, so its marks come from all tasks: they are sent on as
    arrays of many texts, and a text becomes a row only where all of its marks are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, marks in _whole(batches):
            yield by_text(ids, keys.to_numpy(), marks.to_numpy())

    kind = found.schema["ids"].dataType.elementType.simpleString()
    rows = marked(found, homes).repartition("home").sortWithinPartitions("home")
    return rows.mapInArrow(trimmed(read), f"tm_id {kind}, tm_key int, marks array<long>")


def with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs less most rows that have no hits: those whose bit a bitmap of the hits' keys lacks, so their texts are not shuffled."""
    bitmap = bitmap_of(hits.select(F.shiftrightunsigned(F.xxhash64("hit_id", "hit_key"), 64 - COUNTED_BITS).alias("hash")))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)
    own = docs.select("tm_id", "tm_raw", "tm_key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(3).to_numpy().view(np.uint64)
            yield batch.select(["tm_id", "tm_raw", "tm_key"]).filter(pa.array(holds(bits.value, hashes)))

    return own.withColumn("tm_hash", F.xxhash64("tm_id", "tm_key")).mapInArrow(read, own.schema)


@dataclass
class Words:
    """Words of one or more texts: their bytes, places and hashes."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def same(self, at: int, other: Words, there: int, n: int) -> int:
        """How many of n words from ``at`` on equal those of ``other`` from ``there`` on, byte by byte."""
        if not n or self.data[self.starts[at] : self.ends[at + n - 1]] == other.data[other.starts[there] : other.ends[there + n - 1]]:
            return n
        for i in range(n):  # other white space, or a collision
            if self.data[self.starts[at + i] : self.ends[at + i]] != other.data[other.starts[there + i] : other.ends[there + i]]:
                return i
        return n


class Reference:
    """A block of reference texts, in doc_id order, and its index of windows."""

    def __init__(self, ids: list, texts: list[str], window: int):
        self.window, self.ids = window, ids
        words, size, parts, hashes, starts, ends, owner = 0, 0, [], [], [], [], []
        narrow = np.int32 if sum(len(t) for t in texts) < 1 << 29 else np.int64  # a character has four bytes at most
        self.first = np.zeros(len(ids) + 1, dtype=np.int64)
        for c in chunks(pa.array(texts, pa.string()), SPACE_WORDS):
            parts.append(c.data.tobytes())
            hashes.append(c.hashes)
            starts.append((c.starts + size).astype(narrow))
            ends.append((c.ends + size).astype(narrow))
            n = np.diff(c.bounds)
            owner.append(np.repeat(np.arange(c.first, c.first + len(n), dtype=narrow), n))
            self.first[c.first + 1 : c.first + len(n) + 1] = words + np.cumsum(n)
            words, size = words + len(c.hashes), size + len(c.data)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.words, self.owner = Words(b"".join(parts), join(starts, narrow), join(ends, narrow), join(hashes, np.uint64)), join(owner, narrow)
        n = max(0, words - window + 1)
        whole = np.flatnonzero(self.owner[:n] == self.owner[len(self.owner) - n :]).astype(narrow)
        prints = grams(self.words.hashes, window)[whole]
        order = np.argsort(prints, kind="stable")  # ties in doc_id order, then by place
        self.prints, self.places = prints[order], whole[order]

    def places_of(self, prints: np.ndarray) -> tuple[list[int], list[int]]:
        """Where the places of each print begin and end in ``places``."""
        return np.searchsorted(self.prints, prints, "left").tolist(), np.searchsorted(self.prints, prints, "right").tolist()

    def factors(self, doc_id, own: Words, seeds: list[int], low: list[int], high: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, number of the source, place in the source): the greedy parse of a stretch from its seeds on.

        low, high: what places_of gives for the windows at the seeds.
        """
        before, i = bisect_left(self.ids, doc_id), 0  # sources with a smaller doc_id
        while i < len(seeds):
            at, done = seeds[i], 0
            places = self.places[low[i] : high[i]]
            places = places[self.owner[places] < before]
            longest = self.longest(own.hashes, at, places)
            for k in np.argsort(-longest, kind="stable").tolist() if len(places) > 1 else range(len(places)):
                n, place = int(longest[k]), int(places[k])
                if n < self.window:
                    break
                n = self.words.same(place, own, at, n)
                if n >= self.window:  # else two hashes collided
                    source = int(self.owner[place])
                    yield at, n, source, place - int(self.first[source])
                    done = at + n
                    break
            # windows that are whole in this factor are done
            i = max(i + 1, bisect_left(seeds, done - self.window + 1, i))

    def longest(self, own: np.ndarray, at: int, places: np.ndarray) -> np.ndarray:
        """Words that match from each place on, slab by slab for the places that match so far."""
        room = np.minimum(len(own) - at, self.first[self.owner[places] + 1] - places)
        out, alive, done, slab = np.zeros(len(places), dtype=np.int64), np.arange(len(places)), 0, 128
        while len(alive):
            width = min(slab, int(room[alive].max()) - done)
            if width <= 0:
                out[alive] = done
                break
            span = np.arange(done, done + width)
            index = places[alive, None] + span
            same = self.words.hashes[np.minimum(index, len(self.owner) - 1)] == own[at + done : at + done + width]
            same &= span < room[alive, None]
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[alive] = done + n
            alive, done, slab = alive[n == width], done + width, 2 * slab
        return out


def _stretches(places: np.ndarray) -> list[np.ndarray]:
    """Sorted places cut where they do not follow one another."""
    return np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)


def stretches(docs: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """block, tm_id, tm_key, start, raw (words joined by a space), seeds: what each block is to factor."""
    hits = small(hits, 32)
    joined = docs.join(hits, docs["tm_id"].eqNullSafe(hits["hit_id"]) & (docs["tm_key"] == hits["hit_key"]))
    id_type = docs.schema["tm_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, held = [], 0

        def send(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            rows.clear()
            at.clear()
            return pa.RecordBatch.from_arrays([arrays[0], ids, *arrays[1:]], ["block", "tm_id", "tm_key", "start", "raw", "seeds"])

        for batch in batches:
            keys = batch.column(2).to_pylist()
            for c in chunks(batch.column(1), SPACE_WORDS):
                data = c.data.tobytes()
                for i in range(len(c.bounds) - 1):
                    row, first = c.first + i, int(c.bounds[i])
                    marks = np.unique(np.asarray(batch.column(3)[row].values, dtype=np.int64))
                    places = marks & 0xFFFFFFFF
                    order = np.argsort(places, kind="stable")
                    places, blocks = places[order], (marks >> 32)[order]
                    for run in _stretches(np.unique(places)):
                        a, b = np.searchsorted(places, [run[0], run[-1] + 1])
                        s, e = first + int(run[0]), first + int(run[-1]) + window
                        raw = b" ".join([data[x:y] for x, y in zip(c.starts[s:e].tolist(), c.ends[s:e].tolist(), strict=True)]).decode()
                        for block in np.unique(blocks[a:b]).tolist():
                            seeds = places[a:b][blocks[a:b] == block] - run[0]
                            rows.append((block, keys[row], int(run[0]), raw, seeds.tolist()))
                            at.append(row)
                            held += len(raw) + 4 * len(seeds)
                    if held > SENT_BYTES:
                        yield send(batch)
                        held = 0
            yield send(batch)
            held = 0

    return joined.select("tm_id", "tm_raw", "tm_key", "places").mapInArrow(trimmed(read), f"block int, tm_id {id_type}, tm_key int, start int, raw string, seeds array<int>")


def parsed(references: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """tm_id, tm_key, start, length, block, source, source_start: the factors of all stretches against their blocks."""
    id_kind = references.schema["tm_id"].dataType
    shares = targets.groupBy("block").agg(F.ceil(F.sum(F.octet_length("raw") + 4 * F.size("seeds")) / SHARE_BYTES).cast("int").alias("shares"))
    shares = small(stage(shares, "factor-shares"))
    share = F.pmod(F.xxhash64("tm_id", "tm_key", "start"), F.col("shares")).cast("int")
    left = references.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "tm_id", "tm_key", F.lit(0).alias("start"), F.col("tm_raw").alias("raw"), F.lit(None).cast("array<int>").alias("seeds"))
    right = targets.join(shares, "block").select("block", share.alias("share"), F.lit(1).alias("kind"), "tm_id", "tm_key", "start", "raw", "seeds")
    rows = left.unionByName(right).repartition("block", "share").sortWithinPartitions("block", "share", "kind", "tm_id", "tm_key", "start")
    names = ["tm_id", "tm_key", "start", "length", "block", "source", "source_start"]
    schema = f"tm_id {id_kind.simpleString()}, tm_key int, start int, length int, block int, source {id_kind.simpleString()}, source_start int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, index, last = None, [], [], None, None
        rows: list[tuple] = []
        kind = None

        def send() -> pa.RecordBatch:
            kinds = [kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), kind, pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column(3).type
            blocks, shares, kinds, docs, keys, starts = (batch.column(i).to_pylist() for i in range(6))
            raw, seeds = batch.column(6), batch.column(7)
            for c in chunks(raw, SPACE_WORDS):
                data, prints = c.data.tobytes(), c.grams(window)
                for i in range(len(c.bounds) - 1):
                    r, a, b = c.first + i, int(c.bounds[i]), int(c.bounds[i + 1])
                    if (blocks[r], shares[r]) != now:
                        now, ids, texts, index, last = (blocks[r], shares[r]), [], [], None, None
                    if last == (last := (kinds[r], docs[r], keys[r], starts[r])):
                        continue  # a repeated row
                    if not kinds[r]:
                        ids.append(docs[r])
                        texts.append(raw[r].as_py())
                        continue
                    if index is None:
                        index = Reference(ids, texts, window)
                        texts = []
                    at = np.asarray(seeds[r].values, dtype=np.int64)
                    own = Words(data, c.starts[a:b], c.ends[a:b], c.hashes[a:b])
                    for start, n, source, place in index.factors(docs[r], own, at.tolist(), *index.places_of(prints[a + at])):
                        rows.append((docs[r], keys[r], starts[r] + start, n, now[0], index.ids[source], place))
                if len(rows) >= SENT_ROWS:
                    yield send()
        if kind is not None:
            yield send()

    return rows.mapInArrow(trimmed(read), schema)


def factored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """tm_id, tm_key, whole, factors (start, length, block, source, source_start) of each text with a factor.

    whole: the text is a copy of its one source, and factors is null.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("tm_id"), raw.alias("tm_raw"), F.shiftright(F.xxhash64(raw), 32).cast("int").alias("tm_key"))
    spark = docs.sparkSession
    digests = keyed.where(F.col("tm_id").isNotNull()).select("tm_id", "tm_key", F.xxhash64("tm_raw").alias("d1"), F.xxhash64(F.lit(7), "tm_raw").alias("d2"))
    first = digests.groupBy("d1", "d2").agg(F.min("tm_id").alias("source"), F.max("tm_id").alias("last")).where(F.col("source") < F.col("last")).select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "source")
    first = stage(first, "factor-copies")  # an aggregate right below a join would keep a hot text in one task
    copies = digests.join(first, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))).where(F.col("source") < F.col("tm_id")).select("tm_id", "tm_key", "source")
    copies = stage(copies.distinct(), "factor-copies")
    release(spark, first)

    size = keyed.agg(F.sum(F.octet_length("tm_raw"))).first()[0] or 0  # a single number
    blocks, buckets, homes = (max(1, -(-size // n)) for n in (BLOCK_BYTES, BUCKET_BYTES, HOME_BYTES))
    keyed = keyed.withColumn("tm_block", F.pmod(F.xxhash64("tm_id"), F.lit(blocks)).cast("int"))
    found = stage(meetings(shared_windows(keyed, window, shared_anchors(keyed, window), buckets), homes), "factor-found")
    release(spark)
    sources = small(stage(found.where("marks IS NULL").select(F.col("tm_id").alias("source_id")), "factor-sources"), 16)
    references = stage(keyed.join(sources, keyed["tm_id"] == sources["source_id"], "left_semi"), "factor-references")
    hits = found.where("marks IS NOT NULL").select(F.col("tm_id").alias("hit_id"), F.col("tm_key").alias("hit_key"), F.col("marks").alias("places"))
    gone = small(copies.select(F.col("tm_id").alias("copy_id"), F.col("tm_key").alias("copy_key")), 16)
    hits = hits.join(gone, (F.col("hit_id") == F.col("copy_id")) & (F.col("hit_key") == F.col("copy_key")), "left_anti")
    hits = stage(hits, "factor-hits")
    release(spark, found)

    own = stage(stretches(with_hits(keyed, hits), hits, window), "factor-stretches")
    factors = parsed(references.withColumnRenamed("tm_block", "block"), own, window)
    factors = factors.groupBy("tm_id", "tm_key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "block", "source", "source_start"))).alias("factors"))
    kind = factors.schema["factors"].dataType
    return copies.select("tm_id", "tm_key", F.col("source").alias("whole"), F.lit(None).cast(kind).alias("factors")).unionByName(factors.select("tm_id", "tm_key", F.lit(None).cast(factors.schema["tm_id"].dataType).alias("whole"), "factors"))


def parse_of(factors: list[dict]) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Spans (start, end), and (start, length, source, source_start) laid end to end, of a text's factors sorted by start.

    Of the factors that begin at or before a word that is not covered yet, the one that reaches farthest is taken.
    """
    spans: list[list[int]] = []
    tiles: list[tuple] = []
    best, end = None, 0
    for f, after in zip(factors, [*factors[1:], None], strict=True):
        a, b = f["start"], f["start"] + f["length"]
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
            end = a
        if best is None or b > best["start"] + best["length"]:
            best = f
        reach = best["start"] + best["length"]
        if reach > end and (after is None or after["start"] > end):
            skip = end - best["start"]
            tiles.append((end, reach - end, best["source"], best["source_start"] + skip))
            end = reach
    return [(a, b) for a, b in spans], tiles


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """docs with ``text`` less its duplicate words (the kept ones joined by a space), and n_words, n_removed (long), spans and factors added.

    spans: array of (start, end) word numbers, end exclusive, of the words that factors of ``window`` words or more
    cover. factors: array of (start, length, source, source_start), end to end in each span. A text without a factor
    keeps its words joined by a space as well.
    """
    found = stage(factored(docs, doc_id, text, window), "factors")
    found = small(found.select("tm_id", "tm_key", F.col("whole").alias("tm_whole"), F.col("factors").alias("tm_factors")), 64)
    added = ("n_words", "n_removed", "spans", "factors")
    own = docs.drop(*[c for c in added if c in docs.columns])
    key = F.shiftright(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 32).cast("int")
    id_type = docs.schema[doc_id].dataType
    joined = own.join(found, own[doc_id].eqNullSafe(found["tm_id"]) & (key == found["tm_key"]), "left").select(*[own[c] for c in own.columns], "tm_whole", "tm_factors")
    at = own.columns.index(text)
    schema = with_fields(own.schema, f"n_words long, n_removed long, spans array<struct<start:int,end:int>>, factors array<struct<start:int,length:int,source:{id_type.simpleString()},source_start:int>>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            id_kind = batch.column(n).type
            whole, marks = batch.column(n).to_pylist(), batch.column(n + 1)
            texts, words, removed, spans, factors = [], [], [], [], []
            for c in chunks(batch.column(at), SPACE_WORDS):
                data = c.data.tobytes()
                for i in range(len(c.bounds) - 1):
                    row, (a, b) = c.first + i, (int(c.bounds[i]), int(c.bounds[i + 1]))
                    own_spans, tiles = parse_of(marks[row].as_py()) if marks[row].is_valid else ([], [])
                    if whole[row] is not None:
                        own_spans, tiles = ([(0, b - a)], [(0, b - a, whole[row], 0)]) if b - a >= window else ([], [])
                    keep = np.ones(b - a, dtype=bool)
                    for s, e in own_spans:
                        keep[s:e] = False
                    left = a + np.flatnonzero(keep)
                    texts.append(b" ".join([data[s:e] for s, e in zip(c.starts[left].tolist(), c.ends[left].tolist(), strict=True)]))
                    words.append(b - a)
                    removed.append(b - a - len(left))
                    spans.append([{"start": s, "end": e} for s, e in own_spans])
                    factors.append([dict(zip(("start", "length", "source", "source_start"), t, strict=True)) for t in tiles])
            columns = list(batch.columns[:n])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            factor_kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", id_kind), ("source_start", pa.int32())]))
            extra = [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_kind), pa.array(factors, factor_kind)]
            yield pa.RecordBatch.from_arrays([*columns, *extra], [*batch.schema.names[:n], *added])

    return joined.mapInArrow(trimmed(cut), schema)
