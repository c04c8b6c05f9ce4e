"""Packing documents into sequences of at most ``capacity`` tokens with a grouping genetic algorithm on islands.

Pieces: a document is its token ids and the separator id; only a longer one is cut, into pieces of ``capacity`` tokens
of which the first may be shorter. A piece of ``capacity`` tokens fills a sequence by itself, so at most one piece of
a document is left to place. Those are dealt by hash into *cells* of about ``CELL`` pieces, each a packing problem of
its own with the same mix of lengths. Every cell is solved by ``ISLANDS`` islands in different tasks, each a
population of solutions, of which one is best fit of the pieces by falling length and the others in random order. In
each epoch an island breeds: crossover injects well-filled bins of one parent into another, bins that hold an injected
piece are broken up (no piece may be twice), displaced pieces are swapped into bins that they fill better, and what is
left is best-fitted, largest first. An epoch ends at the lower bound, or when ``PATIENCE`` children in a row improve
nothing. Between epochs each island's elite moves to the next island of the ring. After
the last epoch each cell keeps its best solution, and the pieces of badly filled sequences of all cells are dealt anew
into fewer cells for a last round, as long as that lowers the number of sequences.

The state that moves between tasks is a solution of one cell: bounded by CELL, not by the corpus.

Defined results: a null or empty text is the separator alone (one token); repeated doc_ids and rows are packed like
any other row; an empty table gives an empty result; other columns of the documents are not carried.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import stage, trimmed

CELL, ISLANDS, EPOCHS = 1500, 3, 2
#: Solutions of an island, and children in a row that improve nothing before an epoch ends.
POPULATION, PATIENCE = 6, 5
#: Pieces of a bin that are tried for a swap.
TRIED = 6
#: Bytes of ids in a batch that a worker hands over.
BATCH_BYTES = 4 << 20
#: Sequences filled less than this go to the last round.
WELL_FILLED = 0.995


#: Fixed value: the pattern that byte-level pre-tokenisers cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian uint32 bytes.

    A plain byte-level vocabulary whose ids follow its merges is loaded into tiktoken, which gives the same ids several
    times faster; texts with special strings, and any other vocabulary, are encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)

    def _ranks(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, alphabet = spec["pre_tokenizer"] or {}, spec["model"], byte_alphabet()
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, separator: int = 0, with_ids: bool = True, packed_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if with_ids, ids: array<int>, or with packed_ids their little-endian 32-bit bytes. Batches are cut by their ids' bytes, whatever the texts' lengths are."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + f", ids {'binary' if packed_ids else 'array<int>'}" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.array([separator], dtype="<u4").tobytes()
        for batch in batches:
            at: list[int] = []
            cols: list[list] = [[], [], [], []]
            held: list[bytes] = []
            size = 0

            def made(keys=batch.column(0)) -> pa.RecordBatch:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [keys.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
                if with_ids and packed_ids:
                    arrays.append(pa.array(held, pa.binary()))
                elif with_ids:
                    offsets = np.cumsum([0, *[len(x) // 4 for x in held]], dtype=np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), "<i4"))))
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

            for i, t in enumerate(batch.column(1)):
                raw = encode(t.as_py() or "") + end
                n = len(raw) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    own = raw[4 * a : 4 * b]
                    for col, x in zip(cols, (k, a, b - a, zlib.crc32(own)), strict=True):
                        col.append(x)
                    if with_ids:
                        held.append(own)
                        size += len(own)
                    if size >= BATCH_BYTES:
                        yield made()
                        at, cols, held, size = [], [[], [], [], []], [], 0
            if at:
                yield made()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(trimmed(run), schema)


class Solution:
    """Bins as lists of piece numbers."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins = bins
        self.loads = [sum(sizes[i] for i in b) for b in bins]
        #: Falkenauer's cost: mean of the squared fill, so that full bins beside empty ones are preferred.
        self.fitness = (-len(bins), sum((x / capacity) ** 2 for x in self.loads))


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Place items, in their order, each into the fullest bin that takes it; bins and loads change in place."""
    room = sorted((capacity - x, k) for k, x in enumerate(loads) if x < capacity)
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            loads[k] += sizes[i]
            left -= sizes[i]
        else:
            k, left = len(bins), capacity - sizes[i]
            bins.append([i])
            loads.append(sizes[i])
        if left:
            insort(room, (left, k))


def replace(bins: list[list[int]], loads: list[int], displaced: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Swap one or two pieces of a bin for one or two displaced ones that fill it better; returns what is displaced then.

    Falkenauer's local search. Of a bin of many pieces, a few drawn at random are tried.
    """
    out = sorted((sizes[i], i) for i in displaced)
    for k in rng.sample(range(len(bins)), len(bins)):
        room = capacity - loads[k]
        if not room or not out:
            continue
        own = bins[k] if len(bins[k]) <= TRIED else rng.sample(bins[k], TRIED)
        best, found = 0, None
        for leave in [(i,) for i in own] + [(i, j) for x, i in enumerate(own) for j in own[:x]]:
            freed = sum(sizes[i] for i in leave)
            most = freed + room
            one = bisect_right(out, (most, len(sizes))) - 1
            if one >= 0 and out[one][0] - freed > best:
                best, found = out[one][0] - freed, (leave, (one,))
            if best < room and len(leave) == 2:
                for a in range(bisect_right(out, (most - out[0][0], len(sizes))) - 1, max(-1, one - TRIED), -1):
                    b = bisect_right(out, (most - out[a][0], len(sizes)), 0, a) - 1
                    if b >= 0 and out[a][0] + out[b][0] - freed > best:
                        best, found = out[a][0] + out[b][0] - freed, (leave, (a, b))
            if best == room:
                break
        if found:
            leave, enter = found
            new = [out[e][1] for e in enter]
            for e in sorted(enter, reverse=True):
                out.pop(e)
            bins[k] = [i for i in bins[k] if i not in leave] + new
            loads[k] += best
            for i in leave:
                insort(out, (sizes[i], i))
    return [i for _, i in out]


def offspring(one: Solution, other: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Well-filled bins of ``other`` enter ``one`` whole; bins of ``one`` they collide with are broken up, and the displaced pieces swapped in or best-fitted."""
    order = sorted(range(len(other.bins)), key=other.loads.__getitem__, reverse=True)
    full = [k for k in order if other.loads[k] >= WELL_FILLED * capacity] or order[: max(1, len(order) // 4)]
    inject = rng.sample(full, max(1, round(len(full) * rng.uniform(0.1, 0.7))))
    taken = {i for k in inject for i in other.bins[k]}
    displaced: list[int] = []
    kept: list[list[int]] = []
    for b in one.bins:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    # mutation: a few of the emptiest bins are broken up as well
    loads = [sum(sizes[i] for i in b) for b in kept]
    broken = set(sorted(range(len(kept)), key=loads.__getitem__)[: rng.randint(1, 3) + len(kept) // 50])
    for k in broken:
        displaced += kept[k]
    bins = [list(other.bins[k]) for k in inject] + [b for k, b in enumerate(kept) if k not in broken]
    loads = [sum(sizes[i] for i in b) for b in bins]
    displaced = replace(bins, loads, displaced, sizes, capacity, rng)
    displaced.sort(key=lambda i: (-sizes[i], rng.random()))
    best_fit(bins, loads, displaced, sizes, capacity)
    return Solution(bins, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, immigrants: list[list[list[int]]], patience: int = PATIENCE) -> Solution:
    """One epoch of one island; immigrants are solutions (its own elite and that of its neighbour).

    It breeds until the best solution is at the lower bound, or ``patience`` children in a row have not improved it.
    """
    rng = random.Random(seed)
    population = [Solution(b, sizes, capacity) for b in immigrants]
    bound = -(-sum(sizes) // capacity)
    solved = max((s for s in population if len(s.bins) == bound), key=lambda s: s.fitness, default=None)
    if solved:  # no solution has fewer bins
        return solved
    while len(population) < POPULATION:
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        if population:
            rng.shuffle(order)
        bins: list[list[int]] = []
        best_fit(bins, [], order, sizes, capacity)
        population.append(Solution(bins, sizes, capacity))
        if len(bins) == bound:
            return population[-1]
    population.sort(key=lambda s: s.fitness, reverse=True)
    waiting = 0
    while len(population[0].bins) > bound and waiting < patience:
        one, other = rng.sample(range(len(population)), 2)
        child = offspring(population[one], population[other], sizes, capacity, rng)
        waiting = 0 if child.fitness > population[0].fitness else waiting + 1
        if child.fitness > population[-1].fitness and all(child.fitness != s.fitness for s in population):
            population[-1] = child
            population.sort(key=lambda s: s.fitness, reverse=True)
    return population[0]


def _cells(parts: DataFrame, cells: int, seed: int) -> DataFrame:
    """One row for each cell: its pieces' keys and lengths, in key order."""
    dealt = parts.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(cells)))
    rows = dealt.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("key", "length"))).alias("p"))
    return rows.select("cell", F.col("p.key").alias("keys"), F.col("p.length").alias("sizes"))


def _epoch(capacity: int, epoch: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for cell, island, sizes, elites in zip(pdf["cell"], pdf["island"], pdf["sizes"], pdf["elites"], strict=True):
                sizes = [int(x) for x in sizes]
                immigrants = []
                for e in elites if elites is not None else ():
                    bins: list[list[int]] = [[] for _ in range(max(e) + 1)]
                    for i, b in enumerate(e):
                        bins[b].append(i)
                    immigrants.append(bins)
                best = evolve(sizes, capacity, hash((seed, epoch, int(cell), int(island))), immigrants)
                where = np.zeros(len(sizes), dtype=np.int32)
                for k, b in enumerate(best.bins):
                    where[b] = k
                made.append((where, len(best.bins), best.fitness[1]))
            yield pdf[["cell", "island"]].assign(elite=[x[0] for x in made], bins=[x[1] for x in made], fill=[x[2] for x in made])

    return run


def evolve_cells(parts: DataFrame, capacity: int, cells: int, seed: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(key, length) to (key, length, bin, bins): bin is unique over all cells, bins is the cell's number of bins."""
    spark = parts.sparkSession
    tasks = min(cells * islands, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    problem = stage(_cells(parts, cells, seed), "pack-cells")
    isles = problem.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    schema = "cell long, island int, elite array<int>, bins int, fill double"
    state = None
    for epoch in range(epochs):
        if state is None:
            work = isles.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:  # each island gets its own elite back and its neighbour's on the ring
            moved = state.select("cell", "elite", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))).alias("island"))
            elites = moved.groupBy("cell", "island").agg(F.collect_list("elite").alias("elites"))
            work = isles.join(elites, ["cell", "island"])
        work = work.select("cell", "island", "sizes", "elites").repartition(tasks, "cell", "island")
        state = stage(work.mapInPandas(_epoch(capacity, epoch, seed), schema), "pack-islands")
    best = state.groupBy("cell").agg(F.max_by(F.struct("elite", "bins"), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("best"))
    out = problem.join(best, "cell").select("cell", F.col("best.bins").alias("bins"), F.explode(F.arrays_zip("keys", "sizes", F.col("best.elite").alias("elite"))).alias("x"))
    return out.select(F.col("x.keys").alias("key"), F.col("x.sizes").alias("length"), (F.col("cell") * (1 << 32) + F.col("x.elite")).alias("bin"))


def place(parts: DataFrame, capacity: int, seed: int = 1, cell: int = CELL) -> DataFrame:
    """Packs (key, length): two rounds, the second for what the first left in badly filled bins."""
    count = parts.count()
    cells = max(1, round(count / cell))
    first = stage(evolve_cells(parts, capacity, cells, seed), "pack-round")
    if cells == 1:
        return first
    loads = first.groupBy("bin").agg(F.sum("length").alias("load"))
    poor = stage(first.join(loads.where(F.col("load") < WELL_FILLED * capacity), "bin").select("bin", "key", "length"), "pack-poor")
    n, bins = poor.agg(F.count("*"), F.countDistinct("bin")).first()
    if not n:
        return first
    again = stage(evolve_cells(poor.select("key", "length"), capacity, max(1, round(n / cell)), seed + 1), "pack-round")
    if again.select("bin").distinct().count() >= bins:
        return first
    kept = first.join(poor.select("bin").distinct(), "bin", "left_anti")
    return kept.select("key", "length", "bin").unionByName(again.select("key", "length", (-1 - F.col("bin")).alias("bin")))


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, separator: int = 0, with_ids: bool = True, seed: int = 1, packed_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset; ids as in `pieces_of`. Offsets in a sequence follow the pieces' keys."""
    pieces = pieces_of(docs, tokenizer, doc_id, text, capacity, separator, with_ids, packed_ids)
    pieces = stage(pieces.withColumn("key", F.monotonically_increasing_id()), "pack-pieces")
    whole, parts = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    placed = stage(place(parts.select("key", "length"), capacity, seed), "pack-placed")
    # a sequence holds at most capacity pieces, as each has a token or more
    over = Window.partitionBy("bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("key", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(over), F.lit(0)).alias("offset"))
    # sequences of one piece get ids of their own range: bins use the low half of 2**62 on either side of zero
    alone = whole.select("*", (F.lit(1 << 62) + F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return parts.join(offsets, "key").unionByName(alone).drop("key")
