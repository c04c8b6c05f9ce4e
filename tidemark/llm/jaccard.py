"""Documents linked by the Jaccard similarity of their word shingles, exactly: size-banded tiles, bitmap bounds, sorted arrays.

Documents with equal shingle sets are one *node* from the start. Two nodes x and y link when
``100 * |x & y| >= percent * |x | y|``, so their sizes are close and their symmetric difference has at most
``(|x| + |y|) * (100 - percent) / (100 + percent)`` shingles.

*Tiles.* Sizes are cut into bands. In a band, shingles fall by hash into a quarter more parts than the largest
difference a link can have, so two linked nodes agree in many whole parts (a few parts more make up for empty ones). A
node posts the hash of each part in its band, and in the lower bands where smaller partners can be; its empty parts only
if a linked node could agree with it in those alone, as unrelated nodes agree in them too. Nodes that share a posting form a tile. Common shingles make no large
tiles: all shingles of a part must agree. Parts that occur once are filtered by a bitmap of bounded size before the
shuffle, as most do, and with them all nodes that share too few parts with others to link with any. Tiles with the
same members are one tile; a large one is divided into blocks.

*Bounds.* A node's signature is a hashed parity bitmap of a size that follows the node's. The bits in which two differ
are at most their symmetric difference, so bit counts bound the overlap from above. In a tile, or a block of one and a
few pivots from its other blocks, only a spanning forest of the pairs within the bound is passed on.

*Verification.* Those pairs are verified by intersecting sorted shingle arrays, and components come from star
contraction over the links. If a pair is refuted, or a tile was divided, tiles whose members are not all connected yet
are gone through again: members of a tile's largest component meet only the others, the others meet each other, and
every pair within the bound between different components is verified, so no link between components is lost.

Shingles and parts are 64-bit hashes; sets are told apart by a 64-bit hash as well.

Defined results: null, empty or wordless texts have no shingles and link with nothing; a text with fewer words than a
shingle is one shingle; repeated rows and doc_ids are rows of one component if their texts link; a null doc_id takes
part, and is a component's name only if it has no other; other columns pass through untouched; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bitmap import COUNTED, counted, holds, repeated
from tidemark.llm._shared import release, small, stage, text_key
from tidemark.llm._words import SPACE_WORDS, STEP, chunks, mix
from tidemark.llm.components import components

#: Nodes of a block; tiles above it are split.
BLOCK = 1024
#: Nodes of other blocks that each block of a divided tile meets in the first round.
PIVOTS = 8
KEPT_NODES = 200_000
#: Postings, and bytes of signatures and sets, that a worker holds before it sends them on.
HELD, HELD_BYTES = 500_000, 8 << 20
MIN_BITS = 512
ODD = np.uint64(0x9FB21C651E98DF25)


class Bands:
    """Sizes cut into bands; band j holds sizes edges[j] to edges[j + 1] - 1."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * (100 / percent) ** 3)))
        self.edges = np.array(edges)

    def of(self, size: int) -> range:
        """Bands a node posts in: from that of its smallest partner to its own."""
        low = -(-size * self.percent // 100)
        a, b = np.searchsorted(self.edges, [low, size], "right") - 1
        return range(int(a), int(b) + 1)

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a band and how many of them may be empty; no parts if only equal sets can link."""
        x = int(self.edges[band + 1]) - 1
        differ = self.differ(x + 100 * x // self.percent)
        spare = 8 if x < 400 else 2
        return (differ + differ // 4 + 1 + spare, spare) if differ else (0, 0)

    def differ(self, sizes: int) -> int:
        """The largest symmetric difference of two linked sets whose sizes add up to ``sizes``."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def agree(self, band: int, size: int, empty: int) -> int:
        """How many of its posted parts a node shares at least with a partner that it meets in the band.

        empty: its empty parts, which agree as well but may not be posted.
        """
        n = self.parts(band)[0]
        top = int(self.edges[band + 1]) - 1
        partner = 100 * size // self.percent if size <= top else top
        return n - self.differ(size + partner) - empty

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        """By intersecting sorted arrays."""
        a, b = (x, y) if len(x) <= len(y) else (y, x)
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for c in chunks(column, SPACE_WORDS, lower=True):
        grams = c.grams(k)
        for a, b, i in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), range(len(c.bounds)), strict=False):
            yield np.unique(grams[a : b - k + 1]) if b - a >= k else c.whole(i) if b > a else grams[:0]


def node_of(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles ^ ODD).sum() + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def postings(shingles: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray, int]]:
    """(band, hashes of the parts, empty parts) of a set in all its bands.

    Where ``agree`` leaves a linked partner no part that is not empty, both may lack one, so empty parts are posted too.
    If only one of two linked nodes is of that kind, they still share a part that is not empty, and both post that.
    """
    out = []
    for band in bands.of(len(shingles)):
        n, _ = bands.parts(band)
        if not n:
            continue
        part = (shingles % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mix(shingles[order]), starts)
        own = part[starts]
        missing = n - len(own)
        if bands.agree(band, len(shingles), missing) < 1:
            empty = np.setdiff1d(np.arange(n), own, assume_unique=True)
            own, sums = np.concatenate((own, empty)), np.concatenate((sums, np.zeros(len(empty), dtype=np.uint64)))
        out.append((band, mix(sums + own.astype(np.uint64) * STEP + np.uint64(band)), missing))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """Parity bitmap of two to four bits for each shingle; its length is a power of two, so that halves can be folded.

    Of d differing shingles, half of ``bits * (1 - exp(-2 * d / bits))`` bits differ on average, so all but pairs near
    the threshold are told apart.
    """
    bits = max(MIN_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def members_of(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """tm_id, tm_text (the text's key), n, node of every document; the node is null without shingles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes = [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64())], ["tm_id", "tm_text", "n", "node"])

    own = docs.select(F.col(doc_id).alias("tm_id"), text_key(F.col(text)).alias("tm_text"), F.col(text))
    return own.mapInArrow(read, f"tm_id {own.schema['tm_id'].dataType.simpleString()}, tm_text long, n long, node long")


def _posted(docs: DataFrame, text: str, k: int, bands: Bands, bitmap: np.ndarray | None) -> DataFrame:
    """(hash, n) of all postings, or (post, node) of those the bitmap holds. Equal sets post once in a task.

    In the second form a node is left out of a band in which it shares too few of its parts to link with anything.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        posts, nodes, held = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0

        def send() -> pa.RecordBatch:
            post, node = np.concatenate(posts), np.concatenate(nodes)
            del posts[1:], nodes[1:]
            return counted(post) if bits is None else pa.RecordBatch.from_arrays([pa.array(post.view(np.int64)), pa.array(node)], ["post", "node"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= KEPT_NODES:
                    seen.clear()
                seen.add(node)
                for band, own, empty in postings(s, bands):
                    if bits is not None:
                        own = own[holds(bits.value, own)]
                        if len(own) < bands.agree(band, len(s), empty):
                            continue
                    posts.append(own)
                    nodes.append(np.full(len(own), node))
                    held += len(own)
                if held > HELD:
                    yield send()
                    held = 0
        yield send()

    return docs.select(text).mapInArrow(read, COUNTED if bits is None else "post long, node long")


def tiles_of(docs: DataFrame, text: str, k: int, bands: Bands) -> DataFrame:
    """(post, node, blocks) of tiles of two nodes or more, one tile for each set of members."""
    bitmap = repeated(_posted(docs, text, k, bands, None))
    release(docs.sparkSession)
    posted = stage(_posted(docs, text, k, bands, bitmap).distinct(), "jaccard-posted")
    tiles = posted.groupBy("post").agg(F.count("*").alias("c"), F.sum(F.shiftright(F.xxhash64("node"), 16)).alias("s"), F.sum(F.shiftright(F.xxhash64(F.lit(7), "node"), 16)).alias("s2")).where("c >= 2")
    tiles = tiles.groupBy("c", "s", "s2").agg(F.min("post").alias("tile"))
    tiles = stage(tiles.select("tile", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "jaccard-tiles")
    members = stage(posted.join(small(tiles), F.col("post") == F.col("tile")).select("post", "node", "blocks"), "jaccard-members")
    release(docs.sparkSession, posted, tiles)
    return members


def marks_of(docs: DataFrame, members: DataFrame, nodes: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(node, n, bits, shingles) of the given nodes, from one document of each."""
    first = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("tm_id", "tm_text")).alias("d"))
    first = stage(first, "jaccard-nodes").join(nodes, "node", "left_semi")  # copies of a hot text meet in partial aggregates
    first = small(stage(first.select(F.col("d.tm_id").alias("tm_id"), F.col("d.tm_text").alias("tm_text")), "jaccard-first"))
    own = docs.select(F.col(doc_id).alias("tm_doc"), F.col(text).alias("tm_raw"), text_key(F.col(text)).alias("tm_key"))
    chosen = own.join(first, own["tm_doc"].eqNullSafe(first["tm_id"]) & (own["tm_key"] == first["tm_text"]), "left_semi").select("tm_raw")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes, bytes]] = []
        held = 0

        def send() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "n", "bits", "shingles"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                rows.append((node_of(s), len(s), signature(s), s.tobytes()))
                held += len(rows[-1][2]) + len(rows[-1][3])
                if held > HELD_BYTES:
                    yield send()
                    held = 0
        yield send()

    return stage(chosen.distinct().mapInArrow(read, "node long, n long, bits binary, shingles binary"), "jaccard-marks")


def within_bound(sizes: np.ndarray, bits: list[bytes], percent: int, left: np.ndarray | None, parts: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the later ones it may link with: bit counts leave enough overlap, and parts differ (if given).

    left: which members are of the first of two blocks; then only pairs across the blocks.
    """
    width = min(map(len, bits))
    folded = []
    for b in bits:
        x = np.frombuffer(b, dtype=np.uint64)
        while len(x) * 8 > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        folded.append(x)
    matrix = np.array(folded)
    for i in range(len(sizes) - 1):
        later = np.arange(i + 1, len(sizes))
        n, m = sizes[i], sizes[later]
        ok = percent * np.maximum(n, m) <= 100 * np.minimum(n, m)
        if left is not None:
            ok &= left[later] != left[i]
        if parts is not None:
            ok &= parts[later] != parts[i]
        later = later[ok]
        if len(later):
            differ = np.bitwise_count(matrix[later] ^ matrix[i]).sum(axis=1, dtype=np.int64)
            yield i, later[differ * (100 + percent) <= (n + sizes[later]) * (100 - percent)]


def forest_meetings(tiles: DataFrame) -> DataFrame:
    """(post, i, j, left, part, node): each block of a tile meets itself and a few nodes of other blocks, its pivots."""
    rows = tiles.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pivots = rows.where((F.col("blocks") > 1) & (F.col("i") < PIVOTS)).groupBy("post", "i").agg(F.min("node").alias("node"), F.min("blocks").alias("blocks"))
    pivots = pivots.select("post", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "node")
    rows = rows.select("post", "i", "node").unionByName(pivots)
    return rows.select("post", "i", F.col("i").alias("j"), F.lit(None).cast("boolean").alias("left"), F.col("node").alias("part"), "node")


def open_meetings(tiles: DataFrame, connected: DataFrame) -> DataFrame:
    """(post, i, j, left, part, node) of tiles whose nodes are in several components (parts) still.

    The nodes of a tile's largest part are its majority; they need not meet each other. Each of their blocks (i = -1)
    meets all other nodes of the tile, and the blocks of those others meet pairwise.
    """
    named = stage(tiles.join(connected, "node", "left").select("post", "node", F.coalesce("component", "node").alias("part")), "jaccard-named")
    parts = named.groupBy("post", "part").agg(F.count("*").alias("n")).groupBy("post")
    parts = parts.agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.select(F.col("post").alias("open"), F.col("most.part").alias("major"), blocks(F.col("most.n")).alias("many"), blocks(F.col("n") - F.col("most.n")).alias("few"))
    parts = stage(parts, "jaccard-open")  # an aggregate right below a join would keep a large tile in one task
    major = F.col("part") == F.col("major")
    rows = named.join(parts, F.col("post") == F.col("open")).withColumn("block", F.pmod(F.xxhash64("node"), F.when(major, F.col("many")).otherwise(F.col("few"))).cast("int"))
    across = F.when(major, F.array("block")).otherwise(F.sequence(F.lit(0), F.col("many") - 1))
    across = rows.select("post", F.lit(-1).alias("i"), F.explode(across).alias("j"), (~major).alias("left"), "part", "node")
    others = rows.where(~major).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return across.unionByName(others.select("post", i.alias("i"), j.alias("j"), F.when(i != j, F.col("block") == i).alias("left"), "part", "node"))


def candidates(meetings: DataFrame, marks: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b) within the bound: a spanning forest of each meeting, or all its pairs of different parts."""
    rows = meetings.join(marks.select("node", "n", "bits"), "node").select("post", "i", "j", "left", "part", "node", "n", "bits")
    rows = rows.repartition("post", "i", "j").sortWithinPartitions("post", "i", "j", "node")

    def tile(group: list[tuple]) -> Iterator[tuple[int, int]]:
        left, part, node, n, bits = zip(*group, strict=True)
        sides = np.array(left, dtype=bool) if left[0] is not None else None
        roots = list(range(len(node)))

        def root(x: int) -> int:
            while roots[x] != x:
                roots[x] = x = roots[roots[x]]
            return x

        for i, later in within_bound(np.array(n), list(bits), percent, sides, None if forest else np.array(part)):
            for j in later.tolist():
                a, b = root(i), root(j)
                if not forest:
                    yield node[i], node[j]
                elif a != b:
                    roots[max(a, b)] = min(a, b)
                    if node[i] != node[j]:  # a pivot is in its own block twice
                        yield node[i], node[j]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def send() -> pa.RecordBatch:
            pairs = np.array(out or np.zeros((0, 2)), dtype=np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=2**63 - 1)), pa.array(pairs.max(axis=1, initial=-(2**63)))], ["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != now:
                    if len(group) > 1:
                        out.extend(tile(group))
                    if len(out) > 100_000:
                        yield send()
                    now, group = row[:3], []
                group.append(row[3:])
        if len(group) > 1:
            out.extend(tile(group))
        yield send()

    return rows.mapInArrow(read, "a long, b long").distinct()


def verified(pairs: DataFrame, marks: DataFrame, bands: Bands) -> DataFrame:
    """(a, b) with linked. Sets move once for each pair they are in; what is in no pair stays where it is."""
    pairs = stage(pairs, "jaccard-pairs")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("end"))
    sets = marks.join(small(ends), F.col("node") == F.col("end")).groupBy("a", "b").agg(F.collect_list("shingles").alias("sets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [bands.linked(*[np.frombuffer(v, dtype=np.uint64) for v in both.as_py()]) for both in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return sets.mapInArrow(read, "a long, b long, linked boolean")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """tm_id, tm_text, n_shingles, component_id of every row of docs."""
    bands = Bands(percent)
    members = stage(members_of(docs, doc_id, text, k), "jaccard-members-of")
    tiles = tiles_of(docs, text, k, bands)
    marks = marks_of(docs, members, tiles.select("node").distinct(), doc_id, text, k)
    first = stage(verified(candidates(forest_meetings(tiles), marks, percent, True), marks, bands), "jaccard-verified")
    links = first.where("linked").select("a", "b")
    named = components(links)
    split = tiles.where("blocks > 1")
    if not first.where("not linked").isEmpty() or not split.isEmpty():
        # a node of undivided tiles that was in no pair within the bound then is in none now
        nodes = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(split.select("node")).distinct()
        open_tiles = tiles.join(small(stage(nodes, "jaccard-open-nodes")), "node", "left_semi").select(*tiles.columns)
        again = candidates(open_meetings(open_tiles, named), marks, percent, False).join(first, ["a", "b"], "left_anti")
        more = stage(verified(again, marks, bands).where("linked").select("a", "b"), "jaccard-verified")
        if not more.isEmpty():
            named = components(links.unionByName(more))
    named = stage(named, "jaccard-components")
    release(docs.sparkSession, tiles, marks, first)
    whole = members.join(named, "node", "left").select("tm_id", "tm_text", "n", F.coalesce("component", "node").alias("component"))
    names = whole.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("tm_id").alias("component_id"))
    names = stage(names, "jaccard-names")  # an aggregate right below a join would keep a large component in one task
    out = whole.join(names, "component", "left")
    return out.select("tm_id", "tm_text", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("tm_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less every document but the smallest doc_id of its component (rows that repeat that doc_id stay)."""
    found = jaccard_components(docs, doc_id, text, k, percent)
    gone = found.where(~F.col("tm_id").eqNullSafe(F.col("component_id"))).select("tm_id", "tm_text")
    gone = small(stage(gone, "jaccard-gone"))
    own = docs.withColumn("tm_key", text_key(F.col(text)))
    return own.join(gone, own[doc_id].eqNullSafe(gone["tm_id"]) & (own["tm_key"] == gone["tm_text"]), "left_anti").select(*docs.columns)
