"""Token counts through a digest cache.

A text's cache key is the SHA-256 of its normalised content (null as empty; nothing else may change, or the count
would) and the SHA-256 of the tokenizer file with its library's version. Documents are joined to stored counts by that
key; of the texts not found, one document per distinct digest is encoded, and the counts are appended to the cache.
The cache is a folder of Parquet files, partitioned by the tokenizer's digest; entries are never changed, and repeated
entries are equal, so a job that is run again after a failure does no harm.

Encoding: the merges of a piece vocabulary cannot cross the place before a space when no piece has a space mark after
another character (checked when the model is loaded). Texts are then cut there, and a count is the sum over its cuts,
each encoded once per worker and kept in a bounded table. Other models, and texts that hold the mark itself, are
encoded whole. Either way the count is that of the whole text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and doc_ids each get their row; an
empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import new_path, small, stage

#: Cuts kept by a worker; the table is emptied beyond that.
KEPT_CUTS = 250_000
MARK = "▁"
CUT = re.compile(r" *[^ ]+| +$")


def tokenizer_digest(path: str) -> str:
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts as the file's library does; loaded once per worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    cuts = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
    cuts = cuts and proto.trainer_spec.model_type == 2 and not any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode(texts, num_threads=1)] if texts else []

    known: dict[str, int] = {}

    def by_cuts(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if MARK in text or not text:
                out += whole([text])
                continue
            parts = CUT.findall(" " + text)
            new = list({p for p in parts if p not in known})
            if new:
                if len(known) + len(new) > KEPT_CUTS:
                    known.clear()
                    new = list(set(parts))
                known.update(zip(new, whole([p[1:] for p in new]), strict=True))
                if " " in known:  # a single space alone: the model adds none to an empty text
                    known[" "] = 1
            out.append(sum(map(known.__getitem__, parts)))
        return out

    return by_cuts if cuts else whole


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            counts = count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", cache: str | None = None) -> DataFrame:
    """docs with n_bytes and n_tokens (long) added. cache: a folder to read and append to; a new one if None."""
    spark = docs.sparkSession
    raw, version_digest = F.coalesce(F.col(text), F.lit("")), tokenizer_digest(tokenizer)
    digest = F.unhex(F.sha2(raw.cast("binary"), 256))
    docs = docs.drop(*[c for c in ("n_bytes", "n_tokens") if c in docs.columns])
    key, n_bytes = f"tm-{uuid.uuid4().hex}", F.octet_length(raw).cast("long")
    keyed = docs.withColumns({key: digest, "n_bytes": n_bytes})  # before the joins, which then need no text
    store = f"{cache or new_path(spark, 'token-cache')}/tokenizer={version_digest}"
    schema = "digest binary, n_tokens long"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(schema).parquet(store).dropDuplicates(["digest"]) if found else None

    # of each digest that is not stored, the smallest doc_id and its rows; other doc_ids of the digest are left out when encoding
    misses = docs.select(digest.alias("tm_digest"), F.col(doc_id).alias("tm_id"))
    if stored is not None:
        misses = misses.join(stored, misses["tm_digest"] == stored["digest"], "left_anti")
    rows = misses.groupBy("tm_digest", "tm_id").agg(F.count("*").alias("rows")).groupBy("tm_digest")
    first = rows.agg(F.min(F.struct("tm_id", "rows")).alias("d")).select("tm_digest", F.col("d.tm_id").alias("tm_first"), F.col("d.rows").alias("rows"))
    first = stage(first, "token-first")  # an aggregate right below a join would keep a hot digest in one task
    if stored is None:
        wanted = misses.join(first, "tm_digest").where(~F.col("tm_id").eqNullSafe(F.col("tm_first"))).select("tm_digest", "tm_id")
        how = "left_anti"
    else:
        wanted, how = first.select("tm_digest", F.col("tm_first").alias("tm_id")), "left_semi"
    right = small(stage(wanted, "token-wanted"), 64)
    left = docs.select(digest.alias("tm_digest"), F.col(doc_id).alias("tm_doc"), raw.alias("tm_raw"))
    chosen = left.join(right, (left["tm_digest"] == right["tm_digest"]) & left["tm_doc"].eqNullSafe(right["tm_id"]), how)
    again = first.where("rows > 1").select(F.col("tm_digest").alias("again"))
    if not again.isEmpty():  # rows that repeat doc_id and text: one of them
        again = small(again, 64)
        repeated = chosen["tm_digest"] == again["again"]
        chosen = chosen.join(again, repeated, "left_anti").unionByName(chosen.join(again, repeated, "left_semi").dropDuplicates(["tm_digest"]))
    encode_counts(chosen.select(F.col("tm_digest").alias("digest"), "tm_raw"), tokenizer).write.mode("append").parquet(store)

    counts = stage(spark.read.schema(schema).parquet(store).dropDuplicates(["digest"]), "token-counts")  # so that the join can split hot digests
    return keyed.join(counts, keyed[key] == counts["digest"], "left").select(*[keyed[c] for c in docs.columns], keyed["n_bytes"], counts["n_tokens"])
