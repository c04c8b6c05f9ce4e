"""Quality rules as a learned decision list.

Statistics of every whole text come from one Arrow pass. A decision list is learned from the statistics of labelled
documents by sequential covering: each rule is grown, threshold by threshold, on two thirds of the labelled rows (the
condition with the highest information gain is added until the rule covers no document of the other class), then
pruned from its end on the other third to the beginning with the largest p - n, n weighted as in the gain by
``GOOD_COST``. A beginning may come with an exception: a rule for the class it does not cover, grown and pruned in the
same way on the rows it covers, which goes before it. So rules keep or reject, and their order matters. Rows that rules
cover leave, and the next rule is learned from the rest, until none has a precision (after Laplace) of
``MIN_PRECISION`` on the pruning rows. The list becomes one ordered Spark conditional expression (``CASE WHEN``), which
is then applied to all documents.

Learning uses at most ``max_labelled`` labelled documents, those with the smallest hash of their doc_id (a documented
bound; scoring and statistics cover every document).

Statistics (long): n_words of ``[^\\x20\\x09-\\x0D]+``; word_chars, code points in words; n_symbols, characters of
``[#*$%&|<>]``; n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words in a window of three
words found twice or more in the text; n_upper, n_marks (``[!?]``), n_digits.

Defined results: a null text has no words and fails the base rules; labels that are null, or whose doc_id is null or
in no document, are not used; repeated labels count once, and if a labelled doc_id is repeated, the first of its texts
in order counts; with labels of one class only the list is empty
and base rules decide alone; repeated rows and doc_ids each get their row; an empty table gives an empty result; other
columns pass through untouched (statistics replace columns of the same name).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm._shared import with_fields
from tidemark.llm._words import SPACE_WORDS, chunks, mix, powers, table

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits"]
SYMBOLS, UPPER, MARKS, DIGITS = (table(keep=bytes(x, "ascii")) for x in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?", "0123456789"))
#: Bytes that begin a code point.
LEADING = np.array([b & 0xC0 != 0x80 for b in range(256)])

#: What rules compare: names to Spark expressions over the statistics; the base is never zero.
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "words": "cast(n_words as double)",
}
MIN_PRECISION, MAX_RULES, MAX_CONDITIONS, CUTS = 0.8, 12, 4, 48
#: A good document rejected counts as this many bad ones kept.
GOOD_COST = 5


def statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with STATISTICS, and without text unless keep_text."""
    at = docs.columns.index(text)
    keep = [c for c in docs.columns if (keep_text or c != text) and c not in STATISTICS]
    where = [docs.columns.index(c) for c in keep]
    schema = with_fields(StructType([docs.schema[c] for c in keep]), ", ".join(f"{c} long" for c in STATISTICS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in STATISTICS]
            for c in chunks(batch.column(at), SPACE_WORDS):
                lines = next(chunks_of_lines(c))
                totals = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[c.texts])
                inside = np.zeros(len(c.data) + 1, dtype=np.int8)
                inside[c.starts] = 1
                np.subtract.at(inside, c.ends[c.ends < len(c.data)], 1)
                inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
                n = np.diff(c.bounds)
                values = [n, totals(inside & LEADING[c.data]), totals(SYMBOLS[c.data]), lines, repeated(c), totals(UPPER[c.data]), totals(MARKS[c.data]), totals(DIGITS[c.data])]
                for col, v in zip(out, values, strict=True):
                    col.append(v.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in where], *[pa.array(np.concatenate(x)) for x in out]], [*keep, *STATISTICS])

    return docs.mapInArrow(run, schema)


def within_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that tell texts apart."""
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def repeated(c) -> np.ndarray:
    """Words of each text that stand in a window of three found twice or more in it."""
    n = np.diff(c.bounds)
    out = np.zeros(len(n), dtype=np.int64)
    grams = c.grams(3)
    if len(grams):
        owner = np.repeat(np.arange(len(n)), n)
        own = owner[: len(grams)] == owner[2:]
        places = np.flatnonzero(own)
        keys = within_text(grams[places], owner[places])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        words = np.zeros(len(c.hashes), dtype=bool)
        for j in range(3):
            words[places[twice] + j] = True
        out += np.bincount(owner[words], minlength=len(n))
    return out


def chunks_of_lines(c) -> Iterator[np.ndarray]:
    """For the texts of a chunk: lines with a word that equal an earlier line of the text, byte by byte."""

    m, n = len(c.data), len(c.texts) - 1
    stops = np.flatnonzero(c.data == 10)
    starts = np.unique(np.concatenate((c.texts[:-1], stops + 1)))
    starts = starts[starts < m]
    ends = np.minimum(np.searchsorted(stops, starts), len(stops))
    ends = np.where(ends < len(stops), stops[np.minimum(ends, max(len(stops) - 1, 0))] if len(stops) else m, m)
    owner = np.searchsorted(c.texts, starts, "right") - 1
    ends = np.minimum(ends, c.texts[owner + 1])
    up, down = powers(m + 1)
    sums = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum((c.data.astype(np.uint64) + np.uint64(1)) * up[:m], out=sums[1:])
    filled = np.searchsorted(c.starts, ends) > np.searchsorted(c.starts, starts)
    keys = within_text(mix((sums[ends] - sums[starts]) * down[starts]), owner)[filled]
    owner = owner[filled]
    seen = np.zeros(n, dtype=np.int64)
    if len(keys):
        _, first = np.unique(keys, return_index=True)
        later = np.ones(len(keys), dtype=bool)
        later[first] = False
        seen += np.bincount(owner[later], minlength=n)
    yield seen


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= F.lit(self.value) if self.at_least else x < F.lit(self.value)

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for c in self.conditions:
            out &= c.hits(x)
        return out


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each keeping or rejecting the documents it is the first to cover; the default keeps."""

    rules: tuple[tuple[Rule, bool], ...]

    def column(self) -> Column:
        """True to keep."""
        out = None
        for rule, keep in self.rules:
            out = (F if out is None else out).when(rule.column(), F.lit(keep))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), dtype=bool)
        open_rows = ~out
        for rule, keep in self.rules:
            hit = open_rows & rule.hits(x)
            out |= hit & (not keep)
            open_rows &= ~hit
        return out


def _grow(x: dict[str, np.ndarray], target: np.ndarray, cost: float) -> Rule:
    """Add the condition of highest gain until only the target class is covered; others weigh ``cost``."""
    rule, covered = (), np.ones(len(target), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (covered & ~target).any():
        p0, n0 = (covered & target).sum(), (covered & ~target).sum()
        best, best_gain = None, 1e-9
        base = math.log2(p0 / (p0 + cost * n0))
        for f in sorted(x):
            values = np.unique(x[f][covered])
            # thresholds half-way between neighbouring values; quantiles of them where there are many
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > CUTS:
                cuts = cuts[np.unique(np.linspace(0, len(cuts) - 1, CUTS).round().astype(int))]
            for cut in cuts:
                up = covered & (x[f] >= cut)
                for at_least, hit in ((True, up), (False, covered & ~up)):
                    p, n = (hit & target).sum(), (hit & ~target).sum()
                    if p and (gain := p * (math.log2(p / (p + cost * n)) - base)) > best_gain:
                        best, best_gain = Condition(f, at_least, float(cut)), gain
        if best is None:
            break
        rule, covered = (*rule, best), covered & best.hits(x)
    return Rule(rule)


def _gain(hit: np.ndarray, target: np.ndarray, cost: float) -> tuple[float, float]:
    """p - n with n weighted, and the precision after Laplace, so that a rule needs support as well."""
    p, n = (hit & target).sum(), (hit & ~target).sum()
    return float(p - cost * n), (p + 1) / (p + n + 2)


def _covering(x: dict[str, np.ndarray], target: np.ndarray, fold: np.ndarray, rows: np.ndarray, cost: float, exceptions: bool) -> list[Rule]:
    """[rule] for the target class or [exception, rule], grown on one part of the rows and pruned on the other; [] if none is precise enough.

    Each beginning of the grown rule is weighed as it is and, if exceptions, less what a rule for the other class takes
    out of its rows.
    """
    grow, prune = rows & fold, rows & ~fold
    if not (target & grow).any() or not (target & prune).any() or target[rows].all():
        return []
    grown = _grow({k: v[grow] for k, v in x.items()}, target[grow], cost).conditions
    best: list[Rule] = []
    most = (-math.inf, 0)
    for k in range(1, len(grown) + 1):
        rule = Rule(grown[:k])
        covered = rows & rule.hits(x)
        other = _covering(x, ~target, fold, covered, 1, False) if exceptions else []
        other = [Rule((*rule.conditions, *r.conditions)) for r in other]  # it excepts nothing else
        for found in [[rule], [*other, rule]] if other else [[rule]]:
            hit = covered & ~found[0].hits(x) if len(found) > 1 else covered
            gain, precision = _gain(hit[prune], target[prune], cost)
            size = (gain, -sum(len(r.conditions) for r in found))
            if precision >= MIN_PRECISION and size > most:
                best, most = found, size
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> DecisionList:
    """fold: True for rows to grow rules on, False for rows to prune them on."""
    rules: list[tuple[Rule, bool]] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        found = _covering(x, bad, fold, left, GOOD_COST, True)
        if not found:
            break
        rules += [(r, r is not found[-1]) for r in found]
        for r in found:
            left &= ~r.hits(x)
    return DecisionList(tuple(rules))


def labelled_statistics(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_labelled: int) -> DataFrame:
    """Features, bad (quality 0) and fold of the chosen labelled documents."""
    rows = labels.select(F.col(doc_id).alias("tm_id"), F.col(label).cast("int").alias("tm_label")).where(F.col("tm_id").isNotNull() & F.col("tm_label").isNotNull())
    rows = rows.distinct().orderBy(F.xxhash64("tm_id"), "tm_id", "tm_label").limit(max_labelled)
    own = docs.select(F.col(doc_id).alias("tm_doc"), F.col(text).alias("tm_raw"))
    own = own.join(F.broadcast(rows), own["tm_doc"] == rows["tm_id"])  # max_labelled rows at most
    # one text for each label, however often its doc_id is repeated, so that what is collected is bounded as well
    own = own.groupBy("tm_id", "tm_label").agg(F.min("tm_raw").alias("tm_raw"))
    return statistics(own, "tm_raw").select(
        *STATISTICS, *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()], (F.col("tm_label") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("fold"), "tm_id"), F.lit(3)) > 0).alias("fold"), F.col("tm_id")
    )


def learn_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 6000) -> DecisionList:
    pdf = labelled_statistics(docs, labels, doc_id, text, label, max_labelled).toPandas().sort_values(["tm_id", *FEATURES])
    if pdf.empty:
        return DecisionList(())
    return learn({f: pdf[f].to_numpy(dtype=float) for f in FEATURES}, pdf["bad"].to_numpy(dtype=bool), pdf["fold"].to_numpy(dtype=bool))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 6000) -> DataFrame:
    """docs without text, with STATISTICS, base_failed and kept."""
    rules = learn_quality(docs, labels, doc_id, text, label, max_labelled)
    out = statistics(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.column())
