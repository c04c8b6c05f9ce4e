"""Cutting texts into lines, windows, comments and code regions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line); a trailing line end gives an empty last line."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return docs.select(key, F.posexplode(split).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def line_count(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 80, step: int = 4, min_lines: int = 5) -> DataFrame:
    """(key, start, end): windows of up to ``size`` lines every ``step`` lines; short tails of min_lines or more stay."""
    n = docs.select(key, line_count(F.col(text)).alias("n"))
    starts = n.select(key, "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(step))).alias("start"))
    out = starts.select(key, "start", F.least(F.col("n"), F.col("start") + size - 1).alias("end"))
    return out.where(F.col("end") - F.col("start") + 1 >= min_lines)


def range_text(text: Column, start: Column, end: Column, joiner: str = "\n") -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), start, end - start + 1), joiner)


def padded(start: Column, end: Column, n: Column, pad: int) -> tuple[Column, Column]:
    """A range with ``pad`` lines on either side, inside 1 to n."""
    return F.greatest(F.lit(1), start - pad), F.least(n, end + pad)


def resized(start: Column, end: Column, n: Column, min_lines: int, max_lines: int) -> tuple[Column, Column]:
    """Grown on both sides to min_lines, then cut at the end to max_lines."""
    grow = F.greatest(F.lit(0), F.ceil((min_lines - (end - start + 1)) / 2).cast("int"))
    s, e = F.greatest(F.lit(1), start - grow), F.least(n, end + grow)
    return s, F.when(e - s + 1 > max_lines, s + max_lines - 1).otherwise(e)


def line_comments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, text) of // comments to the end of their lines."""
    found = lines(docs, key, text).select(key, F.col("line_no").alias("line"), F.regexp_extract("line", r"//\s*(.+)$", 1).alias("text"))
    return found.where(F.col("text") != "")


def block_comments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, text) of /* */ comments at their first lines, stars and line ends collapsed."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"/\*", -1)
    spread = docs.select(key, parts.alias("parts")).select(key, "parts", F.posexplode("parts").alias("i", "part")).where("i > 0 and contains(part, '*/')")
    before = F.array_join(F.slice("parts", F.lit(1), F.col("i")), "/*")
    body = F.trim(F.regexp_replace(F.substring_index("part", "*/", 1), r"\s*\*\s*", " "))
    return spread.select(key, F.size(F.split(before, "\n", -1)).alias("line"), body.alias("text"))


def preceding_comments(docs: DataFrame, ranges: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 3) -> DataFrame:
    """ranges with ``comments``: of the ``reach`` lines before start, those that hold //, /* or a star."""
    split = docs.select(key, F.split(F.col(text), "\n", -1).alias("tm_lines"))
    above = F.slice("tm_lines", F.greatest(F.lit(1), F.col("start") - reach), F.least(F.lit(reach), F.greatest(F.col("start") - 1, F.lit(0))))
    return ranges.join(split, key).withColumn("comments", F.array_join(F.filter(above, lambda x: F.rlike(x, F.lit(r"//|\*"))), " ")).drop("tm_lines")


REGION = "seq int, start int, end int, kind string, name string, is_function boolean, is_class boolean, is_top_level boolean, parent_seq int"
HEAD = re.compile(
    r"(?:(?P<class>\bclass\s+(?P<class_name>\w+))"
    r"|(?P<function>\bfunction\b\s*\*?\s*(?P<function_name>\w*)\s*\()"
    r"|(?P<arrow>\b(?:const|let|var)\s+(?P<arrow_name>\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>)"
    r"|(?P<route>\b(?P<app>\w+)\.(?P<verb>get|post|put|patch|delete|use|all)\s*\(\s*(?P<path>['\"][^'\"]*['\"]|\())"
    r"|(?P<method>^[ \t]*(?:async\s+|static\s+|get\s+|set\s+)*(?P<method_name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+)\s*\([^()]*\)\s*\{)"
    r"|(?P<property>^[ \t]*(?P<property_name>\w+)\s*:\s*[\[{(])"
    r"|(?P<statement>^(?:const|let|var)\s+(?P<statement_name>\w+)\b))",
    re.M,
)


def blanked(code: str) -> str:
    """The code with strings, templates, regular expressions and comments replaced by blanks of the same shape."""
    out, i, n, last = list(code), 0, len(code), ""

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c, two = code[i], code[i : i + 2]
        if two == "//":
            j = code.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
        elif two == "/*":
            j = code.find("*/", i + 2)
            j = n if j < 0 else j + 2
            blank(i, j)
        elif c in "'\"`":
            j = i + 1
            while j < n and code[j] != c and (c == "`" or code[j] != "\n"):
                j += 2 if code[j] == "\\" else 1
            j = min(n, j + 1)
            blank(i + 1, j - 1)
            last = c
        elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%<>~^"):
            j, inside = i + 1, False
            while j < n and code[j] != "\n" and (inside or code[j] != "/"):
                inside = code[j] == "[" or (inside and code[j] != "]")
                j += 2 if code[j] == "\\" else 1
            j = min(n, j + 1)
            blank(i + 1, j - 1)
            last = c
        else:
            j = i + 1
            if not c.isspace():
                last = c
        i = j
    return "".join(out)


def scan_regions(code: str) -> list[dict]:
    """Functions, classes, methods, routes, long properties and top-level declarations of a script, by a scan of heads and brackets."""
    flat = blanked(code)
    close: dict[int, int] = {}
    stack: list[int] = []
    depth = [0] * (len(flat) + 1)
    for i, c in enumerate(flat):
        depth[i] = len(stack)
        if c in "([{":
            stack.append(i)
        elif c in ")]}" and stack:
            close[stack.pop()] = i
            depth[i] = len(stack)
    starts = [0, *[i + 1 for i, c in enumerate(flat) if c == "\n"]]
    import bisect

    line = lambda i: bisect.bisect_right(starts, i)
    found = []
    for m in HEAD.finditer(flat):
        kind = m.lastgroup if m.lastgroup in ("class", "function", "arrow", "route", "method", "property", "statement") else next(k for k in ("class", "function", "arrow", "route", "method", "property", "statement") if m[k])
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if kind == "route":
            opening = flat.index("(", m.end("verb"))
        elif kind == "property":
            opening = m.end() - 1
        elif kind == "statement":
            stop = re.compile(r"[;\n]").search(flat, m.end())
            opening = next((i for i in range(m.end(), stop.start() if stop else len(flat)) if flat[i] in "([{"), -1)
        else:
            opening = flat.find("{", m.end() - 1 if kind == "method" else m.end())
            if kind == "arrow" and flat[m.end() :].lstrip()[:1] != "{":
                opening = -1
        end = close.get(opening, -1) if opening >= 0 else m.end() - 1
        if end < 0:
            continue
        name = {"route": lambda: f"{m['app']}.{m['verb']}({code[m.start('path') : m.end('path')]}", "class": lambda: m["class_name"], "function": lambda: m["function_name"], "arrow": lambda: m["arrow_name"], "method": lambda: m["method_name"], "property": lambda: m["property_name"], "statement": lambda: m["statement_name"]}[kind]()
        name = name + ")" if kind == "route" and not name.endswith("(") else name
        s, e = line(at), line(end)
        if kind == "property" and e - s <= 2:
            continue
        if kind == "function" and any(r["kind"] == "route" and r["start"] == s for r in found):
            continue  # the callback of a route on its own line is part of the route
        found.append({"start": s, "end": e, "kind": kind, "name": name or None, "is_function": kind in ("function", "arrow", "method"), "is_class": kind == "class", "is_top_level": depth[at] == 0})
    for i, r in enumerate(found):
        around = [j for j, p in enumerate(found) if j != i and p["start"] <= r["start"] and p["end"] >= r["end"] and (p["end"] - p["start"] > r["end"] - r["start"] or j < i)]
        r["seq"], r["parent_seq"] = i, min(around, key=lambda j: (found[j]["end"] - found[j]["start"], j), default=None)
    return found


def regions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, start, end, kind, name, flags, parent_seq) of the code regions of each text; none where nothing is found."""
    import pyarrow as pa

    columns = [x.split()[0] for x in REGION.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, code in enumerate(batch.column(1)):
                for r in scan_regions(code.as_py() or ""):
                    at.append(i)
                    rows.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True)]], [key, *columns])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {REGION}")


def smallest_enclosing(ranges: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """ranges with block_start, block_end of the smallest block of the key around them (ties: the first), null if none."""
    from tidemark.operators.joins import range_join

    b = blocks.select(key, F.col("start").alias("block_start"), F.col("end").alias("block_end")).distinct()
    around = range_join(b, ranges.select(key, "start", "end").distinct(), key, "block_start", "block_end", "start").where("block_end >= end")
    best = around.groupBy(key, "start", "end").agg(F.min(F.struct((F.col("block_end") - F.col("block_start")).alias("size"), "block_start", "block_end")).alias("b"))
    return ranges.join(best.select(key, "start", "end", "b.block_start", "b.block_end"), [key, "start", "end"], "left")


def smart_range(found: DataFrame, max_lines: int) -> tuple[Column, Column]:
    """start and end after growing to the enclosing block: whole if it fits, else the middle of the range in it."""
    start, end, bs, be = (F.col(c) for c in ("start", "end", "block_start", "block_end"))
    mid, half = F.floor((start + end) / 2).cast("int"), max_lines // 2
    fits = be - bs + 1 <= max_lines
    s = F.when(bs.isNull(), start).when(fits, bs).otherwise(F.greatest(bs, mid - half))
    return s, F.when(bs.isNull(), end).when(fits, be).otherwise(F.least(be, mid + half))
