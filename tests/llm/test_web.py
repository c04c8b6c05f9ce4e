"""WARC round trips and main-text extraction, with odd pages."""

import gzip
import hashlib
import html as entities
import json
import random
import re
import tracemalloc
from pathlib import Path

import pytest

from tidemark.llm import warc
from tidemark.llm import wrapper as W
from tidemark.llm.queries import op1_warc_transactions, op4_wrapper_text
from tidemark.llm.warc import assemble, captures, parse_archive, read_records, write_captures

PAGES = "page_id long, url string, html string"


def test_transactions_of_odd_pages(spark):
    big, small = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>" * 80, "<p>x</p>"
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (7, "http://b\r\nX: y", small), (8, "http://b", small), (9, "u", None), (10, "u", ""), (None, "n", "n" * 2000), (5, "http://a/5", big), (11, "z", "\r\n\r\n"), (12, "q" * 3000, "q" * 999)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    root = write_captures(pages)
    records = read_records(spark, root)
    assert records.count() == 3 * len(rows)
    nested = assemble(records)
    out = captures(nested).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    for page_id, url, html in rows:
        raw = (html or "").encode()
        for r in by[page_id]:
            assert r["url"] == url and r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in out if r["page_id"] in (1, 3, 5)) == [("1", "revisit", 5), ("3", "revisit", 5), ("5", "response", None), ("5", "response", None)]
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in out if r["page_id"] not in (1, 3, 5))
    payloads = {(r["m"][0]["fields"].get("page-id"), bytes(r["response"]["payload"])) for r in nested.selectExpr("metadata AS m", "response").collect() if r["response"]["type"] == "response"}
    assert ("5", big.encode()) in payloads and ("9", b"") in payloads and (None, b"n" * 2000) in payloads
    assert all(len(r["request"]) == 1 for r in nested.collect())
    assert captures(assemble(read_records(spark, write_captures(pages.limit(0))))).count() == 0


def test_revisits_name_their_response_record(spark):
    big = "<p>x</p>" * 300
    pages = spark.createDataFrame([(i, f"http://a/{i % 3}", big if i < 6 else "y" * 1500) for i in range(8)] + [(7, "http://a/1", "y" * 1500)], PAGES).repartition(3)
    nested = assemble(read_records(spark, write_captures(pages)))
    records = {r["capture_id"]: r["response"] for r in nested.select("capture_id", "response").collect()}
    assert len(records) == 9
    for r in records.values():
        if r["type"] == "revisit" and r["payload_bytes"] == len(big):
            assert records[r["refers_to"]]["type"] == "response" and records[r["refers_to"]]["payload"] == big.encode()
    out = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in captures(nested).collect())
    assert out == [(i, "revisit", 5) for i in range(5)] + [(5, "response", None), (6, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_long_pages_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(f"p{i}", "http://a/", "é" * n) for i, n in enumerate([10, 3_000_000, 20_000, 700_000, 700_000, 0])]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    root = write_captures(pages)
    assert all(sum(len(b) for _, b in parse_archive(f.read_bytes())) <= max(2**20, 6_002_000) for f in Path(root.removeprefix("file:")).glob("part-*"))
    out = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in captures(assemble(read_records(spark, root)), "string").collect()}
    assert out == {p: (len(h.encode()), "p4" if p == "p3" else None) for p, _, h in rows}


def test_archives_are_read_bit_by_bit():
    """A record of a large archive is there before the rest is decompressed."""
    record = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: 200000\r\n\r\n".encode() + bytes([i % 251]) * 200_000 + b"\r\n\r\n"
    raw = b"".join(gzip.compress(record(i)) for i in range(300))
    tracemalloc.start()
    assert sum(len(block) for _, block in parse_archive(raw)) == 300 * 200_000
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


def test_reader_takes_members_and_either_direction(spark, tmp_path):
    def record(kind, number, extra, block=b""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    parts = [record("warcinfo", 0, ""), record("request", 1, ""), record("response", 2, "WARC-Concurrent-To: <urn:1>\r\nContent-Type: application/http; msgtype=response\r\n", http), record("metadata", 3, "WARC-Concurrent-To: <urn:2>\r\nContent-Type: application/warc-fields\r\n", b"k: v\r\n"), record("request", 4, "WARC-Concurrent-To: <urn:99>\r\n")]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "part-1.warc").write_bytes(record("response", 8, "Content-Type: application/http\r\n", http))
    rows = {r["capture_id"]: r for r in assemble(read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<urn:2>", "<urn:8>"}
    one = rows["<urn:2>"]
    assert one["response"]["payload"] == b"body" and one["request"][0]["record_id"] == "<urn:1>" and one["metadata"][0]["fields"] == {"k": "v"}
    assert rows["<urn:8>"]["request"] == []
    with pytest.raises(ValueError):
        list(parse_archive(record("response", 1, "", b"abc")[:-8]))


def test_warc_query(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    newest = {}
    for p, raw in pages.items():
        newest[raw] = max(p, newest.get(raw, p))
    for r in op1_warc_transactions(spark, sf).collect():
        raw = pages[r["page_id"]]
        again = len(raw) >= 1000 and newest[raw] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", newest[raw] if again else None)


def article(html):
    """The article's blocks, for pages of the test tables."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer|\Z)", html)
    blocks = []
    for b in re.split(r"</?(?:p|h1)>", body.group(1) if body else ""):
        text = re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*(>|\Z)", " ", b))).strip()
        blocks += [text] if text else []
    return "\n".join(blocks)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_text_query(spark, sf, size):
    folder = sf.replace("0.001", size)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = op4_wrapper_text(spark, folder).collect()
    assert {r["page_id"]: r["text"] for r in out} == {p: article(h) for p, h in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def site(rng, i, body):
    menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in ("home", "news", "about"))
    return f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><div class=top>The Daily</div><ul>{menu}</ul><div id=main><h1>Title {i}</h1>{body}<div>Share this page</div></div><div class='side-notes'>All rights reserved</div><div class=comments><p>reader {i} says hi {rng.random()}</p></div></body></html>"


def test_template_without_semantic_tags(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for i in range(12):
        words = [f"Word{rng.randrange(10**6)} &amp; more\n text." for _ in range(1 + i % 4)]
        body = "".join(f"<p>{w} <b>bold</b>{i}</p>" if i % 2 else f"<p>{w} <b>bold</b>{i}" for w in words)
        rows.append((i, f"http://a.example/{i}", site(rng, i, body)))
        expected[i] = "\n".join([f"Title {i}", *[f"{w.replace('&amp;', '&').replace(chr(10), '')} bold{i}".replace("  ", " ") for w in words]])
    rows += [(100, "http://b.example/1", "<p>alone<p>here"), (101, None, None), (102, "http://c.example/", ""), (103, "http://a.example/x", "plain text"), (104, "http://d/", "<div>" * 3000 + "deep" + "</div>" * 3000), (105, "http://e/", "<p>cut <b"), (106, "http://f/", "a < b &lt; c"), (107, "http://g/", "<script>var x='</p>'</script><p>after</p><script>open"), (12, rows[3][1], rows[3][2])]
    expected |= {100: "alone\nhere", 101: "", 102: "", 103: "plain text", 104: "deep", 105: "cut", 106: "a < b < c", 107: "after", 12: expected[3]}
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    assert {r["page_id"]: r["text"] for r in W.extract(pages).collect()} == expected
    assert W.extract(pages.limit(0)).count() == 0


def test_matching_aligns_optional_nodes():
    a, b = (W.folded(W.parse(f"<body><div><h2>x</h2>{x}<p>y</p></div></body>")) for x in ("", "<ul><li>1<li>2</ul>"))
    assert W.matching(a, b) == W.matching(a, a)
    merged = W.merged(a, b)
    labels = [c[W.LABEL] for c in merged[W.CHILDREN][0][W.CHILDREN][0][W.CHILDREN]]
    assert labels == ["h2", "ul", "p"]


def texts(htmls):
    """The pages' texts by the wrapper of all of them, as one host."""
    template = None
    for h in htmls:
        page = W.folded(W.parse(h))
        template = page if template is None else W.merged(template, page)
    wrapper = json.loads(W.wrapper_of(template))
    return [W.extract_page(W.parse(h), wrapper) for h in htmls]


def wrapped(pages, change=lambda h: h, induce=True):
    """page_id to text by the wrappers of the pages' hosts (induce: else each page by itself), in plain Python."""
    hosts, out = {}, {}
    for r in pages:
        hosts.setdefault((r["url"] or "").split("/")[2] if induce else r["page_id"], []).append(r)
    for own in hosts.values():
        htmls = {W.content_key(W.parse(h)): h for h in (change(r["html"] or "") for r in own)}
        template = None
        for h in htmls.values():
            page = W.folded(W.parse(h))
            template = page if template is None else W.merged(template, page)
        wrapper = json.loads(W.wrapper_of(template))
        out |= {r["page_id"]: (len(htmls), W.extract_page(W.parse(change(r["html"] or "")), wrapper)) for r in own}
    return out


@pytest.mark.parametrize("names", [{}, {"nav": "content", "article": "search notice", "footer": "entry", "ad": "story"}])
def test_the_wrapper_decides_without_semantic_tags(spark, sf, names):
    """Menus, adverts and footers as bare or misnamed divs: the host's statistics find the article, a page alone does not."""

    def change(h):
        h = re.sub(r"<(nav|article|footer)>", lambda m: f'<div class="{names[m[1]]}">' if names else "<div>", h)
        return re.sub(r"</(nav|article|footer)>", "</div>", h).replace('class="ad"', f'class="{names.get("ad", "x")}"')

    pages = [r.asDict() for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    expected = {r["page_id"]: article(r["html"]) for r in pages}
    found, alone = wrapped(pages, change), wrapped(pages, change, induce=False)
    enough = [p for p, (n, _) in found.items() if n >= W.SUPPORT]
    assert len(enough) > 100 and all(found[p][1] == expected[p] for p in enough)
    assert sum(alone[p][1] == expected[p] for p in enough) < 0.1 * len(enough)


def alone(html):
    page = W.parse(html)
    return W.extract_page(page, json.loads(W.wrapper_of(W.folded(page))))


def test_words_in_names_do_not_drop_an_article():
    assert alone('<div class="search-results"><p>real text</p></div>') == "real text"
    assert alone('<article><h1>T</h1><p>a b c</p><p class="notice">important</p></article>') == "T\na b c\nimportant"
    assert alone('<article><h1>T</h1><p>a b c</p><div class="related-work"><p>earlier work</p></div></article>') == "T\na b c\nearlier work"
    assert alone('<body><div class="comments"><p>x</p></div><div class=a><h1>T</h1><p>a b c dd</p></div></body>') == "T\na b c dd"


def test_regular_link_slots_of_the_region_are_template():
    page = lambda i: f"<main><h1>t{i}</h1><p>a{i} <a href=/x>see</a></p><ul><li><a href=/1>next {i}</a><li><a href=/2>more {i}</a></ul></main>"
    assert texts([page(i) for i in range(6)]) == [f"t{i}\na{i} see" for i in range(6)]
    assert texts([page(i) for i in range(4)])[0].endswith("more 0")  # too few pages to tell


def test_templates_are_bounded():
    rng, template = random.Random(2), None
    for i in range(150):
        blocks = "".join(f"<div class=b{rng.randrange(10**6)}x><p>{i}</p></div>" for _ in range(20))
        page = W.folded(W.parse(f"<body><main><h1>t{i}</h1><p>text {i}</p></main>{blocks}</body>"))
        template = page if template is None else W.merged(template, page)
    assert len(json.dumps(template)) < 20_000


def test_runs_align_with_what_they_fold_to():
    long = [f"<main><h1>t{i}</h1><div><p>a{i}</p><ul><li>l{i}</ul></div><h2>More</h2><div><p>All rights reserved</p></div></main>" for i in range(6)]
    runs = [f"<main><h1>t{i}</h1><div><p>a{i}</p><ul><li>l{i}</ul></div><div><p>b{i}</p><ul><li>m{i}</ul></div></main>" for i in range(6, 10)]
    out = texts([f"<html><body>{x}</body></html>" for x in long + runs])
    assert out == [f"t{i}\na{i}\nl{i}" for i in range(6)] + [f"t{i}\na{i}\nl{i}\nb{i}\nm{i}" for i in range(6, 10)]


def test_only_the_constant_text_itself_is_template():
    pages = [f"<main><h1>t{i}</h1><p>a{i}</p><h2>More</h2></main>" for i in range(6)]
    template = None
    for h in pages:
        page = W.folded(W.parse(h))
        template = page if template is None else W.merged(template, page)
    other = "<main><h1>t</h1><p>a</p><h2>Own words</h2></main>"
    assert W.extract_page(W.parse(other), json.loads(W.wrapper_of(template))) == "t\na\nOwn words"


def test_copies_are_no_support(spark):
    page = lambda menu, i, more: f"<html><body><nav>{menu}</nav><main><h1>t{i}</h1><p>a{i}</p>{more}<div>Share</div></main></body></html>"
    copies = [page("menu" if k < 6 else f"menu {k}", 0, "<ul><li>own<li>list</ul>") for k in range(9)]
    htmls = copies + [page("menu", i, "") for i in range(1, 6)]
    rows = [(k, "http://a/", h) for k, h in enumerate(htmls)]
    out = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert out == {k: "t0\na0\nown\nlist" if k < 9 else f"t{k - 8}\na{k - 8}" for k in range(14)}


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div><button>Menu</div><article><p>a</article>", "a"),
        ("<body><button>Menu<article><p>a</article><button>Top</button></body>", "a"),
        ("<body><select><option>x<p>a</p></body>", "a"),
        ("<object data=x><p>a</p><p>b</p>", "a\nb"),
        ("<svg class='i'/><p>a</p>", "a"),
        ("<math/><p>a</p><p>b", "a\nb"),
        ("<svg><title/><style /><path d=''/></svg><p>a</p>", "a"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <object>a plot</object></p>", "if x=1 then a plot"),
        ("<p>a <button><div>Menu <p>x</div></button> b</p><p>c", "a b\nc"),
        ("<template><template><p>x</p></template><p>y</p></template><p>a</p>", "a"),
        ("<p>a<select><option>1<option>2</select>b<textarea></p></textarea>c", "a b c"),
        ("<ul><li>a<button><ul><li>x</ul></button><li>b</ul>", "a\nb"),
        ("<p>a</p><script>open</p>", "a"),
    ],
)
def test_only_raw_text_is_skipped(html, text):
    page = W.parse(html)
    assert W.extract_page(page, [W.page_template(page), [], False]) == text
