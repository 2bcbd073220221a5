"""Archives and main texts of pages."""

import base64
import hashlib
import io
import pickle
import random
import time

import pytest
import zstandard

from kinetable.llm import extract, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<p>page {i} " + "lorem ipsum dolor sit amet " * 20) for i in range(60)]
    rows += [(100, "http://a.example.com/", "same"), (99, "http://b.example.com/\nx", "same"), (101, None, "same"), (102, "u", None), (103, "u", ""), (None, "u", "same"), (104, "u", "é" * 50_000), (99, "u", "same")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as sha1", "'x' as host", "3 as archive")


def test_round_trip(pages):
    rows, df = pages
    records = warc.read(warc.write(df)).collect()
    assert all(r["error"] is None for r in records) and len(records) == len(rows)
    got = [(r["page"] and int(r["page"]), r["record_type"], r["refers_to"] and int(r["refers_to"]), r["payload_digest"], r["payload_bytes"]) for r in records]
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(x for x, _, y in rows if (y or "") == (h or "") and x is not None)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[h or ""]
        want.append((i, "response" if i == f else "revisit", None if i == f else f, base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["payload"].decode() for r in records if r["page"] == "104"} == {"é" * 50_000}


def test_least_size_of_revisits_and_empty_tables(pages):
    _, df = pages
    out = warc.summary(warc.read(warc.write(df, least_bytes=5), payloads=False))
    assert {r["record_type"] for r in out.collect()} == {"response"} and dict(out.dtypes)["page_id"] == "bigint"
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_shared_payloads_by_shuffle(pages, monkeypatch):
    _, df = pages
    own = lambda: sorted(map(str, warc.summary(warc.read(warc.write(df), payloads=False)).collect()))
    want = own()
    monkeypatch.setattr(warc, "SHARED", 0)
    assert own() == want


def archive_of(n=200):
    return [warc.record(i, f"http://x/{i}", f"<p>text number {i} of a page that is like others</p>".encode() * 5) for i in range(n)]


def test_the_dictionary_comes_first_and_each_frame_is_a_record():
    records = archive_of()
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    found = list(warc.frames(io.BytesIO(data)))
    assert [raw for _, raw, _ in found] == records and all(e is None for *_, e in found)
    with pytest.raises(zstandard.ZstdError):  # the frames need their dictionary
        zstandard.ZstdDecompressor().decompress(data[found[0][0] :])
    few = warc.archive(records[:2])
    assert [raw for _, raw, _ in warc.frames(io.BytesIO(few))] == records[:2]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_frames_across_chunks(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    monkeypatch.setattr(warc, "PIECE", max(1, chunk // 3))
    records = archive_of(30)
    data = warc.archive(records) + b"\x50\x2a\x4d\x18\x03\0\0\0abc"
    assert [raw for _, raw, _ in warc.frames(io.BytesIO(data))] == records


def test_damage_is_reported():
    data = warc.archive(archive_of(50))
    assert list(warc.frames(io.BytesIO(data[:-3])))[-1][2] == "truncated frame"
    assert list(warc.frames(io.BytesIO(data[:100])))[-1][2] == "truncated skippable frame"
    assert list(warc.frames(io.BytesIO(b"garbage garbage")))[0][2] == "not a Zstandard frame"
    at = list(warc.frames(io.BytesIO(data)))[20][0]
    broken = data[: at + 12] + bytes([data[at + 12] ^ 255]) + data[at + 13 :]
    assert any(e for *_, e in warc.frames(io.BytesIO(broken)))
    good = warc.record(1, "u", b"payload")
    assert warc.parsed(good)["payload"] == b"payload"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), good + b"x", good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(ValueError):
            warc.parsed(bad)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside>Side</aside><form><p>Search</p></form><section id="comments"><article class="comment"><p>First!</p></article></section>
<footer>&copy; 2024</footer></body></html>"""


def test_one_page():
    body = "<article><h1>Head &amp;\n line</h1><p><b>One<br>two<p>Th<i>re</i>e &eacute;<!-- no --><ul><li>a<li>b</ul><div class='ad'>Buy</div></article>"
    assert extract.main_text(PAGE % body) == "Head & line\nOne two\nThree é\na\nb"
    assert extract.main_text(None) == "" and extract.main_text("") == "" and extract.main_text("<p>") == ""
    assert extract.main_text("plain text") == "plain text"
    body = "<div class=wrap><div id=content><h2>Head</h2><p>" + "Long text. " * 20 + "</p><p>More</p></div></div>"
    assert extract.main_text(PAGE % body).split("\n")[0] == "Head"
    assert extract.main_text("<article>" + "<p>x</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert extract.main_text("<div>" * 5_000 + "deep") == "deep"


def test_templates_are_learned_from_pages_of_a_host(spark):
    page = "<body><div class=top>Menu words</div><div class=box><div class=lead>Breaking</div><div class=story><p>%s</p><p>Subscribe for more</p></div></div><div class=bottom>Imprint</div></body>"
    rows = [(i, f"https://news.example.com/{i}", page % (f"Story {i} has words. " * (10 + i))) for i in range(8)]
    rows += [(50, "https://other.example.com/", page % "Single page with words"), (51, None, page % "No host"), (52, "https://news.example.com/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as guide", "2 as slot", "'x' as text")
    got = {r["page_id"]: r["text"] for r in extract.extract(df).collect()}
    for i in range(8):
        assert got[i] == " ".join((f"Story {i} has words. " * (10 + i)).split())
    assert "Single page with words" in got[50] and "Subscribe" in got[50] and got[52] == ""
    assert extract.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    page = "<article><p>Words of the story that all copies have in common.</p></article>"
    df = spark.createDataFrame([(i, "http://h.example.com/", page) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in extract.extract(df).collect()} == {"Words of the story that all copies have in common."}


def article_of(page):
    import html
    import re

    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_driver_pages(spark, sf_dir):
    """The whole query, with wrappers, and each page alone against the text of the article element."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: article_of(r["html"]) for r in rows.collect()}
    assert all(extract.main_text(r["html"]) == want[r["page_id"]] for r in rows.collect())
    out = extract.extract(rows).collect()
    assert {r["page_id"]: r["text"] for r in out} == want and all(r["n_chars"] == len(r["text"]) for r in out)


def test_wrappers_find_the_articles_of_driver_pages_without_article_elements(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = rows.selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div class=main-story>'), '</article>', '</div>') as html")
    want = {r["page_id"]: article_of(r["html"]) for r in rows.collect()}
    got = {r["page_id"]: r["text"] for r in extract.extract(plain).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_layouts_of_a_host_have_wrappers_of_their_own(spark):
    a = "<body><div class=top><p>Menu of the one kind</p></div><div class=content><p>%s</p><p>Read more of these</p></div></body>"
    b = "<body><div class=content><p>%s</p></div><div class=links><p>Other things that we wrote about at length and with great care, year after year, in this place</p></div></body>"
    rows, want = [], {}
    for i in range(12):
        want[i] = f"Story {i} of the host. " * 9
        rows.append((i, f"https://two.example.com/{i}", (a if i % 5 < 3 else b) % want[i]))
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: t.strip() for i, t in want.items()}


def test_wrappers_are_packed_by_layout(spark):
    """A page unpacks the wrapper of its own layout, whatever others its host has."""
    page = "<body><div class=top{0}><p>Top of {0}</p></div><div class=text{0}><p>Story {0} {1}</p></div></body>"
    rows = [("h.example", page.format(k, chr(97 + i) * 40)) for k in "xyz" for i in range(5)]
    (row,) = extract.induced(spark.createDataFrame(rows, "host string, html string")).collect()
    layouts = pickle.loads(row["wrappers"])
    assert len(layouts) == 4 and 0 in layouts and all(isinstance(packed, bytes) for packed in layouts.values())
    g, own = extract.read_page(rows[0][1])
    assert extract.text_of(g, own, extract._wrapper(layouts[extract.layout_of(g)])) == "Story x " + "a" * 40


def test_long_and_deep_pages_of_one_host(spark):
    rows = [(i, "http://big.example.com/", "<div>" * 5_000 + f"deep {i}") for i in range(5)]
    rows += [(10 + i, "http://wide.example.com/", "<body><div class=top>Top</div><div class=text>" + "".join(f"<p id=u{i}x{chr(97 + k % 26)}{k}>par {i} {k}</p>" for k in range(20_000)) + "</div>") for i in range(5)]
    rows += [(20 + i, "http://names.example.com/", "<body>" + "".join(f"<div class={'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}{'abcdefgh'[(i + k) % 8]}>item {i} {k}</div>" for k in range(3_000))) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract(df).collect()}
    assert got[3] == "deep 3" and got[12].count("\n") == 19_999 and got[22].startswith("item 2 0\nitem 2 1\n") and got[22].count("\n") == 2_999


def test_unclosed_quotes_and_names_that_mislead():
    assert extract.main_text('<p><a title="foo>link</a> and more</p>') == "link and more"
    assert extract.main_text('<div><a title="a > b">x</a></div>') == "x"
    assert extract.main_text("<body><div class=search-results><article><p>Found words</p></article></div><div class=menu>No</div></body>") == "Found words"
    assert extract.main_text("<body><div class=social-science><p>All there is</p></div></body>") == "All there is"
    assert extract.main_text("<body><nav>Menu</nav><div class=comments><p>First!</p></div><div class=x><p>Text</p></div></body>") == "Text"


def test_names_of_attributes_are_whole_and_values_hold_none(spark):
    rng = random.Random(4)
    names = ["style", "data-id", "data-hidden", "title", "aria-hidden", "lang", "data-role", "x-class", "hiddens", "onclick"]
    values = ["overflow:hidden", "sidebar-x", "a hidden b", "class=sidebar", "role=banner hidden", "true", "nav", "id='menu'"]
    quotes = ('"{}"', "'{}'")
    for _ in range(300):
        attributes = " ".join(f"{rng.choice(names)}{rng.choice((' = ', '='))}{rng.choice(quotes).format(v)}" for v in rng.sample([v for v in values if "'" not in v], 3))
        assert extract.main_text(f"<article {attributes}><p {attributes}>Body text</p></article>") == "Body text", attributes
    assert extract.main_text("<div hidden>no</div><div HIDDEN=''>no</div><div class=a id='sidebar'>no</div><p>yes</p>") == "yes"
    rows = [(i, f"http://h.example.com/{i}", f'<article style="overflow:hidden"><h1>Title {i}</h1><p>Words of page {i} that stand here.</p></article>') for i in range(6)]
    out = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"Title {i}\nWords of page {i} that stand here." for i in range(6)}


def test_names_within_an_article():
    page = '<div class="header">no</div><article><div class="article-header"><h1>Title</h1></div><p class="related-work">We follow.</p><p aria-hidden="true">Seen</p><p class="ad">no</p><div class="comments"><p>no</p></div><div class="sidebar">no</div></article>'
    assert extract.main_text(page) == "Title\nWe follow.\nSeen"


def test_depth_takes_time_in_proportion():
    began = time.perf_counter()
    tops = [extract.parse(page) for page in ("<div>" * 40_000, "<p><object>" + "<div>" * 40_000, "<div class=menu>" * 20_000 + "<main>" * 20_000)]
    assert all(t.children for t in tops) and time.perf_counter() - began < 15


def test_alignment_is_a_largest_match():
    a = extract.read_page("<body><div><p>x</p></div><ul><li>1</li></ul><div class=b><p>y</p></div></body>")[0]
    b = extract.read_page("<body><ul><li>2</li></ul><div class=b><p>z</p></div></body>")[0]
    to = extract.aligned(a, b)
    assert {(a.tag[i], a.name[i]): (b.tag[j], b.name[j]) for i, j in to.items()}[("div", "b")] == ("div", "b")
    assert len(to) == 6  # html, body, ul, li, div, p
    x, y = (extract.read_page("<body>" + t)[0] for t in ("<div class=top>a</div><div class=content><p>b</p></div>", "<div class=content><p>c</p></div><div class=links>d</div>"))
    assert {x.name[i]: y.name[j] for i, j in extract.aligned(x, y).items() if x.name[i]} == {"content": "content"}


def test_the_heaviest_pairs_that_do_not_cross():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        q = rng.sample(range(10), n)
        pairs, w = list(enumerate(q)), [rng.randrange(1, 9) for _ in range(n)]
        want = max(sum(w[k] for k in c) for r in range(n + 1) for c in itertools.combinations(range(n), r) if all(q[a] < q[b] for a, b in zip(c, c[1:])))
        got, chosen = extract._heaviest(pairs, w)
        assert got == want and sum(w[p] for p, _ in chosen) == want and sorted(chosen) == sorted(chosen, key=lambda x: x[1])
