"""Page text and WARC archives."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from ionloom.llm import html_text, q_corpus, warc
from tests.llm.helpers import SF_DIR, prose

PAGES = "page_id bigint, url string, html string, text string, _k1 int, starts string"


def test_pages_give_their_articles(spark):
    """Every test page was made from a document: its text is the heading and the document's lines."""
    import re

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = q_corpus.op2_html_text(spark, SF_DIR).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        doc = docs[int(re.findall(r"/(\d+)", r["url"])[-1])]
        lines = [" ".join(x.split()) for x in doc.split("\n") if x.split()]
        assert r["text"].split("\n\n")[1:] == lines and r["n_chars"] == len(r["text"]) and r["url"] == urls[r["page_id"]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a</p><svg class='i' /><p>b</p><math/><p>c <svg><title/><path d='M0'/><text>no</text></svg> d</p></article>", ["a", "b", "c d"]),
        ("<article><p>a <svg><g>no</p><p>b</p><canvas>no</canvas><object><p>no</p></object><template><p>no</p></template></article>", ["a", "b"]),
        ("<title-bar>a</title-bar><p>b</p><style/>no</style><p>c</p>", ["a", "b", "c"]),
        ("<article><p>own</p></article><div class=comments><article><p>reader</p></article></div><aside><article>x</article></aside>", ["own"]),
        ("<div class=comments><article>reader</article></div><div>own</div>", ["own"]),
        ("<div class=widget><article><p>only</p><nav>no</nav></article></div>", ["only"]),
        ("<div class=sidebar><main><p>own</p></main></div>", ["own"]),
    ],
)
def test_empty_elements_and_excluded_articles(page, want):
    assert html_text.scan(page)[1] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b &lt;i&gt;<br>c", ["a", "b <i> c"]),
        ("<body><div class='main'>x <b>y</b>\n z</div></body>", ["x y z"]),
        ("<nav>menu</nav><article><h1>T</h1><p>one</p><aside>no</aside><div class='ad'>no</div></article><footer>f</footer>", ["T", "one"]),
        ("<article><header><h1>T</h1></header>t</article><header>site</header>", ["T", "t"]),
        ("<main><p>m</p><section id='comments'><p>reader</p></section><article class='comment'>c</article></main>", ["m"]),
        ("<div id=cookie-notice>no</div><form><p>no</p></form><p>yes</p><!-- <p>no</p> -->", ["yes"]),
        ("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><p title='a > b'>ok</p>", ["ok"]),
        ("<div class='no-sidebar'>keep</div><div hidden>no</div><div style='display: none'>no</div>", ["keep"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ("<article>open <nav>menu</nav> text", ["open", "text"]),
        ("<p>unclosed <!-- comment", ["unclosed"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
    ],
)
def test_blocks(page, want):
    assert html_text.scan(page)[1] == want


def test_repeated_runs_of_a_host_are_removed(spark):
    """Pages without a named article: what distinct pages of a host share goes, also in a hot host."""
    banner = prose(1, 14)
    rows = []
    for i in range(60):
        host = "big.example" if i % 3 else f"h{i}.example"
        rows.append((i, f"http://{host}/{i}", f"<div><p>{banner}</p><p>{prose(100 + i, 30)}</p></div>", "clash", 0, "x"))
    rows += [(99, "http://big.example/x", f"<p>{banner} {prose(7, 12)}</p>", "c", 0, "x"), (None, None, None, None, None, None), (98, "::bad[", "<p>t</p>", None, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows) and got[None] == "" and got[98] == "t" and got[99] == prose(7, 12)
    for i in range(60):
        own = prose(100 + i, 30)
        assert got[i] == (own if i % 3 else f"{banner}\n\n{own}")


def test_the_host_votes_on_articles_too(spark):
    """A notice without a telling name inside most articles of a host goes; what some articles share stays."""
    notice, quote = prose(1, 12), prose(2, 20)
    rows = []
    for i in range(40):
        parts = [prose(100 + i, 30), *([quote] if i % 3 == 0 else []), prose(200 + i, 10)]
        html = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((i, f"http://big.example/{i}", f"<h1>Site</h1><nav>x</nav><article><h2>T{i}</h2>{html}<p>{notice}</p><p>Share</p><p>it with your friends</p></article>", "\n\n".join([f"T{i}", *parts]), 0, ""))
    small = [(100 + i, "http://small.example/", f"<article><p>{prose(300 + i, 9)}</p><p>{notice}</p></article>", f"{prose(300 + i, 9)}\n\n{notice}", 0, "") for i in range(3)]
    # The same body on every page of a host, and one with a little more: nothing goes.
    same = [(200 + i, "http://same.example/", f"<div>{prose(9, 60)}</div>" + ("<div>Extra one.</div>" if i else ""), prose(9, 60) + ("\n\nExtra one." if i else ""), 0, "") for i in range(2)]
    copies = [(300 + i, "http://copy.example/", f"<article><p>{prose(8, 60)}</p></article>", prose(8, 60), 0, "") for i in range(20)]
    rows += small + same + copies
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article id='comment-on-law'><p>a</p></article>", ["a"]),
        ("<article><p>a</p><div class='related-work'>b</div><section class='dinner-menu'>c</section></article>", ["a", "b", "c"]),
        ("<article><p>a</p><div class='post-comments'>no</div><div id='ad-slot-3'>no</div><div class='x user-comments'>no</div></article>", ["a"]),
        ("<h1>Heading</h1><article><p>a</p></article>", ["Heading", "a"]),
        ("<header><h1>Site</h1></header><article><p>a</p></article>", ["a"]),
        ("<h1>Heading</h1><article><h1>Own</h1><p>a</p></article>", ["Own", "a"]),
        ("<h1>Site</h1><p>teaser</p><article><p>a</p></article>", ["a"]),
    ],
)
def test_names_and_headings(page, want):
    assert html_text.scan(page)[1] == want


def test_int_ids_and_very_long_pages(spark):
    long = "".join(f"<p>{prose(i, 200)}</p>" for i in range(400))
    df = spark.createDataFrame([(1, "http://a/", long), (2, None, "<p>b</p>")], "page_id int, url string, html string")
    out = html_text.main_text(df)
    assert out.schema["page_id"].dataType.simpleString() == "int"
    assert {r["page_id"]: r["n_chars"] for r in out.collect()} == {1: sum(len(prose(i, 200)) for i in range(400)) + 2 * 399, 2: 1}


def test_equal_pages_are_not_distinct(spark):
    rows = [(1, "http://a.example/", f"<p>{prose(3, 40)}</p>", "", 0, "")] * 3
    assert {r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()} == {prose(3, 40)}
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def warc_rows():
    big, long = prose(5, 400), "z" * 300_000
    rows = [(i, f"http://h{i % 4}.example/p{i % 6}", big if i % 3 == 0 else prose(50 + i, 20), "c", 1, "x") for i in range(30)]
    rows += [
        (40, None, None, None, None, None), (41, "HTTP://User@WWW.Example.com:80/a b?q=1#f", big + "é", None, None, None),
        (42, "http://x.example/\r\nWARC-Type: fake", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40, None, None, None),
        (43, "http://x.example/", long, None, None, None), (44, "http://x.example/", long, None, None, None),
        (None, "http://n.example/", long, None, None, None), (44, "http://x.example/", long, None, None, None), (45, "u", "", None, None, None),
    ]
    return rows


def test_archives_round_trip(spark, tmp_path):
    rows = warc_rows()
    path = str(tmp_path / "warc")
    index = warc.capture_histories(spark.createDataFrame(rows, PAGES), path).collect()
    by_digest = defaultdict(list)
    for page, _, html, *_ in rows:
        by_digest[hashlib.sha1((html or "").encode()).hexdigest()].append(page)
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        digest = hashlib.sha1(data).hexdigest()
        first = max((p for p in by_digest[digest] if p is not None), default=None)
        revisit = len(data) >= 1000 and first is not None and page != first
        want.append((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in index) == sorted(map(repr, want))
    # Global order: by bucket and rank, the keys ascend and ranks have no gaps.
    ordered = sorted(index, key=lambda r: (r["bucket"], r["rank"]))
    keys = [warc.order(tuple(r)) for r in ordered]
    assert keys == sorted(keys)
    ranks = defaultdict(list)
    for r in ordered:
        ranks[r["bucket"]].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())
    # Offsets lead to the records.
    contents = {f.name: gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz")}
    for r in index:
        assert contents[r["archive"]][r["offset"] :].startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())


def test_empty_archives(spark, tmp_path):
    assert warc.capture_histories(spark.createDataFrame([], PAGES), str(tmp_path / "none")).count() == 0


def test_surt():
    assert warc.surt("http://www.Example.com/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.surt(None) == "" and warc.surt("http://x.org") == "org,x)/"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((("u" * rng.randint(0, 3), str(rng.randint(0, 4)), rng.choice([None, 1, 2]), f"a{i}", j, 0, 0, "", "", None) for j in range(rng.randint(0, 20))), key=warc.order) for i in range(k)]
    assert [warc.order(r) for r in warc.LoserTree(runs)] == sorted(warc.order(r) for run in runs for r in run)
