"""Web pages: extraction, and archives that are written and read back."""

import hashlib
import io
import struct
from html.parser import HTMLParser

import pytest
import zstandard
from oracle import data_dir

from docloom.llm import html_extract, warc
from docloom.llm.html_extract import main_text

ARTICLE = "".join(f"<p>Paragraph {k}, which has some length, and commas, so it counts.</p>" for k in range(4))
TEXT = "\n\n".join(f"Paragraph {k}, which has some length, and commas, so it counts." for k in range(4))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><body><nav><a href=x>Menu, one</a></nav><article>{ARTICLE}</article><footer>Foot, er</footer></body></html>", TEXT),
        (f"<body><div class='cookie-notice'>We, use, cookies</div><div id=main-content>{ARTICLE}</div><div class=sidebar><p>Some, other, text, that is long, too, and more.</p></div></body>", TEXT),
        (f"<div>{ARTICLE}<form><p>Your name, please, and your address, and more.</p></form><aside><p>Ad, ad, ad</p></aside></div>", TEXT),
        (f"<main>{ARTICLE}</main><section id=comments><p>First, great, article, thank you, all, really.</p></section>", TEXT),
        (f"<body>{ARTICLE}<script>var a = '<p>no, not, this</p>';</script><style>p {{}}</style><!-- <p>nor, this</p> --></body>", TEXT),
        ("<p>a &amp; b&nbsp;&#233;\n\t c<p>second <b>bold</b>ly<br>next", "a & b é c\n\nsecond boldly next"),
        ("<article><h1>Title</h1><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "Title\n\none\n\ntwo\n\nx\n\ny"),
        ("just text, no tags", "just text, no tags"),
        ("<p>1 < 2 and <3 hearts", "1 < 2 and <3 hearts"),
        ("", ""),
        (None, ""),
        ("<script>never closed <p>x", ""),
        ("<!-- open", ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


LONG = "This paragraph is long enough to count, with commas, and it goes on for a while, as articles do, and then some more."
LINKS = "".join(f"<li><a href=/{k}>Source number {k}</a></li>" for k in range(5))


@pytest.mark.parametrize(
    "page, text",
    [
        # Headings, intros and ends beside the best container.
        (f"<body><div><h1>Title</h1><div>{ARTICLE}</div><div><p>The end.</p></div></div></body>", f"Title\n\n{TEXT}\n\nThe end."),
        (f"<body><div><div><h1>Title</h1></div><div>{ARTICLE}</div><p>Short.</p></div></body>", f"Title\n\n{TEXT}\n\nShort."),
        (f"<body><div><div><p>{LONG}</p></div><div>{ARTICLE}</div><div><p>{LONG}</p></div></div></body>", f"{LONG}\n\n{TEXT}\n\n{LONG}"),
        # Words of classes that only sound like clutter.
        (f"<article><div class='share-price'>Up, 3 %</div>{ARTICLE}<p class='related-work'>Others, too.</p></article>", f"Up, 3 %\n\n{TEXT}\n\nOthers, too."),
        (f"<article>{ARTICLE}<div class='social-share'>Share this</div><section class='post-comments'><p>Nice, very, nice.</p></section></article>", TEXT),
        # Sources of an article.
        (f"<article>{ARTICLE}<h2>Sources</h2><ul>{LINKS}</ul></article>", TEXT + "\n\nSources\n\n" + "\n\n".join(f"Source number {k}" for k in range(5))),
        # Menus and imprints without a name.
        (f"<body><div><ul>{LINKS}</ul>{ARTICLE}<ul>{LINKS}</ul></div></body>", TEXT),
        (f"<body><div><div>{ARTICLE}</div><div>© 2024 Example, all rights reserved, and more, of that.</div><div>{LINKS}</div></div></body>", TEXT),
    ],
)
def test_nothing_of_the_article_is_lost(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "piece",
    ['<a "', "<p><button><b>x<div></div>", '<a b="', "<a b='x\"", "<b>x", "<", "<a ", "</", "<!-- ", "<![", "<div class='a", "<script>", "</script", "<li><ul>", "<td><b>", "&", "&amp", "<a b=\"'>", "<p>", "<svg>", "a= ", "<dd><i>t"],
)
def test_time_grows_with_the_page(piece):
    import time

    page, start = piece * (5_000_000 // len(piece)), time.process_time()
    assert main_text(page) is not None
    assert time.process_time() - start < 30  # seconds if quadratic: hours


class Plain(HTMLParser):
    """Text of the article by the standard library's parser, for pages whose clutter stands outside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.inside = [], [], False

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in html_extract.BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet(data_dir("sf0.01") + "/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.report(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.flush()
        assert found[r.page_id] == "\n\n".join(plain.blocks), r.page_id


def test_deep_and_hostile_pages():
    assert main_text("<div>" * 20_000 + "<p>deep, text</p>") == "deep, text"
    assert main_text("</p></div>" * 5_000 + "<p>end") == "end"
    assert main_text('<a "' * 2_000) is not None


PAGES = [
    (3, "http://a/", "<p>" + "same " * 40),
    (1, "http://b/é \r\n", "<p>" + "same " * 40),
    (2, None, "<p>" + "same " * 40),
    (None, "http://c/", "<p>" + "same " * 40),
    (4, "u", "short"),
    (5, "u", "short"),
    (6, None, None),
    (7, "", ""),
    (8, "u", "é" * 70_000),
    (1, "http://b/", "<p>" + "same " * 40),
    (9, "u", "\r\n\r\n" * 60),
]


def test_record_ids_differ(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES * 2], "page_id bigint, url string, html string, digest int, copy string").repartition(3)
    archives = warc.write(pages, tmp_path.as_uri(), archive_bytes=2000)
    heads = []
    for r in archives.collect():
        with open(r.path, "rb") as f:
            heads += [head for head, _ in warc.read_archive(f)]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(ids) == 2 * len(PAGES)
    told = {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"}
    assert told and told <= {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}


def test_file_systems():
    assert warc.file_system("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="shared folder"):
        warc.file_system("nosuch://host/x")


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id bigint, url string, html string, digest int, payload string").repartition(2)
    folder = tmp_path.as_uri()
    archives = warc.write(pages, folder, archive_bytes=2000)
    assert archives.count() > 2
    found = warc.read(archives, folder).collect()
    same = hashlib.sha256(PAGES[0][2].encode()).hexdigest()
    expected = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        again = digest == same and i != 1
        expected.append((i, len(payload), digest, "revisit" if again else "response", 1 if again else None, None if again else payload))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sorted(warc.report(pages).collect(), key=repr) == sorted((tuple(e[:5]) for e in expected), key=repr)
    assert warc.report(pages.limit(0)).count() == 0


def test_records_are_frames_of_their_own():
    records = [warc.record(k, f"u{k}", f"<p>page number {k} of a site with a common frame</p>".encode() * 20, "0" * 64, "response", None, "2024-01-01T00:00:00Z") for k in range(300)]
    head, *frames = warc.archive(records)
    magic, size = struct.unpack("<II", head[:8])
    assert magic == 0x184D2A5D and size == len(head) - 8 and len(frames) == len(records)
    alone = zstandard.ZstdDecompressor(dict_data=warc._dictionary_of(head[8:]))
    assert alone.decompress(frames[123]) == records[123]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(map(len, frames)) < plain
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.read_archive(io.BytesIO(b"x" * 20)))


def test_damage_is_noticed():
    record = warc.record(1, "u", b"payload", "0" * 64, "response", None, "2024-01-01T00:00:00Z")
    data = b"".join(warc.archive([record]))
    with pytest.raises(ValueError, match="differs"):
        list(warc.read_archive(io.BytesIO(data)))


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a, b", "old"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    assert sorted(html_extract.report(pages).collect(), key=repr) == sorted([(1, "u", "a, b", 4), (None, None, "", 0)], key=repr)
    assert html_extract.report(pages.limit(0)).count() == 0
