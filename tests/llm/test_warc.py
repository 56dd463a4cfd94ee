"""Derived records: their text, links to the source, and form in files."""

import gzip
import hashlib

from faultline.llm import warc

PAGE = (
    "<!DOCTYPE html><html><head><title>A &amp; B\n c</title><style>p{}</style><script>var a = '<p>no</p>';</script></head>"
    "<body><!-- <p>hidden</p> --><div>one <b>two</b>&nbsp;three</div><p>x &lt;y&gt; &#233;&#x1F600; &amp;lt; &#55296;</p>"
    '<a href="/l?a=1&amp;b=2">link</a><br>  last  <script>open'
)
TEXT = "A & B\nc\none two three\nx <y> é😀 &lt; &#55296;\nlink\nlast"


def response(body, kind="text/html; charset=utf-8"):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nX-Source: s\r\n\r\n{body}"


def records(spark):
    rows = [
        ("<urn:uuid:1>", "http://a", "2024-01-01T00:00:00Z", response(PAGE), None, 1),
        ("<urn:uuid:2>", "http://b", "2024-01-01T00:00:00Z", response("a < b\r\n\r\nc", "text/plain"), "sha1:KEPT", 1),
        ("<urn:uuid:3>", None, None, response("\x00\x01", "image/png"), None, 1),
        ("<urn:uuid:4>", "http://d", "x", None, None, 1),
        ("<urn:uuid:5>", "http://e", "x", response(""), None, 1),
        ("<urn:uuid:6>", "http://f", "x", response("<p>w</p>" * 100000), None, 1),
        (None, "http://g", "x", response("<p>no id</p>"), None, 1),
        ("<urn:uuid:5>", "http://e", "x", response(""), None, 1),
    ]
    return spark.createDataFrame(rows, "record_id string, target_uri string, date string, block string, payload_digest string, title int")


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_records(spark):
    got = warc.derive(records(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.refers_to, {}).setdefault(r.record_type, []).append(r)
        assert r.block_digest == sha(r.block) and r.content_length == len(r.block.encode())
    one = by["<urn:uuid:1>"]
    assert one["conversion"][0].block == TEXT
    meta = one["metadata"][0]
    assert meta.source_payload_digest == sha(PAGE) and meta.source_block_digest == sha(response(PAGE))
    assert meta.block.split("\r\n") == [
        "software: faultline", "source-status: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8",
        "source-header: X-Source: s", f"source-block-digest: {sha(response(PAGE))}", f"source-payload-digest: {sha(PAGE)}",
        "title: A & B c", "outlink: /l?a=1&b=2", "",
    ]
    assert (meta.target_uri, meta.date) == ("http://a", "2024-01-01T00:00:00Z")
    assert by["<urn:uuid:2>"]["conversion"][0].block == "a < b\r\n\r\nc"
    assert by["<urn:uuid:2>"]["metadata"][0].source_payload_digest == "sha1:KEPT"
    assert set(by["<urn:uuid:3>"]) == {"metadata"} and set(by["<urn:uuid:4>"]) == {"metadata"}
    assert [r.block for r in by["<urn:uuid:5>"]["conversion"]] == ["", ""]
    assert by["<urn:uuid:6>"]["conversion"][0].block == "\n".join(["w"] * 100000)
    assert by[None]["conversion"][0].block == "no id"
    assert len({r.record_id for r in got if r.refers_to != "<urn:uuid:5>"}) == len(got) - 4


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    two = warc.derive(records(spark).where("record_id = '<urn:uuid:1>'"))
    warc.write(two.coalesce(1), path)
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.gz")).decode()
    for r in two.collect():
        head = raw.index(f"WARC-Record-ID: {r.record_id}")
        start = raw.index("\r\n\r\n", head) + 4
        assert raw[start:].encode()[: r.content_length].decode() == r.block
        assert raw[start:].encode()[r.content_length :][:4] == b"\r\n\r\n"
    assert raw.count("WARC/1.1\r\n") == 2 and raw.count("WARC-Refers-To: <urn:uuid:1>") == 2


def test_no_shuffle_and_empty_table(spark):
    empty = warc.derive(records(spark).limit(0))
    assert empty.count() == 0
    plan = warc.derive(warc.responses(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))
    assert "Exchange" not in plan._jdf.queryExecution().toString()


def test_entities_are_decoded_once(spark):
    body = "<p>a &#38;lt; b &#38;#60;i&#38;gt; &copy; &mdash; &eacute; &AMP; &nosuch; &#x26;amp; &#0; & ; &amp;copy; &NotEqualTilde;</p>"
    rows = spark.createDataFrame([("<urn:uuid:1>", "u", "d", response(body))], "record_id string, target_uri string, date string, block string")
    [text] = [r.block for r in warc.derive(rows).collect() if r.record_type == "conversion"]
    assert text == "a &lt; b &#60;i&gt; © — é & &nosuch; &amp; &#0; & ; &copy; ≂̸"


def test_links_in_every_form_of_quotes(spark):
    body = (
        "<a href='one&amp;1'>1</a><A class=x HREF=two>2</A><a data-href=\"no\">3</a><a title=\"a > b\" href = \"three\">4</a>"
        "<a\nhref=\"four\" rel='x'>5</a><abbr href='no'>6</abbr><a name=n>7</a><a data-x='href=\"no\"' href='five'>8</a><a href=''>9</a>"
    )
    rows = spark.createDataFrame([("<urn:uuid:1>", "u", "d", response(body))], "record_id string, target_uri string, date string, block string")
    [fields] = [r.block for r in warc.derive(rows).collect() if r.record_type == "metadata"]
    links = [line[9:] for line in fields.split("\r\n") if line.startswith("outlink: ")]
    assert links == ["one&1", "two", "three", "four", "five", ""]


def test_written_records_name_the_digests_of_their_source(spark):
    two = warc.derive(records(spark).where("record_id = '<urn:uuid:1>'"))
    for r in warc.serialised(two).collect():
        assert f"WARC-Source-Payload-Digest: {sha(PAGE)}\r\n" in r.record
