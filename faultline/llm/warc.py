"""Metadata and plain-text records derived from WARC responses.

``derive`` makes two records of every response: ``metadata`` with the status line, the headers and
the digests of the source, its title and links, and ``conversion`` with the plain text of its body.
Both refer to the response by its record id, which they keep as it is, as they do with
target, date and digests that the response has. Their own ids are made from it, so reruns
agree. ``serialised`` gives each record as it stands in a file, and ``write`` writes files.

All of it is one projection in the JVM, without a shuffle. Text comes from the body of
HTML by patterns: comments, scripts and styles go, block elements break lines, all entities of
HTML are decoded once, blank space is collapsed. Plain text is kept as it is; other kinds have no
conversion record. A null block is an empty one, a block without an empty line is all header. Null ids and targets
leave out their header. Equal rows give equal records. Other columns are not read.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\r\n"
# Elements whose content is no text, and elements that break lines (fixed values).
UNREAD = ("script", "style", "template", "noscript")
BREAKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|"
    "hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul"
)
# An entity: a decimal or hexadecimal number, or a name.
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
# A link: ``href`` as an attribute of its own, its value in double, single or no quotes.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
LINK = rf"""(?i)<a[\s/]+(?:[^\s=>"'/]+(?:\s*=\s*{_VALUE})?[\s/]+)*?href\s*=\s*({_VALUE})"""


def named_entities() -> dict[str, str]:
    """The characters of every named entity of HTML, by name."""
    return {name[:-1]: text for name, text in html5.items() if name.endswith(";")}


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def urn(*parts: Column) -> Column:
    """A record id made from values, in the form of a UUID."""
    key = F.sha2(F.concat_ws("|", *parts), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(key, a, n) for a, n in cuts]), F.lit(">"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response records: record_id, target_uri, date, block."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(END + END),
    )
    return pages.select(
        "page_id",
        urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"),
    )


def plain_text(html: Column) -> Column:
    """The text of HTML."""
    text = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    for name in UNREAD:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", "")
    return text


def _character(entity: Column) -> Column:
    """What an entity stands for; itself if it stands for nothing."""
    name = F.regexp_replace(entity, r"^&#?[xX]?|;$", "")
    hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
    point = F.when(hexadecimal, F.conv(name, 16, 10)).otherwise(F.conv(name, 10, 10)).cast("long")
    real = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    table = F.from_json(F.lit(json.dumps(named_entities())), "map<string,string>")
    plain = F.substring(entity, 2, F.length(entity) - 2)
    # The usual ones need no look into the table.
    usual = F.when(plain == "amp", "&").when(plain == "lt", "<").when(plain == "gt", ">").when(plain == "quot", '"').when(plain == "nbsp", "\u00a0")
    named = F.coalesce(usual, F.element_at(table, plain))
    return F.coalesce(F.when(F.startswith(entity, F.lit("&#")), number).otherwise(named), entity)


def _decoded(text: Column) -> Column:
    """Text with entities decoded in one pass: what they stand for is not decoded again."""
    between, entities = F.split(text, ENTITY), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    joined = F.array_join(F.zip_with(between, entities, lambda a, b: F.concat(a, F.coalesce(_character(b), F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _tidy(text: Column) -> Column:
    """Runs of blanks as one, lines trimmed, empty lines gone."""
    # A blank by itself is left alone, as most are.
    text = F.regexp_replace(text, r"[ \t\r\f\x0B\xA0]{2,}|[\t\r\f\x0B\xA0]", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _once(df: DataFrame, **new: Column) -> DataFrame:
    """Columns that later ones use several times, computed once."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def derive(records: DataFrame, software: str = "faultline", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derived records of responses (record_id, target_uri, date, block as text).

    Columns ``block_digest`` and ``payload_digest`` of the response are kept as the source
    digests; where absent or null they are computed. Columns named in ``keep`` come along.
    """
    given = {n: F.col(n) if n in records.columns else F.lit(None).cast("string") for n in ("block_digest", "payload_digest")}
    rows = records.select(
        *keep, "record_id", "target_uri", "date", F.coalesce("block", F.lit("")).alias("source"),
        *[c.alias(f"given_{n}") for n, c in given.items()],
    )
    cut = F.instr("source", END + END)
    rows = _once(rows, head=F.when(cut > 0, F.expr("substr(source, 1, instr(source, '\\r\\n\\r\\n') - 1)")).otherwise(F.col("source")),
                 body=F.when(cut > 0, F.expr("substr(source, instr(source, '\\r\\n\\r\\n') + 4)")).otherwise(F.lit("")))
    kind = F.lower(F.regexp_extract("head", r"(?im)^content-type:[ \t]*([^;\s]*)", 1))
    rows = _once(
        rows, kind=kind, lines=F.split("head", END), stripped=plain_text(F.col("body")),
        title=F.regexp_extract("body", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1),
        links=F.transform(F.regexp_extract_all(F.col("body"), F.lit(LINK), F.lit(1)), lambda v: F.regexp_replace(v, r"^[\"']|[\"']$", "")),
        source_block_digest=F.coalesce("given_block_digest", digest(F.col("source"))),
        source_payload_digest=F.coalesce("given_payload_digest", digest(F.col("body"))),
    )
    html = F.col("kind").isin("text/html", "application/xhtml+xml")
    rows = _once(rows, text=F.when(html, _tidy(_decoded(F.col("stripped")))).when(F.col("kind") == "text/plain", F.col("body")))

    def lines(name: str, values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{name}: "), v, F.lit(END))), "")

    fields = F.concat(
        F.lit(f"software: {software}{END}source-status: "), F.element_at("lines", 1), F.lit(END),
        lines("source-header", F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))),
        F.lit("source-block-digest: "), "source_block_digest", F.lit(f"{END}source-payload-digest: "), "source_payload_digest",
        F.lit(END), F.lit("title: "), _tidy(F.regexp_replace(_decoded(F.col("title")), r"\n", " ")), F.lit(END),
        lines("outlink", F.transform("links", lambda v: F.regexp_replace(_decoded(v), r"[\r\n]+", ""))),
    )
    rows = _once(rows, fields=fields)
    both = [
        F.struct(F.lit(name).alias("record_type"), urn(F.lit(name), F.col("record_id")).alias("record_id"),
                 F.lit(mime).alias("content_type"), block.alias("block"))
        for name, mime, block in (
            ("metadata", "application/warc-fields", F.col("fields")), ("conversion", "text/plain; charset=utf-8", F.col("text")))
    ]
    records_of = F.when(F.col("text").isNull(), F.array(both[0])).otherwise(F.array(*both))
    out = rows.select(
        *keep, F.col("record_id").alias("refers_to"), "target_uri", "date", "source_block_digest", "source_payload_digest",
        F.inline(records_of),
    )
    return out.select(
        *keep, "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"),
        "source_block_digest", "source_payload_digest", "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """``record``: each record as text, without the two line ends that follow it in a file."""
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"),
        ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    # A null value makes its whole line null, and concat_ws leaves it out.
    head = F.concat_ws(END, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in named])
    return records.select(F.concat(head, F.lit(END + END), F.col("block")).alias("record"))


def write(records: DataFrame, path: str) -> None:
    """Write records as WARC files, compressed by file."""
    serialised(records).write.option("lineSep", END + END).option("compression", "gzip").text(path)
