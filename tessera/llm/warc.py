"""WARC (operator 7): builds derivatives of response records.

Every response yields a metadata record (what the page links to, its title, charset and status) and a
conversion record (its plain text). Both refer to the response by WARC-Refers-To, repeat its target and date, and carry
the source's HTTP headers and digests, so that a derivative can be checked against what it was made from.

Responses come from WARC files (`read_records`, plain or gzipped a record, read as a stream) or, where there are pages only, are made
from them (`response_of_page`). Transfer and content encodings (chunked; gzip, deflate, zstd) are undone before a payload is read;
digests are those of the record as it is. Record ids are name-based UUIDs of type, target and payload digest; thus a task that
runs again writes the same records.

Defined results: a null html is an empty payload; a null url gives an empty WARC-Target-URI; responses that aren't HTML
or text, or whose encoding isn't known, get an empty conversion text; a record whose length isn't a number is passed over, and a torn
or broken file ends at its last whole record; a torn encoding gives what there is before the tear; rows with equal page_id yield records each; an empty table gives none; further
columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import html_text
from tessera.llm.common import table, trimmed

#: Made responses bear this date, since pages have none.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed namespace of URLs
#: Elements that begin a line; elements whose content isn't parsed, and of these the ones that a reader sees.
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
UNPARSED = html_text.RAW | {"noscript", "template"}
SEEN = frozenset(["title", "textarea", "xmp"])
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src"}
CHARSET = re.compile(r"charset\s*+=\s*+[\"']?([\w-]+)", re.I)
#: Characters of a page in which any charset counts, if its head names none.
START = 1024

COLUMNS = [("page_id", pa.int64(), "long"), ("record_id", pa.string(), "string"), ("warc_type", pa.string(), "string"), ("refers_to", pa.string(), "string"), ("target_uri", pa.string(), "string"), ("warc_date", pa.string(), "string"), ("content_type", pa.string(), "string"), ("content_length", pa.int64(), "long"), ("block_digest", pa.string(), "string"), ("payload_digest", pa.string(), "string"), ("source_headers", pa.string(), "string"), ("source_block_digest", pa.string(), "string"), ("source_payload_digest", pa.string(), "string"), ("content", pa.string(), "string")]
SCHEMA = ", ".join(f"{n} {t}" for n, _, t in COLUMNS)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


def response_of_page(url: str, page: bytes, page_id: int | None = None) -> dict:
    """A response record of a page: its id, date, HTTP head, payload and digests. Pages of equal url and content differ by page_id."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page)}\r\n\r\n".encode()
    payload = digest(page)
    return {"record_id": record_id("response", url, payload, *([] if page_id is None else [str(page_id)])), "target_uri": url, "date": DATE, "block_digest": digest(head + page), "payload_digest": payload, "head": head.decode(), "payload": page}


def read_page(page: str) -> tuple[str, str | None, str | None, list[tuple[str, str]]]:
    """The text that a reader would see (a line for each block; white space inside is one blank), the title, the charset that
    the head names (else any at the page's start), and the links (target, element)."""
    lines, line, title, charset, links, head = [], [], None, None, [], True

    def end():
        if text := " ".join("".join(line).split()):
            lines.append(text)
        line.clear()

    for name, mark, rest in html_text.tokens(page, UNPARSED):
        if name is None:
            line.append(html.unescape(mark))
            continue
        if name in BREAKS:
            end()
        if mark == "=":
            if name in SEEN:
                line.append(html.unescape(rest))
            if name == "title":
                title = title if title is not None else " ".join(html.unescape(rest).split())
                end()
            continue
        if name == "body" and not mark or name == "head" and mark:
            head = False
        if mark:
            continue
        if name in LINKS and (to := html_text.attributes(rest).get(LINKS[name])):
            links.append((" ".join(html.unescape(to).split()), name))
        elif name == "meta" and head and charset is None and (m := CHARSET.search(rest)):
            charset = m[1].lower()
    end()
    if charset is None and (m := CHARSET.search(page[:START])):
        charset = m[1].lower()
    return "\n".join(lines), title, charset, links


def unchunked(data: bytes) -> bytes:
    """The content of a chunked body; data that isn't chunked, though a header says so, stays."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at, at + 1024)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF") or len(size) > 12:
            break
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else data


def inflated(data: bytes, *windows: int) -> bytes:
    """Zlib data by the first of these formats in which it begins, as far as it goes."""
    for w in windows:
        d, out = zlib.decompressobj(w), []
        with contextlib.suppress(zlib.error):
            for i in range(0, len(data), 1 << 16):
                out.append(d.decompress(data[i : i + (1 << 16)]))
        if any(out) or d.eof:
            return b"".join(out)
    return data


def unzstd(data: bytes) -> bytes:
    import zstandard

    out, d = [], zstandard.ZstdDecompressor().decompressobj()
    with contextlib.suppress(zstandard.ZstdError):
        for i in range(0, len(data), 1 << 16):
            out.append(d.decompress(data[i : i + (1 << 16)]))
    return b"".join(out)


DECODERS = {"gzip": lambda b: inflated(b, 47), "x-gzip": lambda b: inflated(b, 47), "deflate": lambda b: inflated(b, 47, -15), "zstd": unzstd, "identity": bytes, "": bytes}


def body(response: dict) -> bytes | None:
    """The payload without its encodings; None if one isn't known."""
    data, said = response["payload"], {}
    for k, v in headers(response["head"]):
        said.setdefault(k.lower(), v.lower())
    if "chunked" in said.get("transfer-encoding", ""):
        data = unchunked(data)
    for name in reversed(said.get("content-encoding", "").split(",")):
        if (name := name.strip()) not in DECODERS:
            return None
        data = DECODERS[name](data)
    return data


def derivatives(response: dict) -> Iterator[dict]:
    """The metadata record (application/warc-fields) and the conversion record of a response."""
    kind = next((v.lower() for k, v in headers(response["head"]) if k.lower() == "content-type"), "")
    said, data = CHARSET.search(kind), body(response)
    is_page = data is not None and (not kind or "html" in kind)
    is_text = data is not None and (is_page or kind.startswith("text/"))
    page, text, title, charset, links = "", "", None, None, []
    if is_text:
        for encoding in (said[1] if said else "utf-8", "utf-8"):
            try:
                page = data.decode(encoding, "replace")
                break
            except (LookupError, ValueError):
                continue
        text, title, charset, links = read_page(page) if is_page else (page, None, None, [])
    charset = said[1] if said else charset
    status = response["head"].split("\r\n")[0].split(" ")
    fields = [("title", title)] if title is not None else []
    fields += [("charset-detected", charset)] if charset else []
    fields += [("http-status", status[1] if len(status) > 1 else "")]
    fields += [("outlink", f"{to} {name}") for to, name in links]
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    for warc_type, content_type, content in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        raw = content.encode("utf-8", "surrogatepass")
        made = digest(raw)
        yield {"record_id": record_id(warc_type, response["record_id"]), "warc_type": warc_type, "refers_to": response["record_id"], "target_uri": response["target_uri"], "warc_date": response["date"], "content_type": content_type, "content_length": len(raw), "block_digest": made, "payload_digest": made, "source_headers": json.dumps(headers(response["head"])), "source_block_digest": response["block_digest"], "source_payload_digest": response["payload_digest"], "content": content}


def headers(head: str) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]) if k.strip()]


def to_warc(record: dict) -> bytes:
    """A record of `derivatives` in WARC/1.1 format; the source's headers and digests are WARC-Source-... fields."""
    fields = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["warc_date"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record["payload_digest"]), ("WARC-Source-Block-Digest", record["source_block_digest"]), ("WARC-Source-Payload-Digest", record["source_payload_digest"]), ("WARC-Source-Headers", record["source_headers"]), ("Content-Type", record["content_type"]), ("Content-Length", str(record["content_length"]))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass") + record["content"].encode("utf-8", "surrogatepass") + b"\r\n\r\n"


class Members(io.RawIOBase):
    """The content of a gzip file of any number of members, as far as it is whole; torn or broken compression ends it."""

    def __init__(self, file):
        self.file, self.member, self.held = file, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        out = b""
        while not out:
            data = self.member.unconsumed_tail or self.held or self.file.read(1 << 16)
            self.held = b""
            if not data:
                return 0
            try:
                out = self.member.decompress(data, len(buffer))
            except zlib.error:
                return 0
            if self.member.eof:
                self.held, self.member = self.member.unused_data, zlib.decompressobj(31)
        buffer[: len(out)] = out
        return len(out)


def read_records(file, kinds: tuple[str, ...] | None = None) -> Iterator[tuple[dict, bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file, gzipped or not, given as bytes or a stream.

    Blocks of other kinds than those asked for are passed over unread, so one record is held at a time.
    """
    f = io.BufferedReader(io.BytesIO(file) if isinstance(file, bytes) else file, 1 << 20)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = io.BufferedReader(Members(f), 1 << 20)
    line = f.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = f.readline()
            continue
        fields = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(k.strip().lower(), v.strip())
        size = fields.get("content-length", "0")
        if not (size.isascii() and size.isdigit()):
            line = f.readline()  # its end is unknown: on to the next record's first line
            continue
        left, wanted, block = int(size), kinds is None or fields.get("warc-type", "").lower() in kinds, []
        while left and (data := f.read(min(left, 1 << 20))):
            left -= len(data)
            if wanted:
                block.append(data)
        if left:
            return
        if wanted:
            yield fields, b"".join(block)
        line = f.readline()


def response_of_record(fields: dict, block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {"record_id": fields.get("warc-record-id", ""), "target_uri": fields.get("warc-target-uri", ""), "date": fields.get("warc-date", ""), "block_digest": fields.get("warc-block-digest") or digest(block), "payload_digest": fields.get("warc-payload-digest") or digest(payload), "head": head.decode("utf-8", "replace") + "\r\n", "payload": payload}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t, _) in enumerate(COLUMNS)], names=[n for n, _, _ in COLUMNS])


def _pages(it):
    for b in it:
        rows = []
        for page_id, url, page in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            for r in derivatives(response_of_page(url or "", (page or "").encode("utf-8", "surrogatepass"), page_id)):
                rows.append((page_id, *(r[n] for n, _, _ in COLUMNS[1:])))
        if rows:
            yield _batch(rows)


def _open(path: str):
    """A stream of a file, on whatever file system pyarrow reads."""
    import pyarrow.fs

    system, name = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return system.open_input_stream(name, compression=None)


def _files(it):
    for b in it:
        for path in b.column(0).to_pylist():
            rows, size = [], 0
            with _open(path) as file:
                for fields, block in read_records(file, ("response",)):
                    for r in derivatives(response_of_record(fields, block)):
                        rows.append((None, *(r[n] for n, _, _ in COLUMNS[1:])))
                        size += r["content_length"]
                    if len(rows) >= 1000 or size >= 1 << 24:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)


def derive_pages(pages: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every page; no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(trimmed(_pages), SCHEMA)


def derive_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of the responses in WARC files; page_id is null. Only names of files pass through the plan; a task reads each as a stream."""
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(trimmed(_files), SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_pages(table(spark, sf_dir, "pages"))
