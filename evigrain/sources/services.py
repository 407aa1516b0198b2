"""Sources behind a network: a REST review service as a Python data source, and full-text extraction over HTTP. Both
take the call that reaches the service as a function, so they run without a network in tests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, dict], bytes]


def http_fetch(url: str, headers: dict) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=60) as answer:  # noqa: S310 - the caller's own address
        return answer.read()


class _Page(InputPartition):
    def __init__(self, review: str):
        self.review = review


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch

    def partitions(self):
        return [_Page(r) for r in self.options["reviews"].split(",") if r]

    def read(self, partition: _Page) -> Iterator[tuple]:
        headers = {"Authorization": f"Bearer {self.options.get('token', '')}", "Accept": "application/json"}
        body = json.loads(self.fetch(f"{self.options['url'].rstrip('/')}/reviews/{partition.review}/source-files", headers))
        for row in body.get("data", body) if isinstance(body, dict) else body:
            yield int(partition.review), row.get("extraction_status"), row.get("extracted_text"), {k: str(v) for k, v in (row.get("extracted_metadata") or {}).items()}


def review_source(fetch: Fetch = http_fetch) -> type[DataSource]:
    """A data source 'review_files': options url, token, reviews (ids parted by commas); one task a review. Register it
    with spark.dataSource.register(review_source())."""

    class ReviewFiles(DataSource):
        @classmethod
        def name(cls):
            return "review_files"

        def schema(self):
            return "review_id bigint, extraction_status string, extracted_text string, extracted_metadata map<string,string>"

        def reader(self, schema):
            return _Reader(dict(self.options), fetch)

    return ReviewFiles


def review_protocol(url: str, review: str, token: str = "", fetch: Fetch = http_fetch) -> tuple:
    """The protocol of a review as a row of plans.protocol.PROTOCOL: one small answer, fetched on the driver."""
    body = json.loads(fetch(f"{url.rstrip('/')}/reviews/{review}", {"Authorization": f"Bearer {token}", "Accept": "application/json"}))
    row = body.get("data", body)
    own = row.get("protocol") or row
    return int(review), row.get("title"), *(own.get(n) for n in ("population", "intervention", "comparison", "outcome")), [str(f) for f in own.get("extraction_fields") or []]


def tei_extractor(url: str, post: Callable[[str, bytes], bytes]) -> Callable[[bytes], str]:
    """The function bibliography.extract_pdfs takes: sends a file to a full-text service and returns its TEI."""
    def extract(content: bytes) -> str:
        return post(f"{url.rstrip('/')}/api/processFulltextDocument", content).decode("utf-8")

    return extract


def http_post(url: str, content: bytes, field: str = "input") -> bytes:
    """A file sent as one field of a form."""
    from urllib.request import Request, urlopen
    from uuid import uuid4

    mark = uuid4().hex
    head = f'--{mark}\r\nContent-Disposition: form-data; name="{field}"; filename="file.pdf"\r\nContent-Type: application/pdf\r\n\r\n'
    body = head.encode() + content + f"\r\n--{mark}--\r\n".encode()
    with urlopen(Request(url, data=body, headers={"Content-Type": f"multipart/form-data; boundary={mark}"}), timeout=300) as answer:  # noqa: S310 - the caller's own address
        return answer.read()


def tei_service(url: str) -> Callable[[bytes], str]:
    return tei_extractor(url, http_post)


def local_text(content: bytes) -> str:
    """The text of a PDF without any service: the strings shown by its content streams (plain or deflated), line by line.
    Fonts with an encoding of their own, encrypted files and scans give nothing usable; ValueError if no text is found."""
    import re
    import zlib

    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    shown = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T\*|T[dD]\b|'|\"|ET\b|[-\d.]+")
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}

    def string(token: bytes) -> str:
        if token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1]).decode()
            raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
        else:
            raw = re.sub(rb"\\([0-7]{1,3})|\\(.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1) else escapes.get(m.group(2), m.group(2)), token[1:-1], flags=re.S)
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")

    lines: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m.group(1)
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            pass
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            now = ""
            for token in shown.findall(block):
                if token[:1] in b"(<":
                    now += string(token)
                elif token[:1] == b"-" and token[1:].replace(b".", b"").isdigit() and float(token) < -200 and now and not now.endswith(" "):
                    now += " "  # a wide step to the right within a line
                elif token[:1] in b"T'\"" and now.strip():
                    lines.append(now.strip())
                    now = ""
            if now.strip():
                lines.append(now.strip())
    if not lines:
        raise ValueError("no text found")
    return "\n".join(lines)
