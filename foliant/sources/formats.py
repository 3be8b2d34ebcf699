"""Sections of files by format, for :func:`foliant.sources.readers.import_files`."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa

MOST_ENTRIES, MOST_TEXT = 5000, 16 << 20


class Rejected(ValueError):
    """A file that is not read; its text is the reason."""


def decode(raw: bytes) -> str:
    """UTF-16 by its mark, else UTF-8 with or without a mark, else refused."""
    try:
        return raw.decode("utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Rejected("ENCODING") from e


def _tree(raw: bytes) -> ElementTree.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
        raise Rejected("DTD")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Rejected("XML") from e


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(tree: ElementTree.Element, names: tuple[str, ...]) -> str:
    found = ("".join(x.itertext()) for x in tree.iter() if _local(x.tag) in names)
    return "\n\n".join(" ".join(p.split()) for p in found if p.strip())


def _archive(raw: bytes) -> dict[str, bytes]:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Rejected("ARCHIVE") from e
    names = [i.filename for i in z.infolist()]
    if len(names) > MOST_ENTRIES or len(set(names)) != len(names) or sum(i.file_size for i in z.infolist()) > 8 * MOST_TEXT:
        raise Rejected("ARCHIVE_LIMITS")
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Rejected("ENCRYPTED")
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise Rejected("PATH")
    return {n: z.read(n) for n in names if not n.endswith("/")}


def _html(text: str) -> str:
    import html

    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "", text)
    text = re.sub(r"(?i)</?(?:p|div|br|li|h[1-3]|tr|section)\b[^>]*>", "\n", text)
    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"(?s)<[^>]*>", "", text)).split("\n"))
    return "\n".join(x for x in lines if x)


def sections(name: str, raw: bytes) -> list[tuple[str, str]]:
    """(title, text) of a file, by its ending."""
    stem, _, end = name.rsplit("/", 1)[-1].rpartition(".")
    end = end.lower()
    if end in ("txt", "md", "markdown"):
        text = decode(raw)
        heading = re.search(r"(?m)^# (.+)$", text)
        return [(heading[1].strip() if heading else stem, text)]
    if end in ("html", "htm", "xhtml"):
        return [(stem, _html(decode(raw)))]
    if end in ("json", "jsonl", "ndjson"):
        try:
            rows = json.loads(decode(raw)) if end == "json" else [json.loads(x) for x in decode(raw).splitlines() if x.strip()]
        except ValueError as e:
            raise Rejected("JSON") from e
        rows = [r for r in (rows if isinstance(rows, list) else [rows]) if isinstance(r, dict)]
        return [(str(r.get("title") or r.get("name") or "Untitled"), str(r.get("text") or r.get("content") or r.get("body") or "")) for r in rows]
    if end in ("csv", "tsv"):
        table = csv.reader(io.StringIO(decode(raw)), delimiter="," if end == "csv" else "\t")
        return [(stem, "\n".join(" | ".join(r) for r in table if any(r)))]
    if end == "fb2":
        return [(stem, _paragraphs(_tree(raw), ("p", "title", "subtitle")))]
    if end == "docx":
        return [(stem, _paragraphs(_tree(_archive(raw).get("word/document.xml", b"")), ("p",)))]
    if end == "odt":
        return [(stem, _paragraphs(_tree(_archive(raw).get("content.xml", b"")), ("p", "h")))]
    if end == "pptx":
        slides = {int(m[1]): data for n, data in _archive(raw).items() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
        return [(f"Slide {k}", _paragraphs(_tree(slides[k]), ("p",))) for k in sorted(slides)]
    if end == "epub":
        files = _archive(raw)
        package = next((n for n in files if n.endswith(".opf")), None)
        if package is None:
            raise Rejected("EPUB")
        tree, base = _tree(files[package]), package.rpartition("/")[0]
        items = {x.get("id"): x.get("href") for x in tree.iter() if _local(x.tag) == "item"}
        spine = [items.get(x.get("idref")) for x in tree.iter() if _local(x.tag) == "itemref"]
        return [(h, _html(decode(files[p]))) for h in spine if h and (p := f"{base}/{h}" if base else h) in files]
    raise Rejected("FORMAT")


def extract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, status, reason, sections) of files (path, content)."""
    kind = pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())]))
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                found = [(t, x) for t, x in sections(path, raw) if x.strip()]
                if not found:
                    raise Rejected("EMPTY")
                if sum(len(x) for _, x in found) > MOST_TEXT:
                    raise Rejected("TEXT_LIMIT")
                rows.append((path, "IMPORTED", None, [{"title": t, "text": x} for t, x in found]))
            except Rejected as e:
                rows.append((path, "REJECTED", str(e), []))
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), kind))], names=["path", "status", "reason", "sections"])
