"""EPUB archives: admission, ordered spine, rebuilt archives, and the machine-translation mark.

Files are rows: Spark lists and deals them, a small helper opens one archive at a time, and
everything after is columns. An archive that can't be admitted is a row with a status, not a
failed job; its size is tested before a byte of it is read.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from foliant.functions import fixed
from foliant.sources import html

_CONTAINER, _MIMETYPE = "META-INF/container.xml", "application/epub+zip"
_EMPTY_SPINE = "empty"


@dataclass(frozen=True)
class Limits:
    archive_bytes: int = fixed.MAX_ARCHIVE_BYTES
    entries: int = fixed.MAX_ENTRIES
    uncompressed: int = fixed.MAX_UNCOMPRESSED


def archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """path, size, archive (null above the size limit) of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= limits.archive_bytes).select("path", F.col("length").alias("size"), F.col("content").alias("archive"))
    large = files.where(F.col("length") > limits.archive_bytes).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("archive"))
    return small.unionByName(large)


def _unsafe(name: str) -> bool:
    return not name or "\0" in name or name[0] in "/\\" or bool(re.match(r"[A-Za-z]:[\\/]", name)) or ".." in re.split(r"[\\/]", name)


def admission(archive: bytes | None, limits: Limits = Limits()) -> str:
    """ok, or why an archive is refused; only its directory is read."""
    return _admitted(archive, limits)[0]


def _admitted(archive: bytes | None, limits: Limits) -> tuple[str, zipfile.ZipFile | None]:
    """The admission, and the archive with its directory as it was read for it, so that it is read once."""
    if archive is None or len(archive) > limits.archive_bytes:
        return "too large", None
    end = archive.rfind(b"PK\x05\x06", max(0, len(archive) - 22 - 65535))
    if len(archive) < 22 or end < 0 or end + 22 > len(archive):
        return "not an archive", None
    number = lambda at, n: int.from_bytes(archive[end + at : end + at + n], "little")
    if number(4, 2) or number(6, 2) or number(8, 2) != number(10, 2) or number(10, 2) == 0xFFFF or 0xFFFFFFFF in (number(12, 4), number(16, 4)):
        return "multi-disk or 64-bit", None
    if number(10, 2) > limits.entries:
        return "too many entries", None
    if number(12, 4) + number(16, 4) > end:
        return "directory out of bounds", None
    try:
        book = zipfile.ZipFile(io.BytesIO(archive))
    except (zipfile.BadZipFile, NotImplementedError, UnicodeDecodeError, ValueError):
        return "malformed directory", None
    entries = book.infolist()
    names = [e.orig_filename for e in entries]
    if any(map(_unsafe, names)):
        return "unsafe path", None
    if len(set(names)) != len(names):
        return "duplicate entry", None
    if sum(e.file_size for e in entries) > limits.uncompressed:
        return "expands too far", None
    return "ok", book


def _members(book: zipfile.ZipFile, limits: Limits) -> dict[str, bytes]:
    """Entries by path; no more is unpacked than the directory announced and the limit allows."""
    out, left = {}, limits.uncompressed
    for e in book.infolist():
        with book.open(e) as f:
            out[e.filename] = f.read(left + 1)
        left -= len(out[e.filename])
        if left < 0:
            raise ValueError("expands too far")
    return out


def package_path(members: dict[str, bytes]) -> str:
    container = ElementTree.fromstring(members[_CONTAINER])
    return next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))


def package_parts(package: str) -> tuple[str | None, list[dict], list[str | None]]:
    """Title, manifest items (id, href, media_type; the last of an id counts) and the spine's references."""
    tree = ElementTree.fromstring(package)
    local = lambda x: x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""
    title = next((" ".join("".join(x.itertext()).split()) for x in tree.iter() if isinstance(x.tag, str) and x.tag.endswith("}title")), None)
    items = {x.get("id"): {"id": x.get("id"), "href": x.get("href"), "media_type": x.get("media-type")} for x in tree.iter() if local(x) == "item"}
    return title, list(items.values()), [x.get("idref") for x in tree.iter() if local(x) == "itemref"]


_CHAPTER = {"spine_pos": pa.int64(), "item_id": pa.string(), "href": pa.string(), "media_type": pa.string(), "content": pa.string()}
_ITEM = {"id": pa.string(), "href": pa.string(), "media_type": pa.string()}
#: What is known of a file besides its path.
_BOOK = {
    "status": pa.string(), "package_path": pa.string(), "package": pa.string(), "title": pa.string(),
    "items": pa.list_(pa.struct(list(_ITEM.items()))), "refs": pa.list_(pa.string()), "chapters": pa.list_(pa.struct(list(_CHAPTER.items()))),
}


def resolved(folder: str, href: str) -> str:
    """Path in the archive of a link relative to a folder; `..` above the root stays there."""
    out: list[str] = []
    for part in f"{folder}/{href}".split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def unpack(archive: bytes | None, limits: Limits = Limits()) -> dict:
    """One archive, opened once: status, package document, title, manifest, references, and the readable chapters in order.

    References meet the manifest and then the entries; what misses either, or is no readable type, is left out. An
    archive without a chapter is `empty`.
    """
    status, book = _admitted(archive, limits)
    out = dict.fromkeys(_BOOK) | {"status": status, "items": [], "refs": [], "chapters": []}
    if book is None:
        return out
    try:
        members = _members(book, limits)
        at = package_path(members)
        package = members[at].decode("utf-8")
        title, items, refs = package_parts(package)
    except (KeyError, StopIteration, ElementTree.ParseError, UnicodeDecodeError, zipfile.BadZipFile, ValueError) as e:
        return out | {"status": f"unreadable: {type(e).__name__}"}
    known, chapters = {x["id"]: x for x in items}, []
    for ref in refs:
        item = known.get(ref)
        href = resolved(posixpath.dirname(at), item["href"]) if item and item["href"] else None
        if href in members and item["media_type"] in fixed.XHTML_TYPES:
            chapters.append({"spine_pos": len(chapters), "item_id": ref, "href": href, "media_type": item["media_type"], "content": members[href].decode("utf-8", "replace")})
    return {"status": "ok" if chapters else _EMPTY_SPINE, "package_path": at, "package": package, "title": title, "items": items, "refs": refs, "chapters": chapters}


#: Bytes and rows that leave a task together: a batch of its own for each book cost more than the book.
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 1024


def together(rows: Iterable[tuple[list[dict], int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come as (rows of a book, their bytes); what is held is bounded but for a single book."""
    held, size = [], 0
    for made, n in rows:
        held += made
        size += n
        if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _each(files: DataFrame, work: Callable[[dict], tuple[dict, int] | None], columns: dict[str, pa.DataType], keep: Sequence[str] = ()) -> DataFrame:
    """path, the columns that work makes of each row (and their bytes; none: no row), and columns of the files that are kept."""
    kept = [f for f in files.schema if f.name in keep]
    types = {f.name: to_arrow_type(f.dataType) for f in kept}
    schema = pa.schema(list(({"path": pa.string()} | columns | types).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(b.schema.names, (c[i].as_py() for c in b.columns))) for b in batches for i in range(b.num_rows))
        made = ((row, work(row)) for row in rows)
        yield from together((([{"path": row["path"], **m[0], **{c: row[c] for c in types}}], m[1] + sum(len(row[c]) for c in types if isinstance(row[c], bytes))) for row, m in made if m), schema)

    return files.mapInArrow(run, StructType([StructField("path", StringType()), *(StructField(c, from_arrow_type(k)) for c, k in columns.items()), *kept]))


def books(files: DataFrame, limits: Limits = Limits(), keep: Sequence[str] = ()) -> DataFrame:
    """One row per file: path, status, package_path, package, title, items, refs, chapters, and columns of the files that are kept."""

    def work(row: dict) -> tuple[dict, int]:
        book = unpack(row["archive"], limits)
        return book, len(book["package"] or "") + sum(len(c["content"]) for c in book["chapters"])

    return _each(files.select("path", "archive", *keep), work, _BOOK, keep)


def spine(opened: DataFrame) -> DataFrame:
    """path, title, spine_pos, item_id, href, media_type, content: the readable items in reading order."""
    return opened.select("path", "title", F.explode("chapters").alias("c")).select("path", "title", "c.*")


def result_view(translated: DataFrame, original: DataFrame) -> DataFrame:
    """path, href, title, original, translated: translated items beside the original of the same link, empty where there is none.

    Both are spines (path, spine_pos, href, content); of several originals with one link the first counts.
    """
    first = original.groupBy("path", "href").agg(F.min_by("content", "spine_pos").alias("original"))
    fallback = F.concat(F.lit(fixed.CHAPTER_TITLE), F.lit(" "), (F.col("spine_pos") + 1).cast("string"))
    items = translated.select("path", "href", html.title(F.col("content"), fallback).alias("title"), html.body(F.col("content")).alias("translated"))
    return items.join(first, ["path", "href"], "left").select("path", "href", "title", F.coalesce(html.body(F.col("original")), F.lit("")).alias("original"), "translated")


def written(chapters: DataFrame) -> DataFrame:
    """path and archive of new books from (path, title, pos, href, content): a book's chapters in one row."""
    return bound(chapters.groupBy("path").agg(F.min("title").alias("title"), F.sort_array(F.collect_list(F.struct("pos", "href", "content"))).alias("chapters")))


def bound(books_: DataFrame) -> DataFrame:
    """path and archive of new books from (path, title, chapters): chapters are structs with href and content, in their order."""

    def work(row: dict) -> tuple[dict, int]:
        made = _archive(row["title"], row["chapters"])
        return {"archive": made}, len(made)

    return _each(books_.select("path", "title", "chapters"), work, {"archive": pa.binary()})


def _archive(title: str | None, chapters: list[dict]) -> bytes:
    package = ElementTree.Element("package", {"xmlns": "http://www.idpf.org/2007/opf", "version": "3.0"})
    metadata = ElementTree.SubElement(package, "metadata", {"xmlns:dc": "http://purl.org/dc/elements/1.1/"})
    ElementTree.SubElement(metadata, "dc:title").text = title or ""
    manifest, order = ElementTree.SubElement(package, "manifest"), ElementTree.SubElement(package, "spine")
    for k, c in enumerate(chapters):
        ElementTree.SubElement(manifest, "item", {"id": f"c{k}", "href": c["href"], "media-type": fixed.XHTML_TYPES[0]})
        ElementTree.SubElement(order, "itemref", {"idref": f"c{k}"})
    container = '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
    files = {_CONTAINER: container, "OEBPS/content.opf": ElementTree.tostring(package, "unicode"), **{posixpath.normpath(f"OEBPS/{c['href']}"): c["content"] for c in chapters}}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        still = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        z.writestr(still("mimetype"), _MIMETYPE, zipfile.ZIP_STORED)
        for name, text in files.items():
            z.writestr(still(name), text.encode("utf-8", "surrogatepass"), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rebuild(archive: bytes | zipfile.ZipFile, replaced: dict[str, bytes], limits: Limits = Limits(), note: str | None = None, name: str = "translation") -> bytes:
    """The archive with entries replaced (or added) and marked with the note, if any; the type entry first and not compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        still = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # noqa: E731  (equal inputs, equal bytes)
        z.writestr(still("mimetype"), _MIMETYPE, zipfile.ZIP_STORED)
        members = _members(archive if isinstance(archive, zipfile.ZipFile) else zipfile.ZipFile(io.BytesIO(archive)), limits) | replaced
        if note is not None:
            at = package_path(members)
            page = resolved(posixpath.dirname(at), f"{name}-colophon.xhtml")
            members[at] = marked_package(members[at].decode("utf-8"), note, name).encode()
            members.setdefault(page, colophon(note).encode())
        for path, content in members.items():
            if path != "mimetype":
                z.writestr(still(path), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rebuilt(files: DataFrame, replacements: DataFrame | None, note: str | None = None, limits: Limits = Limits(), keep: Sequence[str] = ()) -> DataFrame:
    """path and archive of admitted files with replacements (path, href, content), if any, in place, and columns of the files that are kept.

    With a note, the mark of machine translation is set too: in the package document, and as a page at the end.
    A package that can't take it fails the job, since an unmarked delivery must not pass silently.
    """
    files = files.select("path", "archive", *keep)
    if replacements is not None:
        files = files.join(replacements.groupBy("path").agg(F.collect_list(F.struct("href", "content")).alias("changes")), "path", "left")

    def work(row: dict) -> tuple[dict, int] | None:
        _, book = _admitted(row["archive"], limits)
        if book is None:
            return None
        made = rebuild(book, {c["href"]: c["content"].encode() for c in row.get("changes") or []}, limits, note)
        return {"archive": made}, len(made)

    return _each(files, work, {"archive": pa.binary()}, keep)


# ---- the mark of machine translation -------------------------------------------------------

#: Fixed values of the metadata standard.
IPTC_PREFIX = "iptc: http://iptc.org/std/Iptc4xmpExt/2008-02-29/"
SOURCE_TYPE = "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"
DUBLIN_CORE = "http://purl.org/dc/elements/1.1/"


def marked_package(package: str, note: str, name: str = "translation") -> str:
    """The package document as a tree, with a declared prefix, two metadata elements and a last page added.

    A document that has the mark stays as it is, letter by letter; one without metadata, manifest or spine is refused.
    """
    root = ElementTree.fromstring(package, ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)))
    mark, page = f"{name}-ai-marker", f"{name}-colophon"
    if any(x.get("id") == mark for x in root.iter()):
        return package
    prefixes = [space for _, space in ElementTree.iterparse(io.StringIO(package), events=["start-ns"])]
    kind = root.tag[: -len("package")] if root.tag.endswith("package") else None
    parts = {} if kind is None else {p: root.find(f"{kind}{p}") for p in ("metadata", "manifest", "spine")}
    if not parts or any(p is None for p in parts.values()):
        raise ValueError("the package document can't be marked")
    declared = root.get("prefix", "")
    if IPTC_PREFIX not in declared:
        root.set("prefix", f"{declared} {IPTC_PREFIX}".strip())
    ElementTree.SubElement(parts["metadata"], f"{kind}meta", {"property": "iptc:DigitalSourceType"}).text = SOURCE_TYPE
    ElementTree.SubElement(parts["metadata"], f"{{{DUBLIN_CORE}}}description", {"id": mark}).text = note
    ElementTree.SubElement(parts["manifest"], f"{kind}item", {"id": page, "href": f"{page}.xhtml", "media-type": fixed.XHTML_TYPES[0]})
    ElementTree.SubElement(parts["spine"], f"{kind}itemref", {"idref": page})
    for prefix, uri in [("dc", DUBLIN_CORE), *prefixes]:
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ElementTree.tostring(root, "unicode")


def colophon(note: str) -> str:
    """The page that says it."""
    html = ElementTree.Element("html", {"xmlns": "http://www.w3.org/1999/xhtml"})
    ElementTree.SubElement(ElementTree.SubElement(html, "head"), "title").text = "Colophon"
    ElementTree.SubElement(ElementTree.SubElement(html, "body"), "p").text = note
    return '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n' + ElementTree.tostring(html, "unicode")
