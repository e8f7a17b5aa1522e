"""Archives built in memory: reading, admission, rebuilding and the mark."""

import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources import epub, epub_source

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> Test  Book </dc:title></metadata>
<manifest><item id="c2" href="text/../c2.xhtml" media-type="application/xhtml+xml"/><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="css" href="a.css" media-type="text/css"/></manifest>
<spine><itemref idref="c1"/><itemref idref="css"/><itemref idref="missing"/><itemref idref="c2"/></spine></package>"""


def archive(extra=(), opf=OPF):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/c1.xhtml", "<html><body><h1>One</h1><p>Hello</p></body></html>")
        z.writestr("OEBPS/c2.xhtml", "<html><body><p>Two</p></body></html>")
        z.writestr("OEBPS/a.css", "p {}")
        for name, content in extra:
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def files(spark):
    rows = [("a", bytearray(archive())), ("slip", bytearray(archive([("../evil", "x")]))), ("junk", bytearray(b"nothing" * 9)), ("big", None), ("bare", bytearray(archive(opf=OPF.replace("xhtml+xml", "pdf"))))]
    return spark.createDataFrame(rows, "path string, archive binary")


def test_spine_and_status(files):
    opened = epub.books(files)
    assert {r.path: r.status for r in opened.collect()} == {"a": "ok", "slip": "unsafe path", "junk": "not an archive", "big": "too large", "bare": "empty"}
    assert [r.title for r in opened.where("path = 'a'").collect()] == ["Test Book"]
    got = sorted((r.spine_pos, r.item_id, r.href) for r in epub.spine(opened).collect())
    assert got == [(0, "c1", "OEBPS/c1.xhtml"), (1, "c2", "OEBPS/c2.xhtml")]


def test_admission():
    assert epub.admission(archive()) == "ok"
    assert epub.admission(b"") == "not an archive"
    assert epub.admission(archive(), epub.Limits(entries=3)) == "too many entries"
    assert epub.admission(archive(), epub.Limits(uncompressed=100)) == "expands too far"
    assert epub.admission(archive([("x", "0" * 2_000_000)]), epub.Limits(uncompressed=1_000_000)) == "expands too far"
    with pytest.warns(UserWarning):
        twice = archive([("OEBPS/a.css", "q")])
    assert epub.admission(twice) == "duplicate entry"
    a = archive()
    end = a.rfind(b"PK\x05\x06")
    assert epub.admission(a[: end + 4] + struct.pack("<H", 1) + a[end + 6 :]) == "multi-disk or 64-bit"


def test_rebuilt_round_trip(files):
    changes = files.sparkSession.createDataFrame([("a", "OEBPS/c1.xhtml", "<p>Új</p>")], "path string, href string, content string")
    got = {r.path: bytes(r.archive) for r in epub.rebuilt(files, changes).collect()}
    assert sorted(got) == ["a", "bare"]
    with zipfile.ZipFile(io.BytesIO(got["a"])) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert z.read("OEBPS/c1.xhtml").decode() == "<p>Új</p>"
        assert z.read("OEBPS/c2.xhtml") == b"<html><body><p>Two</p></body></html>"


def test_mark():
    text = epub.marked_package(OPF, "machine translation & more")
    assert text.count("translation-ai-marker") == 1 and text.index("DigitalSourceType") < text.index("</metadata>")
    assert text.count("prefix=") == 1 and "machine translation &amp; more" in text and "ns0" not in text
    title, items, refs = epub.package_parts(text)
    assert title == "Test Book" and items[-1] == {"id": "translation-colophon", "href": "translation-colophon.xhtml", "media_type": "application/xhtml+xml"} and refs[-1] == "translation-colophon"
    assert epub.marked_package(text, "machine translation & more") == text
    for bad in ("<x/>", OPF.replace("spine>", "other>")):
        with pytest.raises(ValueError, match="can't be marked"):
            epub.marked_package(bad, "note")


def test_mark_beside_comments_prefixes_and_spaces():
    odd = OPF.replace("<package ", "<package prefix='x: http://x/' ").replace("</metadata>", "<!-- </metadata> --></metadata >").replace("</spine>", "<!-- </spine> </manifest> --></spine >")
    text = epub.marked_package(odd, "note")
    assert text.count("translation-ai-marker") == 1 and text.count('"translation-colophon"') == 2 and "<!-- </metadata> -->" in text
    assert f'prefix="x: http://x/ {epub.IPTC_PREFIX}"' in text


def test_rebuilt_with_a_note_reads_back(files):
    none = files.sparkSession.createDataFrame([], "path string, href string, content string")
    once = epub.rebuilt(files.where("path = 'a'"), none, "by machine")
    book = epub.books(once).first()
    assert book.status == "ok" and [c.item_id for c in book.chapters] == ["c1", "c2", "translation-colophon"] and "by machine" in book.chapters[2].content
    assert epub.rebuilt(once, none, "by machine").first().archive == once.first().archive


@pytest.mark.parametrize("folder,href,path", [("OEBPS", "a.xhtml", "OEBPS/a.xhtml"), ("OEBPS", "./text/../b.xhtml", "OEBPS/b.xhtml"), ("", "../../c", "c"), ("a/b", "/d", "a/b/d")])
def test_links_are_resolved(spark, folder, href, path):
    assert epub.resolved(folder, href) == path
    assert spark.createDataFrame([(folder, href)], "f string, h string").select(T.resolve_href(F.col("f"), F.col("h"))).first()[0] == path


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(archive())
    (tmp_path / "c.epub").write_bytes(archive([("pad", "x" * 90_000)]))
    got = {r.path[-6:]: r.archive is None for r in epub.archives(spark, str(tmp_path), epub.Limits(archive_bytes=50_000)).collect()}
    assert got == {"b.epub": False, "c.epub": True}


# ---- the data source -----------------------------------------------------------------------


def books(spark, *rows):
    return spark.createDataFrame([(n, None if a is None else bytearray(a)) for n, a in rows], "path string, archive binary").repartition(3)


def found(spark, path, **options):
    return sorted((r.path, r.status, r.item_id) for r in spark.read.format("epub").options(**options).load(path).collect())


def test_written_killed_rewritten_and_read(spark, tmp_path):
    epub_source.register(spark)
    path = f"{tmp_path}/lib"
    good = [("a.epub", "ok", "c1"), ("a.epub", "ok", "c2"), ("j.epub", "not an archive", None)]
    books(spark, ("a.epub", archive()), ("j.epub", b"junk" * 20)).write.format("epub").mode("overwrite").save(path)
    assert found(spark, path) == good
    for bad in ([("b.epub", archive()), ("c.epub", None)], [("b.epub", archive()), ("../c.epub", archive())], [("b.epub", archive()), ("b.epub", archive())]):
        with pytest.raises(Exception):  # a task dies, or the commit does: nothing of it is seen
            books(spark, *bad).write.format("epub").mode("overwrite").save(path)
        assert found(spark, path) == good
    books(spark, ("b.epub", archive()), ("j.epub", archive())).write.format("epub").mode("append").save(path)
    assert [x for x in found(spark, path) if x[2] != "c2"] == [("a.epub", "ok", "c1"), ("b.epub", "ok", "c1"), ("j.epub", "ok", "c1")]
    books(spark, ("n.epub", archive())).write.format("epub").mode("overwrite").save(path)
    assert epub_source.vacuum(path) >= 4
    assert found(spark, path) == [("n.epub", "ok", "c1"), ("n.epub", "ok", "c2")]


def test_plain_folder_limits_and_pushed_filters(spark, tmp_path):
    epub_source.register(spark)
    (tmp_path / "deep").mkdir()
    for name, extra in (("a.epub", ()), ("deep/b.epub", [("pad", os.urandom(30_000))]), ("c.epub", [("pad", os.urandom(90_000))]), ("note.txt", ())):
        (tmp_path / name).write_bytes(archive(extra))
    assert {x[:2] for x in found(spark, str(tmp_path), maxBytes="50000")} == {("a.epub", "ok"), ("deep/b.epub", "ok"), ("c.epub", "too large")}
    d = spark.read.format("epub").load(f"file:{tmp_path}")
    assert {r.path for r in d.where("size > 20000 AND size < 60000").collect()} == {"deep/b.epub"}
    assert {r.path for r in d.where("path = 'a.epub' AND title LIKE 'Test%'").collect()} == {"a.epub"}
    plan = d.where("size > 20000")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")


def test_shares_have_about_the_same_bytes():
    sizes = [900, 30, 500, 500, 20, 10, 400, 40]
    out = epub_source.shares([(str(i), str(i), n) for i, n in enumerate(sizes)], 800)
    held = sorted(sum(b[2] for b in x) for x in out)
    assert len(out) == 3 and sum(held) == sum(sizes) and held[-1] - held[0] <= 300
    assert epub_source.shares([], 10) == []


def test_empty_table_of_books(spark, tmp_path):
    epub_source.register(spark)
    spark.createDataFrame([], "path string, archive binary").write.format("epub").mode("overwrite").save(f"{tmp_path}/none")
    assert found(spark, f"{tmp_path}/none") == []
