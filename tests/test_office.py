import io
import struct
import zipfile

from plenum.operators import content as CO
from plenum.sources import office as OF
from plenum.sources import profiles as PF
from plenum.sources.text import html_blocks
from pyspark.sql import functions as F



def archive(entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return b.getvalue()


def test_quarantine(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive([("word/document.xml", "<x/>")]))
    (tmp_path / "b.docx").write_bytes(b"nothing")
    (tmp_path / "c.docx").write_bytes(archive([("big.bin", b"\0" * 5_000_000)]))
    (tmp_path / "d.docx").write_bytes(archive([("x.xml", "1"), ("X.xml", "2")]))
    parts, bad = OF.read_corpus(spark, str(tmp_path))
    assert [r.part for r in parts.collect()] == ["word/document.xml"]
    assert {r.reason for r in bad.collect()} == {"not a readable archive: BadZipFile", "compression ratio above 200", "duplicate entry names"}


def test_tiff_and_bad_dpi(spark):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 960) + struct.pack("<HHII", 257, 4, 1, 480) + b"\0\0\0\0"
    jpeg = bytes.fromhex("FFD8FFE000104A464946000101010000000000 00FFC0000B0800600060010111".replace(" ", ""))
    m = spark.createDataFrame([("t", "p", tiff), ("j", "p", jpeg)], "doc string, part string, bytes binary")
    got = {r.doc: (r.media_type, r.width, r.height, r.emu_width) for r in OF.image_audit(m).collect()}
    assert got == {"t": ("image/tiff", 960, 480, 9144000), "j": ("image/jpeg", 96, 96, 914400)}


def test_html_table_coordinates(spark):
    df = spark.createDataFrame([("d", "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</table><p>open<p>next &amp; last")], "doc string, html string")
    got = [(r.tag, r.row, r.col, r.text) for r in html_blocks(df, F.col("doc"), F.col("html")).orderBy("idx").collect()]
    assert got == [("th", 1, 1, "A"), ("th", 1, 2, "B"), ("td", 2, 1, "1"), ("td", 2, 2, "2"), ("p", None, None, "open"), ("p", None, None, "next & last")]


def test_markdown_round_trip(spark):
    md = "# Title {#t}\n\nSome *words* here\nand more\n\n- one\n  - two\n\n```py\n# not a heading\n```\n\n> quoted\n\n---\n\n<!-- toc -->\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n<div>x</div>\n\n[^n]: note\n"
    b = CO.markdown_blocks(spark.createDataFrame([("d", md)], "doc string, text string")).orderBy("idx").collect()
    assert [r.type for r in b] == ["heading", "para", "list_item", "list_item", "code", "quote", "hr", "toc", "table", "html", "footnote"]
    assert (b[0].label, b[0].text, b[3].level, b[4].text) == ("t", "Title", 1, "# not a heading")


def test_pipe_table(spark):
    cells = spark.createDataFrame([("d", 1, 1, 1, "head", None), ("d", 1, 2, 1, "x", "left"), ("d", 1, 2, 2, "12345", "right")], "doc string, tbl int, row int, col int, text string, align string")
    assert CO.render_tables(CO.shape_tables(cells)).first().text == "| head |       |\n| ---- | ----: |\n| x    | 12345 |"


def test_overrides(spark, tmp_path):
    src = tmp_path / "o.json"
    src.write_text('{"version": 1, "pins": {"/a": {"value": "1in"}, "/b": "2"}, "muted": ["/c"], "severity": {"/d": "warn"}, "placeholders": {"name": {"type": "text"}}, "later": [1]}')
    t = PF.read_overrides(spark, str(src))
    assert {(r.pointer, r.pin_value) for r in t["pins"].collect()} == {("/a", "1in"), ("/b", "2")}
    PF.write_overrides(spark, t, str(tmp_path / "out"))
    again = PF.read_overrides(spark, str(tmp_path / "out"))
    for name in ("pins", "muted", "severity", "placeholders"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, t[name].collect())), name
    assert {(r.key, r.value) for r in again["extra"].collect()} == {("version", "1"), ("later", "[1]")}


def test_watch_folder(spark, tmp_path):
    from plenum.streaming.watch import watch
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_bytes(b"hi\nthere")
    (inbox / "b.txt").write_bytes(b"\xff\xfe")
    q = watch(spark, str(inbox), lambda b: b.select("doc", "text"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out" / "findings")).collect()) == ["hi", "there"]
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1


def test_picture_density_by_chunks(spark):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(*chunks, size=(300, 150)):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 6, 0, 0, 0)) + b"".join(chunks) + chunk(b"IDAT", b"x" * 40) + chunk(b"IEND", b"")

    def bmp(width, height, ppm, header=40):
        return b"BM" + bytes(8) + struct.pack("<I", 54) + struct.pack("<IiiHHIIiiII", header, width, height, 1, 24, 0, 0, ppm, ppm, 0, 0)

    density = chunk(b"pHYs", struct.pack(">IIB", 11811, 5906, 1))
    exif = b"MM\0*" + struct.pack(">IHHHIIHHIHHI", 8, 2, 282, 5, 1, 38, 296, 3, 1, 3, 0, 0) + struct.pack(">II", 100, 1)
    jpeg = b"\xff\xd8\xff\xff\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 96, 254) + b"\x01\x01\x11"
    files = {
        "300 dpi": png(density), "behind text": png(chunk(b"tEXt", b"pHYs inside a text"), density), "none": png(), "aspect": png(chunk(b"pHYs", struct.pack(">IIB", 4, 3, 0))),
        "late": png(chunk(b"IDAT", b"y"), density), "cut": png(density)[:30], "bmp": bmp(300, 150, 11811), "top-down": bmp(300, -150, 11811), "no density": bmp(300, 150, 0), "jpeg": jpeg, "trace": png(chunk(b"eXIf", b"AExif\0\0GPS"))}
    rows = spark.createDataFrame([(k, "i", v) for k, v in files.items()], "doc string, part string, bytes binary")
    got = {r.doc: (r.width, r.height, r.emu_width, r.emu_height, r.metadata) for r in OF.image_audit(rows).collect()}
    plain = (300, 150, 2857500, 1428750)
    assert got["300 dpi"] == got["behind text"] == (300, 150, 300 / (11811 * .0254) * 914400 // 1, 150 / (5906 * .0254) * 914400 // 1, [])
    assert all(got[k][:4] == plain for k in ("none", "aspect", "late", "no density", "trace"))
    assert got["bmp"] == got["top-down"] and got["bmp"][2] == 300 / (11811 / 39.3701) * 914400 // 1
    assert got["cut"][2:4] == got["none"][2:4] and got["jpeg"][:4] == (254, 96, 914400, 345600) and got["jpeg"][4] == ["EXIF"]
    assert got["trace"][4] == ["EXIF", "GPS"]


def test_page_ballots_of_blank_texts_and_null_ids(spark, tmp_path):
    import __spark_entry__ as entry
    import duckdb
    from oracle import compare
    texts = [(1, ""), (2, "\n\n\n\n\n\n"), (3, "a\n\n\n\n\t\n\r"), (4, " \n \n　\n\nb"), (None, "x\ny"), (None, "\n\n\n\n\nz"), (5, None), (6, "a\nb\n\n\nc\nd\n "),
             (7, "​\n\n\n\n\x1c\n\x85"), (8, "\n\n\n\ne"), (8, "f\ng")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ok, said = compare(entry.queries()["f5_page_ballots"](spark, str(tmp_path)), con, entry.oracle_sql()["f5_page_ballots"])
    assert ok, said
