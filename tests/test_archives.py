"""Archives as rows: order, cap on readable members, nesting, damage, images."""

import io
import zipfile

from pyspark.sql import functions as F

from loomfield.sources import archives, files


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def read(spark, contents, **how):
    rows = [(f"d{i}", f"f{i}.zip", bytearray(c)) for i, c in enumerate(contents)]
    got = archives.members(spark.createDataFrame(rows, "document_id string, source string, content binary"), **how)
    return [(r.document_id, r.source, r.kind, bytes(r.content)) for r in got.orderBy("document_id", "place").collect()]


def test_order_kinds_and_what_is_left_out(spark):
    one = packed([("dir/", ""), ("b.txt", "b"), ("node_modules/x.js", "x"), ("a.py", "a"), ("c.ipynb", "{}"), ("p.PNG", "p"), ("in.zip", b"z"), ("odd.bin", "o")])
    assert read(spark, [one, b"no archive", packed([])]) == [("d0", "b.txt", "text", b"b"), ("d0", "a.py", "script", b"a"), ("d0", "c.ipynb", "notebook", b"{}")]
    assert [k for _, _, k, _ in read(spark, [one], images=True)] == ["text", "script", "notebook", "image"]
    # A name that occurs twice is two members.
    assert [r[3] for r in read(spark, [packed([("t.txt", "1"), ("t.txt", "2")])])] == [b"1", b"2"]


def test_the_cap_counts_readable_members(spark):
    whole = packed([(f"{i:03}.txt", f"text number {i} " * 5) for i in range(8)])
    broken = bytearray(whole)
    at = broken.index(b"002.txt") + len(b"002.txt")
    broken[at : at + 6] = b"\xff" * 6
    assert [r[1] for r in read(spark, [bytes(broken)], most=4)] == ["000.txt", "001.txt", "003.txt", "004.txt"]


def test_archives_inside(spark):
    level = packed([("deep.txt", "d5")])
    for n in (4, 3, 2, 1):
        level = packed([(f"t{n}.txt", f"d{n}"), (f"z{n}.zip", level), (f"u{n}.txt", f"e{n}")])
    got = [r[1] for r in read(spark, [level], inner=True)]
    # Three levels below the first are opened, at their place; the fourth isn't.
    one, two, three = "f0.zip/z1.zip::", "f0.zip/z1.zip::z1.zip/z2.zip::", "f0.zip/z1.zip::z1.zip/z2.zip::z2.zip/z3.zip::"
    assert got == ["t1.txt", one + "t2.txt", two + "t3.txt", three + "t4.txt", three + "u4.txt", two + "u3.txt", one + "u2.txt", "u1.txt"]
    assert [r[1] for r in read(spark, [level], inner=True, most=2)] == got[:2]


def test_images_in_archives_by_what_a_model_tells(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(packed([("x.png", b"\x89"), ("y.jpg", b"\xff"), ("t.txt", "some text")]))
    _, units = files.read_files(spark, str(tmp_path))
    assert {r.source for r in units.collect()} == {"t.txt"}
    _, units = files.read_files(spark, str(tmp_path), archive_images=True)
    assert {(r.source, r.text) for r in units.collect()} == {("t.txt", "some text"), ("x.png", "[IMAGE]: x.png"), ("y.jpg", "[IMAGE]: y.jpg")}
    told = lambda rows: rows.withColumns({"ocr": F.when(F.col("source") == "x.png", "A sign"), "caption": F.lit("a road")})
    _, units = files.read_files(spark, str(tmp_path), archive_images=True, describe=told)
    assert {r.text for r in units.collect()} == {"some text", "[OCR]: A sign [CAPTION]: a road", "[CAPTION]: a road"}
