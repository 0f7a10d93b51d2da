"""Documents as a source of pages."""

import struct
import zlib

from quillspark.sources.pages import document_pages


def pdf(*objects, tail=b"trailer << /Root 1 0 R >>"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + tail


def page(box=b"/MediaBox [0 0 612 792]"):
    return b"<< /Type /Page /Parent 2 0 R %s >>" % box


TREE = (b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 2 /MediaBox [0 0 100 200] >>")


def test_a_row_a_page_and_a_row_a_failure(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    packed = zlib.compress(b"5 0 6 60 << /Type /Page /MediaBox [0 0 10 20] >> << /Type /Page /MediaBox [0 0 30 40] >>")
    cases = {
        "two.pdf": pdf(*TREE, page(), page(b"")),
        "sizeless.pdf": pdf(TREE[0], page(), page(b"/MediaBox [0 0 0 0]")),
        "packed.pdf": pdf(TREE[0], b"<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream"),
        "locked.pdf": pdf(*TREE, page(), tail=b"trailer << /Encrypt 9 0 R >>"),
        "pageless.pdf": b"%PDF-1.4 cut off",
        "long.pdf": pdf(*TREE, *[page()] * 21),
        "a.png": png,
        "wide.png": png[:16] + struct.pack(">II", 12_001, 10),
        "cut.png": png[:18],
        "a.jpg": b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 50, 70) + b"\x00\x00",
        "cut.jpg": b"\xff\xd8\xff\xe0\x00",
        "note.txt": b"plain",
        "empty.pdf": b"",  # passed over by the scan
        "large.pdf": pdf(*TREE, page()) + b" " * 5_000,
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = document_pages(spark, str(tmp_path), most_bytes=4_000).collect()
    got = sorted((r.path.rsplit("/", 1)[1], r.page or 0, r.width, r.height, r.status, r.error_code) for r in rows)
    failed = lambda name, code: (name, 0, None, None, "failed", code)
    assert got == sorted(
        [
            ("two.pdf", 1, 612, 792, "ok", None),
            ("two.pdf", 2, 100, 200, "ok", None),
            ("sizeless.pdf", 1, 612, 792, "ok", None),
            ("sizeless.pdf", 2, 0, 0, "failed", "PDF_PAGE_RENDER_FAILED"),
            ("packed.pdf", 1, 10, 20, "ok", None),
            ("packed.pdf", 2, 30, 40, "ok", None),
            failed("locked.pdf", "ENCRYPTED_PDF"),
            failed("pageless.pdf", "INVALID_PDF"),
            failed("long.pdf", "PDF_PAGE_LIMIT"),
            ("a.png", 1, 640, 480, "ok", None),
            ("wide.png", 1, 12_001, 10, "failed", "IMAGE_TOO_LARGE"),
            failed("cut.png", "CORRUPTED_IMAGE"),
            ("a.jpg", 1, 70, 50, "ok", None),
            failed("cut.jpg", "CORRUPTED_IMAGE"),
            failed("note.txt", "UNSUPPORTED"),
            failed("large.pdf", "DOCUMENT_TOO_LARGE"),
        ]
    )
    plan = document_pages(spark, str(tmp_path), most_bytes=4_000)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,4000)" in plan and "GreaterThan(length,4000)" in plan
