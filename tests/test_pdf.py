import random
import time
import zlib

import pytest

from lakevec.sources import files
from lakevec.sources.pdf import glyph, value_at

CMAP = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfrange <0010> <0029> <0041> <0030> <0032> [<0436> <00660066> <D83DDE00>] endbfrange 2 beginbfchar <0003> <0020> <0041> <672C> endbfchar endcmap end end"""


def stream(head: bytes, body: bytes, packed: bool = False) -> bytes:
    body = zlib.compress(body) if packed else body
    return b"<< %s /Length %d%s >>\nstream\n%s\nendstream" % (head, len(body), b" /Filter /FlateDecode" if packed else b"", body)


def plain_file(objects: dict[int, bytes], trailer: bytes = b"", shift: int = 0) -> bytes:
    out, at = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        at[n] = len(out) + shift
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    top = max(objects) + 1
    table = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(top))
    return out + b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (top, table, top, trailer, len(out))


def packed_file(objects: dict[int, bytes]) -> bytes:
    """The same with an object stream and a cross-reference stream under a predictor."""
    inner = {n: b for n, b in objects.items() if b"stream" not in b}
    heads, bodies = [], b""
    for n, body in inner.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b"\n"
    first = b" ".join(heads) + b"\n"
    container, table = max(objects) + 1, max(objects) + 2
    out, places = b"%PDF-1.5\n", {n: (2, container, i) for i, n in enumerate(inner)}
    for n, body in [*((n, b) for n, b in objects.items() if n not in inner), (container, stream(b"/Type /ObjStm /N %d /First %d" % (len(inner), len(first)), first + bodies, True))]:
        places[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    places[table] = (1, len(out), 0)
    rows = [bytes([k]) + a.to_bytes(4, "big") + bytes([i]) for k, a, i in (places.get(n, (0, 0, 0)) for n in range(table + 1))]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above)) for r, above in zip(rows, [bytes(6), *rows]))
    head = b"/Type /XRef /Size %d /W [1 4 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >>" % (table + 1)
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (table, stream(head, up, True), places[table][1])


def book() -> dict[int, bytes]:
    """Three pages, in the file in another order than in the tree, with a two-byte font and a font of its own encoding."""
    return {
        9: stream(b"", b"BT /A 12 Tf (third \\(last\\) (page)) Tj ET", True),
        6: b"<< /Type /Page /Parent 8 0 R /Contents 9 0 R >>",
        7: stream(b"", b"BT /U 12 Tf <0010001100120003> Tj [<0030> -20 <0031> -300 <00410032>] TJ ET"),
        5: b"<< /Type /Page /Parent 8 0 R /Contents [7 0 R 13 0 R] >>",
        13: stream(b"", b"q BI /W 2 /H 1 ID (\x00\xff( EI Q BT /D 9 Tf (\x01\x02x\x03) ' ET", True),
        3: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /A 10 0 R >> /XObject << /F 14 0 R >> >> /Contents 4 0 R >>",
        4: stream(b"", b"BT /A 12 Tf (fir) Tj (st) Tj 0 -12 Td (p\\341ge) Tj ET /F Do", True),
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 3 >>",
        8: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R 2 0 R] /Count 2 /Resources << /Font << /A 10 0 R /U 11 0 R /D 15 0 R >> >> >>",
        10: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        11: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 12 0 R >>",
        12: stream(b"", CMAP, True),
        14: stream(b"/Type /XObject /Subtype /Form", b"BT /A 8 Tf (drawn) Tj ET /F Do", True),
        15: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /eacute /Zcaron 3 /uni20AC] >> >>",
    }


@pytest.mark.parametrize("kind", ["table", "packed", "wrong places", "no table", "packed, no table"])
def test_structure(kind):
    data = packed_file(book()) if "packed" in kind else plain_file(book(), shift=7 * (kind == "wrong places"))
    if "no table" in kind:
        data = data[: data.rindex(b"startxref")].replace(b"xref\n", b"----\n").replace(b"/Type /XRef", b"/Type /Lost")
    pages = files.pdf_text(data).split("\f")
    assert pages[1:] == ["ABC жff 本😀 éŽx€", "third (last) (page)"]
    assert pages[0] == "first páge" + " drawn" * 8  # a form that draws itself ends


def test_later_versions_replace_objects():
    data = plain_file(book())
    at = len(data) + 1
    body = stream(b"", b"BT /A 1 Tf (changed) Tj ET")
    data += b"\n9 0 obj\n%s\nendobj\n" % body
    table = len(data)
    data += b"xref\n9 1\n%010d 00000 n \ntrailer\n<< /Size 16 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, data.index(b"xref\n0"), table)
    assert files.pdf_text(data).split("\f")[2] == "changed"


def test_one_damaged_page_leaves_the_others():
    objects = book() | {9: b"<< /Length 4 /Filter /FlateDecode >>\nstream\nnope\nendstream"}
    assert files.pdf_text(plain_file(objects)).split("\f")[1:] == ["ABC жff 本😀 éŽx€", ""]
    objects = book() | {12: b"<< /Length 4 /Filter /LZWDecode >>\nstream\nnope\nendstream"}
    assert files.pdf_text(plain_file(objects)).split("\f")[1] == "éŽx€"


def test_one_wrong_place_is_looked_for():
    data = plain_file(book())
    at = data.index(b"xref\n0") + len(b"xref\n0 16\n") + 20 * 6
    data = data[:at] + b"%010d" % data.index(b"7 0 obj") + data[at + 10 :]
    assert files.pdf_text(data).split("\f")[1:] == ["ABC жff 本😀 éŽx€", "third (last) (page)"]


def test_refusals():
    with pytest.raises(ValueError, match="encrypted"):
        files.pdf_text(plain_file(book(), b"/Encrypt 10 0 R"))
    empty = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page >>"}
    with pytest.raises(ValueError, match="no text"):
        files.pdf_text(plain_file(empty))
    with pytest.raises(ValueError, match="header"):
        files.pdf_text(b"")


def test_bounds(monkeypatch):
    monkeypatch.setattr(files, "MAX_UNPACKED_BYTES", 1 << 20)
    with pytest.raises(files.TooLarge):
        files.pdf_text(plain_file(book() | {4: stream(b"", b" " * (2 << 20), True)}))
    loops = b"/F Do " * 100
    with pytest.raises(files.TooLarge):  # forms that draw themselves a hundred times, eight levels deep
        files.pdf_text(plain_file(book() | {4: stream(b"", loops), 14: stream(b"/Subtype /Form", loops)}))


def test_odd_files_end_soon():
    began = time.time()
    for body in (b"[" * 300_000, b"<<" * 300_000, b"(" * 300_000, b"<" * 300_000, b"1 0 R " * 50_000, b"%" * 300_000, b"1" * 300_000, b"/" * 300_000):
        data = plain_file(book() | {3: body})
        assert files.pdf_text(data).split("\f")[-1] == "third (last) (page)"
    assert time.time() - began < 20


def test_damage_never_raises_anything_but_value_errors():
    rng = random.Random(5)
    for data in (plain_file(book()), packed_file(book())):
        for _ in range(150):
            broken = bytearray(data)
            for _ in range(rng.randint(1, 30)):
                broken[rng.randrange(9, len(broken))] = rng.randrange(256)
            try:
                files.pdf_text(bytes(broken[: rng.randint(20, len(broken))] if rng.random() < 0.3 else broken))
            except ValueError:
                pass


def test_values_and_glyphs():
    assert value_at(b" << /A#20B [1 -2.5 (a\\)b) <4> 3 0 R null] % x\n /C << /D true >> >> rest", 0)[0] == {"A B": [1, -2.5, b"a)b", b"@", (3,), None], "C": {"D": True}}
    assert [glyph(n) for n in ("a", "eacute", "Ccedilla", "u1F600", "zero", "f_f.alt", "uniD800", "oslash", "xacute")] == ["a", "é", "Ç", "😀", "0", "", "", "ø", "x"]
