"""PDF bytes as tables: round trips, structures by hand, broken files, and the planning of partitions."""

import base64
import zlib

import pytest

from quirework.sources import pdf_source
from quirework.sources.pdf import glyph, Pdf
from quirework.sources.pdf_source import rows_of, written
from quirework.sources.readers import outline

PAGES = [["Hello wörld", "", "𝒳 line  two\t", "(a) \\ b"], [], ["日本語"]]
ITEMS = [("A", 1, None), ("B", 3, 0), ("C", None, 0), ("", 3, None)]


def built(body: bytes, *objects: bytes, resources=b"/Font << /F1 4 0 R >>", box=b"[0 0 200 100]") -> bytes:
    """A file of one page with a plain content stream and no usable table of objects."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox " + box + b" /Resources << " + resources + b" >> >>", b"<< /Type /Page /Contents 9 0 R >>", *objects]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k + 1, p) for k, p in enumerate(parts))
    return out + b"9 0 obj << /Length 0 >> stream\n" + body + b"\nendstream endobj\ntrailer << /Root 1 0 R >>"


FONT = b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b" ".join([b"500"] * 224) + b"] >>"


def text_of(data: bytes) -> str:
    (row,) = rows_of(data, "pages")
    assert row[-1] is None, row
    return row[1]


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(packed):
    data = written(PAGES, "Title é", None, ITEMS, packed)
    assert [(r[0], r[1]) for r in rows_of(data, "pages")] == [(k + 1, "\n".join(line for line in lines if line)) for k, lines in enumerate(PAGES)]
    assert list(rows_of(data, "metadata")) == [("Title é", None, None, None, None, None, 3, None)]
    assert list(rows_of(data, "outline")) == [(1, None, 0, "A", 1, None), (2, 1, 0, "B", 3, None), (3, 1, 1, "C", None, None), (4, None, 1, "", 3, None)]


def test_table_of_objects_is_rebuilt():
    data = written(PAGES, items=ITEMS)
    for broken in (data[: data.rindex(b"trailer") + 30], data.replace(b"startxref", b"startxxxx"), b"%PDF-1.7 more bytes in front\n" + data):
        assert [r[1] for r in rows_of(broken, "pages")] == ["\n".join(line for line in lines if line) for lines in PAGES]


@pytest.mark.parametrize(
    "body, want",
    [
        (b"BT /F1 10 Tf (a\\(b\\)\\\\ \\101 (in) \\\nc) Tj ET", "a(b)\\ A (in) c"),
        (b"BT /F1 10 Tf [(Wo) -20 (rd) -400 (gap)] TJ ET", "Word gap"),
        (b"BT /F1 10 Tf 12 TL (one) Tj T* (two) Tj (three) ' 0 0 (four) \" ET", "one\ntwo\nthree\nfour"),
        (b"BT /F1 10 Tf 1 0 0 1 10 50 Tm (left) Tj 1 0 0 1 90 50 Tm (right) Tj 1 0 0 1 10 20 Tm (below) Tj ET", "left right\nbelow"),
        (b"BT /F1 10 Tf <636166e9> Tj ET % (comment) Tj", "café"),
        (b"q BT /F1 10 Tf (x) Tj ET Q BI /W 1 ID \x00(no) Tj\x01 EI BT /F1 10 Tf 0 -20 Td (y) Tj ET", "x\ny"),
        (b"/X Do", "form"),
        (b"BT (no font) Tj /F1 Tf 5 Td ET", ""),
        (b"", ""),
    ],
)
def test_text_operators(body, want):
    form = b"<< /Subtype /Form /Length 9 /Resources << /Font << /F1 4 0 R >> >> >> stream\nBT /F1 10 Tf (form) Tj ET\nendstream"
    assert text_of(built(body, FONT, form, resources=b"/Font << /F1 4 0 R >> /XObject << /X 5 0 R >>")) == want


def test_names_of_glyphs():
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /germandbls /uni20AC 70 /seven /A.alt] >> >>"
    assert text_of(built(b"BT /F1 10 Tf (ABCDFG) Tj ET", font)) == "éß€D7A"
    assert [glyph(n) for n in ("comma", "Ccedilla", "ydieresis", "nosuch", "fi", "zcaron")] == [",", "Ç", "ÿ", "", "fi", "ž"]


def test_maps_of_characters():
    to = b"<< /Length 0 >> stream\n1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <10> <12> <0041> <20> <21> [<0078> <D835DCB3>] endbfrange\nendstream"
    assert text_of(built(b"BT /F1 10 Tf <01101112 2021> Tj ET", b"<< /Subtype /TrueType /ToUnicode 5 0 R >>", to)) == "fiABCx𝒳"


SHOWS = b"BT /F1 9 Tf (ok) Tj ET"


@pytest.mark.parametrize("filters, data", [(b"[/ASCIIHexDecode /FlateDecode]", zlib.compress(SHOWS).hex().encode() + b">"), (b"/ASCII85Decode", base64.a85encode(SHOWS) + b"~>"), (b"/FlateDecode", zlib.compress(SHOWS))])
def test_filters(filters, data):
    own = built(b"", FONT).replace(b"9 0 obj << /Length 0 >> stream\n\n", b"9 0 obj << /Filter %s >> stream\n%s\n" % (filters, data))
    assert text_of(own) == "ok"


@pytest.mark.parametrize("data", [b"", b"junk", b"%PDF-1.4", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", written(PAGES)[:200], b"%PDF-" + b"[" * 100000, b"%PDF-1.4 trailer << /Encrypt 5 0 R /Root 1 0 R >>"])
@pytest.mark.parametrize("table", sorted(pdf_source.SCHEMAS))
def test_broken_file_is_a_row(data, table):
    rows = list(rows_of(data, table))
    assert not rows or len(rows) == 1 and rows[0][0] is None and rows[0][-1] or all(r[-1] is None for r in rows)


def test_broken_page_is_a_row():
    data = written([["a"], ["b"], ["c"]]).replace(b"/FlateDecode", b"/NoSuchCode", 3).replace(b"/NoSuchCode", b"/FlateDecode", 2)
    rows = list(rows_of(data, "pages"))
    assert [r[0] for r in rows] == [1, 2, 3] and sum(r[-1] is not None for r in rows) == 1


def test_circles_end():
    loop = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >> endobj 2 0 obj << /Type /Pages /Kids [2 0 R 3 0 R] >> endobj 3 0 obj << /Type /Page >> endobj 5 0 obj << /First 6 0 R >> endobj 6 0 obj << /Title (x) /Next 6 0 R /First 6 0 R >> endobj trailer << /Root 1 0 R >>"
    assert [r[0] for r in rows_of(loop, "pages")] == [1] and len(list(rows_of(loop, "outline"))) == 1


def test_shares_are_all_pages_once():
    data = written([[f"p{k}"] for k in range(17)])
    for n in (1, 2, 5, 16, 17, 40):
        assert [r[1] for k in range(n) for r in rows_of(data, "pages", k, n)] == [f"p{k}" for k in range(17)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pdf files")
    (top / "in").mkdir()
    for k in range(6):
        (top / "in" / f"d{k}.pdf").write_bytes(written([[f"{k} {n}"] for n in range(5)], f"t{k}", items=[("A", 1, None), ("B", 2, 0)], packed=k % 2 == 1))
    (top / "big.PDF").write_bytes(written([[f"big {n}"] for n in range(300)], "big"))
    (top / "bad.pdf").write_bytes(b"nothing")
    (top / "note.txt").write_bytes(b"not read")
    return str(top)


def test_source_by_paths(spark, folder):
    pdf_source.register(spark)
    read = lambda table, **o: spark.read.format("pdf").options(table=table, **o).load(folder)
    pages = read("pages", partitionBytes=20000)
    assert pages.rdd.getNumPartitions() > 3
    rows = pages.collect()
    want = sorted([f"{k} {n}" for k in range(6) for n in range(5)] + [f"big {n}" for n in range(300)])
    assert sorted(r.text for r in rows if r.error is None) == want
    assert [r.source.rsplit("/", 1)[1] for r in rows if r.error] == ["bad.pdf"]
    assert sorted(r.title for r in read("metadata").filter("error IS NULL").collect()) == ["big", *[f"t{k}" for k in range(6)]]
    toc = outline(read("outline").filter("error IS NULL"))
    assert sorted((r.toc_ord, r.level, r.title, r.page_no) for r in toc.collect()) == sorted([(1, 1, "A", 1), (2, 2, "B", 2)] * 6)
    with pytest.raises(Exception, match="no such table"):
        read("words").collect()


def test_files_through_spark(spark, folder):
    """Files in stores that only Spark reads come as bytes; rows are the same."""
    whole = pdf_source.from_files(spark, folder + "/in").select("page_no", "text").collect()
    pdf_source.register(spark)
    assert sorted(whole) == sorted(spark.read.format("pdf").load(folder + "/in").select("page_no", "text").collect())


def test_bytes_with_nulls_and_repeats(spark):
    files = spark.createDataFrame([(1, written(PAGES)), (1, written(PAGES)), (None, None), (2, b"")], "k long, content binary")
    rows = pdf_source.from_bytes(files, "metadata", keep=("k",)).collect()
    assert sorted((str(r.k), r.page_count, r.error is None) for r in rows if r.error is None) == [("1", 3, True)] * 2 and sum(r.error is not None for r in rows) == 2
    assert pdf_source.from_bytes(files.limit(0), "pages", keep=("k",)).count() == 0


def test_objects_of_a_later_part_of_a_file_count():
    """A later part of a file replaces objects of the earlier one."""
    data = written([["old"]])
    at = len(data)
    number = Pdf(data).pages()[0]["Contents"].number
    new = b"%d 0 obj << /Length 0 >> stream\nBT /F1 10 Tf <006e00650077> Tj ET\nendstream endobj\n" % number
    table = b"xref\n%d 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Size 9 /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (number, at, data.rindex(b"xref\n0"), at + len(new))
    assert [r[1] for r in rows_of(data + new + table, "pages")] == ["new"]


def test_few_documents_are_objects_at_a_time(spark):
    """A batch of thousands of documents is worked through in slices, each given on as it is done."""
    import pyarrow as pa

    from quirework.sources import pdf_source

    batch = pa.RecordBatch.from_pydict({"n": list(range(10_000))})
    parts = list(pdf_source._slices([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= pdf_source.SLICE and [n for p in parts for n in p.column(0).to_pylist()] == list(range(10_000))


def test_a_code_is_looked_up_once(monkeypatch):
    """What the codes of a font mean and how wide they are is found for each code, not for each letter of a text."""
    from quirework.sources import pdf

    asked = []
    monkeypatch.setattr(pdf._Font, "_char", lambda self, code, was=pdf._Font._char: (asked.append(code), was(self, code))[1])
    line = "abcä日𝒳" * 2000
    assert [r[1] for r in rows_of(written([[line], [line]]), "pages")] == [f"{line}"] * 2
    assert sorted(asked) == sorted({int.from_bytes(line.encode("utf-16-be")[k : k + 2], "big") for k in range(0, 14, 2)})


@pytest.mark.parametrize("widths", [b"", b"/W [65 [100 200 300]]", b"/W [66 67 250 70 [10]]"])
@pytest.mark.parametrize("usual", [b"", b"/DW 750", b"/DW 333.3"])
def test_widths_and_texts_are_those_of_each_code(widths, usual):
    """A shown string is its codes one by one, with or without widths of their own, and a byte left over."""
    from quirework.sources import pdf

    to = b"<< /Length 0 >> stream\n1 beginbfchar <0043> <00660069> endbfchar 1 beginbfrange <0041> <0050> <0061> endbfrange\nendstream"
    data = built(b"", b"<< /Subtype /Type0 /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>", b"<< /Subtype /CIDFontType2 %s %s >>" % (widths, usual), to)
    own = pdf.Pdf(data)
    font = own._font(pdf.Ref(4, 0))
    for raw in (b"\0A\0B\0C\0D\0F\0A", b"\0A\0B\0A", b"\xff\xfe\0A", b""):
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)]
        text, width, n, spaces = font.read(raw)
        assert (text, n, spaces) == ("".join(map(font._char, codes)), len(codes), 0) and width == pytest.approx(sum(map(font._width, codes)), rel=1e-14)
    assert font.read(b"\0A\0B\0C")[0] == "abfi" and font.read(b"\0A\x41")[2] == 2


def test_documents_are_dealt_out_before_they_are_files(spark):
    """A table of one row group is read by one task; the work in Python isn't that task's."""
    from quirework.plans.queries import pdf_fixture, QUERIES
    from tests.conftest import SF
    from tests.test_steps import exchanges

    assert exchanges(pdf_fixture(spark, SF)) == 1 and exchanges(QUERIES["pdf_pages"](spark, SF)) == 1
