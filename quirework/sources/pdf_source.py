"""PDF files as tables: pages, metadata and outline, by a data source over paths or from a column of bytes.

``spark.read.format("pdf").option("table", "pages").load(path)`` after ``register(spark)``. Files are listed where the plan is made, none is opened there:
small ones are read several to a task, a large one in shares of its pages by as many tasks as its size asks for.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pdf import Pdf, PdfError

SCHEMAS = {
    "pages": "page_no int, text string, width double, height double, error string",
    "metadata": "title string, author string, subject string, creator string, producer string, creation_date string, page_count int, error string",
    "outline": "node_id long, parent_id long, position int, title string, page_no int, error string",
}
_FIELDS = {t: [f.split() for f in s.split(", ")] for t, s in SCHEMAS.items()}
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
#: Bytes of files read by a task; a file of more is read by several.
PARTITION_BYTES = 64 << 20
#: Pages of a batch that leaves a task.
BATCH_PAGES = 256


def rows_of(content: bytes, table: str, share: int = 0, shares: int = 1) -> Iterator[tuple]:
    """A file's rows of a table, of its pages one share of several. A file, or a page, that can't be read is a row with the error."""
    width = len(_FIELDS[table])
    try:
        pdf = Pdf(content)
        pages = pdf.pages()
        if table == "metadata":
            yield (*[x or None for x in pdf.info().values()], len(pages), None)
        elif table == "outline":
            for row in pdf.outline(pages):
                yield (*row, None)
    except Exception as e:  # whatever the bytes hold, a bad file is a row, not a failed task
        if share == 0:
            yield (*[None] * (width - 1), f"{type(e).__name__}: {e}")
        return
    if table != "pages":
        return
    for k in range(len(pages) * share // shares, len(pages) * (share + 1) // shares):
        try:
            yield (k + 1, pdf.text(pages[k]), *pdf.size(pages[k]), None)
        except Exception as e:  # the same for a page
            yield (k + 1, None, None, None, f"{type(e).__name__}: {e}")


def _batches(rows: Iterator[tuple], heads: list[tuple[str, pa.DataType]], table: str) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*heads, *[(n, _KINDS[k]) for n, k in _FIELDS[table]])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], list(names))

    for row in rows:
        held.append(row)
        if len(held) >= BATCH_PAGES:
            yield batch()
            held.clear()
    if held:
        yield batch()


#: Rows that are Python objects at a time: a batch may hold thousands of documents, which as objects take many times their bytes.
SLICE = 32


def _slices(batches):
    """Parts of a few rows each; no row of a batch is copied."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def from_bytes(files: DataFrame, table: str = "pages", content_col: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows of a table from a column of files' bytes, with the columns in ``keep``: for files in any store of Spark, or kept in a table.

    A null is a file that can't be read.
    """
    own = files.select(F.col(content_col).cast("binary").alias("b_content"), *[F.col(c) for c in keep])

    def run(batches):
        for b in _slices(batches):
            heads = [(f.name, f.type) for f in b.schema][1:]
            kept = list(zip(*[c.to_pylist() for c in b.columns[1:]])) if heads else [()] * b.num_rows
            rows = ((*own_columns, *row) for content, own_columns in zip(b.column(0), kept) for row in rows_of(content.as_py() or b"", table))
            yield from _batches(rows, heads, table)

    kept_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:])
    return own.mapInArrow(run, kept_ddl + SCHEMAS[table])


def from_files(spark: SparkSession, path: str, table: str = "pages") -> DataFrame:
    """doc_id (hash of the path), source and the table's columns, of the files under ``path`` in any store that Spark reads; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source"), "content")
    return from_bytes(files, table, keep=("doc_id", "source"))


@dataclass
class Share(InputPartition):
    """(path, share, shares) of the files that a task reads."""

    files: list[tuple[str, int, int]]


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.suffix = options.get("path"), options.get("table", "pages"), options.get("suffix", ".pdf").lower()
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        if not self.path:
            raise ValueError("a path is required")

    def _store(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and (info.type == fs.FileType.File or f.path.lower().endswith(self.suffix)))
        out, held, size = [], [], 0
        for name, n in found:
            shares = -(-n // self.most) if self.table == "pages" else 1
            if shares > 1:
                out += [Share([(name, k, shares)]) for k in range(shares)]
                continue
            if held and size + n > self.most:
                out.append(Share(held))
                held, size = [], 0
            held.append((name, 0, 1))
            size += n
        return [*out, Share(held)] if held or not out else out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()

        def rows() -> Iterator[tuple]:
            for name, share, shares in partition.files:
                try:
                    with store.open_input_stream(name) as f:
                        content = f.read()
                except OSError as e:
                    if share == 0:
                        yield (hashlib.sha256(name.encode()).hexdigest(), name, *[None] * (len(_FIELDS[self.table]) - 1), f"OSError: {e}")
                    continue
                for row in rows_of(content, self.table, share, shares):
                    yield (hashlib.sha256(name.encode()).hexdigest(), name, *row)

        yield from _batches(rows(), [("doc_id", pa.string()), ("source", pa.string())], self.table)


class PdfSource(DataSource):
    """Options: path, table (pages, metadata or outline), suffix (.pdf) of files in a folder, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        table = self.options.get("table", "pages")
        if table not in SCHEMAS:
            raise ValueError(f"no such table: {table}")
        return "doc_id string, source string, " + SCHEMAS[table]

    def reader(self, schema) -> PdfReader:
        return PdfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)


def written(pages: list[list[str]], title: str | None = None, author: str | None = None, items: list[tuple[str, int | None, int | None]] | None = None, packed: bool = False) -> bytes:
    """A PDF with lines of text on pages, and outline items (title, page number or None, parent's number or None): what tests and round trips read.

    Codes are UTF-16 units with a Unicode map. ``packed`` writes objects into an object stream, with a cross-reference stream.
    """
    import zlib

    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes, info: bytes = b"") -> bytes:
        data = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(data), info, data)

    text = lambda s: b"<feff" + s.encode("utf-16-be", "surrogatepass").hex().encode() + b">"
    root, tree, info = add(b""), add(b""), add(b"")
    to = add(stream(b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"))
    below = add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>")
    font = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (below, to))
    kids = []
    for lines in pages:
        body = b"BT /F1 10 Tf 12 TL 50 800 Td\n" + b"\n".join(b"<%s> Tj T*" % line.encode("utf-16-be", "surrogatepass").hex().encode() for line in lines) + b"\nET"
        content = add(stream(body))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (tree, content)))
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 595 842] /Resources << /Font << /F1 %d 0 R >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids), font)
    objects[info - 1] = b"<< %s%s >>" % (b"/Title %s " % text(title) if title is not None else b"", b"/Author %s" % text(author) if author is not None else b"")
    outline = b""
    if items:
        top = add(b"")
        number = [add(b"") for _ in items]
        below_of: dict[int | None, list[int]] = {}
        for k, (_, _, parent) in enumerate(items):
            below_of.setdefault(parent, []).append(k)
        for parent, own in below_of.items():
            for k, after in zip(own, [*own[1:], None]):
                name, page, _ = items[k]
                dest = b"/Dest [%d 0 R /Fit] " % kids[page - 1] if page else b""
                more = b"/First %d 0 R " % number[below_of[k][0]] if k in below_of else b""
                objects[number[k] - 1] = b"<< /Title %s /Parent %d 0 R %s%s%s>>" % (text(name), number[parent] if parent is not None else top, dest, more, b"/Next %d 0 R " % number[after] if after is not None else b"")
        objects[top - 1] = b"<< /Type /Outlines /First %d 0 R >>" % number[below_of[None][0]]
        outline = b" /Outlines %d 0 R" % top
    objects[root - 1] = b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, outline)

    out, places = io.BytesIO(), {}
    out.write(b"%PDF-1.7\n")
    inside = [k for k, body in enumerate(objects, 1) if packed and b"stream\n" not in body]
    for k, body in enumerate(objects, 1):
        if k not in inside:
            places[k] = (1, out.tell(), 0)
            out.write(b"%d 0 obj\n%s\nendobj\n" % (k, body))
    if not packed:
        at = out.tell()
        out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[k][1] for k in range(1, len(objects) + 1)))
        out.write(b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, info, at))
        return out.getvalue()
    holder, table = len(objects) + 1, len(objects) + 2
    bodies, heads, size = [], [], 0
    for i, k in enumerate(inside):
        heads.append(b"%d %d" % (k, size))
        bodies.append(objects[k - 1])
        size += len(objects[k - 1]) + 1
        places[k] = (2, holder, i)
    head = b" ".join(heads) + b"\n"
    places[holder] = (1, out.tell(), 0)
    out.write(b"%d 0 obj\n%s\nendobj\n" % (holder, stream(head + b"\n".join(bodies), b"/Type /ObjStm /N %d /First %d" % (len(inside), len(head)))))
    places[table], at = (1, out.tell(), 0), out.tell()
    rows = b"\x00" + bytes(6) + b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (places[k] for k in range(1, table + 1)))
    # Each row as the difference to the one above, as writers do.
    lines = [rows[k : k + 7] for k in range(0, len(rows), 7)]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(line, above)) for line, above in zip(lines, [bytes(7), *lines]))
    out.write(b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (table, stream(up, b"/Type /XRef /Size %d /W [1 4 2] /Root %d 0 R /Info %d 0 R /DecodeParms << /Predictor 12 /Columns 7 >>" % (table + 1, root, info)), at))
    return out.getvalue()


def to_bytes(documents: DataFrame) -> DataFrame:
    """doc_id and content, a PDF, from doc_id, title, author, pages (lists of lines), items (title, page, parent: the parent's place in the list)."""
    own = documents.select("doc_id", "title", "author", "pages", "items")

    def run(batches):
        for b in _slices(batches):
            rows = b.to_pylist()
            content = [written(r["pages"], r["title"], r["author"], [(i["title"], i["page"], i["parent"]) for i in r["items"] or []]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, content binary")


__all__ = ["Pdf", "PdfError", "PdfSource", "from_bytes", "from_files", "register", "rows_of", "to_bytes", "written"]
