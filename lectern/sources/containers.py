"""DOCX and EPUB containers as rows of units, and back.

A part is read once by an event parser that notes the byte range of every piece of text. Writing back replaces these
ranges in the original bytes, so namespaces, declarations, comments and document types stay as they were.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.entities import html5
from urllib.parse import unquote
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parts import shares
from ..functions.text import extension

MOST_MEMBERS, MOST_RATIO, RATIO_FROM = 5000, 1000, 1 << 20
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main "
# Elements that flush a unit, and elements without text of their own.
BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd figcaption caption td th div section article aside blockquote".split())
IGNORED = set("head script style noscript svg math rt rp".split())
_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_SPACE = re.compile(r"\s+")


class ContainerError(ValueError):
    """A container that cannot be read or written."""


class Slot:
    """A piece of text in a part: its bytes, its value, and the start tag before it."""

    __slots__ = ("start", "end", "value", "tag")

    def __init__(self, start: int, tag: int):
        self.start, self.end, self.value, self.tag = start, start, "", tag


class Unit:
    __slots__ = ("text", "slots")

    def __init__(self):
        self.text: list[str] = []
        self.slots: list[Slot] = []

    def plain(self) -> str:
        return _SPACE.sub(" ", "".join(self.text)).strip()


class _Reader:
    """Events of one part with byte positions; subclasses say what belongs to which unit."""

    def __init__(self, data: bytes):
        self.units: list[Unit] = []
        self.slot: Slot | None = None
        self.tag = 0
        self.parser = p = expat.ParserCreate("utf-8", " ")
        p.buffer_text = False
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.CommentHandler = p.ProcessingInstructionHandler = lambda *_: self._close()
        p.Parse(data, True)
        self._close()
        self.finish()

    def _close(self) -> None:
        if self.slot is not None:
            self.slot.end = self.parser.CurrentByteIndex
            slot, self.slot = self.slot, None
            self.text(slot)

    def _start(self, name: str, _) -> None:
        self._close()
        self.tag = self.parser.CurrentByteIndex
        self.start(name)

    def _end(self, name: str) -> None:
        self._close()
        self.end(name)

    def _text(self, value: str) -> None:
        if self.slot is None:
            self.slot = Slot(self.parser.CurrentByteIndex, self.tag)
        self.slot.value += value

    def finish(self) -> None:
        self.units = [u for u in self.units if u.plain() and u.slots]


class WordReader(_Reader):
    """Paragraphs in the order of their starts; deleted text is left out, a nested paragraph is a unit of its own."""

    def __init__(self, data: bytes):
        self.open: list[Unit] = []
        self.deleted = 0
        self.in_text = False
        super().__init__(data)

    def start(self, name: str) -> None:
        if name == _W + "p":
            self.open.append(Unit())
            self.units.append(self.open[-1])
        elif name == _W + "del":
            self.deleted += 1
        elif name == _W + "t":
            self.in_text = True
        elif self.open and not self.deleted and name in (_W + "tab", _W + "br", _W + "cr"):
            self.open[-1].text.append(" ")

    def end(self, name: str) -> None:
        if name == _W + "p":
            self.open.pop()
        elif name == _W + "del":
            self.deleted -= 1
        elif name == _W + "t":
            self.in_text = False

    def text(self, slot: Slot) -> None:
        if self.in_text and self.open and not self.deleted:
            self.open[-1].text.append(slot.value)
            self.open[-1].slots.append(slot)


class BookReader(_Reader):
    """XHTML: block elements end the unit before and after them; what follows an ignored element still counts."""

    def __init__(self, data: bytes):
        self.hidden = 0
        self.now = Unit()
        super().__init__(data)

    def _flush(self) -> None:
        self.units.append(self.now)
        self.now = Unit()

    def start(self, name: str) -> None:
        local = name.rpartition(" ")[2].lower()
        if self.hidden or local in IGNORED:
            self.hidden += 1
        elif local in BLOCKS:
            self._flush()
        elif local in ("br", "hr"):
            self.now.text.append(" ")

    def end(self, name: str) -> None:
        if self.hidden:
            self.hidden -= 1
        elif name.rpartition(" ")[2].lower() in BLOCKS:
            self._flush()

    def text(self, slot: Slot) -> None:
        if not self.hidden:
            self.now.text.append(slot.value)
            if slot.value.strip():
                self.now.slots.append(slot)

    def finish(self) -> None:
        self._flush()
        super().finish()


def opened(data: bytes, form: str) -> zipfile.ZipFile:
    """A checked archive: no encryption, no bomb, no double paths, the members of its format, every checksum right."""
    if not data:
        raise ContainerError("the container is empty")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        members = archive.infolist()
        names = [m.filename for m in members]
        if len(members) > MOST_MEMBERS:
            raise ContainerError("too many members")
        if any(m.flag_bits & 1 for m in members):
            raise ContainerError("encrypted members")
        if any(m.file_size >= RATIO_FROM and m.file_size > MOST_RATIO * max(1, m.compress_size) for m in members):
            raise ContainerError("absurd compression ratio")
        if len(set(names)) < len(names):
            raise ContainerError("a path occurs twice")
        if form == "docx" and not {"[Content_Types].xml", "word/document.xml"} <= set(names):
            raise ContainerError("not a DOCX container")
        if form == "epub" and ("META-INF/container.xml" not in names or "mimetype" not in names or archive.read("mimetype").strip() != b"application/epub+zip"):
            raise ContainerError("not an EPUB container")
        if (bad := archive.testzip()) is not None:
            raise ContainerError(f"damaged member {bad}")
    except ContainerError:
        raise
    except Exception as e:
        raise ContainerError(f"not a readable container: {e}") from e
    return archive


def word_parts(archive: zipfile.ZipFile) -> list[str]:
    """Body, headers, footers, footnotes, endnotes; each group by name."""
    names = sorted(archive.namelist())
    groups = (r"word/document\.xml", r"word/header\d+\.xml", r"word/footer\d+\.xml", r"word/footnotes\.xml", r"word/endnotes\.xml")
    return [n for g in groups for n in names if re.fullmatch(g, n)]


def _elements(data: bytes, *wanted: str) -> list[tuple[str, dict]]:
    found: list[tuple[str, dict]] = []
    p = expat.ParserCreate(namespace_separator=" ")
    p.StartElementHandler = lambda name, a: found.append((name.rpartition(" ")[2], a)) if name.rpartition(" ")[2] in wanted else None
    p.Parse(data, True)
    return found


def book_parts(archive: zipfile.ZipFile) -> list[str]:
    """XHTML parts in reading order, each once; encrypted ones are refused."""
    names = set(archive.namelist())
    roots = [unquote(a.get("full-path", "")) for _, a in _elements(archive.read("META-INF/container.xml"), "rootfile")]
    package = posixpath.normpath(roots[0]) if roots and roots[0] else ""
    if package.startswith(("../", "/")) or package not in names:
        raise ContainerError("no package file")
    manifest: dict[str, tuple[str, str]] = {}
    order: list[str] = []
    for name, a in _elements(archive.read(package), "item", "itemref"):
        if name == "itemref":
            order.append(a.get("idref", ""))
        elif a.get("id") and (href := unquote(a.get("href", "").partition("#")[0])):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(package), href))
            if not path.startswith(("../", "/")):
                manifest[a["id"]] = (path, a.get("media-type", ""))
    parts = [manifest[i][0] for i in order if i in manifest and manifest[i][1] == "application/xhtml+xml" and manifest[i][0] in names]
    if not parts:
        raise ContainerError("no text in the reading order")
    if "META-INF/encryption.xml" in names:
        locked = {posixpath.normpath(unquote(a.get("URI", "").partition("#")[0])).lstrip("/") for _, a in _elements(archive.read("META-INF/encryption.xml"), "CipherReference")}
        if locked & set(parts):
            raise ContainerError("encrypted text")
    return list(dict.fromkeys(parts))


def _named(m: re.Match) -> bytes:
    name = m[1].decode("ascii")
    if name in ("amp", "lt", "gt", "apos", "quot") or name + ";" not in html5:
        return m[0]
    return "".join(f"&#{ord(c)};" for c in html5[name + ";"]).encode()


def read_part(archive: zipfile.ZipFile, part: str, form: str) -> tuple[bytes, list[Unit]]:
    """(bytes, units) of a part. Named entities of HTML are spelled out if the part is not XML without that."""
    data = archive.read(part)
    reader = WordReader if form == "docx" else BookReader
    try:
        return data, reader(data).units
    except expat.ExpatError as e:
        spelled = re.sub(rb"&([A-Za-z][A-Za-z0-9]+);", _named, data) if form == "epub" else data
        if spelled == data:
            raise ContainerError(f"{part} is not XML: {e}") from e
    try:
        return spelled, reader(spelled).units
    except expat.ExpatError as e:
        raise ContainerError(f"{part} is not XML: {e}") from e


def extract(data: bytes, form: str) -> Iterator[tuple[int, str, int, str, list[int]]]:
    """(part number, part, unit number, text, lengths of its pieces)."""
    archive = opened(data, form)
    n = 0
    for i, part in enumerate(word_parts(archive) if form == "docx" else book_parts(archive)):
        for u in read_part(archive, part, form)[1]:
            yield i, part, n, u.plain(), [len(s.value) for s in u.slots]
            n += 1
    if not n:
        raise ContainerError("no text to translate")


def build(data: bytes, translated: list[str], form: str) -> bytes:
    """The container with its units replaced in order; the counts must agree."""
    archive = opened(data, form)
    new: dict[str, bytes] = {}
    at = 0
    for part in word_parts(archive) if form == "docx" else book_parts(archive):
        raw, units = read_part(archive, part, form)
        edits: list[tuple[int, int, bytes]] = []
        for u in units:
            if at >= len(translated):
                raise ContainerError("fewer translations than units")
            if _ILLEGAL.search(translated[at]):
                raise ContainerError("a translation holds a character that XML cannot hold")
            for slot, piece in zip(u.slots, shares(translated[at], [len(s.value) for s in u.slots])):
                edits.append((slot.start, slot.end, escape(piece).encode()))
                if form == "docx" and piece != piece.strip() and b"space=" not in raw[slot.tag : slot.start]:
                    edits.append((slot.start - 1, slot.start, b' xml:space="preserve">'))
            at += 1
        out, last = [], 0
        for start, end, text in sorted(edits):
            out += [raw[last:start], text]
            last = end
        new[part] = b"".join([*out, raw[last:]])
    if at < len(translated):
        raise ContainerError("more translations than units")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as target:
        target.comment = archive.comment
        for info in sorted(archive.infolist(), key=lambda m: m.filename != "mimetype" or form != "epub"):
            if info.filename == "mimetype" and form == "epub":
                info.compress_type = zipfile.ZIP_STORED
            target.writestr(info, new.get(info.filename) or archive.read(info.filename))
    return held.getvalue()


def packed(paragraphs: list[str], form: str) -> bytes:
    """A small container with one unit per paragraph, two runs each where there is room."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        if form == "docx":
            z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
            runs = ("".join(f'<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r>' for x in (p[: len(p) // 2], p[len(p) // 2 :]) if x) for p in paragraphs)
            body = "".join(f"<w:p>{r}</w:p>" for r in runs)
            z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W.strip()}"><w:body>{body}</w:body></w:document>')
        else:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
            z.writestr("OPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
            body = "".join(f"<p>{escape(p[: len(p) // 2])}<b>{escape(p[len(p) // 2 :])}</b></p>" for p in paragraphs)
            z.writestr("OPS/a.xhtml", f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>-</title></head><body>{body}</body></html>')
    return held.getvalue()


_UNITS = pa.schema([("key", pa.int64()), ("part_no", pa.int32()), ("part", pa.string()), ("unit_no", pa.int32()), ("text", pa.string()), ("slot_lengths", pa.list_(pa.int32())), ("error", pa.string())])


def container_units(df: DataFrame, key: str, content: str, form: str) -> DataFrame:
    """(key, part_no, part, unit_no, text, slot_lengths, error) of binary rows; a bad container gives one row with its error.

    df may come from spark.read.format("binaryFile"). A batch holds few rows, since rows are whole files.
    """

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(k, *u, None) for u in extract(data or b"", form)]
                except ContainerError as e:
                    rows = [(k, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_UNITS)], schema=_UNITS)

    return df.select(F.col(key).cast("long"), content).mapInArrow(run, "key long, part_no int, part string, unit_no int, text string, slot_lengths array<int>, error string")


def built_containers(df: DataFrame, key: str, content: str, units: str, form: str) -> DataFrame:
    """(key, content, error): containers with their units (an array of strings) put in."""

    def run(batches):
        for batch in batches:
            for k, data, texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    row = (k, build(data or b"", texts or [], form), None)
                except ContainerError as e:
                    row = (k, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.string())], names=["key", "content", "error"])

    return df.select(F.col(key).cast("long"), content, units).mapInArrow(run, "key long, content binary, error string")


def packed_containers(df: DataFrame, key: str, units: str, form: str) -> DataFrame:
    """(key, content): new containers from arrays of paragraphs."""

    def run(batches):
        for batch in batches:
            made = [packed(x or [], form) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "content"])

    return df.select(F.col(key).cast("long").alias("key"), units).mapInArrow(run, "key long, content binary")


def xhtml_state(data: bytes) -> str:
    """xml: well formed as it is; spelled: after its named entities are spelled out; rejected: not at all."""
    for state, body in (("xml", data), ("spelled", re.sub(rb"&([A-Za-z][A-Za-z0-9]+);", _named, data))):
        try:
            BookReader(body)
            return state
        except expat.ExpatError:
            continue
    return "rejected"


def units_by_format(df: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """container_units of rows of any format, read as their names' suffixes say; a suffix without a reader gives an error row."""
    suffix = extension(F.col(name))
    rows = df.select(F.col(key).cast("long").alias("key"), suffix.alias("suffix"), F.col(content).alias("content"))
    read = [container_units(rows.where(F.col("suffix") == f".{form}"), "key", "content", form) for form in ("docx", "epub")]
    other = rows.where(~F.coalesce(F.col("suffix").isin(".docx", ".epub"), F.lit(False)))
    missing = (F.lit(None).cast(f.dataType).alias(f.name) for f in read[0].schema.fields[1:-1])
    return read[0].unionByName(read[1]).unionByName(other.select("key", *missing, F.concat(F.lit("no reader for "), F.coalesce("suffix", F.lit(""))).alias("error")))
