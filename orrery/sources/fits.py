"""FITS files as a Spark source and sink.

Reading: ``spark.read.format("fits").option("path", ...).option("ext", n or name).load()``. Headers are read on the driver;
each task reads a range of rows of one file. ``path`` may be a folder or a pattern: files of one schema. Kinds: binary and
ASCII tables, images (a row a pixel: i1 .. iN from 1, value), random groups. gzip, bzip2 and zip files are one partition each. Option
``number`` true adds _row, the row's number in its file from 1.
Undefined values are NULL: NaN, integers equal to TNULL or BLANK, strings that begin with NUL (option ``nulls`` false: as stored).
Writing: every partition writes a complete binary-table file of its own into the folder, so nothing is merged anywhere; a
partition's rows are held by its task, so partitions should be of the size files are meant to have. NULL comes back as NULL;
text that is not ASCII and whole numbers equal to the mark of NULL raise an error. Each file has DATASUM and CHECKSUM.
Paths must be open to Python's open() on driver and executors; for other stores read bytes with ``binaryFile`` and use
``tables_from_bytes``.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import math
import os
import re
import uuid
import zipfile
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from orrery.operators.diff import column_diff, header_diff, table_diff

BLOCK, CARD = 2880, 80
#: Letters of table formats: bytes, numpy kind, Spark type. Fixed values of the file format.
KINDS = {"L": ("i1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType())}
COMPLEX = {"C": ">f4", "M": ">f8"}
PIXELS = {8: ("u1", T.ShortType()), 16: (">i2", T.ShortType()), 32: (">i4", T.IntegerType()), 64: (">i8", T.LongType()), -32: (">f4", T.FloatType()), -64: (">f8", T.DoubleType())}


def parse_card(card: str) -> tuple[str, object, str]:
    """(keyword, value, comment) of an 80-character card."""
    keyword = card[:8].rstrip()
    if keyword == "HIERARCH" and "=" in card:
        keyword, rest = (p.strip() for p in card[9:].split("=", 1))
    elif card[8:10] == "= ":
        rest = card[10:]
    else:
        return keyword, card[8:].rstrip() if keyword in ("COMMENT", "HISTORY", "", "CONTINUE") else None, ""
    if m := re.match(r"\s*'((?:[^']|'')*)'\s*(?:/(.*))?", rest):
        return keyword, m[1].replace("''", "'").rstrip(), (m[2] or "").strip()
    text, _, comment = rest.partition("/")
    text = text.strip()
    if text in ("T", "F"):
        return keyword, text == "T", comment.strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return keyword, int(text), comment.strip()
    try:
        return keyword, float(text.replace("D", "E").replace("d", "e")), comment.strip()
    except ValueError:
        return keyword, text or None, comment.strip()


def format_card(keyword: str, value, comment: str = "") -> str:
    """One card, or several: long commentary takes more cards, and a long string goes on in CONTINUE cards."""
    if keyword in ("COMMENT", "HISTORY", "", "END"):
        text = "" if value is None else str(value)
        return "".join(f"{keyword:8}{text[i : i + 72]}".ljust(CARD) for i in range(0, max(1, len(text)), 72))
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20d}"
    elif isinstance(value, float):
        text = f"{value:.16G}"
        text = f"{text if '.' in text or 'E' in text else text + '.0':>20}"
    else:
        quoted = str(value).replace("'", "''")
        if len(quoted) > 68:
            parts, rest = [], quoted
            while rest:
                end = 67 if len(rest) > 68 else 68
                end -= rest[:end].endswith("'") and (len(rest[:end]) - len(rest[:end].rstrip("'"))) % 2
                parts.append(rest[:end])
                rest = rest[end:]
            cards = [f"{'CONTINUE' if i else keyword:8}{'  ' if i else '= '}'{p}{'&' if i < len(parts) - 1 else ''}'" for i, p in enumerate(parts)]
            if comment and len(cards[-1]) + 3 + len(comment) <= CARD:
                cards[-1] += f" / {comment}"
            return "".join(c.ljust(CARD) for c in cards)
        text = f"'{quoted:8}'".ljust(20)
    card = f"{keyword:8}= {text}" + (f" / {comment}" if comment else "")
    return card[: max(CARD, len(f"{keyword:8}= {text}"))].ljust(CARD)


def joined_cards(cards: list[tuple]) -> list[tuple]:
    """Strings that end in & and go on in CONTINUE cards, as one card each."""
    out: list[tuple] = []
    for k, v, c in cards:
        if k == "CONTINUE" and out and isinstance(out[-1][1], str) and out[-1][1].endswith("&"):
            m = re.match(r"\s*'((?:[^']|'')*)'\s*(?:/(.*))?", v or "")
            if m:
                out[-1] = (out[-1][0], out[-1][1][:-1] + m[1].replace("''", "'").rstrip(), (m[2] or "").strip() or out[-1][2])
                continue
        out.append((k, v, c))
    return out


def pad(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % BLOCK)


def header_bytes(cards: list[tuple]) -> bytes:
    """Cards as blocks. Text that is not ASCII raises UnicodeEncodeError."""
    return pad("".join(format_card(*c) for c in [*cards, ("END", "")]).encode("ascii"), b" ")


def word_sum(data: bytes, before: int = 0) -> int:
    """The ones' complement sum of the big-endian 32-bit words of bytes, filled up with zeros."""
    total = before + int(np.frombuffer(data + b"\0" * (-len(data) % 4), ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def checksum_text(total: int) -> str:
    """Sixteen letters and digits that make the sum of a unit with them all ones. Each byte of the complement is spread over
    four characters; pairs move apart until no punctuation is left."""
    bytes_ = (~total & 0xFFFFFFFF).to_bytes(4, "big")
    columns = []
    for v in bytes_:
        quarter, rest = divmod(v, 4)
        four = [quarter + 48 + (rest if i == 0 else 0) for i in range(4)]
        odd = set(range(0x3A, 0x41)) | set(range(0x5B, 0x61))
        while any(c in odd for c in four):
            for i in (0, 2):
                if four[i] in odd or four[i + 1] in odd:
                    four[i], four[i + 1] = four[i] + 1, four[i + 1] - 1
        columns.append(four)
    text = "".join(chr(columns[j][i]) for i in range(4) for j in range(4))
    return text[-1] + text[:-1]


def with_checksum(cards: list[tuple], data: bytes) -> bytes:
    """A header with DATASUM and CHECKSUM, and its data, padded."""
    data = pad(data)
    datasum = word_sum(data)
    make = lambda text: header_bytes([*cards, ("DATASUM", str(datasum)), ("CHECKSUM", text)])
    return make(checksum_text(word_sum(make("0" * 16), datasum))) + data


def verify_checksums(path: str) -> list[tuple[int, str, bool | None, bool | None]]:
    """(unit, name, data sum right, checksum right) of each unit; None where the card is missing."""
    out = []
    with open_file(path) as f:
        for h in walk(f):
            f.seek(h.start)
            datasum, left = 0, h.size + -h.size % BLOCK
            while left > 0 and (part := f.read(min(left, BLOCK * 1024))):
                datasum, left = word_sum(part, datasum), left - len(part)
            f.seek(h.begin)
            whole = word_sum(f.read(h.start - h.begin), datasum)
            told = str(h.header["DATASUM"]).strip() if "DATASUM" in h.header else None
            out.append((h.index, h.name, None if told is None else int(told) == datasum, whole in (0, 0xFFFFFFFF) if "CHECKSUM" in h.header else None))
    return out


@dataclass
class Hdu:
    index: int
    cards: list
    header: dict
    start: int  # of the data
    size: int  # of the data without padding
    begin: int = 0  # of the header

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", "PRIMARY" if not self.index else "")).strip()

    @property
    def kind(self) -> str:
        x = str(self.header.get("XTENSION", "IMAGE")).strip()
        if x == "BINTABLE":
            return "bintable"
        if x == "TABLE":
            return "table"
        return "groups" if self.header.get("GROUPS") is True and self.header.get("NAXIS1") == 0 else "image" if x == "IMAGE" else "other"


def open_file(path: str):
    path = path.removeprefix("file://").removeprefix("file:")
    with open(path, "rb") as f:
        magic = f.read(3)
    if magic[:2] == b"PK":
        with zipfile.ZipFile(path) as z:
            return z.open(z.namelist()[0])
    return gzip.open(path) if magic[:2] == b"\x1f\x8b" else bz2.open(path) if magic == b"BZh" else open(path, "rb")


def splittable(path: str) -> bool:
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        magic = f.read(3)
    return magic[:2] not in (b"\x1f\x8b", b"PK") and magic != b"BZh"


def walk(f) -> list[Hdu]:
    """All header-data units; data is skipped, not read."""
    out, at = [], 0
    while True:
        f.seek(at)
        begin = at
        cards, done = [], False
        while not done:
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                return out
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD].decode("ascii", "replace")
                if card[:8].rstrip() == "END":
                    done = True
                    break
                cards.append(parse_card(card))
        cards, header = joined_cards(cards), {}
        for k, v, _ in cards:
            header.setdefault(k, v)
        axes = [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0) or 0))]
        n = math.prod(axes[1:] if header.get("GROUPS") is True and axes and axes[0] == 0 else axes) if axes else 0
        size = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1) or 1) * (int(header.get("PCOUNT", 0) or 0) + n)
        out.append(Hdu(len(out), cards, header, at, size, begin))
        at += size + (-size % BLOCK)


def find_hdu(hdus: list[Hdu], ext) -> Hdu:
    """By number, or by name without case, with ",version" behind it where several have the name; without either the first
    that is a table, else the first with data."""
    if ext is None or ext == "":
        return next((h for h in hdus if h.kind in ("bintable", "table")), next((h for h in hdus if h.size), hdus[0]))
    if str(ext).isdigit():
        return hdus[int(ext)]
    name, _, version = str(ext).partition(",")
    found = [h for h in hdus if h.name.lower() == name.strip().lower() and (not version or int(h.header.get("EXTVER", 1) or 1) == int(version))]
    if len(found) != 1:
        raise KeyError(f"{'several extensions' if found else 'no extension'} {ext!r}")
    return found[0]


@dataclass
class Field:
    name: str
    repeat: int
    code: str
    variable: str | None
    scale: float
    zero: float
    metadata: dict
    start: int = 0
    width: int = 0

    @property
    def whole_zero(self) -> bool:
        """Unsigned whole numbers are stored with a zero of half their range."""
        return self.scale == 1 and self.zero in (2**15, 2**31, 2**63, -128) and (self.variable or self.code) in "BIJK"

    def base(self) -> T.DataType:
        code = self.variable or self.code
        if code in COMPLEX:
            part = T.FloatType() if code == "C" else T.DoubleType()
            return T.StructType([T.StructField("re", part), T.StructField("im", part)])
        if self.whole_zero:
            return {"B": T.ShortType(), "I": T.IntegerType(), "J": T.LongType(), "K": T.DecimalType(20, 0)}[code]
        if self.scale != 1 or self.zero != 0:
            return T.DoubleType()
        return T.BooleanType() if code == "X" else T.StringType() if code == "A" else KINDS[code][1]

    def spark(self) -> T.DataType:
        if self.variable:
            return T.StringType() if self.variable == "A" else T.ArrayType(self.base())
        return self.base() if self.code == "A" or self.repeat == 1 and self.code != "X" else T.ArrayType(self.base())

    def raw(self) -> tuple:
        if self.variable:
            return (self.name, ">i4" if self.code == "P" else ">i8", (2,))
        if self.code == "A":
            return (self.name, f"S{self.repeat}")
        if self.code == "X":
            return (self.name, "u1", ((self.repeat + 7) // 8,))
        kind = COMPLEX[self.code] if self.code in COMPLEX else KINDS[self.code][0]
        n = self.repeat * (2 if self.code in COMPLEX else 1)
        return (self.name, kind, (n,))


def fields_of(h: Hdu) -> list[Field]:
    out = []
    for i in range(1, int(h.header.get("TFIELDS", 0)) + 1):
        form = str(h.header.get(f"TFORM{i}", "")).strip()
        meta = {k: h.header[f"{w}{i}"] for k, w in (("unit", "TUNIT"), ("null", "TNULL"), ("scale", "TSCAL"), ("zero", "TZERO"), ("disp", "TDISP"), ("dim", "TDIM")) if f"{w}{i}" in h.header}
        name = str(h.header.get(f"TTYPE{i}", f"col{i}")).strip()
        scale, zero = float(h.header.get(f"TSCAL{i}", 1)), float(h.header.get(f"TZERO{i}", 0))
        if h.kind == "table":
            m = re.match(r"([AIJFED])(\d*)", form)
            out.append(Field(name, 1, m[1], None, scale, zero, meta | {"form": form}, int(h.header.get(f"TBCOL{i}", 1)) - 1, int(m[2] or 10)))
        else:
            m = re.match(r"(\d*)([LXBIJKAEDCMPQ])([LXBIJKAEDCM]?)", form)
            out.append(Field(name, int(m[1]) if m[1] else 1, m[2], m[3] if m[2] in "PQ" else None, scale, zero, meta | {"form": form}))
    return [f for f in out if f.repeat or f.variable]


def schema_of(h: Hdu) -> T.StructType:
    if h.kind == "table":
        kinds = {"A": T.StringType(), "I": T.IntegerType(), "J": T.LongType(), "F": T.DoubleType(), "E": T.DoubleType(), "D": T.DoubleType()}
        return T.StructType([T.StructField(f.name, kinds[f.code] if f.scale == 1 and f.zero == 0 else T.DoubleType(), True, f.metadata) for f in fields_of(h)])
    if h.kind == "bintable":
        return T.StructType([T.StructField(f.name, f.spark(), True, f.metadata) for f in fields_of(h)])
    kind = T.DoubleType() if float(h.header.get("BSCALE", 1)) != 1 or float(h.header.get("BZERO", 0)) != 0 else PIXELS[int(h.header["BITPIX"])][1]
    if h.kind == "groups":
        return T.StructType([T.StructField(str(h.header.get(f"PTYPE{i + 1}", f"p{i + 1}")), T.DoubleType()) for i in range(int(h.header["PCOUNT"]))] + [T.StructField("data", T.ArrayType(kind))])
    return T.StructType([T.StructField(f"i{i + 1}", T.IntegerType()) for i in range(int(h.header.get("NAXIS", 0)))] + [T.StructField("value", kind)])


def _plain(f: Field, values: np.ndarray, null_as_null: bool = True) -> list:
    """Stored numbers of one cell or column as Python values; NaN and those equal to TNULL are None."""
    out, code, null = _values(f, values), f.variable or f.code, f.metadata.get("null")
    if not null_as_null:
        return out
    if code in "ED":
        return [None if v != v else v for v in out]
    if null is not None and code in "BIJK":
        return [None if r == null else v for r, v in zip(values.tolist(), out, strict=True)]
    return out


def _values(f: Field, values: np.ndarray) -> list:
    code = f.variable or f.code
    if code == "L":
        return [None if v == 0 else v == 84 for v in values.tolist()]
    if code in COMPLEX:
        return [(float(a), float(b)) for a, b in values.reshape(-1, 2)]
    if f.whole_zero:
        from decimal import Decimal

        return [Decimal(v + int(f.zero)) if code == "K" else v + int(f.zero) for v in values.tolist()]
    return (values.astype(float) * f.scale + f.zero).tolist() if f.scale != 1 or f.zero != 0 else values.tolist()


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t.fields])
    plain = {T.BooleanType: pa.bool_(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.StringType: pa.string()}
    return pa.decimal128(20, 0) if isinstance(t, T.DecimalType) else plain[type(t)]


def read_batches(f, h: Hdu, first: int, count: int, null_as_null: bool = True, step: int = 50_000):
    """Arrow batches of rows first .. first + count - 1 (pixels of an image)."""
    schema = pa.schema([(x.name, arrow_type(x.dataType)) for x in schema_of(h).fields])
    for a in range(first, first + count, step):
        yield pa.RecordBatch.from_arrays(_columns(f, h, a, min(step, first + count - a), schema, null_as_null), schema=schema)


def _columns(f, h: Hdu, first: int, count: int, schema: pa.Schema, null_as_null: bool) -> list[pa.Array]:
    if h.kind in ("bintable", "table"):
        width = int(h.header["NAXIS1"])
        f.seek(h.start + first * width)
        data = f.read(count * width)
        fields = fields_of(h)
        if h.kind == "table":
            lines = [data[r * width : (r + 1) * width].decode("ascii", "replace") for r in range(count)]
            return [pa.array([_ascii(x, line[x.start : x.start + x.width]) for line in lines], t) for x, t in zip(fields, schema.types, strict=True)]
        rows = np.frombuffer(data, np.dtype([x.raw() for x in fields]), count)
        heap = h.start + int(h.header.get("THEAP", width * int(h.header["NAXIS2"])))
        return [_array(f, x, rows[x.name], heap, t, null_as_null) for x, t in zip(fields, schema.types, strict=True)]
    kind = PIXELS[int(h.header["BITPIX"])][0]
    scale, zero, blank = float(h.header.get("BSCALE", 1)), float(h.header.get("BZERO", 0)), h.header.get("BLANK")
    axes = [int(h.header[f"NAXIS{i + 1}"]) for i in range(int(h.header.get("NAXIS", 0)))]
    item = np.dtype(kind).itemsize
    if h.kind == "groups":
        p, n = int(h.header["PCOUNT"]), math.prod(axes[1:])
        f.seek(h.start + first * (p + n) * item)
        rows = np.frombuffer(f.read(count * (p + n) * item), kind).reshape(count, p + n)
        params = [pa.array(rows[:, i].astype(float) * float(h.header.get(f"PSCAL{i + 1}", 1)) + float(h.header.get(f"PZERO{i + 1}", 0))) for i in range(p)]
        cells = _scaled(rows[:, p:].reshape(-1), kind, scale, zero, blank, schema.types[-1].value_type, null_as_null)
        return [*params, pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * n), cells)]
    f.seek(h.start + first * item)
    values = np.frombuffer(f.read(count * item), kind)
    at, places = np.arange(first, first + count), []
    for n in axes:
        places.append(pa.array((at % n + 1).astype(np.int32)))
        at = at // n
    return [*places, _scaled(values, kind, scale, zero, blank, schema.types[-1], null_as_null)]


def _scaled(raw: np.ndarray, kind: str, scale: float, zero: float, null, t: pa.DataType, null_as_null: bool) -> pa.Array:
    """Stored numbers as an array: NaN, and whole numbers equal to ``null``, are NULL."""
    gone = np.isnan(raw) if kind[-2] == "f" else (raw == int(null)) if null is not None else None
    values = raw.astype(float) * scale + zero if scale != 1 or zero != 0 else raw.astype(raw.dtype.newbyteorder("="))
    return pa.array(values, mask=gone if null_as_null else None).cast(t)


def _array(f, x: Field, raw: np.ndarray, heap: int, t: pa.DataType, null_as_null: bool) -> pa.Array:
    """One column of a binary table; plain numbers never become Python objects."""
    if not x.variable and x.repeat == 1 and x.code in "BIJKED" and not x.whole_zero:
        return _scaled(raw.reshape(-1), KINDS[x.code][0], x.scale, x.zero, x.metadata.get("null") if x.code in "BIJK" else None, t, null_as_null)
    return pa.array(_column(f, x, raw, heap, null_as_null), t)


def _ascii(f: Field, text: str):
    if f.code == "A":
        return text.rstrip()
    text = text.strip()
    if "null" in f.metadata and text == str(f.metadata["null"]).strip() or not text:
        value = 0
    elif f.code in "IJ":
        value = int(text)
    else:
        value = float(text.replace("D", "E"))
    if f.scale != 1 or f.zero != 0:
        return value * f.scale + f.zero
    return value if f.code in "IJ" else float(value)


def _column(f, x: Field, raw: np.ndarray, heap: int, null_as_null: bool) -> list:
    if x.variable:
        item = 1 if x.variable in "AX" else np.dtype(COMPLEX[x.variable] if x.variable in COMPLEX else KINDS[x.variable][0]).itemsize * (2 if x.variable in COMPLEX else 1)
        out = []
        for n, at in raw.tolist():
            f.seek(heap + at)
            data = f.read(n * item if x.variable != "X" else (n + 7) // 8)
            if x.variable == "A":
                out.append(data.rstrip(b"\0 ").decode("ascii", "replace"))
            elif x.variable == "X":
                out.append(np.unpackbits(np.frombuffer(data, "u1"))[:n].astype(bool).tolist())
            else:
                out.append(_plain(x, np.frombuffer(data, COMPLEX.get(x.variable) or KINDS[x.variable][0]), null_as_null))
        return out
    if x.code == "A":
        return [None if null_as_null and v[:1] in (b"", b"\0") else v.rstrip(b"\0 ").decode("ascii", "replace") for v in raw.tolist()]
    if x.code == "X":
        return [r[: x.repeat].astype(bool).tolist() for r in np.unpackbits(raw, axis=1)]
    if x.repeat == 1:
        return _plain(x, raw.reshape(-1), null_as_null)
    return [_plain(x, r, null_as_null) for r in raw]


def row_count(h: Hdu) -> int:
    if h.kind in ("bintable", "table"):
        return int(h.header["NAXIS2"])
    return int(h.header.get("GCOUNT", 1)) if h.kind == "groups" else math.prod(int(h.header[f"NAXIS{i + 1}"]) for i in range(int(h.header.get("NAXIS", 0)))) if h.size else 0


def wants_numbers(options) -> bool:
    return str(options.get("number", "false")).lower() == "true"


class _Rows(InputPartition):
    def __init__(self, path: str, unit: Hdu | None, first: int, count: int):
        self.path, self.unit, self.first, self.count = path, unit, first, count


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, paths: list[str]):
        self.paths, self.ext, self.chunk = paths, options.get("ext"), int(options.get("rows", 200_000))
        self.null_as_null = str(options.get("nulls", "true")).lower() == "true"
        self.number = wants_numbers(options)

    def partitions(self):
        out = []
        for path in self.paths:
            with open_file(path) as f:
                h = replace(find_hdu(walk(f), self.ext), cards=[])
            n, step = row_count(h), self.chunk if splittable(path) else 1 << 62
            out += [_Rows(path, h, a, min(step, n - a)) for a in range(0, n, step)]
        return out or [_Rows("", None, 0, 0)]

    def read(self, part: _Rows):
        if part.count:
            with open_file(part.path) as f:
                at = part.first
                for batch in read_batches(f, part.unit, part.first, part.count, self.null_as_null):
                    yield batch.append_column("_row", pa.array(np.arange(at + 1, at + 1 + len(batch)))) if self.number else batch
                    at += len(batch)


def form_of(t: T.DataType, width: int) -> str:
    if isinstance(t, T.ArrayType):
        return f"P{form_of(t.elementType, 1)[-1]}()"
    letters = {T.BooleanType: "L", T.ByteType: "I", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D", T.TimestampType: "D", T.DateType: "J"}
    return f"{width}A" if isinstance(t, T.StringType) else f"1{letters[type(t)]}"


def table_bytes(schema: T.StructType, rows: list, name: str) -> bytes:
    """A complete file with one binary table. Numbers that are NULL become NaN, or the least whole number (TNULL)."""
    forms, columns, heap = [], [], bytearray()
    for i, f in enumerate(schema.fields):
        values = [r[i] for r in rows]
        if isinstance(f.dataType, T.StringType):
            raw = [None if v is None else v.encode("ascii") for v in values]
            width = max([1, *(len(v) for v in raw if v)])
            forms.append((form_of(f.dataType, width), None))
            columns.append(np.array([b"\0" if v is None else v.ljust(width) for v in raw], f"S{width}"))
        elif isinstance(f.dataType, T.ArrayType):
            form = form_of(f.dataType, 1)
            kind, places = KINDS[form[1]][0], []
            for v in values:
                data = np.array([84 if e is True else 70 if e is False else e for e in v or []], kind).tobytes()
                places.append((len(v or []), len(heap)))
                heap += data
            forms.append((form, None))
            columns.append(np.array(places, ">i4").reshape(-1, 2))
        else:
            form = form_of(f.dataType, 1)
            kind = KINDS[form[-1]][0]
            null = int(np.iinfo(np.dtype(kind)).min) if form[-1] in "IJK" else None
            if form[-1] == "L":
                columns.append(np.array([0 if v is None else 84 if v else 70 for v in values], "i1"))
            else:
                if null is not None and any(v is None for v in values) and any(v == null for v in values):
                    raise ValueError(f"column {f.name!r} holds {null}, which would mark its NULLs")
                columns.append(np.array([(null if null is not None else np.nan) if v is None else v.timestamp() if hasattr(v, "timestamp") else v for v in values], kind))
            forms.append((form, null if any(v is None for v in values) else None))
    dtype = np.dtype([(f"c{i}", c.dtype, c.shape[1:]) for i, c in enumerate(columns)])
    table = np.zeros(len(rows), dtype)
    for i, c in enumerate(columns):
        table[f"c{i}"] = c
    cards = [("XTENSION", "BINTABLE", "binary table"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (f, (form, null)) in enumerate(zip(schema.fields, forms, strict=True), 1):
        cards += [(f"TTYPE{i}", f.name), (f"TFORM{i}", form), *([(f"TNULL{i}", null)] if null is not None else []), *([(f"TUNIT{i}", f.metadata["unit"])] if "unit" in f.metadata else [])]
    primary = header_bytes([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])
    return primary + with_checksum([*cards, ("EXTNAME", name)], table.tobytes() + bytes(heap))


@dataclass
class _Wrote(WriterCommitMessage):
    path: str


class FitsWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.name, self.schema = options.get("extname", "TABLE"), schema
        if os.path.exists(self.folder) and os.listdir(self.folder) and not overwrite and str(options.get("add", "false")) != "true":
            raise FileExistsError(self.folder)
        os.makedirs(self.folder, exist_ok=True)
        self.old = [os.path.join(self.folder, x) for x in os.listdir(self.folder)] if overwrite else []

    def write(self, rows):
        final = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.fits")
        with open(final + ".tmp", "wb") as f:
            f.write(table_bytes(self.schema, list(rows), self.name))
        return _Wrote(final)

    def commit(self, messages):
        for m in messages:
            os.rename(m.path + ".tmp", m.path)
        for path in self.old:
            os.remove(path)

    def abort(self, messages):
        for m in messages:
            if m:
                os.remove(m.path + ".tmp")


class FitsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "fits"

    def paths(self) -> list[str]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        found = sorted(glob.glob(os.path.join(path, "*.fit*")) if os.path.isdir(path) else glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def schema(self):
        with open_file(self.paths()[0]) as f:
            found = schema_of(find_hdu(walk(f), self.options.get("ext")))
        return found.add("_row", T.LongType()) if wants_numbers(self.options) else found

    def reader(self, schema):
        return FitsReader(dict(self.options), self.paths())

    def writer(self, schema, overwrite):
        return FitsWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsDataSource)


def header(spark: SparkSession, path: str) -> DataFrame:
    """(hdu, place, keyword, n, value, comment) of every card; n counts a keyword's occurrences from 0."""
    rows = []
    with open_file(path) as f:
        for h in walk(f):
            seen: dict[str, int] = {}
            for i, (k, v, c) in enumerate(h.cards):
                rows.append((h.index, i, k, seen.get(k, 0), None if v is None else str(v), c))
                seen[k] = seen.get(k, 0) + 1
    return spark.createDataFrame(rows, "hdu int, place int, keyword string, n int, value string, comment string")


def header_text(cards: list[tuple]) -> str:
    """Cards (keyword, value, comment) as text of 80 columns a line, END at the end."""
    whole = header_bytes(cards).decode("ascii")
    lines = [whole[i : i + CARD].rstrip() for i in range(0, len(whole), CARD)]
    return "\n".join(lines[: lines.index("END") + 1])


def header_from_text(text: str) -> list[tuple]:
    """Cards of text with a card a line; lines after END don't count."""
    cards = []
    for line in text.splitlines():
        if line.rstrip() == "END":
            break
        cards.append(parse_card(line[:CARD].ljust(CARD)))
    return joined_cards(cards)


def unit_diff(spark: SparkSession, a: str, b: str, ignore: tuple[str, ...] = ("CHECKSUM", "DATASUM")) -> DataFrame:
    """(hdu, what, value_a, value_b): units that one file lacks, and units of another kind, name, size or number of rows, or
    whose cards differ; cards are compared by ``diff.header_diff``, rows by ``diff.table_diff`` on _row (see file_diff)."""
    units = []
    for path in (a, b):
        with open_file(path) as f:
            units.append({h.index: h for h in walk(f)})
    rows = []
    for i in sorted({*units[0], *units[1]}):
        x, y = units[0].get(i), units[1].get(i)
        if x is None or y is None:
            rows.append((i, "unit", x and x.name, y and y.name))
            continue
        for what, of in (("kind", lambda h: h.kind), ("name", lambda h: h.name), ("rows", lambda h: str(row_count(h))), ("size", lambda h: str(h.size))):
            if of(x) != of(y):
                rows.append((i, what, of(x), of(y)))
    cards = header_diff(header(spark, a), header(spark, b), ignore)
    structure = spark.createDataFrame(rows, "hdu int, what string, value_a string, value_b string")
    return structure.union(cards.select("hdu", F.concat(F.lit("card "), "keyword"), "value_a", "value_b"))


def file_diff(spark: SparkSession, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    """unit_diff, and cells and rows that differ in the tables that both files have, named by column and row."""
    found = unit_diff(spark, a, b)
    with open_file(a) as f, open_file(b) as g:
        both = [(x.index, schema_of(x) == schema_of(y)) for x, y in zip(walk(f), walk(g)) if x.kind == y.kind and x.kind in ("bintable", "table")]
    for i, same in both:
        x, y = (spark.read.format("fits").option("path", p).option("ext", str(i)).option("number", "true").load() for p in (a, b))
        cells = table_diff(x, y, "_row", tolerance)
        what = F.concat_ws(" ", F.lit("row"), "_row", "column_name")
        found = found.union(cells.select(F.lit(i).alias("hdu"), what, F.when(F.col("only_in") == "a", "there").otherwise(F.col("value_a")), F.when(F.col("only_in") == "b", "there").otherwise(F.col("value_b"))))
        if not same:
            found = found.union(column_diff(x, y).select(F.lit(i).alias("hdu"), F.concat(F.lit("column "), "name"), "type_a", "type_b"))
    return found


def open_rows(spark: SparkSession, path: str, ext=None, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of one extension, with a filter and columns given as text (Spark SQL)."""
    df = spark.read.format("fits").option("path", path)
    df = (df.option("ext", str(ext)) if ext is not None else df).load()
    df = df.where(where) if where else df
    return df.selectExpr(*columns) if columns else df


def info(spark: SparkSession, path: str) -> DataFrame:
    """A row a header-data unit: number, name, version, kind, cards, rows, dimensions."""
    with open_file(path) as f:
        rows = [(h.index, h.name, int(h.header.get("EXTVER", 1)), h.kind, len(h.cards), row_count(h), "x".join(str(h.header[f"NAXIS{i + 1}"]) for i in range(int(h.header.get("NAXIS", 0))))) for h in walk(f)]
    return spark.createDataFrame(rows, "hdu int, name string, version int, kind string, cards int, n long, dimensions string")


def tables_from_bytes(files: DataFrame, ext, schema: T.StructType) -> DataFrame:
    """Rows of one extension of whole files in a binary column ``content``, as ``binaryFile`` reads them from any store."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bz2.decompress(data) if data[:3] == b"BZh" else data)
                h = find_hdu(walk(f), ext)
                for part in read_batches(f, h, 0, row_count(h)):
                    yield part.rename_columns(schema.names)

    return files.select("content").mapInArrow(run, schema)
