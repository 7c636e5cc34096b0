"""Media columns: payloads stored as images in ZIP archives, read by a Spark data source.

``write_archives`` turns each text into UTF-8 bytes padded with zeros to a positive multiple
of 64, stores them losslessly as the samples of an 8-bit grey PNG image 64 wide, and appends
the image as a stored member to the archive of its task. The task's archive gets its final
name by one rename and the driver writes a manifest of the archives that were committed, so
a task that was lost or ran twice leaves nothing that is read.

The data source ``media_archive`` plans byte-range partitions over the archives of a manifest:
the driver looks at their sizes alone. Beside each archive lies its index, an entry of fixed
size per member (offset, size, checksum); the task of a range finds its slice of the index by
bisection, reads that slice alone, and streams batches through Arrow. Each member is
read by its own offset and tried again alone, with the archive opened anew, when a read fails
or a checksum is wrong; after ``retries`` the task fails, or, with ``on_error=row``, the
member's row carries the error and no payload.

Ids travel as text in member names, percent-encoded; ``media_features`` casts them to the type
that it is told. Null text counts as empty, which gives 64 zero bytes. Repeated rows are members of their own;
equal texts give equal images and features. An empty table gives an empty archive folder and
an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citeweave.llm.common import bounded_batches, lean, text_array

WIDTH = 64
RANGE_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
MANIFEST = "manifest.json"
#: An index entry: offset of the member, size and checksum of its image.
_ENTRY = struct.Struct("<QQI")
_PNG = b"\x89PNG\r\n\x1a\n"


# ------------------------------------------------------------------ image codec


def pad(data: bytes) -> bytes:
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    return data.ljust(size, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes) -> bytes:
    """Grey image of the padded bytes; a text chunk keeps the length without padding."""
    rows = np.frombuffer(pad(data), dtype=np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(filtered, 3)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> tuple[bytes, int]:
    """(samples, length without padding); ValueError if the image is damaged."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body, height, n_bytes = 8, [], None, None
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("wrong checksum in a chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not a grey image of 8 bits, 64 wide")
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            n_bytes = int(data[6:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    samples = rows[:, 1:].tobytes()
    return samples, len(samples) if n_bytes is None else n_bytes


def feature(samples: bytes | memoryview) -> str:
    """Mean, deviation, share of zero samples, edges, and a 64-bit difference hash over 8 bands of rows."""
    image = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    cuts = np.linspace(0, len(image), 9).astype(int)
    cells = image.reshape(len(image), 8, 8).sum(axis=2, dtype=np.int64)
    bands = np.stack([cells[a:b].sum(axis=0) / max(1, b - a) for a, b in zip(cuts, cuts[1:])])
    bits = (bands > np.roll(bands, 1, axis=1)).ravel()
    word = int(np.packbits(bits).view(">u8")[0])
    edges = np.count_nonzero(image[:, 1:] != image[:, :-1]) / (len(image) * (WIDTH - 1))
    return f"{image.mean():.4f};{image.std():.4f};{np.count_nonzero(image == 0) / image.size:.4f};{edges:.4f};{word:016x}"


# ------------------------------------------------------------------ archives


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _write_task(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = _filesystem(folder)
    done: list[tuple[str, int, int]] = []
    archive, sink, name, members = None, None, "", 0
    index = bytearray()

    def close() -> None:
        nonlocal archive
        archive.close()
        sink.close()
        with fs.open_output_stream(f"{root}/{name}.index") as out:
            out.write(bytes(index))
        fs.move(f"{root}/.{name}", f"{root}/{name}")
        done.append((name, fs.get_file_info(f"{root}/{name}").size, members))
        archive = None

    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), text_array(batch.column("text")).to_pylist(), strict=True):
            if archive is None:
                name, members = f"{uuid.uuid4().hex}.zip", 0
                index.clear()
                sink = fs.open_output_stream(f"{root}/.{name}")
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
            info = zipfile.ZipInfo(f"{members:08d}.png" if key is None else f"{members:08d}/{quote(str(key), safe='')}.png")
            image = encode_png(text.encode("utf-8", "surrogatepass"))
            archive.writestr(info, image)
            index += _ENTRY.pack(info.header_offset, len(image), zlib.crc32(image))
            members += 1
            if sink.tell() >= ARCHIVE_BYTES:
                close()
    if archive is not None:
        close()
    columns = list(zip(*done, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["name", "bytes", "members"])


def write_archives(documents: DataFrame, folder: str) -> int:
    """Write the archives and their manifest (a line per archive); the number of members."""
    bounded_batches(documents.sparkSession)
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = documents.select("doc_id", "text").mapInArrow(partial(_write_task, folder), "name string, bytes long, members long").collect()
    with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
        for r in sorted(rows):
            out.write((json.dumps([r.name, r.bytes, r.members]) + "\n").encode())
    return sum(r.members for r in rows)


def _id_of(member: str) -> str | None:
    """The id in a member's name; null where it has none."""
    number, has_id, name = member.partition("/")
    return unquote(name.removesuffix(".png")) if has_id else None


class _Range(InputPartition):
    def __init__(self, name: str, low: int, high: int):
        super().__init__((name, low, high))
        self.name, self.low, self.high = name, low, high


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", 1 << 20))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("on_error", "fail")

    def partitions(self) -> list[_Range]:
        fs, root = _filesystem(self.folder)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as lines:
            archives = [json.loads(x) for x in lines.read().decode().splitlines()]
        return [_Range(name, low, min(low + self.range_bytes, size)) for name, size, _ in archives for low in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def _open(self, name: str) -> pa.NativeFile:
        fs, root = _filesystem(self.folder)
        return fs.open_input_file(f"{root}/{name}")

    def _slice(self, part: _Range) -> list[tuple[int, int, int]]:
        """(offset, size, checksum) of the members that start in the range."""
        with self._open(f"{part.name}.index") as index:
            n = index.size() // _ENTRY.size

            def first(offset: int) -> int:
                low, high = 0, n
                while low < high:
                    middle = (low + high) // 2
                    index.seek(middle * _ENTRY.size)
                    if _ENTRY.unpack(index.read(_ENTRY.size))[0] < offset:
                        low = middle + 1
                    else:
                        high = middle
                return low

            start, stop = first(part.low), first(part.high)
            index.seek(start * _ENTRY.size)
            return list(_ENTRY.iter_unpack(index.read((stop - start) * _ENTRY.size)))

    def _member(self, file: pa.NativeFile, entry: tuple[int, int, int]) -> tuple[str, bytes]:
        """Name and bytes of a member."""
        offset, size, crc = entry
        file.seek(offset)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {offset}")
        name_len, extra_len = struct.unpack("<HH", head[26:30])
        name = file.read(name_len).decode()
        file.seek(offset + 30 + name_len + extra_len)
        image = file.read(size)
        if len(image) != size or zlib.crc32(image) != crc:
            raise OSError(f"member at {offset} is damaged")
        return name, image

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        file = self._open(part.name)
        rows: list[tuple] = []
        held = 0
        for entry in self._slice(part):
            name = image = samples = n_bytes = error = None
            for attempt in range(self.retries + 1):
                try:
                    name, image = self._member(file, entry)
                    samples, n_bytes = decode_png(image)
                    error = None
                    break
                except (OSError, ValueError, zlib.error, struct.error) as trouble:
                    error = f"{type(trouble).__name__}: {trouble}"
                    if attempt == self.retries and self.on_error != "row":
                        raise
                    file = self._open(part.name)
            digest = None if samples is None else hashlib.sha256(image).hexdigest()
            rows.append((name, entry[0], n_bytes, samples, None if samples is None else len(image), digest, error))
            held += len(samples or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


_FIELDS = [
    ("member", pa.string()),
    ("offset", pa.int64()),
    ("n_bytes", pa.int64()),
    ("payload", pa.binary()),
    ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()),
    ("error", pa.string()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes, batchBytes, retries, on_error."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, offset long, n_bytes long, payload binary, media_bytes long, media_sha256 string, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    bounded_batches(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


# ------------------------------------------------------------------ columns

_OUT = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def media_features(media: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, cast to ``id_type``, and the digests and features of each member; null features where it could not be read."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = None
            keys = [None if m is None else _id_of(m) for m in batch.column("member").to_pylist()]
            payloads = batch.column("payload")
            rows = []
            for k, (n, size, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "media_bytes", "media_sha256")), strict=True)):
                if not payloads[k].is_valid:
                    rows.append((None,) * len(_OUT))
                    continue
                payload = memoryview(payloads[k].as_buffer())
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature(payload)))
            values = list(zip(*rows, strict=True)) or [()] * len(_OUT)
            columns = [pa.array(keys, pa.string()), *(pa.array(v, type=t) for v, (_, t) in zip(values, _OUT, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *dict(_OUT)])
            del batch, payloads, payload
            pa.default_memory_pool().release_unused()

    ddl = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = media.select("member", "n_bytes", "payload", "media_bytes", "media_sha256").mapInArrow(run, ddl)
    return found.withColumn("doc_id", found["doc_id"].cast(id_type))
