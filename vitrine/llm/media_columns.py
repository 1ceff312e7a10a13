"""Images as columns: Netpbm and BMP to arrays, area resizing, NPY tiles and difference hashes.

`decode` reads plain and raw Netpbm (P1 to P6) and uncompressed BMP of 8, 24 or 32 bits as arrays of 8-bit samples;
`area_resize` averages by integral images, exactly also where target cells cut source pixels; `difference_hash` compares neighbouring
cells of a 9 x 8 reduction; `npy_tiles` writes an array as NPY files of bounded size.

`store_images` takes any column of encoded images and writes it with the NPY tiles of each image to a table in the
shared folder; `tile_rows` gives that table's tiles one a row, `describe` its digests and features, from the bytes read
back. The table is left for the folder's owner to clear.

`store_texts` keeps texts losslessly in such a table: the UTF-8 bytes, padded with zero bytes to a positive multiple of
64, are the samples of a grey image 64 wide, stored as binary Netpbm (or BMP). A null or empty text is one row of zero samples; equal texts give equal values; each row is
handled alone, so repeated rows, ties and empty tables need no care and memory is a few times the longest text.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from vitrine.llm.common import by_batch, stored, texts
from vitrine.llm.wordtape import text_buffer

WIDTH = 64
#: Rows and columns of a tile at most.
TILE = 1024
#: Bytes of encoded images after which a batch is cut, and of a row group of the stored table.
SLICE, ROW_GROUP = 16 << 20, 32 << 20

_KINDS = (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6")
_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary grey (P5) or colour (P6) map of 8-bit samples."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at = data[:2], 2
    fields = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _FIELD.match(data, at)
        if not found:
            raise ValueError("not a Netpbm header")
        fields.append(int(found[1]))
        at = found.end()
    width, height = fields[:2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if n > 8 * len(data) or kind not in _KINDS:  # a bit a sample at least
        raise ValueError("no image of the stated size")
    if kind == b"P1":  # digits may touch; 1 is black
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        samples = 255 * (1 - (np.frombuffer(re.sub(rb"\s", b"", body)[:n], np.uint8) - 48))
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1), axis=1)
        samples = 255 * (1 - bits[:, :width]).ravel()
    else:
        most = fields[2]
        if not 0 < most < 65536:
            raise ValueError("no largest sample")
        if kind in (b"P2", b"P3"):
            samples = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
        elif kind in (b"P5", b"P6"):
            samples = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), n, at + 1)
        else:
            raise ValueError("not a Netpbm image")
        if most != 255:
            samples = (samples.astype(np.int64) * 255 + most // 2) // most
    samples = samples.astype(np.uint8)
    return samples.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    height, width = image.shape[:2]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if image.ndim == 2 else b""
    rows = np.ascontiguousarray(image[::-1] if image.ndim == 2 else image[::-1, :, ::-1], np.uint8).reshape(height, -1)
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    at = 54 + len(palette)
    bits = 8 if image.ndim == 2 else 24
    return (
        struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at)
        + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0)
        + palette
        + body
    )


def decode_bmp(data: bytes) -> np.ndarray:
    at, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    if width <= 0 or width * abs(height) > len(data):
        raise ValueError("no image of the stated size")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)[:, : width * bits // 8]
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][rows]
        return palette[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target cell covers, from the integral image, which is linear inside a pixel's edges."""
    grey = image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    for axis, cells in ((0, height), (1, width)):
        n = grey.shape[axis]
        total = np.concatenate([np.zeros_like(grey.take([0], axis)), grey.cumsum(axis)], axis)
        edges = np.arange(cells + 1) * n / cells
        low = np.minimum(edges.astype(np.int64), n - 1)
        share = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = total.take(low, axis) * (1 - share) + total.take(low + 1, axis) * share
        grey = np.diff(at, axis=axis) * (cells / n)
    return grey


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of a 9 x 8 reduction is brighter than its left neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> list[bytes]:
    """The array as NPY files of at most tile x tile pixels, row by row."""
    out = []
    for top in range(0, image.shape[0], tile):
        for left in range(0, image.shape[1], tile):
            file = io.BytesIO()
            np.save(file, np.ascontiguousarray(image[top : top + tile, left : left + tile]))
            out.append(file.getvalue())
    return out


def _encode(batch: pa.RecordBatch, container: str) -> pa.RecordBatch:
    data, offsets = text_buffer(batch.column("text"))
    sizes, media = [], []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        samples = np.zeros(max(1, -(-(hi - lo) // WIDTH)) * WIDTH, np.uint8)
        samples[: hi - lo] = data[lo:hi]
        image = samples.reshape(-1, WIDTH)
        sizes.append(hi - lo)
        media.append(encode_bmp(image) if container == "bmp" else encode_netpbm(image))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def text_images(docs: DataFrame, container: str = "netpbm") -> DataFrame:
    """doc_id, n_bytes and the text's image as encoded bytes, `media`."""
    return texts(docs).mapInArrow(by_batch(lambda batch: _encode(batch, container)), "doc_id long, n_bytes long, media binary")


def _decoded(data: bytes | None) -> np.ndarray | None:
    """The image, or none where the bytes are none, are broken, or hold no pixel."""
    try:
        image = None if data is None else decode(data)
    except (ValueError, TypeError, IndexError, OverflowError, ZeroDivisionError, struct.error):
        return None
    return image if image is not None and image.size else None


def _extended(image: str, used: list[str], fields: list[pa.Field], fn: Callable[..., tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the columns `fields` of fn(image bytes, used columns) after those of the input but `used`; cut after each `SLICE` bytes of images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(image)), 0).to_numpy())
            edges = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                rows = list(map(fn, part.column(image).to_pylist(), *(part.column(c).to_pylist() for c in used)))
                added = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
                kept = [c for c in part.schema.names if c not in used]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *added], [*kept, *(f.name for f in fields)])

    return run


def _cut(data: bytes | None) -> tuple:
    image = _decoded(data)
    return (None, None, None) if image is None else (image.shape[0], image.shape[1], npy_tiles(image))


_SHAPE = [pa.field("height", pa.int64()), pa.field("width", pa.int64()), pa.field("tiles", pa.list_(pa.binary()))]
_DIGESTS = [
    pa.field("payload_bytes", pa.int64()), pa.field("payload_sha256", pa.string()), pa.field("tail_crc32", pa.int64()), pa.field("media_bytes", pa.int64()),
    pa.field("media_sha256", pa.string()), pa.field("feature", pa.string()), pa.field("n_tiles", pa.int64()), pa.field("tiles_sha256", pa.string()),
]


def _without(rows: DataFrame, image: str, names: list[str]) -> DataFrame:
    """The rows without columns of names that an operator gives to its own."""
    if image in names:
        raise ValueError(f"an image column may not be called {image}")
    return rows.drop(*names)


def store_images(images: DataFrame, image: str = "media") -> DataFrame:
    """The rows with height, width and `tiles`, the NPY files of the decoded image, as a table in the shared folder, read back.

    All columns stay, the encoded image among them; those of the names height, width and tiles are replaced. An image
    that is null, has no pixel or cannot be decoded has no tiles.
    """
    images = _without(images, image, [f.name for f in _SHAPE])
    kinds = StructType([*images.schema, StructField("height", LongType()), StructField("width", LongType()), StructField("tiles", ArrayType(BinaryType()))])
    cut = images.mapInArrow(_extended(image, [], _SHAPE, _cut), kinds)
    return stored(cut, "media", compression="zstd", **{"parquet.block.size": ROW_GROUP})


def tile_rows(kept: DataFrame, image: str = "media", tile: int = TILE) -> DataFrame:
    """One row per NPY tile of a table of `store_images`, without the encoded image: tile (number from 0), top, left, npy."""
    across = F.ceil(F.col("width") / tile)
    return (
        _without(kept, image, ["tile", "npy", "top", "left"]).drop(image).select("*", F.posexplode("tiles").alias("tile", "npy")).drop("tiles")
        .withColumn("top", (F.floor(F.col("tile") / across) * tile).cast("long")).withColumn("left", (F.col("tile") % across * tile).cast("long"))
    )


def _digests(data: bytes | None, tiles: list[bytes] | None) -> tuple:
    image = _decoded(data)
    if image is None or tiles is None:
        return (None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, None)
    payload, files = image.tobytes(), hashlib.sha256()
    for file in tiles:
        files.update(file)
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(),
        difference_hash(image), len(tiles), files.hexdigest(),
    )


def describe(kept: DataFrame, image: str = "media") -> DataFrame:
    """Digests of a table of `store_images`, from the encoded images and tiles that it holds; its other columns come first.

    feature is the difference hash, tiles_sha256 the digest of all NPY tiles in order.
    """
    kept = _without(kept, image, [f.name for f in _DIGESTS])
    others = list(kept.drop(image, "tiles", "height", "width").schema)
    kinds = StructType(others + [StructField(f.name, LongType() if f.type == pa.int64() else StringType()) for f in _DIGESTS])
    given = kept.select(*(f.name for f in others), image, "tiles")
    return given.mapInArrow(_extended(image, [image, "tiles"], _DIGESTS, lambda data, _, tiles: _digests(data, tiles)), kinds)


def store_texts(docs: DataFrame, container: str = "netpbm") -> DataFrame:
    """One row per document, of what was stored and read back: doc_id, n_bytes and the columns of `describe`."""
    return describe(store_images(text_images(docs, container)))
