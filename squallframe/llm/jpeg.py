"""Texts as baseline JPEG media: a writer of flat-block images and a reader of DC-only luminance thumbnails."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import table

#: Payloads are filled with bytes 255 up to a positive multiple of this; a row of an image has 24 blocks.
UNIT, ACROSS = 576, 24
#: Blocks of one image: the largest multiple of UNIT whose image is at most 65,535 lines high. Longer payloads
#: become several images, one after the other.
PER_IMAGE = 65535 // 8 * ACROSS // UNIT * UNIT
MARKER = {"soi": 0xD8, "eoi": 0xD9, "sos": 0xDA, "dqt": 0xDB, "sof0": 0xC0, "dht": 0xC4, "dri": 0xDD}  # fixed values of the format


def _segment(marker: str, body: bytes) -> bytes:
    return bytes([0xFF, MARKER[marker]]) + struct.pack(">H", len(body) + 2) + body


# Fixed values of the format: code lengths and categories of the usual table of luminance DC differences.
DC_COUNTS, DC_CATEGORIES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], bytes(range(12))
#: The only AC code: a block ends at once.
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, b"\x00"


def canonical_codes(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol: shorter codes first, counting up."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _block_bits() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: the bits of a flat block (category, difference, end), and how many there are."""
    dc, (end, end_bits) = canonical_codes(DC_COUNTS, DC_CATEGORIES), canonical_codes(AC_COUNTS, AC_SYMBOLS)[0]
    said = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        said.append((((code << size | (d if d >= 0 else d + (1 << size) - 1)) << end_bits) | end, n + size + end_bits))
    width = max(n for _, n in said)
    return np.array([[v >> (n - 1 - k) & 1 if k < n else 0 for k in range(width)] for v, n in said], np.uint8), np.array([n for _, n in said])


BLOCK_BITS, BLOCK_LENGTHS = _block_bits()


def encode_image(samples: np.ndarray) -> bytes:
    """A greyscale JPEG whose 8 x 8 blocks are flat and, from left to right and top to bottom, as light as the samples.

    A row of blocks is a restart interval: its bits are filled with ones to whole bytes, and differences begin anew.
    """
    rows = samples.astype(np.int16).reshape(-1, ACROSS) - 128
    diffs = np.diff(rows, axis=1, prepend=np.int16(0)) + 255
    lengths = BLOCK_LENGTHS[diffs]
    fill = -lengths.sum(axis=1) % 8
    width = BLOCK_BITS.shape[1]
    bits = np.concatenate([BLOCK_BITS[diffs].reshape(len(rows), -1), np.ones((len(rows), 7), np.uint8)], axis=1)
    used = np.concatenate([(np.arange(width) < lengths[..., None]).reshape(len(rows), -1), np.arange(7) < fill[:, None]], axis=1)
    scan, ends = np.packbits(bits[used]), np.cumsum((lengths.sum(axis=1) + fill) // 8)[:-1]
    stuffed = np.flatnonzero(scan == 255) + 1
    restarts = np.repeat(ends, 2)
    marks = np.stack([np.full(len(ends), 255), 0xD0 + np.arange(len(ends)) % 8], axis=1).ravel()
    # a stuffed byte comes before the marker that follows it
    scan = np.insert(scan, np.concatenate([stuffed, restarts]), np.concatenate([np.zeros(len(stuffed), np.int64), marks]))
    return b"".join([
        bytes([0xFF, MARKER["soi"]]),
        _segment("dqt", bytes([0]) + bytes([8] * 64)),
        _segment("sof0", struct.pack(">BHHBBBB", 8, len(rows) * 8, ACROSS * 8, 1, 1, 0x11, 0)),
        _segment("dht", bytes([0x00, *DC_COUNTS]) + DC_CATEGORIES),
        _segment("dht", bytes([0x10, *AC_COUNTS]) + AC_SYMBOLS),
        _segment("dri", struct.pack(">H", ACROSS)),
        _segment("sos", bytes([1, 1, 0x00, 0, 63, 0])),
        scan.astype(np.uint8).tobytes(),
        bytes([0xFF, MARKER["eoi"]]),
    ])


def encode_payload(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(encode_image(samples[k : k + PER_IMAGE]) for k in range(0, len(samples), PER_IMAGE))


def parse_markers(data: bytes, at: int) -> tuple[dict, int]:
    """Tables, frame and scan of the baseline image that starts at a byte, and where the image ends.

    Only what a baseline image with one interleaved scan needs; other frame types raise a ValueError.
    """
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError(f"no JPEG image at byte {at}")
    image: dict = {"quant": {}, "dc": {}, "ac": {}, "restart": 0}
    at += 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == MARKER["dqt"]:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                image["quant"][which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == MARKER["dht"]:
            while body:
                kind, which, counts = ("ac" if body[0] >> 4 else "dc"), body[0] & 15, list(body[1:17])
                symbols = body[17 : 17 + sum(counts)]
                image[kind][which] = (tuple(counts), bytes(symbols))
                body = body[17 + sum(counts) :]
        elif marker == MARKER["sof0"]:
            depth, high, wide, n = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            image |= {"depth": depth, "high": high, "wide": wide, "parts": parts}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == MARKER["dri"]:
            image["restart"] = struct.unpack(">H", body)[0]
        elif marker == MARKER["sos"]:
            image["scan_parts"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
    start = at
    while True:  # the scan ends at the first marker that isn't a stuffed byte or a restart
        at = data.index(b"\xff", at)
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            break
        at += 2
    image["scan"] = data[start:at]
    if data[at + 1] != MARKER["eoi"]:
        raise ValueError("more than one scan")
    return image, at + 2


@lru_cache(maxsize=64)
def code_table(counts: tuple[int, ...], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the symbol of the code that they begin with, and its length (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, bits) in canonical_codes(counts, symbols).items():
        low = code << (16 - bits)
        symbol[low : low + (1 << (16 - bits))], length[low : low + (1 << (16 - bits))] = s, bits
    return symbol, length


def _unstuffed_bits(scan: bytes) -> np.ndarray:
    raw = np.frombuffer(scan, np.uint8)
    after = np.flatnonzero(raw[:-1] == 255) + 1
    return np.unpackbits(np.delete(raw, after[raw[after] == 0]) if len(after) else raw)


def _levels_of_intervals(image: dict) -> np.ndarray | None:
    """DC levels of a one-part image in restart intervals, all of which are decoded side by side; null if it has AC codes.

    Each step reads one block of every interval: its DC code, the difference's bits, and the code that ends it.
    """
    parts, every = image["parts"], image["restart"]
    down, across = -(-image["high"] // 8), -(-image["wide"] // 8)
    if len(parts) != 1 or not every or down * across % every:
        return None
    (symbol, length), (ac_symbol, ac_length) = (code_table(*image[kind][i]) for kind, i in zip(("dc", "ac"), image["scan_parts"][parts[0][0]], strict=True))
    raw = np.frombuffer(image["scan"], np.uint8)
    after = np.flatnonzero(raw[:-1] == 255) + 1
    stuffed, restarts = after[raw[after] == 0], after[raw[after] != 0]
    gone = np.zeros(len(raw), bool)
    gone[stuffed] = gone[restarts] = gone[restarts - 1] = True
    first = np.concatenate([[0], restarts + 1])
    at = (first - np.cumsum(gone)[first] + gone[first]) * 8
    if len(at) != down * across // every:
        return None
    kept = np.concatenate([raw[~gone], np.full(8, 255, np.uint8)]).astype(np.int64)
    wide = kept[:-6] << 48
    for k in range(1, 7):
        wide |= kept[k : len(kept) - 6 + k] << (48 - 8 * k)
    taken = length + symbol  # bits of a DC code and of the difference that follows it
    windows = np.empty((every, len(at)), np.int64)  # the 48 bits from each block's start on
    for k in range(every):
        w = windows[k] = wide[np.minimum(at >> 3, len(wide) - 1)] >> (8 - (at & 7))
        t = taken[(w >> 32) & 0xFFFF]
        at = at + t + ac_length[(w >> (32 - t)) & 0xFFFF]
    codes = (windows >> 32) & 0xFFFF
    size = symbol[codes]
    ends = (windows >> (32 - taken[codes])) & 0xFFFF
    if (ac_symbol[ends] != 0).any() or (ac_length[ends] == 0).any():
        return None
    value = (windows >> (48 - taken[codes])) & ((1 << size) - 1)
    diffs = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value).T
    return np.cumsum(diffs, axis=1).reshape(down, across)


def _levels_general(image: dict) -> np.ndarray:
    """DC levels of the first part's blocks (its rows of blocks, padded to whole MCUs), symbol by symbol."""
    parts = image["parts"]
    h_max, v_max = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-image["wide"] // (8 * h_max)), -(-image["high"] // (8 * v_max))
    order = [(k, p) for k, p in enumerate(parts) for _ in range(p[1] * p[2])] if len(parts) > 1 else [(0, parts[0])]
    if len(parts) == 1:
        across, down = -(-image["wide"] // 8), -(-image["high"] // 8)
    h, v = (parts[0][1], parts[0][2]) if len(parts) > 1 else (1, 1)
    tables = {k: tuple(code_table(*image[kind][i]) for kind, i in zip(("dc", "ac"), image["scan_parts"][p[0]], strict=True)) for k, p in enumerate(parts)}
    runs, last = [], 0
    scan = image["scan"]
    for at in range(len(scan) - 1):
        if scan[at] == 0xFF and 0xD0 <= scan[at + 1] <= 0xD7:
            runs.append(scan[last:at])
            last = at + 2
    runs.append(scan[last:])
    levels = np.zeros((down * v, across * h), np.int64)
    mcu, total = 0, across * down
    for run in runs:
        bits = _unstuffed_bits(run)
        text = np.concatenate([bits, np.ones(64, np.uint8)])
        window = np.zeros(len(bits) + 48, np.int64)
        for k in range(16):
            window |= text[k : k + len(window)].astype(np.int64) << (15 - k)
        at, before = 0, [0] * len(parts)
        for _ in range(image["restart"] or total):
            if mcu >= total:
                break
            inside = 0
            for k, _part in order:
                (symbol, length), (ac_symbol, ac_length) = tables[k]
                size = int(symbol[window[at]])
                at += int(length[window[at]])
                raw = int(window[at]) >> (16 - size) if size else 0
                at += size
                before[k] += raw - (1 << size) + 1 if size and raw < 1 << (size - 1) else raw
                if k == 0:
                    levels[mcu // across * v + inside // h, mcu % across * h + inside % h] = before[0]
                    inside += 1
                place = 1
                while place < 64:
                    code = int(ac_symbol[window[at]])
                    at += int(ac_length[window[at]]) + (code & 15)
                    if code == 0:
                        break
                    place += (code >> 4) + 1
            mcu += 1
    return levels[: -(-image["high"] // 8), : -(-image["wide"] // 8)] if h == h_max and v == v_max or len(parts) == 1 else levels


def thumbnail(image: dict) -> np.ndarray:
    """The mean luminance of each 8 x 8 block, from DC levels alone."""
    levels = _levels_of_intervals(image)
    levels = _levels_general(image) if levels is None else levels
    step = int(image["quant"][image["parts"][0][3]][0])
    return np.clip(np.round(levels * step / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than the grid's mean."""
    edges = [np.unique(np.linspace(0, n, min(8, n) + 1).astype(np.int64))[:-1] for n in thumb.shape]
    grid = np.add.reduceat(np.add.reduceat(thumb.astype(np.float64), edges[0], axis=0), edges[1], axis=1)
    cells = [np.diff(np.append(e, n)) for e, n in zip(edges, thumb.shape, strict=True)]
    means = (grid / np.outer(*cells)).ravel()
    bits = (means > means.mean()).astype(np.uint8)
    return np.packbits(np.append(bits, np.zeros(64 - len(bits), np.uint8))).tobytes().hex()


def media_features(media: bytes) -> tuple[bytes, str]:
    """The payload that media hold, and dimensions and hash of each image's thumbnail."""
    at, samples, said = 0, [], []
    while at < len(media):
        image, at = parse_markers(media, at)
        thumb = thumbnail(image)
        samples.append(thumb.tobytes())
        said.append(f"{image['wide']}x{image['high']}:{average_hash(thumb)}")
    return b"".join(samples), ";".join(said)


def with_media(df: DataFrame, text_col: str, media_col: str = "media") -> DataFrame:
    """Add the JPEG media of each text, and its number of UTF-8 bytes as n_bytes. Columns of these names are replaced."""
    keep = [c for c in df.columns if c not in (media_col, "n_bytes")]
    source = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                raw = [x.as_py().encode() for x in part.column("__text")]
                media = [encode_payload(x + b"\xff" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in raw]
                columns = [part.column(c) for c in keep] + [pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", media_col])

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(encode, f"{schema}, n_bytes long, `{media_col}` binary")


def describe_media(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """Decode media to payloads and add payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null media give nulls; media that aren't baseline JPEG images raise an error.
    """
    added = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        payload, feature = media_features(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(media_col)]
            columns = list(zip(*rows, strict=True)) or [()] * len(added)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(list(c), f.type) for c, f in zip(columns, added, strict=True)], names=[*keep, *added.names])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    said = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(*keep, media_col).mapInArrow(decode, f"{schema}, {said}")


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as JPEG media, read the media back and describe them.

    The payload's bytes are the luminances of flat blocks, so the DC-only thumbnail is the payload, byte for byte.

    Edge cases: null and empty texts store one unit of fill bytes; very long texts become several images of at
    most PER_IMAGE bytes; equal texts get equal values, so ties and repeated rows are described alike; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    media = with_media(chosen, "__t").drop("__t")
    return describe_media(media, "media", ["__id", "n_bytes"]).withColumnRenamed("__id", id_col)


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
