"""Baseline JPEG media columns: writing bytes as images and reading luminance thumbnails from the DC terms.

The format's unit is the quantised DC term of an 8 x 8 block: with a DC quantum of 8 the
term v - 128 is a flat block of value v, so a byte string is stored without loss
as the DC-only thumbnail of a greyscale image 64 blocks wide (a payload over 8191 rows:
several images, one after the other). Every row of blocks ends in a restart marker.

Reading parses the markers (tables, frame, scan, restart interval), and Huffman-decodes
all restart segments of a batch of images in lockstep: each numpy step decodes the next
symbol of every segment. AC terms are decoded only to be stepped over. Images with several
components and sampling factors are read too; the thumbnail is the luminance component's.

Null or empty text: the payload is 64 zero bytes. Null, damaged or not baseline media: a row without dimensions and hash.
Equal texts give equal values; repeated rows repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_ddl

ROW, MAX_ROWS = 64, 8191
#: Code lengths of the DC categories 0 to 8, and the only AC symbol, end of block, in one bit.
_DC_LENGTHS = {3: 3, 4: 3, 5: 3, 6: 3, 0: 4, 1: 4, 2: 4, 7: 4, 8: 5}


def _codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length), of (symbol, length) by length."""
    out, code, last = {}, 0, 0
    for symbol, n in lengths:
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


_DC_CODES = _codes(sorted(_DC_LENGTHS.items(), key=lambda x: x[1]))
_CODE = np.array([_DC_CODES[i][0] for i in range(9)], np.uint32)
_LENGTH = np.array([_DC_CODES[i][1] for i in range(9)], np.uint32)
_CATEGORY = np.array([abs(v).bit_length() for v in range(-255, 256)], np.uint8)
_BITS_MASK = [(np.arange(16) < n) for n in range(17)]
_MASKS = np.array(_BITS_MASK)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _table(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    return bytes([kind, *(sum(n == i for _, n in lengths) for i in range(1, 17)), *(s for s, _ in lengths)])


def _head(rows: int) -> bytes:
    dc = sorted(_DC_LENGTHS.items(), key=lambda x: x[1])
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, bytes([0, 8]) + b"\1" * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, _table(0x00, dc) + _table(0x10, [(0, 1)])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _scan(samples: np.ndarray) -> bytes:
    """Entropy-coded rows with restart markers between; samples: rows x 64."""
    rows = len(samples)
    terms = samples.astype(np.int16) - 128
    steps = np.diff(terms, axis=1, prepend=np.zeros((rows, 1), np.int16))
    category = _CATEGORY[steps + 255].astype(np.uint32)
    extra = np.where(steps < 0, steps + (1 << category) - 1, steps).astype(np.uint32)
    length = np.zeros((rows, ROW + 1), np.uint8)
    length[:, :ROW] = _LENGTH[category] + category + 1
    length[:, ROW] = -length.sum(axis=1, dtype=np.int64) % 8
    value = np.full((rows, ROW + 1), 0xFFFF, np.uint32)
    value[:, :ROW] = (_CODE[category] << category | extra) << 1 << (16 - length[:, :ROW].astype(np.uint32))
    bits = np.unpackbits(value.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    data = np.packbits(bits[_MASKS[length.ravel()]])
    ends = np.cumsum(length.sum(axis=1, dtype=np.int64)) // 8
    stuffed = data == 0xFF
    at = np.arange(len(data)) + np.cumsum(stuffed) - stuffed
    at += 2 * np.repeat(np.arange(rows), np.diff(ends, prepend=0))
    out = np.zeros(len(data) + int(stuffed.sum()) + 2 * (rows - 1), np.uint8)
    out[at] = data
    if rows > 1:
        last = ends[:-1] - 1
        marks = at[last] + 1 + stuffed[last]
        out[marks] = 0xFF
        out[marks + 1] = 0xD0 + np.arange(rows - 1) % 8
    return out.tobytes()


def write(payload: bytes) -> bytes:
    """One or more JPEG images whose DC thumbnail is the payload (a positive multiple of 64 bytes)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(_head(len(part)) + _scan(part) + b"\xff\xd9" for part in (rows[i : i + MAX_ROWS] for i in range(0, len(rows), MAX_ROWS)))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: of each component: id, horizontal, vertical sampling, number of its quantisation table.
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quanta: dict[int, int] = field(default_factory=dict)  # of the DC term
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    interval: int = 0
    data: tuple[int, int] = (0, 0)
    end: int = 0

    @property
    def layout(self) -> tuple[int, int, int, int]:
        """MCUs across and down, and the luminance component's blocks in one."""
        h, v = (1, 1) if len(self.scan) == 1 else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), *((1, 1) if len(self.scan) == 1 else self.components[self.scan[0][0]][1:3])


def markers(data: bytes, at: int = 0) -> Image:
    """Parses one image up to and with its first scan; raises ValueError if it isn't baseline."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image begins here")
    image, at = Image(), at + 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        part, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while part:
                wide = part[0] >> 4
                image.quanta[part[0] & 15] = int.from_bytes(part[1 : 2 + wide], "big")
                part = part[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            _, image.height, image.width, k = struct.unpack(">BHHB", part[:6])
            image.components = [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(k)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while part:
                k = sum(part[1:17])
                image.tables[part[0]] = part[1:17], part[17 : 17 + k]
                part = part[17 + k :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(part[:2], "big")
        elif marker == 0xDA:
            places = {c[0]: i for i, c in enumerate(image.components)}
            image.scan = [(places[part[1 + 2 * i]], part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15) for i in range(part[0])]
            break
        elif marker == 0xD9:
            raise ValueError("no scan")
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("the scan does not end")
        if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
            break
        end += 2
    if not image.width or not image.height or not image.scan:
        raise ValueError("no frame")
    image.data, image.end = (at, end), data.find(b"\xff\xd9", end) + 2 if data.find(b"\xff\xd9", end) >= 0 else len(data)
    return image


def _scan_end_fast(raw: np.ndarray) -> np.ndarray:
    """Places of restart markers in a scan."""
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    return ff[raw[ff + 1] != 0]


_luts: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lut(table: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: symbol << 5 | code length; length 0: no code."""
    if table not in _luts:
        counts, symbols = table
        lut, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                lut[code << (16 - n) : (code + 1) << (16 - n)] = symbols[k] << 5 | n
                code, k = code + 1, k + 1
            code <<= 1
        if len(_luts) > 64:
            _luts.clear()
        _luts[table] = lut
    return _luts[table]


def dc_terms(found: list[tuple[bytes, Image]]) -> list[np.ndarray | None]:
    """Quantised DC terms of the luminance component, rows x columns of blocks, of images with equal tables, scans, and restart layout."""
    first = found[0][1]
    parts, starts, counts, owner, base = [], [], [], [], 0
    across, down, lh, lv = first.layout
    for k, (data, image) in enumerate(found):
        raw = np.frombuffer(data, np.uint8)[image.data[0] : image.data[1]]
        marks = _scan_end_fast(raw) if len(raw) > 1 else np.zeros(0, np.int64)
        keep = np.ones(len(raw), bool)
        keep[marks] = keep[marks + 1] = False
        zero = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
        keep[zero] = False
        begin = np.concatenate(([0], marks + 2))
        place = np.cumsum(keep) - keep
        starts.append(base + np.append(place, int(keep.sum()))[begin])
        mcus = image.layout[0] * image.layout[1]
        step = image.interval or mcus
        n = -(-mcus // step)
        counts.append(np.minimum(step, mcus - step * np.arange(n)))
        if len(begin) != n:
            starts[-1] = np.full(n, base)
            counts[-1] = np.zeros(n, np.int64)
        owner.append(np.full(n, k))
        parts.append(raw[keep])
        base += len(parts[-1])
    data = np.concatenate([*parts, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    words = data[:-7] << np.uint64(32) | data[1:-6] << np.uint64(24) | data[2:-5] << np.uint64(16) | data[3:-4] << np.uint64(8) | data[4:-3]
    at, left, owner = np.concatenate(starts) * 8, np.concatenate(counts), np.concatenate(owner)
    bad = np.zeros(len(found), bool)
    bad[owner[left == 0]] = True
    last = len(words) - 1

    def peek(p: np.ndarray) -> np.ndarray:
        return (words[np.minimum(p >> 3, last)] >> (np.uint64(8) - (p & 7).astype(np.uint64))).astype(np.int64) & 0xFFFFFFFF

    blocks = [(i, dc, ac) for i, dc, ac in first.scan for _ in range(1 if len(first.scan) == 1 else first.components[i][1] * first.components[i][2])]
    luma = first.scan[0][0]
    per = sum(b[0] == luma for b in blocks)
    most = int(left.max(initial=0))
    out = np.zeros((len(at), most, per), np.int16)
    prediction = {i: np.zeros(len(at), np.int64) for i, _, _ in first.scan}
    uneven = bool((left != most).any())
    for mcu in range(most):
        lanes = np.flatnonzero(left > mcu) if uneven else slice(None)
        own = at[lanes]
        seen = 0
        for i, dc, ac in blocks:
            bits = peek(own)
            entry = _lut(first.tables[dc])[bits >> 16]
            n, size = entry & 31, entry >> 5
            value = (bits >> (32 - n - size)) & ((1 << size) - 1)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            own = own + n + size
            wrong = n == 0
            prediction[i][lanes] += value
            if i == luma:
                out[lanes, mcu, seen] = prediction[i][lanes]
                seen += 1
            lut = _lut(first.tables[16 + ac])
            entry = lut[peek(own) >> 16]
            own += entry & 31
            wrong |= entry & 31 == 0
            k = np.where(entry >> 5 == 0, 64, 1)
            rest = np.flatnonzero(k < 64)
            if len(rest):
                symbol = entry[rest] >> 5
                own[rest] += symbol & 15
                k[rest] += symbol >> 4
                k[rest] += 1
                rest = rest[k[rest] < 64]
                while len(rest):
                    entry = lut[peek(own[rest]) >> 16]
                    symbol = entry >> 5
                    wrong[rest] |= entry & 31 == 0
                    own[rest] += (entry & 31) + (symbol & 15)
                    k[rest] = np.where((symbol == 0) | (entry & 31 == 0), 64, k[rest] + (symbol >> 4) + 1)
                    rest = rest[k[rest] < 64]
            if wrong.any():
                bad[owner[lanes][wrong]] = True
        at[lanes] = own
    results: list[np.ndarray | None] = []
    bounds = np.searchsorted(owner, np.arange(len(found) + 1))
    for k, (_, image) in enumerate(found):
        across, down, lh, lv = image.layout
        if bad[k]:
            results.append(None)
            continue
        lanes = slice(bounds[k], bounds[k + 1])
        flat = out[lanes].reshape(-1, per)[: across * down] if not uneven else np.concatenate([out[j, : left[j]] for j in range(bounds[k], bounds[k + 1])])
        grid = flat.reshape(down, across, lv, lh).transpose(0, 2, 1, 3).reshape(down * lv, across * lh)
        results.append(grid[: -(-image.height // 8), : -(-image.width // 8)] if len(first.scan) == 1 else grid)
    return results


def thumbnails(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """Of each value its images: width, height, luminance of every block. None: not to be read."""
    groups: dict[tuple, list[tuple[int, int, bytes, Image]]] = {}
    out: list = [None] * len(media)
    for k, data in enumerate(media):
        at, images = 0, []
        try:
            while data and at < len(data):
                images.append(markers(data, at))
                if any(t not in images[-1].tables for _, dc, ac in images[-1].scan for t in (dc, 16 + ac)) or images[-1].components[images[-1].scan[0][0]][3] not in images[-1].quanta:
                    raise ValueError("a table is missing")
                at = images[-1].end
        except (ValueError, KeyError, IndexError, struct.error):
            continue
        if images:
            out[k] = [None] * len(images)
            for i, image in enumerate(images):
                key = (tuple(image.scan), tuple(image.components) if len(image.scan) > 1 else (), *(image.tables[t] for _, dc, ac in image.scan for t in (dc, 16 + ac)))
                groups.setdefault(key, []).append((k, i, data, image))
    for members in groups.values():
        for (k, i, _, image), terms in zip(members, dc_terms([(d, im) for _, _, d, im in members]), strict=True):
            if out[k] is not None and terms is None:
                out[k] = None
            elif out[k] is not None:
                quantum = image.quanta[image.components[image.scan[0][0]][3]]
                out[k][i] = image.width, image.height, np.clip((terms.astype(np.int32) * quantum + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which of 8 x 8 cells are lighter than the mean of cells."""
    r, c = (np.arange(8) * n // 8 for n in thumbnail.shape)
    sums = np.add.reduceat(np.add.reduceat(thumbnail.astype(np.int64), r, axis=0), c, axis=1)
    size = np.diff(np.append(r, thumbnail.shape[0])).clip(1)[:, None] * np.diff(np.append(c, thumbnail.shape[1])).clip(1)[None, :]
    cells = sums * 64 // size
    return np.packbits(cells > cells.mean()).tobytes().hex()


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % ROW or (0 if data else ROW))


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_and_read(docs: DataFrame) -> DataFrame:
    """Each text stored as JPEG, read back, and described: dimensions and hash of the thumbnail."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(start, 256).columns)
                sizes, stored = zip(*((n, write(p)) for n, p in map(payload, texts)), strict=True)
                rows = []
                for doc_id, n, media, images in zip(ids, sizes, stored, thumbnails(list(stored)), strict=True):
                    if images is None:
                        raise ValueError("a stored image cannot be read")
                    whole = np.concatenate([x[2] for x in images])
                    back = whole.tobytes()
                    feature = f"{images[0][0]}x{sum(x[1] for x in images)}:{average_hash(whole)}"
                    rows.append((doc_id, n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), sha256(media).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OUT.types, strict=True)], schema=OUT)

    return docs.select("doc_id", "text").mapInArrow(run, arrow_ddl(OUT))


MEDIA = pa.schema([("width", pa.int64()), ("height", pa.int64()), ("thumbnail_sha256", pa.string()), ("average_hash", pa.string())])


def describe(media: DataFrame, key: str, column: str) -> DataFrame:
    """key (an integer column), width, height, thumbnail_sha256, average_hash of a binary column of JPEG images (the first image of each)."""
    schema = pa.schema([(key, pa.int64()), *MEDIA])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys, data = (c.to_pylist() for c in batch.slice(start, 256).columns)
                rows = [(k, *((x[0][0], x[0][1], sha256(x[0][2].tobytes()).hexdigest(), average_hash(x[0][2])) if x else (None,) * 4)) for k, x in zip(keys, thumbnails(data), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.select(key, column).mapInArrow(run, arrow_ddl(schema))
