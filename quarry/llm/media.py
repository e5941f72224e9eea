"""Media columns: baseline JPEG with a vectorised Huffman coder and DC-only thumbnails.

A payload byte is the luminance of one 8x8 block: its DC coefficient, quantised
by 8, is exactly byte - 128, and all AC coefficients are zero. The DC-only
thumbnail of such an image, an eighth of its width and height, is the payload
itself, so storage is lossless and any baseline decoder can show the image.
Rows are 192 blocks, and each run of 192 blocks ends with a restart marker:
the decoder steps through all restart intervals of a batch of images at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import flat_bytes, slices, stored, texts

UNIT = 192
#: Frames are at most this many blocks wide and high (65,535 pixels by the format); longer payloads take several frames.
MAX_WIDE, MAX_HIGH = 42, 8191
#: Code lengths of the DC categories 0 to 8. Fixed for all images: neighbouring letters of text mostly differ by 4 to 31.
DC_LENGTHS = {4: 2, 5: 2, 3: 3, 6: 3, 2: 4, 7: 4, 0: 5, 1: 5, 8: 6}
ZIGZAG_DC_STEP = 8


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Counts by length, symbols, and {symbol: (code, length)} of the canonical Huffman code."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s] = (code, last := lengths[s])
        code += 1
    return counts, bytes(order), codes


_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = _canonical(DC_LENGTHS)
_AC_COUNTS, _AC_SYMBOLS, _AC_CODES = _canonical({0: 1})  # end of block alone


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a whole block, by DC difference + 255: category, amplitude, end of block."""
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        code, n = _DC_CODES[cat]
        amplitude = diff if diff >= 0 else diff + (1 << cat) - 1
        eob, k = _AC_CODES[0]
        bits[diff + 255], size[diff + 255] = ((code << cat | amplitude) << k) | eob, n + cat + k
    return bits, size


_BITS, _SIZE = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(wide: int, high: int, restart: int) -> bytes:
    """All segments before the entropy-coded data, for wide x high blocks."""
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + _segment(0xDB, b"\0" + bytes([ZIGZAG_DC_STEP] + [1] * 63))
        + _segment(0xC0, b"\x08" + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + b"\x01\x01\x11\0")
        + _segment(0xC4, b"\0" + _DC_COUNTS + _DC_SYMBOLS)
        + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS)
        + _segment(0xDD, restart.to_bytes(2, "big"))
        + _segment(0xDA, b"\x01\x01\0\0\x3f\0")
    )


def _frames(units: int) -> list[tuple[int, int]]:
    """(blocks wide / 192, blocks high) of the frames that hold so many rows of 192."""
    out = []
    while units:
        if units <= MAX_HIGH:
            out.append((1, units))
            break
        wide = min(MAX_WIDE, -(-units // MAX_HIGH))
        high = min(MAX_HIGH, units // wide)
        out.append((wide, high))
        units -= wide * high
    return out


def encode_images(payload: np.ndarray, units: np.ndarray) -> list[bytes]:
    """JPEG bytes of consecutive payloads of units[i] * 192 bytes."""
    rows = payload.reshape(-1, UNIT).astype(np.int16)
    diff = np.empty_like(rows)
    diff[:, 0] = rows[:, 0] - 128
    np.subtract(rows[:, 1:], rows[:, :-1], out=diff[:, 1:])
    diff += 255
    size = _SIZE[diff]
    end = np.cumsum(size, axis=1)
    n_bytes = (end[:, -1] + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    total = int(n_bytes.sum())
    bit = end - size + 8 * first[:, None]
    window = _BITS[diff] << (32 - (bit & 7) - size)
    sums = np.bincount((bit >> 3).ravel(), weights=window.ravel().astype(np.float64), minlength=total).astype(np.int64)
    out = sums >> 24
    for k, shift in ((1, 16), (2, 8), (3, 0)):  # a block's code may reach into the next three bytes
        out[k:] += (sums[:-k] >> shift) & 255 if total > k else 0
    pad = (8 * n_bytes - end[:, -1]).astype(np.int64)
    out[first + n_bytes - 1] += (1 << pad) - 1
    out = out.astype(np.uint8)
    # A zero follows each 0xFF of the data; a restart marker follows each row but a frame's last.
    stuffed = out == 0xFF
    row_of_end = first + n_bytes
    frames = [f for u in units.tolist() for f in _frames(u)]
    frame_units = np.asarray([w * h for w, h in frames], np.int64)
    last = np.zeros(len(rows), bool)
    last[np.cumsum(frame_units) - 1] = True
    number = np.arange(len(rows)) - np.repeat(np.cumsum(frame_units) - frame_units, frame_units)
    extra = stuffed.astype(np.int64)
    extra[row_of_end - 1] += np.where(last, 0, 2)
    at = np.arange(total) + np.cumsum(extra) - extra
    length = total + int(extra.sum())
    data = np.zeros(length, np.uint8)
    data[at] = out
    marker = np.flatnonzero(~last)
    where = at[row_of_end[marker] - 1] + 1 + stuffed[row_of_end[marker] - 1]
    data[where] = 0xFF
    data[where + 1] = 0xD0 + number[marker] % 8
    raw = data.tobytes()
    ends = np.append(at, length)[row_of_end]  # where the data of a row ends, markers included
    images, unit, begin = [], 0, 0
    k = 0
    for u in units.tolist():
        parts, until = [], unit + u
        while unit < until:
            wide, high = frames[k]
            k += 1
            unit += wide * high
            stop = int(ends[unit - 1])
            parts.append(_header(wide * UNIT, high, UNIT) + raw[begin:stop] + b"\xff\xd9")
            begin = stop
        images.append(b"".join(parts))
    return images


class Frame:
    """What the markers of one frame say of its luminance, and where that scan lies."""

    __slots__ = ("width", "height", "step", "restart", "tables", "pattern", "across", "down", "begin", "end")

    @property
    def units(self) -> int:
        """Coding units of the scan: the blocks that repeat in pattern."""
        return -(-self.width // (8 * self.across)) * -(-self.height // (8 * self.down))


def _marker(image: bytes, at: int) -> int:
    """Where the marker code at or behind fill bytes stands."""
    if image[at] != 0xFF:
        raise ValueError("no marker where one must be")
    while image[at] == 0xFF:
        at += 1
    return at


def parse_frames(image: bytes) -> list[Frame]:
    """Frames of consecutive baseline JPEG images of 8 bits, with one component or several.

    The first component is the luminance. Several may be interleaved in one
    scan, or each have its own; other scans are passed over. Broken bytes raise
    ValueError, IndexError or KeyError.
    """
    frames, at = [], 0
    while at < len(image):
        if image[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        frame, quant, tables, found = Frame(), {}, {}, {}
        frame.restart = 0
        done = False
        while True:
            at = _marker(image, at)
            marker = image[at]
            if marker == 0xD9:
                at += 1
                break
            size = int.from_bytes(image[at + 1 : at + 3], "big")
            body = image[at + 3 : at + 1 + size]
            if size < 2 or len(body) != size - 2:
                raise ValueError("a segment is cut off")
            at += 1 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("only images of 8 bits")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(body[5])]
                found = {c[0]: (c[1] >> 4, c[1] & 15, c[2]) for c in parts}
                first = parts[0][0]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
                begin = at
                while True:  # the scan ends at the first marker that isn't a restart or a stuffed byte
                    at = image.index(b"\xff", at)
                    if image[at + 1] == 0 or 0xD0 <= image[at + 1] <= 0xD7:
                        at += 2
                    else:
                        break
                if first not in [c for c, _ in scan]:
                    continue
                alone = len(scan) == 1
                frame.pattern, chosen = [], []
                for k, (c, t) in enumerate(scan):
                    across, down, _ = found[c]
                    frame.pattern += [(k, c == first)] * (1 if alone else across * down)
                    chosen.append((tables[t >> 4], tables[0x10 | t & 15]))
                most = (1, 1) if alone else (max(h for h, _, _ in found.values()), max(v for _, v, _ in found.values()))
                if not alone and found[first][:2] != most:
                    raise ValueError("luminance that is coarser than another component")
                frame.across, frame.down = most
                frame.tables, frame.pattern = tuple(chosen), tuple(frame.pattern)
                frame.step, frame.begin, frame.end = quant[found[first][2]], begin, at
                done = True
        if not done or not frame.width or not frame.height:
            raise ValueError("no scan of the luminance")
        frames.append(frame)
    return frames


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where there is no code."""
    symbol, length, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            low, high = code << (16 - n), (code + 1) << (16 - n)
            symbol[low:high], length[low:high] = table[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def decode_dc(images: list[bytes]) -> list[list[np.ndarray]]:
    """DC-only luminance thumbnails (height/8 x width/8) of each frame of each image. Broken bytes raise.

    Restart intervals of all frames with the same tables and the same pattern
    of components are decoded in step; AC coefficients are read and passed over.
    """
    out: list[list] = []
    groups: dict[tuple, list] = {}
    for i, image in enumerate(images):
        frames = parse_frames(image)
        out.append([None] * len(frames))
        for k, f in enumerate(frames):
            groups.setdefault((f.tables, f.pattern), []).append((i, k, f))
    for (tables, pattern), members in groups.items():
        lookups = [(_lookup(dc), _lookup(ac)) for dc, ac in tables]
        data = np.frombuffer(b"".join(images[i][f.begin : f.end] + b"\xff\xd0" for i, k, f in members) + bytes(8), np.uint8)
        ff = np.flatnonzero(data[:-1] == 0xFF)
        marks = ff[data[ff + 1] != 0]
        drop = np.zeros(len(data), bool)
        drop[ff + 1] = True
        drop[marks] = True
        kept = np.cumsum(~drop) - ~drop
        clean = np.append(data[~drop], np.zeros(8, np.uint8)).astype(np.uint32)
        window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
        begin = np.append(0, kept[marks])[:-1]
        units: list[int] = []
        for _, _, f in members:
            each = f.restart or f.units
            units += [each] * (f.units // each) + ([f.units % each] if f.units % each else [])
        count = np.asarray(units, np.int64)
        if len(count) != len(begin):
            raise ValueError("restart markers are missing")
        values = _decode_intervals(window, begin, count, pattern, lookups)
        at, inner = 0, sum(own for _, own in pattern)
        for i, k, f in members:
            n = f.units * inner
            pixels, at = values[at : at + n], at + n
            wide, high = -(-f.width // (8 * f.across)), -(-f.height // (8 * f.down))
            # Blocks of a unit lie in its own rows and columns.
            raster = pixels.reshape(high, wide, f.down, f.across).transpose(0, 2, 1, 3).reshape(high * f.down, wide * f.across)
            raster = raster[: -(-f.height // 8), : -(-f.width // 8)]
            out[i][k] = np.clip((raster * f.step + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def thumbnails(images: list[bytes | None]) -> list[list[np.ndarray] | None]:
    """decode_dc for bytes of any kind: None for those that are null or no image that it reads."""
    broken = (ValueError, IndexError, KeyError)
    try:
        return decode_dc(images)
    except (*broken, TypeError):
        out: list[list[np.ndarray] | None] = []
        for image in images:
            try:
                out.append(decode_dc([image])[0] if image else None)
            except broken:
                out.append(None)
        return out


def _decode_intervals(window: np.ndarray, begin: np.ndarray, count: np.ndarray, pattern, lookups) -> np.ndarray:
    """Luminance DC coefficients of all intervals, concatenated. window: 32 bits from each byte; count: units by interval."""
    order = np.argsort(-count, kind="stable")  # lanes that end first come last
    bit = begin[order].astype(np.int64) * 8
    sizes = count[order]
    inner = sum(own for _, own in pattern)
    first = inner * (np.cumsum(count) - count)[order]
    dc_now = np.zeros((len(lookups), len(count)), np.int32)
    out = np.empty(inner * int(count.sum()), np.int32)
    ends = []
    for _, (symbol, length) in lookups:
        used = length > 0
        alone = bool((symbol[used] == 0).all()) and len(set(length[used].tolist())) == 1
        ends.append(int(length.max()) if alone else None)
    for unit in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -unit, side="left"))  # lanes with more units
        b, place = bit[:n], inner * unit
        for part, own in pattern:
            (dc_symbol, dc_length), (ac_symbol, ac_length) = lookups[part]
            head = (window[b >> 3] << (b & 7).astype(np.uint32)) >> 16
            cat, used = dc_symbol[head], dc_length[head]
            shift = cat.astype(np.uint32)
            # Up to 16 + 11 bits may follow the byte's first 7; the second look starts behind the code.
            b = b + used
            look = window[b >> 3] << (b & 7).astype(np.uint32)
            raw = ((look >> 1) >> (31 - shift)).astype(np.int32)
            half = (1 << shift.astype(np.int32)) >> 1
            dc_now[part, :n] += np.where(raw < half, raw - (1 << shift.astype(np.int32)) + 1, raw)
            b = b + cat
            if own:
                out[first[:n] + place] = dc_now[part, :n]
                place += 1
            b = b + ends[part] if ends[part] is not None else _skip_ac(window, b, ac_symbol, ac_length)
        bit[:n] = b
    return out


def _skip_ac(window: np.ndarray, bit: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bit positions behind the AC coefficients of one block in each lane."""
    bit, seen = bit.copy(), np.ones(len(bit), np.int64)
    live = np.arange(len(bit))
    while len(live):
        b = bit[live]
        head = (window[b >> 3] << (b & 7).astype(np.uint32)) >> 16
        s = symbol[head].astype(np.int64)
        bit[live] = b + length[head] + (s & 15)
        if not length[head].all():
            raise ValueError("no such code")
        seen[live] += np.where(s == 0xF0, 16, (s >> 4) + 1)
        live = live[(s != 0) & (seen[live] < 64)]
    return bit


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64-bit difference hash: the thumbnail is averaged into 8 rows of 9 cells, neighbours are compared."""
    high, wide = pixels.shape
    rows = np.linspace(0, high, 9).astype(int)[:8].clip(max=high - 1)
    cols = np.linspace(0, wide, 10).astype(int)[:9].clip(max=wide - 1)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, axis=0), cols, axis=1)
    area = np.diff(np.append(rows, high)).clip(min=1)[:, None] * np.diff(np.append(cols, wide)).clip(min=1)
    mean = sums // area
    bits = (mean[:, 1:] > mean[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def with_media(docs: DataFrame, slice_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes and media: the JPEG of each whole text, padded by spaces to a positive multiple of 192 bytes.

    A null text is empty: 192 spaces. An empty table gives no rows; repeated
    rows and doc_ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                raw, offsets = flat_bytes(part.column("text"))
                n = np.diff(offsets)
                units = np.maximum(1, -(-n // UNIT))
                payload = np.full(int(units.sum()) * UNIT, 32, np.uint8)
                shift = (np.cumsum(units) - units) * UNIT - offsets[:-1]
                payload[np.arange(len(raw)) + np.repeat(shift, n)] = raw
                images = encode_images(payload, units)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "widths array<int>, heights array<int>, hashes array<string>"
)


def media_features(media: DataFrame, slice_bytes: int = 3 << 20) -> DataFrame:
    """Decode the stored images: payload digests, and by frame the dimensions in pixels and the thumbnail's hash. Other columns than media aren't read for them.

    A row for each that comes in. Where media is null, cut, or no baseline
    JPEG, what would need the picture is null, and of null media the rest too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", slice_bytes):
                images = part.column("media").to_pylist()
                rows = []
                for image, frames in zip(images, thumbnails(images), strict=True):
                    stored_as = (None, None) if image is None else (len(image), hashlib.sha256(image).hexdigest())
                    if frames is None:
                        rows.append((None, None, None, *stored_as, None, None, None))
                        continue
                    payload = b"".join(f.tobytes() for f in frames)
                    shape = [8 * f.shape[1] for f in frames], [8 * f.shape[0] for f in frames], [f"{thumbnail_hash(f):016x}" for f in frames]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored_as, *shape))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
                names = [x.split()[0] for x in FEATURES.split(", ")]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def media_digest(docs: DataFrame) -> DataFrame:
    """The stored form and features of each document's text: images are written as a table, features come from what is read back.

    feature has the dimensions and hashes of all frames as one string; see
    with_media for null, empty, long and repeated texts.
    """
    found = media_features(stored(with_media(docs), "media"))
    each = F.zip_with(F.arrays_zip("widths", "heights"), F.col("hashes"), lambda d, h: F.concat(d["widths"].cast("string"), F.lit("x"), d["heights"].cast("string"), F.lit(":"), h))
    return found.withColumn("feature", F.array_join(each, ";"))
