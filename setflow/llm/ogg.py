"""Media columns in Ogg containers.

Writing: a payload of 8-bit samples is cut into packets, packets into lacing segments, segments into pages of at most
255; each page has its granule position (samples complete at its end, -1 if no packet ends there) and checksum.
A second logical stream holds the payload's length before padding. Reading: every page's checksum and sequence
number is verified, pages are dealt to their logical streams, packets are put together from lacing values across pages,
and timestamps come from granule positions.

Ogg's checksum has the polynomial of zlib's with bits in the other order and no inversions, so bytes are reversed
by a table, zlib does the work, and the result is reversed back.

Defined results: a null text is the empty text; its payload is one block of padding. Repeated rows and equal
texts give equal media; a very long text is one payload, held by its task; an empty table gives none. Damaged media raises
``OggError``. Ids may be of any type. Columns of the input do not clash: only id and text are read.

Results are lazy, so both functions leave the session's limit on Arrow batches at 4 MB or what it was below.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_small_batches

UNIT, PACKET, RATE = 576, 16 * 576, 8000
SAMPLES, LENGTH = 1, 2  # serial numbers
HEAD = struct.Struct("<4sBBqIIIB")
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Bytes of media after which a batch goes back to Spark.
BATCH_BYTES = 8 << 20


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    state = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(state.to_bytes(4, "little").translate(REVERSED), "big")


def pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream; its first packet has a page of its own."""
    out: list[bytes] = []
    for first, last, group, ends in ((True, len(packets) == 1, packets[:1], granules[:1]), (False, True, packets[1:], granules[1:])):
        lacing = bytearray()
        done: list[tuple[int, int]] = []  # segments up to the end of each packet, and its granule
        for p, g in zip(group, ends, strict=True):
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            done.append((len(lacing), g))
        data, at, k = b"".join(group), 0, 0
        for s in range(0, len(lacing), 255):
            table = bytes(lacing[s : s + 255])
            size, granule, goes_on = sum(table), -1, s > 0 and lacing[s - 1] == 255
            while k < len(done) and done[k][0] <= s + len(table):
                granule, k = done[k][1], k + 1
            flags = goes_on | 2 * first | 4 * (last and s + 255 >= len(lacing))
            body = table + data[at : at + size]
            crc = checksum(HEAD.pack(b"OggS", 0, flags, granule, serial, len(out), 0, len(table)) + body)
            out.append(HEAD.pack(b"OggS", 0, flags, granule, serial, len(out), crc, len(table)) + body)
            at += size
    return out


def encode(data: bytes) -> bytes:
    """Pad with bytes 255 to a positive multiple of 576 and write one sample stream and one length stream."""
    payload = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\xff")
    cuts = range(0, len(payload), PACKET)
    packets = [struct.pack("<4sIBB", b"PCM8", RATE, 1, 8), *(payload[c : c + PACKET] for c in cuts)]
    sound = pages(packets, [0, *(min(c + PACKET, len(payload)) for c in cuts)], SAMPLES)
    length = pages([struct.pack("<4sQ", b"SIZE", len(data))], [0], LENGTH)
    return b"".join([sound[0], *length, *sound[1:]])  # all beginnings come first


def demultiplex(media: bytes) -> dict[int, dict]:
    """``{serial: {packets, times, pages, granule}}``; ``times`` has (packets complete, granule) per page on which one ends."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise OggError("cut off inside a page header")
        magic, version, flags, granule, serial, seq, crc, n = HEAD.unpack_from(media, at)
        table = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(table)
        if magic != b"OggS" or version or len(table) < n or end > len(media):
            raise OggError(f"no page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & 2:
                raise OggError(f"stream {serial} has no beginning")
            s = streams[serial] = {"packets": [], "times": [], "open": [], "pages": 0, "granule": 0, "ended": False}
        if seq != s["pages"] or bool(flags & 1) != bool(s["open"]) or s["ended"]:
            raise OggError(f"page {seq} of stream {serial} is missing or out of order")
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        pos = at + HEAD.size + n
        ends = np.cumsum(np.frombuffer(table, np.uint8), dtype=np.int64)
        for e in ends[np.frombuffer(table, np.uint8) < 255].tolist():
            s["packets"].append(b"".join([*s["open"], media[pos : at + HEAD.size + n + e]]))
            s["open"], pos = [], at + HEAD.size + n + e
        if n and table[-1] == 255:
            s["open"].append(media[pos:end])
        if granule >= 0:
            s["granule"] = granule
            s["times"].append((len(s["packets"]), granule))
        at = end
    for serial, s in streams.items():
        if not s["ended"] or s.pop("open"):
            raise OggError(f"stream {serial} has no end")
    return streams


def decode(media: bytes) -> tuple[bytes, int, str]:
    """Payload, its length before padding, and features, all from what was read."""
    return decode_with_stamps(media)[:3]


def decode_with_stamps(media: bytes) -> tuple[bytes, int, str, list[float]]:
    """Payload, its length before padding, features computed from what was read, and the seconds at the end of every page on which a packet of sound ends."""
    streams = demultiplex(media)
    sound, length = streams[SAMPLES], streams[LENGTH]
    magic, rate, channels, bits = struct.unpack("<4sIBB", sound["packets"][0])
    payload = b"".join(sound["packets"][1:])
    if magic != b"PCM8" or (channels, bits) != (1, 8) or sound["granule"] != len(payload):
        raise OggError("not a stream of 8-bit samples, or its granule positions do not count them")
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    features = f"seconds={sound['granule'] / rate:.3f};streams={len(streams)};pages={sound['pages'] + length['pages']};packets={len(sound['packets'])};stamps={len(sound['times'])};mean={x.mean():.4f};power={(x * x).mean():.4f};peak={int(np.abs(x).max())};crossings={crossings}"
    return payload, struct.unpack("<4sQ", length["packets"][0])[1], features, [g / rate for _, g in sound["times"]]


def _rows(schema: list[str], types: list):
    """Collect rows into batches of bounded size."""

    def pack(rows):
        held, size = [], 0
        for row, n in rows:
            held.append(row)
            size += n
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema)

    return pack


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text's bytes in an Ogg container."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:

            def rows(b=b):
                for i, t in zip(b.column(0), b.column(1), strict=True):
                    m = encode((t.as_py() or "").encode("utf-8", "surrogatepass"))
                    yield (i.as_py(), m), len(m)

            yield from _rows(["doc_id", "media"], [b.schema.field(0).type, pa.binary()])(rows())

    hold_small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """``doc_id, media, payload, n_bytes, feature, stamps``: what is found in each container, verified; ``stamps`` are seconds."""

    def run(batches):
        for b in batches:

            def rows(b=b):
                for i, m in zip(b.column(0), b.column(1), strict=True):
                    m = m.as_py()
                    payload, n, feature, stamps = decode_with_stamps(m)
                    yield (i.as_py(), m, payload, n, feature, stamps), len(m) + len(payload)

            yield from _rows(["doc_id", "media", "payload", "n_bytes", "feature", "stamps"], [b.schema.field(0).type, pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.float64())])(rows())

    hold_small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, media binary, payload binary, n_bytes long, feature string, stamps array<double>")
