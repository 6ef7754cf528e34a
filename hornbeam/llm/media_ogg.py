"""Media columns in the Ogg container: writing, checked reading, demultiplexing and timestamps.

A page is accepted only if its checksum holds. Packets are put together from lacing values, across pages where one
continues. A page's granule position is the end of the last packet that ends on it; with one byte a sample, earlier
packets' ends follow by subtracting the lengths of those after them. Defined results for odd input: null media gives
no streams and `ok` null; bytes without a valid page give no packets and `ok` false; damaged or truncated pages are
counted in `bad_pages`, pages that a stream's numbers skip or repeat in `missing_pages`, streams without a page marked as
the last in `open_streams`, and each costs only the packets it carries a part of; `ok` is true only if all three are none
and no packet is lost. Null texts count as empty; repeated rows and null ids each give their own row; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hornbeam.llm.common import in_arrow

#: Fixed values of the Ogg format.
CAPTURE, CONTINUED, FIRST, LAST, SEGMENTS, HEADER = b"OggS", 1, 2, 4, 255, struct.Struct("<4sBBqIIIB")
#: Fixed values of our mapping: magic, sample rate, number of streams, stream index, bytes of payload.
MAGIC, HEAD = b"\x01pcm8", struct.Struct("<5sIBBQ")
RATE, PACKET, BLOCK = 8000, 4000, 64

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 0x04c11db7, most significant bit first, zero start) by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Stream:
    """One logical stream while it is written: pages come out as they fill up."""

    serial: int
    number: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: bytearray = field(default_factory=bytearray)
    granule: int = -1
    continued: bool = False

    def page(self, last: bool = False, open_packet: bool = False) -> bytes:
        flags = CONTINUED * self.continued | FIRST * (self.number == 0) | LAST * last
        head = HEADER.pack(CAPTURE, 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + self.lacing
        crc = page_crc(bytes(head + self.body))
        out = head[:22] + crc.to_bytes(4, "little") + head[26:] + self.body
        self.number, self.lacing, self.body, self.granule, self.continued = self.number + 1, bytearray(), bytearray(), -1, open_packet
        return bytes(out)

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        left = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while left:
            room = left[: SEGMENTS - len(self.lacing)]
            self.lacing += bytes(room)
            self.body += packet[at : at + sum(room)]
            at, left = at + sum(room), left[len(room) :]
            if not left:
                self.granule = granule
            if len(self.lacing) == SEGMENTS:
                yield self.page(open_packet=bool(left))


def write(payload: bytes, streams: int = 2, packet: int = PACKET, rate: int = RATE) -> bytes:
    """payload as 8-bit samples, its packets dealt in turn to so many logical streams."""
    base = zlib.crc32(payload)
    made = [Stream((base + k) & 0xFFFFFFFF) for k in range(streams)]
    out = []
    for k, s in enumerate(made):
        out += s.add(HEAD.pack(MAGIC, rate, streams, k, len(payload)), 0)
        out.append(s.page())
    ends = [0] * streams
    for n, at in enumerate(range(0, len(payload), packet)):
        piece, k = payload[at : at + packet], n % streams
        ends[k] += len(piece)
        out += made[k].add(piece, ends[k])
    out += [s.page(last=True) for s in made]
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, int] | None]:
    """(flags, granule, serial, number, lacing, offset of the body) of each valid page; None for a damaged one."""
    at = 0
    while (at := media.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(media):
            yield None
            return
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        lacing = media[at + HEADER.size : body]
        end = body + sum(lacing)
        if version == 0 and len(lacing) == n and end <= len(media) and page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) == crc:
            yield flags, granule, serial, number, lacing, body
            at = end
        else:
            yield None
            at += 1


@dataclass
class Read:
    """What a file holds: packets by serial number as (bytes, end granule or None), counts, and the damage."""

    packets: dict[int, list[tuple[bytes, int | None]]] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0
    missing_pages: int = 0
    lost_packets: int = 0
    ended: set[int] = field(default_factory=set)

    @property
    def open_streams(self) -> int:
        return len(self.packets.keys() - self.ended)

    @property
    def whole(self) -> bool:
        return bool(self.pages) and not (self.bad_pages or self.missing_pages or self.lost_packets or self.open_streams)


def read(media: bytes) -> Read:
    out, part, following = Read(), {}, {}
    for page in pages(media):
        if page is None:
            out.bad_pages += 1
            continue
        flags, granule, serial, number, lacing, at = page
        out.pages += 1
        got = out.packets.setdefault(serial, [])
        held = part.pop(serial, None)
        out.missing_pages += abs(number - following.get(serial, 0))  # a stream begins with page 0
        if number != following.get(serial, number) or bool(flags & CONTINUED) != (held is not None):
            out.lost_packets += held is not None
            held = None
        following[serial] = number + 1
        skip = bool(flags & CONTINUED) and held is None
        held, done = held or bytearray(), []
        for k, v in enumerate(lacing):
            held += media[at : at + v]
            at += v
            if v < 255:
                if skip:
                    skip, out.lost_packets = False, out.lost_packets + (number not in (0,))
                else:
                    done.append(bytes(held))
                held = bytearray()
        if lacing and lacing[-1] == 255 and not skip:
            part[serial] = held
        end: int | None = granule if granule >= 0 else None
        timed = []
        for p in reversed(done):
            timed.append((p, end))
            end = None if end is None else end - len(p)
        got += reversed(timed)
        if flags & LAST:
            out.ended.add(serial)
    out.lost_packets += len(part)
    return out


def samples(got: Read) -> tuple[bytes, float, bool]:
    """The payload in order of time and stream, the seconds of its longest stream, and whether nothing is missing."""
    placed, rate, total, whole = [], RATE, None, got.whole
    for packets in got.packets.values():
        index, at = 0, 0
        for k, (p, end) in enumerate(packets):
            if k == 0 and p[:5] == MAGIC and len(p) == HEAD.size:
                _, rate, _, index, total = HEAD.unpack(p)
            elif end is not None:
                whole &= end - len(p) == at
                placed.append((end - len(p), index, end, p))
                at = end
    placed.sort(key=lambda x: x[:2])
    data = b"".join(x[3] for x in placed)
    return data, max((x[2] for x in placed), default=0) / rate, whole and total == len(data)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def feature(got: Read, data: bytes, seconds: float) -> str:
    x = np.frombuffer(data, np.uint8)
    wave = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    return f"streams={len(got.packets)};pages={got.pages};packets={sum(map(len, got.packets.values()))};bad={got.bad_pages};seconds={seconds:.6f};mean={x.mean():.6f};deviation={x.std():.6f};crossings={crossings}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an Ogg file; a null text counts as empty."""

    def work(batches):
        for b in batches:
            made = [payload(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).transform(in_arrow, work, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Reads each file of encode_texts() back and computes what op1 returns."""

    def work(batches):
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                got = read(m)
                data, seconds, ok = samples(got)
                if not ok:
                    raise ValueError("a stored file does not read back whole")
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(got, data, seconds)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in DIGEST.split(", ")])

    return media.transform(in_arrow, work, DIGEST)


PACKETS = "id long, serial long, packet int, n_bytes long, start double, end double, ok boolean"


def packets(media: DataFrame, id_col: str = "id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """One row per packet of any column of Ogg files: stream, index, size and times in seconds (null where the page
    has no granule position). A null or unreadable file gives one row with serial null; ok tells whether all was sound."""

    def work(batches):
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = read(m or b"")
                ok = None if m is None else got.whole
                before = len(rows)
                for serial, ps in sorted(got.packets.items()):
                    for k, (p, end) in enumerate(ps):
                        head = p[:5] == MAGIC
                        rows.append((i, serial, k, len(p), None if end is None else (end - len(p) * (not head)) / rate, None if end is None else end / rate, ok))
                if len(rows) == before:
                    rows.append((i, None, None, None, None, None, ok))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], [x.split()[0] for x in PACKETS.split(", ")])

    return media.select(media[id_col].cast("long"), media[media_col].cast("binary")).transform(in_arrow, work, PACKETS)
