"""Media columns: MPEG transport streams.

``mux`` stores a payload losslessly as one private elementary stream: a program association table, a
program map table, and packets of 188 bytes whose elementary packets carry a time stamp.  Each
elementary packet starts with a random-access point.  ``streams`` parses the tables (over several packets
if need be) of all programs, checks sync bytes, checksums and the continuity counters of every packet
identifier, drops repeated packets, and reassembles the elementary packets of every stream, of open length
too.  ``demux`` is its first stream.  The time stamps and random-access points are stored in ``units``.

Cases: null text is the empty text; the payload has at least one unit; texts of any length are handled
whole; equal texts give equal streams, so ties and repeated rows change nothing; rows without an id are kept;
other columns, whatever their names, are never read; an empty table gives an empty result; a damaged stream
raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridgauge.llm.common import per_batch, with_text

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, PROGRAM, PRIVATE_TYPE, STREAM_ID = 188, 0x47, 0, 0x1000, 0x100, 1, 0x06, 0xBD
CLOCK, NULL_PID = 90_000, 0x1FFF
#: Payload bytes of one elementary packet, and the ticks from one to the next.
UNIT, TICKS = 48_000, 1800
PAD = 192


@lru_cache(maxsize=1)
def crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ crc_table()[c >> 24 ^ x]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + data).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def tables() -> bytes:
    pat = section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
    return table_packet(PAT_PID, pat) + table_packet(PMT_PID, pmt)


def stamp(mark: int, ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([mark << 4 | (t >> 30) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [tables()], 0
    for k, start in enumerate(range(0, len(payload), UNIT)):
        part = payload[start : start + UNIT]
        ticks = k * TICKS
        body = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, ticks) + part
        clock = bytes([0x50]) + ((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")  # random access, with a clock reference
        room = PACKET - 4 - 1 - len(clock)
        stuff = max(0, room - len(body))
        first = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, len(clock) + stuff]) + clock + b"\xff" * stuff + body[: room - stuff]
        out.append(first)
        rest = body[room - stuff :]
        n = len(rest) // 184
        made = np.empty((n, PACKET), np.uint8)
        made[:, :3] = SYNC, DATA_PID >> 8, DATA_PID & 255
        made[:, 3] = 0x10 | (counter + 1 + np.arange(n)) & 15
        made[:, 4:] = np.frombuffer(rest, np.uint8, n * 184).reshape(n, 184)
        out.append(made.tobytes())
        counter = counter + 1 + n & 15
        if last := rest[n * 184 :]:
            fill = 183 - len(last)
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, fill]) + (b"\x00" + b"\xff" * (fill - 1) if fill else b"") + last)
            counter = counter + 1 & 15
    return b"".join(out)


def sections(p: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """The sections that the packets ``p`` of one identifier carry, checksums tested, each once."""
    held, out = bytearray(), {}

    def take(done: bool) -> None:
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            said = bytes(held[:size])
            if crc32_mpeg(said):
                raise ValueError("a damaged table")
            out[said[0], said[3:5], said[6]] = said
            del held[:size]
        if done:
            held.clear()

    begun = False
    for row, at in zip(p, begins.tolist()):
        data = row[at:].tobytes()
        if row[1] & 0x40:
            if begun:
                held += data[1 : 1 + data[0]]
                take(True)
            held += data[1 + data[0] :]
            begun = True
        elif begun:
            held += data
        take(False)
    return list(out.values())


def streams(media: bytes) -> list[dict]:
    """All elementary streams by program and place in its map: ``program``, ``pid``, ``type``, ``payload`` and ``units``.

    A unit is an elementary packet: time stamp (or none), payload offset, byte of its packet, random access.
    """
    if len(media) % PACKET or not media:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise ValueError("a packet without sync or with an error mark")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    begins = np.where(control >= 2, 5 + p[:, 4].astype(np.int64), 4)
    if (begins > PACKET).any():
        raise ValueError("an adaptation field beyond its packet")
    of: dict[int, np.ndarray] = {}
    for x in np.unique(pid[pid != NULL_PID]).tolist():
        own = np.flatnonzero((pid == x) & (control & 1).astype(bool))
        step = np.diff((p[own, 3] & 15).astype(np.int64)) % 16
        again = np.flatnonzero(step == 0) + 1
        if len(again):  # a packet may come twice
            if (p[own[again], 4:] != p[own[again - 1], 4:]).any() or (np.diff(again) == 1).any():
                raise ValueError("a packet is lost or repeated")
            own = np.delete(own, again)
            step = np.diff((p[own, 3] & 15).astype(np.int64)) % 16
        jumps = np.flatnonzero(step != 1) + 1
        told = (control[own[jumps]] >= 2) & (p[own[jumps], 4] > 0) & (p[own[jumps], 5] & 0x80 > 0)  # a break that the stream announces
        if not told.all():
            raise ValueError("a packet is lost or repeated")
        of[x] = own
    none = np.zeros(0, np.int64)
    out = []
    pat = sections(p[of.get(PAT_PID, none)], begins[of.get(PAT_PID, none)])
    if not pat:
        raise ValueError("no program table")
    for table in pat:
        for k in range(8, len(table) - 4, 4):
            program, pmt_pid = table[k] << 8 | table[k + 1], (table[k + 2] & 31) << 8 | table[k + 3]
            if not program:
                continue
            own = of.get(pmt_pid, none)
            maps = [x for x in sections(p[own], begins[own]) if x[0] == 2 and x[3] << 8 | x[4] == program]
            if not maps:
                raise ValueError("a program without a map")
            pmt = maps[-1][8:-4]
            at = 4 + ((pmt[2] & 15) << 8 | pmt[3])
            while at + 5 <= len(pmt):
                stream = (pmt[at + 1] & 31) << 8 | pmt[at + 2]
                own = of.get(stream, none)
                payload, units = elementary(p[own], control[own], begins[own], own)
                out.append({"program": program, "pid": stream, "type": pmt[at], "payload": payload, "units": units})
                at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    return out


def elementary(q: np.ndarray, control: np.ndarray, begins: np.ndarray, own: np.ndarray) -> tuple[bytes, list[dict]]:
    """Payload and units of one stream's packets."""
    starts = np.flatnonzero(q[:, 1] & 0x40)
    if len(q) and (not len(starts) or starts[0]):
        raise ValueError("an elementary packet without its beginning")
    payload, units, size = [], [], 0
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(q)]):
        odd = np.flatnonzero(control[a:b] >= 2) + a
        body, k = bytearray(), a
        for j in odd.tolist():  # packets with an adaptation field stand between runs of plain ones
            body += q[k:j, 4:].tobytes()
            body += q[j, begins[j] :].tobytes()
            k = j + 1
        body += q[k:b, 4:].tobytes()
        said = body[4] << 8 | body[5] if len(body) >= 9 else -1
        if body[:3] != b"\x00\x00\x01" or said and said != len(body) - 6 or len(body) < 9 + body[8]:
            raise ValueError("a damaged elementary packet")
        part = bytes(body[9 + body[8] :])
        access = bool(control[a] & 2 and q[a, 4] and q[a, 5] & 0x40)
        units.append({"pts": read_stamp(body[9:14]) if body[7] & 0x80 else None, "offset": size, "packet": int(own[a]) * PACKET, "random_access": access})
        payload.append(part)
        size += len(part)
    return b"".join(payload), units


def demux(media: bytes) -> tuple[bytes, list[dict]]:
    """Payload and units of the first stream."""
    found = streams(media)
    if not found:
        raise ValueError("no stream")
    return found[0]["payload"], found[0]["units"]


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b" ")


UNITS = "array<struct<pts:long,offset:long,packet:long,random_access:boolean>>"


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (of the text, unpadded) and ``media``, its transport stream."""
    kind = dict(df.dtypes)[id_col]

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = [x.encode() for x in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

        return f

    return per_batch(with_text(df, text_col, (id_col, "id")), make, f"`{id_col}` {kind}, n_bytes long, media binary")


def from_media(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media", payload: bool = True) -> DataFrame:
    """The ``keep`` columns, ``payload`` if asked for, its digests, ``units``, and the stored form's size and digest."""
    kinds = dict(df.dtypes)

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for m in b.column(media_col).to_pylist():
                data, units = demux(m)
                counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                share = counts[counts > 0] / len(data)
                entropy = float(-(share * np.log2(share)).sum())
                feature = f"packets={len(m) // PACKET};units={len(units)};access={sum(u['random_access'] for u in units)};last_pts={units[-1]['pts']};symbols={len(share)};entropy={entropy:.4f}"
                rows.append((data, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, units))
            cols = list(zip(*rows))
            types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))]
            made = [pa.array(c, t) for c, t in zip(cols, types)][0 if payload else 1 :]
            names = ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"][0 if payload else 1 :]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, *names])

        return f

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(["payload binary"] if payload else []), f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units {UNITS}"])
    return per_batch(df.select(*keep, media_col), make, schema)
