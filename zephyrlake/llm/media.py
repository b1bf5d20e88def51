"""Media columns: texts and other bytes stored as MPEG transport streams, and such streams read and indexed.

A payload is cut into access units of 576 bytes (a sample a byte, at 8 kHz: 72 ms or 6,480 ticks
of 90 kHz each). A unit is one PES packet of private stream 1 with its presentation timestamp,
dealt to transport packets of 188 bytes. Every 16th unit is a random-access point: its first
packet says so and carries a clock reference, and the program tables (PAT, PMT) come before it.

`read_stream` takes any byte string: it finds sync, leaves out packets marked as faulty, puts program tables together over
packets (sections whose CRC is wrong, or that aren't in force yet, don't count), checks continuity counters (a repeat of a stream's
last packet is dropped, a jump is counted), reassembles the elementary packets of the streams that tables name, wherever in
the value the tables are, and returns units with timestamps, places and random-access flags. A unit that lost a packet, or is
shorter than it says, is marked as damaged.

Defined results: a null text is stored as an empty one; empty payloads become one unit of bytes
255; a very long text is stored whole, its timestamps modulo 2**33; a null or damaged media value gives what can be read, never an
error; an empty table gives no rows. Equal texts give equal bytes. Other columns pass through, whatever their names; `store` and
`index` replace a column of the name that they are told to write.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.llm.common import in_small_batches, read, releasing

PACKET, UNIT, TICKS, RAP_EVERY = 188, 576, 6480, 16
PAT_PID, PMT_PID, ES_PID, PRIVATE = 0, 0x1000, 0x0100, 0xBD
UNITS = "array<struct<pid:int,pts:bigint,offset:bigint,size:int,random_access:boolean,damaged:boolean>>"


@lru_cache(maxsize=256)
def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a section; 0 over a section with its own CRC."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> tuple[bytes, bytes]:
    """A packet before and after the byte with its counter."""
    return b"\x47" + (0x4000 | pid).to_bytes(2, "big"), (b"\x00" + section).ljust(PACKET - 4, b"\xff")


_TABLES = (
    _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")),
)
_START, _MORE = b"\x47" + (0x4000 | ES_PID).to_bytes(2, "big"), b"\x47" + ES_PID.to_bytes(2, "big")


def _pes(pts: int, unit: bytes) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])
    return b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + unit


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a unit."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a multiple of a unit."""
    out, counter = [], 0
    for k in range(len(payload) // UNIT):
        pts = k * TICKS & 0x1FFFFFFFF
        pes, at, field_ = _pes(pts, payload[k * UNIT : k * UNIT + UNIT]), 0, b""
        if k % RAP_EVERY == 0:
            n = k // RAP_EVERY & 15
            for head, body in _TABLES:
                out.append(head + bytes([0x10 | n]) + body)
            field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        head = _START
        while at < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            short = room - (len(pes) - at)
            if short > 0 and not field_:  # a length byte, and flags and stuffing where there is room
                field_ = b"" if short == 1 else b"\x00".ljust(short - 1, b"\xff")
                out.append(head + bytes([0x30 | counter, short - 1]) + field_ + pes[at:])
            elif field_:
                field_ = field_.ljust(len(field_) + max(0, short), b"\xff")
                out.append(head + bytes([0x30 | counter, len(field_)]) + field_ + pes[at : at + room])
            else:
                out.append(head + bytes([0x10 | counter]) + pes[at : at + room])
            at, head, field_, counter = at + room, _MORE, b"", (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. units: (pid, pts or None, offset in its stream's payload, size, random access, damaged)."""

    packets: int = 0
    errors: int = 0
    lost_sync: int = 0
    jumps: int = 0
    repeats: int = 0
    bad_sections: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int | None, int, int, bool, bool]] = field(default_factory=list)
    payload: dict[int, bytes] = field(default_factory=dict)


class _Sections:
    """Sections of one table's packets, put together over packets."""

    def __init__(self):
        self.held: bytearray | None = None

    def lose(self) -> bool:
        """Gives up what has begun; was there any?"""
        had, self.held = bool(self.held), None
        return had

    def take(self, start: bool, body: bytes) -> Iterator[bytes]:
        if start:
            after = 1 + body[0] if body else 0
            if self.held is not None:
                self.held += body[1:after]
                yield from self._whole()
            self.held = bytearray(body[after:])
        elif self.held is not None:
            self.held += body
        yield from self._whole()

    def _whole(self) -> Iterator[bytes]:
        while self.held:
            if self.held[0] == 0xFF:  # stuffing up to the packet's end
                self.held = None
            elif len(self.held) >= 3 and len(self.held) >= (end := 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)):
                yield bytes(self.held[:end])
                del self.held[:end]
            else:
                break


def _table(s: Stream, pid: int, section: bytes) -> None:
    """Takes a section of the program tables in; others are passed over."""
    if section[0] not in (0, 2) or section[0] == 0 and pid != PAT_PID or section[0] == 2 and pid not in s.programs.values():
        return
    end = len(section) - 4
    if end < 8 or crc_mpeg(section):
        s.bad_sections += 1
    elif not section[5] & 1:
        return  # not in force yet
    elif section[0] == 0:
        for i in range(8, end - 3, 4):
            number, at = int.from_bytes(section[i : i + 2], "big"), int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
            if number:
                s.programs[number] = at
    else:
        i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while i + 5 <= end:
            s.streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
            i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)


#: Stream ids whose packets have no header of their own after the length; padding is one of them.
PLAIN_IDS, PADDING = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


def _unit(pes: bytes) -> tuple[bytes, int | None, bool] | None:
    """(data, timestamp, is it shorter than it says) of an elementary packet; None for what is none."""
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 6 or pes[3] == PADDING:
        return None
    size, body, pts = int.from_bytes(pes[4:6], "big"), 6, None
    if pes[3] not in PLAIN_IDS:
        if len(pes) < 9:
            return None
        body = 9 + pes[8]
        if pes[7] & 0x80 and len(pes) >= 14:
            pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
    return pes[body : 6 + size] if size else pes[body:], pts, size > 0 and len(pes) < 6 + size


def read_stream(media: bytes | None) -> Stream:
    s, at, media = Stream(), 0, bytes(media or b"")
    last: dict[int, tuple[int, int]] = {}  # a stream's last counter, and where its packet began
    open_: dict[int, list] = {}  # parts, random access, damaged
    done: dict[int, list[tuple[bytes, int | None, bool, bool]]] = {}
    order: list[int] = []
    tables: dict[int, _Sections] = {PAT_PID: _Sections()}

    def close(pid: int) -> None:
        parts, rap, damaged = open_.pop(pid)
        if (unit := _unit(b"".join(parts))) is not None:
            order.append(pid)
            done.setdefault(pid, []).append((unit[0], unit[1], rap, damaged or unit[2]))

    while at + PACKET <= len(media):
        if media[at] != 0x47:
            s.lost_sync += 1
            at = media.find(b"\x47", at + 1)
            while 0 <= at and at + PACKET < len(media) and media[at + PACKET] != 0x47:
                at = media.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        b1, b2, b3 = media[at + 1], media[at + 2], media[at + 3]
        start, pid, counter, body, begin = b1 & 0x40, (b1 & 0x1F) << 8 | b2, b3 & 15, at + 4, at
        at = end = at + PACKET
        s.packets += 1
        if b1 & 0x80:
            s.errors += 1
            continue
        rap = False
        if b3 & 0x20:
            n = media[body]
            if n:
                rap = bool(media[body + 1] & 0x40)
                if media[body + 1] & 0x80:  # counters may jump here
                    last.pop(pid, None)
            body += 1 + n
        if pid == 0x1FFF or not b3 & 0x10 or body > end:
            continue
        if pid in last:
            was, where = last[pid]
            if was == counter and media[begin:end] == media[where : where + PACKET]:
                s.repeats += 1
                continue
            if counter != was + 1 & 15:
                s.jumps += 1
                if pid in open_:
                    open_[pid][2] = True
                if pid in tables and tables[pid].lose():
                    s.bad_sections += 1
        last[pid] = counter, begin
        if pid in tables:
            for section in tables[pid].take(bool(start), media[body:end]):
                _table(s, pid, section)
            for p in s.programs.values():
                if p not in tables:
                    tables[p] = _Sections()
                    open_.pop(p, None)
        elif start:
            if pid in open_:
                close(pid)
            open_[pid] = [[media[body:end]], rap, False]
        elif pid in open_:
            open_[pid][0].append(media[body:end])
    for pid in list(open_):
        close(pid)
    s.bad_sections += sum(t.lose() for t in tables.values())
    length, nth = dict.fromkeys(s.streams, 0), dict.fromkeys(s.streams, 0)
    for pid in order:
        if pid in s.streams:
            data, pts, rap, damaged = done[pid][nth[pid]]
            s.units.append((pid, pts, length[pid], len(data), rap, damaged))
            length[pid], nth[pid] = length[pid] + len(data), nth[pid] + 1
    s.payload = {pid: b"".join(x[0] for x in units) for pid, units in done.items() if pid in s.streams}
    return s


def feature(s: Stream) -> str:
    """The stream's features as one string."""
    stamps = [u[1] for u in s.units if u[1] is not None]
    return (
        f"mpegts packets={s.packets} programs={len(s.programs)} streams={','.join(f'{p}:{k}' for p, k in sorted(s.streams.items()))} units={len(s.units)} "
        f"random_access={sum(u[4] for u in s.units)} pts={min(stamps, default=-1)}..{max(stamps, default=-1)} jumps={s.jumps} lost_sync={s.lost_sync} bad_sections={s.bad_sections} errors={s.errors} damaged={sum(u[5] for u in s.units)}"
    )


def encode(text: str | None) -> bytes:
    return write_stream(pad((text or "").encode("utf-8", "surrogatepass")))


def store(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with media_col: each text's transport stream."""

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(encode)

    return df.withColumn(media_col, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def index(df: DataFrame, media_col: str = "media", index_col: str = "media_index") -> DataFrame:
    """df with index_col: programs, streams, units with timestamps and random-access points, and counts of faults."""
    kind = f"struct<packets:bigint,programs:map<int,int>,streams:map<int,int>,errors:bigint,jumps:bigint,repeats:bigint,lost_sync:bigint,bad_sections:bigint,units:{UNITS}>"
    names = ("pid", "pts", "offset", "size", "random_access", "damaged")

    @F.pandas_udf(kind)
    def run(media: pd.Series) -> pd.DataFrame:
        rows = []
        for m in media:
            s = read_stream(m)
            rows.append(
                (
                    s.packets, s.programs, s.streams, s.errors, s.jumps, s.repeats, s.lost_sync, s.bad_sections,
                    [dict(zip(names, u, strict=True)) for u in s.units]
                )
            )
        return pd.DataFrame(rows, columns=["packets", "programs", "streams", "errors", "jumps", "repeats", "lost_sync", "bad_sections", "units"])

    return df.withColumn(index_col, run(F.col(media_col)))


def _round_trip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.doc_id, b.text, strict=True):
            data = text.encode("utf-8", "surrogatepass") if text is not None else b""
            media = write_stream(pad(data))
            s = read_stream(media)
            back = s.payload.get(ES_PID, b"")
            rows.append(
                (
                    doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature(s)
                )
            )
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text of documents stored as a transport stream, read back and indexed; digests only, so no stream leaves its task."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return in_small_batches(read(spark, sf_dir, "documents")).select("doc_id", "text").mapInPandas(releasing(_round_trip), kind)


#: The stream by the letter of its layout: four packets a unit, the tables before every sixteenth, all in hexadecimal digits.
OP1_SQL = r"""
WITH t AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256)))),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, greatest(1, (n_bytes + 575) // 576) AS units,
    rpad(hex(encode(coalesce(text, ''))), CAST(units * 1152 AS INTEGER), 'F') AS payload FROM documents),
k AS (SELECT doc_id, CAST(unnest(range(units)) AS BIGINT) AS k, payload FROM d),
u AS (
  SELECT doc_id, k, (k * 6480) & 8589934591 AS pts, k % 16 = 0 AS rap, (4 * k) % 16 AS c, substr(payload, CAST(k * 1152 + 1 AS INTEGER), 1152) AS unit FROM k),
p AS (
  SELECT *, '000001BD0248848005' || format('{:02X}{:02X}{:02X}{:02X}{:02X}', 33 | ((pts >> 29) & 14), (pts >> 22) & 255, 1 | ((pts >> 14) & 254), (pts >> 7) & 255, 1 | ((pts << 1) & 254)) || unit AS pes,
    CASE WHEN rap THEN 176 ELSE 184 END AS room FROM u),
q AS (
  SELECT doc_id, k,
    CASE WHEN rap THEN
      '474000' || format('{:02X}', 16 | ((k // 16) & 15)) || rpad('0000B00D0001C100000001F0002AB104B2', 368, 'F') ||
      '475000' || format('{:02X}', 16 | ((k // 16) & 15)) || rpad('0002B0120001C10000E100F00006E100F000BE7FA052', 368, 'F') ||
      '474100' || format('{:02X}', 48 | c) || '0750' || format('{:012X}', (pts << 15) | 32256)
    ELSE '474100' || format('{:02X}', 16 | c) END || substr(pes, 1, 2 * room) ||
    '470100' || format('{:02X}', 16 | (c + 1)) || substr(pes, 2 * room + 1, 368) ||
    '470100' || format('{:02X}', 16 | (c + 2)) || substr(pes, 2 * room + 369, 368) ||
    '470100' || format('{:02X}', 48 | (c + 3)) || CASE WHEN rap THEN '8900' || repeat('F', 272) ELSE '9100' || repeat('F', 288) END || substr(pes, 2 * room + 737) AS packets FROM p),
m AS (SELECT doc_id, string_agg(packets, '' ORDER BY k) AS media FROM q GROUP BY doc_id),
e AS (SELECT doc_id, [CAST(4294967295 AS BIGINT)] || [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(right(payload, 64), '..')] AS tail FROM d)
SELECT d.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(units * 576 AS BIGINT) AS payload_bytes, sha256(unhex(payload)) AS payload_sha256,
  xor(list_reduce(tail, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS tail_crc32, CAST(length(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'mpegts packets=' || (4 * units + 2 * ((units + 15) // 16)) || ' programs=1 streams=256:6 units=' || units || ' random_access=' || ((units + 15) // 16) || ' pts=0..' || ((units - 1) * 6480)
    || ' jumps=0 lost_sync=0 bad_sections=0 errors=0 damaged=0' AS feature
FROM d JOIN m ON d.doc_id = m.doc_id JOIN e ON d.doc_id = e.doc_id, t
"""
