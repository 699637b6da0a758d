"""Ogg media columns: multiplex, verify page checksums, reassemble packets, demultiplex, time stamps.

A media value is one Ogg file in a binary column. encode_media stores a payload as unsigned 8-bit
samples in one logical stream, multiplexed with a second stream of comments; decode_media reads any
well-formed Ogg value back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_table

FRAME = 192  # samples of a frame; payloads are padded to whole frames
PACKET = 4800  # samples of a packet
RATE = 8000  # samples a second
AUDIO, NOTES = 0x41, 0x4E  # serial numbers of the two logical streams
CONTINUED, FIRST, LAST = 1, 2, 4  # header flags
HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, most significant bit first, zero start) of a page whose checksum field is zero, by zlib's bit-reversed CRC over bit-reversed bytes."""
    r = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", page_checksum(blank)) + blank[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of a logical stream from (packet, granule position at its end); packets may span pages. The first packet has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, opened = bytearray(), bytearray(), -1, 0

    def close(last: bool) -> None:
        nonlocal granule, opened
        flags = (CONTINUED if opened else 0) | (FIRST if not pages else 0) | (LAST if last else 0)
        pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))
        opened = bool(lacing) and lacing[-1] == 255
        lacing.clear()
        body.clear()
        granule = -1

    for at, (packet, end) in enumerate(packets):
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(values):
            if len(lacing) == 255:
                close(False)
            take = values[done : done + 255 - len(lacing)]
            lacing += take
            body += packet[done * 255 : done * 255 + sum(take)]
            done += len(take)
        granule = end
        if at == 0 or at == len(packets) - 1:
            close(at == len(packets) - 1)
    return pages


def mux(payload: bytes, note: bytes) -> bytes:
    """One Ogg file: payload as 8-bit samples in stream AUDIO, note in stream NOTES, first pages first, then interleaved."""
    head = b"PCM8" + struct.pack("<IIB", RATE, PACKET, 1)
    audio = [(head, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    a, n = stream_pages(AUDIO, audio), stream_pages(NOTES, [(b"NOTE", 0), (note, len(payload))])
    return b"".join([a[0], n[0], *a[1:2], *n[1:], *a[2:]])


@dataclass
class Stream:
    """A logical stream read back: whole packets, the sample position at the end of those that a page dates, and what was wrong with it: pages lost (gaps), repeated or late, whether its first page is there and whether it ended."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    repeats: int = 0
    begun: bool = False
    ended: bool = False
    next: int = 0
    first: bytes = b""
    part: bytearray | None = None


def demux(media: bytes) -> tuple[dict[int, list[Stream]], int]:
    """The logical streams by serial number, chained ones in order, and how many bytes runs or pages were unreadable.

    A page with a wrong checksum is skipped and counted; reading goes on at the next capture
    pattern. A packet that loses a page is dropped, never joined over the gap. A page that came
    before, or comes after a later one, is skipped and counted as a repeat. A first page that differs
    from the stream's own begins a chained stream of that serial; other pages behind a last page
    count as unreadable.
    """
    streams: dict[int, list[Stream]] = {}
    bad, at = 0, 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            bad += 1
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if version or end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = media.find(b"OggS", at + 4)
            if at < 0:
                break
            continue
        chain = streams.setdefault(serial, [])
        if not chain or (flags & FIRST and page != chain[-1].first):
            chain.append(Stream(begun=bool(flags & FIRST), first=page))
        s, body, at = chain[-1], at + 27 + n, end
        if number < s.next:
            s.repeats += 1
            continue
        if s.ended:
            bad += 1
            continue
        if number > s.next:
            s.gaps += number - s.next
            s.part = None
        s.next = number + 1
        s.pages += 1
        s.ended = bool(flags & LAST)
        skip = bool(flags & CONTINUED) and s.part is None  # the packet began on a page that is lost
        if not flags & CONTINUED:
            s.part = None
        for value in lacing:
            s.part = (s.part if s.part is not None else bytearray()) + media[body : body + value]
            body += value
            if value < 255:
                if not skip:
                    s.packets.append(bytes(s.part))
                    s.granules.append(None)
                s.part, skip = None, False
        if skip:  # all of the page belongs to the lost packet
            s.part = None
        if granule >= 0 and s.granules:
            s.granules[-1] = granule
    return streams, bad


@dataclass
class Audio:
    """The data packets of chained streams in a row, the start of each in seconds, the payload's length in seconds, and whether any header was missing or odd."""

    packets: list[bytes]
    times: list[float]
    seconds: float
    odd: int


def read_audio(chain: list[Stream]) -> Audio:
    """The samples of the streams of one serial. A stream whose first page is lost, whose header is short or of another kind, or whose rate is 0 is read at the usual rate and counted as odd."""
    out = Audio([], [], 0.0, 0)
    for s in chain:
        head = s.packets[0] if s.begun and s.packets else b""
        known = len(head) >= 12 and head[:4] == b"PCM8" and struct.unpack_from("<I", head, 4)[0] > 0
        rate, samples = struct.unpack_from("<II", head, 4) if known else (RATE, PACKET)
        out.odd += not known
        skip = int(s.begun)  # the header is no data
        times = packet_times(s, rate, samples, skip)
        out.packets += s.packets[skip:]
        out.times += [out.seconds + t for t in times]
        out.seconds += sum(map(len, s.packets[skip:])) / rate
    return out


def packet_times(stream: Stream, rate: int, samples: int, skip: int = 1) -> list[float]:
    """Start of each packet behind the first skip in seconds: counted back from dated packets at samples a packet (the last may be shorter), forward where none follows."""
    times: list[float | None] = [None] * len(stream.packets)
    end = None
    for i in range(len(stream.packets) - 1, skip - 1, -1):
        if stream.granules[i] is not None:
            end = stream.granules[i]
        if end is not None:
            end = max(0, end - len(stream.packets[i]))
            times[i] = end / rate
    return [(i - skip) * samples / rate if t is None else t for i, t in enumerate(times) if i >= skip]


def encode_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary media column (one of that name is replaced) from the UTF-8 text, null as empty, padded with spaces to whole frames, at least one."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            payload = raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")
            out.append(mux(payload, b"bytes=%d" % len(raw)))
        return pd.Series(out, dtype=object)

    return docs.withColumn(media, stored(F.col(text)))


def decode_media(docs: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """keep (without columns named as the outputs), and what an Ogg value holds: payload, notes, sizes, digests and a feature line.

    A null or unreadable value gives an empty payload; what could not be read, was lost, came twice or
    had an odd header or note is counted in the feature line. Repeated rows are read alike.
    """
    names = ["n_bytes", "payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["n_bytes long", "payload binary", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]
    keep = [k for k in keep if k not in names]

    def read(value: bytes | None) -> tuple:
        raw = value or b""
        streams, bad = demux(raw)
        every = [s for chain in streams.values() for s in chain]
        audio = read_audio(streams.get(AUDIO, []))
        note = dict(x.split(b"=", 1) for s in streams.get(NOTES, []) for p in s.packets[1:] for x in p.split(b";") if b"=" in x)
        stated = note.get(b"bytes", b"")
        bad += audio.odd + (not (stated.isdigit() and len(stated) <= 18)) + (not raw)
        payload = b"".join(audio.packets)
        mean = sum(payload) / max(1, len(payload))
        lost, again = sum(s.gaps for s in every), sum(s.repeats for s in every)
        feature = f"streams={len(every)} pages={sum(s.pages for s in every)} packets={len(audio.packets)} seconds={audio.seconds:.6f} last={audio.times[-1] if audio.times else 0.0:.6f} mean={mean:.6f} bad={bad} gaps={lost} repeats={again}"
        n_bytes = int(stated) if stated.isdigit() and len(stated) <= 18 else 0
        return n_bytes, payload, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([read(v) for v in batch[media]], columns=names)
            yield pd.concat([batch[keep].reset_index(drop=True), got], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + kinds)
    return docs.select(*keep, media).mapInPandas(rows, schema)


def op5_ogg(spark, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir).select("doc_id", "text")
    return decode_media(encode_media(docs), ["doc_id"]).drop("payload")
