import hashlib
import zlib

import numpy as np
import pytest

from leadloom.llm import flac, media, queries


def round_trip(samples):
    offsets = np.cumsum([0, *map(len, samples)])
    data = np.concatenate(samples).astype(np.uint8)
    streams = flac.encode(data, offsets)
    pcm, bounds, seek = flac.decode(streams)
    assert (pcm == data).all() and (bounds == offsets).all()
    return streams, seek


def test_signals_of_every_kind():
    rng = np.random.RandomState(4)
    t = np.arange(5000)
    samples = [
        np.full(64, 200),
        np.full(2048, 0),
        rng.randint(0, 256, 3000),
        128 + 100 * np.sin(t / 20),
        t % 256,
        128 + np.cumsum(rng.randint(-1, 2, 4000)).clip(-100, 100),
        rng.randint(0, 2, 1025) * 255,
        np.array([7]),
        np.array([1, 2, 3]),
        np.tile([0, 255], 700),
    ]
    streams, seek = round_trip([np.asarray(s).astype(np.uint8) for s in samples])
    assert len(streams[3]) < 0.7 * 5000  # prediction pays
    for stream, points in zip(streams, seek):
        assert (points[:, 0] == np.arange(len(points)) * flac.BLOCK).all()
        assert all(stream[b : b + 2] == b"\xff\xf8" for b in points[:, 1])


def test_streams_without_seek_table_and_many_frames():
    data = np.random.RandomState(1).randint(90, 140, 300 * flac.BLOCK + 5).astype(np.uint8)
    (stream,) = flac.encode(data, np.array([0, len(data)]))
    _, _, _, first, points = flac.parse(stream)
    assert len(points) == 301
    bare = stream[:4] + bytes([0x80]) + stream[5 : 8 + 34] + stream[first:]
    pcm, _, seek = flac.decode([bare, stream])
    assert (pcm == np.tile(data, 2)).all() and (seek[0][:, 0] == points[:, 0]).all()


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21 - 1, 2**21):
        coded = flac.utf8_number(n)
        if n < 0x110000:
            assert coded == chr(n).encode("utf-8", "surrogatepass")
        else:
            assert len(coded) == (4 if n < 2**21 else 5) and coded[0] in (0xF7, 0xF8)


def test_damage_is_found():
    data = (np.arange(4000) * 7 % 251).astype(np.uint8)
    (stream,) = flac.encode(data, np.array([0, len(data)]))
    _, _, _, first, _ = flac.parse(stream)
    for place in (first + 4, first + 5, first + 40, len(stream) - 1, 30):
        broken = bytearray(stream)
        broken[place] ^= 1
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(broken)])


def test_queries_columns(docs, empty, spark):
    stored = media.store(docs)
    rows = sorted(map(tuple, media.features(stored).collect()), key=str)
    wanted = []
    for r in docs.collect():
        body = (r["text"] or "").encode()
        payload = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        wanted.append((r["doc_id"], len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert [r[:5] for r in rows] == sorted(wanted, key=str)
    streams = {r["doc_id"]: bytes(r["media"]) for r in stored.where("doc_id is not null").collect()}
    assert all(hashlib.sha256(streams[r[0]]).hexdigest() == r[6] and len(streams[r[0]]) == r[5] for r in rows if r[0] is not None)
    blocks = media.pcm_blocks(stored.where("doc_id = 10").limit(1)).orderBy("block").collect()
    assert [b["first_sample"] for b in blocks] == [k * flac.BLOCK for k in range(len(blocks))]
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip(b"\0") == b"a" * 5000
    assert media.features(media.store(empty)).count() == 0


def test_query_writes_streams_and_pcm_blocks(spark, monkeypatch):
    stages = {}

    def written(df, name):
        stages[name] = keep(df, name)
        return stages[name]

    keep = queries.written
    monkeypatch.setattr(queries, "written", written)
    rows = {r["doc_id"]: r for r in queries.op7_flac_media(spark, "/root/testdata/sf0.001").collect()}
    streams = {r["doc_id"]: bytes(r["media"]) for r in stages["media"].collect()}
    pcm = {}
    for b in stages["pcm"].orderBy("doc_id", "block").collect():
        own = pcm.setdefault(b["doc_id"], bytearray())
        assert len(own) == b["first_sample"]
        assert streams[b["doc_id"]][b["media_offset"] :][:2] == b"\xff\xf8"
        own += b["pcm"]
    assert set(rows) == set(streams) == set(pcm)
    for k, r in rows.items():
        assert hashlib.sha256(streams[k]).hexdigest() == r["media_sha256"]
        assert hashlib.sha256(pcm[k]).hexdigest() == r["payload_sha256"]
