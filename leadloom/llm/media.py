"""Media columns: texts held as FLAC streams, read back as PCM blocks with sample offsets.

A payload is the text in UTF-8 with bytes 0 up to a positive multiple of 64.
Null and empty texts give 64 bytes 0.  Equal texts give equal streams; repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import flac
from .blocks import column_bytes, document_blocks
from .tokens import text_blocks

PAD = 64


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)
    padded = np.maximum(PAD, -(-size // PAD) * PAD)
    bounds = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(bounds[-1]), np.uint8)
    out[np.repeat(bounds[:-1] - offsets[:-1], size) + np.arange(len(data))] = data
    return out, bounds


def store(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media, a FLAC stream of the padded text."""
    ship(docs.sparkSession)

    def work(batches):
        for rows, offsets, data in text_blocks(batches, limit=1 << 22):
            streams = flac.encode(*payloads(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def _decoded(batches, column: str = "media"):
    """Slices of a batch with streams, their samples and bounds, and the seek points of each."""
    for batch in batches:
        media = batch.column(batch.schema.get_field_index(column))
        offsets, _ = column_bytes(media)
        for a, b in document_blocks(offsets, 1 << 22):
            streams = media.slice(a, b - a).to_pylist()
            yield batch.slice(a, b - a), streams, *flac.decode(streams)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row for each block: doc_id, block, first_sample, media_offset (byte of its frame in the stream) and pcm."""
    ship(media.sparkSession)

    def work(batches):
        for rows, _, pcm, bounds, seek in _decoded(batches):
            out: list[list] = [[], [], [], [], []]
            for k, name in enumerate(rows.column(0).to_pylist()):
                own = pcm[bounds[k] : bounds[k + 1]]
                cuts = [*seek[k][:, 0].tolist(), len(own)]
                for block, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (name, block, a, int(seek[k][block, 1]), own[a:b].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "block", "first_sample", "media_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(work, "doc_id long, block int, first_sample long, media_offset long, pcm binary")


def features(media: DataFrame) -> DataFrame:
    """Digests of the decoded samples and of the stream, and a feature string of each row.

    The feature string has the frames, mean and root mean square of the
    samples, the share of sign changes, and the stream's bytes a sample.
    """
    ship(media.sparkSession)

    def work(batches):
        for rows, streams, pcm, bounds, seek in _decoded(batches):
            size = np.diff(bounds)
            x = pcm.astype(np.int64) - 128
            turn = np.zeros(len(x), np.int64)
            turn[1:] = (x[1:] >= 0) != (x[:-1] >= 0)
            turn[bounds[:-1]] = 0
            total = [np.concatenate([[0], np.cumsum(v)]) for v in (x, x * x, turn)]
            sums = [t[bounds[1:]] - t[bounds[:-1]] for t in total]
            out: list[list] = [[], [], [], [], [], []]
            for k, stream in enumerate(streams):
                own, n = pcm[bounds[k] : bounds[k + 1]].tobytes(), int(size[k])
                said = f"frames={len(seek[k])};mean={sums[0][k] / n:.4f};rms={(sums[1][k] / n) ** 0.5:.4f};turns={sums[2][k] / n:.4f};ratio={len(stream) / n:.4f}"
                for column, value in zip(out, (n, hashlib.sha256(own).hexdigest(), zlib.crc32(own[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), said)):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(v, t) for v, t in zip(out, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", F.col("n_bytes"), "media").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
