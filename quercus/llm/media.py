"""Operator 8: media columns over content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples of an 8-bit grey PNG image 64
samples wide. Each distinct image is stored once, in a tar shard in the shared folder, under its payload's SHA-256. An
index has digest, shard, offset and length of each; rows carry only that. The metadata columns (width, height, depth, n_bytes)
come from range reads of the first bytes of a member alone (`header_columns`); `features` reads whole members back and
computes digests and features.

Only digests are shuffled, never texts or images. A shard's name has its task and attempt, and the index is written before it is used: a lost executor's shards are only
garbage, and no row refers to them.

Cases: null is the empty text, whose payload is 64 zero bytes; a text of any length is one member, held whole by the task that
writes or reads it; equal texts and repeated rows share a member and all values; a null id is kept; an empty table gives no
rows and no shards; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_folder, by_rows, delete, file_system, kept, new_folder, pin_splits, small_batches, table, utf8

WIDTH = 64
#: Bytes of members after which a shard is closed.
SHARD_BYTES = 128 << 20
#: Bytes of a member that hold the image's header with its text chunk.
HEADER_BYTES = 128
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest binary, n_bytes long, shard string, offset long, length long"


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """The image of padded(data); its header says how many bytes are not padding."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """What the first bytes of an image tell."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this operator")
    w, h, depth, colour = struct.unpack(">IIBB", head[16:26])
    n = struct.unpack(">I", head[33:37])[0]
    name, _, value = head[41 : 41 + n].partition(b"\0")
    return {"width": w, "height": h, "depth": depth, "colour": colour, "n_bytes": int(value) if name == b"n_bytes" else None}


def from_png(png: bytes) -> bytes:
    """The payload: every chunk is checked."""
    head, at, packed = png_header(png), 8, []
    while at < len(png):
        n, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a broken chunk")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head["height"], WIDTH + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Features of the samples, as JSON: geometry, mean, spread, entropy in bits, and a coarse 8-cell profile."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    seen = share[share > 0]
    cells = [int(c.mean()) for c in np.array_split(x, 8)]
    mean, entropy = int(x.sum(dtype=np.int64)) / len(x), float(-(seen * np.log2(seen)).sum())
    spread = float(np.sqrt(max(0.0, float((share * np.arange(256) ** 2).sum()) - mean * mean)))
    return json.dumps({"w": WIDTH, "h": len(x) // WIDTH, "mean": round(mean, 4), "spread": round(spread, 4), "entropy": round(entropy, 4), "profile": cells})


class _Shards:
    """Writes tar shards under a folder; add() tells where a member's data lie."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = file_system(folder)
        self.out = None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            t = TaskContext.get()
            self.shard = f"shard-{t.partitionId() if t else 0:06d}-{t.attemptNumber() if t else 0}-{uuid.uuid4().hex[:8]}.tar"
            self.fs.create_dir(self.path, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.shard}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        body = data + bytes(-len(data) % 512)
        self.out.write(head)
        self.out.write(body)
        place = (self.shard, self.at + len(head), len(data))
        self.at += len(head) + len(body)
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _digest(data: bytes) -> bytes:
    """The address of a text: its payload and its length, as zero bytes may end a text."""
    return hashlib.sha256(padded(data) + struct.pack(">Q", len(data))).digest()


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the shards; (rows: id, digest, n_bytes) and the index (one row for each distinct text), kept in the shared folder.

    Texts aren't shuffled. A first pass makes the digests; the split with the smallest number owns a digest that several
    splits have; the second pass writes what its split owns, each digest once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pin_splits(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text_col)

    def digests(b: pa.RecordBatch) -> pa.RecordBatch:
        data = utf8(b.column(1))
        split = TaskContext.get().partitionId()
        return pa.record_batch([b.column(0), pa.array(map(_digest, data), pa.binary()), pa.array([split] * len(data), pa.int32())], ["id", "digest", "split"])

    rows, _ = kept(source.mapInArrow(by_rows(digests), f"id {kind}, digest binary, split int"), "media-rows")
    had = rows.groupBy("digest", "split").agg(F.lit(1).alias("one"))
    owners = rows.groupBy("digest").agg(F.min("split").alias("owner"), F.max("split").alias("other")).where("owner < other")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = had.join(owners, "digest").where("split > owner").select("digest", "split")
    _, foreign = kept(others.repartition(n, "split").sortWithinPartitions("split"), "media-foreign", partition_by="split")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = {r["digest"] for r in by_folder(foreign, "split", TaskContext.get().partitionId())}
        shards = _Shards(folder)
        for b in batches:
            out = []
            for data in utf8(b.column(1)):
                if (d := _digest(data)) not in done:
                    done.add(d)
                    out.append((d, len(data), *shards.add(f"{d.hex()}.png", to_png(data))))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["digest", "n_bytes", "shard", "offset", "length"])
        shards.close()

    index, _ = kept(source.mapInArrow(write, INDEX), "media-index")
    delete(spark, foreign)
    return rows.select("id", "digest"), index


def _read(index: DataFrame, folder: str, fn, schema: str, names: list[str], whole: bool) -> DataFrame:
    """fn(bytes) for each member, or for its header only; a shard is read by one task, from its start to its end."""
    types = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        shard, f = None, None
        for b in batches:
            out = []
            for s, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if s != shard:
                    if f is not None:
                        f.close()
                    shard, f = s, fs.open_input_file(f"{path}/{s}")
                out.append(fn(bytes(f.read_at(n if whole else min(n, HEADER_BYTES), at))))
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types.types)]
                yield pa.record_batch([b.column("digest"), b.column("n_bytes"), b.column("length"), *cols], ["digest", "n_bytes", "media_bytes", *names])
        if f is not None:
            f.close()

    # The index's own files are few and small: its rows are dealt by shard, which are of about equal bytes.
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "shard").sortWithinPartitions("shard", "offset").mapInArrow(run, f"digest binary, n_bytes long, media_bytes long, {schema}")


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """Metadata of every member from the first bytes of it alone."""

    def fn(head: bytes) -> tuple:
        h = png_header(head)
        return h["width"], h["height"], h["depth"], h["n_bytes"]

    return _read(index, folder, fn, "width long, height long, depth long, header_n_bytes long", ["width", "height", "depth", "header_n_bytes"], False).drop("media_bytes")


def features(index: DataFrame, folder: str) -> DataFrame:
    """Digests and features of every member, from its stored bytes."""

    def fn(png: bytes) -> tuple:
        payload = from_png(png)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(png).hexdigest(), feature_of(payload), len(payload)

    names = ["payload_sha256", "tail_crc32", "media_sha256", "feature", "payload_bytes"]
    return _read(index, folder, fn, "payload_sha256 string, tail_crc32 long, media_sha256 string, feature string, payload_bytes long", names, True)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media-shards")
    rows, index = store(table(spark, sf_dir, "documents"), folder)
    found = features(index, folder).drop("n_bytes").join(header_columns(index, folder).drop("n_bytes"), "digest")
    missing = F.when(F.col("media_bytes").isNull(), F.raise_error(F.lit("a row's image isn't stored: the input changed between the two passes")))
    return rows.join(found, "digest", "left").withColumn("media_bytes", F.coalesce("media_bytes", missing)).select(
        F.col("id").alias("doc_id"), F.col("header_n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth"
    )


QUERIES = {"op8_media": op8_media}
SQL: dict[str, str] = {}


def member_names(folder: str) -> list[str]:
    """All members of all shards, by the tar headers (for tests and audits)."""
    fs, path = file_system(folder)
    from pyarrow import fs as pafs

    out = []
    for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        with fs.open_input_file(info.path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
            out += t.getnames()
    return out
