"""Training-order materialisation: a keyed Feistel permutation gives every sequence its slot, shards hold ranges of slots."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rastertime.llm.base import materialise, ordering_key, partitions, ranges
from rastertime.llm.text import mixed

END, PAD = 256, 257  # after the 256 bytes
ROUNDS = 6

Encoder = Callable[[], Callable[[str], np.ndarray]]


def byte_encoder() -> Callable[[str], np.ndarray]:
    """Token ids that are the UTF-8 bytes."""
    return lambda text: np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)


def file_encoder(path: str) -> Encoder:
    """An encoder from a tokenizer file that every executor can open."""

    def load() -> Callable[[str], np.ndarray]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text).ids, np.uint32)

    return load


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of indexes 0 to n - 1: a bijection on 0 to n - 1 that ``key`` chooses.

    A balanced Feistel network permutes the least power of four that holds n; a value past n - 1 is permuted again
    until it falls within (cycle-walking), after four steps or fewer on average.
    """
    half = 1
    while (1 << (2 * half)) < n:
        half += 1
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = mixed(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        with np.errstate(over="ignore"):
            for k in keys:
                left, right = right, left ^ (mixed(right ^ k) & low)
        return (left << shift) | right

    x = once(np.asarray(index, np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def tokenised(docs: DataFrame, encoder: Encoder | None, key: str, text: str) -> DataFrame:
    """key, doc_id, body and n_tokens (the end mark included). Other encoders than bytes run once and are written down."""
    rows = docs.select(ordering_key(key).alias("key"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if encoder is None:
        return rows.withColumn("body", F.encode("body", "UTF-8")).withColumn("n_tokens", F.octet_length("body").cast("long") + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            yield pdf.assign(body=[encode(t).astype("<u4").tobytes() for t in pdf["body"]])

    return materialise(rows.mapInPandas(run, "key long, doc_id long, body binary")).withColumn("n_tokens", (F.octet_length("body") / 4).cast("long") + 1)


def training_order(docs: DataFrame, length: int = 1024, shard_rows: int = 4096, seed: int = 0, encoder: Encoder | None = None, end: int = END, pad: int = PAD, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per sequence: slot, shard, byte_offset in the shard, doc_id, part, n_tokens and payload.

    A document's ids and an end mark are cut into sequences of ``length`` ids, the last one padded; a payload is
    ``length`` little-endian numbers of ``width`` bytes, so slot s lies at (s mod shard_rows) * length * width of shard
    s div shard_rows. Sequences are numbered by document id (nulls first), then part, and permuted by ``seed``. A null
    or empty text is one sequence with the end mark alone; repeated rows are sequences of their own; an empty table
    gives none; other columns are not read, whatever their names; doc_id is a long, or casts to one. Rows come out in ranges of whole shards, sorted by slot, so each task writes its shards in sequence and
    a rerun writes the same bytes.
    """
    if encoder is None and width == 2 and max(end, pad) > 65535:
        raise ValueError("ids need more bytes")
    rows = tokenised(docs, encoder, key, text)
    pid, count = ranges(rows.select("key"), "key")
    n_parts = F.expr(f"(n_tokens + {length - 1}) div {length}")
    sizes = {r.pid: r.n for r in rows.groupBy(pid.alias("pid")).agg(F.sum(n_parts).alias("n")).collect()}  # a row per range
    total, starts = 0, {}
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    kind, source = f"<u{width}", np.dtype("<u1" if encoder is None else "<u4")
    held = docs.sparkSession.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[int, int] = {}
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                out = []
                for p, doc_id, body in zip(pdf["pid"][i : i + 200], pdf["doc_id"][i : i + 200], pdf["body"][i : i + 200]):
                    n_ids = len(body) // source.itemsize + 1
                    n = -(-n_ids // length)
                    first = at.setdefault(p, held.value[p])
                    at[p] = first + n
                    slots, step = permuted(np.arange(first, first + n), total, seed), length * source.itemsize
                    out += [(s, doc_id, j, min(length, n_ids - j * length), body[j * step : (j + 1) * step]) for j, s in enumerate(slots.tolist())]
                made = pd.DataFrame(out, columns=["slot", "doc_id", "part", "n_tokens", "body"])
                yield made.astype({"doc_id": "Int64"})

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                full = np.full((part.num_rows, length), pad, kind)
                for row, body, n in zip(full, part.column("body").to_pylist(), part.column("n_tokens").to_pylist()):
                    ids = np.frombuffer(body, source)
                    row[: len(ids)] = ids
                    if n > len(ids):
                        row[len(ids)] = end
                cols = [part.column(c) for c in ("slot", "doc_id", "part", "n_tokens")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes() for r in full], pa.binary())], ["slot", "doc_id", "part", "n_tokens", "payload"])

    rows = rows.select(pid.alias("pid"), "key", "doc_id", "body").repartitionById(count, F.col("pid")).sortWithinPartitions("pid", "key", F.xxhash64("body"))
    made = rows.select("pid", "doc_id", "body").mapInPandas(cut, "slot long, doc_id long, part long, n_tokens long, body binary")  # as it came, which shuffles half the bytes
    shard = F.expr(f"slot div {shard_rows}")
    shards = max(1, -(-total // shard_rows))
    parts = min(partitions(docs.sparkSession), shards)
    dealt = made.repartitionById(parts, (shard * parts / shards).cast("int")).sortWithinPartitions("slot")
    made = dealt.mapInArrow(lay, "slot long, doc_id long, part long, n_tokens long, payload binary").withColumn("shard", shard)
    offset = (F.col("slot") % shard_rows) * (length * width)
    return made.select("slot", "shard", offset.alias("byte_offset"), "doc_id", "part", "n_tokens", "payload")


def _store(path: str):
    """The file system of a path or address that driver and executors can all open, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class ShardSink(DataSource):
    """Spark sink of (shard, slot, payload), sorted by slot within tasks that hold whole shards: a file per shard."""

    @classmethod
    def name(cls) -> str:
        return "fixed_stride_shards"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(dict(self.options))


class ShardWriter(DataSourceWriter):
    """Tasks write under names of their own attempt; the driver renames what committed tasks wrote, then writes the
    manifest, so a lost executor or a repeated task leaves no half-written shard under its final name."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, rows) -> WriterCommitMessage:
        store, folder = _store(self.options["path"])
        store.create_dir(f"{folder}/_attempts")
        out, files, n = None, [], 0
        for row in rows:
            shard = int(row[0])
            if not files or files[-1][1] != shard:
                if out:
                    out.close()
                files.append((f"{folder}/_attempts/{uuid.uuid4().hex}", shard))
                out = store.open_output_stream(files[-1][0])
            out.write(bytes(row[2]))
            n += 1
        if out:
            out.close()
        return Written(files, n)

    def commit(self, messages) -> None:
        store, folder = _store(self.options["path"])
        for m in messages:
            for path, shard in m.files if m else ():
                store.move(path, f"{folder}/{shard_name(shard)}")
        store.delete_dir(f"{folder}/_attempts")
        facts = {k: int(self.options[k]) for k in ("length", "width", "shard_rows")} | {"slots": sum(m.rows for m in messages if m)}
        mine = {shard_name(i) for i in range(-(-facts["slots"] // facts["shard_rows"]))}
        for found in store.get_file_info(fs.FileSelector(folder)):  # of a larger run before
            if _SHARD.fullmatch(found.base_name) and found.base_name not in mine:
                store.delete_file(found.path)
        with store.open_output_stream(f"{folder}/manifest.json") as f:
            f.write(json.dumps(facts).encode())

    def abort(self, messages) -> None:
        store, folder = _store(self.options["path"])
        store.delete_dir_contents(f"{folder}/_attempts", missing_dir_ok=True)


@dataclass
class Written(WriterCommitMessage):
    files: list
    rows: int


_SHARD = re.compile(r"shard-[0-9]{8,}\.bin")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(sequences: DataFrame, path: str, length: int = 1024, shard_rows: int = 4096, width: int = 2) -> None:
    """Raw files of ``shard_rows`` payloads of ``length * width`` bytes end to end, and a manifest, in a shared folder.

    A rerun writes the same bytes. Shards of an earlier run are replaced, and those that this one doesn't have deleted. A path
    without a scheme is one of the cluster's own file system. No sequences give a manifest of no slots.
    """
    spark = sequences.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    sequences.sparkSession.dataSource.register(ShardSink)
    rows = sequences.select("shard", "slot", "payload")
    rows.write.format("fixed_stride_shards").mode("append").option("path", path).option("length", length).option("width", width).option("shard_rows", shard_rows).save()


def read_slots(path: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot on, in order: a reader that stopped resumes with one seek, wherever it stopped."""
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        facts = json.loads(f.read())
    stride, per_shard = facts["length"] * facts["width"], facts["shard_rows"]
    while slot < facts["slots"]:
        with store.open_input_file(f"{folder}/{shard_name(slot // per_shard)}") as f:
            f.seek(slot % per_shard * stride)
            while len(raw := f.read(stride)) == stride:
                yield slot, np.frombuffer(raw, f"<u{facts['width']}")
                slot += 1
