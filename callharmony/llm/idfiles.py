"""Token-id files: every document compressed by itself with one shared zstandard dictionary.

A file is ``MAGIC``, the documents' frames, the index and a footer. The index holds each document's id, its number
of token ids and where its frame begins, so one short document is read without the others. The footer names the
dictionary by its SHA-256, the width of an id, the number of documents and the index's place. Files follow each
other in ascending order of document ids; ``manifest.json`` says how many ids stand before each file.

Files are written through ``pyarrow.fs``, so the folder may be any store it knows, shared by all executors. A file
appears under its name only when it is whole, and a repeated task writes the same bytes again.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from callharmony.llm.tables import column
from callharmony.llm.tokenizing import ID, WORD_BPE, encoder
from callharmony.session import workspace

MAGIC = b"CHIDS\x01\x00\x00"
FOOTER = struct.Struct("<32sBQQ8s")
NO_ID = 1 << 63
# The dictionary is trained on about so many documents, each with at most so many bytes of ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 32_768, 112_640
LEVEL = 3


def narrow(ids: bytes) -> bytes:
    """Ids for storage: 16 bits where all of them fit, marked by a leading byte."""
    values = np.frombuffer(ids, ID)
    if len(values) and values.max() > 0xFFFF:
        return b"\x04" + ids
    return b"\x02" + values.astype("<u2").tobytes()


def widen(stored: bytes) -> bytes:
    return np.frombuffer(stored, "<u2" if stored[:1] == b"\x02" else ID, offset=1).astype(ID).tobytes()


def train(samples: list[bytes]) -> bytes:
    """A dictionary for serialized id arrays; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


class Frames:
    """Compress and restore single documents with a dictionary."""

    def __init__(self, dictionary: bytes):
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.hash = hashlib.sha256(dictionary).digest()
        self._pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **shared).compress
        self._unpack = zstandard.ZstdDecompressor(**shared).decompress

    def pack(self, ids: bytes) -> bytes:
        return self._pack(narrow(ids))

    def unpack(self, frame: bytes) -> bytes:
        return widen(self._unpack(frame))


def write_file(path: str, documents: Iterable[tuple[int | None, bytes]], dictionary: bytes, attempt: int = 0) -> tuple[int, int]:
    """Write ``(doc_id, packed ids)`` in the given order; returns the numbers of documents and of ids."""
    frames, store = Frames(dictionary), fs.FileSystem.from_uri(path)
    names, sizes, places = [], [], [len(MAGIC)]
    draft = f"{store[1]}.{attempt}"
    with store[0].open_output_stream(draft) as out:
        out.write(MAGIC)
        for doc_id, ids in documents:
            out.write(frames.pack(ids))
            names.append(doc_id)
            sizes.append(len(ids) // ID.itemsize)
            places.append(out.tell())
        index = out.tell()
        out.write(np.array([name is None for name in names], np.uint8).tobytes())
        out.write(np.array([name or 0 for name in names], "<i8").tobytes())
        out.write(np.array(sizes, "<u8").tobytes() + np.array(places, "<u8").tobytes())
        out.write(FOOTER.pack(frames.hash, ID.itemsize, len(names), index, MAGIC))
    store[0].move(draft, store[1])
    return len(names), sum(sizes)


class IdFile:
    """Random access to one file: the index is read when it is opened, a frame when it is asked for."""

    def __init__(self, path: str, dictionary: bytes):
        store, place = fs.FileSystem.from_uri(path)
        self.file, self.frames = store.open_input_file(place), Frames(dictionary)
        end = self.file.size()
        wanted, width, self.count, index, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC or width != ID.itemsize:
            raise ValueError(f"{path} is not an id file")
        if wanted != self.frames.hash:
            raise ValueError(f"{path} was written with another dictionary")
        n, raw = self.count, self.file.read_at(end - FOOTER.size - index, index)
        empty = np.frombuffer(raw, np.uint8, n)
        names = np.frombuffer(raw, "<i8", n, n)
        self.doc_ids = [None if none else int(name) for none, name in zip(empty, names, strict=True)]
        self.n_ids = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.places = np.frombuffer(raw, "<u8", n + 1, 17 * n).astype(np.int64)

    def ids(self, i: int) -> bytes:
        """Packed ids of the ``i``-th document of the file."""
        return self.frames.unpack(self.file.read_at(int(self.places[i + 1] - self.places[i]), int(self.places[i])))


def _sample_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """Trained in one task on a bounded sample, chosen by a hash of the document id."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = docs.where(chosen).limit(4 * SAMPLE_DOCS).repartition(1)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.array([end_id], ID).tobytes()
        samples = [narrow((encode(text) + end)[:SAMPLE_BYTES]) for batch in batches for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(samples)], pa.binary())], ["dictionary"])

    found = sample.mapInArrow(one, "dictionary binary").first()
    return bytes(found[0]) if found else b""


def write_ids(docs: DataFrame, folder: str, tokenizer: str = WORD_BPE, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> dict:
    """Encode every whole text, end it with ``end_id`` and write id files below ``folder``; returns the manifest.

    A null text is an empty one. Documents without an id come first; rows that share an id stand in the order
    of a hash of their texts, over as many files as they need; all rows are written. An empty table gives a manifest without files.
    """
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    dictionary = _sample_dictionary(rows, tokenizer, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(tokenizer).ids, np.array([end_id], ID).tobytes(), TaskContext.get()
        name = f"part-{task.partitionId():06d}.ids"

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc, body in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    yield doc, encode(body.as_py()) + end

        count, ids = write_file(f"{folder}/{name}", documents(), dictionary, task.taskAttemptId())
        yield pa.RecordBatch.from_pylist([{"name": name, "docs": count, "ids": ids}])

    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    by_id, text_key, row_no = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row_no")
    # The last two keys split the rows that share an id, or are equal, between ranges.
    keyed = rows.select("doc_id", "text", text_key, row_no).repartitionByRange(by_id, "text_key", "row_no")
    ordered = keyed.sortWithinPartitions(by_id, "text_key", "text").select("doc_id", "text")
    files, before = [], 0
    for row in sorted(ordered.mapInArrow(write, "name string, docs long, ids long").collect()):
        files.append({"name": row["name"], "docs": row["docs"], "ids": row["ids"], "start": before})
        before += row["ids"]
    manifest = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "files": files}
    for name, body in (("dictionary.zstd", dictionary), ("manifest.json", json.dumps(manifest).encode())):
        with store.open_output_stream(f"{place}/{name}") as out:
            out.write(body)
    return manifest


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the files below ``folder``: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``ids`` are packed little-endian unsigned 32-bit numbers; a column nobody asks for is dropped by Spark.
    """
    store, place = fs.FileSystem.from_uri(folder)
    read = {name: store.open_input_stream(f"{place}/{name}").readall() for name in ("manifest.json", "dictionary.zstd")}
    files, dictionary = json.loads(read["manifest.json"])["files"], read["dictionary.zstd"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
                file = IdFile(f"{folder}/{name}", dictionary)
                starts = start + np.concatenate([[0], np.cumsum(file.n_ids)])
                for first in range(0, file.count, 512):
                    last = min(first + 512, file.count)
                    ids = [file.ids(i) for i in range(first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[first:last], pa.int64()),
                            pa.array(starts[first:last], pa.int64()),
                            pa.array([len(x) // ID.itemsize for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    rows = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, start long")
    spread = rows.repartition(max(1, len(files)), "name")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def id_files(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """Write the documents' id files into the shared folder and read them back."""
    folder = workspace(docs.sparkSession, "ids")
    write_ids(docs, folder, tokenizer, end_id)
    return read_ids(docs.sparkSession, folder).drop("ids")
