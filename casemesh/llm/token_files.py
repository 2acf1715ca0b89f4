"""Token ids in files of independent zstandard frames, read back one document at a time.

A data set is a folder of files and an index table. A file holds the documents of one range
of ids, in ascending order:

    frame of document 1 | frame of document 2 | ... | directory frame | seek table

A document has a frame of its own, so a reader decompresses nothing it was not asked for; one
of more than ``frame_tokens`` ids has several. Every frame carries zstandard's own checksum.
The seek table is the skippable frame of the public seekable format: per frame its compressed
size, its size and a checksum of its content, then the number of frames and a magic number,
so it is found from the end of the file. The directory names the documents of the file: a
file can be read alone (``TokenFile``).

The size of all texts gives the number of files. A range shuffle by id brings every file's
texts into one task, which tokenizes them once and streams them out frame by frame under a
name of its own. Its index rows, one per document, name the file: a
lost task leaves a file that no row points to, and a repeated one writes another. Reading is
a scan of index rows that opens the files they name, in the order they were written.

Defined cases: null texts count as empty, and an empty text is the end token alone; rows
without id come first; rows that repeat an id are documents of their own, ordered by a hash
of their texts; other columns are ignored; an empty table gives a data set without
files. A frame whose content differs from either checksum raises ``DamagedFrame``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemesh.llm.byte_pairs import ID_BYTES, Encoder
from casemesh.llm.learning import worker_state
from casemesh.llm.words import slices
from casemesh.session import small_batches

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
SKIP_HEADER = "<II"
FOOTER = "<IBI"

DIRECTORY_HEADER = "<4sII"
DIRECTORY_MAGIC = b"TOKD"
DIRECTORY_ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("tokens", "<i8")])
GROUP_CHARS = 1 << 19
READ_BYTES = 1 << 22
LOW_32 = (1 << 32) - 1

INDEX_SCHEMA = "shard int, file string, doc_id long, place long, frame long, n_tokens long, before long"
INDEX_NAMES = [column.split()[0] for column in INDEX_SCHEMA.split(", ")]
INDEX_TYPES = [pa.int32(), pa.string(), *[pa.int64()] * 5]


class DamagedFrame(ValueError):
    pass


class TokenFiles(NamedTuple):
    """``tokenizer``: path of a tokenizer file, the same on all machines. A file holds about
    ``file_bytes`` of text and ``file_documents`` documents at most."""

    tokenizer: str
    end_id: int = 0
    frame_tokens: int = 1 << 20
    file_bytes: int = 1 << 24
    file_documents: int = 1 << 18
    level: int = 3


def _open(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Streams documents into one file; nothing but the seek table is held."""

    def __init__(self, out, config: TokenFiles, width: int):
        import zstandard

        self.out, self.config, self.width = out, config, width
        self.packer = zstandard.ZstdCompressor(level=config.level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []

    def _frame(self, content: bytes) -> None:
        import xxhash

        packed = self.packer.compress(content)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & LOW_32))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> tuple[int, int]:
        """Writes a document; returns its first frame and the number of its ids."""
        first = len(self.entries)
        narrow = ids.astype(f"<u{self.width}")
        for low in range(0, max(len(narrow), 1), self.config.frame_tokens):
            self._frame(narrow[low : low + self.config.frame_tokens].tobytes())
        self.documents.append((doc_id or 0, doc_id is not None, len(ids)))
        return first, len(ids)

    def close(self) -> None:
        directory = np.array(self.documents, dtype=DIRECTORY_ENTRY)
        header = struct.pack(DIRECTORY_HEADER, DIRECTORY_MAGIC, self.width, self.config.frame_tokens)
        self._frame(header + directory.tobytes())
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        self.out.write(struct.pack(SKIP_HEADER, SKIPPABLE_MAGIC, len(table) + struct.calcsize(FOOTER)))
        self.out.write(table)
        self.out.write(struct.pack(FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class TokenFile:
    """One file, open for reading; only its seek table and its directory are loaded."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        size = source.size()
        if size < struct.calcsize(FOOTER) + struct.calcsize(SKIP_HEADER):
            raise DamagedFrame("the file is too short for a seek table")
        count, flags, magic = struct.unpack(FOOTER, source.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        length = count * ENTRY.itemsize
        start = size - struct.calcsize(FOOTER) - length - struct.calcsize(SKIP_HEADER)
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG or start < 0:
            raise DamagedFrame("the file has no seek table at its end")
        head, told = struct.unpack(SKIP_HEADER, source.read_at(struct.calcsize(SKIP_HEADER), start))
        if head != SKIPPABLE_MAGIC or told != length + struct.calcsize(FOOTER):
            raise DamagedFrame("the seek table is cut off")
        body = source.read_at(length, start + struct.calcsize(SKIP_HEADER))
        self.entries = np.frombuffer(body, dtype=ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        if not count:
            raise DamagedFrame("the file has no directory")
        header = next(self.contents(count - 1, 1))
        magic, self.width, self.frame_tokens = struct.unpack_from(DIRECTORY_HEADER, header)
        if magic != DIRECTORY_MAGIC:
            raise DamagedFrame("the last frame is no directory")
        self.documents = np.frombuffer(header, dtype=DIRECTORY_ENTRY, offset=struct.calcsize(DIRECTORY_HEADER))
        frames = np.maximum(1, -(-self.documents["tokens"] // self.frame_tokens))
        self.first_frames = np.concatenate([[0], np.cumsum(frames)])
        self.before = np.cumsum(self.documents["tokens"]) - self.documents["tokens"]

    def contents(self, first: int, count: int) -> Iterator[bytes]:
        """The checked contents of ``count`` frames from ``first`` on, from one read."""
        import xxhash
        import zstandard

        low, high = int(self.offsets[first]), int(self.offsets[first + count])
        packed = memoryview(self.source.read_at(high - low, low))
        for number in range(first, first + count):
            size = int(self.entries["size"][number])
            own = packed[int(self.offsets[number]) - low : int(self.offsets[number + 1]) - low]
            try:
                content = self.unpacker.decompress(own, max_output_size=size)
            except zstandard.ZstdError as error:
                raise DamagedFrame(f"frame {number}: {error}") from error
            told = int(self.entries["checksum"][number])
            if len(content) != size or xxhash.xxh64_intdigest(content) & LOW_32 != told:
                raise DamagedFrame(f"frame {number}: its content differs from the seek table")
            yield content

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at ``place``; no frame but its own is decompressed."""
        first, end = self.first_frames[place : place + 2].tolist()
        content = b"".join(self.contents(first, end - first))
        return np.frombuffer(content, dtype=f"<u{self.width}")


def write_token_files(docs: DataFrame, path: str, config: TokenFiles) -> DataFrame:
    """Writes ``docs`` under ``path``, a new folder, and returns the index of the documents."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, size = docs.select(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    files = max(1, -(-(size or 0) // config.file_bytes), -(-rows // config.file_documents))
    # Rows alike in id and text are told apart by their place, so that no range is one key.
    keys = F.asc_nulls_first("doc_id"), F.asc("mark"), F.asc("row")
    ordered = (
        docs.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(int(files), *keys)
        .sortWithinPartitions(*keys)
    )
    folder = f"{path.rstrip('/')}/data"
    end = np.array([config.end_id], dtype="<u4").tobytes()

    def run(batches):
        state = worker_state("token_files")
        if state.get("path") != config.tokenizer:
            state.update(path=config.tokenizer, encoder=Encoder(config.tokenizer))
        encoder = state["encoder"]
        width = 2 if max(len(encoder.sizes), config.end_id + 1) <= 1 << 16 else ID_BYTES
        shard = TaskContext.get().partitionId()
        file = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.tok"
        writer, place, before = None, 0, 0
        for batch in batches:
            if writer is None and batch.num_rows:
                system, name = _open(file)
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(name)
                writer = TokenFileWriter(out, config, width)
            for part in slices(batch.column(1), GROUP_CHARS):
                own, texts = (batch.column(n)[part.low : part.high].to_pylist() for n in range(2))
                rows = []
                for doc_id, ids in zip(own, encoder.encode([text or "" for text in texts])):
                    ids = np.frombuffer(ids + end, dtype="<u4")
                    rows.append((shard, file, doc_id, place, *writer.add(doc_id, ids), before))
                    place, before = place + 1, before + len(ids)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, INDEX_NAMES)
        if writer is not None:
            writer.close()
            out.close()

    index = ordered.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA)
    with small_batches(docs.sparkSession):
        index.write.parquet(f"{path.rstrip('/')}/index")
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path.rstrip('/')}/index")


def find_documents(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index rows of the documents whose ``doc_id`` is in ``wanted``, in file order."""
    found = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.repartitionByRange("shard", "frame").sortWithinPartitions("shard", "frame")


def read_documents(located: DataFrame) -> DataFrame:
    """``shard, doc_id, n_tokens, before, ids`` of the documents that index rows point to.

    Everything but the place comes from the files. ``before`` counts the ids of the file's
    documents before this one; ``ids`` are little-endian unsigned 32-bit integers.
    """

    def run(batches):
        worker_state("token_reader")
        name, source, file = None, None, None
        for batch in batches:
            shards, names, places = (batch.column(n).to_pylist() for n in range(3))
            low = 0
            while low < batch.num_rows:
                if names[low] != name:
                    if source is not None:
                        source.close()
                    system, path = _open(names[low])
                    name, source = names[low], system.open_input_file(path)
                    file = TokenFile(source)
                # Documents that follow each other in a file are fetched together.
                high, start = low + 1, file.offsets[file.first_frames[places[low]]]
                while (
                    high < batch.num_rows
                    and names[high] == name
                    and places[high] == places[high - 1] + 1
                    and file.offsets[file.first_frames[places[high] + 1]] - start <= READ_BYTES
                ):
                    high += 1
                first, end = places[low], places[high - 1] + 1
                frames = file.first_frames[first : end + 1]
                contents = file.contents(int(frames[0]), int(frames[-1] - frames[0]))
                found = [
                    np.frombuffer(b"".join(islice(contents, count)), dtype=f"<u{file.width}")
                    for count in np.diff(frames).tolist()
                ]
                told = file.documents[first:end]
                if [len(ids) for ids in found] != told["tokens"].tolist():
                    raise DamagedFrame(f"{name}: documents differ from the directory")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shards[low:high], pa.int32()),
                        pa.array(told["doc_id"], mask=told["known"] == 0),
                        pa.array(told["tokens"]),
                        pa.array(file.before[first:end]),
                        pa.array([ids.astype("<u4").tobytes() for ids in found], pa.binary()),
                    ],
                    ["shard", "doc_id", "n_tokens", "before", "ids"],
                )
                low = high
        if source is not None:
            source.close()

    return located.select("shard", "file", "place").mapInArrow(
        run, "shard int, doc_id long, n_tokens long, before long, ids binary"
    )


def with_starts(found: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` with ``start``: the ids of all documents of the data set before each one.

    One row per file is summed up, so the window holds what a listing of the files would.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin"))
    return found.join(starts, "shard").withColumn("start", F.col("begin") + F.col("before")).drop("begin")
