"""Token ids as length-delimited binary records, with a separate offset index.

Format. A data set is a folder of shards ``part-N-attempt.rec``, N in ascending order of document, each
with an index ``.idx`` beside it. A record is framed as

    uint64 length | uint32 masked checksum of the length | data | uint32 masked checksum of the data

in little-endian order. A checksum is CRC-32 (zlib), rotated right by 15 bits plus 0xA282EAD8, so that
data which hold checksums do not check themselves. The data are: int64 doc_id, uint8 flags (bit 0:
doc_id is null; bit 1: ids take 4 bytes instead of 2), the ids. An index entry is int64 doc_id, int64
offset of the frame, int64 number of ids; entries have a fixed size, so any record can be read without
those before it.

Writing. Rows are range partitioned and sorted by document; each task streams its rows to one shard, under
a name of the attempt's own. What the tasks return is one manifest row per shard, which names the file
of the attempt that succeeded. Files are opened through pyarrow's file systems, so the shared folder may be any
store they know.

Encoding. Byte-level pre-tokens never cross the start of a run of white space or the end of a run of
letters, so texts are cut there and each piece's ids are kept in a bounded cache, which a Python worker
keeps from task to task; the result is that of encoding the whole text.

Defined cases: null or empty text has only the end id; null doc_ids come first; rows that repeat a
doc_id follow each other in the order of their text's hash; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import NO_ID, RID, TAG, TXT, kept_by_worker, new_path, rows_of, stash

#: White space of the pre-tokenizer's pattern (Unicode White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Finer: a pre-token also ends where a run of letters does (letters that are known as such without a table).
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_FINE = re.compile(f"[{_SPACE}]*+[{_LETTERS}]++(?![^\\W\\d_])|[{_SPACE}]*+[^{_SPACE}]+|[{_SPACE}]+")
_CHUNK = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
END_ID = 0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer.

    At most about ``most`` pieces are kept at a time, and ``units`` characters and ids of them: text without spaces has long
    pieces that never come back.
    """

    def __init__(self, path: str, most: int = 1_800_000, units: int = 40_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.most, self.units = Tokenizer.from_file(path), most, units
        self.wide = self.tok.get_vocab_size() > 65536
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.letters = 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.at, self.n = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        new = list(set(pieces).difference(self.codes))
        for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids, code = e.ids, len(self.codes)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            if code >= len(self.at):
                self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[code], self.n[code] = self.used, len(ids)
            self.used += len(ids)
            self.letters += len(p)
            self.codes[p] = code

    def _codes(self, pieces: list[str]) -> np.ndarray:
        if len(self.codes) > self.most or self.letters + self.used > self.units:
            self.clear()
        try:
            return np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            self._learn(pieces)
            return np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))

    def counts(self, pieces: list[str]) -> np.ndarray:
        codes = self._codes(pieces)  # may replace the arrays
        return self.n[codes]

    def _chunk(self, text: str) -> np.ndarray:
        codes = self._codes(_FINE.findall(text))
        n = self.n[codes]
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[codes] - ends + n, n)
        return self.flat[take]

    def __call__(self, text: str, chunk: int = 1 << 20) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > chunk:
            cut = _CHUNK.search(text, at + chunk)
            if not cut:
                break
            out.append(self._chunk(text[at : cut.end()]))
            at = cut.end()
        out.append(self._chunk(text[at:]))
        return np.concatenate(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder: its pieces stay from task to task."""
    return kept_by_worker(("encoder", path), lambda: Encoder(path))


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def unframe(stream) -> Iterator[bytes]:
    """The records of a shard, in order; raises where a checksum does not hold."""
    while head := stream.read(12):
        if len(head) != 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        n = struct.unpack("<Q", head[:8])[0]
        data, check = stream.read(n), stream.read(4)
        if len(data) != n or len(check) != 4 or masked(data) != struct.unpack("<I", check)[0]:
            raise ValueError("damaged record")
        yield data


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return struct.pack("<qB", NO_ID if doc_id is None else doc_id, (doc_id is None) | wide << 1) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", data)
    return None if flags & 1 else doc_id, np.frombuffer(data, "<u4" if flags & 2 else "<u2", offset=9)


def store_of(path: str):
    """(file system, folder) of a path as Spark names it."""
    from pyarrow import fs

    scheme, found, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else path)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Encode and write ``docs``; a manifest (shard, file, docs, tokens) of what was written, itself written.

    Each attempt of a task writes files of its own name, and only those of the attempt that succeeded come into the
    manifest: nothing is renamed, and what a lost executor leaves behind is never read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        context = TaskContext.get()
        shard = context.partitionId()
        encode, n, offset, tokens = None, 0, 0, 0
        name = f"part-{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        records = index = None
        for batch in batches:
            if records is None:
                encode = encoder(tokenizer or tokenizer_path())
                store.create_dir(root, recursive=True)
                records, index = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx")
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                data = frame(pack(doc_id, ids, encode.wide))
                records.write(data)
                index.write(struct.pack("<qqq", NO_ID if doc_id is None else doc_id, offset, len(ids)))
                n, offset, tokens = n + 1, offset + len(data), tokens + len(ids)
        if records is not None:
            records.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{name}.rec"], "docs": [n], "tokens": [tokens]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = rows_of(docs).repartitionByRange(RID, TAG).sortWithinPartitions(RID, TAG).select(F.col("doc_id").cast("long"), TXT)
    return stash(rows.mapInArrow(task, "shard int, file string, docs long, tokens long"), "manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record of the files; one task reads whole shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with store.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as stream:
                    for data in unframe(stream):
                        doc_id, ids = unpack(data)
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    shards = manifest.select("shard", "file", before.alias("before"))
    spread = shards.repartitionByRange(max(1, manifest.count()), "shard").select("file", "before")
    return spread.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(path: str, file: str, nth: int) -> tuple[int | None, np.ndarray]:
    """The nth record of a shard, found through its index."""
    store, root = store_of(path)
    with store.open_input_file(f"{root}/{file.removesuffix('.rec')}.idx") as index:
        index.seek(24 * nth)
        _, offset, _ = struct.unpack("<qqq", index.read(24))
    with store.open_input_file(f"{root}/{file}") as records:
        records.seek(offset)
        return unpack(next(unframe(records)))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: place, length and checksum of each document's ids, from the files."""
    path = new_path(spark, "tokens")
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
