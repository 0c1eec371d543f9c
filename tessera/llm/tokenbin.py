"""Token ids in fixed-width bit-packed files.

A file holds blocks of ids, each id in the least number of bits that the vocabulary needs, and an
index of byte offsets, so that any block is read and unpacked alone with numpy. Layout, all numbers
little-endian:

    magic "TOKP", version u32, bits u32, ids in a block u32
    blocks:    ceil(ids in block * bits / 8) bytes each
    doc ids:   u64 documents, then i64 for each      doc ends: u64 for each document (ids up to its end)
    offsets:   u64 offsets, then u64 for each block and for the end of the last
    footer:    u64 place of the doc ids, u64 place of the offsets, u64 documents at the start that
               have no id, magic "TOKP"

Files are written in one pass, so all counts stand after the blocks.

Files are written by the tasks of a range-partitioned, sorted table straight into a folder that all
machines share, under a name of the attempt, and renamed when whole: a task that runs again writes
the same file again.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blobs, new_path
from .tokcount import END, byte_letters

MAGIC = b"TOKP"
HEAD = struct.Struct("<4sIII")
FOOT = struct.Struct("<QQQ4s")
BLOCK = 1 << 16
#: Chunks that a worker remembers before it forgets all, and letters of the longest of them.
REMEMBERED, SHORT = 600_000, 11


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, least bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.tobytes()
    every = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(every.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids of a packed block as uint32."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, "<u4", n).astype(np.uint32)
    every = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = every
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one file to a binary stream; holds at most one block of ids."""

    def __init__(self, sink, bits: int, block: int = BLOCK) -> None:
        self.sink, self.bits, self.block = sink, bits, block
        self.docs: list[int] = []
        self.nameless = 0
        self.ends: list[int] = []
        self.offsets = [HEAD.size]
        self.rest, self.held, self.ids = [], 0, 0
        self.sink.write(HEAD.pack(MAGIC, 2, bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], ids, np.array([len(ids)]))

    def extend(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents one after the other: their ids in one array, and how many each has. Documents
        without an id come before all others."""
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id does not fit in {self.bits} bits")
        none = sum(d is None for d in doc_ids)
        if none and (self.nameless < len(self.docs) or any(d is not None for d in doc_ids[:none])):
            raise ValueError("documents without an id come first")
        self.nameless += none
        self.docs += [0 if d is None else d for d in doc_ids]
        self.ends += (self.ids + np.cumsum(counts)).tolist()
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.rest)
            whole = len(every) // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(every[at : at + self.block])
            self.rest, self.held = [every[whole:]], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.rest))
        tables = self.offsets[-1]
        self.sink.write(np.array([len(self.docs), *self.docs], "<i8").tobytes())
        self.sink.write(np.array(self.ends, "<u8").tobytes())
        at = tables + 8 * (1 + 2 * len(self.docs))
        self.sink.write(np.array([len(self.offsets), *self.offsets], "<u8").tobytes())
        self.sink.write(FOOT.pack(tables, at, self.nameless, MAGIC))


class Reader:
    """Random access to a file of Writer's; reads only the blocks it is asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, os.SEEK_END)
        magic, version, self.bits, self.block = HEAD.unpack(self._at(0, HEAD.size))
        tables, offsets, self.nameless, end = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != MAGIC or end != MAGIC or version != 2:
            raise ValueError("not a token file, or not whole")
        n = int(np.frombuffer(self._at(tables, 8), "<i8")[0])
        self.doc_ids = np.frombuffer(self._at(tables + 8, 8 * n), "<i8")
        self.ends = np.frombuffer(self._at(tables + 8 + 8 * n, 8 * n), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self._at(offsets + 8, size - FOOT.size - offsets - 8), "<u8").astype(np.int64)
        self.n_ids = int(self.ends[-1]) if n else 0

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start to end of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            part = data[int(self.offsets[k] - self.offsets[first]) : int(self.offsets[k + 1] - self.offsets[first])]
            out.append(unpack(part, min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def documents(self, most: int = 1 << 23) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of each document in order; reads about `most` ids at a time."""
        k = 0
        while k < len(self.ends):
            start = int(self.ends[k - 1]) if k else 0
            last = max(k + 1, int(np.searchsorted(self.ends, start + most, "right")))
            ids = self.ids(start, int(self.ends[last - 1]))
            for d in range(k, last):
                a = int(self.ends[d - 1]) if d else 0
                yield d, ids[a - start : int(self.ends[d]) - start]
            k = last


#: The splitting that lets a text be encoded by chunks: lower case, no piece across white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Encodes whole texts. A tokenizer with another normalizer or splitting than those above gets
    whole texts as they are. With these, chunks between plain spaces and line ends are encoded once for each
    distinct chunk: the tokenizer's own splitting never crosses white space. Chunks of Latin letters
    alone are one pre-token each, which the normalizer only makes lower-case; so they go straight to
    the model, many at a time, and are parted again after each id that ends a word. Should the count
    of parts ever differ, they are encoded singly by the whole tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for piece, i in vocab.items() if piece.endswith(END)]] = True
        self.model = None
        if self.final.any():
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}

    def _plain(self, c: str) -> bool:
        return self.model is not None and c.isalpha() and (c.isascii() or max(c) < "\u0130")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known yet."""
        out: dict[str, bytes] = {"": b""}
        plain, other, tailed = [], [], []
        for c in new:
            body = c.rstrip(_SIGNS)
            # Signs after letters are a pre-token of their own, whatever comes before them.
            if not body or not self._plain(body):
                other.append(c)
            elif c.islower() and len(body) == len(c):
                plain.append(c)
            else:
                tailed.append((c, body.lower(), c[len(body) :]))
        parts = {b for _, b, _ in tailed} | {t for _, _, t in tailed}
        out.update([(x, self.known[x]) for x in parts if x in self.known])
        plain += [b for b in {b for _, b, _ in tailed}.difference(out, new)]
        other += [t for t in {t for _, _, t in tailed}.difference(out, new)]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            text = " ".join(some)
            if not text.isascii():
                text = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in some])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()
            if len(ends) != len(some):
                other += some
                continue
            data, start = ids.tobytes(), 0
            for c, end in zip(some, ends, strict=True):
                out[c] = data[start:end]
                start = end
        for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            out[c] = array("I", e.ids).tobytes()
        for c, body, tail in tailed:
            out[c] = out[body] + out[tail]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has. Chunks are parted and
        numbered in Arrow, so only distinct ones come to Python; short ones are remembered from
        batch to batch, long ones seldom come again."""
        if not self.by_chunk:
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ready = []
        for t in texts:
            if t.isascii() and "<|" not in t:
                t = t.lower()
            ready.append(t.replace("\n", " ").replace("\t", " ").replace("\r", " "))
        parts = pc.split_pattern(pa.array(ready, pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        learned = self._learn(new) if new else {}
        data = [learned[w] if w in learned else known[w] for w in words]
        known.update([(w, x) for w, x in learned.items() if len(w) <= SHORT])
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        every = np.frombuffer(b"".join(data), np.uint32)
        first = np.cumsum(size) - size
        n = size[at]
        end = np.cumsum(n)
        ids = every[np.repeat(first[at] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        upto = np.concatenate(([0], end))[parts.offsets.to_numpy()]
        return ids, np.diff(upto)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, n = self.encode(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []

    def __call__(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, loaded once for each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def groups(sizes: list[int], most: int = 1 << 23) -> Iterator[slice]:
    """Slices of consecutive items of about `most` in all."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (local, HDFS, S3, GCS) and the folder's path in it."""
    return pafs.FileSystem.from_uri("s3" + folder[3:] if folder.startswith("s3a:") else folder)


def _file(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.tok"


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, block: int = BLOCK) -> DataFrame:
    """Encode docs (doc_id, text) and write them in ascending doc_id order to `folder`, which all
    machines share. Returns (part, n_docs, n_ids), a row for each file.

    Null texts count as empty; each document ends in end_id if one is given. Rows of equal doc_id
    follow each other in the order of the input, and may be in several files; a null doc_id comes
    first."""
    bits = bits_for(max(vocabulary_size(tokenizer), (end_id or 0) + 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _files(folder)
        own = f"{root}/.attempt-{task.partitionId():06d}-{task.taskAttemptId()}"
        encode, writer = None, None
        for b in batches:
            encode = encode or encoder(tokenizer)
            writer = writer or Writer(fs.open_output_stream(own), bits, block)
            ids, texts = b.column(0).to_pylist(), blobs(b.column(1))
            for part in groups([len(x) for x in texts]):
                got, n = encode.encode([t.decode("utf-8", "replace") for t in texts[part]])
                if end_id is not None:
                    got, n = np.insert(got, np.cumsum(n), end_id), n + 1
                writer.extend(ids[part], got, n)
        if writer:
            writer.close()
            writer.sink.close()
            fs.move(own, _file(root, task.partitionId()))
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.ids], pa.int64())], names=["part", "n_docs", "n_ids"])

    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row's place parts many rows of one id.
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    return arrow(ordered.select("doc_id", "text"), kernel, "part int, n_docs long, n_ids long")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of write(), `files` its
    result; start counts the ids of all documents before. Each task opens its own files."""
    # One small row for each file, not for each document, is summed on the driver.
    at, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], at))
        at += r["n_ids"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(_file(root, part)) as f:
                    r = Reader(f)
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in r.documents()), np.int64, len(r.ends))
                    n = np.diff(r.ends, prepend=0)
                    null = np.arange(len(r.doc_ids)) < r.nameless
                    yield pa.record_batch([pa.array(r.doc_ids, mask=null), pa.array(first + r.ends - n), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "part int, start long").repartition(len(rows), "part")
    return arrow(listed, kernel, schema)


def lengths(docs: DataFrame, tokenizer: str, end: bool = True) -> DataFrame:
    """(doc_id, n_tokens): how many ids each row's whole text has in the files of write(), the end id
    included if there is one. Null texts count as empty; all rows stay; other columns are ignored."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            texts = blobs(b.column(1))
            n = [np.zeros(0, np.int64)]
            for part in groups([len(x) for x in texts]):
                n.append(encode.encode([t.decode("utf-8", "replace") for t in texts[part]])[1])
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(n).astype(np.int64) + bool(end))], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, kernel, "doc_id long, n_tokens long")


def encode_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs to token files in the shared folder and return what the files hold."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    done = write(docs, tokenizer, folder, end_id)
    found = spark.createDataFrame(done.collect(), done.schema)  # a row for each file
    return read(spark, folder, found)
