"""Token-id output: flat unsigned integer files with 64-bit document offsets.

For each partition of the documents, in ascending ``doc_id`` order or one given, three files: ``.bin`` (the ids, 16 or 32 bits each, little-endian),
``.off`` (n_docs + 1 offsets in ids, 64 bits) and ``.ids`` (the documents' ids, 64 bits). A manifest row per partition has the
number of ids before it, from a prefix sum. A task writes under a name of its own and only the manifest, itself written once,
says which files count, so a repeated task does no harm.

Defined cases: null text is empty (the end id alone); a null ``doc_id`` sorts first and comes back as null; rows that repeat a
``doc_id`` stay separate documents, ordered by text; an empty table writes no ids; further columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, scratch, texts

END = 2
#: Words whose ids a Python worker keeps, also between tasks; the rest is encoded anew. Characters encoded together.
KEPT_WORDS, TOGETHER = 800_000, 1_000_000
#: New words are encoded in lines of this many, so many lines at a time, with a word between them that is one id and stands in none of them.
LINE, LINES, BETWEEN = 400, 40, "\u2764"
NO_ID = -(1 << 63)
MANIFEST = "part int, path string, n_docs long, n_ids long"
_encoders: dict = {}


class Encoder:
    """Encodes whole texts word by word, each distinct word once.

    Valid where the tokenizer drops white space between words and encodes each by itself; :meth:`by_words` tells. Only ASCII
    blanks and line ends separate here, all of which the tokenizer drops too, so the rest of its rules apply unchanged.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        # a task has one core; the tokenizer's own threads would each keep memory for as long as the worker lives
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kept, self.dtype = Tokenizer.from_file(path), {}, np.dtype(dtype)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        between = ids(BETWEEN)
        self.between = between[0] if len(between) == 1 else None
        self.by_words = ids("It's one-two  \n three,\tfour.") == [i for w in ("It's", "one-two", "three,", "four.") for i in ids(w)]

    def _each(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            yield w, np.array(e.ids, self.dtype).tobytes()

    def _fresh(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        if self.between is None:
            yield from self._each(words)
            return
        yield from self._each([w for w in words if BETWEEN in w])
        plain, width = [w for w in words if BETWEEN not in w], self.dtype.itemsize
        lines = [plain[at : at + LINE] for at in range(0, len(plain), LINE)]
        for at in range(0, len(lines), LINES):
            some = lines[at : at + LINES]
            for line, e in zip(some, self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(x) for x in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends, data, start = [*np.flatnonzero(ids == self.between).tolist(), len(ids)], ids.tobytes(), 0
                for w, end in zip(line, ends, strict=True):
                    yield w, data[width * start : width * end]
                    start = end + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array([*e.ids, END], self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        kept, end = self.kept, np.array([END], self.dtype).tobytes()
        fresh = dict(self._fresh(list({w for words in split for w in words if w not in kept})))
        if len(kept) + len(fresh) <= KEPT_WORDS:
            kept.update(fresh)
            return [np.frombuffer(b"".join([*map(kept.__getitem__, words), end]), self.dtype) for words in split]
        out = [np.frombuffer(b"".join([*(kept[w] if w in kept else fresh[w] for w in words), end]), self.dtype) for words in split]
        for w, ids in fresh.items():
            if len(kept) >= KEPT_WORDS:
                break
            kept[w] = ids
        return out


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``TOGETHER`` characters."""
    sizes = np.cumsum(pc.utf8_length(b.column("text")).to_numpy(zero_copy_only=False)) // TOGETHER
    starts = np.flatnonzero(np.diff(sizes, prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield b.slice(int(s), int(e - s))


def encoder(path: str, dtype: str) -> Encoder:
    return _encoders.get((path, dtype)) or _encoders.setdefault((path, dtype), Encoder(path, dtype))


def _write(target: str, vocabulary: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(target)
        files.create_dir(root, recursive=True)
        part, e = TaskContext.get().partitionId(), encoder(vocabulary, dtype)
        path, offsets, ids = f"{root}/part-{part:05d}-{uuid.uuid4().hex}", [np.zeros(1, np.int64)], []
        total = 0
        with files.open_output_stream(f"{path}.bin") as out:
            for whole in batches:
                for b in slices(whole):
                    encoded = e.encode(b.column("text").to_pylist())
                    out.write(b"".join(x.tobytes() for x in encoded))
                    offsets.append(total + np.cumsum([len(x) for x in encoded], dtype=np.int64))
                    ids.append(np.array(b.column("doc_id").fill_null(NO_ID), np.int64))
                    total += sum(map(len, encoded))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        for end, x in ((".off", np.concatenate(offsets)), (".ids", ids)):
            with files.open_output_stream(path + end) as out:
                out.write(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path[len(root) + 1 :]]), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    return run


def id_type(vocabulary: str) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    most = max(END, *Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values())
    return "<u2" if most < 1 << 16 else "<u4"


def stored_order(docs: DataFrame) -> Column | None:
    """The place of each row in the files that ``docs`` was just read from (their number, then the row's index); None where it was not."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long") * (1 << 40) + F.col("_metadata.row_index")


def write(docs: DataFrame, target: str, vocabulary: str, dtype: str = "<u2", order: Column | None = None) -> DataFrame:
    """Write the files below ``target`` (a URI that all executors reach) and return the manifest with each partition's ``base``.

    Documents stand in the order of ``order``, a number, or else of ``doc_id``.
    """
    by = ["doc_id", "text"] if order is None else ["at"]
    d = texts(docs, *([] if order is None else [order.alias("at")])).repartitionByRange(partitions(docs.sparkSession), by[0]).sortWithinPartitions(*by)
    manifest = cut(d.select("doc_id", "text").mapInArrow(_write(target, vocabulary, dtype), MANIFEST))
    return manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])


class Mapped:
    """Stretches of a file as arrays: memory-mapped where it is local, else read one by one."""

    def __init__(self, files: fs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.size = files.get_file_info(path).size // self.dtype.itemsize
        local = isinstance(files, fs.LocalFileSystem)
        self.array = np.memmap(path, self.dtype, "r") if local and self.size else None
        self.file = None if local else files.open_input_file(path)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.array is not None:
            return np.asarray(self.array[at])
        a, b, width = at.start, min(at.stop, self.size), self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * width, a * width) if self.file and b > a else b"", self.dtype)


def _read(target: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(target)
        for m in batches:
            for path, base in zip(m.column("path").to_pylist(), m.column("base").to_pylist(), strict=True):
                ids, off, own = (Mapped(files, f"{root}/{path}{end}", t) for end, t in ((".bin", dtype), (".off", "<i8"), (".ids", "<i8")))
                for at in range(0, own.size, 10_000):
                    o = off[at : at + 10_001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    d = own[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64(), mask=d == NO_ID), pa.array(base + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(manifest: DataFrame, target: str, dtype: str = "<u2") -> DataFrame:
    """Per document, from the files alone: where it starts among all ids, its number of ids and their checksum."""
    spread = manifest.select("part", "path", F.col("base").cast("long").alias("base")).repartition(partitions(manifest.sparkSession), "part")
    return spread.mapInArrow(_read(target, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, vocabulary: str | None = None, order: Column | None = None) -> DataFrame:
    target, vocabulary = scratch(docs.sparkSession, "token-ids"), vocabulary or default_vocabulary()
    dtype = id_type(vocabulary)
    return read(write(docs, target, vocabulary, dtype, order), target, dtype)
