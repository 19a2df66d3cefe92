"""Token ids in flat binary files: unsigned integers on end, 64-bit document offsets, read back memory-mapped.

Layout of a folder (a path that driver and executors see, as memory-mapping needs):

* ``<name>.ids`` per partition: the ids of its documents on end, little-endian uint16 or uint32;
* ``<name>.offsets``: one uint64 per document and one more, counted over all partitions, so document
  ``i`` of the file has its ids at ``offsets[i] - offsets[0]`` up to ``offsets[i + 1] - offsets[0]``;
* ``docs`` (Parquet): part, file, place and id of each document; ``parts`` (Parquet): size and base of each file.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semblance.llm.common import packed, shared_folder

END_ID = 1
#: Text bytes that are encoded at once, and words whose ids a task remembers: bounds on memory, not on results.
CHUNK_BYTES, WORDS_KEPT = 16 << 20, 400_000
#: Letters of Latin-1 (all composed, lower case by one letter each), and marks that may follow a word.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"


def local_path(folder: str) -> str:
    """``folder`` as a file system path; memory-mapping needs a mounted folder."""
    path = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"token files need a mounted folder, not {folder}")
    return path


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start:start+size] on end."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Encoder:
    """Ids of whole texts.

    ``by_word`` is for tokenizers that drop white space, so that no token reaches over it: each distinct
    word is then encoded once and its ids remembered. Where the file says that the tokenizer only
    normalises to NFC and lower case, parts letters from marks and marks the ends of words, words of Latin-1
    letters (already NFC) and the marks after them go to the library apart, without its normaliser.
    ``by_word=False`` encodes whole texts.
    """

    def __init__(self, path: str, by_word: bool = True, special: bool = True, keep: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_word, self.keep = Tokenizer.from_file(path), by_word, keep
        self.tokenizer.encode_special_tokens = not special
        told = json.loads(self.tokenizer.to_str())
        steps = [[x["type"] for x in (told[k] or {}).get(many, [])] for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        suffix = told["model"].get("end_of_word_suffix")
        self.letters = None
        if by_word and suffix and steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one text: the tokens that end a word part them again."""
        joined = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.ends[flat])
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not mark the end of every word")
        return flat, np.diff(ends, prepend=-1)

    def _remembered(self, words: list[str]) -> np.ndarray:
        """Places of words of letters among those whose ids are known."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.keep:
                self.known, new = {}, words
                self.flat, self.start, self.size = self.flat[:0], self.start[:0], self.size[:0]
            flat, size = (self._encode_letters if self.letters else self._encode)(new)
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word start and how many they are."""
        if not self.letters:
            place = self._remembered(words.to_pylist())
            return self.flat, self.start[place], self.size[place]
        plain = pc.match_substring_regex(words, f"^[{LATIN}]+[{MARKS}]*$")
        own = words.filter(plain)
        stem = pc.utf8_rtrim(own, MARKS)
        mark = pc.replace_substring_regex(own, f"^[{LATIN}]+", "")
        stem, mark = pc.utf8_lower(stem).dictionary_encode(), mark.dictionary_encode()
        rest, rest_size = self._encode([*mark.dictionary.to_pylist(), *words.filter(pc.invert(plain)).to_pylist()])
        rest_start = np.cumsum(rest_size) - rest_size
        place = self._remembered(stem.dictionary.to_pylist())[stem.indices.to_numpy()]
        at = mark.indices.to_numpy()
        # letters then marks of each plain word, end to end, and the other words behind them
        runs = np.empty((len(own), 2), np.int64), np.empty((len(own), 2), np.int64)
        runs[0][:, 0], runs[1][:, 0] = self.start[place], self.size[place]
        runs[0][:, 1], runs[1][:, 1] = len(self.flat) + rest_start[at], rest_size[at]
        flat = np.concatenate([self.flat, rest])
        made = gathered(flat, runs[0].ravel(), runs[1].ravel())
        size = np.empty(len(words), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        n_marks = len(mark.dictionary)
        size[is_plain], size[~is_plain] = runs[1].sum(axis=1), rest_size[n_marks:]
        start = np.empty(len(words), np.int64)
        start[is_plain] = np.cumsum(size[is_plain]) - size[is_plain]
        start[~is_plain] = len(made) + rest_start[n_marks:]
        return np.concatenate([made, rest]), start, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        if not self.by_word:
            return self._encode(texts.to_pylist())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        flat, start, size = self._words(words.dictionary)
        place = words.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(size[place])])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return gathered(flat, start[place], size[place]), np.diff(upto[ends])


def with_end(ids: np.ndarray, size: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids and then ``end_id``."""
    out = np.full(len(ids) + len(size), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
    return out, size + 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, one text at least."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield texts.slice(at, end - at)
        at = end


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, ident: str = "doc_id", text: str = "text", end_id: int = END_ID, by_word: bool = True, special: bool = True,
    keep: int = WORDS_KEPT,
) -> DataFrame:
    """Writes the ids of all documents in ascending order of ``ident``; returns the table of parts.

    Null texts are empty (only the end id), null ids come first, rows equal in id and text follow
    each other, an empty table makes a folder without parts; other columns play no part. Documents
    are dealt by range of (id, text hash, place in the input), so that no repeated id fills a task.
    Each task writes files of a name of its own and only those that the committed ``docs`` table
    names count, so a task that is lost or runs twice does no harm. Then the bases of all parts,
    prefix sums over the table of parts, are added to their offsets.
    """
    spark, path = docs.sparkSession, local_path(folder)
    os.makedirs(path, exist_ok=True)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = packed(docs, ident, text).select("id", "th", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("told"))
    ordered = base.repartitionByRange(width, "id", "th", "told").sortWithinPartitions("id", "th", "told").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(tokenizer, by_word, special, keep), TaskContext.get().partitionId()
        vocabulary = max(encode.tokenizer.get_vocab_size(), end_id + 1)
        kind, name = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4"), f"part-{part:06d}-{uuid.uuid4().hex}"
        sizes, place = [np.zeros(1, "<u8")], 0
        with open(f"{path}/{name}.ids", "wb") as file:
            for b in batches:
                for texts in chunks(b.column(1)):
                    ids, size = with_end(*encode(texts), end_id)
                    file.write(ids.astype(kind).tobytes())
                    sizes.append(size.astype("<u8"))
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), b.column(0)], names=["part", "file", "place", "id"])
                place += n
            if not place:
                os.remove(file.name)
        if place:
            np.cumsum(np.concatenate(sizes), dtype="<u8").tofile(f"{path}/{name}.local")

    id_type = ordered.schema["id"].dataType.simpleString()
    ordered.mapInArrow(run, f"part int, file string, place long, id {id_type}").write.parquet(f"{folder}/docs")
    found = spark.read.parquet(f"{folder}/docs").groupBy("part", "file").agg(F.count("*").alias("n_docs"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = [int(np.memmap(f"{path}/{f}.local", "<u8", "r")[-1]) for f in b.column(1).to_pylist()]
            wide = [os.path.getsize(f"{path}/{f}.ids") // t for f, t in zip(b.column(1).to_pylist(), total)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.int64()), pa.array(wide, pa.int32())], names=["part", "file", "n_docs", "n_tokens", "id_bytes"])

    sized = found.mapInArrow(counted, "part int, file string, n_docs long, n_tokens long, id_bytes int")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sized.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/parts")

    def based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = f"{path}/{f}.{uuid.uuid4().hex}"
                (np.fromfile(f"{path}/{f}.local", "<u8") + np.uint64(at)).tofile(own)
                os.replace(own, f"{path}/{f}.offsets")
            yield b

    parts = spark.read.parquet(f"{folder}/parts")
    parts.select("file", "base").repartition(width).mapInArrow(based, "file string, base long").write.format("noop").mode("overwrite").save()
    return parts


class TokenFile:
    """One memory-mapped file of ids with its offsets."""

    def __init__(self, path: str, name: str):
        self.offsets = np.memmap(f"{path}/{name}.offsets", "<u8", "r")
        total = int(self.offsets[-1] - self.offsets[0])
        wide = os.path.getsize(f"{path}/{name}.ids") // total
        self.ids = np.memmap(f"{path}/{name}.ids", f"<u{wide}", "r")

    def __getitem__(self, place: int) -> np.ndarray:
        first = int(self.offsets[0])
        return self.ids[int(self.offsets[place]) - first : int(self.offsets[place + 1]) - first]


def _from_files(spark: SparkSession, folder: str, work: Callable[[np.ndarray], object], name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    docs, path = spark.read.parquet(f"{folder}/docs"), local_path(folder)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_name = None, None
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                piece = b.slice(at, 1_000)
                start, size, made = [], [], []
                for f, place in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if f != open_name:
                        file, open_name = TokenFile(path, f), f
                    ids = file[place]
                    start.append(int(file.offsets[place]))
                    size.append(len(ids))
                    made.append(work(ids))
                yield pa.RecordBatch.from_arrays([piece.column(2), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(made, arrow)], names=["id", "start", "n_tokens", name])

    return docs.select("file", "place", "id").mapInArrow(run, f"id {id_type}, start long, n_tokens long, {name} {kind}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, read from the files; ``start`` counts all ids before it."""
    return _from_files(spark, folder, lambda ids: ids.astype(np.int64), "ids", "array<long>", pa.list_(pa.int64()))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): the crc32 of each document's ids as little-endian uint32, read from the files."""
    return _from_files(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", "long", pa.int64())


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
