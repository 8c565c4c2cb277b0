"""Token ids to binary files and back: ordered by document, entropy-coded in independent blocks."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.ans import TokenFile, encode_file
from threadloom.llm.arrow_rows import built_once, file_broadcast, forget_built, slices
from threadloom.llm.chunks import LONGEST, OTHER_SPACE, RUNS
from threadloom.llm.prefix_sums import PART, sums_before
from threadloom.llm.registry import documents, query
from threadloom.llm.token_counts import byte_letters
from threadloom.session import new_path, stage_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
FILE_IDS = 2 << 20  # a file is closed at the end of the document that passes this
SLICE_ROWS = 1024  # texts encoded together, of some megabytes in all
KEPT = 120_000  # pieces of a generation
# Characters that are letters, digits or signs in every Unicode version, and no apostrophe, which begins contractions.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
WELL_KNOWN = re.compile(f"(?: ?[{LETTERS}0-9{SIGNS}])?[{LETTERS}0-9{SIGNS}\n]*").fullmatch
MATCHES = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\n+(?!\S)|\n+").findall
LETTER_OF = byte_letters()
SPACE = LETTER_OF[ord(" ")]
# In a text of these characters alone, runs of signs and line feeds are matches of their own. Of three line feeds, or
# of two at the end, some are one match.
ODD, APART = rf"[^ {LETTERS}0-9{SIGNS}\n]|\n\n\n|\n\n\z", rf"( ?[{SIGNS}]+|\n)"
UNCUT = "|".join([f"[{OTHER_SPACE}]", *RUNS])


class LibraryEncoder:
    """The tokenizers library, asked once for what repeats.

    A text is cut before each single space (see ``chunks``), and most around signs and line feeds; the pieces of a slice of texts are told apart by Arrow, and
    their ids are gathered by one ``take``. A new piece of well-known characters is cut into the matches of the
    byte-level pre-tokenizer, and the library's model merges each match; any other piece goes to the library as it is, and so
    does a whole text that can't be cut or has a special string, or every text if the file pre-tokenizes in another way.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merged = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        splits = self.tokenizer.pre_tokenizer
        self.cuts = (self.tokenizer.normalizer is None and isinstance(splits, pre_tokenizers.ByteLevel)
                     and splits.use_regex and not splits.add_prefix_space)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, piece: str) -> bytes:
        word = piece.removeprefix(" ")
        if word.isascii() and word.isalpha():
            return self._match(piece.replace(" ", SPACE))
        if not WELL_KNOWN(piece):
            return self._whole(piece)
        matches = MATCHES(piece)
        if len(matches) != 1:
            return b"".join(map(self._known, matches))
        return self._match(piece.encode().decode("latin-1").translate(LETTER_OF))

    def _match(self, spelt: str) -> bytes:
        return array("I", [t.id for t in self.merged(spelt)]).tobytes()

    def _known(self, piece: str) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self._new(piece)
            if len(piece) <= LONGEST:
                self.young[piece] = ids
        return ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, UNCUT)
        for mark in self.special:
            whole = pc.or_(whole, pc.match_substring(column, mark))
        whole = whole.to_pylist() if self.cuts else [True] * len(texts)
        column = column.filter(pa.array([not w for w in whole], pa.bool_()))
        column = pc.if_else(pc.match_substring_regex(column, ODD), column, pc.replace_substring_regex(
            column, APART, "\t\\1\t"))
        pieces = pc.split_pattern(pc.replace_substring(column, " ", "\t "), "\t")  # no text to cut has a tab
        coded = pieces.flatten().dictionary_encode()
        ids = pa.array(list(map(self._known, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.large_binary()).take(coded.indices)
        if len(self.young) >= KEPT:  # frequent pieces come back from the old generation
            self.old, self.young = self.young, {}
        _, places, content = ids.buffers()
        places = np.frombuffer(places, np.int64)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        offsets = pieces.offsets.to_numpy()
        bounds = places[offsets - offsets[0]].tolist()
        content = memoryview(content or b"")
        cut = (bytes(content[a:b]) for a, b in zip(bounds, bounds[1:]))
        return [self._whole(t) if w else next(cut) for t, w in zip(texts, whole, strict=True)]


def _put(folder: str, name: str, content: bytes) -> None:
    """Write under another name, then move: a repeated or second attempt of a task leaves one whole file."""
    system, path = pafs.FileSystem.from_uri(folder)
    attempt = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as f:
        f.write(content)
    system.move(attempt, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents, each closed by ``end_id``, into files in ascending order of ``id_col``.

    The texts are dealt out by range of the id, one shuffle; each task encodes its range in order and writes files
    of about ``file_ids`` ids, each with its own table of frequencies, so memory is bounded by that (or by one
    document). Returns and stages one row per file: file, part, number, n_docs, n_ids.

    NULL and empty texts are the end id alone; NULL ids come first; rows with equal ids stand side by side, in the
    order of their texts; no rows give no files. Other columns are not read.
    """
    spark = docs.sparkSession
    content = file_broadcast(spark, vocabulary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    end = np.array([end_id], np.uint32).tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = built_once(LibraryEncoder, content.value)
        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, names, held = [], [], [], 0

        def closed():
            file = f"part-{part:06d}-{number:06d}.ids"
            _put(folder, file, encode_file(np.frombuffer(b"".join(ids), np.uint32), names, lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(names)], pa.int64()), pa.array([held], pa.int64())],
                ["file", PART, "number", "n_docs", "n_ids"])

        for rows, texts in slices(batches, most=SLICE_ROWS):
            encoded = encoder.encode_all([t or "" for t in texts])
            for name, one in zip(rows.column("doc_id").to_pylist(), encoded, strict=True):
                one += end
                ids.append(one)
                names.append(name)
                lengths.append(len(one) // 4)
                held += lengths[-1]
                if held >= file_ids:
                    yield closed()
                    ids, lengths, names, held, number = [], [], [], 0, number + 1
        if names:
            yield closed()

    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))
    return stage_table(ordered.mapInArrow(
        written, f"file string, {PART} int, number int, n_docs long, n_ids long"), "token-files")


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), ids.

    ``files`` are the rows that ``write_token_files`` returned. A file that is cut short or damaged raises.
    """
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_built()  # a worker may come from the writing stage, with all its pieces
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held = TokenFile(content.as_py())
                ids, lengths = held.decode(), held.doc_lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                for at in range(0, len(lengths), 1000):
                    to = min(at + 1000, len(lengths))
                    low = ends[at] - lengths[at]
                    offsets = np.concatenate(([0], ends[at:to] - low)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path.rsplit("/", 1)[1]] * (to - at)),
                        pa.array(held.doc_ids[at:to], pa.int64(), mask=held.doc_null[at:to].astype(bool)),
                        pa.array(ends[at:to] - lengths[at:to]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                            ids[low:ends[to - 1]].astype(np.int32)))], ["file", "doc_id", "place", "ids"])

    starts = sums_before(files, [], ["number"], {"before": F.col("n_ids")}).select("file", "before")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select(
        "path", "content")
    return content.mapInArrow(read, "file string, doc_id long, place long, ids array<int>").join(
        starts, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "ids")


def id_checksums(documents_read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_built()
        for batch in batches:
            ids = batch.column("ids")
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), ids.value_lengths().cast(pa.int64()),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents_read.mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op9_token_files")
def token_files(spark, sf_dir) -> DataFrame:
    folder = new_path(spark, "token-ids")
    return id_checksums(read_token_files(folder, write_token_files(documents(spark, sf_dir), folder)))
