"""Language ID by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.arrow_rows import built_once, slices
from threadloom.llm.registry import documents, query
from threadloom.session import ship_package

UNKNOWN = "und"
SAMPLE_DOCS, SAMPLE_CHARS = 100, 4000  # per language: so many documents, those of at most so many characters first
DICTIONARY_BYTES = 100 << 10
BLOCK_BYTES, LEVEL = 1024, 9
MIN_MARGIN = 0.005
NOT_LETTERS = regex.compile(r"\P{L}+")  # numeric signs such as one half or a Roman numeral are no letters


def plain(text: str) -> bytes:
    """Lower-case words with single spaces between: case, digits and signs say little about a language."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """One raw-content dictionary per value of ``lang_col``, from a bounded sample of ``docs``.

    Per language ``SAMPLE_DOCS`` rows in the order of a hash of the id, short ones first, then of a checksum of the
    text; their words up to ``DICTIONARY_BYTES``. Ids are ranked without texts, and a rank limit before the shuffle
    keeps a common language from gathering in one task. Repeated rows count once, texts that share an id each by
    itself. Rows with a NULL text or language are left out. Per language at most ``SAMPLE_DOCS`` texts, cut to
    ``DICTIONARY_BYTES`` characters, come to the driver.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        F.xxhash64(text_col).alias("checksum"))
    place = [F.char_length("text") > SAMPLE_CHARS, F.md5(F.col("id").cast("string")), F.col("id"), F.col("checksum")]
    order = Window.partitionBy("lang").orderBy(*place)
    chosen = labelled.withColumn("n", F.row_number().over(order)).where(
        F.col("n") <= SAMPLE_DOCS).select("id", "lang", "checksum").distinct()
    rows = labelled.join(F.broadcast(chosen), ["id", "lang", "checksum"]).groupBy(  # at most SAMPLE_DOCS per language
        "lang", "id", "checksum").agg(F.min(F.substring("text", 1, DICTIONARY_BYTES)).alias("text")).orderBy("lang", *place)
    words: dict[str, list[bytes]] = {}
    for row in rows.toLocalIterator():
        words.setdefault(row.lang, []).append(plain(row.text))
    return pickle.dumps({k: b"\n".join(v)[:DICTIONARY_BYTES] for k, v in sorted(words.items())})


class Compressors:
    def __init__(self, model: bytes):
        self.by_lang = {}
        for lang, words in pickle.loads(model).items():
            if len(words) < 8:  # the library takes no shorter dictionary
                words = words.ljust(8)
            dictionary = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK_BYTES, dict_size=len(words),
                write_content_size=0, write_checksum=0, write_dict_id=0)
            dictionary.precompute_compress(compression_params=parameters)
            self.by_lang[lang] = zstandard.ZstdCompressor(
                dict_data=dictionary, compression_params=parameters).compress

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: by how much of the second smallest size the smallest is smaller, 0 to 1."""
        words = plain(text) if text else b""
        if not words or not self.by_lang:
            return UNKNOWN, 0.0
        blocks = [words[i:i + BLOCK_BYTES] for i in range(0, len(words), BLOCK_BYTES)]
        sizes = sorted((sum(map(len, map(compress, blocks))), lang) for lang, compress in self.by_lang.items())
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, model: bytes, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score", rejected_out: str = "rejected", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with predicted language, score, and whether the margin is too narrow to trust it.

    The whole text is compressed in blocks of ``BLOCK_BYTES`` with each language's dictionary; sizes are summed.
    ``und`` with score 0, and rejected, if the text is NULL, empty or has no letter, or nothing was learnt. Equal
    sizes go to the first language by name, with score 0. Columns with the names of the results are replaced, all
    others stay. Rows are independent: no shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast(model)
    names = [lang_out, score_out, rejected_out]
    kept = [c for c in docs.columns if c not in names]

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = built_once(Compressors, shipped.value)
        for rows, texts in slices(batches, text_col):
            found = [compressors.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[0] == UNKNOWN or x[1] < min_margin for x in found], pa.bool_())], [*kept, *names])

    schema = docs.select(*kept).withColumns({
        lang_out: F.lit(None).cast("string"), score_out: F.lit(None).cast("double"),
        rejected_out: F.lit(None).cast("boolean")}).schema
    return docs.select(*kept).mapInArrow(identified, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning. A NULL id is never learnt from and not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_documents(docs: DataFrame) -> bytes:
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))


@query("op10_language_id")
def language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), fit_on_documents(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
