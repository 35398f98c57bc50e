"""Token counts of flat, unindexed token files by a scan for separators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from retailflow.llm import pieces
from retailflow.llm.common import data_files, file_system, new_folder, whole_text

#: Tokens are stored as two bytes, the high one first.
TOKEN = np.dtype(">u2")
#: Tokens of one block, the unit that a task scans.
BLOCK_TOKENS = 4 << 20
#: Values from here on are no tokens: five of them in front of a document spell its id, 13 bits
#: each, the sign bit first. The vocabulary must stay below.
ID_BASE = 1 << 15
ID_BITS = 13
ID_WORDS = 5


# --- writing ---------------------------------------------------------------------------------

def id_words(doc_ids: np.ndarray) -> np.ndarray:
    """The words that spell each id, a row per document."""
    bits = doc_ids.astype(np.int64).view(np.uint64)
    shifts = np.arange(ID_WORDS - 1, -1, -1, dtype=np.uint64) * np.uint64(ID_BITS)
    return (((bits[:, None] >> shifts) & np.uint64((1 << ID_BITS) - 1)) + np.uint64(ID_BASE)).astype(TOKEN)


def spelled(words: np.ndarray) -> int | None:
    """The id that five words spell; none if there aren't five."""
    if len(words) != ID_WORDS:
        return None
    value = 0
    for w in words:
        value = (value << ID_BITS) | (int(w) - ID_BASE)
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def write_tokens(docs: DataFrame, folder: str, model_file: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of each document's pieces and the end-of-document id as flat files below ``folder``.

    The files hold nothing but two-byte words. Spark's text writer commits them: a document's last
    byte, the low one of the separator, is its line separator. A null id leaves out the id words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.shared_table(model_file, pieces.TABLE_CHUNKS)
        if table.library.vocab_size() > ID_BASE:
            raise ValueError(f"token ids must be below {ID_BASE}")
        for batch in batches:
            known = batch.column(0).is_valid().to_pylist()
            heads = id_words(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False))
            texts = batch.column(1).to_pylist()
            for start, stop in pieces.blocks_of(texts):
                ids, offsets, _ = pieces.encode_block(table, texts[start:stop], table.library.eos_id())
                data, at = ids.astype(TOKEN).tobytes(), offsets * TOKEN.itemsize
                rows = [(heads[start + i].tobytes() if known[start + i] else b"") + data[at[i]:at[i + 1] - 1]
                        for i in range(stop - start)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    end = separator(model_file) & 0xFF
    if end >= 0x80:
        raise ValueError("the low byte of the separator must be ASCII")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    (plain.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", chr(end)).text(folder))


def separator(model_file: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model_file).eos_id()


# --- scanning --------------------------------------------------------------------------------

@dataclass
class Block(InputPartition):
    path: str
    number: int
    start: int
    tokens: int


@dataclass
class Scanned:
    """What a block says: documents whole within it, and the open pieces at its ends."""

    separators: int
    whole_ids: list
    whole_tokens: list
    head_tokens: int
    head_words: list
    tail_tokens: int
    tail_words: list


def scan(words: np.ndarray, end: int) -> Scanned:
    """Find all separators of a block at once; a block without one is a single open head."""
    words = words.astype(np.uint16)
    ends = np.flatnonzero(words == end)
    named = words >= ID_BASE
    tokens = np.concatenate([[0], np.cumsum(~named)])  # real tokens before each place

    def piece(start: int, stop: int) -> tuple[int, list]:
        return int(tokens[stop] - tokens[start]), words[start:stop][named[start:stop]].tolist()

    if not len(ends):
        return Scanned(0, [], [], *piece(0, len(words)), 0, [])
    starts, stops = ends[:-1] + 1, ends[1:] + 1
    counts = tokens[stops] - tokens[starts]
    with_id = np.flatnonzero(stops - starts - counts == ID_WORDS)
    ids: list = [None] * len(starts)
    if len(with_id):
        at = starts[with_id][:, None] + np.arange(ID_WORDS)
        values = words[at].astype(np.uint64) - np.uint64(ID_BASE)
        bits = np.zeros(len(with_id), np.uint64)
        for k in range(ID_WORDS):
            bits = (bits << np.uint64(ID_BITS)) | values[:, k]
        for i, value in zip(with_id, bits.view(np.int64).tolist()):
            ids[i] = value
    return Scanned(len(ends), ids, counts.tolist(), *piece(0, ends[0] + 1), *piece(ends[-1] + 1, len(words)))


SCANNED = ("file string, block int, separators long, whole_ids array<long>, whole_tokens array<long>, head_tokens long, "
           "head_words array<int>, tail_tokens long, tail_words array<int>")


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.end = options["path"], int(options["separator"])
        self.block_tokens = int(options.get("blocktokens", BLOCK_TOKENS))

    def partitions(self) -> list[Block]:
        blocks = []
        for path, size in data_files(self.path):
            if size % TOKEN.itemsize:
                raise ValueError(f"{path} has half a token")
            for number, start in enumerate(range(0, size // TOKEN.itemsize, self.block_tokens)):
                blocks.append(Block(path, number, start, min(self.block_tokens, size // TOKEN.itemsize - start)))
        return blocks

    def read(self, partition: Block | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in for no partitions
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as f:
            data = f.read_at(partition.tokens * TOKEN.itemsize, partition.start * TOKEN.itemsize)
        s = scan(np.frombuffer(data, TOKEN), self.end)
        yield (partition.path, partition.number, s.separators, s.whole_ids, s.whole_tokens, s.head_tokens, s.head_words,
               s.tail_tokens, s.tail_words)


class TokenSource(DataSource):
    """``spark.read.format("tokens")``: one row per block of flat token files.

    Options: ``separator``, the end-of-document id, and ``blockTokens``. A task reads its block's
    bytes only.
    """

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return SCANNED

    def reader(self, schema) -> TokenReader:
        return TokenReader({k.lower(): v for k, v in self.options.items()})


def count_tokens(spark: SparkSession, folder: str, end: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, document, doc_id, n_tokens) of the flat token files below ``folder``.

    ``document`` numbers a file's documents from 0, ``n_tokens`` counts all ids, the separator
    among them, but no id words; ``doc_id`` is null where the file has none. Tokens after
    the last separator of a file are a document without an end and are counted as one. Equal ids stay
    apart; an empty folder gives no rows.

    Blocks know only how many separators they hold. A prefix sum over a file's blocks gives the
    number of each block's first document; the open pieces at block ends then meet under that number,
    also those of a document longer than several blocks.
    """
    spark.dataSource.register(TokenSource)
    blocks = (spark.read.format("tokens").option("separator", end).option("blockTokens", block_tokens).load(folder))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.withColumn("first", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    whole = (numbered.select("file", "first", F.posexplode(F.arrays_zip("whole_ids", "whole_tokens")).alias("i", "d"))
             .select("file", (F.col("first") + 1 + F.col("i")).alias("document"), F.col("d.whole_ids").alias("doc_id"),
                     F.col("d.whole_tokens").alias("n_tokens")))
    ends = numbered.select("file", "block", F.explode(F.array(
        F.struct(F.col("first").alias("document"), F.col("head_tokens").alias("tokens"), F.col("head_words").alias("words")),
        F.struct((F.col("first") + F.col("separators")).alias("document"), F.col("tail_tokens").alias("tokens"),
                 F.col("tail_words").alias("words")))).alias("p")).select("file", "block", "p.*")
    ends = ends.filter((F.col("tokens") > 0) | (F.size("words") > 0))
    # At most five id words and a block number reach this list from each piece that has any.
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(
        F.size("words") > 0, F.struct("block", "words")))), lambda x: x["words"]))
    stitched = (ends.groupBy("file", "document")
                .agg(F.sum("tokens").alias("n_tokens"), words.alias("words"))
                .select("file", "document", F.when(F.size("words") == ID_WORDS, F.aggregate(
                    "words", F.lit(0).cast("long"),
                    lambda v, w: F.shiftleft(v, ID_BITS).bitwiseOR(w.cast("long") - ID_BASE))).alias("doc_id"), "n_tokens"))
    return whole.unionByName(stitched)


def document_tokens(docs: DataFrame, model_file: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and count them by :func:`count_tokens`; null texts are empty."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    write_tokens(docs, folder, model_file)
    return count_tokens(spark, folder, separator(model_file))
