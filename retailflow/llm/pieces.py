"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retailflow.llm.common import numbered, tidy, without

#: Chunks a task's table holds before it starts anew, and their characters.
TABLE_CHUNKS, TABLE_CHARS = 300_000, 8 << 20
#: Characters of the texts that are put through the table together.
BLOCK_CHARS = 2 << 20
MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")


class ChunkTable:
    """Ids and decoded text of each distinct chunk, a run of markers with the word after it.

    A vocabulary qualifies if no piece has a marker after another character: no merge then
    crosses a chunk's start, so the ids of a text are those of its chunks in turn. The model must
    put a marker in front of a text and leave it otherwise as it is.
    """

    def __init__(self, model_file: str, most: int = TABLE_CHUNKS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.most = most
        self.clear()
        spec = proto.ModelProto.FromString(self.library.serialized_model_proto())
        normalizer = spec.normalizer_spec
        plain = (normalizer.add_dummy_prefix and normalizer.escape_whitespaces and not normalizer.precompiled_charsmap
                 and not normalizer.remove_extra_whitespaces and not spec.denormalizer_spec.precompiled_charsmap)
        own = spec.trainer_spec.model_type == proto.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
        crossing = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        if crossing or not plain or not own:
            raise ValueError("pieces of this model may cross the start of a marked word")

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.decoded: list[str] = []
        self.altered = np.zeros(0, bool)

    def add(self, chunks: list[str]) -> None:
        """Segment new chunks, each once; a chunk begins with its marker as a space."""
        ids = self.library.encode([c[1:] for c in chunks], num_threads=1)
        # The library adds no marker to an empty text, so the lone marker is cut from a longer one.
        ids = [own if chunk != " " else self.library.encode("\n", num_threads=1)[:1] for chunk, own in zip(chunks, ids)]
        # Where a chunk decodes to itself, as nearly all do, its text is kept once.
        decoded = [c if c == " " or c[1:] == t else " " + t for c, t in zip(chunks, self.library.decode(ids))]
        first = len(self.index)
        self.chars += sum(map(len, chunks))
        self.index.update(zip(chunks, range(first, first + len(chunks))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.decoded += decoded
        self.altered = np.concatenate([self.altered, np.array([c != d for c, d in zip(chunks, decoded)], bool)])

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.index) > self.most or self.chars > TABLE_CHARS:
            self.clear()
        flat = list(chain.from_iterable(texts))
        missing = list(dict.fromkeys(c for c in flat if c not in self.index))
        if missing:
            self.add(missing)
        return np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))


def chunks_of(text: str) -> list[str]:
    if not text:
        return []
    marked = " " + text.replace(MARK, " ")
    if "  " in marked or marked[-1] == " ":
        return _CHUNK.findall(marked)
    return [" " + w for w in marked[1:].split(" ")]


def encode_block(table: ChunkTable, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(ids of all texts, offsets, decoded texts)."""
    chunks = [chunks_of(t) for t in texts]
    counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
    codes = table.codes(chunks)
    starts, lengths = table.offsets[codes], table.offsets[codes + 1] - table.offsets[codes]
    first = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(lengths)])
    offsets = total[first]
    ids = table.ids[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
    odd = np.concatenate([[0], np.cumsum(table.altered[codes])])[first]
    decoded = []
    for i, text in enumerate(texts):
        if odd[i] == odd[i + 1]:
            decoded.append(text.replace(MARK, " "))
        else:
            decoded.append("".join([table.decoded[c] for c in codes[first[i]:first[i + 1]]])[1:])
    if end_id is not None:
        ids = np.insert(ids, offsets[1:], end_id)
        offsets = offsets + np.arange(len(offsets))
    return ids, offsets, decoded


#: One table per process and model, for callers whose tasks are short: those that follow each other on a worker share it.
_TABLES: dict[tuple, ChunkTable] = {}


def shared_table(model_file: str, most: int) -> ChunkTable:
    if (model_file, most) not in _TABLES:
        _TABLES[model_file, most] = ChunkTable(model_file, most)
    return _TABLES[model_file, most]


def blocks_of(texts: list[str], most_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of at most so many characters, or one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(text) + 64
    if start < len(texts):
        yield start, len(texts)


def blocks_of_array(texts: pa.Array, most_bytes: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of at most so many bytes, or one text, without making Python strings of all."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right")))
        yield start, stop
        start = stop


def encode(docs: DataFrame, model_file: str, text: str = "text", add_end: bool = True, decoded: bool = True,
           table_chunks: int = TABLE_CHUNKS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded``, the text that the ids stand for.

    Ids are those of the library for the whole text, with an end id last if ``add_end``. Null
    counts as empty; an empty text has only the end id and decodes to an empty text. Input
    columns named like the results are replaced, others pass through, repeated rows are kept;
    without ``keep_text`` the text itself doesn't come back from the workers.

    The table is local to a task: it fills from the texts met there, each distinct chunk being
    segmented once, and starts anew beyond ``table_chunks`` chunks or 8 million characters, so long runs without a
    space don't swell it. Ids come back to their places by position. Nothing shuffles: a table for the whole
    corpus would need a join of every word's position. A worker holds one batch of texts and makes strings and ids of 2 MB
    of it at a time. ``model_file`` must exist on each executor.
    """
    docs = without(docs, "ids", "decoded")
    at = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file, table_chunks)
        end_id = table.library.eos_id() if add_end else None
        for batch in batches:
            for start, stop in blocks_of_array(batch.column(at)):
                part = batch.slice(start, stop - start)
                ids, offsets, back = encode_block(table, [t or "" for t in part.column(at).to_pylist()], end_id)
                arrays = [part.column(i) for i in kept]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                if decoded:
                    arrays.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([docs.schema.fields[i] for i in kept]).add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")
    names = schema.fieldNames()
    return numbered(docs).mapInArrow(tidy(run), schema)
