"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker. Where no piece of the model has a
marker after another character, no merge crosses the border of two chunks, so a text's ids are the ids of its
chunks in order. A task cuts its texts into chunks, segments every chunk that its table does not hold yet (each
distinct one once, all together), and joins the ids back to the texts by position. The table is given up when it
holds more than TABLE_CHARS characters, so memory is bounded whatever the corpus holds; nothing is shuffled.

The model file is read on the driver, checked for the property above, and broadcast (about half a megabyte). Its
unpacked form lives in the tasks only.

Defined cases: null and empty texts have no ids and decode to the empty text; null ids decode to null; blanks and
the marker character U+2581 are the same to the library, so they are here; an empty table gives no rows; other
columns pass through, one of the name asked for is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwire.llm.common import give_back, small_batches

MARK = "▁"
CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")
#: Characters of distinct chunks a task remembers; about 100 bytes of memory each chunk of ten.
TABLE_CHARS = 4_000_000
#: Characters of text cut into chunks at once.
SLICE_CHARS = 1_000_000
PROBES = ("a", "  two  blanks ", "line\nline\tend", "▁mark ▁▁ é中\U0001f600 <s> <0x41> x</s>", "a" * 70 + " b" * 9, "end ")


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def cut(text: str) -> list[str]:
    """The chunks of a text, each without its first marker. Where every marker stands alone, the blanks part them."""
    if not text:
        return []
    if text[0] == " " or "  " in text or MARK in text:
        return CHUNK.findall(MARK + text.replace(" ", MARK))
    return text.split(" ")


def segment(processor, chunks: list[str]) -> list[list[int]]:
    """The ids of each chunk. The library puts the first marker before what it is given; it adds none to an empty
    text, so a lone marker is looked up."""
    found = processor.encode(chunks, num_threads=1)
    alone = [processor.piece_to_id(MARK)]
    return [ids if chunk else alone for chunk, ids in zip(chunks, found)]


def check_model(model: bytes) -> None:
    """Raise ValueError for a model whose pieces may cross chunks, or that changes texts before it cuts them."""
    processor = load(model)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    pieces = (processor.id_to_piece(n) for n in range(processor.get_piece_size()))
    found = next(filter(crossing.search, pieces), None)
    if found is not None:
        raise ValueError(f"piece {found!r} crosses a whitespace marker")
    for probe in PROBES:
        if processor.encode(probe) != list(chain.from_iterable(segment(processor, cut(probe)))):
            raise ValueError(f"the model does not encode {probe!r} chunk by chunk")


def _chars(chunks: Collection[str]) -> int:
    """Characters of the chunks, their first markers included."""
    return len(chunks) + sum(map(len, chunks))


class ChunkTable:
    """Distinct chunks and their ids, packed as 32-bit integers."""

    def __init__(self, model: bytes, chars: int = TABLE_CHARS):
        self.processor, self.chars = load(model), chars
        self.ids: dict[str, bytes] = {}
        self.held = self.segmented = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        placed = [cut(t) for t in texts]
        distinct = set().union(*placed)
        new = distinct.difference(self.ids)
        if self.held and self.held + _chars(new) > self.chars:
            self.ids, self.held = {}, 0
            new = distinct
        self._segment(list(new))
        at = self.ids.__getitem__
        return [b"".join(map(at, chunks)) for chunks in placed]

    def _segment(self, chunks: list[str]) -> None:
        if not chunks:
            return
        found = segment(self.processor, chunks)
        packed = array("i", chain.from_iterable(found)).tobytes()
        ends = np.cumsum([4 * len(ids) for ids in found]).tolist()
        self.ids.update(zip(chunks, (packed[a:b] for a, b in zip([0, *ends], ends))))
        self.held += _chars(chunks)
        self.segmented += len(chunks)


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for each in texts:
        held.append(each.as_py())
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    yield held


def _shared(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    with open(path, "rb") as file:
        model = file.read()
    check_model(model)
    return df.sparkSession.sparkContext.broadcast(model)


def encode(df: DataFrame, text: str, model: str, name: str = "ids") -> DataFrame:
    """Add ``name``: the ids (array of int) the library's encode gives for ``text``, without begin and end ids.
    ``model`` is the path of a model file on the driver."""
    shared = _shared(df, model)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(shared.value)
        for batch in batches:
            packed = [ids for texts in _slices(batch) for ids in table.encode(texts)]
            ends = np.cumsum([0, *[len(ids) // 4 for ids in packed]]).astype("i4")
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.ListArray.from_arrays(pa.array(ends), values)
        table = None
        give_back()

    return df.withColumn(name, ids_of(F.coalesce(F.col(text), F.lit(""))))


def id_lists(rows: pa.Array) -> Iterator[list[int] | None]:
    """The ids of each row, a null row's are None. A row's values become numbers at once: a scalar object for each
    id took several times what the library takes to decode them."""
    ends, values = rows.offsets.to_numpy(), rows.values.to_numpy()
    for there, a, b in zip(rows.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
        yield values[a:b].tolist() if there else None


def decode(df: DataFrame, ids: str, model: str, name: str = "decoded") -> DataFrame:
    """Add ``name``: the text the library's decode gives for ``ids``."""
    shared = _shared(df, model)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = load(shared.value)
        for batch in batches:
            yield pa.array([None if row is None else processor.decode(row) if row else "" for row in id_lists(batch)], pa.string())
        processor = None
        give_back()

    return df.withColumn(name, text_of(F.col(ids)))
