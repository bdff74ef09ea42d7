"""Chunk-wise segmentation against the library on whole texts."""

import hashlib
import random
import time

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwire.llm import queries  # noqa: F401  fills the registry
from groundwire.llm import sentence_pieces
from groundwire.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "▁", " ▁ a▁b ▁", "end ", "\n\n\t x\r\n", "<s> </s> <unk> <0x41>", "\x00a \x00", "é中\U0001f600", "　wide　blank",
    "x" * 3000, " " * 3000 + "y", " ".join(f"w{n % 91}" for n in range(20_000)),
]


@pytest.fixture(scope="module")
def library():
    with open(MODEL, "rb") as file:
        return sentence_pieces.load(file.read())


def test_whole_documents(spark, library):
    texts = pd.read_parquet(f"{SF_DIR}/documents.parquet").set_index("doc_id").text
    got = QUERIES["op13_sentence_pieces"](spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_texts(spark, library):
    given = spark.createDataFrame([(n, t, "mine") for n, t in enumerate([*ODD, ODD[-1]])], "n int, text string, ids string")
    encoded = sentence_pieces.encode(given, "text", MODEL)
    rows = sentence_pieces.decode(encoded, "ids", MODEL).orderBy("n").collect()
    for row, text in zip(rows, [*ODD, ODD[-1]], strict=True):
        assert row.ids == library.encode(text or "") and row.decoded == library.decode(row.ids) and row.text == text
    empty = sentence_pieces.decode(encoded.filter("n < 0"), "ids", MODEL)
    assert empty.collect() == [] and empty.columns == ["n", "text", "ids", "decoded"]
    null = encoded.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))
    assert sentence_pieces.decode(null, "ids", MODEL).first().decoded is None


def test_each_distinct_chunk_is_segmented_once(library):
    with open(MODEL, "rb") as file:
        model = file.read()
    text = " ".join(f"word{n % 50}" for n in range(5_000))
    table = sentence_pieces.ChunkTable(model)
    first, second = table.encode([text, text]), table.encode([text + " new"])
    assert table.segmented == 51 and first[0] == first[1] == second[0][: len(first[0])]
    small = sentence_pieces.ChunkTable(model, chars=40)  # given up again and again, with the same ids
    for part in (text[:300], text[300:900], text):
        assert np.frombuffer(small.encode([part])[0], "i4").tolist() == library.encode(part)


def test_a_model_with_crossing_pieces_is_refused():
    with open(MODEL, "rb") as file:
        model = file.read()
    with pytest.raises(ValueError, match="crosses"):
        sentence_pieces.check_model(model.replace("▁there".encode(), "there▁".encode()))


def test_blanks_and_markers_in_any_order(library):
    with open(MODEL, "rb") as file:
        table = sentence_pieces.ChunkTable(file.read())
    draw = random.Random(13)
    texts = ["".join(draw.choices([" ", "▁", "a", "the", "\n", "é", "　"], k=draw.randint(0, 12))) for _ in range(3_000)]
    for text, packed in zip(texts, table.encode(texts), strict=True):
        assert np.frombuffer(packed, "i4").tolist() == library.encode(text), repr(text)


def test_rows_of_ids():
    rows = [[5, 300], None, [], [31_999, 0, 7]]
    for kind in (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.large_list(pa.int32())):
        given = pa.array(rows, kind)
        assert list(sentence_pieces.id_lists(given)) == rows
        assert list(sentence_pieces.id_lists(given[1:])) == rows[1:] and list(sentence_pieces.id_lists(given[:0])) == []


def test_reading_ids_costs_less_than_decoding_them_twice(library):
    ids = library.encode(" ".join(f"word{n % 911} and then some" for n in range(5_000)))
    rows = pa.array([ids] * 10, pa.list_(pa.int32()))

    def seconds(work):
        spent = []
        for _ in range(3):
            start = time.process_time()
            work()
            spent.append(time.process_time() - start)
        return min(spent)

    read = seconds(lambda: list(sentence_pieces.id_lists(rows)))
    decoded = seconds(lambda: [library.decode(ids) for _ in range(10)])
    assert read < 2 * decoded, (read, decoded)
