"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import base64
import hashlib
import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundwire.llm import (
    byte_bpe, chat, common, fingerprints, language, line_dedup, minhash_links, quality, source_mix, vector_links, warc,
)
from groundwire.llm.queries import bpe_files

# the names the operators use inside, as columns of the caller
CLASH = ["place", "_id", "_key", "node", "key", "size", "part", "n", "kept_bits", "keep_bitmap", "token_ids", "_words", "_part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{n % 977} tail{n}" for n in range(12_000))


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blanks, one word, a very long text, a tie and a repeated row."""
    return documents(spark, [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, "one", "fr", "b"), (None, "lost id here", "en", "a"),
        (5, LONG, "en", "a"), (6, LONG, "en", "b"), (7, "same words in this text\nand one more line", "en", "a"),
        (7, "same words in this text\nand one more line", "en", "a"), (8, "same words in this text\nand one more line", "en", None),
        (9, "12345 67 !!!", None, None),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def rows_by(df, *columns):
    return sorted(((tuple(r[c] for c in columns)) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


def test_fingerprints(odd, none):
    got = fingerprints.fingerprints(odd).withColumns({
        "hex": fingerprints.as_hex("fingerprint"), "near": fingerprints.likeness("fingerprint", "next_fingerprint"),
        "own": fingerprints.likeness("fingerprint", "fingerprint"),
    }).collect()
    assert len(got) == 11 and all(r.own == 1 and 0 <= r.near <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].hex == by[2].hex == by[3].hex == "" and by[1].near == 1 and by[3].near == 0
    assert by[5].hex == by[6].hex != "" and by[5].near == 1
    assert by[4].edited == "o" + "n" + LONG[:1] and by[9].edited == "12345 67 !!!"[:6] + "lost i"
    assert fingerprints.fingerprints(none).collect() == []


def test_line_dedup(odd, none):
    kept = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd))
    assert kept.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert rows_by(kept, "doc_id", "n_lines", "n_dropped") == [
        (None, 1, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 1, 0), (6, 1, 1), (7, 2, 0), (7, 2, 0), (8, 2, 2), (9, 1, 0)]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] is None and texts[6] == texts[8] == "" and texts[5] == LONG
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).collect() == []


def test_language(odd, none):
    model = language.fit(odd, "text", "lang")
    assert model.languages == ("en", "fr")
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(odd, "text", model).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (9, "und", False), (5, "en", True), (4, "fr", True)} <= got
    assert language.predict(none, "text", language.fit(none, "text", "lang")).collect() == []
    assert {r.lang_pred for r in language.predict(odd, "text", language.fit(none, "text", "lang")).collect()} == {"und"}


def test_source_mix(odd, none):
    got = source_mix.mix(odd)
    assert got.count() == 11 and got.filter("taken > 2 * size").count() == 0
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[1, "a"].size == by[2, "a"].size == 0 and by[1, "a"].taken == 0
    assert by[9, None].source_size == 3 + 9 and by[9, None].target == 24.0
    assert [r.taken for r in got.filter("doc_id = 7").collect()] == [by[7, "a"].taken] * 2
    mixed = source_mix.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in got.collect())
    assert source_mix.mix(none).collect() == [] and source_mix.mixed_documents(none).collect() == []


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 0, None, None), (None, 2, "user", "x"), (2, None, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert [got[k].n_turns for k in (1, None, 2)] == [3, 1, 1]
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\n\n\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert got[2].loss_chars == len(LONG) and got[None].loss_chars == 0
    assert chat.digests(chat.format_turns(turns.limit(0))).collect() == []


def test_byte_bpe(odd, none):
    files = bpe_files()
    encoded = byte_bpe.encode(odd, "text", **files)
    assert encoded.columns == odd.columns
    decoded = byte_bpe.decode(encoded, "token_ids", files["vocabulary"]).collect()
    assert all(r.decoded.decode() == (r.text or "") for r in decoded)
    assert byte_bpe.encode(none, "text", **files).collect() == []
    some = byte_bpe.decode(odd.select(F.lit(None).cast("binary").alias("token_ids")), "token_ids", files["vocabulary"])
    assert {r.decoded for r in some.collect()} == {None}


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (9, 0), (4, 0), (9, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(odd, labels)
    assert got.count() == 11 and got.filter("quality_score IS NULL OR kept IS NULL").count() == 0
    assert len({r.quality_score for r in got.filter("doc_id = 7").collect()}) == 1
    assert quality.without_rejected(odd, labels).columns == odd.columns
    unlearned = quality.score(odd, labels.limit(0))
    assert {(r.evidence, r.kept) for r in unlearned.collect()} == {(0.0, True)}
    assert quality.score(none, labels).collect() == [] and quality.without_rejected(none, labels).collect() == []


def test_warc(spark, tmp_path):
    rows = [
        (1, "http://a b\r\n", "x\r\n\r\nWARC/1.1\r\ny"), (5, None, None), (3, "u", ""), (3, "u", ""), (None, "u", ""),
        (0, "z", "x\r\n\r\nWARC/1.1\r\ny"), (7, "é", "é漢\x00" * 1000), (8, "q", "\r\n\r\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("records", F.lit("r"))
    warc.write(pages, str(tmp_path / "w"))
    read = warc.captures(warc.read(spark, str(tmp_path / "w")))
    got = {r.metadata["fields"]["page-id"]: r for r in read.collect()}
    assert sorted(got) == ["", "0", "1", "3", "5", "7", "8"]
    assert {k: r.response.record_type for k, r in got.items()} == {
        "": "revisit", "0": "response", "1": "revisit", "3": "response", "5": "revisit", "7": "response", "8": "response"}
    assert got["1"].response.refers_to == got["0"].capture_id and got["5"].response.refers_to == got["3"].capture_id
    assert got["0"].response.payload == rows[5][2] and got["7"].response.payload == rows[6][2] and got["8"].response.payload == "\r\n\r\n"
    assert got["1"].request.target == got["1"].response.target == "http://a%20b%0D%0A" and got["5"].request.target is None
    digest = base64.b32encode(hashlib.sha1(rows[5][2].encode()).digest()).decode()
    assert got["1"].response.payload_digest == got["0"].response.payload_digest == f"sha1:{digest}"
    marked = {r.metadata["fields"]["page-id"]: r.original for r in warc.with_originals(read).collect()}
    assert {k for k, o in marked.items() if o} == {"", "1", "5"}
    assert (marked["1"].capture_id, marked["1"].payload_bytes) == (got["0"].capture_id, len(rows[5][2]))
    assert marked["1"].fields["page-id"] == "0" and marked[""].payload_bytes == 0
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.captures(warc.read(spark, str(tmp_path / "e"))).collect() == []


def test_minhash_links(odd, none):
    got = minhash_links.near_duplicates(odd)
    assert rows_by(got, "doc_id", "n_shingles", "component_id", "kept") == [
        (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 23_998, 5, True),
        (6, 23_998, 5, False), (7, 7, 7, True), (7, 7, 7, True), (8, 7, 7, False), (9, 1, 9, True)]
    kept = minhash_links.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert minhash_links.near_duplicates(none).collect() == []


def test_vector_links(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.1], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [1.0, None], 1), (9, [1.0, nan], 1), (10, [1.0, inf], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (13, [1.0, 0.2027], 1),
        (14, [1.0, 0.2031], 1), (3, [2.0, 0.0], 1), (15, [1e-30, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(0))
    got = vector_links.near_duplicates(df)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert got.count() == 16
    assert by[1] == (4, 1, True) and by[2] == by[3] == by[15] == (4, 1, False)
    assert by[13] == (5, 1, False) and by[14] == (1, 1, False)  # 14 is too far from 1, but near 13
    assert all(by[n] == (0, n, True) for n in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert vector_links.near_duplicates(df.limit(0)).collect() == []


def test_running_total_and_components(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").alias("u"), F.lit(2).alias("v"))
    got = common.running_total(df, [F.col("g").asc(), F.col("u").asc()], "v", "t").orderBy("g", "u").collect()
    assert [r.t for r in got] == [2 * (n + 1) for n in range(1000)]
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1400).select(F.lit(1400).cast("long").alias("a"), F.col("id").alias("b"))
    found = common.components(chain.unionByName(star), "a", "b").collect()
    assert {r.node: r.component for r in found} == {**{n: 0 for n in range(301)}, **{n: 1000 for n in range(1000, 1401)}}
    assert common.components(chain.limit(0), "a", "b").collect() == []
    assert json.dumps(public_tokenizers.PATTERN)


def test_broken_references_give_nothing(spark, tmp_path):
    """Rows come from the records: a revisit whose reference leads nowhere has neither page nor payload."""
    from groundwire.llm.queries import warc_rows

    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "other")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    columns = ("page_id", "record_type", "payload_bytes", "refers_to")
    assert rows_by(warc_rows(records), *columns) == [(1, "response", 4, None), (2, "revisit", 4, 1), (3, "response", 5, None)]
    for broken in (F.lit("<urn:uuid:none>"), F.lit(None).cast("string")):
        odd = records.withColumn("refers_to", F.when(F.col("refers_to").isNotNull(), broken))
        got = rows_by(warc_rows(odd), *columns, "payload_digest")
        assert [r[:4] for r in got] == [(1, "response", 4, None), (2, "revisit", None, None), (3, "response", 5, None)]
        assert got[1][4] is None
    lost = records.filter("NOT (record_type = 'response' AND target = 'a')")
    assert rows_by(warc_rows(lost), *columns) == [(2, "revisit", None, None), (3, "response", 5, None)]


def test_large_pages_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_PAGE", 1000)
    rows = [(n, f"u{n}", "x" * (9000 + n) if n % 4 == 0 else f"page {n}") for n in range(40)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    read = warc.captures(warc.read(spark, str(tmp_path / "w")))
    assert {int(r.metadata["fields"]["page-id"]): r.response.payload for r in read.collect()} == {n: html for n, _, html in rows}
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 11
