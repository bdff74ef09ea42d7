"""Images, documents, object layout, access log and chunk store."""

import base64
import json

from pyspark.sql import functions as F

from groundwire.operators.ingestion import ingest_knowledge
from groundwire.sources import access_log, chunk_store, documents, images, objects

PNG = b"\x89PNG\r\n\x1a\n" + b"\x00" * 8
STORED = [
    ("png", PNG, None, "png"), ("jpeg", b"\xff\xd8\xff\xe0", None, "jpeg"),
    ("gif87", b"GIF87a..", None, "gif"), ("gif89", b"GIF89a..", None, "gif"),
    ("webp", b"RIFF\x00\x00\x00\x00WEBPVP8 ", None, "webp"), ("riff", b"RIFF\x00\x00\x00\x00WAVEfmt ", None, "jpeg"),
    ("late mark", b"RIFF" + b"\x00" * 12 + b"WEBP", None, "jpeg"), ("unknown", b"hello", None, "jpeg"),
    ("odd offset", b"RIFF\x05\x74\x54\x25\x05\x00", None, "jpeg"),
    ("declared", PNG, "gif", "gif"), ("empty", b"", None, "jpeg"),
]


def test_stored_image_formats(spark):
    rows = [(n, bytearray(c), d) for n, c, d, _ in STORED]
    df = spark.createDataFrame(rows, "image_id string, content binary, image_format string")
    got = {r.image_id: r.format for r in images.resolve_images(df).collect()}
    assert got == {n: f for n, _, _, f in STORED}


def test_inline_images(spark):
    raw = b"hello-bytes"
    encoded = base64.b64encode(raw).decode()
    rows = [("url", f"data:image/png;base64,{encoded}"), ("plain", f" {encoded}\n"), ("bad", "***"),
            ("png", base64.b64encode(PNG).decode())]
    df = spark.createDataFrame(rows, "image_id string, image_base64 string")
    got = {r.image_id: (r.origin, r.format, r.bytes, r.status) for r in images.resolve_images(df).collect()}
    assert got["url"] == got["plain"] == ("inline", "jpeg", len(raw), "ok")
    assert got["png"] == ("inline", "png", len(PNG), "ok")
    assert got["bad"][3] == "undecodable"


def test_size_limit_and_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big.png").write_bytes(PNG + b"\x00" * 5_000_000)
    (tmp_path / "small.gif").write_bytes(b"GIF89a")
    got = images.image_inventory(images.read_stored_images(spark, str(tmp_path)))
    assert {(r.format, r.status, r.images) for r in got.collect()} == {("png", "too large", 1), ("gif", "ok", 1)}


def test_read_documents_below_prefix(spark, tmp_path):
    for key in ("knowledge/2024/a b+c%20.md", "knowledge/b.md", "other/c.md", "knowledge-base/d.md"):
        path = tmp_path / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of\n{key}")
    got = documents.read_documents(spark, str(tmp_path), "knowledge/").collect()
    assert {r.key: r.text for r in got} == {
        k: f"text of\n{k}" for k in ("knowledge/2024/a b+c%20.md", "knowledge/b.md")
    }
    assert documents.read_documents(spark, str(tmp_path), "know").count() == 3


def test_object_events(spark):
    event = {"Records": [
        {"s3": {"bucket": {"name": "docs"}, "object": {"key": "a%20b.md"}}},
        {"s3": {"bucket": {"name": "docs"}}}, {"s3": {"object": {"key": "x"}}}, {}, {"s3": {"bucket": {"name": ""}, "object": {"key": "y"}}},
    ]}
    df = spark.createDataFrame([(json.dumps(event),), ('{"Records":[]}',), ('{"other":1}',)], "body string")
    assert [r.uri for r in documents.object_events(df).collect()] == ["s3://docs/a%20b.md"]


def test_layout(spark):
    rows = [(1, "/../Report.Final.PDF", "document"), (2, "photo", "upload"), (3, "x/y.tar.GZ", "upload"), (4, ".hidden", "upload")]
    df = spark.createDataFrame(rows, "object_id long, filename string, kind string").withColumn(
        "created", F.lit("2024-03-05 10:00:00").cast("timestamp_ntz"))
    got = objects.layout_objects(df, purpose=F.col("kind")).orderBy("object_id").collect()
    assert got[0].key.startswith("knowledge/2024/03/05/") and got[0].key.endswith(".pdf")
    assert [r.content_type for r in got] == [
        "application/pdf", "application/octet-stream", "application/x-tar", "application/octet-stream"]
    assert got[1].key.startswith("uploads/2024/03/05/") and "." not in got[1].key
    assert got[2].key.endswith(".gz") and got[3].key.endswith(".hidden")
    assert [r.bucket for r in got] == ["documents", "uploads", "uploads", "uploads"]


def test_layout_sink_is_partitioned_by_day(spark, tmp_path):
    df = spark.range(10).select("id", (F.lit("2024-03-05").cast("date") + (F.col("id") % 2).cast("int")).cast("timestamp_ntz").alias("created"))
    path = str(tmp_path / "layout")
    objects.write_layout(df, path, "a")
    objects.write_layout(df, path, "a")
    back = spark.read.parquet(path)
    assert back.count() == 10 and {(r.year, r.month, r.day) for r in back.select("year", "month", "day").collect()} == {(2024, 3, 5), (2024, 3, 6)}


def test_lookup(spark):
    refs = spark.createDataFrame([("docs", "a"), ("docs", "b"), ("secret", "a")], "bucket string, key string")
    inventory = spark.createDataFrame([("docs", "a", "text/plain", 3, "aws:kms"), ("secret", "a", "x", 1, "x")],
                                      "bucket string, key string, content_type string, content_length long, sse string")
    got = objects.lookup_objects(refs, inventory, ["docs"]).orderBy("bucket", "key").collect()
    assert [(r.status, r.content_length) for r in got] == [("ok", 3), ("not found", None), ("bucket not allowed", None)]


ROUTES = [
    ("post", "/prod/v1/query/", "prod", "POST /v1/query", "query"), ("GET", "/v1/health", "prod", "GET /v1/health", "query"),
    (None, None, None, "GET /", "unknown"), ("get", "///", "", "GET /", "unknown"), ("options", "/x", "prod", "OPTIONS /x", "preflight"),
    ("post", "/production/ingest", "prod", "POST /production/ingest", "unknown"), ("post", "/prod/ingest", "prod", "POST /ingest", "ingest"),
    ("get", "/prod", "prod", "GET /prod", "unknown"),
]


def test_routes(spark):
    rows = [(n, m, p, s, 200) for n, (m, p, s, _, _) in enumerate(ROUTES)]
    df = spark.createDataFrame(rows, "n int, method string, path string, stage string, status long")
    got = access_log.with_routes(df).orderBy("n").collect()
    assert [(r.route, r.service) for r in got] == [(r, s) for *_, r, s in ROUTES]
    assert [r.outcome for r in got if r.service == "unknown"] == [404] * 4


def test_upsert_is_idempotent_and_keeps_removed_sources(spark, tmp_path):
    path = str(tmp_path / "store")

    def ingest(*rows):
        docs = spark.createDataFrame([(f"s3://d/{n}", "knowledge/", t, 1) for n, t in rows], "uri string, key string, text string, version int")
        ingest_knowledge(docs, path, None)
        return sorted((r.uri, r.text) for r in chunk_store.read_chunks(spark, path).collect())

    assert chunk_store.read_chunks(spark, path) is None
    assert ingest((1, "a b c"), (2, "d e")) == [("s3://d/1", "a b c"), ("s3://d/2", "d e")]
    every = [("s3://d/1", "a b c"), ("s3://d/2", "d e"), ("s3://d/3", "f")]
    assert ingest((2, "d e"), (3, "f"), (3, "f")) == every and ingest((3, "f")) == every
    live = spark.createDataFrame([("s3://d/2",), ("s3://d/3",)], "uri string")
    assert [r.uri for r in chunk_store.stale_chunks(chunk_store.read_chunks(spark, path), live).collect()] == ["s3://d/1"]



def test_latest_chunk_wins(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "chunk_id string, version int, text string")
    assert {r.chunk_id: r.text for r in chunk_store.latest_chunks(df, "version").collect()} == {"a": "new", "b": "only"}


def test_documents_at_the_root_of_a_bucket(spark, tmp_path):
    """Keys are cut from the whole root, not from its path found anywhere: a file system whose root is a bucket."""
    from groundwire.sources.documents import read_documents

    for key in ("knowledge/a b+c.md", "knowledge/knowledge/x.md", "private/y.md"):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_text(f"text of {key}")
    settings = spark._jsc.hadoopConfiguration()
    for folder in ("knowledge", "private"):
        settings.set(f"fs.viewfs.mounttable.bucket.link./{folder}", f"file://{tmp_path}/{folder}")
    for root in ("viewfs://bucket", "viewfs://bucket/", str(tmp_path), f"file://{tmp_path}/"):
        got = {r.key: r.text for r in read_documents(spark, root).collect()}
        assert got == {k: f"text of {k}" for k in ("knowledge/a b+c.md", "knowledge/knowledge/x.md")}
    inner = {r.key for r in read_documents(spark, "viewfs://bucket/knowledge").collect()}
    assert inner == {"knowledge/x.md"}
