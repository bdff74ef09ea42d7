"""Document scans, chunks, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwire.functions.text import letter_embedder
from groundwire.operators import ingestion, knowledge_index, retrieval, vector_codes, vectors
from groundwire.plans import oracle_views as v
from groundwire.plans.registry import register
from groundwire.plans.workspace import new_folder
from groundwire.sources import adapters, chunk_store, documents, images, objects


@register("read_documents", f"""WITH {v.KNOWLEDGE}
  SELECT doc_id, key, uri, text FROM knowledge_documents WHERE starts_with(key, 'knowledge/')""")
def read_documents(spark, sf_dir):
    return documents.under_prefix(adapters.knowledge_documents(spark, sf_dir)).select("doc_id", "key", "uri", "text")


def notifications(spark, sf_dir):
    """One notification per document; the second record of English ones lacks its key."""
    def record(key):
        return F.struct(F.struct(
            F.struct(F.col("source").alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object"),
        ).alias("s3"))

    doc = F.col("doc_id").cast("string")
    copy = F.when(F.col("lang") != "en", F.concat(F.lit("copies/"), doc))
    return adapters.table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct(F.array(record(doc), record(copy)).alias("Records"))).alias("body")
    )


_EVENTS = """events_found AS (
  SELECT doc_id, source AS bucket, CAST(doc_id AS VARCHAR) AS key FROM documents
  UNION ALL SELECT doc_id, source, 'copies/' || doc_id FROM documents WHERE lang <> 'en')"""


@register("object_events", f"""WITH {_EVENTS}
  SELECT doc_id, bucket, key, 's3://' || bucket || '/' || key AS uri FROM events_found""")
def object_events(spark, sf_dir):
    return documents.object_events(notifications(spark, sf_dir))


@register("count_objects", f"WITH {_EVENTS} SELECT bucket, count(*) AS objects FROM events_found GROUP BY 1")
def count_objects(spark, sf_dir):
    return documents.count_objects(documents.object_events(notifications(spark, sf_dir)))


@register("image_inventory", """WITH stored AS (
    SELECT 'stored' AS origin, CASE page_id%6 WHEN 0 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' ELSE 'jpeg' END AS format,
      octet_length(encode(html)) + CASE page_id%6 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 16 WHEN 4 THEN 4 ELSE 0 END AS bytes
    FROM pages
    UNION ALL SELECT 'inline', CASE WHEN lang = 'en' THEN 'png' ELSE 'jpeg' END, octet_length(encode(text)) FROM documents)
  SELECT origin, format, CASE WHEN bytes > 5000000 THEN 'too large' ELSE 'ok' END AS status, count(*) AS images,
    CAST(sum(bytes) AS BIGINT) AS bytes FROM stored GROUP BY 1, 2, 3""")
def image_inventory(spark, sf_dir):
    return images.image_inventory(adapters.stored_images(spark, sf_dir))


ALLOWED_BUCKETS = tuple(f"src{n}" for n in range(0, 20, 2))


@register("lookup_objects", f"""
  SELECT d.source AS bucket, CAST(d.doc_id AS VARCHAR) AS key,
    CASE WHEN d.source IN {v.in_list(ALLOWED_BUCKETS)} AND l.doc_id IS NOT NULL THEN 'text/' || d.lang END AS content_type,
    CASE WHEN d.source IN {v.in_list(ALLOWED_BUCKETS)} AND l.doc_id IS NOT NULL THEN d.n_chars END AS content_length,
    CASE WHEN d.source IN {v.in_list(ALLOWED_BUCKETS)} AND l.doc_id IS NOT NULL THEN 'aws:kms' END AS sse,
    CASE WHEN d.source NOT IN {v.in_list(ALLOWED_BUCKETS)} THEN 'bucket not allowed' WHEN l.doc_id IS NULL THEN 'not found' ELSE 'ok' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lookup_objects(spark, sf_dir):
    """Every document is looked up; the inventory holds the labelled ones."""
    docs = adapters.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("key")
    inventory = docs.join(adapters.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.col("source").alias("bucket"), key, F.concat(F.lit("text/"), F.col("lang")).alias("content_type"),
        F.col("n_chars").alias("content_length"), F.lit("aws:kms").alias("sse"),
    )
    return objects.lookup_objects(docs.select(F.col("source").alias("bucket"), key), inventory, ALLOWED_BUCKETS)


_EXT = "CASE doc_id%7 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' WHEN 2 THEN '.html' WHEN 3 THEN '.gz' WHEN 4 THEN '.csv' WHEN 6 THEN '.png' ELSE '' END"


@register("layout_objects", f"""WITH {v.OBJECTS}
  SELECT version_id AS object_id, CASE o.bucket WHEN 'documents' THEN 'documents' ELSE 'uploads' END AS bucket,
    CASE o.bucket WHEN 'documents' THEN 'knowledge/' ELSE 'uploads/' END || strftime(created, '%Y/%m/%d') || '/' ||
      sha256(CAST(version_id AS VARCHAR)) || {_EXT.replace('doc_id', 'version_id')} AS key,
    CASE version_id%7 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/html'
      WHEN 3 THEN 'application/x-tar' WHEN 4 THEN 'text/csv' WHEN 6 THEN 'image/png'
      ELSE 'application/octet-stream' END AS content_type FROM objects o""")
def layout_objects(spark, sf_dir):
    stored = adapters.objects(spark, sf_dir)
    suffixes = F.array(*[F.lit(f".{e}" if e else "") for e in adapters.EXTENSIONS])
    suffix = F.element_at(suffixes, F.pmod(F.col("version_id"), F.lit(len(adapters.EXTENSIONS))).cast("int") + 1)
    named = stored.select(
        F.col("version_id").alias("object_id"), F.col("bucket").alias("kind"), "created",
        F.concat(F.lit("/../doc"), F.col("version_id").cast("string"), suffix).alias("filename"),
    )
    purpose = F.when(F.col("kind") == "documents", "document").otherwise("upload")
    laid_out = objects.layout_objects(named, purpose=purpose).select("object_id", "bucket", "key", "content_type", "created")
    path = new_folder(spark, "layout")
    for _ in range(2):  # a repeated run stores nothing twice
        objects.write_layout(laid_out, path, "first")
    return objects.read_layout(spark, path).select("object_id", "bucket", "key", "content_type")


_ALL_CHUNKS = v.ALL_DOCUMENTS + v.chunks("all_documents", ", source")


def all_chunks(spark, sf_dir):
    return ingestion.chunk_documents(adapters.all_documents(spark, sf_dir))


@register("chunk_documents", f"WITH {_ALL_CHUNKS} SELECT chunk_id, uri, source, ordinal, text, n_tokens, n_chunks FROM chunks")
def chunk_documents(spark, sf_dir):
    return all_chunks(spark, sf_dir)


@register("corpus_stats", f"""WITH {_ALL_CHUNKS},
  per_document AS (SELECT source, uri, count(*) AS n FROM chunks GROUP BY 1, 2),
  d AS (SELECT source, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, max(n) AS max_chunks,
    quantile_cont(n, 0.5) AS median_chunks FROM per_document GROUP BY 1),
  t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, max(n_tokens) AS max_tokens,
    quantile_cont(n_tokens, 0.5) AS median_tokens FROM chunks GROUP BY 1)
  SELECT *, tokens / chunks AS avg_tokens FROM d JOIN t USING (source)""")
def corpus_stats(spark, sf_dir):
    return ingestion.corpus_stats(all_chunks(spark, sf_dir))


def versioned(documents, text, version):
    """(uri, source, text, version) of table documents; every key lies under one prefix."""
    uri = F.concat(F.lit("s3://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return documents.select(
        uri.alias("uri"), F.lit("knowledge/").alias("key"), "source", text.alias("text"), F.lit(version).alias("version")
    )


def labelled_documents(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").join(
        adapters.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )


@register("upsert_chunks", f"WITH {_ALL_CHUNKS} SELECT chunk_id, uri, source, ordinal, text, n_tokens, n_chunks FROM chunks")
def upsert_chunks(spark, sf_dir):
    """Labelled documents first, then all of them: the second write adds only what is missing."""
    path = new_folder(spark, "chunks")
    ingestion.ingest_knowledge(versioned(labelled_documents(spark, sf_dir), F.col("text"), 1), path, None)
    ingestion.ingest_knowledge(versioned(adapters.table(spark, sf_dir, "documents"), F.col("text"), 1), path, None)
    return chunk_store.read_chunks(spark, path).select("chunk_id", "uri", "source", "ordinal", "text", "n_tokens", "n_chunks")


_REVISED = """revised AS (SELECT 's3://' || source || '/' || doc_id AS uri, source,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN text || ' revised' ELSE text END AS text FROM documents)"""
_FIRST = """labelled AS (SELECT 's3://' || source || '/' || doc_id AS uri, source, text
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


def two_ingests(spark, sf_dir):
    """Labelled documents, then all, the labelled ones changed, then the first ones again, which are old by now."""
    path = new_folder(spark, "index")
    labelled, changed = labelled_documents(spark, sf_dir), revised_documents(spark, sf_dir)
    first = versioned(labelled, F.col("text"), 1)
    ingestion.create_index(ingestion.chunk_documents(first), path)
    embedder = ingestion.load_embedder(spark, path)
    done = [
        ingestion.ingest_knowledge(batch, path, embedder).withColumn("job", F.lit(n).cast("long"))
        for n, batch in enumerate((first, versioned(changed, F.col("text"), 2), first), start=1)
    ]
    return path, done


@register("ingest_twice", f"""WITH {_REVISED}{v.chunks('revised', ', source')}
  SELECT chunk_id, uri, source, ordinal, text, n_tokens, true AS embedded FROM chunks""")
def ingest_twice(spark, sf_dir):
    path, _ = two_ingests(spark, sf_dir)
    embedded = (F.size("embedding") == ingestion.VECTOR_DIM) & F.exists("embedding", lambda x: x > 0)
    return chunk_store.read_chunks(spark, path, embedded=embedded).select(
        "chunk_id", "uri", "source", "ordinal", "text", "n_tokens", "embedded"
    )


@register("ingest_jobs", f"""WITH {_REVISED}, {_FIRST},
  second AS (SELECT count(*) AS documents FROM documents){v.chunks('revised')},
  counted AS (SELECT count(*) AS chunks, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM chunks)
  SELECT 2 AS job, documents, chunks, tokens, 'COMPLETE' AS status FROM second, counted
  UNION ALL SELECT 1, (SELECT count(*) FROM labelled), count(*),
    CAST(sum(least(n, 300)) AS BIGINT), 'COMPLETE' FROM (
      SELECT len(t) - s AS n FROM (SELECT t, unnest(range(0, greatest(len(t) - 60, 1), 240)) AS s FROM (
        SELECT regexp_extract_all(text, {v.lit(v.WORD_PATTERN)}) AS t FROM labelled) WHERE len(t) > 0))
  UNION ALL SELECT 3, 0, 0, 0, 'COMPLETE'""")
def ingest_jobs(spark, sf_dir):
    """What each of the three ingests wrote: the second all documents, the third nothing."""
    _, done = two_ingests(spark, sf_dir)
    return done[0].unionByName(done[1]).unionByName(done[2])


@register("stale_chunks", f"""WITH {_ALL_CHUNKS}
  SELECT chunk_id, uri, ordinal FROM chunks WHERE uri NOT IN
    (SELECT 's3://' || source || '/' || doc_id FROM documents JOIN labels USING (doc_id))""")
def stale_chunks(spark, sf_dir):
    """Labelled documents count as live, all others as removed."""
    docs = adapters.table(spark, sf_dir, "documents")
    live = docs.join(adapters.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.concat(F.lit("s3://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("uri")
    )
    return chunk_store.stale_chunks(all_chunks(spark, sf_dir), live).select("chunk_id", "uri", "ordinal")


def letters_sql(text: str) -> str:
    """The letter embedder in SQL."""
    low = f"lower(coalesce({text}, ''))"
    counts = f"list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda c: length({low}) - length(replace({low}, c, '')))"
    return f"list_transform({counts}, lambda n: CAST(CAST(round(n / greatest(list_max({counts}), 1), 6) AS FLOAT) AS DOUBLE))"


@register("embed_chunks", f"""WITH {_ALL_CHUNKS}, embedded AS (SELECT chunk_id, {letters_sql('text')} AS e FROM chunks)
  SELECT chunk_id, len(e) AS dimensions, round(list_sum(e), 3) AS total,
    round(list_sum(list_transform(e, lambda x, i: x * i)), 3) AS placed, round(list_sum(list_transform(e, lambda x: x * x)), 3) AS squares FROM embedded""")
def embed_chunks(spark, sf_dir):
    """Weights of an embedder that SQL can repeat; the default one is tested against plain arithmetic."""
    embedded = ingestion.embed_chunks(all_chunks(spark, sf_dir), letter_embedder)

    def total(values):
        return F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), 3)

    return embedded.select(
        "chunk_id", F.size("embedding").cast("bigint").alias("dimensions"), total("embedding").alias("total"),
        total(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))).alias("placed"),
        total(F.transform("embedding", lambda x: x.cast("double") * x)).alias("squares"),
    )


@register("ingest_knowledge", f"""WITH {v.KNOWLEDGE}, selected AS (
    SELECT uri, text FROM knowledge_documents WHERE starts_with(key, 'knowledge/')){v.chunks('selected')}
  SELECT count(*) AS chunks, (SELECT count(*) FROM selected) AS documents, CAST(sum(n_tokens) AS BIGINT) AS tokens,
    'COMPLETE' AS status FROM chunks""")
def ingest_knowledge(spark, sf_dir):
    arrived = adapters.knowledge_documents(spark, sf_dir).withColumnRenamed("ts", "version")
    return ingestion.ingest_knowledge(arrived, new_folder(spark, "knowledge"), letter_embedder)


def vector_queries(spark, sf_dir):
    """Every vector asks for its neighbours; the wanted number runs from -2 to 16 with the label."""
    return adapters.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding", (F.col("label") * 2 - 2).alias("requested")
    )


def vector_corpus(spark, sf_dir):
    return adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


_QUERIES = """queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e,
  CASE WHEN label * 2 - 2 = 0 THEN 5 ELSE greatest(1, least(10, label * 2 - 2)) END AS k FROM embeddings),
corpus AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
_EXACT = _QUERIES + """,
distances AS (SELECT query_id, k, chunk_id, list_distance(q.e, c.e) AS distance FROM queries q, corpus c),
exact AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, chunk_id,
  round(distance, 6) AS distance, k FROM distances QUALIFY rank <= k)"""


@register("vector_topk", f"WITH {_EXACT} SELECT query_id, rank, chunk_id, distance FROM exact")
def vector_topk(spark, sf_dir):
    return vectors.vector_topk(vector_queries(spark, sf_dir), vector_corpus(spark, sf_dir))


@register("vector_topk_blocked", f"WITH {_EXACT} SELECT query_id, rank, chunk_id, distance FROM exact")
def vector_topk_blocked(spark, sf_dir):
    """Against an index that was written before, in small blocks."""
    path = new_folder(spark, "vector-index")
    vectors.CellIndex.build(vector_corpus(spark, sf_dir), path, pivots=16)
    index = vectors.CellIndex.open(spark, path, block_rows=1000)
    return vectors.vector_topk(vector_queries(spark, sf_dir), index)


#: Unit vectors that are spread evenly need most cells; ``choose_probes`` gives 14 of 16 for a recall of 0.95.
PROBES = 14
_APPROXIMATE = """,
pivots AS (SELECT row_number() OVER (ORDER BY md5(CAST(chunk_id AS VARCHAR)), chunk_id) - 1 AS cell, e FROM corpus QUALIFY cell < 16),
cells AS (SELECT c.chunk_id, c.e, p.cell FROM corpus c, pivots p
  QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY list_distance(c.e, p.e), p.cell) = 1),
probes AS (SELECT q.query_id, q.e, q.k, p.cell FROM queries q, pivots p
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY list_distance(q.e, p.e), p.cell) <= 14),
approximate AS (SELECT p.query_id, c.chunk_id, p.k, list_distance(p.e, c.e) AS d,
  row_number() OVER (PARTITION BY p.query_id ORDER BY list_distance(p.e, c.e), c.chunk_id) AS rank
  FROM probes p JOIN cells c USING (cell) QUALIFY rank <= p.k)"""


def approximate(spark, sf_dir):
    return vectors.vector_topk_ann(
        vector_queries(spark, sf_dir), vector_corpus(spark, sf_dir), probes=PROBES, pivots=16
    )


@register("vector_topk_ann", f"""WITH {_QUERIES}{_APPROXIMATE}
  SELECT query_id, rank, chunk_id, round(d, 6) AS distance FROM approximate""")
def vector_topk_ann(spark, sf_dir):
    return approximate(spark, sf_dir)


@register("vector_recall", f"""WITH {_EXACT}{_APPROXIMATE}
  SELECT count(*) AS expected, count(a.query_id) AS found, count(a.query_id) / count(*) AS recall,
    count(a.query_id) / count(*) >= 0.95 AS enough
  FROM exact e LEFT JOIN approximate a USING (query_id, chunk_id)""")
def vector_recall(spark, sf_dir):
    exact = vectors.vector_topk(vector_queries(spark, sf_dir), vector_corpus(spark, sf_dir))
    return vectors.recall_at_k(approximate(spark, sf_dir), exact).withColumn("enough", F.col("recall") >= 0.95)


#: Full vectors that a coded search reads for a query.
RERANK = 60


def coded_index(spark, sf_dir):
    """Codes as long as a recall of 0.95 takes on these tables."""
    cells = vectors.CellIndex.build(vector_corpus(spark, sf_dir), pivots=16)
    return vector_codes.codes_for_recall(vector_queries(spark, sf_dir), cells, rerank=RERANK)


@register("vector_topk_coded")
def vector_topk_coded(spark, sf_dir):
    """Nearest by their codes, ranked on the full vectors."""
    return vector_codes.vector_topk_coded(vector_queries(spark, sf_dir), coded_index(spark, sf_dir), rerank=RERANK)


@register("coded_recall", f"WITH {_EXACT} SELECT count(*) AS expected, true AS enough, true AS frugal FROM exact")
def coded_recall(spark, sf_dir):
    """What the coded search finds of the true neighbours, and how few full vectors it reads for it."""
    measured = vector_codes.coded_recall(vector_queries(spark, sf_dir), coded_index(spark, sf_dir), rerank=RERANK)
    return measured.select(
        "expected", (F.col("recall") >= 0.95).alias("enough"), (F.col("read_share") <= 0.25).alias("frugal")
    )


@register("retrieve_knowledge", f"""WITH {v.REQUESTS}, {_ALL_CHUNKS},
  stored AS (SELECT chunk_id, uri, text, {letters_sql('text')} AS e FROM chunks),
  asked AS (SELECT request_id, {letters_sql(v.strip('query'))} AS e FROM requests WHERE {v.strip('query')} <> ''),
  hits AS (SELECT request_id, chunk_id, uri, text, round(list_distance(a.e, s.e), 6) AS distance,
    row_number() OVER (PARTITION BY request_id ORDER BY list_distance(a.e, s.e), chunk_id) AS rank
    FROM asked a, stored s QUALIFY rank <= 5)
  SELECT request_id, rank, chunk_id, distance, round(1.0 / (1.0 + distance * distance), 6) AS score, uri AS source,
    substr(text, 1, 500) AS excerpt FROM hits""")
def retrieve_knowledge(spark, sf_dir):
    """Every request against the stored index of all documents."""
    path = new_folder(spark, "index")
    ingestion.ingest_knowledge(
        versioned(adapters.table(spark, sf_dir, "documents"), F.col("text"), 1), path, letter_embedder
    )
    knowledge_index.refresh_index(spark, path)
    return _citations(adapters.requests(spark, sf_dir), path)


def _citations(requests, path):
    citations, _ = retrieval.retrieve_from_store(requests, path, letter_embedder)
    return citations.select("request_id", "rank", "chunk_id", "distance", "score", "source", "excerpt")


def revised_documents(spark, sf_dir):
    """All documents, the labelled ones changed."""
    known = adapters.table(spark, sf_dir, "labels").select("doc_id", F.lit(" revised").alias("_end")).distinct()
    joined = adapters.table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    return joined.withColumn("text", F.concat("text", F.coalesce("_end", F.lit(""))))


@register("retrieve_after_update", f"""WITH {v.REQUESTS}, {_REVISED}{v.chunks('revised')},
  stored AS (SELECT chunk_id, uri, text, {letters_sql('text')} AS e FROM chunks),
  asked AS (SELECT request_id, {letters_sql(v.strip('query'))} AS e FROM requests WHERE {v.strip('query')} <> ''),
  hits AS (SELECT request_id, chunk_id, uri, text, round(list_distance(a.e, s.e), 6) AS distance,
    row_number() OVER (PARTITION BY request_id ORDER BY list_distance(a.e, s.e), chunk_id) AS rank
    FROM asked a, stored s QUALIFY rank <= 5)
  SELECT request_id, rank, chunk_id, distance, round(1.0 / (1.0 + distance * distance), 6) AS score, uri AS source,
    substr(text, 1, 500) AS excerpt FROM hits""")
def retrieve_after_update(spark, sf_dir):
    """An index made of the labelled documents as they were; a later ingest changes those and adds the others, and
    the store is merged. Retrieval opens the index as that ingest left it."""
    path = new_folder(spark, "index")
    ingestion.ingest_knowledge(versioned(labelled_documents(spark, sf_dir), F.col("text"), 1), path, letter_embedder)
    knowledge_index.refresh_index(spark, path)
    ingestion.ingest_knowledge(versioned(revised_documents(spark, sf_dir), F.col("text"), 2), path, letter_embedder)
    chunk_store.merge_versions(spark, path)
    return _citations(adapters.requests(spark, sf_dir), path)


@register("merge_versions", f"""WITH {_REVISED}{v.chunks('revised', ', source')}
  SELECT chunk_id, uri, source, ordinal, text, n_tokens, n_chunks FROM chunks""")
def merge_versions(spark, sf_dir):
    """Labelled documents, merged into a snapshot, then all, the labelled ones changed, merged again, then the first
    ones once more: they are old by now, and read beside the snapshot."""
    path = new_folder(spark, "store")
    first = versioned(labelled_documents(spark, sf_dir), F.col("text"), 1)
    for batch in (first, versioned(revised_documents(spark, sf_dir), F.col("text"), 2)):
        ingestion.ingest_knowledge(batch, path, None)
        chunk_store.merge_versions(spark, path)
    chunk_store.append_rows(ingestion.version_rows(first, None), path)
    return chunk_store.read_chunks(spark, path).select("chunk_id", "uri", "source", "ordinal", "text", "n_tokens", "n_chunks")


@register("shape_citations", """
  SELECT doc_id, CASE lang WHEN 'en' THEN 's3://' || source || '/' || doc_id WHEN 'de' THEN 'WEB' ELSE 'knowledge-base' END AS source,
    substr(text, 1, 500) AS excerpt FROM documents""")
def shape_citations(spark, sf_dir):
    """Documents as hits: English ones have a URI, German ones a location type only, others neither."""
    lang = F.col("lang")
    uri = F.concat(F.lit("s3://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return retrieval.shape_citations(adapters.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(lang == "en", uri).alias("uri"), F.when(lang == "de", "WEB").otherwise("").alias("location_type"),
        F.col("text").alias("content"),
    ))
