"""Documents to chunks to vectors, and corpus statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from groundwire.functions.terms import count_terms
from groundwire.llm.common import small_batches
from groundwire.operators.knowledge_index import add_versions, has_index
from groundwire.plans.workspace import scratch
from groundwire.sources.chunk_store import FOLDERS, HEADER, bucket_of, changed_documents, content_of, write_dealt
from groundwire.sources.documents import under_prefix

# Chunk length in tokens, overlap in percent, vector dimension.
CHUNK_TOKENS = 300
OVERLAP_PERCENT = 20
VECTOR_DIM = 1024
CHUNK = "ordinal bigint, text string, n_tokens bigint, n_chunks bigint"


def cut_texts(texts: pa.Array, max_tokens: int, stride: int, headers: bool) -> pa.Array:
    """The rows of each text (ordinal, text, n_tokens, n_chunks) as a list; ``str.split`` takes the whitespace that
    ``WHITESPACE_CHARS`` spells out."""
    ordinals, pieces, sizes, held, ends = [], [], [], [], [0]
    for text in texts.cast(pa.large_binary()):
        words = (text.as_py() or b"").decode("utf-8", "replace").split()
        # Last start: the first one whose chunk reaches the end of the document.
        last = -1 if not words else max(0, -(-(len(words) - max_tokens) // stride)) * stride
        starts = range(0, last + 1, stride)
        if headers:
            ordinals.append(HEADER)
            pieces.append(None)
            sizes.append(0)
        for ordinal, start in enumerate(starts):
            part = words[start : start + max_tokens]
            ordinals.append(ordinal)
            pieces.append(" ".join(part))
            sizes.append(len(part))
        held.extend([len(starts)] * (len(ordinals) - ends[-1]))
        ends.append(len(ordinals))
    columns = {
        "ordinal": pa.array(ordinals, pa.int64()), "text": pa.array(pieces, pa.string()),
        "n_tokens": pa.array(sizes, pa.int64()), "n_chunks": pa.array(held, pa.int64()),
    }
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def chunk_documents(
    documents: DataFrame, max_tokens: int = CHUNK_TOKENS, overlap_percent: int = OVERLAP_PERCENT, headers: bool = False
) -> DataFrame:
    """(uri, text, …) to one row per fixed-size chunk; every token is in at least one chunk.

    A token is a whitespace-separated word; ``n_chunks`` is the number of chunks of the document. With
    ``headers`` each document also gives a row of ordinal -1 without text, empty documents too.
    Row-local: one pass over the words of a document in Arrow batches, one generator, no shuffle.
    """
    stride = max_tokens - max_tokens * overlap_percent // 100
    others = [c for c in documents.columns if c not in ("text", "uri")]

    small_batches(documents.sparkSession)

    @F.arrow_udf(f"array<struct<{CHUNK}>>")
    def cut(texts: pa.Array) -> pa.Array:
        return cut_texts(texts, max_tokens, stride, headers)

    chunked = documents.select("uri", *others, cut("text").alias("_rows")).select("uri", *others, F.inline("_rows"))
    identity = F.concat_ws("\x1f", "uri", F.col("ordinal").cast("string"), "text")
    return chunked.select(F.sha2(identity, 256).alias("chunk_id"), "*")


TOKENS = "SELECT *, split(lower(coalesce(text, '')), '\\\\s+') AS _tokens FROM __THIS__"


def document_frequencies(chunks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of chunks, and of those with a term in each slot; a task sends one row a slot."""
    def count(batches):
        seen, rows = np.zeros(dim, np.int64), 0
        for batch in batches:
            seen += (count_terms(batch.column(0), dim) > 0).sum(axis=0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([rows, *seen], pa.int64())], ["slot", "n"])

    texts = chunks.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    sums = dict(texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect())
    return sums.get(-1, 0), [sums.get(slot, 0) for slot in range(dim)]


def fit_embedder(chunks: DataFrame, dim: int = VECTOR_DIM) -> PipelineModel:
    """Default embedder: hashed term counts weighted by 1 + inverse document frequency, unit length.

    The 1 keeps words of every document, so no text with words has a zero vector.
    """
    small_batches(chunks.sparkSession)
    n, found = document_frequencies(chunks, dim)
    if not n:
        raise ValueError("no chunks to fit an embedder on")
    tokens = SQLTransformer(statement=TOKENS)
    counts = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dim)
    weigh = ElementwiseProduct(
        inputCol="_counts", outputCol="_weights", scalingVec=Vectors.dense([1.0 + math.log((n + 1) / (x + 1)) for x in found])
    )
    return PipelineModel([tokens, counts, weigh, Normalizer(inputCol="_weights", outputCol="_unit", p=2.0)])


def _default_weights(model: PipelineModel) -> np.ndarray | None:
    """The weights of a model that ``fit_embedder`` made; None for another one."""
    kinds = [SQLTransformer, HashingTF, ElementwiseProduct, Normalizer]
    if [type(stage) for stage in model.stages] != kinds or model.stages[0].getStatement() != TOKENS:
        return None
    counts, weigh, unit = model.stages[1:]
    return None if counts.getBinary() or unit.getP() != 2.0 else weigh.getScalingVec().toArray()


def embed_chunks(
    chunks: DataFrame, embedder: PipelineModel | Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add ``embedding``; a callable stands for an external model behind an Arrow hook. The default embedder is
    applied in Arrow batches, with the vectors its stages give."""
    if not isinstance(embedder, PipelineModel):
        return embedder(chunks)
    weights = _default_weights(embedder)
    if weights is not None:
        small_batches(chunks.sparkSession)

        @F.arrow_udf("array<float>")
        def unit(texts: pa.Array) -> pa.Array:
            vectors = count_terms(texts, len(weights)) * weights
            norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            vectors = (vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32)
            return pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * len(weights), pa.array(vectors.ravel()))

        return chunks.withColumn("embedding", unit(F.lower(F.coalesce("text", F.lit("")))))
    vectors = embedder.transform(chunks)
    return vectors.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_tokens", "_counts", "_weights", "_unit"
    )


def create_index(chunks: DataFrame, path: str) -> PipelineModel:
    """Fit the default embedder on ``chunks`` and keep it with the index: all its vectors share one space."""
    model = fit_embedder(chunks)
    model.write().save(f"{path}/embedder")
    return model


def load_embedder(spark: SparkSession, path: str) -> PipelineModel:
    """The embedder an index was created with; fails for an index that has none."""
    return PipelineModel.load(f"{path}/embedder")


def version_rows(
    documents: DataFrame, embedder: PipelineModel | Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """Store rows of documents (uri, text, version, …): headers and embedded chunks. Stateless, so it serves
    batches and streams alike. Without an embedder the chunks are stored as they are."""
    return _store_rows(
        documents.withColumns({"content": content_of(F.col("text")), "bucket": bucket_of(F.col("uri"))}), embedder
    )


def _store_rows(
    named: DataFrame, embedder: PipelineModel | Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    rows = chunk_documents(named, headers=True)
    if embedder is None:
        return rows
    embedded = embed_chunks(rows, embedder)
    return embedded.withColumn("embedding", F.when(F.col("ordinal") != HEADER, F.col("embedding")))


def job_metrics(news: Column | None = None) -> list[Column]:
    """What one ingest wrote, observed on the rows as they are written; ``news``: documents that count."""
    header = F.col("ordinal") == HEADER
    return [
        F.count_if(header if news is None else header & news).alias("documents"), F.count_if(~header).alias("chunks"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
    ]


def ingest_knowledge(
    documents: DataFrame, path: str, embedder: PipelineModel | Callable[[DataFrame], DataFrame] | None,
    prefix: str = "knowledge/",
) -> DataFrame:
    """Filter by prefix, chunk, embed and store new and changed documents; returns the job's status row.

    ``documents``: uri, key, text, version and further columns to keep. Unchanged documents drop out before
    the chunking; a document that is only newer renews its header. ``load_embedder`` gives the embedder.
    """
    spark = documents.sparkSession
    changed, job = changed_documents(under_prefix(documents, prefix), path), Observation("ingest")
    news = ~F.col("content_known")
    # chunks are cut where the texts are dealt, and written there: neither texts nor vectors move again
    rows = _store_rows(changed.drop("old_content").withColumn("text", F.when(news, F.col("text"))), embedder)
    written = rows.observe(job, *job_metrics(news)).drop("content_known")
    with ExitStack() as stack:
        if embedder is not None and has_index(spark, path):
            added = stack.enter_context(scratch(changed.filter(news).select("uri", "content", "old_content"), "changed-versions"))
            write_dealt(written, f"{path}/{FOLDERS[0]}", "append")
            if added.head(1):
                add_versions(spark, path, added)
        else:
            write_dealt(written, f"{path}/{FOLDERS[0]}", "append")
    done = job.get
    return spark.createDataFrame(
        [(done["documents"], done["chunks"], done["tokens"], "COMPLETE")], "documents long, chunks long, tokens long, status string"
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Documents, chunks per document and tokens per chunk by source.

    One pass and one small shuffle: chunks are counted per (source, tokens, chunks of the document),
    which takes few distinct values, and the exact percentiles read those counts. A document is
    represented by its chunk 0.
    """
    document_size = F.when(F.col("ordinal") == 0, F.col("n_chunks"))
    counted = chunks.groupBy("source", "n_tokens", document_size.alias("_size")).agg(F.count("*").alias("_n"))
    documents = F.when(F.col("_size").isNotNull(), F.col("_n"))
    return counted.groupBy("source").agg(
        F.sum(documents).alias("documents"), F.sum("_n").alias("chunks"),
        F.max("_size").alias("max_chunks"),
        F.percentile("_size", 0.5, F.coalesce(documents, F.lit(0))).alias("median_chunks"),
        F.sum(F.col("_n") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("max_tokens"),
        F.percentile("n_tokens", 0.5, F.col("_n")).alias("median_tokens"),
    ).withColumn("avg_tokens", F.col("tokens") / F.col("chunks"))
