"""Token counts through a digest cache."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, Scratch, blank, kept_dir

LIMIT = 4096
CACHE = "digest string, tokenizer string, n_tokens long"
#: Texts that go to Python in one batch.
TEXTS = 1024


@functools.cache
def _model(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return lambda texts, m=sentencepiece.SentencePieceProcessor(model_file=path): [len(x) for x in m.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(docs: DataFrame, path: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Token counts of whole texts, from the cache where it has them.

    Content is normalised only as far as counts can't change: null becomes empty. Its SHA-256 and the
    tokenizer's are looked up in cache (digest, tokenizer, n_tokens); of the rest, one row for each digest is
    encoded, and the new rows are to be appended to the cache. Returns (docs with digest, n_bytes and n_tokens,
    which replace columns of that name; the new cache rows, a table in the shared folder).

    Equal rows each come back; a null doc_id is as any other; a text of any length is counted whole, in one piece; cache
    may hold a row several times; an empty table gives empty tables.
    """
    version = tokenizer_digest(path)
    work = Scratch(docs.sparkSession, "tokens")
    rows = docs.withColumns({"digest": F.sha2(blank("text").cast("binary"), 256), "n_bytes": F.octet_length(blank("text")).cast("long")})
    own = rows.select("digest", blank("text").alias("text"))
    known = None if cache is None else cache.filter(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    if known is not None:
        own = own.join(known.select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _model(path)
        for b in batches:
            for at in range(0, len(b), 256):
                x = b.slice(at, 256)
                n = count(x.column("text").to_pylist())
                yield pa.record_batch({"digest": x.column("digest"), "n_tokens": pa.array(n, pa.int64())})

    misses = own.dropDuplicates(["digest"])  # copies in one part are dropped before they move
    fresh = work.table(misses.mapInArrow(encode, "digest string, n_tokens long"), TEXTS)
    counts = fresh if known is None else known.unionByName(fresh)
    out = rows.drop("n_tokens").join(counts, "digest")
    return out, fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens")


def count_with(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """docs with their counts, by the cache in folder, which then holds all of them."""
    cache = Kept(docs.sparkSession, folder, CACHE)
    out, fresh = count_tokens(docs, path, cache.read())
    cache.append(fresh)
    return out


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = count_with(docs, public_tokenizers.path("piece_bpe_32k.model"), kept_dir(spark, "token-cache", sf_dir))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
