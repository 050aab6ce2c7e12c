"""Token counts of texts under a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}
_sent: set[tuple[str, str]] = set()


def sent(spark: SparkSession, path: str) -> str:
    """Give the vocabulary to every executor; its name there."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        sc.addFile(path)
        _sent.add((sc.applicationId, path))
    return path.rstrip("/").rsplit("/", 1)[-1]


def encoder(name: str):
    """The tokenizer of a vocabulary that was sent, loaded once a process."""
    if name not in _encoders:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of the whole text; NULL and empty texts have 0.

    path: the vocabulary, on the driver or any place Spark reads; else the setting ``spark.tidemark.tokenizer``, else ``TOKENIZER``. Executors get it from Spark.
    """
    name = sent(docs.sparkSession, path or docs.sparkSession.conf.get("spark.tidemark.tokenizer", TOKENIZER))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name).encode_ordinary
        for b in batches:
            n = [len(encode(x)) if (x := v.as_py()) else 0 for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(count, f"doc_id {kind}, n_tokens bigint")
