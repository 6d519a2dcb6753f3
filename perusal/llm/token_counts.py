"""Token counts by compiled finite-state transducers (see ``transducer``).

Documents stay where they are scanned: one Arrow-batched pass, no shuffle. A batch is cut
into slices of bounded size, so a worker's memory depends on the longest text only. The
tokenizer's file is read once on the driver and travels with the function, as it need not
exist on the executors.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, without

ADDED = ("n_bytes", "n_tokens", "over_limit")
#: Characters that are counted in one step.
STEP = 500_000
_compiled: dict = {}


def compiled(name: str, data: bytes):
    """The compiled tokenizer of this worker process."""
    if name not in _compiled:
        from .transducer import Compiled

        with tempfile.NamedTemporaryFile(suffix=".json") as f:
            f.write(data)
            f.flush()
            _compiled[name] = Compiled(f.name)
    return _compiled[name]


def slices(texts: list[str], step: int = STEP) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= step:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All rows of ``df`` with n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE file on the driver. Counts equal those of the
    file's library without begin, end or added tokens; the file's special strings within a
    text count as one token each, as is its default. Null text counts as empty: 0 bytes, 0
    tokens. Input columns with the added names are replaced; every row is counted for itself.
    """
    df = without(df, *ADDED)
    name, data = os.path.abspath(tokenizer), df.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fst = compiled(name, data.value)
        for b in batches:
            texts = [t or "" for t in b]
            n = np.array([x for part in slices(texts) for x in fst.counts(part)], np.int64)
            yield pd.DataFrame({"n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit})

    # only texts go to Python and only counts come back
    return df.withColumn("__counts", count(F.col(text))).select(*[F.col(f"`{c}`") for c in df.columns], "__counts.*")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
