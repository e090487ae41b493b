"""Token counts by overlap resynchronisation (see ``bpe.spliced``)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import bounded_batches, utf8


def _counter(path: str):
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series(own.encode(texts.tolist(), with_ids=False)[0])

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row, without a shuffle.

    ``tokenizer`` is a byte-level BPE file of the ``tokenizers`` library; begin, end and other added
    tokens are not counted, special strings inside a text are, as the library does by default. A null
    text counts as empty: no bytes, no tokens. Ids pass unread; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"),
        _counter(tokenizer)(utf8(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
