"""Token counting.

The default counter is native: the number of word runs plus single punctuation
marks (``regexp_count``), which stays inside whole-stage codegen. A real BPE
tokenizer can be plugged in as an Arrow ``pandas_udf`` built by
:func:`bpe_counter` when its vocabulary is available locally.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# word run, or one mark that is neither a word character nor white space
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"


def regex_tokens(x: Column) -> Column:
    """Default token count of a string column (null → 0)."""
    return F.coalesce(F.regexp_count(x, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def bpe_counter(encoding_name: str = "cl100k_base") -> Callable[[Column], Column]:
    """Arrow-batched token counter backed by ``tiktoken`` (needs the encoding files
    cached locally; raises at call time otherwise)."""
    import pandas as pd

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        import tiktoken
        enc = tiktoken.get_encoding(encoding_name)
        return s.map(lambda v: 0 if v is None else len(enc.encode(v, disallowed_special=()))).astype("int64")

    return _count
