"""Token counts with a public tokenizer read from a file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Where the tokenizer files lie; the path is a parameter and may be set in the environment.
TOKENIZER = os.environ.get("FOTOLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters that are encoded at once, or one text if it is longer.
BATCH_CHARS = 1 << 20


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def count_tokens(df: DataFrame, text: str, path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """The rows without ``text`` but with its token count; null and empty texts have 0 tokens.

    A column of the name ``out`` that is there already is replaced. Every text is encoded whole.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, out)]

    def batches(texts: list[str | None]) -> Iterator[list[int]]:
        part, chars = [], 0
        for i, t in enumerate(texts):
            if t:
                if part and (chars + len(t) > BATCH_CHARS or len(part) == 256):
                    yield part
                    part, chars = [], 0
                part.append(i)
                chars += len(t)
        if part:
            yield part

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for pdf in it:
            n, texts = [0] * len(pdf), pdf[text].to_list()
            for part in batches(texts):
                for i, e in zip(part, tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                    n[i] = len(e.ids)
            res = pdf[[f.name for f in keep]].copy()
            res[out] = pd.array(n, dtype="int64")
            yield res

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` bigint"])
    return df.mapInPandas(run, schema)
