"""Which tokens a distance counts: words by pattern, or those of a vocabulary file of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from spanwise.functions.text import normalize_text, word_tokens

MODES = ("regex", "auto", "tiktoken", "hf")
# Fixed value: the pattern that splits text for the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encode(mode: str, path: str) -> Callable[[str], list[str]]:
    if mode == "hf":
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda t: [str(i) for i in own.encode(t, add_special_tokens=False).ids]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: [str(i) for i in enc.encode_ordinary(t)]


def selected(mode: str = "regex", path: str | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its tokens.

    'regex': words and marks, in the JVM. 'tiktoken' and 'hf' need a vocabulary file; 'auto' takes one of ranks if it is there and words
    otherwise. Texts are normalised and in lower case; null and blank ones have no tokens.
    """
    mode = {"huggingface": "hf", "transformers": "hf"}.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unsupported tokenizer {mode!r}, use one of {', '.join(MODES)}")
    if mode == "auto":
        mode = "tiktoken" if path and os.path.exists(path) else "regex"
    if mode == "regex":
        return lambda c: word_tokens(normalize_text(c))
    if not path:
        raise ValueError(f"{mode} needs a vocabulary file")

    @F.pandas_udf(ArrayType(StringType()))
    def encoded(texts: pd.Series) -> pd.Series:
        encode = _encode(mode, path)
        return texts.map(lambda t: encode(t) if t else [])

    return lambda c: encoded(F.lower(normalize_text(c)))
