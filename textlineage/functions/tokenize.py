"""Tokenizer strategies: text column -> ARRAY<STRING>. Order and duplicates stay."""

from __future__ import annotations

import importlib.util
import logging
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "[\\u4e00-\\u9fff]+"


#: Bytes of texts that a step looks at, a text at least.
STEP = 4 << 20


@F.arrow_udf(T.ArrayType(T.StringType()))
def letter_runs(texts: pa.Array) -> pa.Array:
    """The runs of a to z of each text, null for null: found in the bytes of many texts at once, several times cheaper than a match a word."""
    texts, out, i = texts.cast(pa.large_string()), [], 0
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    while i < len(texts) or not out:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, side="right")) - 1)
        out.append(runs(data[at[i] : at[min(j, len(texts))]], at[i : j + 1] - at[i], texts.slice(i, j - i).is_null()))
        i = j
    return pa.concat_arrays(out)


def runs(data: np.ndarray, at: np.ndarray, null: pa.Array) -> pa.Array:
    """letter_runs of texts that lie between the places `at`."""
    inside = data - np.uint8(97) < 26
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]  # a run ends with its text
    first, last = at[:-1][filled], at[1:][filled] - 1
    begins[first], ends[last] = inside[first], inside[last]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    places = np.append(0, np.cumsum(lengths)).astype(np.int32)  # in the letters alone
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), words, mask=null)


def regex_words(text: Column) -> Column:
    """Lower-case runs of a to z."""
    return letter_runs(F.lower(text))


def cjk_runs(text: Column) -> Column:
    """Maximal runs of CJK ideographs."""
    return F.regexp_extract_all(text, F.lit(CJK), F.lit(0))


def cjk_bigram(text: Column) -> Column:
    """Overlapping pairs of characters inside each CJK run; a run of one character stays."""
    pairs = F.transform(
        cjk_runs(text),
        lambda run: F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))),
    )
    return F.flatten(pairs)


def segmenter(user_dict_path: str | None = None) -> Callable[[Column], Column]:
    """Dictionary segmentation by the optional jieba package, loaded once in each Python worker. Of its words those of CJK ideographs alone stay;
    a user dictionary that can't be read is warned of and left out."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import jieba

        if user_dict_path:
            try:
                jieba.load_userdict(user_dict_path)
            except OSError as e:
                logging.getLogger(__name__).warning("user dictionary left out: %s", e)
        for texts in batches:
            yield texts.fillna("").map(lambda t: [w for w in jieba.cut(t, HMM=True) if w])

    return lambda text: F.filter(cut(text), lambda t: t.rlike(f"^{CJK}$"))


STRATEGIES: dict[str, Callable[[Column], Column]] = {"regex": regex_words, "cjk_runs": cjk_runs, "cjk_bigram": cjk_bigram}


def tokenizer(name: str, user_dict_path: str | None = None) -> Callable[[Column], Column]:
    """A strategy by name. "auto" segments by dictionary where the package is installed, else takes pairs of characters and says so."""
    if name == "auto":
        name = "jieba" if importlib.util.find_spec("jieba") else "cjk_bigram"
        if name != "jieba":
            logging.getLogger(__name__).warning("jieba is not installed: words are pairs of characters")
    if name != "jieba":
        return STRATEGIES[name]
    if user_dict_path and not os.path.exists(user_dict_path):
        logging.getLogger(__name__).warning("no user dictionary at %s", user_dict_path)
    return segmenter(user_dict_path)


def drop_words(tokens: Column, words: Column) -> Column:
    """Tokens without those in an array of words (array_except would also drop duplicates)."""
    return F.filter(tokens, lambda t: ~F.array_contains(words, t))
