"""Substring dedup of words: count-min prefilter, then exact grouping.

A word is a maximal run of characters other than space and U+0009 to U+000D.  A
window is ``window`` consecutive words of one document.  Every word covered by
a window that also starts anywhere else, in the same document too, is removed.

Defined cases: a null or empty text has no words and stays as it is (kept text
is empty); documents shorter than a window lose nothing; repeated rows remove
each other's windows; an empty table gives an empty table; other columns pass
through, and the operator's columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unwrapped
from .repeats import Repeats, Windows

WINDOW = 35
GRAM = 22

_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def _finish(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    kept = words if not gone.any() else [words[i] for i in np.flatnonzero(~gone)]
    return len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int | None = None, most_bits: int = 27) -> DataFrame:
    """``docs`` and ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space)."""
    gram = gram or max(1, window * GRAM // WINDOW)
    found = Repeats(docs, doc_id, text, Windows("words", window, gram), keep_first=False, most_bits=most_bits).applied(_RESULT, _finish)
    return unwrapped(found, {n: F.col("found").getField(n) for n in _RESULT.fieldNames()})
