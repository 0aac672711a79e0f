"""Words of many texts as 64-bit codes: Arrow cuts and numbers them, each distinct one is hashed once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit SipHash of each word."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def coded_words(texts: pa.Array, unicode: bool = False, code_of: Callable[[pa.Array], np.ndarray] = hashed) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words in a row, and where each text's words begin and end among them.

    Words are cut at white space, of ASCII or of Unicode. ``code_of`` gives the unsigned 64-bit codes of
    distinct words. Null texts have none.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.utf8_split_whitespace(texts) if unicode else pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    encoded = parts.flatten().dictionary_encode()
    number, offsets = encoded.indices.to_numpy(), offsets - offsets[0]
    codes = code_of(encoded.dictionary)[number]
    empty = pc.index(encoded.dictionary, "").as_py()
    if empty >= 0:
        # White space at an end of a text leaves an empty word there.
        real = number != empty
        codes, offsets = codes[real], np.concatenate([[0], np.cumsum(real)])[offsets]
    return codes, offsets
