"""Words of the search operators: runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased.

On UTF-8 every byte of a non-ASCII character is above 0x7F, so one byte table lowers A-Z and
blanks every separator, and splitting at blanks gives the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

_WORD_BYTES = bytes(
    b | 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def codes_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words' numbers; 0 stands for words outside of the vocabulary."""
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words))


def numbered(words: Iterator[bytes]) -> dict[bytes, int]:
    """Numbers from 1 in order of the words."""
    return {w: i for i, w in enumerate(sorted(set(words)), 1)}
