"""Words of whole Arrow columns, split and counted outside the interpreter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
# A-Z lower-cased, all other bytes as they are; ASCII white space divides words.
LOWER_CASED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The same with every ASCII byte that is no letter or digit turned into a space.
LETTERS_AND_DIGITS = bytes(b if b >= 128 or chr(b).isalnum() else SPACE for b in LOWER_CASED)


def split_words(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has; null has none.

    ``table`` says what each byte of the UTF-8 text becomes before it is split at white space;
    bytes of longer characters must stay.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(ends[0]), int(ends[-1])) if len(texts) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    plain = np.frombuffer(table, np.uint8)[raw]
    moved = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - first), pa.py_buffer(plain))
    lists = pc.ascii_split_whitespace(moved)
    words, bounds = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(before[bounds - bounds[0]] if len(texts) else np.zeros(1, np.int64))
