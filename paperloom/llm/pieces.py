"""Blocks of texts cut at white space, with each distinct piece handed out once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that are cut at a time.
BLOCK_BYTES = 2 << 20


def release() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


#: What a worker remembers from task to task, by its user, and how to forget it.
MEMORIES: dict[str, Callable[[], None]] = {}


def only(user: str = "") -> None:
    """Forgets what others than `user` remember, at the start of a task: workers of one stage share, later stages do not pay."""
    for name, forget in MEMORIES.items():
        if name != user:
            forget()
    release()


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about BLOCK_BYTES; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = end[at - 1] if at else 0
        n = max(1, int(np.searchsorted(end, base + BLOCK_BYTES, side="right")) - at)
        yield texts.slice(at, n)
        at += n
    release()


def cut(texts: pa.Array, lines: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces between ASCII white space, the piece numbers of all texts, and where each text begins in them.

    lines: line feeds stay as pieces of their own.  The empty piece may occur.
    """
    for blank in "\t\r\x0b\x0c":
        texts = pc.replace_substring(texts, blank, " ")
    texts = pc.replace_substring(texts, "\n", " \n " if lines else " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]
