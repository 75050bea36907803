"""Exact, columnar use of `tokenizers` models whose text splits at white space.

Both vocabularies that the queries name split a text before any merge, so a text cut where a token
must begin anyway gives the same ids piece by piece.  Arrow cuts a block of texts and finds its
distinct pieces; the library sees each new piece once and a worker remembers its ids (a fixed
number of pieces).  Texts for whose shape a cut is not proven go through the library whole.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperloom.llm.pieces import MEMORIES, only, release

#: Pieces that a worker remembers; a full cache is emptied.
CACHE_PIECES = 500_000
#: UTF-8 bytes of text that are cut at a time.
BLOCK_BYTES = 2 << 20

#: Unicode white space without the ASCII characters, and what Python alone counts as such.
_WIDE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD = r"\x{1C}-\x{1F}\x00"
_UNSAFE = {
    "spaces": rf"<\||[{_ODD}]|[\x09-\x0D {_WIDE}][\x09-\x0D {_WIDE}]|^[\x09-\x0D {_WIDE}]|[\x09-\x0D {_WIDE}]$",
    "words": rf"<\||[{_ODD}]|[{_WIDE}\x0B\x0C\x{{130}}]",  # U+0130 is the one letter whose lower case ends in a mark
}
#: A word and the punctuation behind it are separate tokens in both patterns; an apostrophe may begin a contraction.
_TAIL = r"(\pL)([!-&(-/:-@\[-`{-~]+)"
_PLAIN = re.compile(r" ?[A-Za-z]+|[!-&(-/:-@\[-`{-~]+").fullmatch


class PieceEncoder:
    """Ids of whole texts.

    split: "words" cuts at runs of white space (models that drop it and lower-case), "spaces" cuts
    before a single space between two visible characters (byte-level models, where the space
    belongs to the next word) and around a single line feed.
    """

    def __init__(self, path: str, split: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.model.model)  # merges only, for pieces that are one token run of ASCII
        self.top = max(self.model.get_vocab(with_added_tokens=True).values(), default=0)
        self.split = split
        self.cache: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _ask(self, fresh: list[str]) -> None:
        """Remembers the packed ids of new pieces, from one library call for plain and one for other ones."""
        plain: list[str] = []
        other: list[str] = []
        for x in fresh:
            (plain if _PLAIN(x) else other).append(x)
        for model, texts, sent in ((self.bare, plain, [x.replace(" ", "Ġ") for x in plain]), (self.model, other, other)):
            if not texts:
                continue
            found = model.encode(sent, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype=np.uint32).tobytes()
            word = np.array(found.word_ids, dtype=np.int64)
            cut = (np.searchsorted(word, np.arange(len(texts) + 1)) * 4).tolist()
            self.cache.update(zip(texts, [raw[i:j] for i, j in itertools.pairwise(cut)], strict=True))

    def _block(self, texts: pa.Array) -> list[np.ndarray]:
        unsafe = pc.match_substring_regex(texts, _UNSAFE[self.split])
        safe = pc.if_else(unsafe, "", texts)
        if self.split == "words":
            safe = pc.ascii_lower(safe)
            for blank in "\t\n\r":
                safe = pc.replace_substring(safe, blank, " ")
            lists = pc.split_pattern(pc.replace_substring_regex(safe, _TAIL + "( |$)", r"\1 \2\3"), " ")
        else:
            safe = pc.replace_substring(pc.replace_substring(safe, " ", "\0 "), "\n", "\0\n\0")
            lists = pc.split_pattern(pc.replace_substring_regex(safe, _TAIL + r"(\x00|$)", "\\1\0\\2\\3"), "\0")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache = self.cache
        cache[""] = b""
        new = [p for p in distinct if p not in cache]
        if new:
            self._ask(new)
        packed = [cache[p] for p in distinct]
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) >> 2
        table = np.frombuffer(b"".join(packed), dtype=np.uint32)
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        ends = np.cumsum(n)
        flat = table[np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()]
        out = np.split(flat, at[1:-1]) if len(at) > 1 else []
        if pc.any(unsafe).as_py():
            odd = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
            for i, ids in zip(odd.tolist(), self.whole([texts[i].as_py() for i in odd.tolist()]), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null counts as empty), as unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            base = end[len(out) - 1] if out else 0
            n = max(1, int(np.searchsorted(end, base + BLOCK_BYTES, side="right")) - len(out))
            out += self._block(texts.slice(len(out), n))
        release()
        return out


_MODELS: dict[tuple[str, str], PieceEncoder] = {}
MEMORIES["tokens"] = _MODELS.clear


def encoder(path: str, split: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file; asked for once a task."""
    only("tokens")
    if (path, split) not in _MODELS:
        _MODELS[path, split] = PieceEncoder(path, split)
    return _MODELS[path, split]
