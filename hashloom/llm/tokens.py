"""Whole texts to token ids with the tokenizers library, fast on repeated words.

Byte-level BPE splits a text into pieces before merging, and a piece never
spans the gap before a space that follows a non-space. So a text is cut there,
and each distinct cut is encoded by the library once and remembered. The
result equals encoding the whole text. Texts in which the string of an added
token stands (special ones among them) are encoded whole, as is every text
where the tokenizer does not split by ByteLevel.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GAP = re.compile(r"(?<=\S)(?= )")
#: Chunks remembered: beyond MOST, all but the first KEEP are forgotten. The
#: first ones met are mostly the frequent ones; it only saves time.
MOST, KEEP = 450_000, 220_000
#: Chunks encoded in one call of the library.
JOINED = 64


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, as the library's encode(text, add_special_tokens=False) has them."""

    def __init__(self, path: str, most: int = MOST, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [x.content for x in self.lib.get_added_tokens_decoder().values() if x.content]
        # An added token with white space in it could come of chunks that are joined.
        self.cuts = type(self.lib.pre_tokenizer).__name__ == "ByteLevel" and self.lib.normalizer is None and not any(re.search(r"\s", x) for x in self.added)
        # The library's own memory of words only costs time, as each chunk comes once.
        if self.cuts and hasattr(self.lib.model, "_resize_cache"):
            self.lib.model._resize_cache(0)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        # In byte-level BPE a letter of a token's name stands for a byte.
        self.bytes = np.zeros(self.lib.get_vocab_size(), np.int64)
        for name, i in self.lib.get_vocab().items():
            self.bytes[i] = len(name)
        self.most, self.keep = most, keep
        self.known: dict[str, int] = {}  # chunks after a space, without it
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        # Of each chunk: its first id in flat, its ids, and whether it is empty or ends in white space.
        self.begin, self.size, self.edge = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)

    def rest(self) -> None:
        """Gives memory back at the end of a task, as workers are used again."""
        if len(self.known) > self.keep:
            self._forget()

    def _forget(self) -> None:
        self.known = dict(islice(self.known.items(), self.keep))
        self.used = int(self.begin[self.keep])
        self.flat = self.flat[: max(self.used, 1)].copy()
        self.begin, self.size, self.edge = (x[: self.keep + 1].copy() for x in (self.begin, self.size, self.edge))

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.lib.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum())), sizes

    def _joined(self, chunks: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks after spaces, one after the other, and how many each has.

        Such chunks may stand beside each other in one call; the bytes of
        chunks and of tokens tell which ids belong to which."""
        ids, _ = self._alone([" " + " ".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)])
        upto = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(lengths + 1), side="right")
        return ids, np.diff(upto, prepend=0)

    def _learn(self, chunks: list[str], lengths: np.ndarray, last: np.ndarray) -> None:
        """Remembers chunks, whose UTF-8 has the given lengths and last bytes."""
        edge = lengths == 0
        # White space beyond ASCII ends in a byte beyond it.
        for i in np.flatnonzero(~edge & ((last <= 0x20) | (last >= 0x80))).tolist():
            edge[i] = chunks[i][-1].isspace()
        if edge.any():
            at, away = np.flatnonzero(~edge), np.flatnonzero(edge)
            chunks, lengths, ends = [chunks[i] for i in at], lengths[at], [chunks[i] for i in away]
        else:
            ends = []
        (ids, sizes), (more, others) = self._joined(chunks, lengths), self._alone([" " + c for c in ends])
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, others])
        n, at, total, new = len(self.known), self.used, len(ids), len(chunks) + len(ends)
        while at + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(1 << 16, len(self.flat) // 2), self.dtype)])
        while n + new >= len(self.begin):
            self.begin, self.size, self.edge = (np.concatenate([x, np.zeros(max(1 << 14, len(x) // 2), x.dtype)]) for x in (self.begin, self.size, self.edge))
        self.flat[at : at + total] = ids
        self.size[n : n + new] = sizes
        self.edge[n : n + new] = np.arange(new) >= len(chunks)
        self.begin[n : n + new + 1] = at + np.concatenate([[0], np.cumsum(sizes)])
        self.used = at + total
        self.known.update(zip(chain(chunks, ends), range(n, n + new), strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text; nulls are empty."""
        texts = [x or "" for x in texts]
        if not texts:
            return []
        if not self.cuts:
            return [self._whole(x) for x in texts]
        if len(self.known) > self.most:
            self._forget()
        marked = [i for i, x in enumerate(texts) if any(a in x for a in self.added)]
        if marked:
            whole, texts = {i: self._whole(texts[i]) for i in marked}, list(texts)
            for i in marked:
                texts[i] = ""
            out = self.encode(texts)
            for i, ids in whole.items():
                out[i] = ids
            return out
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int32, len(chunks))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [chunks[i] for i in new]
            ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[coded.dictionary.offset :][: len(chunks) + 1]
            data = np.frombuffer(coded.dictionary.buffers()[2] or b"\0", np.uint8)
            self._learn(fresh, np.diff(ends)[new], data[np.maximum(ends[1:][new] - 1, 0)])
            place[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int32, len(fresh))
        at = place[coded.indices.to_numpy()]
        # In a text with a space after white space the cuts stand elsewhere. The
        # last chunk of a text has no space behind it.
        edge = self.edge[at]
        edge[starts[1:] - 1] = False
        odd = np.flatnonzero(np.logical_or.reduceat(edge, starts[:-1]))
        # The first chunk of a text has no space before it.
        first, first_sizes = self._alone([x[: x.find(" ")] if " " in x else x for x in texts])
        sizes = self.size[at]
        sizes[starts[:-1]] = 0
        done = np.concatenate([[0], np.cumsum(sizes)])
        kind = np.int32 if max(done[-1], self.used) < 1 << 31 else np.int64
        flat = self.flat[np.repeat((self.begin[at] - done[:-1]).astype(kind), sizes) + np.arange(done[-1], dtype=kind)]
        heads, tails = np.split(first.astype(self.dtype), np.cumsum(first_sizes)[:-1]), np.split(flat, done[starts[1:-1]])
        out = [np.concatenate(x) for x in zip(heads, tails, strict=True)]
        for i in odd.tolist():
            out[i] = self._odd(texts[i])
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)

    def _odd(self, text: str) -> np.ndarray:
        ids, _ = self._alone(_GAP.split(text))
        return ids.astype(self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
