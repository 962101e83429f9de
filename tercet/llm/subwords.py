"""Batch encoding with a public byte-level BPE file through the tokenizers library.

Texts are cut only where the tokenizer's own pre-tokenisation always cuts: before a space or line
feed that follows a visible character. Equal chunks are encoded once and their ids reused, so a
worker asks the library only for chunks that it has not met yet.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tercet.llm.textkernel import blocks, mix, segment_hash

#: Chunks that a worker remembers; beyond it, it starts afresh. Bounds memory, not results.
REMEMBERED = 1_500_000

_ENCODERS: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_length = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.byte_length[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if len(self.byte_length) <= 1 << 16 else np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new chunks: those that can stand in one text together, the few others singly.

        In a text made of joined chunks, the tokens' byte lengths tell where each chunk ends.
        """
        joins = np.array([p[0] in b" \n" and (0x20 < p[-1] < 0x7F or p[-2:-1] == b"\xc3") for p in pieces])
        joined = [p for p, j in zip(pieces, joins, strict=True) if j]
        alone = [p.decode("utf-8") for p, j in zip(pieces, joins, strict=True) if not j]
        got = [x.ids for x in self.tokenizer.encode_batch_fast([b"".join(joined).decode("utf-8"), *alone], add_special_tokens=False)]
        reached = np.concatenate(([0], np.cumsum(self.byte_length[np.array(got[0], np.int64)])))
        ends = np.cumsum([len(p) for p in joined])
        upto = np.searchsorted(reached, ends, "left")
        if not np.array_equal(reached[upto], ends):
            raise AssertionError("a chunk did not end with a token")
        sizes = np.concatenate((np.diff(upto, prepend=0), np.array([len(x) for x in got[1:]], np.int64))).astype(np.int64)
        ids = np.concatenate([np.array(x, np.int64) for x in got])
        keys = np.concatenate((keys[joins], keys[~joins]))
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(keys)
        keys, begin, sizes = keys[order], begin[order], sizes[order]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, (begin + self.used).astype(np.int32))
        self.size = np.insert(self.size, at, sizes.astype(np.int32))
        self.used += len(ids)

    def encode_block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and where each document's ids begin."""
        n_docs = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        cut = np.zeros(len(data), bool)
        here = (data[1:] == 0x20) | (data[1:] == 0x0A)
        before = data[:-1]
        visible = (before > 0x20) & (before < 0x7F)
        visible[1:] |= (before[1:] >= 0x80) & (data[:-2] == 0xC3)
        cut[1:] = here & visible
        cut[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = mix(segment_hash(data.astype(np.uint64) + np.uint64(1), starts))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED and len(self.keys):
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        unknown = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        unknown[inside] = self.keys[at[inside]] != distinct[inside]
        if unknown.any():
            raw = data.tobytes()
            self._learn(distinct[unknown], [raw[starts[j] : ends[j]] for j in first[unknown]])
            at = np.searchsorted(self.keys, distinct)
        slots = at[which]
        sizes, begins = self.size[slots].astype(np.int64), self.begin[slots].astype(np.int64)
        total = np.cumsum(sizes)
        where = np.repeat(begins - (total - sizes), sizes)
        where += np.arange(len(where))
        doc = np.searchsorted(off, starts, "right") - 1
        per_doc = np.bincount(doc, weights=sizes, minlength=n_docs).astype(np.int64)
        return self.flat[where].astype(np.uint32), np.concatenate(([0], np.cumsum(per_doc)))

    def encode_column(self, column: pa.Array):
        """Yield (row, ids) for every row of a string column; null counts as empty."""
        for at, to, data, off in blocks(column):
            ids, place = self.encode_block(data, off)
            for i in range(to - at):
                yield at + i, ids[place[i] : place[i + 1]]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
