"""Interpolated Kneser-Ney models of four letters, one a language, in sorted hash arrays.

Text is read as lower-case letters; whatever lies between letters is one gap, and so are both ends. A
gram of four symbols of 16 bits is one 64-bit number, and a bijective mixer makes it the hash by which
arrays are sorted: no two grams share one. (Letters beyond the basic plane share the 6,400 private
codes.) Models are made from counts of four-letter grams alone, since Kneser-Ney counts of lower orders
are numbers of distinct longer grams.
"""

from __future__ import annotations

import numpy as np

from tercet.llm.textkernel import mix

ORDER, BITS = 4, 16
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: 0 if it is no letter, else the 16-bit symbol of its lower case."""
    if not _LETTERS:
        out = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                k = ord(low) if len(low) == 1 else c
                out[c] = k if k <= 0xFFFF else 0xE000 + k % 0x1900
        _LETTERS.append(out)
    return _LETTERS[0]


def _points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of documents, and each document's number of them."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
        return points, np.diff(upto)
    except UnicodeDecodeError:
        each = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), "<u4") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.concatenate(each) if each else np.zeros(0, "<u4"), np.array([len(e) for e in each], np.int64)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four-symbol gram that ends at each symbol of the documents, and how many each document has (0: no letter)."""
    points, sizes = _points(data, off)
    n_docs = len(sizes)
    lead = np.cumsum(sizes + 2) - (sizes + 2)
    symbols = np.zeros(len(points) + 2 * n_docs, np.uint64)
    inside = np.ones(len(symbols), bool)
    inside[lead] = False
    inside[lead + sizes + 1] = False
    symbols[inside] = letters()[points]
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0
    kept[lead] = True
    first = np.zeros(len(symbols), bool)
    first[lead] = True
    symbols, first = symbols[kept], first[kept]
    at = np.flatnonzero(first)
    per_doc = np.diff(np.append(at, len(symbols))) - 1
    key = symbols.copy()
    for back in (1, 2, 3):
        earlier = np.zeros_like(symbols)
        earlier[back:] = symbols[:-back]
        if back == 3:
            after = at + 1
            earlier[after[after < len(symbols)]] = 0  # the document before
        key |= earlier << np.uint64(BITS * back)
    return key[~first], per_doc


class Sorted:
    """Rows found by hash: a sorted array with a directory of its leading bits."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys.copy())
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the sorted array, -1 for none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = self.directory[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        last = len(self.hashes) - 1
        going = np.flatnonzero(self.hashes[np.minimum(at, last)] < hashes)
        while len(going):
            at[going] += 1
            going = going[at[going] <= last]
            going = going[self.hashes[at[going]] < hashes[going]]
        at[at > last] = last
        return np.where(self.hashes[at] == hashes, at, -1)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


class KneserNey:
    """One language's model from its distinct four-symbol grams and their counts; ``kinds`` is the number of symbols of all languages."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, kinds: int):
        self.kinds, self.orders = kinds, []
        for order in range(ORDER, 0, -1):
            discount = _discount(counts)
            context, which = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(which, weights=counts, minlength=len(context))
            types = np.bincount(which, minlength=len(context))
            own, rest = Sorted(keys), Sorted(context)
            share = (counts - discount) / total[which]
            self.orders.append((order, own, share[own.order], rest, (discount * types / total)[rest.order]))
            if order > 1:  # lower orders count the distinct grams that they end
                keys, counts = np.unique(keys & np.uint64((1 << (BITS * (order - 1))) - 1), return_counts=True)
        self.orders.reverse()

    def chances(self, keys: np.ndarray) -> np.ndarray:
        """Probability of each gram's last symbol after the others."""
        p = np.full(len(keys), 1 / self.kinds)
        for order, own, share, rest, left in self.orders:
            gram = keys & np.uint64((1 << (BITS * order)) - 1) if order < ORDER else keys
            at, ctx = own.find(mix(gram.copy())), rest.find(mix(gram >> np.uint64(BITS)))
            p = np.where(at >= 0, share[at], 0.0) + np.where(ctx >= 0, left[ctx], 1.0) * p
        return p


class Languages:
    """All languages' models, and their log2 probabilities of every gram that any has seen side by side."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counted)
        every = np.unique(np.concatenate([counted[k][0] for k in self.names])) if self.names else np.zeros(0, np.uint64)
        kinds = len(np.unique(every & np.uint64((1 << BITS) - 1))) + 1
        self.models = [KneserNey(*counted[k], kinds) for k in self.names]
        self.seen = Sorted(every)
        self.logs = self._logs(every[self.seen.order])

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.log2(m.chances(keys)).astype(np.float32) for m in self.models], axis=1) if self.models else np.zeros((len(keys), 0), np.float32)

    def entropies(self, keys: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Bits a symbol of each document under each language; nan for a document without letters."""
        at = self.seen.find(mix(keys.copy()))
        out = np.full((len(per_doc), len(self.names)), np.nan)
        some = np.flatnonzero(per_doc)
        if not len(some) or not self.names:
            return out
        begins = (np.cumsum(per_doc) - per_doc)[some]
        missed = np.flatnonzero(at < 0)
        strange, which = np.unique(keys[missed], return_inverse=True)
        more = self._logs(strange)
        for k in range(len(self.names)):
            value = self.logs[:, k][at] if len(self.logs) else np.zeros(len(keys), np.float32)
            value[missed] = more[which, k]
            out[some, k] = -np.add.reduceat(value, begins, dtype=np.float64) / per_doc[some]
        return out
