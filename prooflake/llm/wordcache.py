"""Token ids of whole text batches: each distinct pre-token is encoded once per worker generation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from . import kernels as K


class WordCache:
    """Ids of pre-tokens by their 64-bit hash; forgets everything when it holds ``most`` entries.

    ``find``, if given, is asked by hash first; what it doesn't know is encoded.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 400_000, find: Callable[[np.ndarray], list[bytes | None]] | None = None):
        self.encode, self.most, self.find, self.ids = encode, most, find, {}

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all rows of a slice one after another, and each row's bounds in them."""
        starts, bounds = K.pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        code, uniq = pd.factorize(K.slice_hash(data, starts, ends))
        where = np.empty(len(uniq), np.int64)  # some place of each distinct pre-token
        where[code] = np.arange(len(code))
        keys = uniq.tolist()
        if len(self.ids) > self.most:
            self.ids.clear()
        got = self.ids
        new = [k for k, h in enumerate(keys) if h not in got]
        if new and self.find:
            found = self.find(uniq[new].view(np.int64))
            got.update((keys[k], ids) for k, ids in zip(new, found, strict=True) if ids is not None)
            new = [k for k, ids in zip(new, found, strict=True) if ids is None]
        if new:
            raw = data.tobytes()
            at = where[new]
            for lo in range(0, len(new), 20_000):
                part = [raw[a:b] for a, b in zip(starts[at[lo : lo + 20_000]].tolist(), ends[at[lo : lo + 20_000]].tolist(), strict=True)]
                for k, ids in zip(new[lo : lo + 20_000], self.encode(part), strict=True):
                    got[keys[k]] = ids
        each = [got[h] for h in keys]
        pool = np.frombuffer(b"".join(each), np.uint32)
        n = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        first = np.cumsum(n) - n
        count = n[code]
        upto = np.cumsum(count)
        flat = np.repeat(first[code] - (upto - count), count) + np.arange(upto[-1])
        return pool[flat], np.append(0, upto)[bounds]
