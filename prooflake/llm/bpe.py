"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of the whole table, found by one aggregation, are the corpus; Spark divides it by hash.  In each part an
inverted index from merge rank (a token pair) to the positions where the pair stands drives the replay: ranks are taken
in order, a merge is applied at all its positions, and only the two touched neighbours of each get new index entries.
Words never interact, so the result is that of encoding every pre-token alone, each once for the whole table.  Their ids go
into sorted pages (``pages``) in the shared folder, where the texts' pre-tokens are looked up; texts aren't shuffled.
Decoding looks ids up in the table; a text whose decoded bytes are not its own bytes
(which only a hash collision between two pre-tokens could cause) is encoded again without the cache.

Defined cases: a null text is empty and has no ids; repeated rows are rows of their own; an empty table gives no rows;
further columns of the input are ignored; texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .pages import Pages, store
from .scratch import Scratch
from .wordcache import WordCache

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many words together by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, or -1."""
        k = a << 32 | b
        r = self.pairs.get(k)
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[k] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(w) for w in words]
        open_ = [k for k, r in enumerate(whole) if r is None and words[k]]
        tok: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        base: list[int] = []
        index: dict[int, list[int]] = {}
        rank, byte_id = self.rank, self.byte_id
        for k in open_:
            b = len(tok)
            base.append(b)
            ids = [byte_id[x] for x in words[k]]
            tok += ids
            nxt += range(b + 1, b + len(ids) + 1)
            nxt[-1] = -1
            prv += range(b - 1, b + len(ids) - 1)
            prv[b] = -1
            for i in range(len(ids) - 1):
                r = rank(ids[i], ids[i + 1])
                if r >= 0:
                    index.setdefault(r, []).append(b + i)
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            wait: set[int] = set()  # words in which a pair of lower rank arose: it goes first
            later: list[int] = []
            for i in places:
                j = nxt[i]
                if j < 0 or tok[i] < 0 or rank(tok[i], tok[j]) != r:
                    continue
                if wait and bisect_right(base, i) in wait:
                    later.append(i)
                    continue
                tok[i], tok[j] = r, -1
                n = nxt[i] = nxt[j]
                nxt[j] = -1
                if n >= 0:
                    prv[n] = i
                    s = rank(r, tok[n])
                    if s >= 0:
                        if s not in index:
                            index[s] = []
                            heappush(heap, s)
                        index[s].append(i)
                        if s < r:
                            wait.add(bisect_right(base, i))
                p = prv[i]
                if p >= 0:
                    s = rank(tok[p], r)
                    if s >= 0:
                        if s not in index:
                            index[s] = []
                            heappush(heap, s)
                        index[s].append(p)
                        if s < r:
                            wait.add(bisect_right(base, i))
            if later:
                index.setdefault(r, []).extend(later)
                heappush(heap, r)
        out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
        left = np.array(tok, np.int64)
        bounds = np.append(np.array(base, np.int64), len(left))
        alive = left >= 0
        flat = left[alive].astype("<u4").tobytes()
        at = np.append(0, np.cumsum(alive))[bounds].tolist()
        for k, a, b in zip(open_, at, at[1:], strict=False):
            out[k] = flat[4 * a : 4 * b]
        return out


class Decoder:
    """Bytes of id arrays, by one gather."""

    def __init__(self, bytes_of: dict[int, bytes]):
        n = max(bytes_of) + 1
        each = [bytes_of.get(i, b"") for i in range(n)]
        self.data = np.frombuffer(b"".join(each), np.uint8)
        self.len = np.fromiter(map(len, each), np.int64, n)
        self.first = np.cumsum(self.len) - self.len

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.len[ids]
        upto = np.cumsum(n)
        if not len(upto):
            return b""
        return self.data[np.repeat(self.first[ids] - (upto - n), n) + np.arange(upto[-1])].tobytes()


#: Bytes of pre-tokens that one replay takes (a longer one is taken alone), and pre-tokens that a task remembers as sent.
REPLAY_BYTES, SENT = 1 << 20, 500_000

_WORKER: dict[str, tuple[MergeReplay, Decoder]] = {}
_CACHE: dict[str, WordCache] = {}


def codec(path: str) -> tuple[MergeReplay, Decoder]:
    """This process's replay and decoder for a rank file."""
    if path not in _WORKER:
        replay = MergeReplay(load_ranks(path))
        _WORKER[path] = replay, Decoder(replay.bytes_of)
    return _WORKER[path]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word): pre-tokens by hash, each once for as long as the task remembers it."""
    sent: set[int] = set()
    for batch in batches:
        for _, _, data, offsets in K.calls(batch.column("text")):
            starts, _ = K.pretokens(data, offsets)
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(data))
            code, uniq = pd.factorize(K.slice_hash(data, starts, ends))
            where = np.empty(len(uniq), np.int64)
            where[code] = np.arange(len(code))
            if len(sent) > SENT:
                sent.clear()
            new = [k for k, h in enumerate(uniq.tolist()) if h not in sent]
            if new:
                sent.update(uniq[new].tolist())
                raw, at = data.tobytes(), where[new]
                words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(uniq[new].view(np.int64)), pa.array(words, pa.binary())], names=["key", "word"])


def _replayed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, _ = codec(path)
        keys: list[int] = []
        words: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([""] * n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(replay.encode(words), pa.binary())], names=["lang", "part", "key", "v"])

        for batch in batches:
            for key, word in zip(batch.column("key").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if words and size + len(word) > REPLAY_BYTES:
                    yield out()
                    keys, words, size = [], [], 0
                keys.append(key)
                words.append(word)
                size += len(word)
        if words:
            yield out()

    return run


def replay(docs: DataFrame, vocabulary: str, keep: Scratch) -> Pages:
    """Ids of every distinct pre-token of the table, by its hash; of two with one hash the smaller (see ``_encode``)."""
    words = docs.select("text").mapInArrow(_words, "key long, word binary").groupBy("key").agg(F.min("word").alias("word"))
    encoded = keep.keep(keep.keep(words, "words").mapInArrow(_replayed(vocabulary), "lang string, part int, key long, v binary"), "encoded")
    pages = store(encoded, keep.path("pages"))
    keep.drop("words", "encoded")
    return pages


def _cache(path: str, pages: Pages) -> WordCache:
    """This process's cache in front of the pages."""
    if pages.root not in _CACHE:
        _CACHE.clear()
        _CACHE[pages.root] = WordCache(codec(path)[0].encode, find=lambda key: pages.find_bytes("", 0, key))
    return _CACHE[pages.root]


def _encode(path: str, pages, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, decoder = codec(path)
        cache = _cache(path, pages.value)
        for batch in batches:
            ids_col = batch.column("doc_id")
            for lo, hi, data, offsets in K.calls(batch.column("text")):
                ids, bounds = cache.batch(data, offsets)
                raw = data.tobytes()
                n, a, d, lists = [], [], [], []
                whole = decoder.decode(ids) == raw
                for i in range(hi - lo):
                    own = ids[bounds[i] : bounds[i + 1]]
                    text = raw[offsets[i] : offsets[i + 1]]
                    if not whole and decoder.decode(own) != text:
                        own, _ = WordCache(replay.encode).batch(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                    n.append(len(own))
                    a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    d.append(hashlib.sha256(text if whole else decoder.decode(own)).hexdigest())
                    lists.append(own if with_ids else None)
                cols = [ids_col.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pages = docs.sparkSession.sparkContext.broadcast(replay(own, vocabulary, Scratch(docs.sparkSession, "bpe")))  # the pages' index: a row for 65,536 pre-tokens
    return own.mapInArrow(_encode(vocabulary, pages, with_ids), schema)


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text encoded and decoded again."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or public_tokenizers.path(VOCABULARY), with_ids=False)
