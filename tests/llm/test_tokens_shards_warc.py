import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from prooflake.llm import bpe, kernels, packing, pages, sharding, warc
from prooflake.llm.scratch import Scratch

ODD = [(0, None), (1, ""), (2, "a"), (2, "a"), (3, "same text here"), (4, "same text here"), (5, "x" * 70_000), (6, "word " * 9_000), (7, "It's 'll I'VE   \n\n é中😀   12²"), (8, " \t ")]


def rows(spark, sf, table="documents"):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


def test_pretokens_equal_the_pattern():
    rx, rng = regex.compile(P.PATTERN), random.Random(3)
    parts = ["'", " ", "\n", "s", "t", "re", "ve", "ll", "d", "m", "a", "É", "1", "!", "²", "　", "\t", "  ", "中", "😀", "'s", "'re", "\x85", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["", None]
    at = 0
    for lo, hi, data, offsets in kernels.calls(pa.array(texts, pa.string()), 1000):
        starts, bounds = kernels.pretokens(data, offsets)
        for i in range(hi - lo):
            s = [*starts[bounds[i] : bounds[i + 1]].tolist(), int(offsets[i + 1])]
            assert [data[a:b].tobytes().decode() for a, b in zip(s, s[1:])] == rx.findall(texts[at] or "")
            at += 1
    assert at == len(texts)


def test_replay_equals_the_library():
    ranks = bpe.load_ranks(P.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu 'éß中0") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["a" * 300, "ab" * 200]
    got = bpe.MergeReplay(ranks).encode([w.encode() for w in words])
    for w, g in zip(words, got):
        assert np.frombuffer(g, "<u4").tolist() == enc._core_bpe.encode_single_piece(w.encode())


def check_bpe(expected, got):
    ranks = bpe.load_ranks(P.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in expected:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(want) == sorted(tuple(r) for r in got)


def test_bpe(spark, sf, frame, table):
    check_bpe([(r.doc_id, r.text) for r in rows(spark, sf)], bpe.op8_bpe(spark, sf).collect())
    check_bpe(ODD, bpe.op8_bpe(spark, table(frame(ODD))).collect())
    out = bpe.encode_documents(frame([(1, "hello world")]), P.path(bpe.VOCABULARY)).collect()
    assert len(out[0].ids) == out[0].n_tokens


def check_packing(expected, got, window=2048):
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = defaultdict(list)
    for i, text in expected:
        want[i].append(t.encode(text or "", add_special_tokens=False).ids + [1])
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(want)
    for i, pieces in docs.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        crcs = sorted(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids in want[i] for p in pieces[: len(pieces) // len(want[i])]) if len(want[i]) == 1 else None
        if crcs is not None:
            assert crcs == sorted(p.ids_crc32 for p in pieces)
            assert {p.doc_tokens for p in pieces} == {len(want[i][0])}
            assert sorted((p.start, p.start + p.length) for p in pieces)[-1][1] == len(want[i][0])
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(seqs)


def test_packing(spark, sf, frame, table):
    got = packing.op9_packing(spark, sf).collect()
    n = check_packing([(r.doc_id, r.text) for r in rows(spark, sf)], got)
    assert n <= 1.02 * sum(r.length for r in got) / 2048 + 1
    odd = [*ODD, (9, "a<|endoftext|>b")]
    check_packing(odd, packing.op9_packing(spark, table(frame(odd))).collect())


def test_plan_equals_best_fit_decreasing_one_by_one():
    rng = random.Random(2)
    for _ in range(50):
        window = rng.choice([7, 20, 64])
        hist = {k: rng.randint(1, 9) for k in rng.sample(range(1, window), rng.randint(1, window - 1))}
        free = []
        for length in sorted(hist, reverse=True):
            for _ in range(hist[length]):
                fits = [k for k, f in enumerate(free) if f >= length]
                k = min(fits, key=lambda k: free[k]) if fits else len(free)
                free[k:] = [window - length] if k == len(free) else [free[k] - length, *free[k + 1 :]]
        runs, opened = packing.best_fit_plan(hist, window)
        assert opened == len(free)
        fill = defaultdict(list)
        for length in hist:
            own = sorted(r for r in runs if r[0] == length)
            for at in range(hist[length]):
                r = [x for x in own if x[1] <= at][-1]
                k = at - r[1]
                fill[r[2] + k // r[3]].append((r[4] + k % r[3] * length, length))
        left = []
        for pieces in fill.values():
            at = 0
            for off, length in sorted(pieces):
                assert off == at
                at += length
            left.append(window - at)
        assert sorted(left) == sorted(free)


def check_shards(expected, got, shards=40):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in expected)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by[k]) for k in range(shards)]


def test_sharding(spark, sf, frame, table):
    got = sharding.op10_sharding(spark, sf).collect()
    sizes = check_shards([(r.doc_id, r.text) for r in rows(spark, sf)], got)
    most = max(r.size for r in got)
    assert max(sizes) - min(sizes) <= 2.2 * most
    check_shards(ODD, sharding.op10_sharding(spark, table(frame(ODD))).collect())
    many = [(i, f"text {i} " * 20) for i in range(3000)] + [(5000 + i, "copy " * 8) for i in range(500)]
    full = sharding.shard_by_bytes(spark, frame(many)).collect()
    at = 0
    for r in sorted(full, key=lambda r: (r.shard, r.slot)):  # contiguous
        assert r.first_byte == at
        at += r.size
    total = [sum(r.size for r in full if r.shard == k) for k in range(40)]
    assert max(total) <= 1.05 * sum(total) / 40 and min(total) >= 0.95 * sum(total) / 40


PAGES = "page_id long, url string, html string, digest string, block string, refers_to string"


def check_warc(expected, got):
    first = {}
    for i, _, h in expected:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in expected:
        b = (h or "").encode()
        again = i is not None and first[h or ""] < i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    key = lambda r: str(r)
    assert sorted(want, key=key) == sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key)


def test_warc(spark, sf, table):
    check_warc([(r.page_id, r.url, r.html) for r in rows(spark, sf, "pages")], warc.op3_warc(spark, sf, segment_bytes=1000).collect())
    odd = [(1, "u", None), (2, None, ""), (3, "a b\nc", "WARC/1.1\r\n\r\n0\r\n\r\n"), (4, "x", "é中😀" * 5000), (5, "x", "é中😀" * 5000), (6, "x", "b"), (6, "x", "b"), (None, "x", "b"), (7, "x", "b"), (8, "x", "p"), (9, "x", "q"), (11, "x", "p"), (11, "x", "q"), (12, "x", "p"), (12, "x", "zzz"), (8, "y", "q")]
    check_warc(odd, warc.op3_warc(spark, table(spark.createDataFrame([(*r, "d", "b", "r") for r in odd], PAGES), "pages"), segment_bytes=700).collect())


def test_empty_tables(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    for f in (bpe.op8_bpe, packing.op9_packing, sharding.op10_sharding, warc.op3_warc):
        assert f(spark, str(tmp_path)).collect() == []


def test_segments_and_chunks():
    block = ("é" * 1000).encode()
    parts = warc.segments(block, 301)
    assert b"".join(parts) == block and all(p.decode() and len(p) <= 301 for p in parts)
    assert warc.dechunk(warc.chunked(block, 77)) == block and warc.dechunk(warc.chunked(b"")) == b""
    found = [(k, len(block) if k == len(parts) else None, p) for k, p in enumerate(parts, 1)]
    assert warc.join_segments(found[::-1]) == block
    for bad in (found[1:], found[:-1], [*found[:-1], (len(parts), 5, parts[-1])]):
        with pytest.raises(ValueError):
            warc.join_segments(bad)
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc")


def test_segments_of_repeated_pages_are_groups_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 4000)] * 30 + [(2, "u", "é" * 4000)], "page_id long, url string, html string").repartition(4)
    warc.write_archives(pages, f"{tmp_path}/a", warc.revisits(pages), 700)
    parsed = spark.read.format("binaryFile").load(f"{tmp_path}/a").select("content").mapInArrow(warc._parser(False), warc._PARSED)
    sizes = [r["count"] for r in parsed.where("segment IS NOT NULL").groupBy("origin", "copy").count().collect()]
    assert len(sizes) == 30 and len(set(sizes)) == 1 and sizes[0] < 20
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, f"{tmp_path}/a").collect()]
    assert sorted(got) == [(1, "response", None, 8000)] * 30 + [(2, "revisit", 1, 8000)]


@pytest.mark.parametrize("page", [1, 7, 1 << 16])
def test_pages_hold_byte_strings(spark, page):
    rng = np.random.default_rng(page)
    rows = {(part, int(k)): bytes(rng.integers(0, 256, int(k) % 9, np.uint8)) for part in (0, 1) for k in rng.integers(-(1 << 63), (1 << 63) - 1, 200)}
    df = spark.createDataFrame([("", *k, v) for k, v in rows.items()], "lang string, part int, key long, v binary").repartition(4)
    found = pages.store(df, Scratch(spark, "test").path("pages"), page)
    for part in (0, 1, 2):
        key = [k for _, k in rows] + [0, 1, -1]
        assert found.find_bytes("", part, np.array(key)) == [rows.get((part, k)) for k in key]


def test_each_pretoken_is_replayed_once_for_the_table(spark, frame):
    rng = np.random.default_rng(5)
    words = [" " + "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(1, 14))) for _ in range(300)] + ["😀é" * 50, " " * 400]
    docs = frame([(i, "".join(rng.choice(words, 80))) for i in range(60)] + [(99, None), (100, ""), (101, words[-2])]).repartition(6)
    found = bpe.replay(docs, P.path(bpe.VOCABULARY), Scratch(spark, "test"))
    ranks = bpe.load_ranks(P.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    distinct = {m for r in docs.collect() for m in regex.findall(P.PATTERN, r.text or "")}
    assert sum(int(x[4].sum()) for x in found.of.values()) == len(distinct)
    data = [w.encode() for w in sorted(distinct)]
    ends = np.cumsum([len(w) for w in data])
    key = kernels.slice_hash(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]), ends).view(np.int64)
    for w, ids in zip(data, found.find_bytes("", 0, key), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc._core_bpe.encode_single_piece(w)
