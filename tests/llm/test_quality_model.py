"""The language model end to end: verdicts against a plain model over several languages, and its pages of sorted arrays."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prooflake.llm import kernels as K
from prooflake.llm import pages, quality
from prooflake.llm.scratch import Scratch

from test_text_operators import LOWER, plain_counts, plain_model


def units(text):
    """A text as a string of UTF-16 units; U+FFFF is two units that nothing else has."""
    data = (text or "").translate(LOWER).replace("\uffff", "\udfff\udfff").encode("utf-16-le", "surrogatepass")
    return "".join(chr(int.from_bytes(data[i : i + 2], "little")) for i in range(0, len(data), 2))


def corpus():
    """(doc_id, text, lang): three large languages, two small ones, null texts; some texts of noise, some of one letter."""
    rng = np.random.default_rng(21)
    letters = {"en": list("etaoinshr"), "emoji": [*"abcdef", "😀", "😁", "\uffff", "\U0002f800"], None: list("абвгдежз"), "s1": list("etaoinshr"), "s2": list("mnopq")}
    rows = []
    for lang, of in letters.items():
        words = ["".join(rng.choice(of, rng.integers(2, 8))) for _ in range(200)]
        n = 8 if lang in ("s1", "s2") else 60
        rows += [(" ".join(rng.choice(words, 90)), lang) for _ in range(n)]
        rows += [(" ".join("".join(rng.choice(list("QXZJKV0123456789😂€"), 6)) for _ in range(70)), lang) for _ in range(2)]
        rows += [(" ".join(of[0] * int(k) for k in rng.integers(1, 60, 70)), lang), ("too short", lang), (None, lang), ("", lang)]
    return [(i, t, lang) for i, (t, lang) in enumerate(rows)]


def plain_bands(measured):
    """(lang -> (lo, hi)) from (lang, log-perplexity) of the documents that pass the base rules; None: small languages."""
    n = Counter(lang for lang, _ in measured)
    groups = defaultdict(list)
    for lang, x in measured:
        groups[lang if n[lang] >= quality.BAND_MIN else ""].append(math.floor(x / quality.BIN))
    everything = sorted(b for g in groups.values() for b in g)

    def quartiles(bins):
        bins = sorted(bins)
        return bins[math.ceil(len(bins) / 4) - 1] * quality.BIN, (bins[math.ceil(3 * len(bins) / 4) - 1] + 1) * quality.BIN

    out = {}
    for lang, bins in groups.items():
        q, share = quartiles(bins), 1.0
        if lang == "":
            share = len(bins) / (len(bins) + quality.BAND_MIN)
        q1, q3 = (share * a + (1 - share) * b for a, b in zip(q, quartiles(everything)))
        out[lang] = q1 - quality.BAND_REACH * (q3 - q1), q3 + quality.BAND_REACH * (q3 - q1)
    return out


def test_verdicts_equal_a_plain_model_in_several_languages(spark, table):
    rows = corpus()
    models, ppl, failed = {}, {}, {}
    for lang in {r[2] for r in rows}:
        models[lang] = plain_model([units(t) for _, t, of in rows if of == lang])
    for i, t, lang in rows:
        u = [-1] * 3 + list(units(t))
        ppl[i] = -np.mean([models[lang](tuple(u[k : k + 4])) for k in range(len(u) - 3)]) if t else 0.0
        n = plain_counts(t)
        failed[i] = n[0] < 50 or 100 * n[4] > 50 * n[0]
    passing = [(lang, ppl[i]) for i, _, lang in rows if not failed[i]]
    band = plain_bands(passing)
    got = {r.doc_id: r for r in quality.op5_quality(spark, table(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert len(got) == len(rows)
    verdicts, close = Counter(), 0
    for i, _, lang in rows:
        assert abs(got[i].log_ppl - ppl[i]) < 1e-3
        lo, hi = band.get(lang, band[""])
        if not failed[i] and min(abs(ppl[i] - lo), abs(ppl[i] - hi)) < 0.1:  # a quartile's bin may differ by one
            close += 1
            continue
        kept = not failed[i] and lo <= ppl[i] <= hi
        assert got[i].kept == kept, (lang, ppl[i], lo, hi)
        verdicts[failed[i], kept] += 1
    assert close < 10 and verdicts[False, True] > 150 and verdicts[False, False] >= 3 and verdicts[True, False] >= 15


def test_every_character_keeps_its_own_key():
    texts = ["\U0001f600a", "\U0001e600a", "a", "\uffffa", "a", "\udfff", "A\U0010ffff\uffff", ""]
    texts = [t for t in texts if t != "\udfff"]  # no text of a table holds half a pair
    data, offsets = K.text_buffers(pa.array(texts))
    key, bounds = quality.grams(data, offsets)
    runs = [key[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(r) for r in runs] == [len(units(t)) for t in texts]
    for t, r in zip(texts, runs):
        u = "\uffff" * 3 + units(t)
        want = [int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in u[i : i + 4]), "big", signed=True) for i in range(len(u) - 3)]
        assert r.tolist() == want
    assert len({tuple(r) for r in runs}) == len(texts)


@pytest.mark.parametrize("page", [1, 3, 64, 1 << 16])
def test_pages_find_what_a_dictionary_finds(spark, page):
    rng = np.random.default_rng(page)
    rows = {(lang, part, int(k)): float(np.float32(k % 97)) for lang, part, n in (("a", 1, 300), ("a", 2, 1), ("\x00", 1, 50), ("ü", 11, 7)) for k in rng.integers(-(1 << 63), (1 << 63) - 1, n)}
    rows |= {("a", 1, k): 1.5 for k in (-(1 << 63), (1 << 63) - 1, 0)}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "lang string, part int, key long, v float").repartition(5)
    keep = Scratch(spark, "test")
    found = pages.store(df, keep.path("pages"), page)
    for lang, part in {k[:2] for k in rows} | {("none", 1), ("a", 9)}:
        own = [k[2] for k in rows if k[:2] == (lang, part)]
        key = np.array(own + [5, -5] + [k + 1 for k in own if k < (1 << 63) - 1] + own[:3], np.int64)
        hit, v = found.find(lang, part, key)
        assert hit.tolist() == [(lang, part, k) in rows for k in key.tolist()]
        assert v.tolist() == [rows.get((lang, part, k), 0) for k in key.tolist()]
    assert sum(len(x[0]) for x in found.of.values()) >= len(rows) // (page + 2000) + 1


def test_no_entries_make_no_pages(spark):
    keep = Scratch(spark, "test")
    found = pages.store(spark.createDataFrame([], "lang string, part int, key long, v float"), keep.path("pages"))
    assert found.of == {} and not found.find("a", 1, np.array([1, 2]))[0].any()
