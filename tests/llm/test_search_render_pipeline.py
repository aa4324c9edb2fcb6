import re
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prooflake.llm import html_render, oracle, topk
from test_text_operators import components, plain_counts
from test_tokens_shards_warc import check_packing

VECTORS = "vec_id long, embedding array<float>, label int, q string, score long"


# ---- exact top-k


def plain_top(rows, k=5, every=50):
    ok = [(i, np.floor(np.array(v, np.float64) * 256), v) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out, least = [], {}
    for i, q, v in ok:
        if i % every == 0 and (i not in least or v < least[i][1]):
            least[i] = q, v
    for i, (q, _) in least.items():
        scored = []
        for j, v, _ in ok:
            if j != i:
                n = min(len(q), len(v))
                scored.append((-sum(int(a) * int(b) for a, b in zip(q[:n], v[:n])), j))
        out += [(i, r, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_topk(spark, sf, tmp_path):
    got = topk.op6_topk(spark, sf)
    rel = duckdb.sql(oracle.TOP_K.replace("embeddings", f"'{sf}/embeddings.parquet'"))
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 16))]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # ties
    rows += [(50, rows[50][1]), (5000, None), (5001, [None, 1.0]), (5002, [float("nan")] * 16), (5003, [float("inf")] * 16), (5050, [1.0, -1.0]), (None, [1.0] * 16), (5051, []), (5100, None), (5100, [1.0, 2.0]), (5100, [0.5, 9.0, 1.0])]
    spark.createDataFrame([(*r, 0, "x", 1) for r in rows], VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, topk.op6_topk(spark, str(tmp_path)).collect())) == plain_top(rows)


def test_topk_by_buckets_and_groups_without_broadcast_blocks(spark, tmp_path, monkeypatch):
    """Blocks of queries repeated for every bucket were broadcast, through the driver."""
    monkeypatch.setattr(topk, "VECTORS", 32)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "GROUP", 6)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 4))]) for i in range(900)]
    spark.createDataFrame([(*r, 0, "x", 1) for r in rows], VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op6_topk(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == plain_top(rows)
    plan = got._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for k in (k for k, x in enumerate(plan) if "Build" in x):
        end = next((j for j in range(k + 1, len(plan)) if depth(plan[j]) <= depth(plan[k])), len(plan))
        left, right = (j for j in range(k + 1, end) if depth(plan[j]) == depth(plan[k]) + 3)
        assert not any("vectors" in x for x in (plan[right:end] if "BuildRight" in plan[k] else plan[left:right]))


def test_topk_of_few_and_huge(spark, tmp_path):
    rows = [(0, [1e30, 1.0]), (50, [-1e30, 2.0]), (1, [0.5, 0.5])]
    small = [(0, [1.0, 2.0]), (50, [3.0, 1.0])]
    for name, r in (("small", small), ("none", [])):
        spark.createDataFrame([(*x, 0, "x", 1) for x in r], VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert sorted(map(tuple, topk.op6_topk(spark, f"{tmp_path}/{name}").collect())) == plain_top(r)
    block = topk.ImpactBlock(np.array([i for i, _ in rows]), topk._matrix([np.floor(np.array(v) * 256) for _, v in rows]))
    ids, scores = block.search(block.matrix[2], 1, 2)
    assert ids.tolist() == [0, 50] and scores[0] > 0 > scores[1]
    spark.createDataFrame([(*x, 0, "x", 1) for x in rows], VECTORS).write.parquet(f"{tmp_path}/huge/embeddings.parquet")
    got = sorted(map(tuple, topk.op6_topk(spark, f"{tmp_path}/huge").collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)] and got[1][3] == -(2**63)


@pytest.mark.parametrize("scale", [0, 1, 300])
def test_block_search_equals_brute_force(scale):
    rng = np.random.default_rng(8)
    m = rng.integers(-scale, scale + 1, (3000, 12)).astype(np.int64)
    block = topk.ImpactBlock(np.arange(3000), m)
    own = rng.integers(0, 3000, 30)
    for q in own.tolist():
        s = m @ m[q]
        s[q] = s.min() - 1
        want = np.lexsort((np.arange(3000), -s))[:5]
        for known in (-np.inf, int(s[want[-1]])):
            ids, scores = block.search(m[q], q, 5, known)
            assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
            assert set(np.flatnonzero(s >= s[want[-1]])) - {q} <= set(block.possible(m[q], q, 5, known).tolist())


def test_search_stops_before_all_postings_are_read():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (40, 32))
    m = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.2, (4000, 32)))).astype(np.int64)
    block = topk.ImpactBlock(np.arange(4000), m)
    for q in range(50):
        s = m @ m[q]
        s[q] = s.min() - 1
        assert block.search(m[q], q, 5)[0].tolist() == np.lexsort((np.arange(4000), -s))[:5].tolist()
    assert block.read < 0.7 * 50 * m.size


# ---- HTML


CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("x <b>bold</b>  and\n<i>it</i>", "x bold and it"),
    ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>", "- one\n- two\n  - deep\n- three"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><tr><th colspan=2>wide heading<tr><td>a<td>b</table>", "wide heading\na  b"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<script>if (a<b) {}</script><style>p{}</style>seen<!-- no --><noscript>n</noscript>", "seen"),
    ("<div hidden>no</div><div style='color:red; display : none'>no</div><span style=\"visibility:hidden\">no</span>yes", "yes"),
    ("<pre>\n  keep\n    this </pre>after", "  keep\n    this\n\nafter"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("&lt;b&gt; &amp; &eacute;&#8364; &nbsp;x", "<b> & é€ \xa0x"),
    ("<head><title>no</title></head><body>yes", "yes"),
    ("<title>no</title><p>yes", "yes"),
    ("<h1>T</h1><p>one</p>two", "T\n\none\n\ntwo"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    ("<img alt='pic'> <input type=submit value=Go><input type=hidden value=no>", "pic Go"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("</p></div>stray</b> <b>x", "stray x"),
    ("text <unclosed", "text <unclosed"),
    ("<a href='x>y'>link</a>", "link"),
    ("<![CDATA[raw & <b>]]>", "raw & <b>"),
    ("<textarea>a\n &lt;b</textarea>", "a\n <b"),
    ("", ""),
    ("<p>" * 5000 + "deep", "deep"),
    ("<div>" * 5000 + "deep", "deep"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_render(source, text):
    assert html_render.render(source) == text


def test_pages(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_render.op4_html_render(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert "<script" not in got[r.page_id] and "track(" not in got[r.page_id] and got[r.page_id] == html_render.render(r.html)
    spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>x", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(str, html_render.op4_html_render(spark, str(tmp_path)).collect())) == sorted(["Row(page_id=1, text='')"] * 2 + ["Row(page_id=None, text='x')"])


def test_every_visible_word_is_kept():
    rng = np.random.default_rng(5)
    tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "span", "h2", "dd", "blockquote", "section"]
    for _ in range(200):
        words, parts = [], []
        for k in range(30):
            tag = tags[rng.integers(len(tags))]
            parts.append(f"<{tag}> w{k} " if rng.random() < 0.6 else f"</{tag}> w{k} ")
            words.append(f"w{k}")
        text = html_render.render("".join(parts))
        assert sorted(text.replace("-", " ").split()) == sorted(words)


def hostile():
    rng = np.random.default_rng(1)
    return {
        "tags without end": "<a " * 350_000,
        "quotes without end": "<a '>' " * 150_000 + '"',
        "many quotes": "<a \"'<a '" * 100_000 + ">x",
        "deep": "<div>" * 200_000 + "x",
        "paragraphs under a button": "<p><button>" + "<div>" * 150_000 + "x",
        "stray ends": "<i>" * 100_000 + "</b>" * 100_000 + "x",
        "raw without end": "<title>" * 140_000,
        "comments": "<!--" * 250_000,
        "brackets": "<" * 1_000_000,
        "ends": "</" * 500_000 + ">",
        "mixed": "".join(rng.choice(["<", ">", "'", '"', "a", " ", "=", "/", "!", "-", "<a ", "</a>"], 300_000)),
    }


@pytest.mark.parametrize("name", hostile())
def test_hostile_pages_take_linear_time(name):
    start = time.time()
    html_render.render(hostile()[name])
    assert time.time() - start < 25  # some seconds on a slow machine; minutes to hours if it were quadratic


def test_spanning_cells():
    start = time.time()
    page = "<table>" + "<tr><td rowspan=1000 colspan=300>" * 500 + "</table>"
    assert html_render.render(page) == ""
    assert html_render.render("<table><tr><td rowspan=3 colspan=2>ab<td>c<tr><td>d<td rowspan=2>e<tr><td>f</table>") == "ab  c\n    d  e\n    f"
    assert time.time() - start < 10


class Plain(HTMLParser):
    """Visible words of a well-formed page by another reader, and whether each stands in a hidden element."""

    def __init__(self):
        super().__init__()
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html_render.VOID:
            a = dict(attrs)
            self.open.append((tag, tag in html_render.HIDDEN or "hidden" in a or "none" in (a.get("style") or "")))

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if not any(h for _, h in self.open):
            self.words += data.split()


def test_visible_words_equal_another_reader():
    rng = np.random.default_rng(7)
    inline, block = ["b", "i", "span", "a", "em"], ["div", "section", "ul><li", "ol><li", "blockquote", "table><tr><td", "h2", "script", "style", "template", "dl><dd", "p"]

    def page(depth, n=[0]):
        out = []
        for _ in range(rng.integers(1, 5)):
            n[0] += 1
            out.append(f" w{n[0]} ")
            if depth and rng.random() < 0.8:
                kinds = inline if rng.random() < 0.4 else block
                tags = kinds[rng.integers(len(kinds))].split("><")
                a = ["", " hidden", " style='display:none'", " title=\"a > b\""][rng.integers(4)]
                code = tags[0] in ("script", "style")
                body = "if (a < b) { w }" if code else f"w{n[0]}x" if tags[0] in ("p", "h2") else page(depth - 1)
                out.append(f"<{tags[0]}{a}>" + "".join(f"<{t}>" for t in tags[1:]) + body + "".join(f"</{t}>" for t in reversed(tags)))
        return "".join(out)

    for _ in range(150):
        source = page(4)
        if re.search(r"<(b|i|span|a|em)[ >](?:(?!</\1>).)*<(p|h2)", source):
            continue
        want = Plain()
        want.feed(source)
        got = re.sub(r"(?m)^\s*((-|\d+\.) +)*", "", html_render.render(source))
        assert sorted(re.findall(r"w\d+x?", got)) == sorted(want.words)


SEEN = [
    ("<svg><title>no</title><defs><text>no</text></defs><text>vis</text><g><text>two</text></g></svg>", "vis two"),
    ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>", "x="),
    ("<object data=x>instead</object>", "instead"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b><i style='display:none'><b style='visibility:visible'>no</b></i></div>", "yes"),
    ("<ul><li>a<blockquote>q<p>r</blockquote>b<li><li><ol><li>x</ol></ul>end", "- a\n\n    q\n\n    r\n\n  b\n-\n- 1. x\n\nend"),
    ("<dl><dt>t<dd>d<p>e</dl>", "t\n  d\n\n  e"),
]


@pytest.mark.parametrize(("source", "want"), SEEN)
def test_all_that_is_seen(source, want):
    assert html_render.render(source) == want


@pytest.mark.parametrize(("piece", "n"), [("<b>ab</b> ", 100_000), ("<ul><li>a", 100_000), ("<blockquote>a", 70_000), ("<dl><dd>a", 100_000), ("a<br>", 200_000), ("<svg><text>a", 50_000)])
def test_a_megabyte_of_one_thing(piece, n):
    began = time.time()
    text = html_render.render(piece * n)
    assert text.count("a") == n and len(text) < 100 * n and time.time() - began < 20  # 1 to 6 s alone


# ---- pipeline


def test_pipeline_stages(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.where("doc_id < 5")  # repeated rows
    one, two = (r.text for r in corpus_pipeline.quality_rules(spark, docs, sf).where("lang = 'en' AND n_chars BETWEEN 900 AND 2000").orderBy("doc_id").limit(2).collect())
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, f"{one} token = abcdefghijkl {two}", "en", None, None)], docs.schema)
    docs.unionByName(again).unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    folder = str(tmp_path)
    state = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "secret_scan", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        out = stage(spark, state, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, state.collect()
    before, after = seen["quality_rules"]
    for r in before:
        n = plain_counts(r.text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert not failed or r not in after
    assert set(after) <= set(before) and len(after) > 0.5 * len(before)
    before, after = seen["ngram_jaccard_join"]
    roots = {c for i, _, c in components([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(roots)
    before, after = seen["secret_scan"]
    assert len(before) == len(after)
    texts = {r.doc_id: r.text for r in after}
    assert texts[9003] == f"{one} [SECRET] {two}" and not any("AKIA" in t and "AKIA" in t.replace("AKIA ", "") and any(len(w) >= 20 and w.startswith("AKIA") for w in t.split()) for t in texts.values())
    before, after = seen["packing"]
    check_packing([(r.doc_id, r.text) for r in before], after)


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    ddl = "doc_id long, text string, set_id string, __row string, first int"
    for rows, want in (
        ([(1, a), (1, b), (2, a)], [(1, a), (1, b)]),
        ([(1, a), (2, b), (2, a)], [(1, a), (2, b)]),
        ([(1, a), (1, a), (2, a + " more")], [(1, a)]),
        ([(3, c), (3, c + " end"), (2, b), (4, c), (None, a), (None, a), (5, None), (5, None), (6, ""), (6, " ")], None),
    ):
        docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], ddl)
        out = corpus_pipeline.one_of_each_group(spark, docs, "")
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        if want is None:
            assert len([r for r in got if r[0] == 3]) == 1 and [r for r in got if r[0] == 4] == []
            assert sorted(map(str, (r for r in got if r[0] != 3))) == sorted(map(str, [(2, b), (None, a), (None, a), (5, None), (5, None), (6, ""), (6, " ")]))
        else:
            assert sorted(got) == sorted(want)


NAMES = """spans base_spans __own __row __base __tokens __more __clean row s e k token family level least random p_text
    id own several gone n set_id first __id __n sig doc_a component_id group_id start after base_failed kept log_ppl lo hi small_lo
    key c ctx p q gamma part length rank sequence_id offset a.b c`d""".split()


def test_stages_keep_columns_of_any_name(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    docs = own.withColumns({f"z{k}": F.concat(F.lit(f"{k}/"), F.col("doc_id")) for k in range(len(NAMES))}).toDF(*own.columns, *NAMES)
    doc, (_, text) = docs.first(), max(((len(r.text or ""), r.text) for r in own.collect()))
    more = [(1000, f"{text} token = abcdefghijkl end", "en", "s", 9), (1001, text, "en", "s", 9), (1001, "another one", "en", "s", 9), (1002, text, "en", "s", 9), (1002, "", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame([(*r, *(f"{k}/{r[0]}" for k in range(len(NAMES)))) for r in more], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r[c] == f"{k}/{r.doc_id}" for r in rows for k, c in enumerate(NAMES)), name
        if name == "ngram_jaccard_join":  # the copies go, what else has their ids stays
            assert sorted((r.doc_id, r.text) for r in rows if r.doc_id > 999) == [(1001, "another one"), (1002, "")]
        if name == "secret_scan":
            assert {r.doc_id: r.text for r in rows}[1000].endswith("[SECRET] end") and len(rows) == docs.count()
    assert doc is not None and corpus_pipeline.packed(spark, docs, sf).count() >= docs.count()


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(got[0].asDict())
    assert not ({r.doc_id for r in got} - {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_pipeline_of_nothing(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("tag", ["div", "font", "b", "blockquote", "ul><li", "table><tr><td"])
@pytest.mark.parametrize("closed", [True, False])
def test_pages_of_any_depth(tag, closed):
    n, ends = 1000, "".join(f"</{t}>" for t in reversed(tag.split("><")))
    inner = "<script>code()</script><style>css</style><p hidden>no <b>no</b></p><template>no</template><pre>a<i>b</i></pre>word"
    page = f"<div style='display:none'>{f'<{tag}>' * n}hidden{ends * n}hidden</div>" if closed else ""
    page += f"<{tag}>" * n + inner + (ends * n + "<p>end" if closed else "")
    assert html_render.render(page).replace("- ", "").split() == ["ab", "word"] + ["end"] * closed
