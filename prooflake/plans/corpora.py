"""Corpus building and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import sampling as S
from ..operators.analytics import rule_counts, six
from .tables import CAP, DRAWS, EARLY, JUDGED, MAX_CHARS, SAMPLE, SEEDS, STEPS, TEMPERATURE, TRACES, judged, r6, steps, table, traces

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, lang, source FROM documents WHERE source = 'src1'")
def source_filter(spark, sf):
    """Documents of one source."""
    return table(spark, sf, "documents").where("source = 'src1'").select("doc_id", "lang", "source")


@query(f"SELECT doc_id, n_chars FROM documents WHERE n_chars <= {MAX_CHARS}")
def length_cap(spark, sf):
    """Documents within the length cap."""
    return table(spark, sf, "documents").where(F.col("n_chars") <= MAX_CHARS).select("doc_id", "n_chars")


@query("WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) SELECT doc_id, md5(text) AS text_md5 FROM r WHERE k = 1")
def dedup_first(spark, sf):
    """First document of each text; the digest stands for the text in the shuffle."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return d.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_md5")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents d WHERE doc_id >= 100 AND text NOT IN (SELECT text FROM documents WHERE doc_id < 100) GROUP BY text")
def dedup_new(spark, sf):
    """Rows beyond the known buffer whose text isn't known, each once."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return C.new_rows(d.where("doc_id >= 100"), d.where("doc_id < 100"), ["text_md5"], ["doc_id"]).select("doc_id", "text_md5")


@query(f"WITH {TRACES}, r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY d, user_id) AS k FROM traces) SELECT user_id, d, shape FROM r WHERE k <= {CAP}")
def cap_per_shape(spark, sf):
    """At most three traces of a shape, the earliest."""
    return C.cap_per_key(traces(spark, sf).select("user_id", "d", "shape"), ["shape"], ["d", "user_id"], CAP)


@query(
    f"""WITH {JUDGED}, s AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM judged WHERE n_chars <= 2000),
r AS (SELECT CASE WHEN k > 1 THEN 'duplicate' WHEN quality = 0 THEN 'rejected' ELSE 'kept' END AS reason FROM s UNION ALL SELECT 'too_long' FROM judged WHERE n_chars > 2000)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""
)
def build_funnel(spark, sf):
    """Why rows don't get into the corpus: first failing reason."""
    d = judged(spark, sf).select("doc_id", "n_chars", "quality", F.md5("text").alias("key"))
    return C.funnel(d, F.col("n_chars") > 2000, ["key"], ["doc_id"], F.col("quality") != 0)


@query(f"WITH {JUDGED} SELECT source, count(*) FILTER (WHERE quality <> 0) AS kept, count(*) FILTER (WHERE quality = 0) AS dropped FROM judged GROUP BY source")
def clean_buffer(spark, sf):
    """Rows that cleaning keeps and drops, by source."""
    return C.cleaned(judged(spark, sf).select("source", "quality"), F.col("quality") != 0)


@query(
    """SELECT doc_id, text_md5, source, CAST(0 AS BIGINT) AS discovered_round FROM
(SELECT doc_id, md5(text) AS text_md5, 'curated' AS source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, md5(text), 'synthetic' FROM documents WHERE lang <> 'en')"""
)
def seed_buffer(spark, sf):
    """A buffer from a curated and a synthetic part."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    return C.seeded(d.where("lang = 'en'").drop("lang"), d.where("lang <> 'en'").drop("lang"))


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('0:', CAST(doc_id AS VARCHAR))), doc_id) AS k FROM documents)
SELECT doc_id, source FROM r WHERE k <= {SAMPLE}"""
)
def hash_sample(spark, sf):
    """A reproducible sample of each source."""
    return C.hash_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", SAMPLE, ["source"])


@query(
    f"""WITH f AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant') SELECT conv_id, turn, md5(prompt) AS prompt_md5, md5(target) AS target_md5, CAST(length(prompt) + length(target) + 3 AS BIGINT) AS n
FROM f WHERE length(prompt) + length(target) + 3 <= {MAX_CHARS}"""
)
def sft_pairs(spark, sf):
    """Prompts with the answers that follow them, within the length cap."""
    c = table(spark, sf, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    n = (F.length("prompt") + F.length("target") + 3).cast("long")
    return a.join(b, ["conv_id", "turn"]).withColumn("n", n).where(F.col("n") <= MAX_CHARS).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.md5("target").alias("target_md5"), "n")


@query(
    f"""WITH {JUDGED} SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN CAST(4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight FROM judged"""
)
def sft_weights(spark, sf):
    """Resampling weights: rows of the current kind count four times."""
    return S.weights(judged(spark, sf), (F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id", "weight")


@query(
    f"""WITH {STEPS}, f AS (SELECT pos, rule, count(*) AS n, count(*) FILTER (WHERE value > 50) AS s FROM steps WHERE pos < {EARLY} GROUP BY pos, rule)
SELECT pos, rule, n, s, {r6("(s + 1) / CAST(n + 2 AS DOUBLE)")} AS rate FROM f"""
)
def laplace_rate(spark, sf):
    """Success rate of each rule and position with one success and one failure added."""
    f = steps(spark, sf).where(F.col("pos") < EARLY).groupBy("pos", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("s"))
    return f.withColumn("rate", six(S.laplace(F.col("s"), F.col("n"))))


@query(
    f"""WITH {STEPS}, f AS (SELECT pos, rule, count(*) AS c, count(*) FILTER (WHERE value > 50) AS s FROM steps WHERE pos < {EARLY} GROUP BY pos, rule),
x AS (SELECT pos, rule, ln((s + 1) / CAST(c + 2 AS DOUBLE) / (c + 1)) / {TEMPERATURE} AS z FROM f),
e AS (SELECT pos, rule, exp(z - max(z) OVER (PARTITION BY pos)) AS e FROM x)
SELECT pos, rule, {r6("e / sum(e) OVER (PARTITION BY pos)")} AS p FROM e"""
)
def adaptive_probs(spark, sf):
    """Sampler probabilities that favour rules that are rare and succeed."""
    f = steps(spark, sf).where(F.col("pos") < EARLY).groupBy("pos", "rule").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("value") > 50).alias("s"))
    return S.softmax(f, F.log(S.laplace(F.col("s"), F.col("c")) / (F.col("c") + 1)), ["pos"], TEMPERATURE).select("pos", "rule", "p")


@query(
    f"""WITH {STEPS}, f AS (SELECT pos, rule, count(*) AS n FROM steps GROUP BY pos, rule), q AS (SELECT pos, rule, n / CAST(sum(n) OVER (PARTITION BY pos) AS DOUBLE) AS p, count(*) OVER (PARTITION BY pos) AS k FROM f)
SELECT pos, rule, {r6("p")} AS p, {r6("0.9 * p + 0.1 / k")} AS mixed FROM q"""
)
def uniform_mix(spark, sf):
    """Rule shares mixed with a tenth of the uniform distribution."""
    from pyspark.sql import Window

    f = rule_counts(steps(spark, sf))
    f = f.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("pos")).cast("double"))
    return S.mixed(f, "q", ["pos"], 0.1).select("pos", "rule", six(F.col("q")).alias("p"), "mixed")


@query(
    """WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings),
s AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS DOUBLE) AS z FROM x WHERE embedding[i] > 0),
e AS (SELECT vec_id, place, exp(z / 2.0 - max(z / 2.0) OVER (PARTITION BY vec_id)) AS e FROM s)
SELECT vec_id, place, round(e / sum(e) OVER (PARTITION BY vec_id), 6) + CAST(0 AS DOUBLE) AS p FROM e"""
)
def masked_softmax(spark, sf):
    """Temperature softmax over the allowed entries of a score vector."""
    x = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "z"))
    return S.softmax(x.select("vec_id", F.col("i").cast("long").alias("place"), F.col("z").cast("double").alias("z")), F.col("z"), ["vec_id"], TEMPERATURE, F.col("z") > 0).select("vec_id", "place", "p")


@query(
    """WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings),
s AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS DOUBLE) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, place) AS rank FROM s) SELECT vec_id, rank, place, score FROM r WHERE rank <= 3"""
)
def topk_rules(spark, sf):
    """Three best entries of each score vector."""
    return S.top_scores(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("scores")), "vec_id", "scores", 3)


@query("SELECT user_id AS seed, k.id AS sample, md5(concat(CAST(user_id AS VARCHAR), '/', CAST(k.id AS VARCHAR))) AS key FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) u, range(64) k(id)")
def rollout_grid(spark, sf):
    """Every user, as a seed, with every sample number."""
    seeds = table(spark, sf, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("seed")).distinct()
    grid = seeds.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("sample"))
    return grid.withColumn("key", F.md5(F.concat_ws("/", F.col("seed").cast("string"), F.col("sample").cast("string"))))


@query(f"SELECT event_id, event_id % {SEEDS} AS seed, concat('seed', CAST(event_id % {SEEDS} AS VARCHAR)) AS label FROM events")
def positional_join(spark, sf):
    """Proposals dealt to seeds in turn."""
    seeds = F.broadcast(spark.range(SEEDS).select(F.col("id").alias("seed"), F.concat(F.lit("seed"), F.col("id").cast("string")).alias("label")))  # 23 rows
    return table(spark, sf, "events").select("event_id", F.pmod("event_id", F.lit(SEEDS)).alias("seed")).join(seeds, "seed").select("event_id", "seed", "label")


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract(text, '^[^ \n]+') AS word FROM documents)
SELECT doc_id, word, CAST(CASE WHEN length(word) <> 3 THEN -1 WHEN regexp_matches(word, '[aeiouAEIOU]') THEN 100 ELSE 1 END AS BIGINT) AS verdict FROM w WHERE word IS NOT NULL"""
)
def toy_validator(spark, sf):
    """Verdict of a word: three letters, one of them a vowel."""
    w = F.regexp_extract("text", r"^[^ \n]+", 0)
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", w.alias("word"))
    return d.withColumn("verdict", F.when(F.length("word") != 3, -1).when(F.col("word").rlike("[aeiouAEIOU]"), 100).otherwise(1).cast("long"))


@query(
    f"""WITH {JUDGED}, c AS (SELECT md5(text) AS key, min(doc_id) AS cached FROM judged WHERE quality = 1 GROUP BY ALL)
SELECT doc_id, cached FROM documents LEFT JOIN c ON md5(text) = key"""
)
def cache_lookup(spark, sf):
    """Cache hits by the digest of the text; the cache holds what was judged good."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    cache = judged(spark, sf).where("quality = 1").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("cached"))
    return d.join(cache, "key", "left").select("doc_id", "cached")


_U = "CAST('0x' || substr(md5(concat_ws('/', {})), 1, 8) AS BIGINT)"


@query(
    f"""WITH {JUDGED}, r AS (SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 4 ELSE 1 END AS w FROM judged),
n AS (SELECT id, w, CAST(ceil(w * 256 / CAST((SELECT sum(w) FROM r) AS DOUBLE)) AS BIGINT) AS n FROM r), x AS (SELECT id, w, n, unnest(range(n)) AS piece FROM n),
c AS (SELECT id, piece, w * (piece + 1) // n - w * piece // n AS w, {_U.format("'7', id, piece")} % 256 AS bucket FROM x),
p AS (SELECT id, CAST(sum(w) OVER (ORDER BY bucket, id, piece) AS BIGINT) AS hi, w FROM c WHERE w > 0), t AS (SELECT max(hi) AS total FROM p),
d AS (SELECT i AS draw, CAST((CAST({_U.format("'7', i, 'a'")} AS HUGEINT) * 2147483648 + {_U.format("'7', i, 'b'")} // 2) % total AS BIGINT) AS point FROM range({DRAWS}) g(i), t)
SELECT draw, id AS doc_id FROM d JOIN p ON point >= hi - w AND point < hi"""
)
def resample(spark, sf):
    """Draws with replacement by weight: good documents four times as often."""
    weighed = judged(spark, sf).select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 4).otherwise(1).alias("w"))
    return S.resampled(weighed, "doc_id", "w", DRAWS, 7)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('/', '42', doc_id)), doc_id) AS place FROM documents")
def shuffle(spark, sf):
    """All documents in a seeded order, with their places."""
    return S.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)
