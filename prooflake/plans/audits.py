"""Audits, drift, probes, novelty and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as Q
from ..operators import sampling as S
from ..operators.analytics import six, top_shapes
from .tables import BASELINE, JUDGED, PHASE, SEEDS, STEPS, TRACES, events, judged, r6, steps, table, traces

QUERIES, ORACLE = {}, {}
_SOLVED = "count(*) FILTER (WHERE last_rule = 'purchase')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _verdict():
    return F.when(F.col("last_rule") == "error", -1).when(F.col("last_rule") == "purchase", 100).otherwise(0).cast("long")


_VERDICT = "CAST(CASE last_rule WHEN 'error' THEN -1 WHEN 'purchase' THEN 100 ELSE 0 END AS BIGINT)"


def _rejected():
    return F.col("last_rule") == "error"


@query(f"WITH {TRACES} SELECT {_VERDICT} AS verdict, count(*) AS n FROM traces GROUP BY ALL")
def verdict_counts(spark, sf):
    """Traces by verdict."""
    return traces(spark, sf).groupBy(_verdict().alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {JUDGED} SELECT coalesce(source, 'OVERALL') AS source, count(*) AS n, CAST(sum(CAST(quality = 0 AS INT)) AS BIGINT) AS rejected,
{r6("sum(CAST(quality = 0 AS INT)) / CAST(count(*) AS DOUBLE)")} AS rate FROM judged GROUP BY GROUPING SETS ((source), ())"""
)
def contamination_audit(spark, sf):
    """Reject rate by source and overall."""
    return Q.contamination(judged(spark, sf).select("source", "quality"), "source", F.col("quality") == 0)


@query(
    f"""WITH {TRACES}, o AS (SELECT avg(CAST(last_rule = 'error' AS INT)) AS o FROM traces),
e AS (SELECT DISTINCT user_id, d, last_rule, unnest(rules) AS rule FROM traces),
g AS (SELECT rule, count(*) AS n, CAST(sum(CAST(last_rule = 'error' AS INT)) AS BIGINT) AS rejected FROM e GROUP BY rule)
SELECT rule, n, rejected, {r6("rejected / CAST(n AS DOUBLE)")} AS rate, {r6("rejected / CAST(n AS DOUBLE) / greatest(0.001, o)")} AS ratio,
rejected / CAST(n AS DOUBLE) / greatest(0.001, o) >= 2 AND rejected >= 3 AS flag FROM g, o"""
)
def rule_drift(spark, sf):
    """Reject rate of the traces that contain each rule, against the overall rate."""
    return Q.rule_drift(traces(spark, sf), _rejected())


@query(f"WITH {TRACES} SELECT shape, count(*) AS n FROM traces WHERE last_rule = 'error' GROUP BY shape ORDER BY n DESC, shape LIMIT 15")
def rejected_shapes(spark, sf):
    """Most frequent rejected shapes."""
    return top_shapes(traces(spark, sf).where(_rejected()), 15)


@query(
    f"""WITH {TRACES} SELECT count(*) AS n, {_SOLVED} AS accepted, count(*) FILTER (WHERE last_rule NOT IN ('purchase', 'error')) AS wrong_conclusion,
count(*) FILTER (WHERE last_rule = 'error') AS rejected, count(*) FILTER (WHERE n > 32) AS encode_failed FROM traces"""
)
def drift_summary(spark, sf):
    """Outcomes of all traces; those too long for step ids can't be encoded."""
    last = F.col("last_rule")
    return traces(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(last == "purchase").alias("accepted"), F.count_if(~last.isin("purchase", "error")).alias("wrong_conclusion"), F.count_if(last == "error").alias("rejected"), F.count_if(F.col("n") > 32).alias("encode_failed")
    )


@query(f"WITH {TRACES} SELECT rule, count(*) AS n, count(*) FILTER (WHERE early = 'error') AS rejected, {r6("count(*) FILTER (WHERE early = 'error') / CAST(count(*) AS DOUBLE)")} AS rate FROM (SELECT last_rule AS rule, first_rule AS early FROM traces) GROUP BY rule")
def drift_by_final_rule(spark, sf):
    """Reject rate by final rule (a trace is rejected if it starts with an error)."""
    return Q.by_group(traces(spark, sf).withColumn("rule", F.col("last_rule")), "rule", F.col("first_rule") == "error")


@query(f"WITH {TRACES} SELECT n AS depth, count(*) AS n, count(*) FILTER (WHERE last_rule = 'error') AS rejected, {r6("count(*) FILTER (WHERE last_rule = 'error') / CAST(count(*) AS DOUBLE)")} AS rate FROM traces GROUP BY traces.n")
def drift_by_depth(spark, sf):
    """Reject rate by trace length."""
    return Q.by_group(traces(spark, sf).select(F.col("n").alias("depth"), "last_rule"), "depth", _rejected())


_PROBE = f"""{STEPS}, s AS (SELECT *, coalesce(max(CAST(rule = 'view' AS INT)) OVER (PARTITION BY user_id, d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM steps),
w AS (SELECT user_id, d, max(CAST(rule = 'purchase' AS INT)) AS reach, max(pre) AS pre, count(*) FILTER (WHERE pre = 1) AS open,
  count(*) FILTER (WHERE pre = 1 AND rule = 'purchase') AS sampled, count(*) FILTER (WHERE pre = 1 AND rule = 'purchase' AND value > 50) AS applied FROM s GROUP BY user_id, d),
f AS (SELECT count(*) AS walks, CAST(sum(reach) AS BIGINT) AS reached, CAST(sum(pre) AS BIGINT) AS ready, CAST(sum(open) AS BIGINT) AS open, CAST(sum(sampled) AS BIGINT) AS sampled, CAST(sum(applied) AS BIGINT) AS applied FROM w),
p AS (SELECT *, {r6("reached / CAST(walks AS DOUBLE)")} AS reach_rate, {r6("ready / CAST(walks AS DOUBLE)")} AS ready_rate,
  {r6("sampled / CAST(nullif(open, 0) AS DOUBLE)")} AS sampled_rate, {r6("applied / CAST(nullif(sampled, 0) AS DOUBLE)")} AS applied_rate FROM f)"""


def _probe(spark, sf):
    return Q.probe_funnel(steps(spark, sf), ["user_id", "d"], "purchase", F.col("rule") == "view", F.col("value") > 50)


@query(f"WITH {_PROBE} SELECT * FROM p")
def probe_report(spark, sf):
    """Reachability funnel of one target rule."""
    return _probe(spark, sf)


@query(
    f"""WITH {_PROBE} SELECT 'purchase' AS target, CASE WHEN reach_rate < 0.05 THEN 'low' WHEN ready_rate < 0.05 AND (sampled_rate < 0.05 OR applied_rate < 0.05) THEN 'Both'
WHEN ready_rate < 0.05 THEN 'A' WHEN sampled_rate < 0.05 OR applied_rate < 0.05 THEN 'B' ELSE 'Neither' END AS verdict FROM p"""
)
def probe_verdict(spark, sf):
    """What holds a target back, by its funnel."""
    p = _probe(spark, sf)
    return p.select(F.lit("purchase").alias("target"), Q.probe_class(*(F.col(f"{k}_rate") for k in ("reach", "ready", "sampled", "applied"))).alias("verdict"))


@query("SELECT event_type AS rule, coalesce(CASE WHEN value <= 10 THEN 'too low' WHEN value > 100 THEN 'too high' END, 'other') AS reason, count(*) AS n FROM events WHERE value <= 50 OR value > 100 GROUP BY ALL")
def failure_reasons(spark, sf):
    """Failed applications by rule and reason."""
    reason = F.when(F.col("value") <= 10, "too low").when(F.col("value") > 100, "too high").otherwise("other")
    failed = table(spark, sf, "events").where("value <= 50 OR value > 100").select(F.col("event_type").alias("rule"), F.array(reason).alias("reasons"))
    return failed.select("rule", F.explode("reasons").alias("reason")).groupBy("rule", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRACES}, e AS (SELECT DISTINCT user_id, d, unnest(rules) AS rule FROM traces) SELECT rule, count(*) AS walks, {r6("count(*) / CAST((SELECT count(*) FROM traces) AS DOUBLE)")} AS rate FROM e GROUP BY rule")
def unigram_reach(spark, sf):
    """Walks that reach each rule."""
    t = traces(spark, sf)
    total = F.broadcast(t.agg(F.count(F.lit(1)).alias("all")))  # one row
    reach = t.select(F.explode(F.array_distinct("rules")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("walks"))
    return reach.join(total).select("rule", "walks", Q.rate(F.col("walks"), F.col("all")).alias("rate"))


@query(f"WITH {TRACES} SELECT user_id % {SEEDS} AS seed, count(*) AS n, {_SOLVED} AS solved FROM traces GROUP BY ALL")
def per_seed_success(spark, sf):
    """Attempts and successes of each seed."""
    return traces(spark, sf).groupBy((F.col("user_id") % SEEDS).alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("last_rule") == "purchase").alias("solved"))


@query(f"WITH {TRACES} SELECT d, count(*) AS n, {_SOLVED} AS solved, {r6(f'{_SOLVED} / CAST(count(*) AS DOUBLE)')} AS rate FROM traces GROUP BY d")
def solve_rate(spark, sf):
    """Solved traces of each round."""
    t = traces(spark, sf).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("last_rule") == "purchase").alias("solved"))
    return t.withColumn("rate", Q.rate(F.col("solved"), F.col("n")))


_NOVEL = f"{TRACES}, v AS (SELECT * FROM traces WHERE d > DATE '{BASELINE}' AND shape NOT IN (SELECT shape FROM traces WHERE d <= DATE '{BASELINE}'))"


def _novel(spark, sf):
    t = traces(spark, sf)
    return Q.novel(t.where(F.col("d") > BASELINE), t.where(F.col("d") <= BASELINE))


@query(f"WITH {_NOVEL} SELECT user_id, d, shape FROM v")
def novelty(spark, sf):
    """Traces of shapes that the baseline doesn't have."""
    return _novel(spark, sf).select("user_id", "d", "shape")


@query(f"WITH {_NOVEL} SELECT shape, count(*) AS n, min(d) AS first_round FROM v GROUP BY shape")
def novelty_summary(spark, sf):
    """Novel shapes, how often and since when."""
    return _novel(spark, sf).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_round"))


@query(f"WITH {_NOVEL}, r AS (SELECT *, row_number() OVER (PARTITION BY d, shape ORDER BY user_id) AS k FROM v) SELECT d, shape, user_id FROM r WHERE k = 1")
def novel_first_sample(spark, sf):
    """First sample of each novel shape in each round."""
    return _novel(spark, sf).groupBy("d", "shape").agg(F.min("user_id").alias("user_id"))


@query(f"WITH {TRACES}, f AS (SELECT shape, min(d) AS d FROM traces GROUP BY shape), g AS (SELECT d, count(*) AS new FROM f GROUP BY d) SELECT d, new, CAST(sum(new) OVER (ORDER BY d) AS BIGINT) AS total FROM g")
def cumulative_novelty(spark, sf):
    """New and total shapes by round."""
    return Q.cumulative(traces(spark, sf).groupBy("shape").agg(F.min("d").alias("d")), "d")


_ROUNDS = f"{TRACES}, g AS (SELECT d, count(*) AS n, {_SOLVED} AS solved, avg(CAST(n AS DOUBLE)) AS length FROM traces GROUP BY d)"


@query(f"WITH {_ROUNDS} SELECT d, solved, {r6("avg(solved) OVER (ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")} AS mean FROM g")
def rolling_solve(spark, sf):
    """Mean of solved traces over the last ten rounds."""
    return Q.rolling(traces(spark, sf).groupBy("d").agg(F.count_if(F.col("last_rule") == "purchase").alias("solved")), "d", "solved", 10)


@query(
    f"""WITH {_ROUNDS} SELECT {r6(f"avg(solved) FILTER (WHERE d <= DATE '{PHASE}')")} AS phase1, {r6(f"avg(solved) FILTER (WHERE d > DATE '{PHASE}')")} AS phase2,
{r6(f"avg(solved) FILTER (WHERE d > DATE '{PHASE}') - avg(solved) FILTER (WHERE d <= DATE '{PHASE}')")} AS delta FROM g"""
)
def phase_delta(spark, sf):
    """Mean of solved traces in two phases, and their difference."""
    g = traces(spark, sf).groupBy("d").agg(F.count_if(F.col("last_rule") == "purchase").alias("solved"))
    a, b = F.avg(F.when(F.col("d") <= PHASE, F.col("solved"))), F.avg(F.when(F.col("d") > PHASE, F.col("solved")))
    return g.agg(six(a).alias("phase1"), six(b).alias("phase2"), six(b - a).alias("delta"))


@query(f"WITH {_ROUNDS}, r AS (SELECT d, n, lag(n) OVER (ORDER BY d) AS before FROM g) SELECT d, n, CAST(n - before AS BIGINT) AS change FROM r")
def step_rate(spark, sf):
    """Change of the number of traces from round to round."""
    g = traces(spark, sf).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("d")))


@query("SELECT CAST(ts AS DATE) AS d, min(value) AS least, max(value) AS most, min(event_id) FILTER (WHERE value = m) AS best FROM (SELECT *, max(value) OVER (PARTITION BY CAST(ts AS DATE)) AS m FROM events) GROUP BY ALL")
def reward_minmax(spark, sf):
    """Least and best reward of each round, and the first event with the best."""
    e = events(spark, sf).groupBy("d").agg(F.min("value").alias("least"), F.max(F.struct("value", -F.col("event_id"))).alias("m"))
    return e.select("d", "least", F.col("m.value").alias("most"), (-F.col("m.col2")).alias("best"))


@query(
    f"""WITH RECURSIVE {_ROUNDS}, o AS (SELECT d, {r6("length")} AS reward, row_number() OVER (ORDER BY d) AS k FROM g),
b AS (SELECT k, d, reward, CAST(0.1 * reward AS DOUBLE) AS b FROM o WHERE k = 1 UNION ALL SELECT o.k, o.d, o.reward, CAST(0.9 * b.b + 0.1 * o.reward AS DOUBLE) FROM o JOIN b ON o.k = b.k + 1)
SELECT d, reward, {r6("b")} AS baseline FROM b"""
)
def ema_baseline(spark, sf):
    """Moving average of the mean reward, in round order."""
    g = traces(spark, sf).groupBy("d").agg(six(F.avg(F.col("n").cast("double"))).alias("reward"))
    return S.ema(g, "d", "reward")


@query(f"WITH {TRACES} SELECT user_id, d, {_VERDICT} AS reward, {r6(f'{_VERDICT} - 20.0')} AS advantage, {_VERDICT} < 50 AS bonus FROM traces")
def advantage(spark, sf):
    """Advantage of each rollout over a baseline, and whether it gets the entropy bonus."""
    t = traces(spark, sf).withColumn("reward", _verdict())
    return S.advantage(t, F.col("reward"), F.lit(20.0)).select("user_id", "d", "reward", "advantage", "bonus")


METHODS = ("greedy", "sample", "tree")
_USERS = f"""e AS (SELECT user_id AS seed, event_type, CAST(ts AS DATE) <= DATE '{BASELINE}' AS early FROM events),
u AS (SELECT seed, NOT bool_or(early AND event_type = 'purchase') AS ood, bool_or(early AND event_type = 'signup') AS signed FROM e GROUP BY seed)"""


def _grid(spark, sf, methods):
    """Methods on users; out of distribution are those who don't buy up to the baseline."""
    early = F.col("d") <= F.lit(BASELINE).cast("date")
    users = events(spark, sf).groupBy(F.col("user_id").alias("seed")).agg((~F.bool_or(early & (F.col("event_type") == "purchase"))).alias("ood"), F.bool_or(early & (F.col("event_type") == "signup")).alias("signed"))
    return users.withColumn("method", F.explode(F.array(*map(F.lit, methods))))


@query(f"WITH {_USERS} SELECT seed, method, ood FROM u, (VALUES ('greedy'), ('sample'), ('tree')) m(method)")
def eval_grid(spark, sf):
    """Every method on every user."""
    return _grid(spark, sf, METHODS).select("seed", "method", "ood")


@query(f"WITH {_USERS} SELECT seed, method, ood FROM u, (VALUES ('sample'), ('tree')) m(method) WHERE signed")
def eval_subset(spark, sf):
    """Two methods on the users who sign up by the baseline."""
    return _grid(spark, sf, METHODS[1:]).where("signed").select("seed", "method", "ood")


@query(
    f"""WITH {TRACES}, m AS (SELECT CASE user_id % 3 WHEN 0 THEN 'greedy' WHEN 1 THEN 'sample' ELSE 'tree' END AS method, user_id % {SEEDS} AS seed, last_rule, shape, d FROM traces),
x AS (SELECT *, shape NOT IN (SELECT shape FROM traces WHERE d <= DATE '{BASELINE}') AS novel FROM m)
SELECT method, count(DISTINCT seed) AS seeds, count(DISTINCT CASE WHEN last_rule = 'purchase' THEN seed END) AS solved, count(DISTINCT CASE WHEN last_rule = 'purchase' AND seed >= 13 THEN seed END) AS solved_ood,
count(*) FILTER (WHERE novel) AS novel, {_SOLVED} AS successes FROM x GROUP BY method"""
)
def eval_summary(spark, sf):
    """Seeds solved by each method, out of distribution too, and novel traces."""
    t = traces(spark, sf)
    base = t.where(F.col("d") <= BASELINE).select("shape").distinct().withColumn("old", F.lit(True))
    method = F.element_at(F.array(*map(F.lit, ("greedy", "sample", "tree"))), (F.col("user_id") % 3 + 1).cast("int"))
    x = t.select("shape", "last_rule", method.alias("method"), (F.col("user_id") % SEEDS).alias("seed")).join(base, "shape", "left")
    won = F.col("last_rule") == "purchase"
    return x.groupBy("method").agg(
        F.countDistinct("seed").alias("seeds"), F.countDistinct(F.when(won, F.col("seed"))).alias("solved"), F.countDistinct(F.when(won & (F.col("seed") >= 13), F.col("seed"))).alias("solved_ood"), F.count_if(F.col("old").isNull()).alias("novel"), F.count_if(won).alias("successes")
    )


@query(
    f"""WITH {TRACES}, p AS (SELECT user_id, d, unnest(['lookup', 'scripted', 'enumerator']) AS prover, unnest([1, 2, 3]) AS k, last_rule, n FROM traces),
a AS (SELECT * FROM p WHERE (k = 1 AND last_rule = 'purchase') OR (k = 2 AND n >= 4) OR k = 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY k) AS x FROM a)
SELECT user_id, d, prover FROM r WHERE x = 1"""
)
def first_accepting_prover(spark, sf):
    """First prover, in order, that accepts each goal: decided within the row, nothing is shuffled twice."""
    t = traces(spark, sf)
    tried = F.array(F.when(F.col("last_rule") == "purchase", "lookup"), F.when(F.col("n") >= 4, "scripted"), F.lit("enumerator"))
    return t.select("user_id", "d", F.get(F.array_compact(tried), F.lit(0)).alias("prover"))


@query(
    f"""WITH {STEPS}, s AS (SELECT *, count(*) OVER w AS pool, count(*) FILTER (WHERE rule = 'view') OVER w AS eqs, count(*) FILTER (WHERE rule = 'click') OVER w AS conjs FROM steps
WINDOW w AS (PARTITION BY user_id, d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, d, pos, coalesce(eqs, 0) >= 2 AS trans, coalesce(conjs, 0) >= 1 AS conjunct1, coalesce(pool, 0) >= 2 AS conj, coalesce(pool, 0) >= 1 AS disch FROM s"""
)
def applicable_rules(spark, sf):
    """Which rules the steps before each step make possible."""
    w = Window.partitionBy("user_id", "d").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = steps(spark, sf)
    pool, eqs, conjs = F.count(F.lit(1)).over(w), F.count_if(F.col("rule") == "view").over(w), F.count_if(F.col("rule") == "click").over(w)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return s.select("user_id", "d", "pos", (zero(eqs) >= 2).alias("trans"), (zero(conjs) >= 1).alias("conjunct1"), (zero(pool) >= 2).alias("conj"), (zero(pool) >= 1).alias("disch"))


#: What stands for the facts that the fifteen rules ask for: equations, conjunctions, quantified and implied steps, and
#: steps with something free.
_FACTS = {"eqs": "rule = 'view'", "conjs": "rule = 'click'", "foralls": "rule = 'signup'", "imps": "rule = 'purchase'", "free": "value > 50"}
#: The least that each rule needs of the steps before.
APPLICABLE = {
    "refl": "true", "assume": "true", "beta": "true", "trans": "eqs >= 2", "mk_comb": "eqs >= 2", "abs": "eqs >= 1", "disch": "pool >= 1", "mp": "imps >= 1 AND pool >= 2",
    "gen": "free >= 1", "spec": "foralls >= 1", "conj": "pool >= 2", "conjunct1": "conjs >= 1", "conjunct2": "conjs >= 1", "eq_mp": "eqs >= 1 AND pool >= 2", "inst": "free >= 1",
}


@query(
    f"""WITH {STEPS}, s AS (SELECT user_id, d, pos, count(*) OVER w AS pool, {", ".join(f"count(*) FILTER (WHERE {c}) OVER w AS {k}" for k, c in _FACTS.items())} FROM steps
WINDOW w AS (PARTITION BY user_id, d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, d, pos, {", ".join(f"coalesce({c}, false) AS {k}" for k, c in APPLICABLE.items())} FROM s"""
)
def applicable_of_all(spark, sf):
    """Which of the fifteen rules the steps before each step make possible: one pass over each trace."""
    w = Window.partitionBy("user_id", "d").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    facts = [F.coalesce(F.count_if(F.expr(c)).over(w), F.lit(0)).alias(k) for k, c in _FACTS.items()]
    s = steps(spark, sf).select("user_id", "d", "pos", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)).alias("pool"), *facts)
    return s.select("user_id", "d", "pos", *(F.expr(c).alias(k) for k, c in APPLICABLE.items()))


#: Targets of the probes: the rule looked for, the rule that makes it ready, and the least value of a success.
TARGETS = {"purchase": ("view", 50), "signup": ("click", 20), "click": ("view", 10), "view": ("signup", 80)}


def _funnel_sql(target: str, ready: str, least: int) -> str:
    return f"""SELECT '{target}' AS target, count(*) AS walks, CAST(sum(reach) AS BIGINT) AS reached, CAST(sum(pre) AS BIGINT) AS ready, CAST(sum(open) AS BIGINT) AS open, CAST(sum(sampled) AS BIGINT) AS sampled, CAST(sum(applied) AS BIGINT) AS applied FROM (
SELECT user_id, d, max(CAST(rule = '{target}' AS INT)) AS reach, max(pre) AS pre, count(*) FILTER (WHERE pre = 1) AS open, count(*) FILTER (WHERE pre = 1 AND rule = '{target}') AS sampled,
  count(*) FILTER (WHERE pre = 1 AND rule = '{target}' AND value > {least}) AS applied
FROM (SELECT *, coalesce(max(CAST(rule = '{ready}' AS INT)) OVER (PARTITION BY user_id, d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM steps) GROUP BY user_id, d)"""


@query(f"WITH {STEPS} " + " UNION ALL ".join(_funnel_sql(t, *x) for t, x in TARGETS.items()))
def probe_targets(spark, sf):
    """Reachability funnel of every registered target; all targets share one pass over the traces."""
    w = Window.partitionBy("user_id", "d").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = steps(spark, sf)
    pre = {t: F.coalesce(F.max((F.col("rule") == ready).cast("int")).over(w), F.lit(0)).alias(f"pre_{t}") for t, (ready, _) in TARGETS.items()}
    s = s.select("user_id", "d", "rule", "value", *pre.values())
    of = []
    for t, (_, least) in TARGETS.items():
        ready, hit = F.col(f"pre_{t}") == 1, F.col("rule") == t
        of.append(F.struct(F.lit(t).alias("target"), F.max(hit.cast("int")).alias("reach"), F.max(f"pre_{t}").alias("pre"), F.count_if(ready).alias("open"), F.count_if(ready & hit).alias("sampled"), F.count_if(ready & hit & (F.col("value") > least)).alias("applied")))
    walks = s.groupBy("user_id", "d").agg(F.array(*of).alias("of")).select(F.explode("of").alias("x")).select("x.*")
    total = {"reached": "reach", "ready": "pre", "open": "open", "sampled": "sampled", "applied": "applied"}
    return walks.groupBy("target").agg(F.count(F.lit(1)).alias("walks"), *(F.sum(c).alias(k) for k, c in total.items()))


@query(f"WITH {_ROUNDS} SELECT d, solved, {r6("avg(solved) OVER (ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")} AS mean FROM g")
def rolling_solve_100(spark, sf):
    """Mean of solved traces over the last hundred rounds."""
    return Q.rolling(traces(spark, sf).groupBy("d").agg(F.count_if(F.col("last_rule") == "purchase").alias("solved")), "d", "solved", 100)


@query(
    f"""WITH {STEPS} SELECT user_id, d, count(DISTINCT CASE WHEN rule = 'view' THEN value END) >= 2 AS two_equations, bool_or(rule = 'click') AS has_conjunction,
count(DISTINCT CASE WHEN rule = 'view' THEN value END) >= 3 AS three_assumptions, bool_or(rule = 'signup' AND value > 50) AS nested FROM steps GROUP BY user_id, d"""
)
def precond_flags(spark, sf):
    """Four preconditions of each trace, over distinct assumptions."""
    views = F.countDistinct(F.when(F.col("rule") == "view", F.col("value")))
    return steps(spark, sf).groupBy("user_id", "d").agg((views >= 2).alias("two_equations"), F.bool_or(F.col("rule") == "click").alias("has_conjunction"), (views >= 3).alias("three_assumptions"), F.bool_or((F.col("rule") == "signup") & (F.col("value") > 50)).alias("nested"))
