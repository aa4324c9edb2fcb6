"""Recurrences, automata and lineage over the events in their order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import patterns as P
from ..operators import scan as S
from ..operators.analytics import six
from .tables import RULES, STEPS, events, r6, steps

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_ORDER = ["ts", "event_id"]
#: Not a short decimal: averages of values with two decimals would tie when they are rounded.
KEEP = 6 / 7
_NUMBERED = "o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM events)"


@query(
    f"""WITH RECURSIVE {_NUMBERED},
b AS (SELECT k, event_id, value, value / CAST(7 AS DOUBLE) AS b FROM o WHERE k = 1 UNION ALL SELECT o.k, o.event_id, o.value, (6 * b.b + o.value) / CAST(7 AS DOUBLE) FROM b JOIN o ON o.k = b.k + 1)
SELECT event_id, {r6("b")} AS average FROM b"""
)
def ema_events(spark, sf):
    """Moving average of the values of all events as one sequence."""
    e = events(spark, sf).select("ts", "event_id", "value")
    return S.moving_average(e, [], _ORDER, "value", KEEP).select("event_id", six(F.col("average")).alias("average"))


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT k, user_id, event_id, value / CAST(7 AS DOUBLE) AS b FROM o WHERE k = 1 UNION ALL SELECT o.k, o.user_id, o.event_id, (6 * b.b + o.value) / CAST(7 AS DOUBLE) FROM b JOIN o ON o.k = b.k + 1 AND o.user_id = b.user_id)
SELECT user_id, event_id, {r6("b")} AS average FROM b"""
)
def ema_users(spark, sf):
    """Moving average of each user's values."""
    e = events(spark, sf).select("user_id", "ts", "event_id", "value")
    return S.moving_average(e, ["user_id"], _ORDER, "value", KEEP).select("user_id", "event_id", six(F.col("average")).alias("average"))


#: A visit: views, then clicks with errors between them, then a purchase; again and again.
VISIT = P.some(P.seq(P.some(P.kind("view")), P.many(P.either(P.kind("click"), P.kind("error"))), P.kind("purchase")))
_TABLE, _OTHER, _ACCEPTS = P.automaton(VISIT)
_LETTER = "CASE rule WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'error' THEN 'e' WHEN 'purchase' THEN 'p' ELSE 'x' END"


@query(f"WITH {STEPS} SELECT user_id, d, regexp_full_match(string_agg({_LETTER}, '' ORDER BY pos), '(v+[ce]*p)+') AS accepted FROM steps GROUP BY user_id, d")
def visit_traces(spark, sf):
    """Whether each trace is a row of visits."""
    met = S.run_automaton(steps(spark, sf).select("user_id", "d", "pos", "rule"), ["user_id", "d"], ["pos"], "rule", _TABLE, _OTHER)
    good = [k for k, a in enumerate(_ACCEPTS) if a]
    return met.groupBy("user_id", "d").agg(F.max_by("state", "pos").isin(good).alias("accepted"))


#: The latest visit in a sequence: whatever comes before, then a view, clicks, a purchase.
FUNNEL = P.seq(P.many(P.anything()), P.kind("view"), P.many(P.kind("click")), P.kind("purchase"))
_FTABLE, _FOTHER, _FACCEPTS = P.automaton(FUNNEL)


@query(
    """WITH o AS (SELECT event_id, event_type AS rule, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT *, max(CASE WHEN rule <> 'click' THEN k END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT g.event_id, g.rule = 'purchase' AND coalesce(o.rule = 'view', false) AS hit FROM g LEFT JOIN o ON o.k = g.before"""
)
def funnel_hits(spark, sf):
    """Events that end a view, clicks and a purchase in all events as one trace."""
    e = events(spark, sf).select("ts", "event_id", "event_type")
    met = S.run_automaton(e, [], _ORDER, "event_type", _FTABLE, _FOTHER)
    return met.select("event_id", F.col("state").isin([k for k, a in enumerate(_FACCEPTS) if a]).alias("hit"))


#: What each event needs before it: the latest earlier event of that type is its premise.
NEEDS = {"view": "view", "click": "view", "purchase": "click", "error": "click"}
_NEED = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NEEDS.items()) + " END"
_LATEST = ", ".join(f"max(CASE WHEN event_type = '{r}' THEN k END) OVER w AS k_{r}" for r in RULES)
_CITES = f"""{_NUMBERED}, lt AS (SELECT *, {_LATEST} FROM o WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cited AS (SELECT event_id, event_type, k, CASE event_type {' '.join(f"WHEN '{a}' THEN k_{b}" for a, b in NEEDS.items())} END AS pk FROM lt),
c AS (SELECT cited.event_id, cited.event_type, cited.k, o.event_id AS cites, o.event_type AS premise FROM cited LEFT JOIN o ON o.k = pk)"""


def _cites(spark, sf):
    e = events(spark, sf).select("ts", "event_id", "event_type")
    return S.latest_rows(e, [], _ORDER, "event_id", "event_type", RULES, NEEDS)


@query(f"WITH {_CITES} SELECT event_id, event_type, cites, premise FROM c WHERE cites IS NOT NULL")
def event_premises(spark, sf):
    """Each event with the earlier event that it rests on."""
    c = _cites(spark, sf)
    other = c.select(F.col("event_id").alias("cites"), F.col("event_type").alias("premise"))
    return c.select("event_id", "event_type", "cites").join(other, "cites").select("event_id", "event_type", "cites", "premise")


@query(f"WITH {_CITES} SELECT event_id, event_type, {_NEED} AS need FROM c WHERE cites IS NULL AND {_NEED} IS NOT NULL")
def missing_premises(spark, sf):
    """Events that need an earlier one which isn't there."""
    need = F.lit(None).cast("string")
    for a, b in NEEDS.items():
        need = F.when(F.col("event_type") == a, F.lit(b)).otherwise(need)
    return _cites(spark, sf).withColumn("need", need).where("cites IS NULL AND need IS NOT NULL").select("event_id", "event_type", "need")


@query(
    f"""WITH RECURSIVE {_CITES}, m AS (SELECT *, CAST(1 << (list_position({RULES}, event_type) - 1) AS BIGINT) AS bit FROM c),
r AS (SELECT event_id, event_id AS root, CAST(0 AS BIGINT) AS depth, bit AS mask FROM m WHERE cites IS NULL
  UNION ALL SELECT m.event_id, r.root, r.depth + 1, r.mask | m.bit FROM r JOIN m ON m.cites = r.event_id)
SELECT event_id, root, depth, array_to_string([x FOR x IN {RULES} IF mask & (1 << (list_position({RULES}, x) - 1)) > 0], ',') AS rules FROM r"""
)
def event_lineage(spark, sf):
    """The first event that each event rests on, how many lie between, and the types of all of them."""
    bit = F.lit(0)
    for k, r in enumerate(RULES):
        bit = F.when(F.col("event_type") == r, F.lit(1 << k)).otherwise(bit)
    e = events(spark, sf).select("ts", "event_id", "event_type")
    got = S.latest_lineage(e, [], _ORDER, "event_id", "event_type", RULES, NEEDS, bit)
    rules = F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.lit(r)) for k, r in enumerate(RULES))))
    return got.select("event_id", "root", "depth", F.array_join(rules, ",").alias("rules"))


_EDGES = f"""{STEPS}, edge AS (SELECT a.user_id, a.d, a.pos AS id, max(b.pos) AS p FROM steps a JOIN steps b ON b.user_id = a.user_id AND b.d = a.d AND b.pos < a.pos
  AND b.rule IN (CASE a.rule {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in NEEDS.items())} END, 'signup') GROUP BY a.user_id, a.d, a.pos, b.rule)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT user_id, d, id, p FROM edge UNION SELECT r.user_id, r.d, r.id, edge.p FROM r JOIN edge ON edge.user_id = r.user_id AND edge.d = r.d AND edge.id = r.p),
a AS (SELECT user_id, d, id, p FROM r UNION ALL SELECT user_id, d, pos, pos FROM steps)
SELECT a.user_id, a.d, a.id, CAST(count(*) - 1 AS BIGINT) AS ancestors, array_to_string(list_sort(list(DISTINCT s.rule)), ',') AS rules
FROM a JOIN steps s ON s.user_id = a.user_id AND s.d = a.d AND s.pos = a.p GROUP BY a.user_id, a.d, a.id"""
)
def provenance(spark, sf):
    """Ancestors of each step within its trace, and their rules: a step cites the latest step that it needs and the latest signup."""
    st = steps(spark, sf).select("user_id", "d", "pos", "rule")
    by = ["user_id", "d"]
    need = S.latest_rows(st, by, ["pos"], "pos", "rule", RULES, NEEDS).select(*by, F.col("pos").alias("id"), F.col("cites").alias("p"))
    sign = S.latest_rows(st, by, ["pos"], "pos", "rule", RULES, dict.fromkeys(RULES, "signup")).select(*by, F.col("pos").alias("id"), F.col("cites").alias("p"))
    reach = L.closure(need.unionByName(sign).where("p IS NOT NULL"), by)
    every = reach.unionByName(st.select(*by, F.col("pos").alias("id"), F.col("pos").alias("p")))
    rules = every.join(st.select(*by, F.col("pos").alias("p"), "rule"), [*by, "p"])
    return rules.groupBy(*by, "id").agg((F.count(F.lit(1)) - 1).alias("ancestors"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
