"""Nesting, best paths and sequences up to renaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nesting as N
from ..operators import paths as K
from ..operators import renaming as R
from ..sources.files import goal_lines
from .tables import STEPS, TRACES, events, steps, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: Tags that must be closed by their own end tag.
TAGS = ["article", "b", "div", "h1", "i", "li", "nav", "p", "table", "td", "tr", "ul"]


def _stack_sql(source: str, key: str, text: str, pattern: str, name: str, opens: str) -> str:
    """A stack as a string of /names; a failed reading is ! and its place."""
    return f"""WITH x AS (SELECT {key} AS key, coalesce({text}, '') AS s FROM {source}),
m AS (SELECT key, s, regexp_extract_all(s, '{pattern}') AS ts, [length(g) FOR g IN string_split_regex(s, '{pattern}')] AS gs FROM x),
t AS (SELECT key, s, ts, [{{'t': ts[i], 'o': CAST(list_sum(gs[1:i]) AS BIGINT) + CAST(coalesce(list_sum([length(y) FOR y IN ts[1:i - 1]]), 0) AS BIGINT)}} FOR i IN range(1, len(ts) + 1)] AS ps FROM m),
n AS (SELECT key, s, [CASE WHEN {opens} THEN '+' ELSE '-' END || {name} || '@' || p.o FOR p IN ps] AS us, [CASE WHEN {opens} THEN 1 ELSE -1 END FOR p IN ps] AS signs FROM t),
r AS (SELECT key, s, signs, list_reduce(list_concat([''], us), lambda a, u: CASE WHEN a[1] = '!' THEN a
  WHEN u[1] = '+' THEN a || '/' || split_part(u[2:], '@', 1)
  WHEN split_part(a, '/', -1) = split_part(u[2:], '@', 1) AND a <> '' THEN a[1:length(a) - length(split_part(u, '@', 1))]
  ELSE '!' || split_part(u, '@', 2) END) AS a FROM n)
SELECT key AS {key}, CAST(len(signs) AS BIGINT) AS n_tokens, CAST(greatest(0, coalesce(list_max([list_sum(signs[1:i]) FOR i IN range(1, len(signs) + 1)]), 0)) AS BIGINT) AS deepest,
  a = '' AS balanced, CASE WHEN a[1] = '!' THEN CAST(a[2:] AS BIGINT) WHEN a <> '' THEN length(s) END AS place FROM r"""


@query(_stack_sql("documents", "doc_id", "text", r"[()\[\]{}]", "translate(p.t, ')]}', '([{')", "p.t IN ('(', '[', '{')"))
def bracket_nesting(spark, sf):
    """Whether the brackets of each document nest, and where they first don't."""
    return N.brackets(table(spark, sf, "documents"), "doc_id", "text")


@query(_stack_sql("pages", "page_id", "html", f"(?i)</?(?:{'|'.join(TAGS)})\\b", "lower(regexp_replace(p.t, '[</]', '', 'g'))", "p.t[2] <> '/'"))
def tag_nesting(spark, sf):
    """Whether start and end tags of each page nest, and where they first don't."""
    return N.tags(table(spark, sf, "pages"), "page_id", "html", TAGS)


PATHS, STEPS_MOST = 8, 6
_COST = "CAST(floor(-1000 * ln(n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE))) AS BIGINT)"


@query(
    f"""WITH RECURSIVE f AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
c AS (SELECT a, b, count(*) AS n FROM f WHERE b IS NOT NULL GROUP BY a, b), e AS (SELECT a, b, {_COST} AS cost FROM c),
p AS (SELECT 'view' AS node, CAST(0 AS BIGINT) AS cost, ['view'] AS path UNION ALL
  SELECT e.b, p.cost + e.cost, list_append(p.path, e.b) FROM p JOIN e ON e.a = p.node WHERE p.node <> 'purchase' AND len(p.path) <= {STEPS_MOST}),
r AS (SELECT *, row_number() OVER (ORDER BY cost, path) AS rank FROM p WHERE node = 'purchase')
SELECT rank, cost, array_to_string(path, '>') AS path FROM r WHERE rank <= {PATHS}"""
)
def likely_paths(spark, sf):
    """The likeliest ways from a view to a purchase, by how often events follow each other."""
    from pyspark.sql import Window

    t = K.transitions(events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")
    cost = F.floor(-1000 * F.log(F.col("n") / F.sum("n").over(Window.partitionBy("a")).cast("double")))
    best = K.best_paths(t.select("a", "b", cost.alias("cost")), "view", "purchase", PATHS, STEPS_MOST)
    return best.select("rank", "cost", F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {TRACES}, l AS (SELECT user_id, d, n, rules, [list_position(list_distinct_in_order, x) FOR x IN rules] AS labels FROM
  (SELECT *, list_filter(rules, lambda x, i: list_position(rules, x) = i) AS list_distinct_in_order FROM traces)),
c AS (SELECT labels, count(*) AS size, min({{'user_id': user_id, 'd': d}}) AS first FROM l GROUP BY labels)
SELECT user_id, d, n, CAST(list_max(l.labels) AS BIGINT) AS n_symbols, size, first.user_id AS first_user, first.d AS first_d FROM l JOIN c ON l.labels = c.labels"""
)
def renamed_traces(spark, sf):
    """Traces that are equal up to the names of their rules: the size of each one's class and its first member."""
    got = R.classes(steps(spark, sf).select("user_id", "d", "pos", "rule"), ["user_id", "d"], "pos", "rule")
    return got.select("user_id", "d", "n", "n_symbols", "size", F.col("first.user_id").alias("first_user"), F.col("first.d").alias("first_d"))


_KIND = "CASE rule WHEN 'view' THEN 'type' WHEN 'click' THEN 'const' WHEN 'signup' THEN 'axiom' WHEN 'purchase' THEN 'goal' END"


def decls(spark, sf):
    """Declarations of a goal file for each trace: event types stand for kinds, properties for bodies."""
    kind = F.create_map(*map(F.lit, ("view", "type", "click", "const", "signup", "axiom", "purchase", "goal")))
    arity = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int") % 3
    return steps(spark, sf).select(F.concat_ws("-", "user_id", "d").alias("file"), "pos", kind[F.col("rule")].alias("kind"), F.concat("rule", F.col("pos").cast("string")).alias("name"), arity.alias("arity"), F.col("props").alias("body"))


@query(
    rf"""WITH {STEPS}, x AS (SELECT concat_ws('-', s.user_id, d) AS file, {_KIND} AS kind, pos, '"' || rule || pos || '"' AS name, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 3 AS arity,
'"' || replace(replace(props, '\', '\\'), '"', '\"') || '"' AS body FROM steps s JOIN events USING (event_id))
SELECT file, kind = 'goal' AS last, pos, CASE kind WHEN 'type' THEN '(type ' || name || ' ' || arity || ')' WHEN 'goal' THEN '(goal ' || body || ')' ELSE '(' || kind || ' ' || name || ' ' || body || ')' END AS value FROM x WHERE kind IS NOT NULL AND body IS NOT NULL"""
)
def goal_file_lines(spark, sf):
    """Lines of the goal files that traces make, in the order (last, pos) of each file."""
    return goal_lines(decls(spark, sf))
