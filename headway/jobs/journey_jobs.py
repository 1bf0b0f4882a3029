"""Journey searches and what is reported of journeys, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions import geo
from headway.functions.durable import durable
from headway.jobs.catalogue import CALLS, EDGES, calls, query
from headway.operators import rounds, summaries
from headway.operators.journeys import MODES
from headway.sources.demo_feed import DemoFeed


def search_sql(modes: list[str], n: int = 4, width: int = 10, k: int = 3) -> str:
    """SQL of the search in rounds, up to ``found``: one table of ways a ride, one after the walk."""
    best = "mode, origins, stop_id, lines, days, min({'cost': cost, 'walk': walk, 'steps': steps, 'tram': tram}) AS best"
    top = f"QUALIFY row_number() OVER (PARTITION BY mode, origins, stop_id ORDER BY cost, walk, lines, days) <= {width}"
    flat = "mode, origins, stop_id, lines, days, best.cost AS cost, best.walk AS walk, best.steps AS steps, best.tram AS tram"
    walk = "SELECT mode, origins, to_stop AS stop_id, lines, days, cost + metres * on_foot AS cost, walk + metres AS walk, steps || 'w:' || stop_id || ':' || to_stop || ':' || metres || ';' AS steps, tram FROM {0} JOIN edges USING (stop_id) JOIN modes USING (mode)"
    listed = ", ".join(f"('{m}', {', '.join(map(str, MODES[m]))})" for m in modes)
    sql = CALLS + EDGES + f""", modes AS (SELECT * FROM (VALUES {listed}) t(mode, by_bus, by_tram, on_foot, bonus, change)),
pairs AS (SELECT DISTINCT origins, destinations FROM named_requests WHERE NOT list_has_any(origins, destinations)),
ends AS (SELECT origins, destinations, unnest(destinations) AS stop_id FROM pairs),
seeds AS (SELECT mode, origins, unnest(origins) AS stop_id, '-' AS lines, 127 AS days, 0::BIGINT AS cost, 0::BIGINT AS walk, '' AS steps, false AS tram FROM (SELECT DISTINCT origins FROM pairs), modes),
feet AS ({walk.format('seeds')}),
ways0 AS (SELECT {flat} FROM (SELECT {best} FROM (SELECT * FROM seeds UNION ALL SELECT * FROM feet) GROUP BY mode, origins, stop_id, lines, days))"""
    for r in range(1, n + 1):
        sql += f""", rode{r} AS MATERIALIZED (SELECT {flat} FROM (SELECT {best} FROM (
  SELECT mode, origins, b.stop_id, lines || a.route_id || '-' AS lines, w.days & a.days AS days, cost + 200000 + 10000 * (b.position - a.position) + greatest(b.metres - a.metres, 0) * CASE WHEN a.tram THEN by_tram ELSE by_bus END
      - CASE WHEN a.tram AND NOT w.tram THEN bonus ELSE 0 END + {'change' if r > 1 else '0'} AS cost, walk, steps || 'r:' || a.pattern_id || ':' || a.position || ':' || b.position || ';' AS steps, w.tram OR a.tram AS tram
  FROM ways{r - 1} w JOIN modes USING (mode) JOIN calls a ON a.stop_id = w.stop_id AND a.pickup JOIN calls b ON b.pattern_id = a.pattern_id AND b.position > a.position AND b.dropoff
  WHERE NOT contains(lines, '-' || a.route_id || '-') AND w.days & a.days <> 0) GROUP BY mode, origins, stop_id, lines, days)),
kept{r} AS (SELECT * FROM rode{r} {top}),
ways{r} AS MATERIALIZED (SELECT * FROM (SELECT {flat} FROM (SELECT {best} FROM (SELECT * FROM kept{r} UNION ALL {walk.format(f'kept{r}')}) GROUP BY mode, origins, stop_id, lines, days)) {top})"""
    some = " UNION ALL ".join(["SELECT *, 0 AS rides FROM feet", *(f"SELECT *, {r} AS rides FROM (SELECT * FROM rode{r} UNION ALL {walk.format(f'rode{r}')})" for r in range(1, n + 1))])
    return sql + f""", reached AS (SELECT * FROM ({some}) JOIN ends USING (origins, stop_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY mode, origins, destinations ORDER BY CASE WHEN mode = 'fewest_transfers' THEN greatest(rides - 1, 0) ELSE 0 END, best.cost, greatest(rides - 1, 0), best.walk, lines) AS rank
  FROM (SELECT mode, origins, destinations, rides, lines, min({{'cost': cost, 'walk': walk, 'days': days, 'steps': steps}}) AS best FROM reached GROUP BY ALL) QUALIFY rank <= {k}),
found AS (SELECT request_id, mode, rank, rides, lines, best.days AS days, best.steps AS steps, best.walk AS walk, best.cost / 40000::DOUBLE AS cost FROM named_requests JOIN top USING (origins, destinations))"""


def searched(feed: DemoFeed, on: DataFrame, **options) -> DataFrame:
    return rounds.journeys(feed.named_requests(), on, geo.walking_edges(feed.stops()), stops=feed.stops(), **options)


for _mode in MODES:

    def _search(feed: DemoFeed, mode: str = _mode) -> DataFrame:
        """Journeys of up to four rides between all platforms of two names, in one of the four modes."""
        return searched(feed, calls(feed), modes=(mode,))

    _search.__name__ = f"journeys_{_mode}"
    query(search_sql([_mode]) + " SELECT * FROM found")(_search)


COUNTED = ", ".join(f"count(*) FILTER (rides = {n}) AS {c}" for n, c in enumerate(rounds.CHANGES, 1))


@query(search_sql(["fewest_transfers"], k=5) + f" SELECT request_id, m.mode, {COUNTED} FROM named_requests CROSS JOIN modes m LEFT JOIN found USING (request_id) GROUP BY request_id, m.mode")
def answer_counts(feed: DemoFeed) -> DataFrame:
    """Of the five journeys with fewest changes of each request, how many have none to three."""
    only = ("fewest_transfers",)
    return rounds.answer_counts(feed.named_requests(), searched(feed, calls(feed), modes=only, k=5), only)


@query(None)
def sensible_journeys(feed: DemoFeed) -> DataFrame:
    """The fastest journeys of up to three rides, without round-about ones."""
    return searched(feed, calls(feed), modes=("fastest",), rides=3, sensible=True)


LEGS = search_sql(["fastest"], 2) + """, steps AS (SELECT request_id, rank, unnest(string_split(rtrim(steps, ';'), ';')) AS step, generate_subscripts(string_split(rtrim(steps, ';'), ';'), 1) - 1 AS leg FROM found),
parts AS (SELECT request_id, rank, leg, step[1] AS kind, string_split(step, ':')[2]::BIGINT AS x, string_split(step, ':')[3]::BIGINT AS y, string_split(step, ':')[4]::BIGINT AS z FROM steps),
legs AS (
  SELECT request_id, rank, leg, false AS walking, x AS pattern_id, a.route_id, y::INT AS board, z::INT AS alight, a.stop_id AS board_stop, b.stop_id AS alight_stop, greatest(b.metres - a.metres, 0) AS metres, (z - y)::INT AS hops, a.tram,
    greatest(b.metres - a.metres, 0) * CASE WHEN a.tram THEN 5 ELSE 6 END + 500 * (z - y) AS ticks
  FROM parts JOIN calls a ON a.pattern_id = x AND a.position = y JOIN calls b ON b.pattern_id = x AND b.position = z WHERE kind = 'r'
  UNION ALL SELECT request_id, rank, leg, true, NULL, NULL, NULL, NULL, x, y, z, 0, false, z * 25 FROM parts WHERE kind = 'w'),
timed AS (SELECT *, coalesce(sum(ticks + CASE WHEN walking THEN 0 ELSE 10000 END) OVER (PARTITION BY request_id, rank ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reach_ticks FROM legs)"""
KEYS = ("request_id", "rank")


def fast(feed: DemoFeed, on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fastest journeys of up to two rides, and their legs."""
    found = durable(searched(feed, on, modes=("fastest",), rides=2))
    return found, durable(summaries.timed_legs(rounds.legs(found, on, *KEYS), *KEYS))


@query(LEGS + " SELECT * FROM timed")
def journey_legs(feed: DemoFeed) -> DataFrame:
    return fast(feed, calls(feed))[1]


@query(LEGS + """, totals AS (
  SELECT request_id, rank, count(*) AS n_legs, count(*) FILTER (NOT walking) AS n, sum(metres)::BIGINT AS metres, sum(CASE WHEN walking THEN metres ELSE 0 END)::BIGINT AS walk_metres, bool_or(tram) AS has_tram, sum(hops)::BIGINT AS hops, sum(ticks)::BIGINT AS ticks,
    coalesce(string_agg(route_id::VARCHAR, '>' ORDER BY leg) FILTER (NOT walking), '') AS combination FROM timed GROUP BY ALL)
SELECT request_id, rank, n_legs, greatest(n - 1, 0) AS transfers, n = 1 AS is_direct, metres, walk_metres, has_tram, hops, (ticks + 10000 * n + 1999) // 2000 AS minutes, n - 1 AS score_transfers, hops + walk_metres / 80 AS score_effort, combination,
  array_to_string([d for d, i in zip(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], range(7)) if true], ', ') AS day_names FROM totals JOIN found USING (request_id, rank)""".replace(
    "array_to_string([d for d, i in zip(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], range(7)) if true], ', ')",
    "concat_ws(', ', " + ", ".join(f"CASE WHEN days & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(summaries.DAY_NAMES)) + ")",
))
def journey_summaries(feed: DemoFeed) -> DataFrame:
    found, each = fast(feed, calls(feed))
    return summaries.summaries(found, each, *KEYS)


@query(LEGS + """, ordered AS (SELECT *, lag(alight_stop) OVER (PARTITION BY request_id, rank ORDER BY leg) AS prior FROM timed)
SELECT 'rides' AS rule, request_id, rank FROM timed GROUP BY ALL HAVING count(*) FILTER (NOT walking) > 4 UNION ALL SELECT 'legs', request_id, rank FROM timed GROUP BY ALL HAVING count(*) > 9
UNION SELECT 'meet', request_id, rank FROM ordered WHERE prior <> board_stop UNION SELECT 'days', request_id, rank FROM found WHERE days = 0 UNION SELECT 'order', request_id, rank FROM timed WHERE board >= alight""")
def broken_journeys(feed: DemoFeed) -> DataFrame:
    found, each = fast(feed, calls(feed))
    return summaries.broken(found, each, *KEYS)


@query(LEGS + """, told AS (
  SELECT request_id, rank, leg, CASE WHEN any_value(walking) THEN 'walk ' || any_value(board_stop) || '-' || any_value(alight_stop) || ' ' || any_value(t.metres)
    ELSE CASE WHEN any_value(t.tram) THEN 'tram ' ELSE 'bus ' END || string_agg(c.stop_id::VARCHAR, '-' ORDER BY c.position) END AS part
  FROM timed t LEFT JOIN calls c ON c.pattern_id = t.pattern_id AND c.position BETWEEN board AND alight GROUP BY request_id, rank, leg),
signed AS (SELECT request_id, rank, string_agg(part, ' / ' ORDER BY leg) AS signature FROM told GROUP BY ALL)
SELECT request_id, rank, signature, min(rank) OVER (PARTITION BY request_id, signature) AS first_rank FROM signed""")
def parallel_journeys(feed: DemoFeed) -> DataFrame:
    """The exact path of each journey, and the best journey of the request that has the same."""
    from pyspark.sql import Window

    on = calls(feed)
    signed = summaries.signatures(fast(feed, on)[1], on, *KEYS)
    return signed.withColumn("first_rank", F.min("rank").over(Window.partitionBy("request_id", "signature")))


@query(LEGS + " SELECT DISTINCT pattern_id, board, alight FROM timed WHERE NOT walking")
def journey_vehicle_specs(feed: DemoFeed) -> DataFrame:
    return summaries.vehicle_specs(fast(feed, calls(feed))[1])


@query(LEGS + """, named_legs AS (SELECT t.*, a.name AS a, b.name AS b FROM timed t JOIN stops a ON a.stop_id = board_stop JOIN stops b ON b.stop_id = alight_stop)
SELECT request_id, rank, rides, count(*) AS n_legs, string_agg(a || ' > ' || b, ', ' ORDER BY leg) AS told FROM named_legs JOIN found USING (request_id, rank) GROUP BY request_id, rank, rides""")
def journey_records(feed: DemoFeed) -> DataFrame:
    """Nested records of journeys, told in one line each."""
    found, each = fast(feed, calls(feed))
    nested = summaries.records(found, each, feed.stops(), *KEYS)
    told = F.array_join(F.transform("legs", lambda x: F.concat_ws(" > ", x.board_stop_name, x.alight_stop_name)), ", ")
    return nested.select(*KEYS, "rides", F.size("legs").cast("long").alias("n_legs"), told.alias("told"))
