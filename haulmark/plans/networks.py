"""Graph queries: components, shortest paths, line graphs, certificates, edge splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import geo
from haulmark.operators import graphs, routing
from haulmark.sources.tables import LINKS, LOCATIONS, ROADS, TIMED_TRADE, TRADE, locations, roads, table, timed_trade, trade, traded

from .registry import query


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.settle(roads(spark, sf_dir).groupBy("u", "v").agg(F.min("length_m").alias("w")))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


@query("""WITH g AS (SELECT event_id, user_id, sum(CASE WHEN ts - before <= INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)),
  c AS (SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, part) AS component, count(*) OVER (PARTITION BY user_id, part) AS size FROM g),
  r AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS rank FROM (SELECT DISTINCT component, size FROM c WHERE size > 1))
  SELECT node, component, size, 'W' || lpad(CAST(rank AS VARCHAR), greatest(4, length(CAST(rank AS VARCHAR)))::INTEGER, '0') AS label FROM c JOIN r USING (component, size)""")
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components of events that follow within twelve hours, labelled by size and smallest member."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), (F.lead("ts").over(w) - F.col("ts")).alias("gap"))
    member = graphs.components(pairs.where(F.col("b").isNotNull() & (F.col("gap") <= F.expr("interval '12' hour"))).select("a", "b"))
    return graphs.ranked(member, "W").select("node", "component", "size", "label")


#: Of two ways between cities the longer one is closed.
SOME = f"{LINKS}, picked AS (SELECT l.u, l.v, l.w FROM links l LEFT JOIN links r ON r.u = l.v AND r.v = l.u WHERE r.w IS NULL OR l.w <= r.w)"


@query(f"""WITH RECURSIVE {SOME}, reach AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION SELECT a, picked.v FROM reach JOIN picked ON b = picked.u),
  c AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS rank FROM s)
  SELECT node, component, size, 'S' || lpad(CAST(rank AS VARCHAR), greatest(4, length(CAST(rank AS VARCHAR)))::INTEGER, '0') AS label FROM c JOIN r USING (component)""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("back"))
    edges = links.join(back, ["u", "v"], "left").where(F.col("back").isNull() | (F.col("w") <= F.col("back"))).select("u", "v")
    return graphs.ranked(graphs.strong_components(edges, _nodes(spark, sf_dir)), "S").select("node", "component", "size", "label")


def _paths_sql(edges: str, starts: str, hops: int = 30) -> str:
    """Bellman-Ford by rounds: the least cost with at most so many hops."""
    return f"""walk(source, node, cost, hop) AS (SELECT source, node, cost, 0 FROM ({starts}) UNION ALL SELECT source, v, min(cost + w), any_value(hop) + 1 FROM walk JOIN {edges} ON node = u WHERE hop < {hops} GROUP BY source, v),
  best AS (SELECT source, node, min(cost) AS cost FROM walk GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {LINKS}, {_paths_sql('links', 'SELECT min(n_nationkey) AS source, min(n_nationkey) AS node, 0.0::DOUBLE AS cost FROM nation GROUP BY n_regionkey')} SELECT source, node, cost FROM best")
def sssp_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distances from the first city of each region, all sources at once."""
    first = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("node"))
    starts = first.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    return graphs.shortest(_links(spark, sf_dir), starts)


@query(f"WITH RECURSIVE {TRADE}, {_paths_sql('trade', 'SELECT min(s_suppkey) * 2 + 1 AS source, min(s_suppkey) * 2 + 1 AS node, 0.0::DOUBLE AS cost FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey', 40)} SELECT source, node, cost FROM best")
def sssp_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least costs from the first supplier of each region over the graph of all customers and suppliers."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    first = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").groupBy("n_regionkey").agg((F.min("s_suppkey") * 2 + 1).alias("node"))
    return graphs.shortest(graphs.settle(trade(spark, sf_dir)), first.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")))


@query()
def scc_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the graph of all customers and suppliers."""
    edges = graphs.settle(traded(spark, sf_dir).select("u", "v"))  # parallel edges change nothing
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return graphs.ranked(graphs.strong_components(edges, nodes), "S").select("node", "component", "size", "label")


def _tree_sql(edges: str, starts: str, hops: int) -> str:
    """By rounds, the least (cost, second) of ways with exactly so many hops; then the least label, and who leads to it."""
    return f"""walk(source, node, cost, second, hop) AS (SELECT source, node, 0::BIGINT, 0::BIGINT, 0 FROM ({starts}) UNION ALL SELECT source, v, min(c), arg_min(s, (c, s)), any_value(hop) + 1 FROM (SELECT source, v, cost + w AS c, second + t AS s, hop FROM walk JOIN {edges} ON node = u WHERE hop < {hops}) GROUP BY source, v),
  best AS (SELECT source, node, min(cost) AS cost, arg_min(second, (cost, second, hop)) AS second, arg_min(hop, (cost, second, hop)) AS hops FROM walk GROUP BY 1, 2),
  tree AS (SELECT b.source, b.node, b.cost, b.second, b.hops, min(a.node) AS previous FROM best b LEFT JOIN {edges} e ON e.v = b.node AND b.hops > 0
    LEFT JOIN best a ON a.source = b.source AND a.node = e.u AND a.cost + e.w = b.cost AND a.second + e.t = b.second AND a.hops + 1 = b.hops GROUP BY ALL)"""


#: One supplier of each region, and the least ways from it by quantity, then by time.
TRADE_TREE = f"{TIMED_TRADE}, {_tree_sql('timed', 'SELECT min(s_suppkey) * 2 + 1 AS source, min(s_suppkey) * 2 + 1 AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey', 40)}"


def _trade_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    first = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").groupBy("n_regionkey").agg((F.min("s_suppkey") * 2 + 1).alias("node"))
    zero = F.lit(0).cast("bigint")
    return routing.shortest_tree(timed_trade(spark, sf_dir), first.select(F.col("node").alias("source"), "node", zero.alias("cost"), zero.alias("second")))


@query(f"WITH RECURSIVE {TRADE_TREE} SELECT source, node, cost, second, hops, previous FROM tree")
def sssp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths with predecessors over the graph of all customers and suppliers, and the time along each."""
    return _trade_tree(spark, sf_dir)


@query(f"""WITH RECURSIVE {TRADE_TREE}, way(source, node, path) AS (SELECT source, node, CAST(node AS VARCHAR) FROM tree WHERE hops = 0 UNION ALL SELECT t.source, t.node, way.path || '>' || t.node FROM tree t JOIN way ON t.source = way.source AND t.previous = way.node)
  SELECT source, node, hops, cost, path FROM tree JOIN way USING (source, node)""")
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shortest path as the nodes it goes through."""
    tree = graphs.settle(_trade_tree(spark, sf_dir))
    ways = routing.paths(tree).select("source", "node", F.array_join("path", ">").alias("path"))
    return tree.join(ways, ["source", "node"]).select("source", "node", "hops", "cost", "path")


@query(f"""WITH RECURSIVE {LINKS}, back AS (SELECT v AS u, u AS v, w FROM links), {_paths_sql('links', 'SELECT 0 AS source, 0 AS node, 0.0::DOUBLE AS cost')},
  walk2(source, node, cost, hop) AS (SELECT 0, 0, 0.0::DOUBLE, 0 UNION ALL SELECT source, v, min(cost + w), any_value(hop) + 1 FROM walk2 JOIN back ON node = u WHERE hop < 30 GROUP BY source, v), best2 AS (SELECT source, node, min(cost) AS cost FROM walk2 GROUP BY 1, 2)
  SELECT n_nationkey AS node, best.cost AS outward, best2.cost AS inward FROM nation LEFT JOIN best ON best.node = n_nationkey LEFT JOIN best2 ON best2.node = n_nationkey""")
def depot_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one depot to all and back, on the graph and its reverse."""
    links = _links(spark, sf_dir)
    start = spark.range(1).select(F.lit(0).alias("source"), F.lit(0).alias("node"), F.lit(0.0).alias("cost"))
    outward = graphs.shortest(links, start).select("node", F.col("cost").alias("outward"))
    inward = graphs.shortest(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"), start).select("node", F.col("cost").alias("inward"))
    return _nodes(spark, sf_dir).join(outward, "node", "left").join(inward, "node", "left")


@query(f"""WITH RECURSIVE {LINKS}, {_paths_sql('links', 'SELECT n_nationkey AS source, n_nationkey AS node, 0.0::DOUBLE AS cost FROM nation')}
  SELECT a.source AS a, a.node AS b, (a.cost + b.cost) / 2 AS distance FROM best a JOIN best b ON a.source = b.node AND a.node = b.source WHERE a.source < a.node""")
def sssp_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _nodes(spark, sf_dir).select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    cost = graphs.shortest(_links(spark, sf_dir), starts)
    back = cost.select(F.col("node").alias("source"), F.col("source").alias("node"), F.col("cost").alias("back"))
    return cost.join(back, ["source", "node"]).where("source < node").select(F.col("source").alias("a"), F.col("node").alias("b"), ((F.col("cost") + F.col("back")) / 2).alias("distance"))


@query(f"""WITH RECURSIVE {LINKS}, {_paths_sql('links', 'SELECT n_nationkey AS source, n_nationkey AS node, 0.0::DOUBLE AS cost FROM nation')} SELECT source AS i, node AS j, cost AS distance_m, cost * 3.6 / 30 AS time_s FROM best""")
def all_pairs_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of all terminals, as rows; all sources take their rounds together."""
    starts = _nodes(spark, sf_dir).select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    cost = graphs.shortest(_links(spark, sf_dir), starts)
    return cost.select(F.col("source").alias("i"), F.col("node").alias("j"), F.col("cost").alias("distance_m"), (F.col("cost") * 3.6 / 30).alias("time_s"))


#: Where cities lie, and the angle of a road between them.
PLACED = f"""{LINKS}, e AS (SELECT u * 100 + v AS edge, u, v, w, (degrees(atan2(v % 5 - u % 5, v // 5 - u // 5)) + 360) % 360 AS angle FROM links),
  turns AS (SELECT a.edge AS a, b.edge AS b, b.w, (b.angle - a.angle + 540) % 360 - 180 AS delta FROM e a JOIN e b ON a.v = b.u),
  line AS (SELECT a AS u, b AS v, w + CASE WHEN abs(delta) <= 30 THEN 0.0::DOUBLE WHEN abs(delta) >= 150 THEN 20.0::DOUBLE WHEN delta > 0 THEN 3.0::DOUBLE ELSE 8.0::DOUBLE END AS w FROM turns)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (lambda c: (F.col(c) % 5).cast("double")), (lambda c: F.floor(F.col(c) / 5).cast("double"))
    return _links(spark, sf_dir).select((F.col("u") * 100 + F.col("v")).alias("edge"), "u", "v", "w", geo.bearing(x("u"), y("u"), x("v"), y("v")).alias("angle"))


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.line_graph(_placed(spark, sf_dir), geo.turn_penalty_s(geo.turn_delta(F.col("a_angle"), F.col("b_angle"))))


@query(f"WITH {PLACED} SELECT u AS a, v AS b, w FROM line")
def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, sf_dir)


@query(f"""WITH RECURSIVE {PLACED}, {_paths_sql('line', 'SELECT u AS source, edge AS node, w AS cost FROM e WHERE u IN (0, 7)', 60)} SELECT source, node % 100 AS target, min(cost) AS cost FROM best GROUP BY 1, 2""")
def sssp_turn_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least costs with turn penalties: paths over the line graph from a source's edges; a target costs what its best last edge does."""
    edges = _placed(spark, sf_dir)
    starts = edges.where("u IN (0, 7)").select(F.col("u").alias("source"), F.col("edge").alias("node"), F.col("w").alias("cost"))
    line = graphs.settle(_line(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))
    return graphs.shortest(line, starts).groupBy("source", (F.col("node") % 100).alias("target")).agg(F.min("cost").alias("cost"))


#: Two ways onto the roads for each supplier; a hundred suppliers are a family. Times in milliseconds.
ACCESS = f"""{PLACED}, road AS (SELECT edge, u, v, CAST(w * 120 AS BIGINT) AS time, CAST(w AS BIGINT) AS length FROM e),
  turn AS (SELECT a, b, CAST(CASE WHEN abs(delta) <= 30 THEN 0 WHEN abs(delta) >= 150 THEN 20000 WHEN delta > 0 THEN 3000 ELSE 8000 END AS BIGINT) AS penalty FROM turns),
  options AS (SELECT s_suppkey // 100 AS family, s_suppkey AS terminal, o AS option, edge, abs(o - (s_suppkey % 97) / 96.0::DOUBLE) AS at, 1000 * (o + 1) AS link_time, 5 + o AS link_length, time, length FROM supplier, (SELECT unnest([0, 1]) AS o) JOIN road ON u = s_nationkey AND v = (s_nationkey + 1 + (s_suppkey + 7 * o) % 24) % 25),
  line2 AS (SELECT a AS u, b AS v, penalty + time AS w, length AS t FROM turn JOIN road ON edge = b),
  {_tree_sql('line2', 'SELECT DISTINCT edge AS source, edge AS node FROM options', 10)},
  between_ AS (SELECT source AS edge_i, b AS edge_j, min(cost + penalty) AS time, arg_min(second, (cost + penalty, second)) AS length FROM best JOIN turn ON node = a WHERE b IN (SELECT edge FROM options) GROUP BY 1, 2),
  pair AS (SELECT i.family, i.terminal AS i, j.terminal AS j, i.option AS option_i, j.option AS option_j, i.link_time + ((1 - i.at) * i.time + w.time + j.at * j.time) + j.link_time AS time, i.link_length + ((1 - i.at) * i.length + w.length + j.at * j.length) + j.link_length AS length
      FROM options i JOIN options j ON i.family = j.family AND i.terminal <> j.terminal JOIN between_ w ON w.edge_i = i.edge AND w.edge_j = j.edge
    UNION ALL SELECT i.family, i.terminal, j.terminal, i.option, j.option, i.link_time + (j.at - i.at) * i.time + j.link_time, i.link_length + (j.at - i.at) * i.length + j.link_length FROM options i JOIN options j ON i.family = j.family AND i.terminal <> j.terminal AND i.edge = j.edge AND i.at <= j.at
    UNION ALL SELECT family, terminal, terminal, min(option), min(option), 0, 0 FROM options GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {ACCESS} SELECT family, i, j, round(min(time), 6) AS time, round(arg_min(length, (time, length, option_i, option_j)), 6) AS length, arg_min(option_i, (time, length, option_i, option_j)) AS option_i, arg_min(option_j, (time, length, option_i, option_j)) AS option_j FROM pair GROUP BY family, i, j""")
def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quickest turn-aware ways between a family's suppliers by either of their ways onto the roads, then the shortest."""
    roads_ = graphs.settle(_placed(spark, sf_dir))
    road = roads_.select("edge", "u", "v", (F.col("w") * 120).cast("bigint").alias("time"), F.col("w").cast("bigint").alias("length"))
    turns = graphs.line_graph(roads_.withColumn("w", F.lit(0.0)), geo.turn_penalty_s(geo.turn_delta(F.col("a_angle"), F.col("b_angle"))))
    turns = turns.select("a", "b", (F.col("w") * 1000).cast("bigint").alias("penalty"))
    key, o = F.col("s_suppkey"), F.col("option")
    owned = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("option"))
    target = F.pmod(F.col("s_nationkey") + 1 + F.pmod(key + o * 7, F.lit(24)), F.lit(25))
    owned = owned.select("s_suppkey", F.col("s_nationkey").alias("u"), target.cast(road.schema["v"].dataType).alias("v"), "option")
    options = owned.join(road, ["u", "v"]).select(
        F.floor(key / 100).alias("family"), key.alias("terminal"), "option", "edge", F.abs(o - F.pmod(key, F.lit(97)) / 96.0).alias("at"), ((o + 1) * 1000).alias("link_time"), (o + 5).alias("link_length"))
    found = routing.access_matrix(road, turns, options)
    return found.select("family", "i", "j", F.round("time", 6).alias("time"), F.round("length", 6).alias("length"), "option_i", "option_j")


#: How each day type weighs a road.
PROFILES = {0: 1.0, 1: 1.25}
REWEIGHED = f"""{PLACED}, profile AS (SELECT unnest([0, 1]) AS p, unnest([1.0, 1.25])::DOUBLE AS f), line2 AS (SELECT p * 10000 + a AS u, p * 10000 + b AS v, turns.w * f + (line.w - turns.w) AS w FROM turns JOIN line ON line.u = turns.a AND line.v = turns.b, profile)"""


@query(f"""WITH RECURSIVE {REWEIGHED}, {_paths_sql('line2', 'SELECT p AS source, p * 10000 + edge AS node, w * f AS cost FROM e, profile WHERE u = 0', 60)} SELECT source AS profile, node % 100 AS target, round(min(cost), 6) AS cost FROM best GROUP BY 1, 2""")
def reweighted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topology of turns, kept once and weighed anew for each day type; both are searched in the same rounds."""
    edges = graphs.settle(_placed(spark, sf_dir))
    turns = graphs.settle(graphs.line_graph(edges.withColumn("w", F.lit(0.0)), geo.turn_penalty_s(geo.turn_delta(F.col("a_angle"), F.col("b_angle")))))
    profile = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p, f in PROFILES.items()))).alias("x")
    weighed = edges.select("u", "edge", "w", profile).select("u", "edge", F.col("x.p").alias("p"), (F.col("w") * F.col("x.f")).alias("cost"))
    line = turns.join(weighed, turns.b == weighed.edge).select((F.col("p") * 10000 + F.col("a")).alias("u"), (F.col("p") * 10000 + F.col("b")).alias("v"), (F.col("cost") + F.col("w")).alias("w"))
    starts = weighed.where("u = 0").select(F.col("p").alias("source"), (F.col("p") * 10000 + F.col("edge")).alias("node"), "cost")
    found = graphs.shortest(graphs.settle(line), starts)
    return found.groupBy(F.col("source").alias("profile"), (F.col("node") % 100).alias("target")).agg(F.round(F.min("cost"), 6).alias("cost"))


@query(f"WITH {LINKS} SELECT u // 5 AS a, v // 5 AS b, min(w) AS w, count(*) AS n FROM links WHERE u // 5 <> v // 5 GROUP BY 1, 2")
def community_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _nodes(spark, sf_dir).select("node", F.floor(F.col("node") / 5).cast("int").alias("g"))
    return graphs.contract(_links(spark, sf_dir), groups)


#: Stations are cities of keys divisible by 4; a leg between depot 0 and stations costs its distance and the recharge.
STATES = f"{LINKS}, state AS (SELECT u, v, w + w * 0.05 AS w FROM links WHERE (u % 4 = 0 AND v % 4 = 0) AND w <= 1500)"


@query(f"""WITH RECURSIVE {STATES}, back AS (SELECT v AS u, u AS v, w FROM state), {_paths_sql('state', 'SELECT 0 AS source, 0 AS node, 0.0::DOUBLE AS cost')},
  walk2(source, node, cost, hop) AS (SELECT 0, 0, 0.0::DOUBLE, 0 UNION ALL SELECT source, v, min(cost + w), any_value(hop) + 1 FROM walk2 JOIN back ON node = u WHERE hop < 30 GROUP BY source, v), best2 AS (SELECT source, node, min(cost) AS cost FROM walk2 GROUP BY 1, 2)
  SELECT best.node AS station, round(best.cost, 6) AS forward, round(best2.cost, 6) AS reverse FROM best FULL OUTER JOIN best2 USING (node) WHERE best.node IS NOT NULL""")
def full_state_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost from the depot to each station with a full battery, and back, recharging at each."""
    forward, back = _states(spark, sf_dir)
    return forward.join(back, "node", "left").select(F.col("node").alias("station"), F.round("forward", 6).alias("forward"), F.round("reverse", 6).alias("reverse"))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    legs = graphs.settle(_links(spark, sf_dir).where("u % 4 = 0 AND v % 4 = 0 AND w <= 1500").select("u", "v", (F.col("w") + F.col("w") * 0.05).alias("w")))
    start = spark.range(1).select(F.lit(0).alias("source"), F.lit(0).alias("node"), F.lit(0.0).alias("cost"))
    forward = graphs.shortest(legs, start).select("node", F.col("cost").alias("forward"))
    return forward, graphs.shortest(legs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"), start).select("node", F.col("cost").alias("reverse"))


@query(f"""WITH RECURSIVE {STATES}, back AS (SELECT v AS u, u AS v, w FROM state), {_paths_sql('state', 'SELECT 0 AS source, 0 AS node, 0.0::DOUBLE AS cost')},
  walk2(source, node, cost, hop) AS (SELECT 0, 0, 0.0::DOUBLE, 0 UNION ALL SELECT source, v, min(cost + w), any_value(hop) + 1 FROM walk2 JOIN back ON node = u WHERE hop < 30 GROUP BY source, v), best2 AS (SELECT source, node, min(cost) AS cost FROM walk2 GROUP BY 1, 2),
  option AS (SELECT i.v AS customer, i.u AS station_in, o.v AS station_out, round(best.cost + i.w + o.w + best2.cost, 6) AS cost FROM links i JOIN links o ON i.v = o.u JOIN best ON best.node = i.u JOIN best2 ON best2.node = o.v WHERE i.v % 4 <> 0 AND i.u % 4 = 0 AND o.v % 4 = 0 AND i.w + o.w <= 3000)
  SELECT customer, min(cost) AS cost, arg_min(station_in, (cost, station_in, station_out)) AS station_in, arg_min(station_out, (cost, station_in, station_out)) AS station_out FROM option GROUP BY 1""")
def feasibility_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the least way from a full battery in, and out to a station or the depot, inside the battery's range."""
    forward, back = _states(spark, sf_dir)
    links = _links(spark, sf_dir)
    into = links.where("v % 4 <> 0 AND u % 4 = 0").select(F.col("v").alias("customer"), F.col("u").alias("station_in"), F.col("w").alias("w_in")).join(forward.withColumnRenamed("node", "station_in"), "station_in")
    out = links.where("u % 4 <> 0 AND v % 4 = 0").select(F.col("u").alias("customer"), F.col("v").alias("station_out"), F.col("w").alias("w_out")).join(back.withColumnRenamed("node", "station_out"), "station_out")
    cost = F.round(F.col("forward") + F.col("w_in") + F.col("w_out") + F.col("reverse"), 6)
    options = into.join(out, "customer").where("w_in + w_out <= 3000").select("customer", F.struct(cost.alias("cost"), "station_in", "station_out").alias("o"))
    best = options.groupBy("customer").agg(F.min("o").alias("o"))
    return best.select("customer", "o.cost", "o.station_in", "o.station_out")


@query(f"""WITH RECURSIVE {LINKS}, nxt AS (SELECT u AS node, min(v) AS next FROM links WHERE v > u GROUP BY 1), walk AS (SELECT n_nationkey AS start, 0::BIGINT AS step, n_nationkey AS node FROM nation UNION ALL SELECT start, step + 1, next FROM walk JOIN nxt USING (node)) SELECT start, step, node FROM walk""")
def predecessor_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes out of an arc table: the smallest successor is followed until none is left."""
    nexts = graphs.settle(_links(spark, sf_dir).where("v > u").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("next")))
    return graphs.chains(nexts, _nodes(spark, sf_dir))


@query(f"""WITH {LINKS}, {LOCATIONS}, p AS (SELECT u, v, w, round((location_id % 97) / 96.0::DOUBLE, 12) AS cut FROM locations JOIN links ON city_id = u AND v = (u + 1 + location_id % 3) % 25),
  o AS (SELECT u, v, w, cut FROM p WHERE cut > 1e-10 AND cut < 1 - 1e-10 UNION SELECT u, v, w, 0.0::DOUBLE FROM links UNION SELECT u, v, w, 1.0::DOUBLE FROM links), s AS (SELECT u, v, w, cut AS start, lead(cut) OVER (PARTITION BY u, v ORDER BY cut) AS stop FROM o)
  SELECT u, v, start, stop, round(w * (stop - start), 6) AS length_m FROM s WHERE stop IS NOT NULL""")
def edge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads cut at the projections of active locations; attributes go in proportion."""
    links = _links(spark, sf_dir)
    target = F.pmod(F.col("city_id") + 1 + F.pmod("location_id", F.lit(3)), F.lit(25)).cast("int")
    at = locations(spark, sf_dir).select(F.col("city_id").alias("u"), target.alias("v"), F.round(F.pmod("location_id", F.lit(97)) / 96.0, 12).alias("at")).where("at > 1e-10 AND at < 1 - 1e-10").distinct()
    inner = links.join(at, ["u", "v"]).select("u", "v", "w", "at")
    ends = links.select("u", "v", "w", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("at"))
    cut = inner.union(ends).withColumn("stop", F.lead("at").over(W.partitionBy("u", "v").orderBy("at"))).where(F.col("stop").isNotNull())
    return cut.select("u", "v", F.col("at").alias("start"), "stop", F.round(F.col("w") * (F.col("stop") - F.col("at")), 6).alias("length_m"))


@query(f"""WITH {LINKS}, r AS (SELECT n_regionkey AS city, buffer, count(*) FILTER (w <= 100 + buffer * 40) / count(*) AS coverage FROM links JOIN nation ON u = n_nationkey, (SELECT unnest([0, 1, 2, 5, 10, 20]) AS buffer) GROUP BY 1, 2)
  SELECT city, CAST(coalesce(min(buffer) FILTER (coverage >= 0.6), arg_max(buffer, (coverage, -buffer))) AS INTEGER) AS buffer, max(coverage) >= 0.6 AS met FROM r GROUP BY 1""")
def ladder_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first buffer of the ladder whose coverage is enough, else that of the most coverage; all steps in one aggregate."""
    steps = [0, 1, 2, 5, 10, 20]
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("city"))
    shares = _links(spark, sf_dir).join(region, "u").groupBy("city").agg(*((F.count_if(F.col("w") <= 100 + b * 40) / F.count(F.lit(1))).alias(f"c{b}") for b in steps))
    tried = F.array(*(F.struct(F.col(f"c{b}").alias("coverage"), F.lit(-b).alias("less"), F.lit(b).alias("buffer")) for b in steps))
    enough = F.filter(tried, lambda s: s["coverage"] >= 0.6)
    return shares.select("city", F.coalesce(F.get(enough, F.lit(0))["buffer"], F.array_max(tried)["buffer"]).alias("buffer"), (F.size(enough) > 0).alias("met"))


@query(f"""WITH {ROADS} SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS n_refs, min(length_m) AS length_m, string_agg(u || ':' || v || ':' || key, ',' ORDER BY u, v, key) AS refs FROM roads GROUP BY 1, 2""")
def physical_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges of both ways as one physical edge with its references; a pair of cities has at most ten."""
    rows = roads(spark, sf_dir).groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        F.count(F.lit(1)).alias("n_refs"), F.min("length_m").alias("length_m"), F.array_sort(F.collect_list(F.struct("u", "v", "key"))).alias("r"))
    return rows.select("a", "b", "n_refs", "length_m", F.array_join(F.transform("r", lambda r: F.concat_ws(":", r["u"], r["v"], r["key"])), ",").alias("refs"))
