"""Operators applied to the driver's tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeseam.functions import text as T
from codeseam.operators import cycles, diff, edits, graph, interval, metrics, search

Query = Callable[[SparkSession, str], DataFrame]
#: Members of a component are listed in one row up to so many.
LISTED = 1000
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- graphs of whole tables


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a line's supplier and that of the order's next line, where they differ."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"))
    return lines.filter(F.col("src") != F.col("dst"))


HOPS = (
    "h AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS dst FROM lineitem), "
    "e AS (SELECT src, dst FROM h WHERE src <> dst)"
)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the state they put their user in: user, kind of event and the tens of its value."""
    e = read(spark, sf_dir, "events")
    return e.withColumn("state", F.concat_ws(":", "user_id", "event_type", F.floor(F.col("value") / 10).cast("bigint")))


def moves_of(events: DataFrame) -> DataFrame:
    """(src, dst): each event's state and its user's next one, where they differ."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("state").alias("src"), F.lead("state").over(order).alias("dst")).filter(F.col("src") != F.col("dst"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves_of(states(spark, sf_dir))


def states_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(node): the states that events of a kind lead to."""
    return states(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("state").alias("node")).distinct()


MOVES = (
    "s AS (SELECT *, concat_ws(':', user_id, event_type, floor(value / 10)::BIGINT) AS state FROM events), "
    "l AS (SELECT state AS src, lead(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM s), e AS (SELECT src, dst FROM l WHERE src <> dst)"
)


def _of(kind: str) -> str:
    return f"(SELECT DISTINCT state AS node FROM s WHERE event_type = '{kind}')"


REACH = f"reach AS (SELECT node FROM {_of('signup')} UNION SELECT e.dst FROM reach JOIN e ON e.src = reach.node)"
BACK = f"back AS (SELECT node FROM {_of('purchase')} UNION SELECT e.src FROM back JOIN e ON e.dst = back.node)"


@query(f"WITH {HOPS} SELECT src, dst, count(*) AS weight FROM e GROUP BY ALL")
def graph_edges_weighted(spark, sf_dir):
    return graph.weighted(hops(spark, sf_dir))


@query(f"WITH RECURSIVE {MOVES}, {REACH} SELECT node FROM reach")
def graph_reach_from_roots(spark, sf_dir):
    return graph.reachable(moves(spark, sf_dir), states_of(spark, sf_dir, "signup")).select("node")


@query(f"WITH RECURSIVE {MOVES}, {REACH} SELECT DISTINCT state FROM s WHERE state NOT IN (SELECT node FROM reach)")
def graph_unreachable(spark, sf_dir):
    live = graph.reachable(moves(spark, sf_dir), states_of(spark, sf_dir, "signup")).select(F.col("node").alias("state"))
    return states(spark, sf_dir).select("state").distinct().join(live, "state", "left_anti")


@query(f"WITH RECURSIVE {MOVES}, {BACK} SELECT node FROM back WHERE node NOT IN (SELECT node FROM {_of('purchase')})")
def graph_transitive_callers(spark, sf_dir):
    targets = states_of(spark, sf_dir, "purchase")
    return graph.reaches(moves(spark, sf_dir), targets).select("node").join(targets, "node", "left_anti")


@query(
    f"WITH RECURSIVE {MOVES}, own AS (SELECT src AS node FROM e GROUP BY src HAVING count(DISTINCT dst) > 2), "
    "back AS (SELECT node FROM own UNION SELECT e.src FROM back JOIN e ON e.dst = back.node) "
    "SELECT node FROM back WHERE node NOT IN (SELECT node FROM own)"
)
def graph_symbol_callers(spark, sf_dir):
    e = moves(spark, sf_dir)
    own = e.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n")).filter("n > 2").select("node")
    return graph.reaches(e, own).select("node").join(own, "node", "left_anti")


@query(f"WITH RECURSIVE {MOVES}, {BACK} SELECT event_id, state FROM s WHERE event_type = 'signup' AND state IN (SELECT node FROM back)")
def graph_affected_roots(spark, sf_dir):
    callers = graph.reaches(moves(spark, sf_dir), states_of(spark, sf_dir, "purchase")).select(F.col("node").alias("state"))
    return states(spark, sf_dir).filter("event_type = 'signup'").select("event_id", "state").join(callers, "state", "left_semi")


@query(
    f"WITH RECURSIVE {MOVES}, d AS (SELECT DISTINCT src, dst FROM e), c AS (SELECT src AS a, dst AS b FROM d UNION SELECT c.a, d.dst FROM c JOIN d ON d.src = c.b), "
    "m AS (SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY 1) "
    "SELECT component, count(*) AS size, CASE WHEN count(*) <= 2 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN count(*) <= 1000 THEN string_agg(node, ',' ORDER BY node) END AS members "
    "FROM m GROUP BY component HAVING count(*) > 1"
)
def graph_scc(spark, sf_dir):
    found = graph.strong_components(moves(spark, sf_dir))
    size = F.count("*")
    sizes = found.groupBy("component").agg(size.alias("size"), F.when(size <= 2, "medium").otherwise("high").alias("severity"))
    return sizes.join(cycles.listed(found, "component", "node", "node", LISTED, "members"), "component", "left")


@query(
    f"WITH RECURSIVE {MOVES}, w AS (SELECT node, 0 AS depth FROM {_of('purchase')} UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 3) "
    "SELECT node, min(depth) AS depth FROM w GROUP BY node"
)
def graph_impact_depth3(spark, sf_dir):
    return graph.reaches(moves(spark, sf_dir), states_of(spark, sf_dir, "purchase"), max_depth=3).select("node", "depth")


@query(
    f"WITH {HOPS}, d AS (SELECT DISTINCT src, dst FROM e) SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM "
    "(SELECT src AS node, 0 AS i, 1 AS o FROM d UNION ALL SELECT dst, 1, 0 FROM d) GROUP BY node"
)
def graph_fanin_fanout(spark, sf_dir):
    return graph.degrees(hops(spark, sf_dir))


# ---------------------------------------------------------------- search, limits, sets


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*a.*e.') ORDER BY p_name, p_partkey LIMIT 50 OFFSET 5")
def symbol_glob_search(spark, sf_dir):
    found = read(spark, sf_dir, "part").filter(T.glob_match(F.col("p_name"), "*a*e?")).select("p_partkey", "p_name")
    return search.page(found, [F.col("p_name"), F.col("p_partkey")], 5, 50)


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, 'CUSTOMER.*1.', 'i')")
def glob_ci(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(F.col("c_name").rlike(T.loose_glob_regex("CUSTOMER*1?"))).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
def glob_prefix(spark, sf_dir):
    return read(spark, sf_dir, "part").filter(T.glob_match(F.col("p_type"), "S*")).select("p_partkey", "p_type")


TOP = (
    "SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, "
    "count(*) OVER (PARTITION BY c_mktsegment) AS total FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 10"
)


@query(TOP)
def topk_with_total(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderkey", "o_totalprice")
    return search.top_per_group(o, ["c_mktsegment"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("SELECT *, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS total FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def limit_with_exact_total(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return search.top_with_total(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


LABELS = (("buy", "purchase"), ("buy2", "add_to_cart"), ("look", "view"), ("look2", "click"), ("in", "login"), ("in2", "signup"), ("srch", "search"))


@query(
    "WITH lab(label, event_type) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LABELS) + ") "
    "SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY ts, event_id)::INT AS rank FROM events JOIN lab USING (event_type) QUALIFY rank <= 7"
)
def limit_per_label(spark, sf_dir):
    table = spark.createDataFrame(LABELS, "label string, event_type string")  # a fixed table of a few rows
    found = read(spark, sf_dir, "events").join(F.broadcast(table), "event_type").select("label", "event_id", "ts")
    return search.top_per_group(found, ["label"], [F.col("ts"), F.col("event_id")], 7, total=None).drop("ts")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_per_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return search.first_per_key(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join_marked(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_join_unused(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersection(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query(
    "SELECT 'used' AS part, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL "
    "SELECT 'unused', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"
)
def used_unused_split(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("u", F.lit(1))
    parts = read(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").groupBy(F.col("u").isNotNull().alias("is_used")).count()
    kinds = spark.createDataFrame([(True, "used"), (False, "unused")], "is_used boolean, part string")
    return kinds.join(parts, "is_used", "left").select("part", F.coalesce("count", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- intervals, prefixes, snapshots


@query(
    "WITH p AS (SELECT event_id, user_id, epoch_ms(ts) // 1000 AS pos FROM events), "
    "i AS (SELECT user_id, event_id AS holder, pos AS s, pos + 3600 * (1 + event_id % 5) AS e FROM p) "
    "SELECT p.event_id, i.holder FROM p JOIN i ON p.user_id = i.user_id AND i.s <= p.pos AND p.pos < i.e "
    "QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY i.e - i.s, i.s DESC, i.holder) = 1"
)
def interval_containment(spark, sf_dir):
    p = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    i = p.select("user_id", F.col("event_id").alias("holder"), F.col("at").alias("s"), (F.col("at") + 3600 * (1 + F.col("event_id") % 5)).alias("e"))
    return interval.innermost(p, i, "user_id", "at", "s", "e", 6 * 3600, ["event_id"], ["holder"])


@query(
    "WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), "
    "r AS (SELECT page_id, host, array_to_string(list_reverse(string_split(host, '.')), '.') AS name FROM h), "
    "k(known) AS (VALUES ('com'), ('com.example'), ('net.example'), ('org.example.thering'), ('org')) "
    "SELECT page_id, name, (SELECT max_by(known, length(known)) FROM k WHERE r.name = known OR starts_with(r.name, known || '.')) AS match FROM r"
)
def longest_prefix(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(host, "[.]", -1)), ".").alias("name"))
    known = spark.createDataFrame([(x,) for x in ("com", "com.example", "net.example", "org.example.thering", "org")], "known string")
    return interval.longest_prefix(pages, "name", known, "known")


@query(
    "WITH a AS (SELECT s_suppkey AS k, md5(s_nationkey::VARCHAR) AS h FROM supplier), b AS (SELECT c_custkey AS k, md5(c_nationkey::VARCHAR) AS h FROM customer), "
    "d AS (SELECT 'forth' AS way, a.k AS was, b.k AS now, a.h IS DISTINCT FROM b.h AS differs FROM a FULL JOIN b ON a.k = b.k "
    "UNION ALL SELECT 'back', b.k, a.k, a.h IS DISTINCT FROM b.h FROM a FULL JOIN b ON a.k = b.k) "
    "SELECT way, coalesce(was, now) AS k, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'edited' END AS change FROM d WHERE differs"
)
def snapshot_diff(spark, sf_dir):
    """Suppliers and customers as two snapshots of one key, each way."""
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.md5(F.col("s_nationkey").cast("string")).alias("h"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.md5(F.col("c_nationkey").cast("string")).alias("h"))
    ways = [diff.snapshot_diff(x, y, "k", "h").select(F.lit(way).alias("way"), "k", "change") for way, x, y in (("forth", a, b), ("back", b, a))]
    return ways[0].union(ways[1])


# ---------------------------------------------------------------- rules and metrics


@query(
    "SELECT kind, name FROM (SELECT 'class' AS kind, p_name AS name FROM part UNION ALL SELECT 'method', c_name FROM customer UNION ALL SELECT 'constant', p_brand FROM part) t "
    "WHERE NOT regexp_matches(name, CASE kind WHEN 'class' THEN '^[A-Z][a-zA-Z0-9]*$' WHEN 'method' THEN '^[a-z][a-zA-Z0-9]*$' ELSE '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$' END)"
)
def naming_rules(spark, sf_dir):
    parts, customers = read(spark, sf_dir, "part"), read(spark, sf_dir, "customer")
    names = parts.select(F.lit("class").alias("kind"), F.col("p_name").alias("name"))
    names = names.union(customers.select(F.lit("method"), "c_name")).union(parts.select(F.lit("constant"), "p_brand"))
    fits = F.when(F.col("kind") == "class", F.col("name").rlike(T.PASCAL)).when(F.col("kind") == "method", F.col("name").rlike(T.CAMEL)).otherwise(F.col("name").rlike(T.UPPER_SNAKE))
    return names.filter(~fits)


@query(
    "WITH o AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1) SELECT * FROM (SELECT l_orderkey, "
    "concat_ws('; ', CASE WHEN lines > 5 THEN 'lines > 5' END, CASE WHEN quantity > 200 THEN 'quantity > 200' END) AS messages FROM o) WHERE messages <> ''"
)
def threshold_or(spark, sf_dir):
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    return metrics.violations(o, [(F.col("lines"), 5, "lines > 5"), (F.col("quantity"), 200, "quantity > 200")]).select("l_orderkey", "messages")


@query(
    "SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity > 40) AS high, count(*) FILTER (l_quantity > 20 AND l_quantity <= 40) AS medium, "
    "count(*) FILTER (l_quantity <= 20) AS low FROM lineitem GROUP BY ALL"
)
def conditional_counts(spark, sf_dir):
    q = F.col("l_quantity")
    return metrics.conditional_counts(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], high=q > 40, medium=(q > 20) & (q <= 40), low=q <= 20)


@query("SELECT event_type, count(*) AS found, least(count(*), 1500) AS shown FROM events GROUP BY 1")
def usage_summary_capped(spark, sf_dir):
    return search.capped_counts(read(spark, sf_dir, "events"), "event_type", 1500)


@query(
    "WITH c AS (SELECT l_orderkey, 1 + count(*) FILTER (l_quantity > 25) + count(*) FILTER (l_discount > 0.05) AS cc FROM lineitem GROUP BY 1) "
    "SELECT CASE WHEN cc <= 5 THEN 'low' WHEN cc <= 10 THEN 'medium' ELSE 'high' END AS risk, count(*) AS n, sum(cc)::BIGINT AS total, max(cc) AS most, round(avg(cc), 2) AS average FROM c GROUP BY 1"
)
def risk_buckets(spark, sf_dir):
    cc = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((1 + F.count_if(F.col("l_quantity") > 25) + F.count_if(F.col("l_discount") > 0.05)).alias("cc"))
    return cc.groupBy(metrics.bucket(F.col("cc"), metrics.RISK, "high").alias("risk")).agg(
        F.count("*").alias("n"), F.sum("cc").alias("total"), F.max("cc").alias("most"), F.round(F.avg("cc"), 2).alias("average")
    )


@query(
    "SELECT doc_id, CASE WHEN text = '' THEN 1 WHEN rtrim(text, chr(10)) = '' THEN 0 ELSE len(string_split(rtrim(text, chr(10)), chr(10))) END AS physical, "
    "CASE WHEN text = '' THEN 1 WHEN rtrim(text, chr(10)) = '' THEN 0 ELSE len(list_filter(string_split(rtrim(text, chr(10)), chr(10)), lambda x: trim(x) = '')) END AS blank FROM documents"
)
def loc_metrics(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.physical_lines(F.col("text")).alias("physical"), T.blank_lines(F.col("text")).alias("blank"))


@query(
    "WITH p AS (SELECT doc_id, text, length(text) // 2 AS pos FROM documents), b AS (SELECT doc_id, pos, left(text, pos) AS t FROM p) "
    "SELECT doc_id, pos, length(t) - length(replace(t, chr(10), '')) AS line, length(t) - coalesce(length(t) - strpos(reverse(t), chr(10)) + 1, 0) * (strpos(t, chr(10)) > 0)::INT AS col FROM b"
)
def line_offsets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).alias("pos"))
    at = F.col("pos").cast("int")
    return d.select("doc_id", "pos", T.line_of(F.col("text"), at).alias("line"), T.column_of(F.col("text"), at).alias("col"))


@query(
    "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, "
    "len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n FROM pages"
)
def tag_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select(
        "page_id", F.array_join(links, " ").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("bigint").alias("n")
    )


@query(
    "WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1) AS a, regexp_extract(url, '^https?://[^/]*/[^/?#]*(/[^?#]*)', 1) AS b FROM pages), "
    "n AS (SELECT page_id, regexp_replace(regexp_replace(trim(a), '/+', '/', 'g'), '^/|/$', '', 'g') AS a, regexp_replace(regexp_replace(trim(b), '/+', '/', 'g'), '^/|/$', '', 'g') AS b FROM u), "
    "p AS (SELECT page_id, CASE WHEN a = '' THEN '' ELSE '/' || a END || CASE WHEN b = '' THEN '' ELSE '/' || b END AS path FROM n) "
    "SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM p"
)
def route_table(spark, sf_dir):
    prefix = F.regexp_extract("url", "^https?://[^/]*/([^/?#]*)", 1)
    path = F.regexp_extract("url", "^https?://[^/]*/[^/?#]*(/[^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", T.join_path(prefix, path).alias("path"))


@query(
    "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS segments "
    "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"
)
def entity_model(spark, sf_dir):
    # orders are counted by customer before they meet the customers, so the wide join carries one row a customer
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    c = read(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    n = read(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.groupBy("n_name").agg(
        F.count("c_custkey").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments")
    )


@query(
    "SELECT r_name AS name, 0 AS depth, r_name AS path FROM region UNION ALL SELECT n_name, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL "
    "SELECT s_name, 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def hierarchy_list(spark, sf_dir):
    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    top = r.select(F.col("r_name").alias("name"), F.lit(0).alias("depth"), F.col("r_name").alias("path"))
    mid = rn.select("n_name", F.lit(1), F.concat_ws("/", "r_name", "n_name"))
    low = s.join(rn, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", F.lit(2), F.concat_ws("/", "r_name", "n_name", "s_name"))
    return top.union(mid).union(low)


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CASE WHEN l_quantity > 25 THEN 10 ELSE 5 END AS b FROM lineitem), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b) AS k FROM s), "
    "m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM n), "
    "g AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS i FROM m) "
    "SELECT l_orderkey, min(a) AS island_start, max(b) AS island_end, count(*) AS pieces FROM g GROUP BY l_orderkey, i"
)
def gaps_islands_merge(spark, sf_dir):
    spans = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 10).alias("a"), (F.col("l_linenumber") * 10 + F.when(F.col("l_quantity") > 25, 10).otherwise(5)).alias("b")
    )
    return edits.merge_adjacent(spans, ["l_orderkey"], "a", "b")


@query("SELECT conv_id, turn, coalesce(length(text), 0) AS col, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(length(text), 0) DESC)::INT AS position FROM conversations")
def edits_order(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("col"))
    return edits.bottom_up(c, "conv_id", "turn", "col")


@query(
    "SELECT conv_id::VARCHAR AS id, NULL AS parent, 0 AS depth, count(*) AS children FROM conversations GROUP BY conv_id UNION ALL "
    "SELECT conv_id || '.' || turn, conv_id::VARCHAR, 1, 0 FROM conversations"
)
def tree_outline(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    top = c.groupBy("conv_id").agg(F.count("*").alias("children"))
    tops = top.select(F.col("conv_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "children")
    return tops.union(c.select(F.concat_ws(".", "conv_id", "turn"), F.col("conv_id").cast("string"), F.lit(1), F.lit(0)))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS payload, coalesce(array_to_string(list_sort(json_keys(props)), ','), '') AS keys FROM events")
def json_canonical(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("payload"), F.coalesce(F.array_join(F.array_sort(F.json_object_keys("props")), ","), F.lit("")).alias("keys"))


@query(
    f"WITH {MOVES}, d AS (SELECT DISTINCT src, dst FROM e), one AS (SELECT src AS seed, dst AS node, src || '>' || dst AS steps, 1 AS depth FROM d), "
    "two AS (SELECT seed, d.dst AS node, steps || '>' || d.dst AS steps, 2 AS depth FROM one JOIN d ON d.src = one.node WHERE d.dst <> seed) SELECT * FROM one UNION ALL SELECT * FROM two"
)
def flow_bounded(spark, sf_dir):
    from codeseam.operators.flow import bounded_paths

    e = moves(spark, sf_dir)
    return bounded_paths(e, e.select(F.col("src").alias("node")).distinct(), 2).select("seed", "node", F.array_join("steps", ">").alias("steps"), "depth")
