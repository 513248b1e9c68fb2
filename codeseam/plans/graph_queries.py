"""Maintained graphs, cycle paths, hierarchy labels, scopes, indexed search, edits, payloads and streamed changes over the
driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeseam.operators import cycles, edits, graph, incremental, labels, payload, scopes
from codeseam.operators.budget import Grouped
from codeseam.operators.postings import GlobIndex
from codeseam.operators.running import running
from codeseam.operators.shared import bucketed, settled, shared_path
from codeseam.plans.table_queries import MOVES, Query, moves_of, read, states
from codeseam.streaming.epochs import Epochs

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- reachability kept up to date

#: A fiftieth of the time that the events span: what comes with a batch, or leaves with it.
SPAN = "SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events"


def _changed(spark: SparkSession, sf_dir: str, old, new) -> DataFrame:
    """Reach of the states of ``old`` events from their signups, brought to what ``new`` has: (node).

    ``old`` and ``new`` tell from a time (``at``, in microseconds), the first and the last one which events count; both hold
    a stretch of every user's events, so one window gives the moves of both.
    """
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    at = lambda ts: F.unix_micros(ts.cast("timestamp"))
    row = events.agg(F.coalesce(at(F.min("ts")), F.lit(0)).alias("a"), F.coalesce(at(F.max("ts")), F.lit(0)).alias("b")).first()
    within = lambda which, *ts: F.coalesce(reduce(Column.__and__, [which(at(t), row["a"], row["b"]) for t in ts]), F.lit(False))
    state = lambda kind, tens: F.concat_ws(":", "user_id", kind, tens)
    told = lambda rows, keys: rows.groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new")).filter("old or new")
    tens, ts = F.floor(F.col("value") / 10).cast("bigint"), F.col("ts")

    signups = events.filter("event_type = 'signup'").select(state("event_type", tens).alias("node"), within(old, ts).alias("old"), within(new, ts).alias("new"))
    roots = settled(told(signups, ["node"]))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = events.select("user_id", "event_type", tens.alias("tens"), "ts", F.lead(F.struct("event_type", tens.alias("tens"), "ts")).over(order).alias("next")).filter("next is not null")
    moves = following.select(
        state("event_type", "tens").alias("src"), state("next.event_type", "next.tens").alias("dst"),
        within(old, ts, F.col("next.ts")).alias("old"), within(new, ts, F.col("next.ts")).alias("new"),
    ).filter("src <> dst")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = bucketed(spark, told(moves.repartition(n, "src"), ["src", "dst"]), "src", "moves")
    reach = incremental.build(edges.filter("old"), roots.filter("old"))
    differ = [t.filter(which).select(*keys) for t, keys in ((edges, ["src", "dst"]), (roots, ["node"])) for which in ("new and not old", "old and not new")]
    return incremental.maintain(reach, *differ, exact=True).nodes


_REACH = "reach AS (SELECT DISTINCT state AS node FROM s WHERE event_type = 'signup' UNION SELECT e.dst FROM reach JOIN e ON e.src = reach.node) SELECT node FROM reach"


@query(f"WITH RECURSIVE {MOVES}, {_REACH}")
def graph_reach_inserted(spark, sf_dir):
    """Reach of the earlier events, maintained under the insertions of the last fiftieth of the time."""
    return _changed(spark, sf_dir, lambda at, a, b: at < b - (b - a) // 50, lambda at, a, b: F.lit(True))


@query(f"WITH RECURSIVE {MOVES.replace('FROM events)', f'FROM events, ({SPAN}) t WHERE epoch_us(ts) >= t.a + (t.b - t.a) // 50)', 1)}, {_REACH}")
def graph_reach_retained(spark, sf_dir):
    """Reach of all events, maintained under the loss of the first fiftieth of the time."""
    return _changed(spark, sf_dir, lambda at, a, b: F.lit(True), lambda at, a, b: at >= a + (b - a) // 50)


# ---------------------------------------------------------------- cycles as paths


@query(
    f"WITH RECURSIVE {MOVES}, d AS (SELECT DISTINCT src, dst FROM e), c AS (SELECT src AS a, dst AS b FROM d UNION SELECT c.a, d.dst FROM c JOIN d ON d.src = c.b), "
    "m AS (SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY 1), "
    "i AS (SELECT x.component, src, dst FROM d JOIN m x ON src = x.node JOIN m y ON dst = y.node AND x.component = y.component), "
    "b AS (SELECT DISTINCT component, component AS node, 0 AS depth FROM m UNION SELECT i.component, i.dst, b.depth + 1 FROM b JOIN i ON i.component = b.component AND i.src = b.node "
    "WHERE i.dst <> i.component AND b.depth < (SELECT count(*) FROM m WHERE m.component = b.component)), "
    "f AS (SELECT component, node, min(depth) AS depth FROM b GROUP BY ALL), "
    "p AS (SELECT f.node, min(g.node) AS parent FROM f JOIN i ON i.dst = f.node JOIN f g ON g.node = i.src AND g.depth = f.depth - 1 GROUP BY f.node), "
    "z AS (SELECT f.component, f.node, f.depth FROM f JOIN i ON i.src = f.node AND i.dst = f.component WHERE f.depth > 0 QUALIFY row_number() OVER (PARTITION BY f.component ORDER BY f.depth, f.node) = 1), "
    "w AS (SELECT component, depth + 1 AS length, depth AS position, node FROM z UNION ALL SELECT w.component, w.length, w.position - 1, p.parent FROM w JOIN p ON p.node = w.node WHERE w.position > 0) "
    "SELECT component, length, position, node FROM w"
)
def graph_cycle_paths(spark, sf_dir):
    e = settled(moves_of(states(spark, sf_dir)).distinct())
    return cycles.shortest_cycles(e, graph.strong_components(e))


# ---------------------------------------------------------------- hierarchy labels

FOREST = (
    "n AS (SELECT 'c' || c_custkey AS node, NULL AS parent, 0::BIGINT AS v FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 0 FROM orders UNION ALL "
    "SELECT concat_ws('.', 'l' || l_orderkey, l_linenumber, l_partkey, l_suppkey), 'o' || l_orderkey, sum(l_quantity::BIGINT)::BIGINT FROM lineitem GROUP BY ALL), "
    "u AS (SELECT n.node, n.v, k.node AS parent FROM n LEFT JOIN (SELECT node FROM n) k ON k.node = n.parent), "
    "a AS (SELECT node, node AS up, 0 AS distance FROM u UNION ALL SELECT a.node, u.parent, a.distance + 1 FROM a JOIN u ON u.node = a.up WHERE u.parent IS NOT NULL)"
)


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, v): customers, their orders and those's lines, with the lines' quantities; rows of one line have its node."""
    named = lambda letter, c: F.concat(F.lit(letter), c)
    zero = F.lit(0).cast("bigint").alias("v")
    customers = read(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("node"), F.lit(None).cast("string").alias("parent"), zero)
    orders = read(spark, sf_dir, "orders").select(named("o", "o_orderkey"), named("c", "o_custkey"), zero)
    line = F.concat_ws(".", named("l", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    lines = read(spark, sf_dir, "lineitem").select(line, named("o", "l_orderkey"), F.col("l_quantity").cast("bigint"))
    return customers.union(orders).union(lines)


@query(
    f"WITH RECURSIVE {FOREST}, t AS (SELECT up, count(*) AS size, sum(u.v)::BIGINT AS total FROM a JOIN u USING (node) GROUP BY up), "
    "r AS (SELECT node, max(distance) AS depth, max_by(up, distance) AS root FROM a GROUP BY node) SELECT r.node, root, depth::INT AS depth, size, total FROM r JOIN t ON t.up = r.node"
)
def hierarchy_labels(spark, sf_dir):
    """Root, depth, subtree size and subtree quantity of every node, from interval labels."""
    return labels.interval_labels(forest(spark, sf_dir), "v").select("node", "root", "depth", "size", "total")


@query(f"WITH RECURSIVE {FOREST} SELECT node, up AS ancestor, distance::INT AS distance FROM a WHERE distance > 0 AND node LIKE 'l%'")
def hierarchy_ancestors(spark, sf_dir):
    made = labels.interval_labels(forest(spark, sf_dir))
    return labels.ancestors(made, F.startswith("node", F.lit("l")))


@query(f"WITH RECURSIVE {FOREST} SELECT up AS ancestor, node, distance::INT AS distance FROM a WHERE distance > 0 AND up LIKE 'c%'")
def hierarchy_descendants(spark, sf_dir):
    made = labels.interval_labels(forest(spark, sf_dir))
    return labels.descendants(made, F.startswith("node", F.lit("c")))


# ---------------------------------------------------------------- scopes


def _scoped_sql(key: str, more: str = "") -> str:
    by = f"PARTITION BY {key}" if key else ""
    at_depth = f"PARTITION BY {key}, depth" if key else "PARTITION BY depth"
    return (
        f"WITH t AS (SELECT *, row_number() OVER ({by} ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS step FROM events), "
        f"x AS (SELECT *, sum(step) OVER ({by} ORDER BY k ROWS UNBOUNDED PRECEDING) AS total FROM t), y AS (SELECT *, min(total) OVER ({by} ORDER BY k ROWS UNBOUNDED PRECEDING) AS low FROM x), "
        f"z AS (SELECT *, (total - least(0, low))::BIGINT AS depth FROM y), "
        f"v AS (SELECT *, CASE WHEN depth > 0 THEN last_value(CASE WHEN step = 1 THEN event_id END IGNORE NULLS) OVER ({at_depth} ORDER BY k ROWS UNBOUNDED PRECEDING) END AS scope FROM z){more} "
    )


def _scoped(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    return scopes.bound(e, keys, ["ts", "event_id"], kind == "signup", kind == "purchase", "event_id").select("event_id", "depth", "scope")


@query(_scoped_sql("user_id") + "SELECT event_id, depth, scope FROM v")
def scope_binding(spark, sf_dir):
    """Each event's innermost open signup of its user, which purchases close."""
    return _scoped(spark, sf_dir, ["user_id"])


@query(_scoped_sql("") + "SELECT event_id, depth, scope FROM v")
def scope_binding_one_key(spark, sf_dir):
    """The same with all events under one key, which is spread over ranges."""
    return _scoped(spark, sf_dir, [])


@query(
    "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events"
)
def asof_last_view(spark, sf_dir):
    """Each event with its user's last view before it."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.filter("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view_id"))
    return scopes.asof(e, views, ["user_id"], ["ts", "event_id"], ["view_id"], strict=True).select("event_id", "view_id")


@query(
    _scoped_sql("user_id", ", q AS (SELECT *, floor(value / 10)::BIGINT AS name FROM v)")
    + "SELECT u.event_id, (SELECT max_by(d.event_id, d.k) FROM q d WHERE d.user_id = u.user_id AND d.name = u.name AND d.event_type = 'view' AND d.k < u.k "
    "AND NOT EXISTS (SELECT 1 FROM q c WHERE c.user_id = d.user_id AND c.k > d.k AND c.k < u.k AND c.depth < d.depth)) AS declared FROM q u WHERE u.event_type NOT IN ('signup', 'purchase', 'view')"
)
def scope_names(spark, sf_dir):
    """Signups open a block and purchases close it, views declare the tens of their value, other events use theirs."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "view", "declare").otherwise("use")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"), F.floor(F.col("value") / 10).cast("bigint").alias("name"))
    return scopes.resolved(e, ["user_id"], ["ts", "event_id"], "name", "kind", "event_id", "declared").select("event_id", "declared")


# ---------------------------------------------------------------- search through an index

#: (glob, whether case counts)
GLOBS = (("*ea*on", True), ("Customer#0000001?", True), ("*CUSTOMER*9?", False), ("ba*", True), ("?o", True), ("*zz*", True), ("the", False), ("*", True))


def _glob_regex(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else c for c in glob).replace("#", "[#]")


@query(
    "WITH w AS (SELECT DISTINCT 'part' AS source, p_name AS name FROM part UNION ALL SELECT DISTINCT 'customer', c_name FROM customer UNION ALL "
    "SELECT DISTINCT 'word', unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM documents) "
    + " UNION ALL ".join(
        f"SELECT '{g}' AS glob, source, count(*) AS n, min(name) AS first, max(name) AS last FROM w WHERE regexp_full_match(name, '{_glob_regex(g)}', '{'s' if case else 'si'}') GROUP BY source"
        for g, case in GLOBS
    )
)
def glob_index_search(spark, sf_dir):
    """Globs over the distinct part and customer names and words of documents, each through the rarest of its grams."""
    index = GlobIndex(spark, shared_path(spark, "globs"))
    index.refresh("part", read(spark, sf_dir, "part"), "p_name")
    index.refresh("customer", read(spark, sf_dir, "customer"), "c_name")
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    index.refresh("word", read(spark, sf_dir, "documents").select(words.alias("name")))
    found = [index.search(g, ignore_case=not case).select(F.lit(g).alias("glob"), "source", "name") for g, case in GLOBS]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.groupBy("glob", "source").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


# ---------------------------------------------------------------- edits, differences, payloads


@query("SELECT doc_id, sha256(CASE WHEN length(text) < 2 THEN coalesce(text, '') ELSE '<<' || replace(substr(text, 3), chr(10), ' | ') || '>>' END) AS digest, length(text) AS size FROM documents")
def edits_applied(spark, sf_dir):
    """Every document with its first two letters and later line ends replaced and a mark put at its end."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    lines = docs.filter("length(text) >= 2").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("k").over(Window.partitionBy("doc_id"))
    ends = lines.select("doc_id", (upto - 1).cast("int").alias("start"), (F.col("k") == last).alias("last"))
    breaks = ends.filter("not last and start >= 2").select("doc_id", "start", (F.col("start") + 1).alias("end"), F.lit(" | ").alias("new_text"))
    marks = ends.filter("last").select("doc_id", "start", F.col("start").alias("end"), F.lit(">>").alias("new_text"))
    heads = ends.filter("last").select("doc_id", F.lit(0), F.lit(2), F.lit("<<"))
    made = edits.applied(docs, breaks.union(marks).union(heads), "doc_id", "text")
    return made.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.length("before").cast("bigint").alias("size"))


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS b FROM lineitem), "
    "r AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) "
    "SELECT l_orderkey, a, b, reach FROM r WHERE a < reach"
)
def edits_crossing(spark, sf_dir):
    """Spans of an order's lines that begin inside an earlier one."""
    a = F.col("l_linenumber") * 10
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", a.cast("int").alias("a"), (a + F.col("l_quantity").cast("int")).cast("int").alias("b"))
    return edits.crossings(spans, ["l_orderkey"], "a", "b")


_STEP = "list_reduce([0, " + ", ".join(str(1 << k) for k in range(20, -1, -1)) + "], lambda n, p: CASE WHEN n + p <= least(length({a}), length({b})) AND left({a}, n + p) = left({b}, n + p) THEN n + p ELSE n END)"


@query(
    "WITH p AS (SELECT doc_id, text AS a, lead(doc_id) OVER w AS other, lead(text) OVER w AS b FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)), "
    f"h AS (SELECT *, {_STEP.format(a='a', b='b')} AS head FROM p WHERE a <> b), t AS (SELECT doc_id, other, head, substr(a, head + 1) AS x, substr(b, head + 1) AS y FROM h), "
    f"r AS (SELECT *, reverse(x) AS rx, reverse(y) AS ry FROM t), z AS (SELECT *, {_STEP.format(a='rx', b='ry')} AS tail FROM r) "
    "SELECT doc_id, other, head::INT AS start, (length(x) - tail)::INT AS length, md5(left(y, length(y) - tail)) AS new_digest FROM z"
)
def text_replacements(spark, sf_dir):
    """What turns each document into its source's next one, as one replacement; neighbours are found by their ids alone, over ranges."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    ids = running(docs.select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], {"before": ("doc_id", "lag")})
    pairs = ids.filter("before is not null").select(F.col("before").alias("doc_id"), F.col("doc_id").alias("other"))
    pairs = pairs.join(docs.select("doc_id", "text"), "doc_id").join(docs.select(F.col("doc_id").alias("other"), F.col("text").alias("next")), "other")
    found = pairs.select("doc_id", "other", edits.replacement(F.col("text"), F.col("next")).alias("r")).filter("r is not null")
    return found.select("doc_id", "other", "r.start", "r.length", F.md5("r.new_text").alias("new_digest"))


@query(
    "WITH e AS (SELECT event_id, sha256('s' || event_type) AS kind, sha256('n' || user_id) AS who, sha256('{' || coalesce((SELECT string_agg(sha256(key) || ':' || sha256('n' || value), ',' ORDER BY sha256(key)) "
    "FROM json_each(props::JSON)), '')) AS props FROM events), l AS (SELECT *, sha256('[' || least(kind, who) || ',' || greatest(kind, who)) AS tags FROM e), "
    "k AS (SELECT event_id, unnest([sha256('type') || ':' || kind, sha256('props') || ':' || props, sha256('tags') || ':' || tags]) AS part FROM l) "
    "SELECT event_id, sha256('{' || string_agg(part, ',' ORDER BY part)) AS digest FROM k GROUP BY event_id"
)
def payload_digests(spark, sf_dir):
    """Each event as a payload, its fields and tags in an order that changes from row to row, with a time and a null beside them."""
    e = read(spark, sf_dir, "events")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    tags = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", text(F.col("event_type")), F.col("user_id"))).otherwise(F.concat_ws(", ", F.col("user_id"), text(F.col("event_type"))))
    fields = [F.concat(F.lit('"type": '), text(F.col("event_type"))), F.concat(F.lit('"props":'), "props"), F.concat(F.lit('"tags": ['), tags, F.lit("]")), F.concat(F.lit('"startedAt": '), text(F.col("ts").cast("string"))), F.lit('"note": null')]
    forth, back = F.concat_ws(",", *fields), F.concat_ws(" , ", *fields[::-1])
    json = F.concat(F.lit("{"), F.when(F.col("event_id") % 3 == 0, forth).otherwise(back), F.lit("}"))
    return payload.canonical_digests(e.select("event_id", json.alias("json")), "json").select("event_id", "digest")


# ---------------------------------------------------------------- a budget of file groups

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    f"SELECT 'latest' AS list, strftime(l_shipdate, '%Y-%m-%d') AS day, {_LINE} FROM (SELECT l_shipdate, {_LINE} FROM lineitem ORDER BY l_shipdate DESC, {_LINE} LIMIT 500) UNION ALL "
    f"SELECT 'first returned', strftime(l_shipdate, '%Y-%m-%d'), {_LINE} FROM (SELECT l_shipdate, {_LINE} FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate, {_LINE} LIMIT 500)"
)
def budget_first_rows(spark, sf_dir):
    """The last 500 lines shipped and the first 500 returned, from the few groups of files that can hold them."""
    lines = read(spark, sf_dir, "lineitem")
    ties = _LINE.split(", ")
    grouped = Grouped(spark, shared_path(spark, "groups"), "l_shipdate").write(lines, 32)
    picks = (("latest", True, None), ("first returned", False, "l_returnflag = 'R'"))
    out = None
    for name, last, where in picks:
        found = grouped.first(500, last, ties, where).rows.select(F.lit(name).alias("list"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), *ties)
        out = found if out is None else out.union(found)
    return out


# ---------------------------------------------------------------- changes of a table as a stream


@query(
    "WITH d AS (SELECT doc_id, text, coalesce(length(text), 0) AS n FROM documents), "
    "s AS (SELECT 0 AS e, doc_id, text FROM d UNION ALL SELECT 1, doc_id, CASE WHEN n % 3 = 0 THEN text || '.' ELSE text END FROM d WHERE n % 5 <> 0 UNION ALL SELECT 2, doc_id, text FROM d WHERE n % 4 <> 1), "
    "c AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.e, a.e + 1) AS epoch, CASE WHEN b.e IS NULL THEN 'deleted' WHEN a.e IS NULL THEN 'added' WHEN a.text IS DISTINCT FROM b.text THEN 'edited' END AS change "
    "FROM s a FULL JOIN s b ON a.doc_id = b.doc_id AND b.e = a.e + 1) SELECT doc_id, epoch::BIGINT AS epoch, change FROM c WHERE change IS NOT NULL AND epoch < 3"
)
def stream_changes(spark, sf_dir):
    """Three snapshots of the documents, told as a stream of changes: two before the stream stops, one after it goes on."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    later = docs.filter(n % 5 != 0).select("doc_id", F.when(n % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    last = docs.filter(n % 4 != 1)
    folder = shared_path(spark, "epochs")
    epochs = Epochs(spark, f"{folder}/snapshots", docs.select("doc_id").schema)
    for at, snapshots in enumerate(([docs, later], [last])):
        for k, snapshot in enumerate(snapshots):
            epochs.publish(snapshot, 2 * at + k)
        epochs.follow(f"{folder}/changes", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/changes")
    return found.select("key.doc_id", "epoch", "change")
