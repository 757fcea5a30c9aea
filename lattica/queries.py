"""The reference's operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import row_formula
from lattica.operators import aggregate as ag
from lattica.operators import cells as ce
from lattica.operators import edits, formats, layout, lookup, markdown, quality, rows, specs, text, trees, windows
from lattica.operators.criteria import criteria, criterion
from lattica.registry import Tables, query, rounded

# ---------------------------------------------------------------- conditional aggregates, pivots


@query("""
WITH x AS (SELECT l_returnflag, year(l_shipdate) AS y, l_extendedprice AS p FROM lineitem WHERE l_quantity >= 10)
SELECT l_returnflag,
  round(coalesce(sum(p) FILTER (WHERE y = 1997), 0), 2) + 0.0 AS "1997", round(coalesce(sum(p) FILTER (WHERE y = 1998), 0), 2) + 0.0 AS "1998",
  round(coalesce(sum(p) FILTER (WHERE y = 1999), 0), 2) + 0.0 AS "1999", round(coalesce(sum(p) FILTER (WHERE y = 2000), 0), 2) + 0.0 AS "2000",
  round(sum(p), 2) + 0.0 AS total, CAST(grouping(l_returnflag) AS INTEGER) AS _total
FROM x GROUP BY ROLLUP (l_returnflag)
""")
def pivot_revenue(t: Tables):
    """The flagship: a criterion, a pivot and its grand totals, in one scan and one shuffle of partial sums."""
    kept = t.lineitem.where(criterion(t.lineitem, "l_quantity", ">=10")).withColumn("y", F.year("l_shipdate"))
    return rounded(ag.pivot(kept, ["l_returnflag"], "y", "l_extendedprice", values=[1997, 1998, 1999, 2000]), 2)


@query("""
SELECT l_returnflag, round(sum(l_extendedprice) FILTER (WHERE l_quantity >= 10 AND l_discount < 0.05), 2) AS sumifs,
  count(*) FILTER (WHERE l_quantity >= 10 AND l_discount < 0.05) AS countifs,
  round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 2) AS averageifs,
  max(l_tax) FILTER (WHERE l_quantity <> 50) AS maxifs, min(l_extendedprice) FILTER (WHERE l_quantity > 40) AS minifs
FROM lineitem GROUP BY l_returnflag
""")
def sumifs_family(t: Tables):
    li = t.lineitem
    two = {"l_quantity": ">=10", "l_discount": "<0.05"}
    return li.groupBy("l_returnflag").agg(
        F.round(ag.sumifs(li, "l_extendedprice", two), 2).alias("sumifs"),
        ag.countifs(li, two).alias("countifs"),
        F.round(ag.averageifs(li, "l_extendedprice", {"l_linestatus": "o"}), 2).alias("averageifs"),
        ag.maxifs(li, "l_tax", {"l_quantity": "<>50"}).alias("maxifs"),
        ag.minifs(li, "l_extendedprice", {"l_quantity": ">40"}).alias("minifs"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%r_n%' AND upper(p_type) <> 'PROMO' AND p_size BETWEEN 10 AND 20")
def criteria_wildcards(t: Tables):
    return t.part.where(criteria(t.part, {"p_name": "*R?n*", "p_type": "<>promo", "p_size": [">=10", "<=20"]})).select("p_partkey", "p_name")


@query("""
SELECT p_brand, round(avg(p_size), 4) AS s1, count(p_size) AS s2, count(p_size) AS s3, max(p_size) AS s4, min(p_size) AS s5,
  round(sum(ln(p_size)), 4) AS s6, round(stddev_samp(p_size), 4) AS s7,
  round(stddev_pop(p_size), 4) AS s8, CAST(sum(p_size) AS BIGINT) AS s9, round(var_samp(p_size), 4) AS s10, round(var_pop(p_size), 4) AS s11
FROM part GROUP BY p_brand
""")
def subtotal_codes(t: Tables):
    c = F.col("p_size")
    made = {k: ag.subtotal(k, c) for k in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11)}
    made[6] = F.coalesce(F.log(ag.subtotal(6, c.cast("double"))), ag.log_product(c))  # beyond a double the product is an error, its logarithm is not
    return rounded(t.part.groupBy("p_brand").agg(*[made[k].alias(f"s{k}") for k in range(1, 12)]))


@query("""
SELECT n_name, suppliers, round(balance, 2) AS balance, 0 AS _total FROM (
  SELECT n_name, count(*) AS suppliers, sum(s_acctbal) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
UNION ALL SELECT 'Total', count(*), round(sum(s_acctbal), 2), 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def totals_row(t: Tables):
    by = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("balance"))
    return rounded(ag.totals_row(by, "Total", {"suppliers": "SUM", "balance": "SUM"}), 2)


@query("SELECT o_orderpriority AS item, min(o_orderkey) AS first FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def slicer_items(t: Tables):
    return ag.distinct_items(t.orders, "o_orderpriority", "o_orderkey")


@query("""
SELECT nr, bin, coalesce(n, 0) AS n FROM (VALUES (0, 950.0::DOUBLE), (1, 1000.0::DOUBLE), (2, 1050.0::DOUBLE), (3, NULL)) b(nr, bin)
LEFT JOIN (SELECT CASE WHEN p_retailprice <= 950 THEN 0 WHEN p_retailprice <= 1000 THEN 1 WHEN p_retailprice <= 1050 THEN 2 ELSE 3 END AS k, count(*) AS n FROM part GROUP BY 1) c ON k = nr
""")
def frequency_bins(t: Tables):
    return ag.frequency(t.part, "p_retailprice", [950, 1000, 1050])


@query("""
SELECT p_brand, p_type AS mode, n FROM (
  SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS r
  FROM part GROUP BY p_brand, p_type) WHERE r = 1
""")
def mode_by_group(t: Tables):
    return ag.mode(t.part, "p_type", ["p_brand"], F.min("p_partkey"))


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS quartile1, round(median(l_extendedprice), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS percentile90, round(exp(avg(ln(l_quantity))), 4) AS geomean,
  round(count(l_quantity) / sum(1 / l_quantity), 4) AS harmean, round(var_pop(l_quantity) * count(l_quantity), 2) AS devsq,
  round(sum(l_quantity * l_quantity), 2) AS sumsq
FROM lineitem GROUP BY l_returnflag
""")
def order_statistics(t: Tables):
    """Quantiles by ranks that are counted over range partitions; the moments are partial aggregates."""
    q = F.col("l_quantity")
    made = ag.quantiles(t.lineitem, "l_extendedprice", ["l_returnflag"], {"quartile1": 0.25, "median": 0.5, "percentile90": 0.9})
    means = t.lineitem.groupBy("l_returnflag").agg(ag.geomean(q).alias("geomean"), ag.harmean(q).alias("harmean"), F.round(ag.devsq(q), 2).alias("devsq"), F.round(F.sum(q * q), 2).alias("sumsq"))
    return rounded(made.join(means, "l_returnflag"))


@query("""
SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS correl, round(covar_pop(l_extendedprice, l_quantity), 4) AS covar,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS rsq, round(sum((l_tax - l_discount) * (l_tax - l_discount)), 4) AS sumxmy2,
  round(sum(l_tax * l_tax - l_discount * l_discount), 4) AS sumx2my2, round(sum(l_tax * l_tax + l_discount * l_discount), 4) AS sumx2py2,
  round(sum(l_quantity * l_tax), 4) AS sumproduct
FROM lineitem GROUP BY l_returnflag
""")
def paired_statistics(t: Tables):
    y, x, a, b = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr(y, x), 6).alias("correl"),
        F.round(F.covar_pop(y, x), 4).alias("covar"),
        F.round(F.regr_slope(y, x), 4).alias("slope"),
        F.round(F.regr_intercept(y, x), 4).alias("intercept"),
        F.round(F.regr_r2(y, x), 6).alias("rsq"),
        F.round(F.sum((a - b) * (a - b)), 4).alias("sumxmy2"),
        F.round(F.sum(a * a - b * b), 4).alias("sumx2my2"),
        F.round(F.sum(a * a + b * b), 4).alias("sumx2py2"),
        F.round(F.sum(x * a), 4).alias("sumproduct"),
    )


@query("""
WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, round(avg(c_acctbal), 4) AS trim_mean FROM r WHERE r > floor(n * 0.2 / 2) AND r <= n - floor(n * 0.2 / 2) GROUP BY c_nationkey
""")
def trimmed_mean(t: Tables):
    return rounded(ag.trim_mean(t.customer, "c_acctbal", ["c_nationkey"], 0.2))


@query("""
WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1)
SELECT c_nationkey, round(avg(abs(c_acctbal - m)), 4) AS ave_dev FROM customer JOIN m USING (c_nationkey) GROUP BY c_nationkey
""")
def average_deviation(t: Tables):
    return rounded(ag.ave_dev(t.customer, "c_acctbal", ["c_nationkey"]))


@query("""
SELECT p_brand, p_retailprice AS upper_median FROM (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
WHERE r = floor(n / 2.0) + 1
""")
def upper_median(t: Tables):
    return ag.upper_median(t.part, "p_retailprice", ["p_brand"])


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 16")
def top_census(t: Tables):
    return ag.top_census(t.part, "p_name", 16)


@query("""
SELECT p_partkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (p_retailprice - lo) / (hi - lo) END, 6) AS ratio,
  CASE WHEN hi = lo THEN 1 WHEN (p_retailprice - lo) / (hi - lo) >= 0.67 THEN 2 WHEN (p_retailprice - lo) / (hi - lo) >= 0.34 THEN 1 ELSE 0 END AS band
FROM part JOIN (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1) USING (p_brand)
""")
def icon_bands(t: Tables):
    return rounded(ag.cut_bands(t.part, "p_retailprice", ["p_brand"]).select("p_partkey", "ratio", "band"), 6)


# ---------------------------------------------------------------- lookups


@query("""
SELECT o_orderkey, c_name, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def vlookup_chain(t: Tables):
    a = lookup.vlookup(t.orders, "o_custkey", t.customer, "c_custkey", {"c_name": "c_name", "c_mktsegment": "c_mktsegment", "_n": "c_nationkey"}, "c_custkey")
    b = lookup.vlookup(a, "_n", t.nation, "n_nationkey", {"n_name": "n_name", "_r": "n_regionkey"}, "n_nationkey")
    c = lookup.vlookup(b, "_r", t.region, "r_regionkey", {"r_name": "r_name"}, "r_regionkey")
    return c.select("o_orderkey", "c_name", "c_mktsegment", "n_name", "r_name")


@query("""
SELECT p_partkey, coalesce(f.l_orderkey, -1) AS l_orderkey FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1) f ON l_partkey = p_partkey * 3
""")
def xlookup_default(t: Tables):
    """First match among many, a default for the two thirds of the keys that are absent."""
    keys = t.part.select("p_partkey", (F.col("p_partkey") * 3).alias("wanted"))
    return lookup.vlookup(keys, "wanted", t.lineitem.select("l_partkey", "l_orderkey"), "l_partkey", {"l_orderkey": "l_orderkey"}, "l_orderkey", {"l_orderkey": -1}).select("p_partkey", "l_orderkey")


@query("""
WITH p AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS place FROM part), f AS (SELECT p_name AS name, min(place) AS position FROM p GROUP BY 1)
SELECT p_partkey, position FROM part LEFT JOIN f ON p_name = name
""")
def match_position(t: Tables):
    return lookup.match_position(t.part.select("p_partkey", "p_name"), "p_name", t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k")), "name", "k").select("p_partkey", "position")


@query("""
SELECT e.event_id, p.value AS value_asof FROM events e ASOF LEFT JOIN (SELECT ts, user_id, value FROM events WHERE event_type = 'purchase') p
ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def lookup_asof(t: Tables):
    """For each event the user's last purchase at or before it."""
    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", "value", "event_id")
    return lookup.asof(t.events.select("event_id", "user_id", "ts"), "ts", bought, "ts", ["value"], ["user_id"], "event_id").select("event_id", "value_asof")


@query("""
SELECT p_partkey, grade FROM part LEFT JOIN (VALUES (900.0, 950.0, 'low'), (950.0, 1000.0, 'middle'), (1020.0, 1050.0, 'high')) b(lo, hi, grade) ON p_retailprice >= lo AND p_retailprice < hi
""")
def bin_lookup(t: Tables):
    bins = t.spark.createDataFrame([(900.0, 950.0, "low"), (950.0, 1000.0, "middle"), (1020.0, 1050.0, "high")], "lo double, hi double, grade string")
    return lookup.bin_of(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", bins, "lo", "hi", ["grade"]).select("p_partkey", "grade")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def countif_members(t: Tables):
    return lookup.members(t.customer, "c_custkey", t.orders.where("o_totalprice > 400000"), "o_custkey").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def countif_strangers(t: Tables):
    return lookup.members(t.documents, "doc_id", t.labels, "doc_id", wanted=False).select("doc_id")


@query("""
SELECT '/label[' || doc_id || ']' AS path, 'warning' AS severity, 'missing label ' || doc_id AS message FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def missing_references(t: Tables):
    return lookup.missing_references(t.documents, "doc_id", t.labels, "doc_id", "label")


@query("""
WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 > 0 THEN p_partkey - 1 END AS up, CASE WHEN p_partkey % 40 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 7 = 0 THEN p_size END AS size FROM part),
w AS (SELECT id, up, brand, size, 0 AS d FROM c UNION ALL SELECT w.id, c.up, coalesce(w.brand, c.brand), coalesce(w.size, c.size), d + 1 FROM w JOIN c ON w.up = c.id WHERE d < 20)
SELECT id, brand, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS r FROM w) WHERE r = 1
""")
def style_inheritance(t: Tables):
    """Chains of forty styles, of which twenty steps are walked."""
    key = F.col("p_partkey")
    chain = t.part.select(key.alias("id"), F.when(key % 40 > 0, key - 1).alias("up"), F.when(key % 40 == 0, F.col("p_brand")).alias("brand"), F.when(key % 7 == 0, F.col("p_size")).alias("size"))
    return lookup.inherit(chain, "id", "up", ["brand", "size"])


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, CASE WHEN b.hi > 48 THEN b.hi END, b.lo) AS size FROM part JOIN (SELECT p_brand, max(p_size) AS hi, min(p_size) AS lo FROM part GROUP BY 1) b USING (p_brand)
""")
def placeholder_inheritance(t: Tables):
    by = t.part.groupBy("p_brand").agg(F.max("p_size").alias("hi"), F.min("p_size").alias("lo"))
    lay = by.select("p_brand", F.when(F.col("hi") > 48, F.col("hi")).alias("size"))
    slides = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return lookup.placeholder_inherit(slides, lay, by.select("p_brand", F.col("lo").alias("size")), ["p_brand"], ["size"]).select("p_partkey", "size")


@query("""
WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
SELECT a.k AS row, b.k AS col, round(sum(CAST(a.x AS DOUBLE) * b.x), 4) + 0.0 AS value FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2
""")
def matrix_gram(t: Tables):
    """MMULT of the transpose with the matrix of all vectors: dimension by dimension, small by its shape."""
    v = t.embeddings.select("vec_id", F.posexplode("embedding").alias("k", "x"))
    a = v.select(F.col("k").alias("row"), F.col("vec_id").alias("col"), F.col("x").cast("double").alias("value"))
    b = v.select(F.col("vec_id").alias("row"), F.col("k").alias("col"), F.col("x").cast("double").alias("value"))
    return rounded(lookup.mmult(a, b))


@query("""
SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' k=' || json_extract_string(props, '$.k') || ' {{none}} ' AS text, 3 AS hits FROM events
""")
def template_fill(t: Tables):
    data = F.to_json(F.struct(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("u"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    rows_ = t.events.select("event_id", F.lit("user {{u.id}} did {{ u.kind }} k={{k}} {{none}} ").alias("template"), data.alias("data"))
    made, hits = lookup.fill_template(rows_, "template", "data")
    return rows_.select("event_id", made.alias("text"), hits.alias("hits"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# ---------------------------------------------------------------- windows


@query("""
SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS rank_eq, rank() OVER w + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2 AS rank_avg,
  round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS percent_rank
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)
""")
def rank_family(t: Tables):
    return rounded(windows.ranks(t.customer, "c_acctbal", ["c_nationkey"]).select("c_custkey", "rank_eq", "rank_avg", "percent_rank"), 6)


@query("SELECT c_nationkey, c_acctbal AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r = 3")
def large_third(t: Tables):
    return windows.kth(t.customer, "c_acctbal", ["c_nationkey"], 3)


@query("SELECT c_nationkey, c_acctbal AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r FROM customer) WHERE r = 2")
def small_second(t: Tables):
    return windows.kth(t.customer, "c_acctbal", ["c_nationkey"], 2, largest=False)


@query("""
SELECT event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS high, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def scan_running(t: Tables):
    made = windows.running(t.events, ["user_id"], ["ts", "event_id"], total=F.sum("value"), high=F.max("value"), n=F.count("*"))
    return rounded(made.select("event_id", "total", "high", "n"))


@query("""
WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 14401000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g
""")
def sessions(t: Tables):
    return windows.sessions(t.events, ["user_id"], "ts", 4 * 3600, ["ts", "event_id"]).select("event_id", "session")


@query("""
WITH l AS (SELECT event_id, user_id, ts, length(event_type) AS level, lag(length(event_type), 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
SELECT event_id, level, previous FROM l WHERE level > previous + 1
""")
def level_jumps(t: Tables):
    return windows.level_jumps(t.events.select("event_id", "user_id", F.length("event_type").alias("level")), ["user_id"], "event_id", "level").select("event_id", "level", "previous")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ordinal FROM lineitem")
def ordinals(t: Tables):
    made = windows.ordinals(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return made.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ordinal")


# ---------------------------------------------------------------- rows


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice < 1000 OR o_totalprice >= 450000)")
def auto_filter(t: Tables):
    spec = {"o_orderpriority": {"values": ["1-URGENT", "2-HIGH"]}, "o_totalprice": {"criteria": ["<1000", ">=450000"], "both": False}}
    return rows.auto_filter(t.orders, spec).select("o_orderkey")


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 100")
def sort_state(t: Tables):
    """A report of the first hundred rows of a sorted table: Spark keeps only those."""
    return rows.sort_state(t.part, [("p_brand", True), ("p_size", False)], "p_partkey").limit(100).select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def take_last(t: Tables):
    return rows.take(t.orders, "o_orderkey", -25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1000")
def drop_first(t: Tables):
    return rows.drop(t.orders, "o_orderkey", 1000).select("o_orderkey")


@query("SELECT arg_min(p_brand, p_partkey) AS p_brand, arg_min(p_type, p_partkey) AS p_type, min(p_partkey) AS p_partkey FROM part GROUP BY upper(p_brand), upper(p_type)")
def unique_rows(t: Tables):
    return rows.unique(t.part, ["p_brand", "p_type"], "p_partkey")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def vstack_tables(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return rows.vstack(a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""
SELECT place, s_name, p_name FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier)
FULL JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS place FROM part) USING (place)
""")
def hstack_tables(t: Tables):
    return rows.hstack(t.supplier, t.part, "s_suppkey", "p_partkey").select("place", "s_name", "p_name")


@query("""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS n FROM part)
SELECT nr, p_partkey FROM (VALUES (1, 3), (2, -1), (3, 10)) w(nr, want) JOIN p ON r = CASE WHEN want > 0 THEN want ELSE n + want + 1 END
""")
def choose_rows(t: Tables):
    return rows.choose_rows(t.part, "p_partkey", [3, -1, 10]).select("nr", "p_partkey")


@query("SELECT page_id FROM pages WHERE page_id = 1 OR page_id = 3 OR page_id BETWEEN 5 AND 8")
def page_ranges(t: Tables):
    return t.pages.withColumnRenamed("page_id", "page").where(rows.page_spec("1,3,5-8")).select(F.col("page").alias("page_id"))


@query("SELECT p_name FROM part INTERSECT SELECT p_name FROM part WHERE p_size > 49")
def intersect_names(t: Tables):
    return t.part.select("p_name").intersect(t.part.where("p_size > 49").select("p_name"))


# ---------------------------------------------------------------- cells


def _part_cells(t: Tables):
    return ce.to_cells(t.part.select((F.col("p_partkey") + 1).alias("nr"), "p_name", "p_size", "p_retailprice"), "Part", "nr")


@query("""
SELECT 'Part' AS sheet, 1 AS row, c AS col, 'string' AS kind, NULL::DOUBLE AS num, n AS str FROM (VALUES (1, 'p_name'), (2, 'p_size'), (3, 'p_retailprice')) h(c, n)
UNION ALL SELECT 'Part', p_partkey::INT + 2, 1, 'string', NULL, p_name FROM part
UNION ALL SELECT 'Part', p_partkey::INT + 2, 2, 'number', p_size::DOUBLE, NULL FROM part
UNION ALL SELECT 'Part', p_partkey::INT + 2, 3, 'number', p_retailprice, NULL FROM part
""")
def sheet_cells(t: Tables):
    return _part_cells(t).select("sheet", "row", "col", "kind", "num", "str")


@query("SELECT 'Part' AS sheet, count(*) + 1 AS rows, 3 * (count(*) + 1) AS cells FROM part")
def sheet_summary(t: Tables):
    return ce.sheet_summary(_part_cells(t))


@query("SELECT p_partkey + 2 AS _row, p_name, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def detected_table(t: Tables):
    made = ce.from_cells(_part_cells(t), "part")
    return made.withColumn("_row", F.col("_row").cast("long"))


@query("""
SELECT row, col, text FROM (SELECT p_partkey::INT + 2 AS row, 1 AS col, p_name AS text FROM part UNION ALL SELECT p_partkey::INT + 2, 2, CAST(p_size AS VARCHAR) FROM part) WHERE row BETWEEN 5 AND 40 AND contains(text, '1')
""")
def contains_cells(t: Tables):
    return ce.contains(ce.window(_part_cells(t), "A5:B40"), "1").select("row", "col", ce.shown().alias("text"))


@query("SELECT 'Part' AS sheet, 1 AS r1, max(p_partkey)::INT + 2 AS r2, 1 AS c1, 3 AS c2 FROM part")
def used_range(t: Tables):
    return ce.used_range(_part_cells(t))


@query("""
SELECT p_partkey, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) ELSE chr(64 + (n - 703) // 676 + 1) || chr(65 + ((n - 27) // 26) % 26) || chr(65 + (n - 1) % 26) END || '7' AS a1, n AS col, 7 AS row
FROM (SELECT p_partkey, p_partkey::INT + 1 AS n FROM part)
""")
def a1_names(t: Tables):
    named = t.part.select("p_partkey", ce.a1(F.lit(7), F.col("p_partkey") + 1).alias("a1"))
    row, col = ce.split_a1(F.col("a1"))
    return named.select("p_partkey", "a1", col.alias("col"), row.alias("row"))


@query("SELECT p_brand AS sheet FROM part GROUP BY 1 HAVING max(p_size) < 50")
def empty_sheets(t: Tables):
    sheets = t.part.select(F.col("p_brand").alias("sheet")).distinct()
    cells = t.part.where("p_size >= 50").select(F.col("p_brand").alias("sheet"), F.lit("string").alias("kind"))
    return ce.empty_sheets(sheets, cells)


@query("""
SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN 'number' WHEN lower(x) IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind,
  TRY_CAST(CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN x END AS DOUBLE) AS num
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'TRUE' ELSE '-.5' END AS x FROM orders)
""")
def typed_cells(t: Tables):
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.col("o_custkey").cast("string")).when(k == 2, "TRUE").otherwise("-.5")
    kind, num, _, _ = ce.typed(x)
    return t.orders.select("o_orderkey", kind, num)


# ---------------------------------------------------------------- formulas filled down


def _formulas(df, key: str, made: dict[str, str], digits: int = 6):
    return rounded(df.select(key, *[row_formula(df, f).alias(n) for n, f in made.items()]), digits)


@query("""
SELECT p_partkey, length(p_name)::DOUBLE AS len, upper(p_name) AS up, left(p_name, 3) AS head, right(p_name, 2) AS tail, substr(p_name, 2, 3) AS mid,
  CASE WHEN strpos(p_name, 'r') > 0 THEN strpos(p_name, 'r')::DOUBLE END AS find, replace(p_name, 'e', 'E') AS subst, repeat(left(p_name, 1), 3) AS rept,
  p_name || '/' || p_size AS cat, split_part(p_name, ' ', 1) AS before, ascii(p_name)::DOUBLE AS code, p_name = lower(p_name) AS exact
FROM part
""")
def text_functions(t: Tables):
    made = {
        "len": "LEN(p_name)", "up": "UPPER(p_name)", "head": "LEFT(p_name,3)", "tail": "RIGHT(p_name,2)", "mid": "MID(p_name,2,3)", "find": 'FIND("r",p_name)',
        "subst": 'SUBSTITUTE(p_name,"e","E")', "rept": "REPT(LEFT(p_name),3)", "cat": 'p_name&"/"&p_size', "before": 'TEXTBEFORE(p_name," ")', "code": "UNICODE(p_name)", "exact": "EXACT(p_name,LOWER(p_name))",
    }
    return _formulas(t.part, "p_partkey", made)


@query("""
SELECT o_orderkey, round(abs(x), 6) AS a, floor(x)::DOUBLE AS b, round(sqrt(o_totalprice), 6) AS c, round(ln(o_totalprice), 6) AS d, round(x - 7 * floor(x / 7), 6) + 0.0 AS e,
  round(sign(x) * floor(abs(x) * 10 + 0.5) / 10, 6) + 0.0 AS f, round(sign(x) * ceil(abs(x)), 6) + 0.0 AS g, round(sin(x), 6) + 0.0 AS h, round(atan2(2.0, x), 6) AS i,
  gcd(o_custkey, 60)::DOUBLE AS j, (o_custkey & 12)::DOUBLE AS k, upper(to_base(o_custkey, 16)) AS l, round(ceil(x / 50) * 50, 6) + 0.0 AS m
FROM (SELECT *, o_totalprice / 1000 - 200 AS x FROM orders)
""")
def math_functions(t: Tables):
    made = {
        "a": "ABS(x)", "b": "INT(x)", "c": "SQRT(o_totalprice)", "d": "LN(o_totalprice)", "e": "MOD(x,7)", "f": "ROUND(x,1)", "g": "ROUNDUP(x,0)", "h": "SIN(x)", "i": "ATAN2(x,2)",
        "j": "GCD(o_custkey,60)", "k": "BITAND(o_custkey,12)", "l": "DEC2HEX(o_custkey)", "m": "CEILING(x,50)",
    }
    return _formulas(t.orders.withColumn("x", F.col("o_totalprice") / 1000 - 200), "o_orderkey", made)


@query("""
SELECT o_orderkey, year(d)::DOUBLE AS y, month(d)::DOUBLE AS m, day(d)::DOUBLE AS dd, (dayofweek(d) + 1)::DOUBLE AS wd, weekofyear(d)::DOUBLE AS iso,
  date_diff('day', DATE '1899-12-30', d)::DOUBLE AS serial, date_diff('day', DATE '1899-12-30', last_day(d))::DOUBLE AS eom,
  date_diff('day', DATE '1899-12-30', CAST(d + INTERVAL 1 MONTH AS DATE))::DOUBLE AS edate,
  (SELECT count(*) FROM range(d::TIMESTAMP, d::TIMESTAMP + INTERVAL 20 DAY, INTERVAL 1 DAY) r(x) WHERE isodow(x) < 6)::DOUBLE AS net, strftime(d, '%y/%m/%d') AS shown
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def date_functions(t: Tables):
    made = {
        "y": "YEAR(d)", "m": "MONTH(d)", "dd": "DAY(d)", "wd": "WEEKDAY(d)", "iso": "ISOWEEKNUM(d)", "serial": "d+0", "eom": "EOMONTH(d,0)", "edate": "EDATE(d,1)", "net": "NETWORKDAYS(d,d+19)", "shown": "DATESTRING(d)",
    }
    return _formulas(t.orders.withColumn("d", F.col("o_orderdate").cast("date")), "o_orderkey", made)


@query("""
SELECT o_orderkey, round(-pv * pow(1 + r, 24) * r / (pow(1 + r, 24) - 1), 4) AS pmt, round(-(pv * pow(1 + r, 24)), 4) AS fv, round((pv - 100) / 5, 4) AS sln,
  round(pow(1 + r, 12) - 1, 8) AS effect, round(-pv * r, 6) AS ipmt, round(pv / pow(1 + r, 1) + pv / pow(1 + r, 2), 4) AS npv, round(ln(2.0) / ln(1 + r), 6) AS pduration, round(pow(3.0, 1 / 5.0) - 1, 8) AS rri
FROM (SELECT o_orderkey, o_totalprice AS pv, 0.005 + (o_orderkey % 7) / 1000.0 AS r FROM orders)
""")
def finance_functions(t: Tables):
    df = t.orders.select("o_orderkey", F.col("o_totalprice").alias("pv"), (0.005 + F.col("o_orderkey") % 7 / 1000.0).alias("r"))
    made = {"pmt": ("PMT(r,24,pv)", 4), "fv": ("FV(r,24,0,pv)", 4), "sln": ("SLN(pv,100,5)", 4), "effect": ("EFFECT(r*12,12)", 8), "ipmt": ("IPMT(r,1,24,pv)", 6), "npv": ("NPV(r,pv,pv)", 4), "pduration": ("PDURATION(r,1,2)", 6), "rri": ("RRI(5,1,3)", 8)}
    return df.select("o_orderkey", *[F.round(row_formula(df, f), d).alias(n) for n, (f, d) in made.items()])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS a, o_totalprice > 100000 AND o_orderstatus = 'F' AS b, o_totalprice > 400000 OR o_orderstatus = 'P' AS c,
  CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END AS d, round(CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_totalprice / (o_custkey % 5) END, 4) AS e, o_orderkey % 2 = 0 AS f,
  CASE WHEN o_totalprice < 1e5 THEN 'A' WHEN o_totalprice < 2e5 THEN 'B' ELSE 'C' END AS g
FROM orders
""")
def logic_functions(t: Tables):
    made = {
        "a": 'IF(o_totalprice>250000,"big","small")', "b": 'AND(o_totalprice>100000,o_orderstatus="f")', "c": 'OR(o_totalprice>400000,o_orderstatus="P")', "d": 'SWITCH(o_orderstatus,"F",1,"O",2,3)',
        "e": "IFERROR(o_totalprice/MOD(o_custkey,5),-1)", "f": "ISEVEN(o_orderkey)", "g": 'IFS(o_totalprice<100000,"A",o_totalprice<200000,"B",TRUE,"C")',
    }
    return _formulas(t.orders, "o_orderkey", made, 4)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(exp(-q * q / 2) / sqrt(2 * pi()), 8) AS phi, round(1 - exp(-0.1 * l_quantity), 8) AS expon, round(1 - exp(-pow(l_quantity / 30, 1.5)), 8) AS weibull, round((l_quantity - 25) / 14, 8) AS z
FROM (SELECT *, (l_quantity - 25) / 14 AS q FROM lineitem)
""")
def closed_distributions(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    made = {"phi": "PHI((l_quantity-25)/14)", "expon": "EXPON.DIST(l_quantity,0.1,TRUE)", "weibull": "WEIBULL.DIST(l_quantity,1.5,30,TRUE)", "z": "STANDARDIZE(l_quantity,25,14)"}
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", *[row_formula(df, f).alias(n) for n, f in made.items()]), 8)


@query("""
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS sumsq, round(list_dot_product(v, v), 5) AS dot, round(list_max(v), 5) AS high, round(list_sum(list_transform(v, lambda x: 2 * x + 1)), 4) AS mapped,
  len(list_filter(v, lambda x: x > 0))::DOUBLE AS positive, round(list_sort(v)[2], 5) AS small2, round(median, 5) AS median
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT median(x) FROM unnest(CAST(embedding AS DOUBLE[])) u(x)) AS median FROM embeddings)
""")
def array_functions(t: Tables):
    df = t.embeddings.select("vec_id", "embedding")
    made = {
        "sumsq": ("SUMSQ(embedding)", 5), "dot": ("SUMPRODUCT(embedding,embedding)", 5), "high": ("MAX(embedding)", 5), "mapped": ("SUM(MAP(embedding,LAMBDA(x,2*x+1)))", 4),
        "positive": ('COUNTIF(embedding,">0")', 0), "small2": ("INDEX(SORT(embedding),2)", 5), "median": ("MEDIAN(embedding)", 5),
    }
    return df.select("vec_id", *[F.round(row_formula(df, f), d).alias(n) for n, (f, d) in made.items()])


@query("""
SELECT p_partkey, round(list_reduce([1.0, 2.0, 3.0, 4.0], lambda a, x: a * x) * p_size, 4) AS reduced, p_size * 2.0 + 1 AS let_, [[p_size * 1.0], [p_size * 2.0], [p_size * 3.0]] AS grid, [[1.0 * p_size, 2.0], [p_size, NULL]] AS stacked
FROM part
""")
def lambda_functions(t: Tables):
    made = {"reduced": "REDUCE(1,SEQUENCE(4),LAMBDA(a,x,a*x))*p_size", "let_": "LET(y,p_size*2,y+1)", "grid": "MAKEARRAY(3,1,LAMBDA(r,c,r*p_size))", "stacked": "VSTACK(HSTACK(p_size,2),p_size)"}
    return _formulas(t.part, "p_partkey", made, 4)


# ---------------------------------------------------------------- formats and specifications


@query("""
SELECT o_orderkey, CASE WHEN x < 0 THEN '(' || format('{:,.1f}', abs(floor(abs(x) * 10 + 0.5) / 10)) || ')' ELSE format('{:,.1f}', floor(x * 10 + 0.5) / 10) END AS a,
  CASE WHEN x < 0 THEN '-' ELSE '' END || format('{:.1f}%', floor(abs(x) * 1000 + 0.5) / 10) AS b, strftime(o_orderdate, '%Y-%m-%d') AS c
FROM (SELECT *, (o_custkey - 700) * 12.34 AS x FROM orders)
""")
def number_formats(t: Tables):
    from lattica.functions.dates import to_serial

    x = (F.col("o_custkey") - 700) * 12.34
    return t.orders.select("o_orderkey", formats.format_number(x, "#,##0.0;(#,##0.0)").alias("a"), formats.format_number(x, "0.0%").alias("b"), formats.format_number(to_serial(F.col("o_orderdate")), "yyyy-mm-dd").alias("c"))


@query("SELECT c_custkey, c_acctbal >= (SELECT min(c_acctbal) FROM (SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 10)) AS hit FROM customer")
def top_ten_rule(t: Tables):
    return specs.top_rule(t.customer, "c_acctbal", "c_custkey", 10).select("c_custkey", "hit")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_retailprice) > 1 AS hit FROM part")
def duplicate_rule(t: Tables):
    return specs.multiplicity(t.part, "p_retailprice").select("p_partkey", "hit")


@query("SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) + stddev_pop(c_acctbal) FROM customer) AS hit FROM customer")
def above_average_rule(t: Tables):
    return specs.about_average(t.customer, "c_acctbal", deviations=1.0).select("c_custkey", "hit")


@query("""
SELECT o_orderkey, o_totalprice BETWEEN 100000 AND 200000 AS inside, contains(lower(o_orderpriority), 'high') AS has_text, starts_with(o_orderpriority, '1') AS begins,
  CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-24' AND DATE '1998-06-30' AS last7, date_trunc('month', o_orderdate) = TIMESTAMP '1998-05-01' AS last_month
FROM orders
""")
def cell_rules(t: Tables):
    today = F.lit("1998-06-30").cast("date")
    return t.orders.select(
        "o_orderkey",
        specs.cell_is(F.col("o_totalprice"), "between", 200000, 100000).alias("inside"),
        specs.text_rule(F.col("o_orderpriority"), "containsText", "HIGH").alias("has_text"),
        specs.text_rule(F.col("o_orderpriority"), "beginsWith", "1").alias("begins"),
        specs.time_period(F.col("o_orderdate"), "last7Days", today).alias("last7"),
        specs.time_period(F.col("o_orderdate"), "lastMonth", today).alias("last_month"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE NOT (l_quantity BETWEEN 2 AND 49 AND l_quantity = floor(l_quantity))")
def data_validation(t: Tables):
    return specs.violations(t.lineitem, "l_quantity", "whole", "between", 2, 49).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT user_id, list(value ORDER BY event_id) AS points FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id")
def sparklines(t: Tables):
    return specs.sparkline(t.events, ["user_id"], "event_id", "value", 5)


@query("""
SELECT 'p_size' AS series, p_partkey AS nr, p_name AS label, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'p_retailprice', p_partkey, p_name, p_retailprice FROM part
""")
def chart_series(t: Tables):
    return specs.chart_series(t.part, "p_name", "p_partkey", ["p_size", "p_retailprice"])


# ---------------------------------------------------------------- text


@query(r"""
SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM (SELECT doc_id, replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{AD}\x{200B}-\x{200F}\x{2060}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}\x{FE00}-\x{FE0F}\x{E000}-\x{F8FF}]', '', 'g'), 'œ', 'oe'), 'æ', 'ae') AS t FROM documents)
""")
def content_sanitize(t: Tables):
    made = text.content_sanitize(F.col("text"))
    return t.documents.select("doc_id", made.alias("t")).select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("sha"))


def _replaced_sql(sql: str, table: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for a, b in table.items():
        sql = f"replace({sql}, {quoted(a)}, {quoted(b)})"
    return sql


#: No page of the test tables holds a numeric reference or a \\uXXXX; both are put before the text.
_REFERENCES = "&#65;&#x2014;&#120; \\u0041 H₂O x²⁻¹ "


@query(f"""
WITH p AS (SELECT page_id, {_replaced_sql(f"('{_REFERENCES}' || html)", text.ENTITIES)} AS s FROM pages),
h AS (SELECT page_id, list_reduce(list_distinct(regexp_extract_all(s, '&#[xX]([0-9A-Fa-f]{{1,6}});', 1)), lambda a, x: replace(a, '&#x' || x || ';', chr(('0x' || x)::INT)), s) AS s FROM p),
d AS (SELECT page_id, list_reduce(list_distinct(regexp_extract_all(s, '&#([0-9]{{1,7}});', 1)), lambda a, x: replace(a, '&#' || x || ';', chr(x::INT)), s) AS s FROM h),
u AS (SELECT page_id, list_reduce(list_distinct(regexp_extract_all(s, '\\\\u([0-9A-Fa-f]{{4}})', 1)), lambda a, x: replace(a, chr(92) || 'u' || x, chr(('0x' || x)::INT)), s) AS s FROM d),
r AS (SELECT page_id, translate(regexp_replace(translate(regexp_replace(s, '([{text.SUPER[0]}]+)', '<super>\\1</super>', 'g'), '{text.SUPER[0]}', '{text.SUPER[1]}'), '([{text.SUB[0]}]+)', '<sub>\\1</sub>', 'g'), '{text.SUB[0]}', '{text.SUB[1]}') AS s FROM u)
SELECT page_id, sha256({_replaced_sql("s", text.SYMBOLS)}) AS sha FROM r
""")
def code_sanitize(t: Tables):
    """All pages, null ones too, behind a line of references and of raised and lowered digits."""
    return t.pages.select("page_id", F.sha2(text.code_sanitize(F.concat(F.lit(_REFERENCES), "html")), 256).alias("sha"))


#: Characters that are put behind each document in turn, by its id: one of each class, and none.
_SUSPECT = [0xFFFD, 0x200B, 0x2060, 0x85, 0x202E, 0xFE0F, 0xE000, None]
_SUSPECT_SQL = "coalesce(text, '') || CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN repeat(chr({c}), 2)" for k, c in enumerate(_SUSPECT) if c) + " ELSE '' END"
_AUDIT = {
    "replacement_char": r"\x{FFFD}", "zero_width": r"\x{200B}-\x{200D}\x{FEFF}\x{2060}", "control": r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F",
    "bidi_control": r"\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}", "variation_selector": r"\x{FE00}-\x{FE0F}", "private_use": r"\x{E000}-\x{F8FF}",
}


@query(f"WITH d AS (SELECT doc_id, {_SUSPECT_SQL} AS s FROM documents) SELECT kind AS class, sum(n)::BIGINT AS count, count(DISTINCT doc_id) AS pages FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, length(regexp_replace(s, '[^{c}]', '', 'g')) AS n FROM d" for k, c in _AUDIT.items()) + ") WHERE n > 0 GROUP BY kind")
def character_audit(t: Tables):
    planted = F.lit("")
    for k, c in enumerate(_SUSPECT):
        planted = F.when(F.col("doc_id") % 8 == k, chr(c) * 2 if c else "").otherwise(planted)
    return text.audit(t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), planted).alias("s")), "s", "doc_id")


@query("""
SELECT doc_id, n >= 30 AND v / n < 0.2 AS garbled, list_filter([CASE WHEN len < 20 THEN 'no_text' WHEN len < 400 AND cover < 0.05 THEN 'sparse_text' END, CASE WHEN img > 0.25 THEN 'embedded_images' END, CASE WHEN n >= 30 AND v / n < 0.2 THEN 'garbled' END], lambda x: x IS NOT NULL) AS reasons,
  len < 20 OR (n >= 30 AND v / n < 0.2) AS ocr
FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n, length(regexp_replace(text, '[^AEIOUaeiou]', '', 'g')) AS v, length(text) AS len, length(text) / 10000.0 AS cover, (doc_id % 10) / 20.0 AS img FROM documents)
""")
def page_complexity(t: Tables):
    reasons = text.complexity(F.col("text"), F.length("text") / 10000.0, F.col("doc_id") % 10 / 20.0, F.lit(False))
    return t.documents.select("doc_id", text.is_garbled(F.col("text")).alias("garbled"), reasons.alias("reasons")).withColumn("ocr", text.needs_ocr(F.col("reasons")))


@query("""
WITH w AS (SELECT * FROM (VALUES ('nature', 'eco'), ('nature', 'forest'), ('neutral', 'report'), ('energy', 'social'), ('authority', 'formal'), ('calm', 'simple'), ('tension', 'alert'), ('warmth', 'home')) x(k, w)),
s AS (SELECT doc_id, k, sum(CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END) AS n FROM documents CROSS JOIN w GROUP BY 1, 2),
r AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k = 'neutral', k) AS r FROM s)
SELECT doc_id, CASE WHEN n > 0 THEN k ELSE 'neutral' END AS intent FROM r WHERE r = 1
""")
def intents(t: Tables):
    table = {"nature": ["eco", "forest"], "neutral": ["report"], "energy": ["social"], "authority": ["formal"], "calm": ["simple"], "tension": ["alert"], "warmth": ["home"]}
    return t.documents.select("doc_id", text.intent(F.col("text"), table).alias("intent"))


def _words(t: Tables):
    """Invented misspellings: a part's name without its second letter."""
    return t.part.select("p_partkey", F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 100)).alias("word"))


@query("""
WITH c AS (SELECT p_name AS c, min(p_partkey) AS o FROM part GROUP BY 1), w AS (SELECT p_partkey, left(p_name, 1) || substr(p_name, 3) AS word FROM part),
d AS (SELECT DISTINCT word FROM w), m AS (SELECT word, c, levenshtein(lower(word), lower(c)) AS d, o FROM d CROSS JOIN c),
b AS (SELECT word, arg_min(c, d * 1000000 + o) AS suggestion FROM m WHERE d <= greatest(length(word) // 3, 2) GROUP BY word)
SELECT p_partkey, word, suggestion FROM w LEFT JOIN b USING (word)
""")
def did_you_mean(t: Tables):
    return text.did_you_mean(_words(t), "word", t.part, "p_name", "p_partkey").select("p_partkey", "word", "suggestion")


#: Put before the lines of the documents in turn.
_MARKERS = ["• ", "12. ", "(a) ", "- ", "", "3) ", "1234. "]


def _lines(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    marker = F.element_at(F.array(*map(F.lit, _MARKERS)), (F.col("nr") % len(_MARKERS) + 1).cast("int"))
    return lines.withColumn("line", F.concat(marker, "line"))


@query(r"""
SELECT doc_id, nr, item FROM (SELECT doc_id, nr, CASE WHEN regexp_matches(t, '^([•·●■□○◦-]|[0-9]{1,3}[.)])$') THEN ''
  WHEN regexp_matches(t, '^([•·●■□○◦-]|[0-9]{1,3}[.)]|\([^)]{1,3}\)) +') THEN trim(regexp_replace(t, '^([•·●■□○◦-]|[0-9]{1,3}[.)]|\([^)]{1,3}\)) +', ''), E' \t\r\n') END AS item
  FROM (SELECT doc_id, nr, trim(MARKERS[nr % 7 + 1] || line, E' \t\r\n') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS nr FROM documents))) WHERE item IS NOT NULL
""".replace("MARKERS", "[" + ", ".join(f"'{m}'" for m in _MARKERS) + "]"))
def list_items(t: Tables):
    return _lines(t).select("doc_id", "nr", text.list_item(F.col("line")).alias("item")).where("item is not null")


_EM = "length(regexp_replace(text, '[^{}]', '', 'g')) * {}"


@query("SELECT doc_id, round((" + " + ".join(_EM.format(c, w) for c, w in [(r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}", 1), ("ijl!|.,:;'' ", 0.28), (r"ftr()\[\]/-", 0.36), ("mMWw@%", 0.85), ("QOGDUHNBRKX", 0.72), ("ACEFIJLPSTVYZ", 0.68), ("0-9", 0.556), ("abcdeghknopqsuvxyz", 0.52)]) + r" + length(regexp_replace(text, '[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}ijl!|.,:;'' ftr()\[\]/mMWw@%A-Z0-9a-z-]', '', 'g')) * 0.55)::DOUBLE, 3) + 0.0 AS em FROM documents")
def text_widths(t: Tables):
    return rounded(t.documents.select("doc_id", text.width_em(F.col("text")).alias("em")), 3)


@query("""
WITH c AS (SELECT p_partkey, (p_size * 5)::DOUBLE / 255 AS a, ((p_partkey * 7) % 256)::DOUBLE / 255 AS b FROM part),
l AS (SELECT p_partkey, CASE WHEN a <= 0.03928 THEN a / 12.92 ELSE ((a + 0.055) / 1.055) ** 2.4 END AS x, CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE ((b + 0.055) / 1.055) ** 2.4 END AS y FROM c)
SELECT p_partkey, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) AS ratio FROM l
""")
def contrast_ratios(t: Tables):
    grey = lambda n: F.concat(F.lit("#"), F.repeat(F.lpad(F.hex(n.cast("long")), 2, "0"), F.lit(3)))
    return rounded(t.part.select("p_partkey", text.contrast(grey(F.col("p_size") * 5), grey(F.col("p_partkey") * 7 % 256)).alias("ratio")), 6)


@query("""
SELECT doc_id, length(text) AS n, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS capitals, contains(text, 'ü') AS umlaut FROM documents WHERE contains(text, 'and') OR contains(text, 'ü')
""")
def contains_text(t: Tables):
    d = t.documents.where(F.contains("text", F.lit("and")) | F.contains("text", F.lit("ü")))
    return d.select("doc_id", F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("long").alias("capitals"), F.contains("text", F.lit("ü")).alias("umlaut"))


# ---------------------------------------------------------------- Markdown


@query("""
SELECT conv_id, string_agg('**' || role || ':** ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def conversation_markdown(t: Tables):
    return markdown.conversation(t.conversations, "conv_id", "turn", "role", "text")


@query("""
SELECT n_regionkey, '| nation | region |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || r_name || ' |', chr(10) ORDER BY n_nationkey) AS text
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey
""")
def table_markdown(t: Tables):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", "r_name").alias("r")))), lambda x: x["r"])
    return joined.groupBy("n_regionkey").agg(markdown.table(F.concat(F.array(F.array(F.lit("nation"), F.lit("region"))), body)).alias("text"))


@query("""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '# ' || text WHEN 'user' THEN regexp_replace(text, '(?m)^', '> ', 'g') ELSE '- ' || text END, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def document_markdown(t: Tables):
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "quote").otherwise("list")
    blocks = t.conversations.select("conv_id", "turn", kind.alias("type"), "text", F.lit(1).alias("level"))
    return markdown.document(blocks, ["conv_id"], ["turn"])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT p_brand, '|  | " + " | ".join(_TYPES) + " |' || chr(10) || '|" + " --- |" * 7 + "' || chr(10) || string_agg('| ' || p_size || ' | ' || " + " || ' | ' || ".join(x.lower() for x in _TYPES) + " || ' |', chr(10) ORDER BY p_size) AS text FROM (SELECT p_brand, p_size, " + ", ".join(f"coalesce(max(p_partkey) FILTER (WHERE p_type = '{x}')::VARCHAR, '—') AS {x.lower()}" for x in _TYPES) + " FROM part GROUP BY 1, 2) GROUP BY p_brand")
def chart_markdown(t: Tables):
    points = t.part.select("p_brand", F.col("p_size").cast("string").alias("size"), "p_size", "p_type", F.col("p_partkey").alias("v"))
    best = points.groupBy("p_brand", "size", "p_size", "p_type").agg(F.max("v").alias("v"))
    return markdown.long_chart(best, ["p_brand"], "size", "p_size", _TYPES, "v", "p_type")


@query("""
SELECT 'Region' AS sheet, '| r_name |' || chr(10) || '| --- |' || chr(10) || string_agg('| ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region
""")
def sheet_markdown(t: Tables):
    return markdown.sheet(ce.to_cells(t.region.select((F.col("r_regionkey") + 1).alias("nr"), "r_name"), "Region", "nr"))


# ---------------------------------------------------------------- changes and rules


def _steps(t: Tables):
    e = t.events
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("set")
    key = F.when(F.col("event_type") == "click", "hits").otherwise("price")
    return e.select(F.col("event_id").alias("idx"), op.alias("op"), F.col("user_id").cast("string").alias("path"), F.create_map(key, F.col("value").cast("string")).alias("props"))


_STEPS_SQL = """
s AS (SELECT event_id AS idx, CAST(user_id AS VARCHAR) AS path, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'set' END AS op,
  CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) END AS hits, CASE WHEN event_type <> 'click' THEN CAST(value AS VARCHAR) END AS price FROM events),
st AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events WHERE user_id % 2 = 0)
"""


@query(f"""
WITH {_STEPS_SQL}, g AS (SELECT path, max(idx) AS gone FROM s WHERE op = 'remove' GROUP BY 1),
l AS (SELECT s.* FROM s LEFT JOIN g USING (path) WHERE gone IS NULL OR idx > gone),
w AS (SELECT path, bool_or(op = 'add') AS added, arg_max(hits, idx) FILTER (WHERE hits IS NOT NULL) AS hits, arg_max(price, idx) FILTER (WHERE price IS NOT NULL) AS price FROM l GROUP BY 1)
SELECT p.path, hits, price FROM (SELECT path FROM st UNION SELECT path FROM s) p LEFT JOIN g USING (path) LEFT JOIN w USING (path) LEFT JOIN (SELECT path, true AS old FROM st) o USING (path)
WHERE coalesce(added, false) OR (old AND gone IS NULL)
""")
def apply_changes(t: Tables):
    state = t.events.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("path"), F.lit(None).cast("string").alias("hits"), F.lit(None).cast("string").alias("price")).distinct()
    return edits.apply_steps(state, "path", ["hits", "price"], _steps(t))


@query(f"""
WITH {_STEPS_SQL}, x AS (SELECT s.*, coalesce(last_value(CASE op WHEN 'add' THEN true WHEN 'remove' THEN false END IGNORE NULLS) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st.path IS NOT NULL) AS there FROM s LEFT JOIN st USING (path))
SELECT idx, op, path, op = 'add' OR there AS ok, CASE WHEN NOT (op = 'add' OR there) THEN 'no such path ' || path END AS message FROM x
""")
def replay_report(t: Tables):
    state = t.events.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("path")).distinct()
    return edits.replay_report(state, "path", _steps(t), force=True)


@query("SELECT r_regionkey::BIGINT AS idx, 'add' AS op, '/region[' || r_regionkey || ']' AS path, r_name AS name FROM region")
def dump_steps(t: Tables):
    made = edits.dump(t.region.withColumn("path", F.concat(F.lit("/region["), "r_regionkey", F.lit("]"))), "path", ["r_name"], "r_regionkey")
    return made.select("idx", "op", "path", F.col("props")["r_name"].alias("name"))


@query(r"""
WITH b AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'heading' WHEN 'system' THEN 'image' ELSE 'paragraph' END AS type, 1 + turn % 4 AS level, CASE turn % 5 WHEN 4 THEN '  ' WHEN 3 THEN text || ' {{name}}' ELSE text END AS text FROM conversations),
p AS (SELECT *, '/doc[' || conv_id || ']/block[' || turn || ']' AS path FROM b)
SELECT path, 'info' AS severity, 'empty paragraph' AS message FROM p WHERE type = 'paragraph' AND trim(coalesce(text, '')) = ''
UNION ALL SELECT path, 'warning', 'placeholder text' FROM p WHERE regexp_matches(text, '\{\{.*?\}\}|(?i:lorem ipsum|\bTODO\b|\bTBD\b)')
UNION ALL SELECT path, 'warning', 'image without a description' FROM p WHERE type = 'image' AND trim(coalesce(text, '')) = ''
UNION ALL SELECT path, 'warning', 'heading jumps to level ' || level FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM p WHERE type = 'heading') WHERE level > before + 1
UNION ALL SELECT '/doc[' || conv_id || ']', 'info', 'no table of contents' FROM p GROUP BY conv_id HAVING count(*) FILTER (WHERE type = 'heading') >= 3
""")
def content_warnings(t: Tables):
    """All turns with their own text, some emptied and some with a placeholder."""
    kind = F.when(F.col("role") == "user", "heading").when(F.col("role") == "system", "image").otherwise("paragraph")
    body = F.when(F.col("turn") % 5 == 4, "  ").when(F.col("turn") % 5 == 3, F.concat("text", F.lit(" {{name}}"))).otherwise(F.col("text"))
    return quality.content_warnings(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("type"), (1 + F.col("turn") % 4).alias("level"), body.alias("text")))


@query("""
SELECT '/sheet[' || p_brand || ']/cell[' || ref || ']' AS path, severity, message FROM (SELECT p_brand, ref, unnest([CASE WHEN p_size < 3 THEN {'severity': 'error', 'message': 'row index below 1'} END,
  CASE WHEN NOT regexp_matches(ref, '^[$]?[A-Za-z]{1,3}[$]?[0-9]+$') THEN {'severity': 'error', 'message': 'bad cell reference'} END, CASE WHEN p_size > 48 THEN {'severity': 'warning', 'message': 'formula begins with ='} END], recursive := true)
  FROM (SELECT *, CASE WHEN p_partkey % 100 = 0 THEN '7A' ELSE 'A' || p_size END AS ref FROM part)) WHERE severity IS NOT NULL
""")
def workbook_rules(t: Tables):
    p = t.part
    cells = p.select(F.col("p_brand").alias("sheet"), (F.col("p_size") - 2).alias("row"), F.lit(1).alias("col"), F.when(F.col("p_partkey") % 100 == 0, "7A").otherwise(F.concat(F.lit("A"), "p_size")).alias("ref"), F.when(F.col("p_size") > 48, "=1").alias("formula"), F.lit(None).cast("string").alias("style"))
    sheets = p.select(F.col("p_brand").alias("sheet"), F.lit("A2").alias("freeze"), F.lit("A1:B2").alias("filter_range")).distinct()
    return quality.workbook(sheets, cells)


@query("""
SELECT path, 'warning' AS severity, 'duplicate name ' || name AS message FROM (SELECT p_brand, lower(p_name) AS name, min('/part[' || p_partkey || ']') AS path, count(*) AS n FROM part GROUP BY 1, 2) WHERE n > 1
""")
def duplicate_names(t: Tables):
    return quality.duplicates(t.part, ["p_brand"], "p_name", F.concat(F.lit("/part["), F.col("p_partkey").cast("string"), F.lit("]")), "warning")


# ---------------------------------------------------------------- layout


def _items(t: Tables):
    """Words of the benchmark items set on a page: six to a line, a wide gap after the third."""
    w = t.benchmark.select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", " ")).alias("item", "text")).where("text <> ''")
    k = F.col("item") % 6
    x = k * 40.0 + F.when(k >= 3, 60.0).otherwise(0.0)
    return w.select("doc_id", F.lit(1).alias("page"), "item", x.alias("x"), (x + 35).alias("end_x"), (800.0 - F.floor(F.col("item") / 6) * 14).alias("y"), F.lit(10.0).alias("size"), "text")


_ITEMS_SQL = """
w AS (SELECT item_id AS doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS item FROM benchmark),
i AS (SELECT doc_id, item, text, item // 6 + 1 AS line, (item % 6) // 3 AS cell FROM w WHERE text <> '')
"""


@query(f"WITH {_ITEMS_SQL} SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS line, count(*) AS items, string_agg(text, ' ' ORDER BY item) AS text FROM i GROUP BY doc_id, line")
def layout_lines(t: Tables):
    lined = layout.lines(_items(t))
    parts = F.array_sort(F.collect_list(F.struct("item", "text")))
    return lined.groupBy("doc_id", "line").agg(F.count("*").alias("items"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


@query(f"""
WITH {_ITEMS_SQL} SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS line, dense_rank() OVER (PARTITION BY doc_id, line ORDER BY cell) - 1 AS cell, string_agg(text, ' ' ORDER BY item) AS text FROM i GROUP BY doc_id, line, cell
""")
def layout_cells(t: Tables):
    return layout.line_cells(layout.lines(_items(t))).select("doc_id", "line", "cell", "text")


@query(f"""
WITH {_ITEMS_SQL}, c AS (SELECT doc_id, line, count(DISTINCT cell) AS n FROM i GROUP BY 1, 2), f AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM c),
g AS (SELECT *, r - row_number() OVER (PARTITION BY doc_id, n ORDER BY r) AS k FROM f)
SELECT doc_id, min(r) AS first, max(r) AS last, n AS columns FROM g WHERE n >= 2 GROUP BY doc_id, n, k HAVING count(*) >= 2
""")
def layout_tables(t: Tables):
    return layout.tables(layout.line_cells(layout.lines(_items(t)))).select("doc_id", "first", "last", "columns")


@query(f"""
WITH {_ITEMS_SQL}, c AS (SELECT doc_id, line, cell FROM i GROUP BY 1, 2, 3), n AS (SELECT doc_id, count(*) AS n, max(cell) AS sides FROM c GROUP BY 1)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS line, CASE WHEN n >= 4 AND sides = 1 THEN cell ELSE 0 END::BIGINT AS region FROM c JOIN n USING (doc_id)
""")
def layout_regions(t: Tables):
    """Each cell a line of its own: the wide gap after the third word cuts the page into two columns."""
    cells = layout.line_cells(layout.lines(_items(t))).select("doc_id", "page", "line", "x", "end_x", "y", "size")
    return layout.xy_cut(cells).select("doc_id", "line", "region")


@query(f"""
WITH {_ITEMS_SQL}, c AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY item) FILTER (WHERE cell = 0) AS l, string_agg(text, ' ' ORDER BY item) FILTER (WHERE cell = 1) AS r FROM i GROUP BY 1, 2)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS line, CASE WHEN r IS NULL THEN l WHEN l IS NULL THEN repeat(' ', 36) || r ELSE l || repeat(' ', greatest(36 - length(l), 1)) || r END AS text FROM c
""")
def layout_projected(t: Tables):
    return layout.projected(layout.line_cells(layout.lines(_items(t)))).select("doc_id", "line", "text")


@query(f"""
WITH {_ITEMS_SQL}, l AS (SELECT DISTINCT doc_id, line, 800 - (line - 1) * 14 - CASE WHEN line > 4 THEN 30 ELSE 0 END AS y FROM i),
s AS (SELECT doc_id, line, lag(y) OVER w - y AS step FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
m AS (SELECT doc_id, list_sort(list(step) FILTER (WHERE step > 0))[count(step) // 2 + 1] AS m FROM s GROUP BY 1)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS line, coalesce(sum(CASE WHEN step > 1.4 * m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS block FROM s LEFT JOIN m USING (doc_id)
""")
def layout_blocks(t: Tables):
    """A wide step after the fourth line begins a block."""
    items = _items(t).withColumn("y", F.col("y") - F.when(F.col("item") >= 24, 30.0).otherwise(0.0))
    return layout.blocks(layout.line_text(layout.line_cells(layout.lines(items)))).select("doc_id", "line", "block")


# ---------------------------------------------------------------- workbooks and event time


@query("""
WITH b AS (SELECT s_suppkey, s_acctbal AS x FROM supplier)
SELECT s_suppkey::INT + 2 AS row, 2 AS col, round(x * 2, 4) AS num FROM b UNION ALL
SELECT s_suppkey::INT + 2, 3, round(x * 2 + x, 4) FROM b UNION ALL SELECT 1, 5, round(sum(x), 4) FROM b UNION ALL SELECT 2, 5, round(sum(x) / count(*), 4) FROM b
""")
def workbook_formulas(t: Tables):
    """Two fill-down columns, the second on the first, and totals on a total, in three rounds."""
    from lattica.plans.workbook import evaluate

    s = t.supplier
    n = s.count() + 1
    spot = (F.col("s_suppkey") + 2).cast("int")
    one = lambda row, col, num, formula: F.struct(row.alias("row"), F.lit(col).alias("col"), F.lit("number" if num is not None else "empty").alias("kind"), (num if num is not None else F.lit(None)).cast("double").alias("num"), (formula if formula is not None else F.lit(None)).cast("string").alias("formula"))
    body = s.select(F.explode(F.array(one(spot, 1, F.col("s_acctbal"), None), one(spot, 2, None, F.concat(F.lit("A"), spot, F.lit("*2"))), one(spot, 3, None, F.concat(F.lit("B"), spot, F.lit("+A"), spot)))).alias("c")).select("c.*")
    totals = t.spark.createDataFrame([(1, 5, "empty", None, f"SUM(A2:A{n})"), (2, 5, "empty", None, f"E1/COUNT(A2:A{n})")], body.schema)
    cells = body.unionByName(totals).select(F.lit("Book").alias("sheet"), "row", "col", "kind", "num", F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"), "formula")
    values, _ = evaluate(cells)
    return rounded(values.where("col > 1").select("row", "col", "num"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t: Tables):
    from lattica.streaming.events import windowed

    made = windowed(t.events, "ts", "1 day", ["event_type"], "value")
    return rounded(made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"))


@query("""
WITH b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g.g
""")
def event_sessions(t: Tables):
    from lattica.streaming.events import session_windows

    made = session_windows(t.events, "ts", "2 hours", ["user_id"], "value")
    return rounded(made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total"))


# ---------------------------------------------------------------- further document operators


@query("""
SELECT sha256(coalesce(html, '')) AS sha256, octet_length(encode(coalesce(html, '')))::BIGINT AS size, min(page_id || '.html') AS path, 'text/html' AS mime, count(DISTINCT page_id) AS sources
FROM pages GROUP BY 1, 2
""")
def payload_manifest(t: Tables):
    from lattica.sources.products import manifest

    files = t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return manifest(files).withColumn("sources", F.size("sources").cast("long"))


@query(f"WITH {_ITEMS_SQL}, s AS (SELECT doc_id, 9.0::DOUBLE + item % 3 AS s, sum(length(text)) AS n FROM i GROUP BY 1, 2) SELECT doc_id, s AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS r FROM s) WHERE r = 1")
def body_sizes(t: Tables):
    return layout.body_size(_items(t).withColumn("size", 9.0 + F.col("item") % 3), ["doc_id"])


@query(f"WITH {_ITEMS_SQL} SELECT doc_id, item::INT AS item FROM i")
def overlapping_items(t: Tables):
    """Each word set twice, the second a point aside: the second ones go."""
    first = _items(t)
    second = first.withColumn("item", F.col("item") + 100_000).withColumn("x", F.col("x") + 1).withColumn("end_x", F.col("end_x") + 1)
    return layout.overlaps(first.unionByName(second)).select("doc_id", "item")


@query(f"""
WITH {_ITEMS_SQL}, l AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS line, count(DISTINCT cell) AS n, string_agg(text, ' ' ORDER BY item) AS text FROM i GROUP BY doc_id, line)
SELECT doc_id, count(*) FILTER (WHERE n = 2) > 1 AS has_table, count(*) FILTER (WHERE n = 1) AS others FROM l GROUP BY doc_id
""")
def rebuilt_blocks(t: Tables):
    made = layout.to_blocks(_items(t))
    counted = made.groupBy("doc_id").agg((F.count_if(F.col("type") == "table") > 0).alias("has_table"), F.count_if((F.col("type") != "table") & (F.size(F.split("text", " ")) <= 3)).alias("others"))
    return counted


@query("SELECT p_partkey, p_name AS title, p_size AS page FROM part")
def toc_entries(t: Tables):
    return t.part.select("p_partkey", text.toc_entry(F.concat("p_name", F.lit(" ..... "), "p_size")).alias("entry")).select("p_partkey", "entry.*")


@query("""
WITH x AS (SELECT p_brand, p_size, p_size < lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS back FROM part)
SELECT p_brand, count(*) AS entries, min(p_size) = max(p_size) AS all_same, coalesce(bool_or(back), false) AS non_monotonic FROM x GROUP BY p_brand
""")
def toc_findings(t: Tables):
    return text.toc_findings(t.part, "p_brand", "p_partkey", "p_size")


@query("""
SELECT '/part[' || p_partkey || ']' AS path, u.m.severity AS severity, u.m.message AS message FROM part, unnest([CASE WHEN p_size * 10 + p_retailprice > 1300 THEN {'severity': 'warning', 'message': 'outside the page'} END, CASE WHEN p_size < 3 THEN {'severity': 'error', 'message': 'no size'} END]) u(m) WHERE u.m IS NOT NULL
""")
def element_rules(t: Tables):
    boxes = t.part.select(F.concat(F.lit("/part["), F.col("p_partkey").cast("string"), F.lit("]")).alias("path"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("name"), (F.col("p_size") * 10.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_retailprice").alias("w"), F.when(F.col("p_size") < 3, 0.0).otherwise(5.0).alias("h"))
    return quality.elements(boxes, 1300, 1000)


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN '' ELSE text END AS final, CASE role WHEN 'assistant' THEN '' ELSE text END AS original FROM conversations")
def tracked_changes(t: Tables):
    kind = F.when(F.col("role") == "user", "del").when(F.col("role") == "assistant", "ins").otherwise("keep")
    return t.conversations.select("conv_id", "turn", markdown.revised(F.col("text"), kind, "final").alias("final"), markdown.revised(F.col("text"), kind, "original").alias("original"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 4 || '. ' || role AS markdown FROM conversations")
def numbered_lists(t: Tables):
    return markdown.numbered(t.conversations, ["conv_id"], "turn", "role", start=5).select("conv_id", "turn", "markdown")


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'k: ' || CAST(round(v) AS BIGINT) || '%' WHEN 'view' THEN '**k**: 3 (+1)' WHEN 'error' THEN 'k: 3/5' WHEN 'signup' THEN '- k' ELSE 'k' END AS text FROM (SELECT *, 3 * 100 / 5.0 AS v FROM events)
""")
def deck_components(t: Tables):
    kind = F.create_map(*[F.lit(x) for x in ("click", "progress", "view", "kpi", "error", "rating", "signup", "timeline", "purchase", "text")])[F.col("event_type")]
    return t.events.select("event_id", markdown.component(kind, F.lit("k"), F.lit(3.0), F.lit(5.0), F.lit(1.0)).alias("text"))


@query("""
SELECT event_type, ts, user_id, n FROM (SELECT event_type, ts, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
""")
def first_events(t: Tables):
    made = windows.ordinals(t.events, ["user_id"], ["ts", "event_id"], "n").where("n = 1")
    return made.select("event_type", "ts", "user_id", F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- trees, forms, pages and paragraphs


def _tree(t: Tables):
    """Each conversation a slide whose turns hang from each other in pairs: turn n from turn (n - 1) / 2."""
    up = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    return t.conversations.select(F.col("conv_id").alias("page"), F.col("turn").alias("id"), up.cast("long").alias("up"), F.col("turn").alias("place"), F.col("role").alias("type"), F.concat(F.lit("n"), F.col("turn") % 3).alias("name"), "text")


_TREE_SQL = """e AS (SELECT conv_id AS page, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up, role AS type, 'n' || turn % 3 AS name, text FROM conversations),
n AS (SELECT *, type || '[' || row_number() OVER (PARTITION BY page, up, type ORDER BY id) || ']' AS step FROM e),
w AS (SELECT page, id, type, name, text, '/slide[' || page || ']/' || step AS path FROM n WHERE up IS NULL UNION ALL SELECT n.page, n.id, n.type, n.name, n.text, w.path || '/' || n.step FROM n JOIN w ON n.page = w.page AND n.up = w.id)"""


def _walked(t: Tables):
    return trees.walk(_tree(t), ["page"], F.concat(F.lit("/slide["), F.col("page").cast("string"), F.lit("]")))


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT page, id, path FROM w")
def tree_paths(t: Tables):
    return _walked(t).select("page", "id", "path")


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT path, type, name FROM w WHERE type = 'user' AND name = 'n2' AND contains(coalesce(text, ''), 'e')")
def deck_selector(t: Tables):
    return trees.select(_walked(t), 'user[name=n2]:contains("e")').select("path", "type", "name")


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT path, type FROM w WHERE page = 1 AND (path = '/slide[1]/user[1]' OR starts_with(path, '/slide[1]/user[1]/') OR path = '/slide[1]/system[1]' OR starts_with(path, '/slide[1]/system[1]/'))")
def path_get(t: Tables):
    """What hangs from the first turn of slide 1, whoever speaks there."""
    walked = _walked(t)
    return trees.get(walked, "/slide[1]/user[1]", below=True).unionByName(trees.get(walked, "/slide[1]/system[1]", below=True)).select("path", "type")


@query("SELECT p_partkey::INT + 2 AS row, 2 AS col, p_size::DOUBLE AS num FROM part WHERE p_partkey::INT + 2 BETWEEN 3 AND 9")
def workbook_path(t: Tables):
    return trees.cells_at(_part_cells(t), "/part/B3:B9").select("row", "col", "num")


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT page, type, count(*) AS fields FROM e WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.page = e.page AND c.up = e.id) GROUP BY 1, 2")
def form_field_counts(t: Tables):
    return trees.field_counts(trees.fields(_tree(t), ["page"]), ["page"])


@query("""
WITH RECURSIVE e AS (SELECT conv_id AS page, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up, 'n' || turn % 3 AS name FROM conversations),
w AS (SELECT page, id, name AS full_name FROM e WHERE up IS NULL UNION ALL SELECT e.page, e.id, w.full_name || '.' || e.name FROM e JOIN w ON e.page = w.page AND e.up = w.id)
SELECT page, id, full_name FROM w WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.page = w.page AND c.up = w.id)
""")
def form_fields(t: Tables):
    return trees.fields(_tree(t), ["page"]).select("page", "id", "full_name")


@query("SELECT page_id, url AS name, octet_length(encode(coalesce(html, '')))::BIGINT AS size, sha256(coalesce(html, '')) AS sha256 FROM pages")
def attachment_list(t: Tables):
    return trees.attachments(t.pages, "page_id", "url", "html")


@query("SELECT p_brand, p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS merged, p_brand || '_page' || CASE WHEN p_size < 1000 THEN lpad(p_size::VARCHAR, 3, '0') ELSE p_size::VARCHAR END || '.pdf' AS part FROM part")
def merged_and_split_pages(t: Tables):
    return trees.split_pages(trees.merged_pages(t.part, "p_brand", "p_partkey"), "p_brand", "p_size").select("p_brand", "p_partkey", "merged", "part")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS kept_as FROM part WHERE p_size >= 5")
def cleaned_pages(t: Tables):
    return trees.clean_pages(t.part, "p_brand", "p_partkey", F.col("p_size") < 5).select("p_brand", "p_partkey", "kept_as")


#: (style id, outline level, style name) and the class of each.
_STYLES = [
    (None, None, None, "Normal"), ("Header1", 0, "heading 1", "Normal"), ("S1", 2, "x", "Heading3"), ("S2", 8, "x", "Heading6"), ("S3", 9, "Heading 4", "Heading4"), ("S4", None, "My heading", "Heading1"), ("S5", None, "标题 2", "Heading2"),
    ("S6", None, "Title", "Title"), ("S7", None, "Subtitle", "Subtitle"), ("S8", None, "Figure Caption", "Caption"), ("S9", None, "Intense Quote", "Quote"), ("S10", None, "Source code", "Code"), ("S11", None, "TOC 1", "TOC"), ("Heading2", None, None, "Heading2"), ("Heading9", None, "x", "Heading6"), ("title", None, None, "Title"), ("Body", None, "Body", "Normal"),
]


@query(f"SELECT p_partkey, [{', '.join(repr(x[3]) for x in _STYLES)}][p_partkey % {len(_STYLES)} + 1] AS class FROM part")
def paragraph_classes(t: Tables):
    of = lambda k, kind: F.element_at(F.array(*(F.lit(x[k]).cast(kind) for x in _STYLES)), (F.col("p_partkey") % len(_STYLES) + 1).cast("int"))
    return t.part.select("p_partkey", trees.paragraph_class(of(0, "string"), of(1, "int"), of(2, "string")).alias("class"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_name, '- ' || p_type || ' x', '- ' || p_brand] WHEN 1 THEN []::VARCHAR[] ELSE ['- ' || p_type, '- 1234. ' || p_brand] END AS items FROM part
""")
def split_list_lines(t: Tables):
    k, join = F.col("p_partkey") % 3, F.concat_ws
    line = F.when(k == 0, join(" ", "p_name", F.lit("•"), "p_type", F.lit("x 2."), "p_brand")).when(k == 1, join(" ", F.lit("1."), "p_name")).otherwise(join(" ", F.lit("- 3)"), "p_type", F.lit("◦ 1234."), "p_brand"))
    items = F.transform(trees.list_segments(line), lambda s: F.concat(F.when(s["marked"], "- ").otherwise(""), s["text"]))
    return t.part.select("p_partkey", items.alias("items"))
