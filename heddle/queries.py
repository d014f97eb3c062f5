"""The registered queries of the relational engine, each with its SQL for comparison."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import google as g
from heddle.operators import patterns as mr
from heddle.operators import profile as pf
from heddle.operators import relational as rel
from heddle.plans import joinorder as jo
from heddle.plans import models as md
from heddle.session import load
from heddle.streaming import incremental as inc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query given as Spark SQL; tables are read and widened where the text names them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        used = {t: load(spark, folder, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        if not used:
            return spark.sql(text)
        return spark.sql(re.sub(r"\b(" + "|".join(used) + r")\b(?!\s*\()", r"{\1}", text), **used)

    QUERIES[name] = run
    ORACLE[name] = text if oracle is None else oracle


def query(name: str, oracle: str | None = None):
    """Registers a query given as a function of (load, spark), load giving a table."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, folder: f(lambda t: load(spark, folder, t))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


_MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"

# scans, projections, predicates

FLAGSHIP = f"""
    SELECT l_returnflag, l_linestatus, {_MONEY.format("l_quantity")} AS sum_qty, {_MONEY.format("l_extendedprice")} AS sum_base_price,
           ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
sql("q_scan_filter_agg", FLAGSHIP)
sql("q_projection_arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS q1, -l_tax AS neg_tax, l_orderkey % 7 AS m FROM lineitem")
sql("q_predicates_3vl", """
    SELECT event_id, CASE WHEN value > 50 AND event_type = 'click' THEN 1 WHEN value IS NULL THEN 2 ELSE 0 END AS c,
           NULLIF(event_type, 'error') AS n, COALESCE(NULLIF(event_type, 'click'), 'none') AS co, value BETWEEN 10 AND 20 AS b,
           event_type IN ('click', 'view') AS i, (NULLIF(event_type, 'error') IS DISTINCT FROM 'click') AS d, NOT (value > 3) AS nn
    FROM events""")
sql("q_like_any", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE ANY ('small%', '%ring') AND p_type NOT LIKE 'ECO%'", "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'small%' OR p_name LIKE '%ring') AND p_type NOT LIKE 'ECO%'")
sql("q_in_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("q_scalar_subquery", "SELECT p_partkey, p_retailprice > (SELECT AVG(p_retailprice) FROM part) AS above, (SELECT COUNT(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS n FROM part p")
sql("q_exists_correlated", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
sql("q_no_from", "SELECT 1 AS one, 7 / 2 AS half, 'a' || 'b' AS s, 5 & 3 AS band, 5 | 3 AS bor")
sql("q_cte_derived", "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS customers FROM a GROUP BY n) SELECT x.n, x.customers FROM (SELECT * FROM b WHERE n > 1) x")
sql("q_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("q_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (2, 'b')) AS t(k, v)")


@query("q_star_except_replace", "SELECT p_partkey, UPPER(p_name) AS p_name, p_brand, p_size * 2 AS p_size, p_retailprice FROM part")
def _(t):
    return rel.star(t("part"), ("p_type",), {"p_name": F.upper("p_name"), "p_size": F.col("p_size") * 2})


@query("q_year_range", "SELECT o_orderkey FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1998")
def _(t):
    return t("orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("q_parameters", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def _(t):
    return t("customer").sparkSession.sql("SELECT c_custkey, c_name FROM {c} WHERE c_acctbal > :least AND c_mktsegment = :segment", args={"least": 5000, "segment": "BUILDING"}, c=t("customer"))


# joins

sql("q_join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
sql("q_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
sql("q_join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
sql("q_join_full_using", "SELECT k, a, b FROM (SELECT o_custkey AS k, COUNT(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) x FULL JOIN (SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal > 0) y USING (k)")
sql("q_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("q_join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("q_join_nested", "SELECT n_name, r_name, s_suppkey FROM (nation JOIN region ON n_regionkey = r_regionkey) JOIN supplier ON s_nationkey = n_nationkey")
sql("q_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("q_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("q_join_star5", f"""
    SELECT n_name, {_MONEY.format("l_extendedprice")} AS revenue, COUNT(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""")


@query("q_unnest_offset", "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings")
def _(t):
    return rel.unnest(t("embeddings"), "embedding", "x", "pos").select("vec_id", "pos", F.col("x").cast("double").alias("x"))


@query("q_unnest_left", "SELECT doc_id, w FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [NULL] END) AS w FROM documents)")
def _(t):
    d = t("documents").withColumn("a", F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")))
    return rel.unnest(d, "a", "w", outer=True).select("doc_id", "w")


# aggregation

sql("q_group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL")
sql("q_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(GROUPING(o_orderpriority) AS INT) AS gp FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("q_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("q_groupingsets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("q_global_agg_empty", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderdate) AS m FROM orders WHERE o_orderkey < 0")
sql("q_countif", "SELECT event_type, COUNT_IF(value > 50) AS c, COUNT(DISTINCT user_id) AS u, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY event_type")
sql("q_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
sql("q_string_agg", "SELECT n_regionkey, LISTAGG(DISTINCT n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("q_max_by", "SELECT o_custkey, MAX_BY(o_orderkey, (o_orderkey % 1000) * 1000000 + o_orderkey) AS a, MIN_BY(o_orderkey, o_orderkey) AS b FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 1000) * 1000000 + o_orderkey) AS a, arg_min(o_orderkey, o_orderkey) AS b FROM orders GROUP BY o_custkey")
sql("q_bit_logical", "SELECT user_id % 10 AS k, BIT_AND(event_id) AS a, BIT_OR(event_id) AS o, BIT_XOR(event_id) AS x, BOOL_AND(value > 0) AS la, BOOL_OR(value > 99) AS lo FROM events GROUP BY 1")
sql("q_var_cov", "SELECT l_returnflag, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(STDDEV_SAMP(l_quantity), 6) AS ss, ROUND(STDDEV_POP(l_quantity), 6) AS sp, ROUND(COVAR_POP(l_quantity, l_tax), 6) AS cp, ROUND(COVAR_SAMP(l_quantity, l_tax), 6) AS cs, ROUND(CORR(l_quantity, l_extendedprice), 6) AS co FROM lineitem GROUP BY l_returnflag")
sql("q_filtered_agg", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_discount > 0.05) AS n, SUM(l_linenumber) FILTER (WHERE l_tax = 0) AS s FROM lineitem GROUP BY l_returnflag")
sql("q_avg_distinct", "SELECT p_brand, ROUND(AVG(DISTINCT p_size), 6) AS a, SUM(DISTINCT p_size) AS s FROM part GROUP BY p_brand")


@query("q_array_agg_ordered", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:3] AS first3 FROM orders GROUP BY o_custkey")
def _(t):
    return rel.top_array_agg(t("orders"), ["o_custkey"], F.col("o_orderkey"), [F.asc("o_orderkey")], 3, "first3")


@query("q_array_agg_nulls", "SELECT n_regionkey, list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(rel.array_agg(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("n_nationkey")).alias("names"))


@query("q_array_concat_agg", "SELECT n_regionkey, list_sort(flatten(list([n_name, CAST(n_nationkey AS VARCHAR)]))) AS a FROM nation GROUP BY n_regionkey")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_sort(F.flatten(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string"))))).alias("a"))


@query("q_any_value_having_max", "SELECT o_custkey, COUNT(*) AS n, MAX(o_orderkey) AS k FROM (SELECT *, MAX(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m GROUP BY o_custkey")
def _(t):
    return rel.having_extremum(t("orders"), ["o_custkey"], "o_orderdate").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))


@query("q_eager_aggregation", f"SELECT c_nationkey, {_MONEY.format('o_totalprice')} AS total, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def _(t):
    per = t("orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("s"), F.count("*").alias("c"))
    return per.join(t("customer"), per["o_custkey"] == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("s").cast("double").alias("total"), F.sum("c").alias("n"))


# windows

sql("q_window_rank", "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d, ROUND(PERCENT_RANK() OVER w, 9) AS p, ROUND(CUME_DIST() OVER w, 9) AS c, CAST(NTILE(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("q_window_frames_rows", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS s, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events")
sql("q_window_frames_range", "SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem")
sql("q_lag_lead", "SELECT o_orderkey, LAG(o_orderkey, 1, -1) OVER w AS prev, LEAD(o_orderkey, 2) OVER w AS next2, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("q_nth_ignore_nulls", "SELECT event_id, NTH_VALUE(CASE WHEN value > 50 THEN event_id END, 2) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM events", "SELECT event_id, NTH_VALUE(CASE WHEN value > 50 THEN event_id END, 2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM events")
sql("q_percentile_over", "SELECT DISTINCT p_brand, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY p_size) OVER (PARTITION BY p_brand) AS med FROM part", "SELECT p_brand, quantile_cont(p_size, 0.5) AS med FROM part GROUP BY p_brand")


@query("q_qualify_dedup", "SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def _(t):
    return rel.qualify(t("events"), rel.is_first(1, ["user_id"], F.desc("ts"), F.asc("event_id"))).select("user_id", "event_id")


@query("q_is_last", "SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2")
def _(t):
    return rel.qualify(t("events"), rel.is_last(2, ["user_id"], "event_id")).select("user_id", "event_id")


@query("q_count_distinct_over", "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(t):
    return t("orders").select("o_orderkey", rel.count_distinct_over(F.col("o_orderpriority"), ["o_custkey"]).cast("long").alias("n"))


# order, limit, sets

sql("q_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("q_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 7")
sql("q_order_nulls", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END DESC NULLS LAST, n_nationkey) AS r FROM nation")
sql("q_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("q_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("q_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("q_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("q_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("q_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
sql("q_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


@query("q_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, NULL::BIGINT AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = t("supplier").select(F.col("s_nationkey").alias("extra"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return rel.union_by_name(a, b, "full")


@query("q_union_corresponding_inner", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return rel.union_by_name(t("customer").withColumnRenamed("c_nationkey", "k"), t("supplier").withColumnRenamed("s_nationkey", "k"), "inner")


@query("q_recursive_distinct", "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3) % 50 FROM r) SELECT k FROM r")
def _(t):
    spark = t("region").sparkSession
    return rel.recursive_distinct(spark.range(1, 2).toDF("k"), lambda d: d.select(((F.col("k") * 3) % 50).alias("k")), lambda d: d.checkpoint())


# pivots, semi-structured


@query("q_pivot", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS F, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS O, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def _(t):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


sql("q_unpivot", "SELECT p_partkey, name, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (v FOR name IN (p_size, p_retailprice))", "SELECT p_partkey, name, v FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME name VALUE v)")
sql("q_json_value", "SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("q_struct_access", "SELECT s.a AS a, s.b.c AS c FROM (SELECT NAMED_STRUCT('a', n_name, 'b', NAMED_STRUCT('c', n_regionkey)) AS s FROM nation)", "SELECT n_name AS a, CAST(n_regionkey AS BIGINT) AS c FROM nation")
sql("q_pipe", "FROM orders |> WHERE o_orderstatus = 'F' |> EXTEND o_totalprice * 2 AS dbl |> AGGREGATE COUNT(*) AS n, MAX(dbl) AS m GROUP BY o_orderpriority |> WHERE n > 1 |> ORDER BY o_orderpriority", "SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice * 2) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority HAVING COUNT(*) > 1")
sql("q_tumbling_window", "SELECT window.start AS start, event_type, COUNT(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
sql("q_session_window", "SELECT user_id, session_window.start AS start, COUNT(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", """
    SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")

# scalar functions

@query("q_fn_string", r"""
    SELECT doc_id, substr(text, greatest(length(text) - 4, 1), 3) AS tail, string_split(source, 'c') AS parts, length(text) AS n, strlen(text) AS b, reverse(lang) AS rev,
           lpad(lang, 5, '*') AS lp, rpad(lang, 1, '*') AS rp, repeat(lang, 2) AS rep, replace(source, 'src', '$') AS repl, starts_with(source, 'src1') AS sw, ends_with(source, '9') AS ew,
           instr(source, 'r') AS ins, translate(lang, 'en', 'xy') AS tr, trim('  ' || lang || ' ') AS tm, upper(lang) AS up, left(text, 3) AS l3, right(source, 2) AS r2, ascii(lang) AS asc1,
           contains(lower(text), 'the of') AS cs, levenshtein(lang, source) AS ed FROM documents""")
def _(t):
    s, x = F.col("text"), F.col("source")
    return t("documents").select(
        "doc_id", g.substr(s, -5, 3).alias("tail"), g.split(x, "c").alias("parts"), F.length(s).cast("long").alias("n"), F.octet_length(s).cast("long").alias("b"), F.reverse("lang").alias("rev"),
        F.lpad("lang", 5, "*").alias("lp"), F.rpad("lang", 1, "*").alias("rp"), F.repeat("lang", 2).alias("rep"), F.replace(x, F.lit("src"), F.lit("$")).alias("repl"), g.starts_with(x, F.lit("src1")).alias("sw"), F.endswith(x, F.lit("9")).alias("ew"),
        g.instr(x, F.lit("r")).alias("ins"), F.translate("lang", "en", "xy").alias("tr"), F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("tm"), F.upper("lang").alias("up"), F.left(s, F.lit(3)).alias("l3"), F.right(x, F.lit(2)).alias("r2"), F.ascii("lang").alias("asc1"),
        g.contains_substr(s, "the of").alias("cs"), F.levenshtein("lang", x).cast("long").alias("ed"),
    )


sql("q_fn_regexp", r"SELECT doc_id, REGEXP_LIKE(source, '^src[0-9]$') AS c, REGEXP_EXTRACT(source, '([0-9]+)', 1) AS e, REGEXP_REPLACE(source, '[0-9]', '#') AS r, SIZE(REGEXP_EXTRACT_ALL(text, '(an)', 1)) AS n FROM documents", r"SELECT doc_id, regexp_matches(source, '^src[0-9]$') AS c, regexp_extract(source, '([0-9]+)', 1) AS e, regexp_replace(source, '[0-9]', '#', 'g') AS r, CAST(len(regexp_extract_all(text, 'an')) AS INT) AS n FROM documents")


@query("q_fn_hash_encode", "SELECT doc_id, md5(text) AS md, sha1(text) AS s1, sha256(text) AS s2, to_base64(encode(lang)) AS b64, lower(hex(source)) AS hx, ord(lang) AS cp, chr(65 + CAST(doc_id % 26 AS INT)) AS ch FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5("text").alias("md"), F.sha1("text").alias("s1"), F.sha2("text", 256).alias("s2"), F.base64(F.encode("lang", "UTF-8")).alias("b64"), g.to_hex(F.col("source")).alias("hx"), g.code_points(F.col("lang"))[0].cast("int").alias("cp"), F.char(65 + F.col("doc_id") % 26).alias("ch"))


@query("q_fn_math", """
    SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 9) AS ln_, round(sqrt(l_extendedprice), 9) AS sq, round(exp(l_discount), 9) AS ex, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_tax) AS BIGINT) AS ce, sign(l_tax) AS sg,
           abs(-l_quantity) AS ab, pow(l_linenumber, 2) AS pw, CAST(trunc(l_extendedprice / 7) AS DOUBLE) AS tr, CAST(round(l_quantity / 4, 0) AS BIGINT) AS ri, round(sin(l_quantity) + cos(l_tax) + tan(0.1) + atan2(l_tax, 1), 9) AS tg, l_orderkey // 7 AS dv,
           CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 6) END AS sd, CASE WHEN l_tax = 0 THEN 'inf' ELSE 'finite' END AS ie, bit_count(l_orderkey) AS bc, round(cbrt(l_quantity), 9) AS cb FROM lineitem""")
def _(t):
    q, p, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.ln(q), 9).alias("ln_"), F.round(F.sqrt(p), 9).alias("sq"), F.round(F.exp("l_discount"), 9).alias("ex"), F.floor(p).alias("fl"), F.ceil(x).alias("ce"), F.sign(x).cast("tinyint").alias("sg"),
        F.abs(-q).alias("ab"), F.pow("l_linenumber", F.lit(2)).alias("pw"), g.trunc(p / 7).alias("tr"), g.to_int64(q / 4).alias("ri"), F.round(F.sin(q) + F.cos(x) + F.tan(F.lit(0.1)) + F.atan2(x, F.lit(1.0)), 9).alias("tg"), g.div(F.col("l_orderkey"), F.lit(7).cast("long")).alias("dv"),
        F.round(g.safe_divide(q, x), 6).alias("sd"), F.when(F.abs(g.ieee_divide(q, x)) == float("inf"), "inf").otherwise("finite").alias("ie"), F.bit_count("l_orderkey").cast("tinyint").alias("bc"), F.round(F.cbrt(q), 9).alias("cb"),
    )


@query("q_fn_null_extremes", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE greatest(n_nationkey, n_regionkey) END::BIGINT AS gr, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE least(n_nationkey, n_regionkey) END::BIGINT AS le, CAST((n_nationkey >= 5)::INT + (n_nationkey >= 10)::INT + (n_nationkey >= 20)::INT AS BIGINT) AS rb FROM nation")
def _(t):
    k = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    return t("nation").select("n_nationkey", g.greatest(k, F.col("n_regionkey")).alias("gr"), g.least(k, F.col("n_regionkey")).alias("le"), g.range_bucket(F.col("n_nationkey"), F.array(F.lit(5), F.lit(10), F.lit(20))).alias("rb"))


@query("q_fn_date", """
    SELECT o_orderkey, date_diff('day', DATE '1998-01-01', o_orderdate::DATE) AS dd, date_diff('month', DATE '1998-01-31', o_orderdate::DATE) AS dm, date_diff('year', DATE '1997-12-31', o_orderdate::DATE) AS dy,
           date_trunc('month', o_orderdate::DATE)::DATE AS tm, (o_orderdate::DATE - CAST(dayofweek(o_orderdate) AS INT))::DATE AS tw, last_day(o_orderdate::DATE) AS ld, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS am,
           CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS dy2, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(o_orderdate::DATE - DATE '1970-01-01' AS INT) AS ud FROM orders""")
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select(
        "o_orderkey", g.date_diff(d, F.lit("1998-01-01").cast("date"), "DAY").alias("dd"), g.date_diff(d, F.lit("1998-01-31").cast("date"), "MONTH").alias("dm"), g.date_diff(d, F.lit("1997-12-31").cast("date"), "YEAR").alias("dy"),
        g.date_trunc(d, "MONTH").alias("tm"), g.date_trunc(d, "WEEK").alias("tw"), F.last_day(d).alias("ld"), g.date_add(d, 1, "MONTH").alias("am"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.dayofyear(d).alias("dy2"), F.date_format(d, "yyyy/MM/dd").alias("f"), F.unix_date(d).alias("ud"),
    )


@query("q_fn_timestamp", "SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 12:00:00')) / 3600000000.0) AS BIGINT) AS dh, date_trunc('hour', ts) AS th, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", F.unix_micros(ts).alias("us"), F.unix_millis(ts).alias("ms"), F.unix_seconds(ts).alias("s"), g.timestamp_diff(ts, F.lit("2024-01-01 12:00:00").cast("timestamp"), "HOUR").alias("dh"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("th"), g.bucket(ts, 900).cast("timestamp_ntz").alias("b"))


@query("q_fn_array", """
    SELECT n_nationkey, [n_nationkey, n_regionkey, 7::BIGINT] AS a, list_reverse([n_nationkey, n_regionkey, 7::BIGINT]) AS r, ([n_nationkey, n_regionkey, 7::BIGINT])[2:3] AS sl, len(list_distinct([n_nationkey, n_regionkey, 7])) = 3 AS di, range(0, n_regionkey::BIGINT + 1, 2) AS ga,
           list_concat([n_nationkey::BIGINT], [n_regionkey::BIGINT]) AS cc, array_to_string([n_name, 'x'], '-') AS ts, [x * 2 FOR x IN [n_nationkey::BIGINT, n_regionkey]] AS tf, [x FOR x IN [n_nationkey::BIGINT, n_regionkey] IF x > 2] AS fl, n_nationkey = 7 OR n_regionkey = 7 AS inc FROM nation""")
def _(t):
    a = F.array("n_nationkey", "n_regionkey", F.lit(7).cast("long"))
    two = F.array("n_nationkey", "n_regionkey")
    return t("nation").select(
        "n_nationkey", a.alias("a"), F.reverse(a).alias("r"), g.array_slice(a, 1, 2).alias("sl"), g.array_is_distinct(a).alias("di"), g.generate_array(F.lit(0).cast("long"), F.col("n_regionkey"), 2).alias("ga"), F.concat(F.array("n_nationkey"), F.array("n_regionkey")).alias("cc"),
        g.array_to_string(F.array("n_name", F.lit("x")), "-").alias("ts"), F.transform(two, lambda x: x * 2).alias("tf"), F.filter(two, lambda x: x > 2).alias("fl"), F.array_contains(two, F.lit(7).cast("long")).alias("inc"),
    )


@query("q_fn_vector", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS d, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS c FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(t):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = e.where("vec_id = 0").select(F.col("e").alias("o"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(g.euclidean_distance(F.col("e"), F.col("o")), 4).alias("d"), F.round(g.cosine_distance(F.col("e"), F.col("o")), 4).alias("c"))


sql("q_fn_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS STRING) AS s, TRY_CAST(l_returnflag AS BIGINT) AS n, CAST(l_shipdate AS DATE) AS d, CAST('12.5' AS DOUBLE) AS x, CAST(l_discount AS DECIMAL(9,2)) AS dec FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS VARCHAR) AS s, TRY_CAST(l_returnflag AS BIGINT) AS n, CAST(l_shipdate AS DATE) AS d, CAST('12.5' AS DOUBLE) AS x, CAST(l_discount AS DECIMAL(9,2)) AS dec FROM lineitem")


# jobs over tables


def _profile_oracle(table: str, numeric: list[str], text: list[str]) -> str:
    parts = []
    for c in numeric:
        parts.append(f"SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct_values, MIN({c})::DOUBLE AS min_number, MAX({c})::DOUBLE AS max_number, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS stddev, quantile_cont({c}::DOUBLE, 0.5) AS median, NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, COUNT(DISTINCT {c}) = COUNT(*) AS is_unique FROM {table}")
    for c in text:
        parts.append(f"SELECT '{c}', COUNT(*), COUNT(*) - COUNT({c}), COUNT(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, MIN(LENGTH({c})), MAX(LENGTH({c})), COUNT(DISTINCT {c}) = COUNT(*) FROM {table}")
    return " UNION ALL ".join(parts)


@query("q_profile_orders", _profile_oracle("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]))
def _(t):
    p = pf.profile(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    return p.select("column_name", "rows", "nulls", "distinct_values", "min_number", "max_number", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "median", "min_length", "max_length", "is_unique")


@query("q_top_values", "SELECT o_orderpriority AS value, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _(t):
    return pf.top_values(t("orders"), "o_orderpriority", 3)


_H = "CAST(SUM(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)) AS VARCHAR)"


@query("q_fingerprint", " UNION ALL ".join(f"SELECT '{n}' AS column_name, COUNT(*) AS row_count, {_H.format(v)} AS checksum FROM customer" for n, v in (("*", "c_custkey::VARCHAR || chr(31) || c_mktsegment || chr(31) || c_name"), ("c_custkey", "c_custkey::VARCHAR"), ("c_mktsegment", "c_mktsegment"), ("c_name", "c_name"))))
def _(t):
    return pf.fingerprint(t("customer"), ["c_custkey", "c_name", "c_mktsegment"], "md5")


@query("q_fingerprint_compare", "SELECT * FROM (VALUES ('*', false), ('o_orderkey', true), ('o_orderstatus', false)) AS v(column_name, matches)")
def _(t):
    before = t("orders").select("o_orderkey", "o_orderstatus")
    after = before.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 5, "X").otherwise(F.col("o_orderstatus")))
    return pf.compare_fingerprints(pf.fingerprint(before), pf.fingerprint(after))


@query("q_diff_keyed", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'removed' WHEN c_custkey % 10 = 1 THEN 'changed' END AS change, CASE WHEN c_custkey % 10 = 1 THEN 'c_acctbal,c_name' END AS changed_columns FROM customer WHERE c_custkey % 10 < 2")
def _(t):
    before = t("customer")
    hit = F.col("c_custkey") % 10 == 1
    after = before.where("c_custkey % 10 <> 0").withColumns({"c_acctbal": F.when(hit, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_name": F.when(hit, F.lit("x")).otherwise(F.col("c_name"))})
    return pf.diff_keyed(before, after, ["c_custkey"])


@query("q_diff_bags", "SELECT k, SUM(d)::BIGINT AS difference FROM (SELECT c_nationkey AS k, -1 AS d FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY k HAVING SUM(d) <> 0")
def _(t):
    return pf.diff_bags(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@query("q_violations", "SELECT 'not_null(o_custkey)' AS rule, (SELECT COUNT(*) FROM orders WHERE o_custkey IS NULL) AS n UNION ALL SELECT 'unique(o_custkey)', (SELECT COUNT(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1)) UNION ALL SELECT 'foreign(o_custkey)', (SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 100))")
def _(t):
    return pf.violations(t("orders"), ["o_custkey"], [["o_custkey"]], [("o_custkey", t("customer").where("c_custkey > 100"), "c_custkey")])


@query("q_tie_sites", "SELECT o_custkey, o_orderdate, COUNT(*) AS count FROM orders GROUP BY ALL HAVING COUNT(*) > 1")
def _(t):
    return pf.row_order(t("orders"), ["o_custkey", "o_orderdate"])


@query("q_join_statistics", "WITH c AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1), h AS (SELECT * FROM c ORDER BY n DESC, k LIMIT 20) SELECT 'v' || k AS bin, n, 1::BIGINT AS distinct_values FROM h UNION ALL SELECT 'r0', SUM(n)::BIGINT, COUNT(*) FROM c WHERE k NOT IN (SELECT k FROM h)")
def _(t):
    return pf.key_bins(t("orders"), "o_custkey", heavy=20, bins=1)


@query("q_join_order", f"SELECT n_name, COUNT(*) AS n, {_MONEY.format('l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000 AND n_regionkey = 2 GROUP BY n_name")
def _(t):
    q = jo.JoinQuery(
        {n: t(n) for n in ("lineitem", "orders", "customer", "supplier", "nation")},
        [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey")],
        {"orders": F.col("o_totalprice") > 200000, "nation": F.col("n_regionkey") == 2},
    )
    _, plan = jo.optimize(q, jo.Statistics.collect(q))
    return jo.emit(q, plan).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("revenue"))


@query("q_view_reuse", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
def _(t):
    summary = t("lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return md.roll_up(summary, ["l_returnflag"], {"n": "count", "s": "sum", "lo": "min", "hi": "max"})


_PIPELINE = {
    "m_orders": "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice * 2 AS twice, o_orderstatus AS status FROM s_orders",
    "m_customers": "SELECT c_custkey AS c, c_name AS name FROM s_customer",
    "m_joined": "SELECT m_customers.name AS who, SUM(m_orders.twice) AS total FROM m_orders JOIN m_customers ON m_orders.c = m_customers.c GROUP BY m_customers.name",
}


@query("q_column_lineage", "SELECT * FROM (VALUES ('m_orders','k','o_orderkey'),('m_orders','c','o_custkey'),('m_orders','twice','o_totalprice'),('m_orders','status','o_orderstatus'),('m_customers','c','c_custkey'),('m_customers','name','c_name'),('m_joined','who','c_name'),('m_joined','total','o_totalprice')) AS v(model, column_name, source)")
def _(t):
    t("orders").createOrReplaceTempView("s_orders")
    t("customer").createOrReplaceTempView("s_customer")
    return md.Pipeline(_PIPELINE).columns(t("orders").sparkSession)


@query("q_impact", "SELECT * FROM (VALUES ('s_orders', 0), ('m_orders', 1), ('m_joined', 2)) AS v(node, distance)")
def _(t):
    return md.reach(md.Pipeline(_PIPELINE).edges(t("region").sparkSession), ["s_orders"])


@query("q_cost_attribution", "WITH p AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'm_orders' ELSE 'm_joined' END AS model, event_id AS bytes, user_id AS slot_ms FROM events) SELECT model, COUNT(*) AS runs, SUM(bytes)::BIGINT AS bytes, SUM(slot_ms)::BIGINT AS slot_ms, ROUND(SUM(bytes) / (SELECT SUM(bytes) FROM p), 6) AS share, CASE WHEN model = 'm_orders' THEN 1 ELSE 0 END::BIGINT AS feeds FROM p GROUP BY model")
def _(t):
    jobs = t("events").select(F.when(F.col("event_type").isin("click", "view"), "m_orders").otherwise("m_joined").alias("target"), F.col("event_id").alias("bytes"), F.col("user_id").alias("slot_ms"))
    return md.attribute_costs(jobs, md.Pipeline(_PIPELINE).edges(jobs.sparkSession))


# incremental and streaming


def _batches(events: DataFrame, n: int = 4) -> list[DataFrame]:
    return [events.where(F.pmod(F.col("event_id"), F.lit(n)) == i) for i in range(n)]


@query("q_incremental_replay", "SELECT user_id, COUNT(*) AS n, MAX(event_id) AS last_event FROM events GROUP BY user_id")
def _(t):
    full = lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    return inc.replay(inc.Model(full, inc.reaggregate_groups(["user_id"], full)), _batches(t("events")), lambda d: d.checkpoint())[0]


@query("q_incremental_dedup", "SELECT user_id, MAX(event_id) AS event_id FROM events GROUP BY user_id")
def _(t):
    full = lambda d: d.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    step = inc.newest_for_key(["user_id"], F.desc("event_id"))
    return inc.replay(inc.Model(full, step), _batches(t("events")), lambda d: d.checkpoint())[0]


@query("q_merge_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 5.0")
def _(t):
    target = t("customer").select("c_custkey", "c_acctbal")
    source = target.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)).union(target.sparkSession.createDataFrame([(-1, 5.0)], target.schema))
    return rel.upsert(target, source, ["c_custkey"])


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")


def _state(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root}/heddle-streams/{uuid.uuid4().hex}"


def _streaming_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = inc.windowed_counts(_stream(spark, folder).withColumn("t", F.col("ts").cast("timestamp")), "t", ["event_type"], "1 hour", "1 day")
    out = inc.run_once(counts, f"counts_{uuid.uuid4().hex}", _state(spark), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


QUERIES["q_streaming_window"] = _streaming_counts
ORACLE["q_streaming_window"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL"


def _streaming_dedup(spark: SparkSession, folder: str) -> DataFrame:
    stream = _stream(spark, folder).withColumn("t", F.col("ts").cast("timestamp"))
    out = inc.run_once(inc.deduplicated(stream, "t", ["event_id"], "1 hour").select("event_id", "user_id"), "dedup", _state(spark))
    return out


QUERIES["q_streaming_dedup"] = _streaming_dedup
ORACLE["q_streaming_dedup"] = "SELECT DISTINCT event_id, user_id FROM events"

# more functions and forms

sql("q_fn_json", "SELECT event_id, SIZE(JSON_OBJECT_KEYS(props)) AS n_keys, GET_JSON_OBJECT(props, '$.missing') AS m, TO_JSON(NAMED_STRUCT('e', event_id)) AS j, CAST(VARIANT_GET(PARSE_JSON(props), '$.k', 'int') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n_keys, json_extract_string(props, '$.missing') AS m, '{\"e\":' || event_id || '}' AS j, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
sql("q_fn_net", "SELECT page_id, PARSE_URL(url, 'HOST') AS host FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
sql("q_fn_null_handling", "SELECT n_nationkey, NULLIFZERO(n_regionkey) AS nz, ZEROIFNULL(NULLIF(n_regionkey, 2)) AS zn, IF(n_regionkey > 2, 'hi', 'lo') AS f, IFNULL(NULLIF(n_name, 'NATION_3'), '-') AS i FROM nation", "SELECT n_nationkey, CAST(NULLIF(n_regionkey, 0) AS BIGINT) AS nz, CAST(COALESCE(NULLIF(n_regionkey, 2), 0) AS BIGINT) AS zn, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS f, COALESCE(NULLIF(n_name, 'NATION_3'), '-') AS i FROM nation")
sql("q_fn_trig", "SELECT l_orderkey, l_linenumber, ROUND(SINH(l_tax) + COSH(l_tax) + TANH(l_tax) + ASIN(l_tax) + ACOS(l_tax) + ATAN(l_tax), 9) AS a, ROUND(DEGREES(l_tax) + RADIANS(l_quantity), 9) AS d, ROUND(LOG(2, l_quantity) + LOG10(l_quantity), 9) AS lg, ROUND(COT(l_quantity) + SEC(l_tax) + CSC(l_quantity), 6) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, round(sinh(l_tax) + cosh(l_tax) + tanh(l_tax) + asin(l_tax) + acos(l_tax) + atan(l_tax), 9) AS a, round(degrees(l_tax) + radians(l_quantity), 9) AS d, round(log2(l_quantity) + log10(l_quantity), 9) AS lg, round(cot(l_quantity) + 1 / cos(l_tax) + 1 / sin(l_quantity), 6) AS c FROM lineitem")


@query("q_fn_safe", "SELECT l_orderkey, l_linenumber, l_tax = 0 AS z, NULL::BIGINT AS a, l_orderkey * 2 AS m, l_orderkey - 1 AS s, [1, 2][l_linenumber] AS e FROM lineitem")
def _(t):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.try_divide("l_quantity", "l_tax").isNull().alias("z"), g.safe_add(F.lit(2**63 - 1), line).alias("a"), g.safe_multiply(key, F.lit(2)).alias("m"), g.safe_subtract(key, F.lit(1)).alias("s"),
        F.try_element_at(F.array(F.lit(1), F.lit(2)), line.cast("int")).alias("e"),
    )


sql("q_fn_parse_format", "SELECT o_orderkey, TO_DATE(DATE_FORMAT(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS d, DATE_FORMAT(o_orderdate, 'EEEE') AS w, MAKE_DATE(2024, CAST(o_orderkey % 12 + 1 AS INT), 1) AS m, MONTHS_BETWEEN(DATE '2024-03-01', DATE '2024-01-01') AS mb FROM orders", "SELECT o_orderkey, o_orderdate::DATE AS d, dayname(o_orderdate) AS w, make_date(2024, (o_orderkey % 12 + 1)::BIGINT, 1) AS m, 2.0 AS mb FROM orders")
sql("q_multi_unpivot", "SELECT s_suppkey, kind, k, v FROM supplier UNPIVOT ((k, v) FOR kind IN ((s_nationkey, s_acctbal) AS a, (s_suppkey2, s_acctbal2) AS b))".replace("FROM supplier", "FROM (SELECT s_suppkey, s_nationkey, s_acctbal, s_suppkey * 2 AS s_suppkey2, s_acctbal * 2 AS s_acctbal2 FROM supplier)"), "SELECT s_suppkey, 'a' AS kind, s_nationkey::BIGINT AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', s_suppkey * 2, s_acctbal * 2 FROM supplier")
sql("q_not_in_null_aware", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE r_regionkey END FROM region)", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE r_regionkey END FROM region)")
sql("q_range_overlap", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate + INTERVAL 10 DAYS AND b.o_orderdate < a.o_orderdate + INTERVAL 10 DAYS", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate + INTERVAL 10 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 10 DAY")
sql("q_sliding_window", "SELECT window.end AS e, COUNT(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')", "SELECT e, COUNT(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOUR]) AS e FROM events) GROUP BY e")


@query("q_having_min_any", "SELECT p_brand, SUM(p_size)::BIGINT AS s, COUNT(*) AS n FROM (SELECT *, MIN(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_retailprice = m GROUP BY p_brand")
def _(t):
    return rel.having_extremum(t("part"), ["p_brand"], "p_retailprice", largest=False).groupBy("p_brand").agg(F.sum("p_size").alias("s"), F.count(F.lit(1)).alias("n"))


@query("q_approx_sketches", "SELECT COUNT(*) > 0 AS close FROM events")
def _(t):
    e = t("events")
    exact = e.agg(F.countDistinct("user_id").alias("n"))
    return e.agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("h"), F.approx_count_distinct("user_id").alias("a")).join(F.broadcast(exact)).select(((F.abs(F.col("h") - F.col("n")) < F.col("n") * 0.1 + 2) & (F.abs(F.col("a") - F.col("n")) < F.col("n") * 0.2 + 2)).alias("close"))


@query("q_match_recognize", None)
def _(t):
    e = t("events")
    return mr.match_recognize(e, ["user_id"], ["ts"], {"e": F.col("event_type") == "error", "c": F.col("event_type") == "click"}, "e+c", "event_id")


@query("q_align", "SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS period_end, event_type, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY ALL")
def _(t):
    return mr.align(t("events"), "ts", ["event_type"], "1 hour", "1 hour", n=F.count(F.lit(1)), last=F.max("event_id"))


@query("q_sql_function", "SELECT p_partkey, p_retailprice * 1.19 AS gross FROM part")
def _(t):
    spark = t("part").sparkSession
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION heddle_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.19")
    return spark.sql("SELECT p_partkey, heddle_gross(p_retailprice) AS gross FROM {p}", p=t("part"))


@query("q_asof_join", "SELECT o_orderkey, (SELECT MAX(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS before FROM orders o")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").cast("timestamp").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    return t("orders").select("o_orderkey", F.max("o_orderdate").over(w).alias("before"))


from heddle import function_queries  # noqa: E402, F401  registers more
