"""The catalogue of queries: each operator over the driver's tables, with the same statement in SQL.

``QUERIES`` maps a name to a function of (session, folder); ``SQL`` has the
equivalent DuckDB statement for all but stateful folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import periodic_weight
from ..functions.generators import jump, lcg_at, lcg_fold
from ..operators import attach, consensus, cuts, epoch, kernels, ranges, reduce, space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    """Exact sums need decimals."""
    return F.col(c).cast("decimal(18,2)")


# --- index spaces -----------------------------------------------------------

#: The owner of a dense key among 7 parts, for n rows.
_OWNER = "CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE (n % 7) + (k - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END"


@query(f"""
WITH t AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey AS k, o_totalprice, n FROM orders, t)
SELECT CAST({_OWNER} AS INTEGER) AS part, min(k) AS first_i, max(k) AS last_i, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM r GROUP BY 1""")
def block_partition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    part = space.owner(F.col("o_orderkey"), orders.count(), 7)
    return orders.groupBy(part.alias("part")).agg(
        F.min("o_orderkey").alias("first_i"), F.max("o_orderkey").alias("last_i"), F.count("*").alias("n_rows"), F.sum(money("o_totalprice")).cast("double").alias("total")
    )


@query("""
SELECT p_partkey // 50 AS y, count(*) AS n_cells, CAST(sum(p_size) AS BIGINT) AS total_size, max(p_partkey % 50) AS last_x
FROM part GROUP BY 1""")
def nd_collapse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    y, x = space.decode(F.col("p_partkey"), [part.count() // 50, 50])
    return part.select(y.alias("y"), x.alias("x"), "p_size").groupBy("y").agg(F.count("*").alias("n_cells"), F.sum("p_size").alias("total_size"), F.max("x").alias("last_x"))


@query("""
SELECT range AS i, 2 + range // 20 AS a, (range // 4) % 5 AS b, 7 + range % 4 AS c FROM range(0, 60)""")
def nd_loop(spark, sf_dir):
    return space.loop_nd(spark, [2, 0, 7], [5, 5, 11], ["a", "b", "c"])


@query("""
SELECT c_custkey AS i, round(1000 * (sin(a) * cos(b) + sqrt(a * b)), 4) AS c
FROM (SELECT c_custkey, o_totalprice / 1000 + 1 AS a, abs(c_acctbal) / 1000 + 1 AS b FROM orders JOIN customer ON o_orderkey = c_custkey)""")
def elementwise(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1000 + 1).alias("a"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (F.abs("c_acctbal") / 1000 + 1).alias("b"))
    return space.bind(left, right).select("i", F.round(kernels.elementwise(F.col("a"), F.col("b")), 4).alias("c"))


@query("SELECT range AS i, round(1000 * (sin(range + 1.0::DOUBLE) * cos(200.0::DOUBLE - range) + sqrt((range + 1.0::DOUBLE) * (200.0::DOUBLE - range))), 4) AS c FROM range(0, 200)")
def vector(spark, sf_dir):
    return kernels.vector_workload(spark).select("i", F.round("c", 4).alias("c"))


@query("""SELECT range // 50 AS y, range % 50 AS x, round(1000 * (sin(range + 1.0::DOUBLE) * cos(200.0::DOUBLE - range) + sqrt((range + 1.0::DOUBLE) * (200.0::DOUBLE - range))), 4) AS c FROM range(0, 200)""")
def vector_nd(spark, sf_dir):
    """The vector workload over nested loops of 4 by 50."""
    return kernels.vector_nd_workload(spark).select("y", "x", F.round("c", 4).alias("c"))


# --- contractions -----------------------------------------------------------


@query(f"""
WITH t AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id AS k, embedding, n FROM embeddings, t)
SELECT k AS i, CAST({_OWNER} AS INTEGER) AS part,
       round(list_sum(list_transform(range(0, 64), lambda c: CAST(embedding[c + 1] AS DOUBLE) * (1 + (c & 3) * 0.25::DOUBLE))), 6) AS y
FROM e""")
def matvec(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row"))
    x = [1 + (c & 3) * 0.25 for c in range(64)]
    rows = kernels.matvec(vectors, x)
    return rows.select("i", space.owner(F.col("i"), vectors.count(), 7).alias("part"), F.round("y", 6).alias("y"))


@query("SELECT r.range AS i, c.range AS j, (r.range + 1) * 60.0::DOUBLE AS v FROM range(0, 120) r, range(0, 40) c")
def matmat(spark, sf_dir):
    """The dense workload: all cells of the product."""
    a = space.loop_nd(spark, [0, 0], [120, 60], ["r", "k"]).select(F.col("r").alias("i"), "k", (F.col("r") + 1.0).alias("v"))
    b = space.loop_nd(spark, [0, 0], [60, 40], ["k", "j"]).select("k", "j", F.lit(1.0).alias("v"))
    return kernels.matmul(a, b)


_COO = "SELECT l_suppkey AS r, l_partkey AS c, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2"


#: Rows of lineitem that a task of the MatrixMarket query sums: so many up to 200 tasks, to which a shuffle deals without sorting, and the most beyond.
TASK_ROWS = (1 << 19, 1 << 21)


def lineitem_matrix(spark: SparkSession, sf_dir: str, task_rows: tuple[int, int] | None = None) -> DataFrame:
    """Coordinates (supplier, part, quantity) with whole values; ``task_rows`` bounds the rows that a task sums."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c"), F.col("l_quantity").cast("long").alias("v"))
    if task_rows:  # dealt before they are summed: hardly a pair repeats, and sums of a whole file split would be held at once
        total = rows.count()
        fair, most = (-(-total // n) for n in task_rows)
        rows = rows.repartition(max(1, min(fair, 200), most), "r", "c")
    return rows.groupBy("r", "c").agg(F.sum("v").alias("v"))


@query(f"""
WITH a AS ({_COO})
SELECT r AS i, p_size AS j, CAST(sum(v * (p_size % 5)) AS BIGINT) AS v
FROM a JOIN part ON c = p_partkey WHERE v <> 0 AND p_size % 5 <> 0 GROUP BY 1, 2""")
def matmat_sparse(spark, sf_dir):
    a = lineitem_matrix(spark, sf_dir).select(F.col("r").alias("i"), F.col("c").alias("k"), "v")
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("j"), (F.col("p_size") % 5).cast("long").alias("v"))
    return kernels.matmul(a, b, skip_zeros=True)


@query("""
WITH e AS (SELECT r.range AS i, k.range AS k FROM range(0, 1000) r, range(0, 500) k),
a AS (SELECT i, (13 * i + 7 * k) % 1000 AS c, arg_max(0.5::DOUBLE + ((i + k) % 11) * 0.2::DOUBLE, k) AS v FROM e GROUP BY 1, 2),
b AS (SELECT i AS r, (17 * i + 5 * k) % 1000 AS j, arg_max(0.3::DOUBLE + ((i + k) % 7) * 0.15::DOUBLE, k) AS w FROM e GROUP BY 1, 2)
SELECT i, j, round(sum(v * w), 6) AS v FROM a JOIN b ON c = r GROUP BY 1, 2""")
def sparse_workload(spark, sf_dir):
    a, b = kernels.sparse_operands(spark, 1000, 1000, 1000, 500)
    return kernels.matmul(a, b, skip_zeros=True).select("i", "j", F.round("v", 6).alias("v"))


@query(f"SELECT r, CAST(sum(v * (1 + (c & 3) * 0.25::DOUBLE)) AS DOUBLE) AS y FROM ({_COO}) GROUP BY 1")
def spmv(spark, sf_dir):
    return kernels.spmv(lineitem_matrix(spark, sf_dir))


@query(f"SELECT r, CAST(sum(v * (p_size + (p_partkey % 8) / 8.0::DOUBLE)) AS DOUBLE) AS y FROM ({_COO}) JOIN part ON c = p_partkey GROUP BY 1")
def spmv_gather(spark, sf_dir):
    """A vector that is a table, met by column."""
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"), (F.col("p_size") + F.col("p_partkey") % 8 / 8.0).alias("x"))  # eighths: sums are exact
    return kernels.spmv(lineitem_matrix(spark, sf_dir), x)


@query(f"SELECT r, c::INTEGER AS c, v::FLOAT AS v FROM ({_COO})")
def mtx_round_trip(spark, sf_dir):
    """The matrix as a folder of MatrixMarket lines, a file a task, written and read back."""
    from ..sources import mtx
    from .store import cut, new_path

    cells = cut(lineitem_matrix(spark, sf_dir, TASK_ROWS))  # counted and written from one table
    path = new_path(spark, "matrix")
    mtx.write_mtx(cells, table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count(), path)
    return mtx.read_mtx(spark, path)


@query(f"""
WITH s AS (SELECT s_suppkey AS r FROM supplier), d AS (SELECT r, count(*) AS nnz FROM ({_COO}) GROUP BY 1),
f AS (SELECT s.r, coalesce(nnz, 0) AS nnz FROM s LEFT JOIN d ON s.r = d.r)
SELECT r, nnz, CAST(sum(nnz) OVER (ORDER BY r) - nnz AS BIGINT) AS row_start, CAST(sum(nnz) OVER (ORDER BY r) AS BIGINT) AS row_end FROM f""")
def csr_build(spark, sf_dir):
    return attach.csr_offsets(lineitem_matrix(spark, sf_dir), table(spark, sf_dir, "supplier").count())


@query(f"SELECT max(n) AS max_nnz, avg(n) AS mean_nnz FROM (SELECT count(*) AS n FROM ({_COO}) GROUP BY r)")
def row_stats(spark, sf_dir):
    return attach.row_stats(attach.csr_offsets(lineitem_matrix(spark, sf_dir), table(spark, sf_dir, "supplier").count()))


@query(f"""
WITH d AS (SELECT r, count(*) AS nnz FROM ({_COO}) GROUP BY 1),
p AS (SELECT r, sum(nnz) OVER (ORDER BY r) AS upto, sum(nnz) OVER () AS total FROM d)
SELECT CAST(part AS INTEGER) AS part, min(r) AS cut FROM p, (SELECT range AS part FROM range(1, 5)) WHERE upto * 5 >= part * total GROUP BY 1""")
def nnz_cuts(spark, sf_dir):
    offsets = attach.csr_offsets(lineitem_matrix(spark, sf_dir), table(spark, sf_dir, "supplier").count())
    return cuts.row_cuts(offsets, 5)


@query("""
SELECT vec_id AS i, round(sum(v * (1 + (k & 3) * 0.25::DOUBLE)), 6) AS y
FROM (SELECT vec_id, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""")
def ragged_long(spark, sf_dir):
    """Array rows in long form, contracted with a replicated vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row"))
    x = spark.range(64).select(F.col("id").cast("int").alias("k"), periodic_weight(F.col("id")).alias("x"))
    both = attach.attach(attach.to_long(vectors), x, attach.Access.SHARED_ACTIVE, on="k")
    return both.groupBy("i").agg(F.round(F.sum(F.col("v").cast("double") * F.col("x")), 6).alias("y"))


# --- reductions -------------------------------------------------------------


@query("SELECT event_id AS i, round(value / (SELECT sqrt(sum(value * value)) FROM events), 9) AS y FROM events")
def normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), "value")
    return reduce.scaled_by_norm(rows, "value").select("i", F.round("y", 9).alias("y"))


@query("WITH x AS (SELECT range AS i, 1.0::DOUBLE + range % 10 AS x FROM range(0, 4000)) SELECT i, round(x / (SELECT sqrt(sum(x * x)) FROM x), 9) AS y FROM x")
def normalize_workload(spark, sf_dir):
    return kernels.normalize_workload(spark).select("i", F.round("y", 9).alias("y"))


@query("""
SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_partkey) AS hi, min(l_partkey) AS lo,
       max(l_extendedprice) AS hi_price, min(l_discount) AS lo_discount
FROM lineitem GROUP BY 1""")
def reduce_ops(spark, sf_dir):
    a = reduce.Accumulator
    found = [a("s", "l_linenumber", "sum", "int"), a("hi", "l_partkey", "max"), a("lo", "l_partkey", "min"), a("hi_price", "l_extendedprice", "max", "double"), a("lo_discount", "l_discount", "min", "double")]
    return reduce.reduce(table(spark, sf_dir, "lineitem"), found, ["l_returnflag"])


@query("""
SELECT 0::BIGINT AS s, 1.0::DOUBLE AS p, '-9223372036854775808'::BIGINT AS hi, '9223372036854775807'::BIGINT AS lo,
       '-1.7976931348623157e308'::DOUBLE AS hi_price, '1.7976931348623157e308'::DOUBLE AS lo_price""")
def reduce_identities(spark, sf_dir):
    a = reduce.Accumulator
    found = [a("s", "l_partkey"), a("p", "l_partkey", "prod"), a("hi", "l_partkey", "max"), a("lo", "l_partkey", "min"), a("hi_price", "l_tax", "max", "double"), a("lo_price", "l_tax", "min", "double")]
    return reduce.reduce(table(spark, sf_dir, "lineitem").where("l_quantity < 0"), found)


@query("SELECT user_id, round(product(1 + value / 1000), 6) AS p FROM events GROUP BY 1")
def reduce_prod(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (1 + F.col("value") / 1000).alias("f"))
    return reduce.reduce(rows, [reduce.Accumulator("p", "f", "prod", "double")], ["user_id"]).withColumn("p", F.round("p", 6))


@query("""
SELECT CAST(k AS INTEGER) AS pos, round(sum(v), 6) AS value
FROM (SELECT unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""")
def array_sync(spark, sf_dir):
    return reduce.array_reduce(table(spark, sf_dir, "embeddings"), "embedding").withColumn("value", F.round("value", 6))


@query("""
SELECT CAST(sum(l_linenumber) AS BIGINT) AS as_int, CAST(sum(l_orderkey) AS BIGINT) AS as_long, CAST(sum(l_partkey) % 4294967296 AS BIGINT) AS as_uint,
       CAST(sum(CAST(l_suppkey AS DECIMAL(20,0))) AS DOUBLE) AS as_ulong, CAST(max(CAST(l_tax AS FLOAT)) AS FLOAT) AS as_float, min(l_extendedprice) AS as_double
FROM lineitem""")
def reduce_types(spark, sf_dir):
    """One accumulator of each numeric type in a single aggregate."""
    a = reduce.Accumulator
    found = [a("as_int", "l_linenumber", "sum", "int"), a("as_long", "l_orderkey"), a("as_uint", "l_partkey", "sum", "uint"), a("as_ulong", "l_suppkey", "sum", "ulong"), a("as_float", "l_tax", "max", "float"), a("as_double", "l_extendedprice", "min", "double")]
    return reduce.reduce(table(spark, sf_dir, "lineitem"), found).withColumn("as_ulong", F.col("as_ulong").cast("double"))


@query("""
SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_partkey) AS hi, min(l_partkey) AS lo FROM lineitem GROUP BY 1""")
def reduce_partials(spark, sf_dir):
    """Partial results of 16 index blocks, carried and folded."""
    a = reduce.Accumulator
    found = [a("s", "l_linenumber", "sum", "int"), a("hi", "l_partkey", "max"), a("lo", "l_partkey", "min")]
    rows = table(spark, sf_dir, "lineitem").withColumn("block", F.col("l_orderkey") % 16)
    return reduce.combine(reduce.reduce(rows, found, ["l_returnflag", "block"]), found, ["l_returnflag"])


@query("SELECT count(*)::DOUBLE AS n, round(avg(o_totalprice), 4) AS mean, round(var_pop(o_totalprice) / 1e6, 4) AS variance FROM orders")
def user_aggregate(spark, sf_dir):
    """A user's own reduction: count, mean and sum of squared deviations, which merge by Chan's formula."""

    def merge(a, b):
        n = a[0] + b[0]
        d = b[1] - a[1]
        return (n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n) if n else a

    how = reduce.UserAggregate((0.0, 0.0, 0.0), lambda s, v: merge(s, (len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum()))) if len(v) else s, merge)
    found = reduce.reduce_user(table(spark, sf_dir, "orders"), "o_totalprice", how)
    x = F.col("state")
    return found.select(x[0].alias("n"), F.round(x[1], 4).alias("mean"), F.round(x[2] / x[0] / 1e6, 4).alias("variance"))


@query("""
SELECT n_nationkey AS rank, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM nation, supplier GROUP BY 1""")
def allgather(spark, sf_dir):
    """Every rank's view of a whole field."""
    ranks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rank"))
    whole = attach.allgather(table(spark, sf_dir, "supplier").select("s_suppkey", money("s_acctbal").alias("v")), ranks)
    return whole.groupBy("rank").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


@query("SELECT n_nationkey AS rank, r_name, r_regionkey AS key FROM nation, region WHERE r_regionkey = 2")
def root_values(spark, sf_dir):
    """One rank's values for all."""
    values = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rank"), "r_name", F.col("r_regionkey").alias("key"))
    return attach.from_root(values, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rank")), root=2)


# --- cuts and ranges --------------------------------------------------------


@query("""
WITH n AS (SELECT count(*) AS n FROM orders),
w AS (SELECT user_id % 5 AS rank, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM events GROUP BY 1),
s AS (SELECT rank, n * weight / (SELECT sum(weight) FROM w) AS share, n FROM w, n),
f AS (SELECT rank, share, floor(share)::BIGINT AS base, n - sum(floor(share)::BIGINT) OVER () AS rest FROM s),
z AS (SELECT rank, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, rank) <= rest THEN 1 ELSE 0 END AS size FROM f)
SELECT rank, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (ORDER BY rank) - size AS BIGINT) AS start FROM z""")
def weighted_cuts(spark, sf_dir):
    weights = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("rank")).agg(F.sum(money("value")).cast("double").alias("weight"))
    return cuts.weighted_cuts(weights, table(spark, sf_dir, "orders").count())


# Cuts of given weights (total, weights, whether balancing is on, starts and end).
GIVEN_CUTS = ((10, (1.0, 1.0, 1.0), True, (0, 4, 7, 10)), (100, (0.5, 0.3, 0.2), True, (0, 50, 80, 100)), (7, (0.9, 0.05, 0.05), True, (0, 5, 6, 7)), (10, (0.0, 0.0), True, (0, 5, 10)), (10, (3.0, 1.0), False, (0, 5, 10)))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::INTEGER, {r}::INTEGER, {a}::BIGINT, {b - a}::BIGINT)" for k, (_, _, _, at) in enumerate(GIVEN_CUTS) for r, (a, b) in enumerate(zip(at, at[1:], strict=False))) + ") t(k, rank, start, size)")
def given_cuts(spark, sf_dir):
    """Cuts that fall back, or take from the largest part for an empty one."""
    found = None
    for k, (total, weights, balancing, _) in enumerate(GIVEN_CUTS):
        rows = cuts.weighted_cuts(spark.createDataFrame(list(enumerate(weights)), "rank int, weight double"), total, balancing)
        rows = rows.select(F.lit(k).alias("k"), "rank", "start", "size")
        found = rows if found is None else found.union(rows)
    return found


_TELEMETRY_5 = "SELECT user_id % 5 AS rank, count(*) AS remaining, count(*) FILTER (event_id % 3 = 0) AS done, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 100 AS elapsed FROM events GROUP BY 1"


@query(f"""
WITH t AS ({_TELEMETRY_5}), d AS (SELECT rank, remaining, elapsed / done AS density, remaining * (elapsed / done) AS cost FROM t),
c AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS cost_to, sum(remaining) OVER (ORDER BY rank) AS rows_to FROM d),
a AS (SELECT max(cost_to) AS all_cost, max(rows_to) AS all_rows FROM c),
p AS (SELECT range AS part, range * all_cost / 6 AS wanted, all_rows FROM range(1, 6), a),
f AS (SELECT part, wanted, all_rows, min(rank) AS rank FROM p JOIN c ON cost_to >= wanted OR rank = 4 GROUP BY ALL),
g AS (SELECT part, least(rows_to - remaining + floor((wanted - (cost_to - cost)) / density + 0.5), all_rows) AS cut FROM f JOIN c USING (rank)
      UNION ALL SELECT 0, 0 UNION ALL SELECT 6, all_rows FROM a)
SELECT CAST(part AS INTEGER) AS part, CAST(max(cut) OVER (ORDER BY part) AS BIGINT) AS cut FROM g""")
def cost_cuts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    telemetry = events.groupBy((F.col("user_id") % 5).alias("rank")).agg(
        F.count("*").alias("remaining"), F.count_if(F.col("event_id") % 3 == 0).alias("done"), (F.sum(money("value")).cast("double") / 100).alias("elapsed")
    )
    return cuts.cost_cuts(telemetry, 6)


#: Two ranges a rank over the orders, and how far each rank has come.
_PLAN = """n AS (SELECT count(*) AS n FROM orders),
plan AS (SELECT r.range // 2 AS rank, r.range % 2 AS ord, r.range * n // 16 AS s, (r.range + 1) * n // 16 AS e FROM range(0, 16) r, n),
conf AS (SELECT user_id % 8 AS rank, (user_id % 8) * 2 * max(n) // 16 + count(*) % (max(n) // 10) AS confirmed FROM events, n GROUP BY user_id % 8)"""


def order_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    n = table(spark, sf_dir, "orders").count()
    at = F.col("id")
    edge = lambda k: space.quotient(k * n, 16)
    plan = spark.range(16).select(space.quotient(at, 2).alias("rank"), (at % 2).alias("ord"), edge(at).alias("s"), edge(at + 1).alias("e"))
    rank = F.col("user_id") % 8
    confirmed = table(spark, sf_dir, "events").groupBy(rank.alias("rank")).agg(F.count("*").alias("c"))
    return plan, confirmed.select("rank", (edge(F.col("rank") * 2) + F.col("c") % (n // 10)).alias("confirmed")), n


@query(f"""
WITH {_PLAN}, b AS (SELECT *, sum(e - s) OVER (ORDER BY rank, ord) - (e - s) AS base FROM plan),
w AS (SELECT rank, ord, s, base, greatest(base, n // 5) AS a, least(base + e - s, n // 2) AS z FROM b, n)
SELECT rank, ord, CAST(s + a - base AS BIGINT) AS s, CAST(s + z - base AS BIGINT) AS e FROM w WHERE a < z""")
def slice_window(spark, sf_dir):
    plan, _, n = order_plan(spark, sf_dir)
    return ranges.slice_window(plan, n // 5, n // 2)


@query(f"""
WITH {_PLAN} SELECT rank, ord, greatest(s, confirmed + 1) AS s, e FROM plan JOIN conf USING (rank) WHERE greatest(s, confirmed + 1) < e""")
def slice_remaining(spark, sf_dir):
    plan, confirmed, _ = order_plan(spark, sf_dir)
    return ranges.remaining(plan, confirmed)


@query(f"""
WITH {_PLAN}, d AS (SELECT rank, ord, s, greatest(least(confirmed + 1, e) - s, 0) AS n FROM plan JOIN conf USING (rank))
SELECT rank, ord, s AS start, n AS "count" FROM d WHERE n > 0""")
def done_segments(spark, sf_dir):
    plan, confirmed, _ = order_plan(spark, sf_dir)
    return ranges.done_segments(plan, confirmed)


@query(f"WITH {_PLAN} SELECT rank, ord, s, e, CAST(sum(e - s) OVER (PARTITION BY rank ORDER BY ord) - (e - s) AS BIGINT) AS base FROM plan")
def range_bases(spark, sf_dir):
    plan, _, _ = order_plan(spark, sf_dir)
    return ranges.local_bases(plan)


@query(f"""
WITH {_PLAN}, r AS (SELECT rank, greatest(s, confirmed + 1) AS s, e FROM plan JOIN conf USING (rank))
SELECT rank, max(e) - min(s) = sum(e - s) AS contiguous FROM r WHERE s < e GROUP BY 1""")
def contiguous_ranges(spark, sf_dir):
    plan, confirmed, _ = order_plan(spark, sf_dir)
    return ranges.contiguous(ranges.remaining(plan, confirmed))


_WORK = """w AS (SELECT s_nationkey AS rank, count(*) AS remaining FROM supplier GROUP BY 1),
o AS (SELECT rank, sum(remaining) OVER (ORDER BY rank) - remaining AS old_s, sum(remaining) OVER (ORDER BY rank) AS old_e FROM w),
c AS (SELECT range AS part, range * n // 4 AS s, (range + 1) * n // 4 AS e FROM range(0, 4), (SELECT count(*) AS n FROM supplier))"""


def supplier_work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier = table(spark, sf_dir, "supplier")
    n, at = supplier.count(), F.col("id")
    work = supplier.groupBy(F.col("s_nationkey").alias("rank")).agg(F.count("*").alias("remaining"))
    return work, spark.range(4).select(at.alias("part"), space.quotient(at * n, 4).alias("s"), space.quotient((at + 1) * n, 4).alias("e"))


@query(f"""
WITH {_WORK}
SELECT rank AS old_rank, part AS new_rank, CAST(greatest(old_s, s) AS BIGINT) AS start, CAST(least(old_e, e) - greatest(old_s, s) AS BIGINT) AS "count"
FROM o JOIN c ON old_s < e AND s < old_e""")
def transfer_plan(spark, sf_dir):
    return ranges.transfer_plan(*supplier_work(spark, sf_dir))


_HELD = f"""{_PLAN}, h AS (SELECT rank, ord, greatest(s, confirmed + 1) AS s, e FROM plan JOIN conf USING (rank) WHERE greatest(s, confirmed + 1) < e),
hb AS (SELECT *, sum(e - s) OVER (ORDER BY rank, ord) - (e - s) AS base FROM h), ht AS (SELECT sum(e - s) AS n FROM h),
ct AS (SELECT range AS part, range * n // 5 AS cs, (range + 1) * n // 5 AS ce FROM range(0, 5), ht),
x AS (SELECT rank AS old_rank, part AS new_rank, CAST(s + greatest(base, cs) - base AS BIGINT) AS s, CAST(s + least(base + e - s, ce) - base AS BIGINT) AS e FROM hb JOIN ct ON base < ce AND cs < base + e - s)"""


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes hands when the orders that remain are dealt to five ranks."""
    plan, confirmed, _ = order_plan(spark, sf_dir)
    held = ranges.remaining(plan, confirmed)
    n = held.agg(F.sum(F.col("e") - F.col("s")).alias("n"))
    at = F.col("id")
    parts = spark.range(5).crossJoin(F.broadcast(n)).select(at.alias("part"), F.expr("id * n div 5").alias("s"), F.expr("(id + 1) * n div 5").alias("e"))
    return ranges.exchange(held, parts)


@query(f"""
WITH {_HELD} SELECT old_rank, new_rank, CASE WHEN old_rank = new_rank THEN 'keep' ELSE 'move' END AS kind, s, e FROM x""")
def exchange(spark, sf_dir):
    return order_transfers(spark, sf_dir)


@query(f"""
WITH {_HELD} SELECT old_rank, new_rank, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM x JOIN orders ON o_orderkey >= s AND o_orderkey < e WHERE old_rank <> new_rank GROUP BY 1, 2""")
def exchange_rows(spark, sf_dir):
    """The rows of a vector that move; what is done or kept stays."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), money("o_totalprice").alias("v"))
    moved = ranges.moved_rows(orders, order_transfers(spark, sf_dir))
    return moved.groupBy("old_rank", "new_rank").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


@query("""
WITH n AS (SELECT count(*) AS n FROM orders), h AS (SELECT n // 3 AS s, n AS e FROM n),
p AS (SELECT range AS part, range * (e - s) // 4 AS cs, (range + 1) * (e - s) // 4 AS ce, s FROM range(0, 4), h)
SELECT 2::INTEGER AS old_rank, part AS new_rank, s + cs AS s, s + ce AS e, CASE WHEN part = 2 THEN 'keep' ELSE 'scatter' END AS kind FROM p""")
def scatter(spark, sf_dir):
    """All remaining work is one rank's: it scatters."""
    n = table(spark, sf_dir, "orders").count()
    left = n - n // 3
    held = spark.createDataFrame([(2, 0, n // 3, n)], "rank int, ord int, s long, e long")
    parts = spark.createDataFrame([(p, p * left // 4, (p + 1) * left // 4) for p in range(4)], "part long, s long, e long")
    return ranges.exchange(held, parts)


@query("""
WITH b AS (SELECT l_orderkey AS i, count(*) AS size, sum(l_linenumber) AS total FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM orders),
o AS (SELECT range AS rank, range * n // 6 AS s, (range + 1) * n // 6 AS e FROM range(0, 6), n)
SELECT rank, i, size, CAST(sum(size) OVER (PARTITION BY rank ORDER BY i) - size AS BIGINT) AS base, CAST(total AS BIGINT) AS total FROM b JOIN o ON i >= s AND i < e""")
def ragged_resync(spark, sf_dir):
    """Array rows dealt to new owners, with where each begins in its owner's buffer."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i")).agg(F.collect_list("l_linenumber").alias("row"))
    n = table(spark, sf_dir, "orders").count()
    owners = spark.createDataFrame([(r, r * n // 6, (r + 1) * n // 6) for r in range(6)], "rank long, s long, e long")
    found = attach.ragged_resync(lines, owners)
    return found.select("rank", "i", "size", "base", F.aggregate("row", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""
WITH {_WORK}, k AS (SELECT part, s - 2 * part AS cs, e + 3 - 2 * part AS ce FROM c WHERE part < 3)
SELECT c.part AS rank, coalesce(bool_and(s >= cs AND e <= ce), false) AS reuse FROM c LEFT JOIN k USING (part) GROUP BY 1""")
def cache_reuse(spark, sf_dir):
    _, parts = supplier_work(spark, sf_dir)
    assigned = parts.withColumnRenamed("part", "rank")
    cached = assigned.where("rank < 3").select("rank", (F.col("s") - 2 * F.col("rank")).alias("cs"), (F.col("e") + 3 - 2 * F.col("rank")).alias("ce"))
    return ranges.reusable(assigned, cached)


@query("""
SELECT n_nationkey AS rank, r_regionkey AS buffer FROM nation, region
WHERE n_nationkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM nation h WHERE h.n_nationkey = nation.n_nationkey AND h.n_regionkey = r_regionkey)""")
def missing_replicas(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    joiners = nation.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("rank"))
    needed = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("buffer"))
    return ranges.missing_replicas(joiners, needed, nation.select(F.col("n_nationkey").alias("rank"), F.col("n_regionkey").alias("buffer")))


@query("""
SELECT user_id, event_id, event_type FROM
(SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
WHERE event_type IS DISTINCT FROM last""")
def fixed_sequence(spark, sf_dir):
    """Adjacent repeats dropped, as a sequence of sizes drops them."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ranges.without_repeats(rows, "event_type", "event_id", ["user_id"])


@query("SELECT o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders")
def gather(spark, sf_dir):
    original = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    computed = original.where("i % 3 = 0").select("i", (F.col("v") * 2).alias("v"))
    return attach.gather(original, computed, "v")


# --- neighbours -------------------------------------------------------------

_STEP = """SELECT i, u + 0.25::DOUBLE * (coalesce(lag(u) OVER (ORDER BY i), (SELECT arg_max(u, i) FROM {0})) - 2 * u
+ coalesce(lead(u) OVER (ORDER BY i), (SELECT arg_min(u, i) FROM {0}))) AS u FROM {0}"""


def price_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("u")), orders.count()


@query(f"WITH f0 AS (SELECT o_orderkey AS i, o_totalprice AS u FROM orders), f1 AS ({_STEP.format('f0')}) SELECT i, round(u, 4) AS u FROM f1")
def stencil_step(spark, sf_dir):
    field, n = price_field(spark, sf_dir)
    return kernels.stencil_step(field, n, block=4096).select("i", F.round("u", 4).alias("u"))


@query(f"""
WITH f0 AS (SELECT o_orderkey AS i, o_totalprice AS u FROM orders), f1 AS ({_STEP.format("f0")}), f2 AS ({_STEP.format("f1")}), f3 AS ({_STEP.format("f2")})
SELECT i, round(u, 8) AS u FROM f3""")
def stencil_steps(spark, sf_dir):
    field, n = price_field(spark, sf_dir)
    for _ in range(3):
        field = kernels.stencil_step(field, n)
    return field.select("i", F.round("u", 8).alias("u"))  # three steps make 64ths of cents: no ties


@query(f"""
WITH f0 AS (SELECT o_orderkey AS i, o_totalprice AS u FROM orders), f1 AS ({_STEP.format("f0")})
SELECT round((SELECT sum(u) FROM f0), 2) AS before_sum, round((SELECT sum(u) FROM f1), 2) AS after_sum,
       round((SELECT sum(pow(f1.u - f0.u, 2)) FROM f0 JOIN f1 USING (i)) / 1e6, 2) AS residual""")
def stencil_conservation(spark, sf_dir):
    field, n = price_field(spark, sf_dir)
    after = kernels.stencil_step(field, n)
    sums = field.agg(F.round(F.sum("u"), 2).alias("before_sum")).join(after.agg(F.round(F.sum("u"), 2).alias("after_sum")))
    return sums.join(kernels.residual(field, after).select(F.round(F.col("residual") / 1e6, 2).alias("residual")))


#: A sine of one period fades by the same factor each step, and the sum stays.
_FADE = "pow(1 - 0.5::DOUBLE * (1 - cos(2 * pi() / 200000)), 2000)"


@query(f"""
SELECT 200000::BIGINT AS cells, 200000.0::DOUBLE AS total, round(1 + {_FADE}, 6) AS highest, round(1 - {_FADE}, 6) AS lowest,
       round(sum(pow(1 + {_FADE} * sin(2 * pi() * range / 200000), 2)), 2) AS squares FROM range(0, 200000)""")
def heat(spark, sf_dir):
    """The heat workload at its full size: 2,000 steps of 200,000 cells, against the closed form."""
    from .store import cut

    out = kernels.stencil_many(kernels.heat_initial(space.loop(spark, 200_000), 200_000), 200_000, 2_000, cut)
    u = F.col("u")
    return out.agg(F.count("*").alias("cells"), F.round(F.sum(u), 2).alias("total"), F.round(F.max(u), 6).alias("highest"), F.round(F.min(u), 6).alias("lowest"), F.round(F.sum(u * u), 2).alias("squares"))


_HEAT = "f0 AS (SELECT range AS i, 1.0::DOUBLE + sin(6.2831853::DOUBLE * range / 500) AS u FROM range(0, 500))"


@query(f"""
WITH {_HEAT}, f1 AS ({_STEP.format("f0")}), f2 AS ({_STEP.format("f1")}), f3 AS ({_STEP.format("f2")}), f4 AS ({_STEP.format("f3")})
SELECT i, round(u, 9) AS u FROM f4""")
def heat_steps(spark, sf_dir):
    """Four steps of the heat workload, run by the step loop."""
    from .controller import run_steps

    field = kernels.heat_initial(space.loop(spark, 500), 500)
    out = run_steps(field, 4, lambda f: kernels.stencil_step(f, 500, block=128), 64, lambda f: f)
    return out.select("i", F.round("u", 9).alias("u"))


_GRID = "g AS (SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, CASE WHEN p_size % 10 < 3 THEN 1 ELSE 0 END AS alive FROM part), h AS (SELECT count(*) // 50 AS h FROM part)"


@query(f"""
WITH {_GRID}, d AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(0, 3) a, range(0, 3) b WHERE NOT (a.range = 1 AND b.range = 1)),
n AS (SELECT (y + dy + h) % h AS y, (x + dx + 50) % 50 AS x, sum(alive) AS n FROM g, d, h GROUP BY 1, 2)
SELECT g.y, g.x, CASE WHEN n = 3 OR alive = 1 AND n = 2 THEN 1 ELSE 0 END AS alive FROM g JOIN n ON g.y = n.y AND g.x = n.x""")
def life_step(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    height = part.count() // 50
    y, x = space.decode(F.col("p_partkey"), [height, 50])
    return kernels.life_step(part.select(y.alias("y"), x.alias("x"), (F.col("p_size") % 10 < 3).cast("int").alias("alive")), 50, height)


@query(f"""
WITH {_GRID}, d AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(0, 3) a, range(0, 3) b WHERE NOT (a.range = 1 AND b.range = 1)),
n AS (SELECT (y + dy + h) % h AS y, (x + dx + 50) % 50 AS x, sum(alive) AS n FROM g, d, h GROUP BY 1, 2)
SELECT (SELECT CAST(sum(alive) AS BIGINT) FROM g) AS before_alive,
       CAST(sum(CASE WHEN n = 3 OR alive = 1 AND n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS after_alive FROM g JOIN n ON g.y = n.y AND g.x = n.x""")
def life_population(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    height = part.count() // 50
    y, x = space.decode(F.col("p_partkey"), [height, 50])
    cells = part.select(y.alias("y"), x.alias("x"), (F.col("p_size") % 10 < 3).cast("int").alias("alive"))
    both = cells.select("alive", F.lit(0).alias("new")).union(kernels.life_step(cells, 50, height).select("alive", F.lit(1)))
    return both.agg(F.sum(F.when(F.col("new") == 0, F.col("alive"))).alias("before_alive"), F.sum(F.when(F.col("new") == 1, F.col("alive"))).alias("after_alive"))


_LIFE = ", ".join(
    f"""p{k} AS (SELECT (y + dy + h) % h AS y, (x + dx + 50) % 50 AS x, sum(alive) AS n FROM g{k}, d, h GROUP BY 1, 2),
g{k + 1} AS (SELECT g.y, g.x, CASE WHEN n = 3 OR alive = 1 AND n = 2 THEN 1 ELSE 0 END AS alive FROM g{k} g JOIN p{k} n ON g.y = n.y AND g.x = n.x)"""
    for k in range(4)
)


@query(f"""
WITH {_GRID}, g0 AS (SELECT * FROM g), d AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(0, 3) a, range(0, 3) b WHERE NOT (a.range = 1 AND b.range = 1)), {_LIFE}
{" UNION ALL ".join(f"SELECT {k}::INTEGER AS step, y % 8 AS part, CAST(sum(alive) AS BIGINT) AS alive FROM g{k} GROUP BY 2" for k in range(5))}""")
def life_dynamic(spark, sf_dir):
    """Four steps, and the living cells of each part after each: a load that changes over time."""
    part = table(spark, sf_dir, "part")
    height = part.count() // 50
    y, x = space.decode(F.col("p_partkey"), [height, 50])
    cells = part.select(y.alias("y"), x.alias("x"), (F.col("p_size") % 10 < 3).cast("int").alias("alive"))
    out = None
    for step in range(5):
        counts = cells.groupBy((F.col("y") % 8).alias("part")).agg(F.sum("alive").alias("alive")).select(F.lit(step).alias("step"), "part", "alive")
        out = counts if out is None else out.union(counts)
        cells = kernels.life_step(cells, 50, height)
    return out


# --- generators -------------------------------------------------------------


def _sql_lcg(seed: str, steps: str) -> str:
    return f"list_reduce(list_prepend(CAST({seed} AS BIGINT), range(0, {steps})), lambda s, x: (s * 1664525 + 1013904223) & 4294967295)"


def _sql_stream(source: str, position: str, out: str, seed: int = 12345, bits: int = 23) -> str:
    """``source`` with ``out``, the state after ``position`` steps: each bit of the position is a power of the map."""
    rows = f"(SELECT *, {seed}::UBIGINT AS {out} FROM {source})"
    for b in range(bits):
        factor, offset = jump(1 << b)
        rows = f"(SELECT * REPLACE (CASE WHEN ({position} >> {b}) & 1 = 1 THEN ({out} * {factor}::UBIGINT + {offset}::UBIGINT) & 4294967295::UBIGINT ELSE {out} END AS {out}) FROM {rows})"
    return rows


def _sql_spmv(n: int, heavy: int, high: int, low: int) -> str:
    """y of a clustered matrix whose first ``heavy`` rows have ``high`` entries and the others ``low``."""
    cells = f"(SELECT r, unnest(range(0, nnz)) + first AS e FROM (SELECT range AS r, CASE WHEN range < {heavy} THEN {high} ELSE {low} END AS nnz, CASE WHEN range < {heavy} THEN range * {high} ELSE {heavy} * {high} + (range - {heavy}) * {low} END AS first FROM range(0, {n})))"
    both = _sql_stream(_sql_stream(cells, "(2 * e + 1)", "a"), "(2 * e + 2)", "b")
    return f"SELECT r, round(sum((0.5::DOUBLE + (b % 100)::BIGINT * 0.01::DOUBLE) * (1 + ((a % {n})::BIGINT & 3) * 0.25::DOUBLE)), 4) AS y FROM {both} GROUP BY 1"


@query(f"SELECT o_orderkey AS i, {_sql_lcg('o_orderkey', '5')} AS state FROM orders")
def lcg(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), lcg_fold(F.col("o_orderkey"), 5).alias("state"))


@query(f"SELECT range AS position, {_sql_lcg('12345', 'range')} AS state FROM range(0, 300)")
def lcg_stream(spark, sf_dir):
    """Any row of the stream alone, by jumps."""
    return spark.range(300).select(F.col("id").alias("position"), lcg_at(12345, F.col("id")).alias("state"))


@query(f"""
WITH s AS (SELECT {_sql_lcg("o_orderkey + 1", "2")} AS a, {_sql_lcg("o_orderkey + 1", "3")} AS b FROM orders),
h AS (SELECT CASE WHEN (a / 4294967296.0::DOUBLE) * (a / 4294967296.0::DOUBLE) + (b / 4294967296.0::DOUBLE) * (b / 4294967296.0::DOUBLE) <= 1 THEN 1 ELSE 0 END AS hit FROM s)
SELECT CAST(sum(hit) AS BIGINT) AS hits, count(*) AS points, 4.0::DOUBLE * sum(hit) / count(*) AS pi FROM h""")
def montecarlo(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(kernels.inside_circle(F.col("o_orderkey") + 1).alias("hit"))
    return kernels.pi_estimate(points)


@query("""
SELECT 'clustered' AS pattern, range AS r, CASE WHEN range < 125 THEN 22 ELSE 3 END::BIGINT AS nnz FROM range(0, 500)
UNION ALL SELECT 'uniform', range, 8 FROM range(0, 500)
UNION ALL SELECT 'spike', range, CASE WHEN range IN (100, 200, 300, 400) THEN 56 ELSE 8 END FROM range(0, 500)
UNION ALL SELECT 'powerlaw', range, least(greatest(floor(8.0::DOUBLE * 500 / (SELECT sum(1.0::DOUBLE / (range + 1)) FROM range(0, 500)) / (range + 1) + 0.5), 1), 500)::BIGINT FROM range(0, 500)""")
def synthetic_degrees(spark, sf_dir):
    from ..sources import synthetic

    made = {
        "clustered": synthetic.clustered_degrees(spark, 500, 8),
        "uniform": synthetic.uniform_degrees(spark, 500, 8),
        "spike": synthetic.spike_degrees(spark, 500, 8),
        "powerlaw": synthetic.powerlaw_degrees(spark, 500, 8),
    }
    rows = [d.select(F.lit(k).alias("pattern"), "r", "nnz") for k, d in made.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"""
WITH d AS (SELECT range AS r, CASE WHEN range < 10 THEN 11 ELSE 2 END AS nnz FROM range(0, 40)),
f AS (SELECT r, nnz, sum(nnz) OVER (ORDER BY r) - nnz AS first FROM d),
e AS (SELECT r, unnest(range(0, nnz)) AS k, first FROM f),
s AS (SELECT r, k, {_sql_lcg("12345", "(2 * (first + k) + 1)::BIGINT")} AS a, {_sql_lcg("12345", "(2 * (first + k) + 2)::BIGINT")} AS b FROM e)
SELECT r, k, CAST(a % 40 AS INTEGER) AS c, round(0.5::DOUBLE + (b % 100) * 0.01::DOUBLE, 4) AS v FROM s""")
def synthetic_csr(spark, sf_dir):
    from ..sources import synthetic

    found = synthetic.matrix(spark, "clustered", 40, 4)
    return found.select("r", "k", "c", F.round(F.col("v").cast("double"), 4).alias("v"))


@query(_sql_spmv(100_000, 25_000, 45, 6))
def spmv_csr(spark, sf_dir):
    """The sparse workload: 100,000 rows with 16 entries on average, clustered (values are floats, so four places count)."""
    from ..sources import synthetic

    x = space.loop(spark, 100_000).select(F.col("i").cast("int").alias("c"), periodic_weight(F.col("i")).alias("x"))
    cells = synthetic.matrix(spark, "clustered", 100_000, 16)
    return kernels.spmv(cells.withColumn("v", F.round(F.col("v").cast("double"), 2)), x).select("r", F.round("y", 4).alias("y"))


@query("""
WITH d AS (SELECT range AS r, CASE WHEN range < 50000 THEN 45 ELSE 6 END AS nnz FROM range(0, 200000)), u AS (SELECT r, nnz, sum(nnz) OVER (ORDER BY r) AS upto, sum(nnz) OVER () AS total FROM d),
c AS (SELECT 'rows' AS cut, range AS part, range * 25000 AS s, (range + 1) * 25000 AS e FROM range(0, 8)
 UNION ALL SELECT 'entries', part, s, coalesce(lead(s) OVER (ORDER BY part), 200000) FROM (SELECT part, min(r) AS s FROM u, (SELECT range AS part FROM range(1, 8)) WHERE upto * 8 >= part * total GROUP BY 1 UNION ALL SELECT 0, 0))
SELECT cut, CAST(part AS INTEGER) AS part, count(*) AS n_rows, CAST(sum(nnz) AS BIGINT) AS entries, CAST(sum(nnz) * 50 AS BIGINT) AS products,
       round(sum(nnz) / (SELECT sum(nnz) / 8.0::DOUBLE FROM d), 6) AS imbalance FROM c JOIN d ON r >= s AND r < e GROUP BY 1, 2""")
def spmv_imbal(spark, sf_dir):
    """The skewed sparse workload, 200,000 rows, 50 repetitions: each part's load under equal rows and under equal entries."""
    from ..sources import synthetic

    cells = synthetic.clustered_degrees(spark, 200_000, 16)
    by_rows = cells.withColumns({"cut": F.lit("rows"), "part": space.owner(F.col("r"), 200_000, 8)})
    starts = cuts.row_cuts(cells, 8).agg(F.sort_array(F.collect_list("cut")).alias("starts"))  # seven of them
    by_entries = cells.crossJoin(F.broadcast(starts)).select("r", "nnz", F.lit("entries").alias("cut"), F.size(F.filter("starts", lambda s: s <= F.col("r"))).alias("part"))
    loads = by_rows.unionByName(by_entries).groupBy("cut", "part").agg(F.count("*").alias("n_rows"), F.sum("nnz").alias("entries"))
    mean = cells.agg((F.sum("nnz") / 8).alias("mean"))
    return loads.crossJoin(F.broadcast(mean)).select("cut", "part", "n_rows", "entries", (F.col("entries") * 50).alias("products"), F.round(F.col("entries") / F.col("mean"), 6).alias("imbalance"))


@query("""
SELECT i, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, 150), lambda k: sin(i + k) * cos(i - k) + sqrt((i + 1) * (k + 1)))), lambda s, v: s + v), 4) AS fp
FROM (SELECT range AS i FROM range(0, 20000))""")
def noise_fp(spark, sf_dir):
    return space.loop(spark, 20_000).select("i", F.round(kernels.fp_kernel(F.col("i"), F.lit(150)), 4).alias("fp"))


@query("""
SELECT i, w AS work, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, w), lambda k: sin(i + k) * cos(i - k) + sqrt((i + 1) * (k + 1)))), lambda s, v: s + v), 4) AS c
FROM (SELECT range AS i, greatest(150 // 8 + 300 * range // 20000, 1) AS w FROM range(0, 20000))""")
def noise_imbalanced(spark, sf_dir):
    work = kernels.imbalanced_work(F.col("i"), 150, 20_000)
    return space.loop(spark, 20_000).withColumn("work", work).select("i", "work", F.round(kernels.fp_kernel(F.col("i"), F.col("work")), 4).alias("c"))


_WRAP = "& 18446744073709551615::HUGEINT"


@query(f"""
WITH RECURSIVE w(i, k, x, c) AS (
 SELECT range, 0, ((range + 1)::HUGEINT * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) {_WRAP}, 0.0::DOUBLE FROM range(0, 20000)
 UNION ALL SELECT i, k + 1, y, c + (((y >> 33) % 65536)::BIGINT * 2654435761 % 1000)::DOUBLE * 0.001::DOUBLE
 FROM (SELECT i, k, c, (x * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) {_WRAP} AS y FROM w WHERE k < 150))
SELECT i, round(c, 6) AS c FROM w WHERE k = 150""")
def noise_mem(spark, sf_dir):
    return kernels.mem_kernel(space.loop(spark, 20_000), 150, 1 << 16).select("i", F.round("c", 6).alias("c"))


# --- epochs and decisions ---------------------------------------------------

#: Events as telemetry: 500 an epoch, 8 workers, of whom each has some work left.
_EPOCHS = """t AS (SELECT event_id // 500 AS epoch, user_id % 8 AS rank, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v,
max(event_id) AS m FROM events GROUP BY 1, 2),
e AS (SELECT epoch, rank, rank < 6 AS active, CAST(m % 400 + 1 AS DOUBLE) AS remaining, n AS done, v / 100 AS elapsed, epoch // 3 AS start FROM t),
g AS (SELECT *, CASE WHEN elapsed > 0 AND done > 0 THEN done / elapsed ELSE 0 END AS thr,
 lag(start) OVER w AS ls, lag(done) OVER w AS ld, lag(elapsed) OVER w AS le FROM e WINDOW w AS (PARTITION BY rank ORDER BY epoch)),
h AS (SELECT *, done - CASE WHEN ls = start THEN ld ELSE 0 END AS od, elapsed - CASE WHEN ls = start THEN le ELSE 0.0 END AS oe FROM g),
r AS (SELECT *, CASE WHEN oe > 0 AND od > 0 THEN od / oe ELSE 0 END AS epoch_thr, CASE WHEN thr > 1e-9 THEN remaining / thr ELSE 0 END AS rem_time FROM h),
m AS (SELECT epoch, count(*) FILTER (active) AS active_n, sum(remaining) AS remaining, sum(thr) AS throughput, sum(epoch_thr) AS epoch_throughput,
 max(thr) AS max_throughput, coalesce(min(CASE WHEN active AND thr > 1e-9 THEN thr END), 0) AS min_throughput, max(rem_time) AS max_rem_time,
 sum(rem_time) AS sum_rem_time, coalesce(max(CASE WHEN active THEN elapsed END), -1) AS epoch_elapsed FROM r GROUP BY 1)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.groupBy(space.quotient(F.col("event_id"), 500).alias("epoch"), (F.col("user_id") % 8).alias("rank")).agg(
        F.count("*").alias("done"), (F.sum(money("value")).cast("double") / 100).alias("elapsed"), (F.max("event_id") % 400 + 1).cast("double").alias("remaining")
    )
    return rows.withColumns({"active": F.col("rank") < 6, "start": space.quotient(F.col("epoch"), 3)})


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epoch.epoch_metrics(epoch.worker_rates(telemetry(spark, sf_dir)))


@query(f"""
WITH {_EPOCHS} SELECT epoch, active_n, remaining, round(throughput, 9) AS throughput, round(epoch_throughput, 9) AS epoch_throughput,
round(max_throughput, 9) AS max_throughput, round(min_throughput, 9) AS min_throughput, round(max_rem_time, 9) AS max_rem_time,
round(sum_rem_time, 9) AS sum_rem_time, epoch_elapsed,
round(CASE WHEN active_n > 0 AND sum_rem_time > 1e-9 THEN max_rem_time / (sum_rem_time / active_n) ELSE 0 END, 9) AS imbalance FROM m""")
def epoch_metrics(spark, sf_dir):
    exact = {"epoch", "active_n", "remaining", "epoch_elapsed"}
    found = metrics(spark, sf_dir)
    return found.select(*[F.col(c) if c in exact else F.round(c, 9).alias(c) for c in found.columns])


@query(f"""
WITH {_EPOCHS}, a AS (SELECT epoch, rank, rem_time, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER w AS n, sum(rem_time) OVER w AS total FROM r WINDOW w AS (PARTITION BY epoch)),
s AS (SELECT epoch, rank, CASE WHEN n > 1 AND total > 1e-9 AND rem_time > 1.5 * (total / n) THEN 1 ELSE 0 END AS slow FROM a),
i AS (SELECT *, sum(1 - slow) OVER (PARTITION BY rank ORDER BY epoch) AS island FROM s)
SELECT epoch, rank, slow, CAST(sum(slow) OVER (PARTITION BY rank, island ORDER BY epoch) AS INTEGER) AS streak FROM i""")
def slow_streak(spark, sf_dir):
    return epoch.slow_streaks(epoch.worker_rates(telemetry(spark, sf_dir)))


@query(f"""
WITH {_EPOCHS} SELECT epoch, remaining < 1 OR active_n <= 0 AS done,
throughput > 1e-9 AND greatest(remaining / throughput, CASE WHEN min_throughput > 1e-9 AND active_n > 0 THEN remaining / active_n / min_throughput ELSE 0 END) < 2 * 50.0 AS short FROM m""")
def min_horizon(spark, sf_dir):
    m = metrics(spark, sf_dir)
    short = epoch.short_horizon(F.col("remaining"), F.col("throughput"), F.col("active_n"), F.col("min_throughput"), 2.0, 50.0)
    return m.select("epoch", epoch.is_done(F.col("remaining"), F.col("active_n")).alias("done"), short.alias("short"))


#: Events as raw votes; one in 40 is nonsense.
_RAW_VOTES = """v AS (SELECT event_id, event_id // 25 AS epoch, CASE WHEN event_id % 40 = 7 THEN 'NONSENSE' WHEN event_type IN ('view', 'click') THEN 'KEEP'
WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ABSTAIN' ELSE 'RESIZE' END AS vote,
CAST(user_id % 12 - 1 AS INTEGER) AS target, 5 AS active_n, CAST(event_id // 100 % 3 AS INTEGER) AS cooldown, CAST(event_id % 7 * 100 AS INTEGER) AS next_epoch_ms, event_id % 2 = 0 AS skip_cooldown FROM events),
k AS (SELECT *, CASE WHEN vote NOT IN ('KEEP', 'RESIZE', 'ABSTAIN') OR vote = 'RESIZE' AND target <= 0 THEN 'ABSTAIN'
 WHEN vote = 'RESIZE' AND target = active_n AND cooldown > 0 THEN 'KEEP' ELSE vote END AS counted FROM v)"""


def raw_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    vote = F.when(e % 40 == 7, "NONSENSE").when(kind.isin("view", "click"), "KEEP").when((kind == "purchase") & (e % 3 == 0), "ABSTAIN").otherwise("RESIZE")
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"),
        space.quotient(e, 25).alias("epoch"),
        vote.alias("vote"),
        (F.col("user_id") % 12 - 1).cast("int").alias("target"),
        F.lit(5).alias("active_n"),
        (space.quotient(e, 100) % 3).cast("int").alias("cooldown"),
        (e % 7 * 100).cast("int").alias("next_epoch_ms"),
        (e % 2 == 0).alias("skip_cooldown"),
    )


def counted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote, target = consensus.normalised(F.col("vote"), F.col("target"), F.col("active_n"), F.lit(8), F.col("cooldown"))
    return raw_votes(spark, sf_dir).withColumns({"vote": vote, "target": target})


@query(f"WITH {_RAW_VOTES} SELECT event_id, counted AS vote, CAST(CASE WHEN counted = 'RESIZE' THEN least(target, 8) ELSE -1 END AS INTEGER) AS target FROM k")
def vote_normalise(spark, sf_dir):
    return counted_votes(spark, sf_dir).select("event_id", "vote", "target")


def _sql_consensus(quorum: str) -> str:
    """From votes v(g, vote, target, active_n, next_epoch_ms, skip_cooldown)."""
    return f"""
s AS (SELECT *, CASE WHEN vote <> 'RESIZE' THEN NULL WHEN target > active_n THEN 'grow' WHEN target < active_n THEN 'shrink' ELSE 'rebalance' END AS side FROM w),
a AS (SELECT g, count(*) FILTER (vote = 'KEEP') AS n_keep, count(*) FILTER (vote = 'ABSTAIN') AS n_abstain, count(*) FILTER (side = 'grow') AS n_grow,
 count(*) FILTER (side = 'shrink') AS n_shrink, count(*) FILTER (side = 'rebalance') AS n_rebalance, min(vote) = max(vote) AND min(target) = max(target) AS unanimous,
 max(vote) AS any_vote, max(target) AS any_target, max(active_n) AS active_n,
 quantile_disc(target, 0.5 ORDER BY target) FILTER (side = 'grow') AS grow_to, quantile_disc(target, 0.5 ORDER BY target DESC) FILTER (side = 'shrink') AS shrink_to,
 max(next_epoch_ms) AS next_epoch_ms, bool_and(skip_cooldown) AS skip_cooldown FROM s GROUP BY g),
b AS (SELECT *, n_keep + n_grow + n_shrink + n_rebalance AS voters FROM a),
c AS (SELECT *, greatest(voters // 2 + 1, ceil({quorum} * voters - 1e-9)) AS need FROM b)
SELECT g, active_n, n_keep, n_abstain, n_grow, n_shrink, n_rebalance, unanimous, CAST(CASE WHEN unanimous THEN CASE WHEN any_vote = 'RESIZE' THEN any_target ELSE -1 END
 WHEN voters = 0 OR voters < ceil(0.5 * (voters + n_abstain) - 1e-9) THEN -1 WHEN n_grow >= need THEN grow_to WHEN n_shrink >= need THEN shrink_to
 WHEN n_rebalance >= need THEN active_n ELSE -1 END AS INTEGER) AS target, next_epoch_ms, skip_cooldown FROM c"""


_SQL_VOTES = f"{_RAW_VOTES}, w AS (SELECT epoch AS g, counted AS vote, CASE WHEN counted = 'RESIZE' THEN least(target, 8) ELSE -1 END AS target, active_n, next_epoch_ms, skip_cooldown FROM k)"


@query(f"WITH {_SQL_VOTES}, {_sql_consensus('1.0')}")
def consensus_full(spark, sf_dir):
    votes = counted_votes(spark, sf_dir).withColumnRenamed("epoch", "g")
    return consensus.consensus(votes, ["g"])


@query(f"WITH {_SQL_VOTES}, {_sql_consensus('0.51')}")
def consensus_quorum(spark, sf_dir):
    votes = counted_votes(spark, sf_dir).withColumnRenamed("epoch", "g")
    return consensus.consensus(votes, ["g"], quorum=0.51)


# The scenarios of the vote test (current size, votes with -1 for abstaining, quorum) and the sizes they lead to.
SCENARIOS = (
    ("unanimous", 4, (6, 6, 6, 6), 1.0, 6),
    ("outlier", 4, (5, 8, 6, 6), 1.0, 6),
    ("split", 4, (6, 6, 6, 2), 1.0, 4),
    ("split_quorum", 4, (6, 6, 6, 2), 0.75, 6),
    ("turnout_4", 8, (-1, -1, -1, -1, 6, 6, 6, 6), 1.0, 6),
    ("turnout_5", 8, (-1, -1, -1, -1, -1, 6, 6, 6), 1.0, 8),
    ("rebalance", 4, (4, 4, 4, 4), 1.0, 4),
    ("tie_grow", 4, (5, 5, 7, 7), 1.0, 5),
    ("tie_shrink", 8, (2, 2, 2, 2, 6, 6, 6, 6), 1.0, 6),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {size}::INTEGER, {int(name not in ('split', 'turnout_5'))}::INTEGER)" for name, _, _, _, size in SCENARIOS) + ") t(g, final_size, commits)")
def consensus_scenarios(spark, sf_dir):
    schema = "g string, vote string, target int, active_n int, next_epoch_ms int, skip_cooldown boolean"
    out = None
    for quorum in sorted({q for _, _, _, q, _ in SCENARIOS}):
        rows = [(g, "ABSTAIN" if t < 0 else "RESIZE", t, a, 0, False) for g, a, votes, q, _ in SCENARIOS if q == quorum for t in votes]
        found = consensus.consensus(spark.createDataFrame(rows, schema), ["g"], quorum=quorum)
        out = found if out is None else out.union(found)
    changed = F.col("target") > 0
    return out.select("g", F.when(changed, F.col("target")).otherwise(F.col("active_n")).alias("final_size"), changed.cast("int").alias("commits"))


@query("""
WITH s AS (SELECT user_id, event_id, event_type AS was, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS now FROM events)
SELECT user_id, event_id FROM (SELECT user_id, event_id, was, now, lag(was) OVER w AS old_from, lag(now) OVER w AS old_to FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE now = old_from AND was = old_to AND was <> now""")
def oscillation(spark, sf_dir):
    """Changes that undo the change before."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("was"), F.lead("event_type").over(order).alias("now"))
    back = (F.col("now") == F.lag("was").over(order)) & (F.col("was") == F.lag("now").over(order)) & (F.col("was") != F.col("now"))
    return steps.withColumn("back", back).where("back").select("user_id", "event_id")


@query("""
SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda s, x: 0.5::DOUBLE * s + (1 - 0.5::DOUBLE) * x), 6) AS ewma FROM events GROUP BY 1""")
def ewma(spark, sf_dir):
    return epoch.ewma(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("ewma", F.round("ewma", 6))


@query("""
WITH o AS (SELECT event_id, user_id, value, user_id % 3 + event_id // 1000 AS size, lag(user_id % 3 + event_id // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events),
k AS (SELECT *, sum(CASE WHEN size IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM o),
t AS (SELECT user_id, max(island) AS island FROM k GROUP BY 1)
SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda s, x: 0.9::DOUBLE * s + (1 - 0.9::DOUBLE) * x), 6) AS ewma FROM k JOIN t USING (user_id, island) GROUP BY 1""")
def ewma_reset(spark, sf_dir):
    """The average since the size last changed."""
    rows = table(spark, sf_dir, "events").withColumn("size", F.col("user_id") % 3 + space.quotient(F.col("event_id"), 1000))
    return epoch.ewma(rows, "user_id", "event_id", "value", keep=0.9, reset="size").withColumn("ewma", F.round("ewma", 6))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of eight runs: the epochs of the events in turn."""
    m = metrics(spark, sf_dir)
    return m.select(
        (F.col("epoch") % 8).alias("run_id"),
        "epoch",
        (1 + F.col("epoch") * 5 % 8).cast("int").alias("active_n"),
        "remaining",
        "throughput",
        "max_rem_time",
        "sum_rem_time",
        (F.col("epoch") % 5).cast("int").alias("max_slow_streak"),
        "epoch_elapsed",
        F.lit(0).alias("commits"),
    )


# Decisions of the policies, a token an epoch: phase, size, and the size asked for if any. Throughput follows
# the size by the named curve, and each decision takes effect at once.
POLICY_TRACES = {
    "auto": (
        (16, "usual", False, "IDLE:16>1 NEEDS_BASELINE:1 NEEDS_BASELINE:1 NEEDS_BASELINE:1>16 EXPLORE_MAX:16>8 SEARCHING:8>4 SEARCHING:4>6 SEARCHING:6>7 SEARCHING:7 PROBING:7>8 PROBING:8>7 PROBING:7>8"),
        (8, "usual", False, "IDLE:1>8 EXPLORE_MAX:8>4 SEARCHING:4>6 SEARCHING:6>7 SEARCHING:7 PROBING:7>8 PROBING:8>7"),
    ),
    "throughput": ((8, "usual", False, "IDLE:8>1 NEEDS_BASELINE:1 NEEDS_BASELINE:1 NEEDS_BASELINE:1>8 EXPLORE_MAX:8 PROBING:8 PROBING:8"),),
    "efficiency": ((8, "usual", False, "IDLE:1>8 EXPLORE_MAX:8>4 SEARCHING:4>2 SEARCHING:2>3 SEARCHING:3 PROBING:3>4 PROBING:4>3 PROBING:3>4"),),
    "cost": (
        (8, "capped", False, "RAMP:2>8 RAMP:8 RAMP:8>7 DESCENT:7>6 DESCENT:6>5 DESCENT:5>4 DESCENT:4>5 SETTLED:5"),
        (32, "humped", True, "RAMP:32 RAMP:32>24 SAMPLE:24 SAMPLE:24 SAMPLE:24 SAMPLE:24>16 SAMPLE:16 SAMPLE:16 SAMPLE:16 SAMPLE:16>8 SAMPLE:8 SAMPLE:8 SAMPLE:8 SAMPLE:8>16 SETTLED:16"),
    ),
    "fixed": ((8, "usual", False, ":8>2 :2>4 :4>8 :8"),),
}
CURVES = {"usual": lambda n: 100 * n / (1 + 0.1 * (n - 1)), "capped": lambda n: 100.0 * min(n, 5), "humped": lambda n: 100.0 * n * (33 - n)}


def _tokens(trace: str) -> list[tuple[int, str, int, int]]:
    """(epoch, phase, size, size asked for or -1)."""
    cut = [t.replace(">", ":").split(":") for t in trace.split()]
    return [(e, t[0], int(t[1]), int(t[2]) if len(t) > 2 else -1) for e, t in enumerate(cut)]


def _folded(name: str):
    runs = POLICY_TRACES[name]

    def folded(spark, sf_dir):
        from ..conf import Conf
        from ..streaming.telemetry import METRICS, fold_policy

        out = None
        for k, (universe, curve, iterative, trace) in enumerate(runs):
            rows, commits = [], 0
            for e, _, size, target in _tokens(trace):
                thr = CURVES[curve](size)
                rows.append((k, e, size, 1e9, float(thr), 1e9 / thr, size * 1e9 / thr, 0, 1.0, commits))
                commits += target > 0
            found = fold_policy(spark.createDataFrame(rows, METRICS), Conf(elastic=True, policy=name, sequence="2,2,4,8"), universe, iterative)
            out = found if out is None else out.union(found)
        return out.select("run_id", "epoch", "phase", "active_n", "target", "done")

    folded.__name__ = f"policy_{name}"
    rows = [(k, *t, name == "fixed" and t[3] < 0) for k, run in enumerate(runs) for t in _tokens(run[3])]
    values = ", ".join(f"({k}::BIGINT, {e}::BIGINT, '{phase}', {size}::INTEGER, {target}::INTEGER, {done})" for k, e, phase, size, target, done in rows)
    return query(f"SELECT * FROM (VALUES {values}) t(run_id, epoch, phase, active_n, target, done)")(folded)


for _name in POLICY_TRACES:
    _folded(_name)


# --- elastic runs -----------------------------------------------------------


def resize_scene():
    """Given sizes, and a worker that slows down."""
    from ..conf import Conf
    from .controller import Controller

    buffers = {"x": attach.Access.SHARED_ACTIVE, "y": attach.Access.SHARED_ALL}
    return Controller(8, Conf(elastic=True, policy="fixed", sequence="2,6,3", balancing=True), speed=lambda e, r, n: 300.0 if r == 1 and e > 1 else 600.0, buffers=buffers)


def custom_scene():
    """A policy of the user's own, and a worker that is faster than the others."""
    from ..conf import Conf
    from .controller import Controller
    from .policies import grow_or_shrink

    return Controller(8, Conf(elastic=True, initial_size=2, balancing=True), grow_or_shrink(2, 2), speed=lambda e, r, n: 1000.0 + 7000.0 * (r == e % 2))


def auto_scene():
    """The search policy, with workers that slow each other down."""
    from ..conf import Conf
    from .controller import Controller

    return Controller(8, Conf(elastic=True, initial_size=2, balancing=True, min_horizon_epochs=0.0), speed=lambda e, r, n: 150.0 / (1 + 0.1 * (n - 1)))


HISTORY_KINDS = ("resize", "transfer", "active", "inactive", "cache", "refresh")
# Rows that :func:`resize_scene` and the others must give, from a simulation that deals single indexes (tests/test_elastic.py).
SPANS = {
    "resize_demo": (
        (0, 0, 0, 600), (0, 1, 2500, 3100), (0, 2, 5000, 5600), (0, 3, 7500, 8100), (0, 4, 10000, 10600), (0, 5, 12500, 13100), (0, 6, 15000, 15600), (0, 7, 17500, 18100),
        (1, 0, 600, 1200), (1, 1, 10600, 11200), (2, 0, 1200, 1800), (2, 1, 4133, 4433), (2, 2, 7067, 7500), (2, 2, 8100, 8267), (2, 3, 11200, 11800), (2, 4, 14133, 14733),
        (2, 5, 17067, 17500), (2, 5, 18100, 18267), (3, 0, 1800, 2400), (3, 1, 6289, 6589), (3, 2, 13355, 13955), (4, 0, 2400, 2500), (4, 0, 3100, 3600), (4, 1, 6589, 6889),
        (4, 2, 13955, 14133), (4, 2, 14733, 15000), (4, 2, 15600, 15755), (5, 0, 3600, 4133), (5, 0, 4433, 4500), (5, 1, 6889, 7067), (5, 1, 8267, 8389), (5, 2, 15755, 16355),
        (6, 0, 4500, 5000), (6, 0, 5600, 5700), (6, 1, 8389, 8689), (6, 2, 16355, 16955), (7, 0, 5700, 6289), (7, 1, 8689, 8989), (7, 2, 16955, 17067), (7, 2, 18267, 18755),
        (8, 1, 8989, 9289), (8, 2, 18755, 19355), (9, 1, 9289, 9589), (9, 2, 19355, 19955), (10, 1, 9589, 9889), (10, 2, 19955, 20000), (11, 1, 9889, 10000), (11, 1, 11800, 11989),
        (12, 1, 11989, 12289), (13, 1, 12289, 12500), (13, 1, 13100, 13189), (14, 1, 13189, 13355),
    ),
    "custom_policy": (
        (0, 0, 0, 8000), (0, 1, 25000, 26000), (1, 0, 8000, 9000), (1, 1, 30406, 36938), (1, 2, 36938, 37938), (1, 3, 43469, 44469), (2, 0, 9000, 17000), (2, 2, 37938, 38938),
        (2, 3, 44469, 45469), (3, 0, 17000, 18000), (3, 2, 38938, 39938), (3, 3, 45469, 46469), (4, 0, 18000, 23824), (4, 1, 23824, 24824), (4, 2, 40011, 41011), (4, 3, 41758, 42758),
        (4, 4, 46505, 47505), (4, 5, 48253, 49253), (5, 1, 24824, 25000), (5, 1, 26000, 30406), (5, 1, 39938, 40011), (5, 2, 41011, 41758), (5, 3, 42758, 43469), (5, 3, 46469, 46505),
        (5, 4, 47505, 48253), (5, 5, 49253, 50000),
    ),
    "wave_invariance": (
        (0, 0, 0, 136), (0, 1, 1500, 1636), (1, 0, 136, 286), (2, 0, 286, 436), (3, 0, 436, 586), (4, 0, 586, 736), (5, 0, 736, 886), (6, 0, 886, 974),
        (6, 1, 1133, 1221), (6, 2, 1381, 1469), (6, 3, 1764, 1852), (6, 4, 2011, 2099), (6, 5, 2258, 2346), (6, 6, 2506, 2594), (6, 7, 2753, 2841), (7, 0, 974, 1062),
        (7, 1, 1221, 1309), (7, 2, 1469, 1500), (7, 2, 1636, 1693), (7, 3, 1852, 1940), (7, 4, 2099, 2187), (7, 5, 2346, 2434), (7, 6, 2594, 2682), (7, 7, 2841, 2929),
        (8, 0, 1062, 1133), (8, 1, 1309, 1381), (8, 2, 1693, 1764), (8, 3, 1940, 2011), (8, 4, 2187, 2258), (8, 5, 2434, 2506), (8, 6, 2682, 2753), (8, 7, 2929, 3000),
    ),
}
RESIZE_HISTORY = (
    (0, "resize", None, 2, None, None, None), (0, "transfer", 0, 0, 600, 2500, "keep"), (0, "transfer", 1, 0, 3100, 5000, "move"), (0, "transfer", 2, 0, 5600, 7500, "move"),
    (0, "transfer", 3, 0, 8100, 10000, "move"), (0, "transfer", 4, 1, 10600, 12500, "move"), (0, "transfer", 5, 1, 13100, 15000, "move"), (0, "transfer", 6, 1, 15600, 17500, "move"),
    (0, "transfer", 7, 1, 18100, 20000, "move"), (0, "inactive", 2, None, None, None, None), (0, "inactive", 3, None, None, None, None), (0, "inactive", 4, None, None, None, None),
    (0, "inactive", 5, None, None, None, None), (0, "inactive", 6, None, None, None, None), (0, "inactive", 7, None, None, None, None), (0, "cache", 0, 0, None, None, None),
    (0, "cache", 1, 0, None, None, None), (1, "resize", None, 6, None, None, None), (1, "transfer", 0, 0, 1200, 2500, "keep"), (1, "transfer", 0, 0, 3100, 4133, "keep"),
    (1, "transfer", 0, 1, 4133, 5000, "move"), (1, "transfer", 0, 1, 5600, 7067, "move"), (1, "transfer", 0, 2, 7067, 7500, "move"), (1, "transfer", 0, 2, 8100, 10000, "move"),
    (1, "transfer", 1, 3, 11200, 12500, "move"), (1, "transfer", 1, 3, 13100, 14133, "move"), (1, "transfer", 1, 4, 14133, 15000, "move"), (1, "transfer", 1, 4, 15600, 17067, "move"),
    (1, "transfer", 1, 5, 17067, 17500, "move"), (1, "transfer", 1, 5, 18100, 20000, "move"), (1, "active", 2, None, None, None, None), (1, "active", 3, None, None, None, None),
    (1, "active", 4, None, None, None, None), (1, "active", 5, None, None, None, None), (1, "cache", 0, 1, None, None, None), (1, "cache", 1, 0, None, None, None),
    (1, "cache", 2, 0, None, None, None), (1, "cache", 3, 0, None, None, None), (1, "cache", 4, 0, None, None, None), (1, "cache", 5, 0, None, None, None),
    (1, "refresh", 2, None, None, None, "x"), (1, "refresh", 3, None, None, None, "x"), (1, "refresh", 4, None, None, None, "x"), (1, "refresh", 5, None, None, None, "x"),
    (2, "resize", None, 3, None, None, None), (2, "transfer", 0, 0, 1800, 2500, "keep"), (2, "transfer", 0, 0, 3100, 4133, "keep"), (2, "transfer", 1, 0, 4433, 5000, "move"),
    (2, "transfer", 1, 0, 5600, 6289, "move"), (2, "transfer", 1, 1, 6289, 7067, "keep"), (2, "transfer", 2, 1, 8267, 10000, "move"), (2, "transfer", 3, 1, 11800, 12500, "move"),
    (2, "transfer", 3, 1, 13100, 13355, "move"), (2, "transfer", 3, 2, 13355, 14133, "move"), (2, "transfer", 4, 2, 14733, 15000, "move"), (2, "transfer", 4, 2, 15600, 17067, "move"),
    (2, "transfer", 5, 2, 18267, 20000, "move"), (2, "inactive", 3, None, None, None, None), (2, "inactive", 4, None, None, None, None), (2, "inactive", 5, None, None, None, None),
    (2, "cache", 0, 1, None, None, None), (2, "cache", 1, 0, None, None, None), (2, "cache", 2, 0, None, None, None),
)


def _sql_spans(name: str) -> str:
    return "(VALUES " + ", ".join(f"({w}, {r}, {a}::BIGINT, {b}::BIGINT)" for w, r, a, b in SPANS[name]) + ") t(wave, rank, s, e)"


def _loads(values: DataFrame) -> DataFrame:
    return values.groupBy("wave", "rank").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"), F.sum("data").alias("total"))


def _sql_loads(name: str) -> str:
    return f"SELECT wave, rank, min(s) AS first_i, max(e) - 1 AS last_i, CAST(sum(e - s) AS BIGINT) AS n, CAST(sum((s + 1 + e) * (e - s) // 2) AS DOUBLE) AS total FROM {_sql_spans(name)} GROUP BY 1, 2"


@query(f"""SELECT i, wave, rank, round(1000 * (sin(i + 1.0::DOUBLE) * cos(3000.0::DOUBLE - i) + sqrt((i + 1.0::DOUBLE) * (3000.0::DOUBLE - i))), 4) AS c
FROM (SELECT wave, rank, unnest(range(s, e)) AS i FROM {_sql_spans("wave_invariance")})""")
def wave_invariance(spark, sf_dir):
    """A kernel that runs in waves whose size changes: values are those of one pass, waves and ranks those of the policy."""
    i = F.col("i").cast("double")
    return auto_scene().run(spark, 3_000, lambda s: s.select("i", "wave", "rank", F.round(kernels.elementwise(i + 1, 3000.0 - i), 4).alias("c"))).values


@query(_sql_loads("custom_policy"))
def custom_policy(spark, sf_dir):
    """The exact workload under a policy of the user's own: what each worker computed in each wave."""
    return _loads(custom_scene().run(spark, 50_000, lambda s: s.select("i", "wave", "rank", (F.col("i") + 1.0).alias("data"))).values)


@query(_sql_loads("resize_demo"))
def resize_demo(spark, sf_dir):
    """The exact workload under given sizes and a worker that slows down."""
    return _loads(resize_scene().run(spark, 20_000, lambda s: s.select("i", "wave", "rank", (F.col("i") + 1.0).alias("data"))).values)


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(["NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::{kind}" for x, kind in zip(row, ("BIGINT", "", "INTEGER", "INTEGER", "BIGINT", "BIGINT", ""), strict=True)]) + ")" for row in RESIZE_HISTORY) + ') t(epoch, kind, rank, other, start, "end", note)')
def resize_history(spark, sf_dir):
    """What that run's resizes did: transfers, workers that came and went, caches and replicas."""
    run = resize_scene().run(spark, 20_000, lambda s: s.select("i"))
    return run.history.where(F.col("kind").isin(*HISTORY_KINDS)).select("epoch", "kind", "rank", "other", "start", "end", "note")


@query("""
SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_orderkey) AS hi, min(o_custkey) AS lo, count(*) AS n FROM orders""")
def partial_carry(spark, sf_dir):
    """Reductions whose partial results are carried across resizes."""
    from ..conf import Conf
    from .controller import Controller

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_custkey")
    n = orders.count()
    run = Controller(6, Conf(elastic=True, policy="fixed", sequence="2,5,3"), speed=lambda e, r, k: n / 15)
    a = reduce.Accumulator
    found = [a("cents", "cents"), a("hi", "i", "max"), a("lo", "o_custkey", "min"), a("n", "one")]
    return run.run(spark, n, lambda s: s.join(orders, "i").select("i", "cents", "o_custkey", F.lit(1).cast("long").alias("one")), found).reductions


@query(f"""
WITH s AS (SELECT {_sql_lcg("range + 1", "2")} AS a, {_sql_lcg("range + 1", "3")} AS b FROM range(0, 4000)),
h AS (SELECT CASE WHEN (a / 4294967296.0::DOUBLE) * (a / 4294967296.0::DOUBLE) + (b / 4294967296.0::DOUBLE) * (b / 4294967296.0::DOUBLE) <= 1 THEN 1 ELSE 0 END AS hit FROM s)
SELECT CAST(sum(hit) AS BIGINT) AS hits, count(*) AS points FROM h""")
def montecarlo_plugin(spark, sf_dir):
    """Random points under a policy that a plugin names."""
    from ..conf import Conf
    from .controller import Controller

    run = Controller(6, Conf(elastic=True, policy="rangeflow.plans.policies:step_of_one", initial_size=3, min_horizon_epochs=0.0), speed=lambda e, r, k: 100.0 if r else 400.0)
    a = reduce.Accumulator
    kernel = lambda s: s.select(kernels.inside_circle(F.col("i") + 1).cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    return run.run(spark, 4_000, kernel, [a("hits", "hit"), a("points", "one")]).reductions


@query("""
SELECT range::INTEGER AS step, range % 3 = 0 OR range = 10 AS evaluated, CASE WHEN range <= 3 THEN 4 WHEN range <= 6 THEN 2 ELSE 3 END::INTEGER AS size, (10 - range) * 500.0::DOUBLE AS remaining FROM range(1, 11)""")
def step_loop(spark, sf_dir):
    """Ten steps with a decision after every third and the last."""
    from ..conf import Conf
    from .controller import Steps
    from .store import cut

    loop = Steps(500, 4, Conf(elastic=True, policy="fixed", sequence="2,3", step_epoch=3))
    field, rows = loop.run(kernels.heat_initial(space.loop(spark, 500), 500), 10, lambda f: kernels.stencil_step(f, 500, block=256), cut)
    if field.count() != 500:
        raise RuntimeError("the field lost cells")
    return spark.createDataFrame([(r.step, r.evaluated, r.size, r.remaining) for r in rows], "step int, evaluated boolean, size int, remaining double")


@query("""
WITH s AS (SELECT * FROM (VALUES (0, 8), (1, 1), (2, 1), (3, 1), (4, 8), (5, 4)) t(epoch, size))
SELECT epoch::BIGINT AS epoch, size AS old, round(size * 100 / (1 + 0.1::DOUBLE * (size - 1)), 6) AS value, CASE WHEN epoch > 0 THEN 100.0::DOUBLE END AS thr1,
       CASE WHEN epoch > 0 THEN round(size / (1 + 0.1::DOUBLE * (size - 1)), 6) END AS speedup, CASE WHEN epoch > 0 THEN round(1 / (1 + 0.1::DOUBLE * (size - 1)), 6) END AS eff FROM s""")
def trace_probes(spark, sf_dir):
    """The PROBE rows of a search: throughput, that of one worker, speedup and efficiency."""
    from .. import trace
    from ..conf import Conf
    from .controller import Controller

    run = Controller(8, Conf(elastic=True, policy="auto", min_horizon_epochs=0.0, fast_response=True), speed=lambda e, r, n: 100 / (1 + 0.1 * (n - 1)))
    rows = trace.trace_rows(spark, run.waves(100_000)[:6]).where("tag = 'PROBE'")
    return rows.select("epoch", "old", *[F.round(c, 6).alias(c) for c in ("value", "thr1", "speedup", "eff")])


@query("""
SELECT 'FIXED' AS policy, * FROM (VALUES (0::BIGINT, 8::INTEGER, 4::INTEGER), (1, 4, 2), (2, 2, 8)) t(epoch, old, new)""")
def trace_resizes(spark, sf_dir):
    """The RESIZE rows of a run with a given sequence of sizes."""
    from .. import trace
    from ..conf import Conf
    from .controller import Controller

    waves = Controller(8, Conf(elastic=True, policy="fixed", sequence="4,2,8"), speed=lambda e, r, n: 10.0).waves(400)
    rows = trace.trace_rows(spark, waves).where("tag = 'RESIZE'")
    return rows.select(F.lit("FIXED").alias("policy"), "epoch", "old", "new")


@query("SELECT 'CSV' AS tag, 'matmat' AS example, 4800::BIGINT AS work_items, 0::BIGINT AS errors")
def bench_rows(spark, sf_dir):
    """The bench record of the dense product, whose cells (joined and summed) have a closed form to be checked against."""
    from .. import trace

    expected = (F.col("i") + 1) * 60.0
    off = F.abs(F.col("v") - expected) > 1e-3 * F.abs(expected) + 1e-3
    checked = matmat(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(off).alias("errors")).first()
    rows = trace.bench_rows(spark, [("matmat", "flat", "spark", 1, 1, checked.n, 0.0, checked.errors)])
    return rows.select("tag", "example", "work_items", "errors")
