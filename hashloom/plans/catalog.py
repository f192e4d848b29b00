"""The registered queries over the driver's tables, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions import oracle as O
from hashloom.functions.kernels import GAMMA, KERNELS, kernel, splitmix64
from hashloom.functions.u64 import lit64, to_text, wrapping
from hashloom.operators import join as J
from hashloom.operators import partition as P
from hashloom.operators import stats as S
from hashloom.sources import generate as G
from hashloom.sources.tables import table

PARTS, FINE, CHUNKS, RANKS = 64, 2048, 4, 4
N, SEED, MAX_KEY = 500, 42, 50

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _keyed(name: str, column: str, key: str = "key") -> Query:
    return lambda spark, d: table(spark, d, name).select(F.col(column).cast("bigint").alias(key))


def wide(df: DataFrame, key: str) -> DataFrame:
    """The key spread over all 64 bits."""
    with wrapping(df.sparkSession):
        return df.withColumn("wide", splitmix64(F.col(key).cast("bigint")))


USERS, CUSTOMERS = _keyed("events", "user_id"), _keyed("orders", "o_custkey")
ORDERS, LINES = _keyed("orders", "o_orderkey"), _keyed("lineitem", "l_orderkey")


def HEAVY(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("l_linenumber") % 2 == 0, F.lit(33)).otherwise(F.col("l_suppkey")).cast("bigint")
    return table(spark, d, "lineitem").select(key.alias("key"))


SUPPLIERS = _keyed("supplier", "s_suppkey")
HEAVY_SQL = "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 33 ELSE l_suppkey END::BIGINT AS key FROM lineitem"
MM = ("SELECT user_id::BIGINT AS key FROM events", "SELECT o_custkey::BIGINT AS key FROM orders")


# --- projections -----------------------------------------------------------

_add(
    "partition_id",
    lambda s, d: P.with_pid(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", FINE).select("o_orderkey", "pid"),
    f"SELECT o_orderkey, {O.kernel('murmur3_32', 'o_custkey', FINE)} AS pid FROM orders",
)


def _hash_query(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        return P.with_pid(wide(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), "wide", FINE, name).select("o_orderkey", "pid")

    return query


for _name in KERNELS:
    _add(
        "partition_id_wide" if _name == "murmur3_32" else f"hash_{_name}",
        _hash_query(_name),
        f"WITH w AS (SELECT o_orderkey, {O.splitmix64('o_orderkey')} AS wide FROM orders) SELECT o_orderkey, {O.kernel(_name, 'wide', FINE)} AS pid FROM w",
    )


def _splitmix(s: SparkSession, d: str) -> DataFrame:
    df = wide(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return df.select("o_orderkey", to_text(F.col("wide")).alias("mixed"))


_add("splitmix64_key", _splitmix, f"SELECT o_orderkey, {O.splitmix64('o_custkey')}::VARCHAR AS mixed FROM orders")
_add(
    "key_bins",
    lambda s, d: S.key_bins(CUSTOMERS(s, d), "key", 1000, 1500),
    "SELECT least(o_custkey::BIGINT * 1000 // 1500, 999)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1",
)

# --- partitioning ----------------------------------------------------------

_PID = O.kernel("murmur3_32", "o_custkey", PARTS)
_HIST = f"h AS (SELECT i.range AS pid, count(o.pid) AS n FROM range({PARTS}) i LEFT JOIN (SELECT {_PID} AS pid FROM orders) o ON o.pid = i.range GROUP BY 1)"
_OFFSETS = f"{_HIST}, f AS (SELECT pid, n, coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM h)"
_CHUNK = f"least(o_orderkey // greatest(1, (SELECT count(*) FROM orders) // {CHUNKS}), {CHUNKS - 1})::BIGINT"
_CHUNKS = f"c AS (SELECT {_CHUNK} AS chunk, {_PID} AS pid, count(*) AS n FROM orders GROUP BY 1, 2)"


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_custkey")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    return P.chunk_histogram(o, "o_orderkey", "o_custkey", o.count(), CHUNKS, PARTS)


_add("partition_checksum", lambda s, d: S.partition_checksum(CUSTOMERS(s, d), "key", FINE), f"SELECT sum({O.kernel('murmur3_32', 'o_custkey', FINE)})::BIGINT::VARCHAR AS checksum FROM orders")
_add("partition_histogram", lambda s, d: P.histogram(CUSTOMERS(s, d), "key", PARTS), f"WITH {_HIST} SELECT pid, n FROM h")
_add("chunk_histogram", _chunks, f"WITH {_CHUNKS} SELECT chunk, pid, n FROM c")
_add("partition_offsets", lambda s, d: P.offsets(P.histogram(CUSTOMERS(s, d), "key", PARTS)), f'WITH {_OFFSETS} SELECT pid, n, b AS "begin", b + n AS "end" FROM f')
_add(
    "write_cursors",
    lambda s, d: P.write_cursors(_chunks(s, d), P.histogram(CUSTOMERS(s, d), "key", PARTS)),
    f'WITH {_OFFSETS}, {_CHUNKS} SELECT chunk, pid, c.n, (b + coalesce(sum(c.n) OVER (PARTITION BY pid ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "next" FROM c JOIN f USING (pid)',
)
_add(
    "scatter_slots",
    lambda s, d: P.scatter_slots(_orders(s, d), "o_orderkey", "o_custkey", PARTS),
    f"WITH {_OFFSETS}, o AS (SELECT o_orderkey, o_custkey, {_PID} AS pid FROM orders) SELECT o_orderkey, o_custkey, pid, (b + row_number() OVER (PARTITION BY pid ORDER BY o_orderkey) - 1)::BIGINT AS slot FROM o JOIN f USING (pid)",
)
_add("partition_layout", lambda s, d: P.layout(CUSTOMERS(s, d), "key", PARTS), f"WITH {_HIST} SELECT pid, n AS rows, true AS all_same_task FROM h")
_add(
    "two_level_histogram",
    lambda s, d: P.two_level_histogram(wide(ORDERS(s, d), "key"), "wide", 8, 16),
    f"WITH w AS (SELECT {O.splitmix64('o_orderkey')} AS wide FROM orders), t AS (SELECT {O.kernel('murmur3_32', 'wide', 8)} AS rank, {O.kernel('murmur3_32', 'wide', 16)} AS pid FROM w) "
    "SELECT r.range AS rank, p.range AS pid, count(t.pid) AS n FROM range(8) r CROSS JOIN range(16) p LEFT JOIN t ON t.rank = r.range AND t.pid = p.range GROUP BY 1, 2",
)


def _exchange(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    return P.rank_exchange(o, "o_orderkey", "o_custkey", o.count(), RANKS)


_add("rank_exchange", _exchange, f"SELECT {_CHUNK} AS src, {O.kernel('murmur3_32', 'o_custkey', RANKS)} AS dst, count(*) AS n FROM orders GROUP BY 1, 2")
_add(
    "load_imbalance",
    lambda s, d: S.load_imbalance(HEAVY(s, d), "key", RANKS),
    f"WITH k AS ({HEAVY_SQL}), h AS (SELECT r.range AS pid, count(k.pid) AS n FROM range({RANKS}) r LEFT JOIN (SELECT {O.kernel('murmur3_32', 'key', RANKS)} AS pid FROM k) k ON k.pid = r.range GROUP BY 1) "
    f"SELECT max(n) AS max_rows, round(sum(n) / {RANKS}.0::DOUBLE, 6) AS mean_rows, round(max(n) - sum(n) / {RANKS}.0::DOUBLE, 6) AS imbalance FROM h",
)

# --- hash quality ----------------------------------------------------------


def _quality_sql(keys: str, name: str, p: int) -> str:
    return (
        f"WITH k AS ({keys}), h AS (SELECT i.range AS pid, count(k.pid) AS n FROM range({p}) i LEFT JOIN (SELECT {O.kernel(name, 'key', p)} AS pid FROM k) k ON k.pid = i.range GROUP BY 1), "
        f"m AS (SELECT max(n) AS most, sum(n)::DOUBLE / {p} AS mean, sum(n * n)::DOUBLE AS squares FROM h) SELECT round(most / mean, 6) AS overload, round(sqrt(greatest(0, squares / {p} - mean * mean)) / mean, 6) AS cv FROM m"
    )


for _name in KERNELS:
    _add(f"hash_quality_{_name}", lambda s, d, name=_name: S.hash_quality(ORDERS(s, d), "key", 256, name), _quality_sql("SELECT o_orderkey::BIGINT AS key FROM orders", _name, 256))
    _add(f"hash_quality_{_name}_multiples", lambda s, d, name=_name: S.hash_quality(G.multiples_of_64(s, 20_000), "key", 1024, name), _quality_sql("SELECT (range + 1) * 64 AS key FROM range(20000)", _name, 1024))

# --- joins -----------------------------------------------------------------


def _join_sql(r: str, s: str, by: str = "") -> str:
    sums = f"count(*) AS join_count, {O.wrap_sum(O.splitmix64('key'))} AS checksum1, {O.wrap_sum(O.splitmix64('key', GAMMA))} AS checksum2"
    return f"WITH r AS ({r}), s AS ({s}), j AS (SELECT r.key FROM r JOIN s USING (key)) SELECT {by + ' AS pid, ' if by else ''}{sums} FROM j" + " GROUP BY 1" * bool(by)


_MM = _join_sql(*MM)
_pair = lambda f: lambda s, d: f(USERS(s, d), CUSTOMERS(s, d))
_add("build_multiplicity", lambda s, d: J.multiplicity(USERS(s, d)), "SELECT user_id::BIGINT AS key, count(*) AS n FROM events GROUP BY 1")
_add(
    "probe_multiplicity",
    lambda s, d: J.probe(J.multiplicity(USERS(s, d)), CUSTOMERS(s, d)),
    "WITH b AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1) SELECT o_custkey::BIGINT AS key, coalesce(n, 0) AS n FROM orders LEFT JOIN b ON key = o_custkey",
)
_add("join_count", lambda s, d: J.join_checksums(ORDERS(s, d), LINES(s, d)).select("join_count"), "SELECT count(*) AS join_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
_add("join_checksums", _pair(J.join_checksums), _MM)
_add("join_checksums_wide", lambda s, d: J.join_checksums(*(wide(f(s, d), "key").select(F.col("wide").alias("key")) for f in (ORDERS, LINES))), _join_sql(f"SELECT {O.splitmix64('o_orderkey')} AS key FROM orders", f"SELECT {O.splitmix64('l_orderkey')} AS key FROM lineitem"))
_add("join_per_partition", _pair(lambda r, s: J.join_per_partition(r, s, 16)), _join_sql(*MM, by=O.kernel("murmur3_32", "key", 16)))
_add("join_partitioned", _pair(lambda r, s: J.join_partitioned(r, s, 16)), _MM)
for _name in J.HINTS:
    _add(f"join_{_name}", _pair(lambda r, s, name=_name: J.join_hinted(r, s, name)), _MM)
_add(
    "join_naive",
    lambda s, d: J.join_naive(_keyed("supplier", "s_nationkey")(s, d), _keyed("customer", "c_nationkey")(s, d), most=1 << 20),
    _join_sql("SELECT s_nationkey::BIGINT AS key FROM supplier", "SELECT c_nationkey::BIGINT AS key FROM customer"),
)
_add("join_skew_salted", lambda s, d: J.join_skew_salted(SUPPLIERS(s, d), HEAVY(s, d)), _join_sql("SELECT s_suppkey::BIGINT AS key FROM supplier", HEAVY_SQL))
_add("join_two_level", _pair(lambda r, s: J.join_two_level(r, s, 8, 16)), _MM)
_add(
    "skewed_partitions",
    lambda s, d: J.skewed_partitions(SUPPLIERS(s, d), HEAVY(s, d), 16),
    f"WITH s AS ({HEAVY_SQL}), a AS (SELECT {O.kernel('murmur3_32', 's_suppkey', 16)} AS pid, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT {O.kernel('murmur3_32', 'key', 16)} AS pid, count(*) AS n FROM s GROUP BY 1), "
    "t AS (SELECT p.range AS pid, coalesce(a.n, 0) AS r_size, coalesce(b.n, 0) AS s_size FROM range(16) p LEFT JOIN a ON a.pid = p.range LEFT JOIN b ON b.pid = p.range) "
    "SELECT * FROM t WHERE greatest(r_size, s_size) > 3 * ((SELECT count(*) FROM s) // 16)",
)

# --- generators ------------------------------------------------------------


def _draw_sql(seed: int, j: str) -> str:
    start = (seed + GAMMA) & ((1 << 64) - 1)
    return O.mix64(f"((({start}::UHUGEINT + ({j})::UHUGEINT * {GAMMA}::UHUGEINT) & {O.M64})::UBIGINT)")


def _generated_sql(kind: str, seed: int) -> str:
    if kind == "one_draw":
        return f"SELECT range AS id, ({_draw_sql(seed, 'range')} % {MAX_KEY}::UBIGINT)::BIGINT AS key FROM range({N})"
    m, key = MAX_KEY, "v"
    if kind == "multiples":
        key = "v // 1000::UBIGINT * 1000::UBIGINT"
    elif kind == "heavy_skew":
        key = f"CASE WHEN die < 50 THEN {m // 3}::UBIGINT ELSE v END"
    elif kind == "step_skew":
        a, b, c = m // 20, m * 3 // 20, m * 3 // 10
        key = f"CASE WHEN die < 40 THEN v % {a}::UBIGINT WHEN die < 70 THEN {a}::UBIGINT + v % {b}::UBIGINT WHEN die < 90 THEN {a + b}::UBIGINT + v % {c}::UBIGINT ELSE {a + b + c}::UBIGINT + v % {m - a - b - c}::UBIGINT END"
    return f"SELECT id, (({key}) % {m}::UBIGINT)::BIGINT AS key FROM (SELECT range AS id, {_draw_sql(seed, '2 * range')} % 100::UBIGINT AS die, {_draw_sql(seed, '2 * range + 1')} AS v FROM range({N}))"


_add("gen_uniform_1draw", lambda s, d: G.one_draw(s, N, SEED, MAX_KEY), _generated_sql("one_draw", SEED))
for _name in G.DISTRIBUTIONS:
    _add(f"gen_{_name}", lambda s, d, name=_name: G.relation(s, N, SEED, MAX_KEY, name), _generated_sql(_name, SEED))
    _add(
        f"join_generated_{_name}",
        lambda s, d, name=_name: J.join_checksums(G.relation(s, N, SEED, MAX_KEY, name), G.relation(s, N, G.other_seed(SEED), MAX_KEY, name)),
        _join_sql(_generated_sql(_name, SEED), _generated_sql(_name, G.other_seed(SEED))),
    )
_add("join_generated_golden", lambda s, d: J.join_checksums(G.one_draw(s, N, SEED, MAX_KEY), G.one_draw(s, N, G.other_seed(SEED), MAX_KEY)), _join_sql(_generated_sql("one_draw", SEED), _generated_sql("one_draw", G.other_seed(SEED))))
_add("gen_sequential", lambda s, d: G.sequential(s, N), f"SELECT range AS id, range AS key FROM range({N})")
_add("gen_multiples64", lambda s, d: G.multiples_of_64(s, N), f"SELECT range AS id, (range + 1) * 64 AS key FROM range({N})")


def _mersenne_sql(n: int, signed: bool = True) -> str:
    """id, key: the first n draws of mt19937_64, its state as one list that grows."""
    mask = f"{(1 << 64) - 1}::UHUGEINT"
    first = f"(((6364136223846793005::UHUGEINT * xor(x[i], x[i] >> 62)::UHUGEINT) & {mask}) + i::UHUGEINT) & {mask}"
    y = "((x[i + 1] & 18446744071562067968::UBIGINT) | (x[i + 2] & 2147483647::UBIGINT))"
    new = f"xor(xor(x[i + 157], {y} >> 1), CASE WHEN {y} & 1 = 1 THEN 13043109905998158313::UBIGINT ELSE 0::UBIGINT END)"
    steps = ("xor(v, (v >> 29) & 6148914691236517205::UBIGINT)", f"xor(v, ((v::UHUGEINT << 17) & {mask})::UBIGINT & 8202884508482404352::UBIGINT)", f"xor(v, ((v::UHUGEINT << 37) & {mask})::UBIGINT & 18444473444759240704::UBIGINT)", "xor(v, v >> 43)")
    tempered = "SELECT j AS id, x[313 + j] AS v FROM (SELECT x, unnest(range(" + str(n) + ")) AS j FROM t WHERE i = " + str(n) + ")"
    for step in steps:
        tempered = f"SELECT id, {step} AS v FROM ({tempered})"
    key = "(v::HUGEINT - CASE WHEN v >= 9223372036854775808::UBIGINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT" if signed else "v"
    return (
        f"WITH RECURSIVE s(i, x) AS (SELECT 1, [{SEED}::UBIGINT] UNION ALL SELECT i + 1, list_append(x, ({first})::UBIGINT) FROM s WHERE i < 312), "
        f"t(i, x) AS (SELECT 0, x FROM s WHERE i = 312 UNION ALL SELECT i + 1, list_append(x, {new}) FROM t WHERE i < {n}) "
        f"SELECT id::BIGINT AS id, {key} AS key FROM ({tempered})"
    )


def _duplicates_sql(n: int, signed: bool = True) -> str:
    return f"SELECT r.range AS id, m.key FROM range({n}) r JOIN ({_mersenne_sql(n // 1000, signed)}) m ON m.id = r.range % {n // 1000}"


_DEALT = 4000
_add("gen_duplicates", lambda s, d: G.duplicates(s, _DEALT, SEED), _duplicates_sql(_DEALT))
_add("gen_mersenne", lambda s, d: G.mersenne_uniform(s, N, SEED), _mersenne_sql(N))

# --- hash quality on the other key kinds, at the published partition count ---

KINDS = {
    "uniform": (lambda s: G.mersenne_uniform(s, N, SEED), f"SELECT key FROM ({_mersenne_sql(N, signed=False)})"),
    "duplicates": (lambda s: G.duplicates(s, _DEALT, SEED), f"SELECT key FROM ({_duplicates_sql(_DEALT, signed=False)})"),
    "sequential": (lambda s: G.sequential(s, 20_000), "SELECT range AS key FROM range(20000)"),
}
for _kind, (_keys, _sql) in KINDS.items():
    for _name in KERNELS:
        _add(f"hash_quality_{_name}_{_kind}", lambda s, d, name=_name, keys=_keys: S.hash_quality(keys(s), "key", 1 << 20, name), _quality_sql(_sql, _name, 1 << 20))

# --- partition distribution over the four key distributions ----------------

_add(
    "partition_bins",
    lambda s, d: S.partition_bins({k: G.relation(s, N, SEED, MAX_KEY, k) for k in G.DISTRIBUTIONS}, 2048),
    f"WITH {', '.join(f'{k} AS (SELECT {O.kernel("murmur3_32", "key", 2048)} AS pid, count(*) AS n FROM ({_generated_sql(k, SEED)}) GROUP BY 1)' for k in G.DISTRIBUTIONS)} "
    f"SELECT p.range AS \"PartitionID\", {', '.join(f'coalesce({k}.n, 0) AS {k}' for k in G.DISTRIBUTIONS)} FROM range(2048) p {' '.join(f'LEFT JOIN {k} ON {k}.pid = p.range' for k in G.DISTRIBUTIONS)}",
)
