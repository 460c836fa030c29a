"""Copula, hierarchy and flow queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mockloom.functions.typemaps import FK_TAG
from mockloom.operators import catalog as cat
from mockloom.operators import copula
from mockloom.operators.fidelity import audit_quality, correlation_difference, fk_orphans, ks_statistic, medians, pk_duplicates, settled
from mockloom.plans import flows
from mockloom.plans.catalog_queries import SCHEMAS, schemas
from mockloom.plans.derive import sql_u32, table
from mockloom.plans.fidelity_queries import evaluate_sql, rounded
from mockloom.plans.registry import query

MODEL_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "copula_marginals",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, i / 32 AS prob, any_value(v) FILTER (rn = greatest(1, ceil(i / 32 * n))) AS quantile
 FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM lineitem), (SELECT unnest(range(0, 33)) AS i) GROUP BY i"""
        for c in MODEL_COLUMNS
    ),
)
def copula_marginals(spark, sf_dir):
    fitted = copula.marginals(table(spark, sf_dir, "lineitem"), MODEL_COLUMNS)
    return fitted.select("column_name", F.posexplode("quantiles").alias("i", "quantile")).select(
        "column_name", (F.col("i") / 32).alias("prob"), "quantile"
    )


WHOLE = ["orders", "lineitem"]
TEXTS = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"]}


def _synthetic(spark, sf_dir, name):
    real = table(spark, sf_dir, name)
    return real, copula.plugin("copula").fit(real).generate(spark, real.count())


def _all_hold(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def near_real(made, real, room):
    """The real table's value where the synthetic one is within ``room`` of it, else the synthetic one: so SQL over the real table alone can check it."""
    return F.when(F.abs(made - real) <= room, real).otherwise(made)


def _sample_sql():
    parts = []
    for t, texts in TEXTS.items():
        for c in texts:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS n, count(*) / (SELECT count(*) FROM {t}) AS share FROM {t} GROUP BY {c}")
        parts.append(f"SELECT '{t}', '', NULL, count(*), 1.0 FROM {t}")
    return f"SELECT table_name, column_name, value, round(share, 6) AS share, CASE WHEN column_name = '' THEN n END AS rows FROM ({' UNION ALL '.join(parts)})"


@query("copula_sample", _sample_sql())
def copula_sample(spark, sf_dir):
    """Rows of the sample, and the share of every value of every text column (the real one where the sample's is within sampling error of it)."""
    parts = []
    for name in WHOLE:
        real, made = _synthetic(spark, sf_dir, name)
        texts = [c for c, t in real.dtypes if t == "string"]
        long = lambda df, side: df.select(F.lit(1).cast("int").alias(side), *texts).unpivot([side], texts, "column_name", "value")
        # a row for each value: kept once, read by the sums and by the shares
        both = settled(long(real, "r").unionByName(long(made, "m"), allowMissingColumns=True).groupBy("column_name", "value").agg(F.sum("r").alias("r"), F.sum("m").alias("m")))
        sums = both.groupBy("column_name").agg(F.sum("r").alias("all_r"), F.sum("m").alias("all_m"))
        shares = both.join(F.broadcast(sums), "column_name")  # a row for each text column
        p, q = F.coalesce("r", F.lit(0)) / F.col("all_r"), F.coalesce("m", F.lit(0)) / F.col("all_m")
        share = near_real(q, p, 5 * F.sqrt(p * (1 - p) / F.col("all_m")))
        parts.append(shares.select(F.lit(name).alias("table_name"), "column_name", "value", F.round(share, 6).alias("share"), F.lit(None).cast("bigint").alias("rows")))
        parts.append(sums.agg(F.max("all_m").alias("rows")).select(F.lit(name).alias("table_name"), F.lit("").alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit(1.0).alias("share"), "rows"))
    return _all_hold(parts)


def _fidelity_sql():
    parts = []
    numbers = {"orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]}
    for t, cols in numbers.items():
        parts += [f"SELECT '{t}' AS table_name, '{c}' AS measure, median({c}::DOUBLE) AS value FROM {t}" for c in cols]
        parts += [f"SELECT '{t}', '{a} {b}', corr({a}, {b}) FROM {t}" for i, a in enumerate(cols) for b in cols[i + 1:]]
        parts += [f"SELECT '{t}', unnest(['largest shape distance', 'largest correlation difference']), 0.0"]
    return f"SELECT table_name, measure, round(value, 6) AS value FROM ({' UNION ALL '.join(parts)})"


@query("copula_fidelity", _fidelity_sql())
def copula_fidelity(spark, sf_dir):
    """Medians and correlations (the real ones where the sample's are near), and the largest distances over all columns, times included, down to a bound."""
    parts = []
    numbers = {"orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]}
    for name, cols in numbers.items():
        real, made = _synthetic(spark, sf_dir, name)
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
        made = settled(made)
        spreads = lambda df: df.agg(*[F.stddev(c).alias(f"spread {c}") for c in cols], *[F.corr(a, b).alias(f"{a} {b}") for a, b in pairs])
        middles = lambda df: medians(df, cols, at_once=True).groupBy().pivot("column_name", cols).agg(F.first("median"))  # a row for each column
        both = reduce(lambda a, b: a.join(b), [
            measure(df).select(F.struct("*").alias(f"{side}{k}")) for k, measure in (("s", spreads), ("m", middles)) for side, df in (("r", real), ("m", made))])
        value = lambda k, side, room: F.struct(F.lit(k).alias("measure"), near_real(F.col(f"m{side}")[k], F.col(f"r{side}")[k], room).alias("value"))
        cells = [value(c, "m", 0.1 * F.col("rs")[f"spread {c}"]) for c in cols] + [value(f"{a} {b}", "s", F.lit(0.06)) for a, b in pairs]
        parts.append(both.select(F.lit(name).alias("table_name"), F.inline(F.array(*cells))))
        for measure, worst, bound in (
                ("largest shape distance", audit_quality(real, made, csv_semantics=False, at_once=True).agg(F.max("score").alias("value")), 0.05),
                ("largest correlation difference", correlation_difference(real, made).agg(F.max("diff").alias("value")), 0.06)):
            parts.append(worst.select(F.lit(name).alias("table_name"), F.lit(measure).alias("measure"), near_real(F.col("value"), F.lit(0.0), bound).alias("value")))
    return _all_hold(parts).withColumn("value", F.round("value", 6))


@query(
    "model_choice",
    f"""WITH {SCHEMAS}, per AS (SELECT user_id, table_name, count(*) AS columns, count(*) FILTER (type IS NULL OR type IN ('VARCHAR', 'TIMESTAMP')) AS text_columns
 FROM attrs GROUP BY ALL)
SELECT *, CASE WHEN columns > 15 THEN 'ctgan' WHEN text_columns > 5 THEN 'vae' ELSE 'copula' END AS model FROM per""",
)
def model_choice(spark, sf_dir):
    return copula.model_choice(cat.flatten(schemas(spark, sf_dir), "user_id"), "user_id")


COUNTS = """counts AS (SELECT c_custkey, count(o_orderkey) AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""


def _counts(spark, sf_dir):
    return copula.child_counts(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "fk"), "fk")


@query("hma_cardinality", f"WITH {COUNTS} SELECT children, count(*) AS parents FROM counts GROUP BY children")
def hma_cardinality(spark, sf_dir):
    return copula.cardinality_histogram(_counts(spark, sf_dir))


@query(
    "hma_children",
    f"""WITH {COUNTS}, k AS (SELECT children, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM counts),
ids AS (SELECT unnest(range(1, 2 * (SELECT count(*) FROM customer) + 1)) AS id),
drawn AS (SELECT id, children FROM (SELECT id, {sql_u32(42, 'hma', 'children', 'id')} % (SELECT count(*) FROM customer) AS n FROM ids) JOIN k USING (n))
SELECT id AS parent, unnest(range(1, children + 1)) AS ordinal FROM drawn""",
)
def hma_children(spark, sf_dir):
    ids = spark.range(1, 2 * table(spark, sf_dir, "customer").count() + 1)
    return copula.spread_children(copula.synthetic_counts(_counts(spark, sf_dir), "c_custkey", ids), chunk=5)


_SHOP = {
    "databases": [{"name": "shop", "tables": [
        {"name": "customer", "attributes": [{"name": "c_custkey", "type": "BIGINT", "constraints": ["PRIMARY_KEY"]}]},
        {"name": "orders", "attributes": [
            {"name": "o_orderkey", "type": "BIGINT", "constraints": ["PRIMARY_KEY"]},
            {"name": "o_custkey", "type": "BIGINT", "constraints": [FK_TAG + "customer.c_custkey"]},
        ]},
        {"name": "lineitem", "attributes": [{"name": "l_orderkey", "type": "BIGINT", "constraints": [FK_TAG + "orders.o_orderkey"]}]},
    ]}]
}
#: Child table, foreign key, parent table, its key, and child columns whose spread within parents is compared.
_FAMILIES = [
    ("orders", "o_custkey", "customer", "c_custkey", ["o_totalprice", "o_orderdate"]),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", ["l_quantity", "l_linenumber", "l_shipdate"]),
]


def _family_sql(child, fk, parent, key, columns):
    counts = f"(SELECT p.{key}, count(c.{fk}) AS n FROM {parent} p LEFT JOIN {child} c ON c.{fk} = p.{key} GROUP BY p.{key})"
    yield f"SELECT '{child}' AS table_name, 'rows' AS measure, 2.0 * count(*) AS value FROM {child}"
    yield f"SELECT '{child}', unnest(['orphan rows', 'KS of children per parent']), 0.0"
    yield f"SELECT '{child}', 'children per parent', avg(n) FROM {counts}"
    yield f"SELECT '{child}', 'parents without children', avg((n = 0)::INT) FROM {counts}"
    for c in columns:
        x = f"epoch({c})" if c.endswith("date") else c
        yield f"""SELECT '{child}', 'spread of {c} within parents', sum(n * v) / sum(n) / any_value(t) FROM
 (SELECT count({x}) AS n, var_pop({x}) AS v FROM {child} GROUP BY {fk}), (SELECT var_pop({x}) AS t FROM {child})"""


@query(
    "flow_complete",
    "SELECT table_name, measure, round(value::DOUBLE, 6) AS value FROM (SELECT 'customer' AS table_name, 'rows' AS measure, 2.0 * count(*) AS value FROM customer"
    " UNION ALL SELECT unnest(['customer', 'orders']), 'duplicate keys', 0.0 UNION ALL " + " UNION ALL ".join(q for f in _FAMILIES for q in _family_sql(*f)) + ")",
)
def flow_complete(spark, sf_dir):
    """Three tables scaled up twofold, children following their parents: sizes, keys, children of a parent and
    what their columns' spread within a parent is of the whole. The real value stands where the synthetic one is near it."""
    real = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    rows = {t: df.count() for t, df in real.items()}
    made = {t: settled(df) for t, df in flows.scale_up(spark, _SHOP, real, rows).items()}
    parts = []

    def add(t, measure, df, wanted, room):
        parts.append(df.select(F.lit(t).alias("table_name"), F.lit(measure).alias("measure"), near_real(F.col("value").cast("double"), wanted, room).alias("value")))

    size = lambda t: made[t].agg(F.count(F.lit(1)).alias("value"))
    add("customer", "rows", size("customer"), F.lit(2.0 * rows["customer"]), 0)
    for t, key in (("customer", "c_custkey"), ("orders", "o_orderkey")):
        add(t, "duplicate keys", pk_duplicates(made[t], [key]).select(F.col("duplicate_keys").alias("value")), F.lit(0.0), 0)
    for child, fk, parent, key, columns in _FAMILIES:
        add(child, "rows", size(child), F.lit(2.0 * rows[child]), 0.05 * 2 * rows[child])
        add(child, "orphan rows", fk_orphans(made[child], fk, made[parent], key).select(F.col("orphan_rows").alias("value")), F.lit(0.0), 0)
        counts = [copula.child_counts(side[parent], key, side[child].select(F.col(fk).alias("_fk")), "_fk").select("children") for side in (real, made)]
        noise = 1.5 * (3 / (2 * rows[parent])) ** 0.5  # of two samples of this size
        add(child, "KS of children per parent", ks_statistic(*counts, ["children"]).select(F.col("statistic").alias("value")), F.lit(0.0), 0.05 + noise)
        measures = [F.avg("children").alias("children per parent"), F.avg((F.col("children") == 0).cast("double")).alias("parents without children")]
        both = [c.agg(*measures) for c in counts]
        for m, room in (("children per parent", F.lit(0.05) * F.col("real")), ("parents without children", F.lit(0.02 + noise))):
            add(child, m, both[0].select(F.col(m).alias("real")).join(both[1].select(F.col(m).alias("value"))), F.col("real"), room)
        for c in columns:
            shares = []
            for side, name in ((real, "real"), (made, "value")):
                x = (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if c.endswith("date") else F.col(c)).cast("double").alias("x")
                values = side[child].select(fk, x)
                within = values.groupBy(fk).agg(F.count("x").alias("n"), F.var_pop("x").alias("v")).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("w"))
                shares.append(within.join(values.agg(F.var_pop("x").alias("t"))).select((F.col("w") / F.col("t")).alias(name)))
            add(child, f"spread of {c} within parents", shares[0].join(shares[1]), F.col("real"), F.lit(0.1))
    return _all_hold(parts).withColumn("value", F.round("value", 6))


@query("flow_quick", "SELECT 2 * count(*) AS rows, 2 * count(*) AS keys, true AS known_kinds FROM orders")
def flow_quick(spark, sf_dir):
    schema = {"databases": [{"tables": [{"name": "notes", "attributes": [
        {"name": "id", "type": "BIGINT", "constraints": ["PRIMARY_KEY"]}, {"name": "weight", "type": "FLOAT"}, {"name": "kind", "type": "ENUM"}]}]}]}
    notes = flows.quick(spark, schema, {"notes": table(spark, sf_dir, "orders").count()})["notes"]
    return notes.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("keys"), F.bool_and(F.col("kind").isNotNull() & F.col("weight").isNotNull()).alias("known_kinds")
    )


_LINES = """real_t AS (SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE l_linestatus = 'O'),
synth_t AS (SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE l_linestatus = 'F')"""


@query(
    "flow_evaluation_only",
    f"SELECT table_name, column_name, metric, round(value, 5) AS value FROM ({evaluate_sql('lineitem', _LINES, ['l_quantity', 'l_extendedprice'], ['l_returnflag'])})",
)
def flow_evaluation_only(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda s: lines.filter(F.col("l_linestatus") == s).select("l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(flows.evaluation_only({"lineitem": side("O")}, {"lineitem": side("F")}), 5)
