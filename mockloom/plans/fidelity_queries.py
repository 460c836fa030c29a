"""Fidelity queries over real/synthetic pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mockloom.operators import fidelity as fid
from mockloom.operators import sketches
from mockloom.plans.derive import (
    ACCOUNTS_PAIR, LINEITEM_PAIR, ORDERS_PAIR, accounts_pair, lineitem_pair, orders_pair, table,
)
from mockloom.plans.registry import query
from mockloom.session import scratch_path

# --- SQL building blocks ------------------------------------------------------------


def sql_values(cols: list[str], kind: str, name: str = "vals") -> str:
    """(column_name, value, side) of both tables."""
    parts = [
        f"SELECT '{c}' AS column_name, {c}::{kind} AS value, {side} AS side FROM {t} WHERE {c} IS NOT NULL"
        for c in cols
        for side, t in ((1, "real_t"), (0, "synth_t"))
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def sql_ks(cols: list[str]) -> str:
    return f"""{sql_values(cols, 'DOUBLE', 'nums')},
n_counts AS (SELECT column_name, value, sum(side) AS r, sum(1 - side) AS s FROM nums GROUP BY ALL),
n_cum AS (SELECT *, sum(r) OVER w AS cr, sum(s) OVER w AS cs,
            sum(r) OVER (PARTITION BY column_name) AS nr, sum(s) OVER (PARTITION BY column_name) AS ns
          FROM n_counts WINDOW w AS (PARTITION BY column_name ORDER BY value)),
ks AS (SELECT column_name, max(abs(cr / nr - cs / ns)) AS statistic, max(nr)::BIGINT AS n_real, max(ns)::BIGINT AS n_synth
       FROM n_cum GROUP BY column_name),
ks_p AS (SELECT *, greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k:
            (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * k * k * statistic * statistic
              * (n_real::DOUBLE * n_synth / (n_real + n_synth))))))) AS p_value FROM ks)"""


def sql_categories(cols: list[str]) -> str:
    return f"""{sql_values(cols, 'VARCHAR', 'cats')},
c_counts AS (SELECT column_name, value, sum(side) AS r, sum(1 - side) AS s FROM cats GROUP BY ALL),
c_tot AS (SELECT column_name, sum(r) AS nr, sum(s) AS ns, count(*) AS k FROM c_counts GROUP BY column_name),
c_all AS (SELECT * FROM c_counts JOIN c_tot USING (column_name)),
tvds AS (SELECT column_name, 0.5 * sum(abs(r / nr - s / ns)) AS tvd FROM c_all GROUP BY column_name),
chi AS (SELECT column_name, sum(pow(r - nr * (r + s) / (nr + ns), 2) / (nr * (r + s) / (nr + ns))
                              + pow(s - ns * (r + s) / (nr + ns), 2) / (ns * (r + s) / (nr + ns))) AS chi2_statistic,
               (max(k) - 1)::BIGINT AS degrees_of_freedom FROM c_all GROUP BY column_name)"""


def sql_corr(cols: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT {_corr(a, b)} FROM real_t) AS real_corr, "
        f"(SELECT {_corr(a, b)} FROM synth_t) AS synth_corr"
        for a in cols
        for b in cols
    )
    return f"cells AS ({cells}), diffs AS (SELECT *, abs(real_corr - synth_corr) AS diff FROM cells)"


def _corr(a: str, b: str) -> str:
    if a == b:
        return f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0::DOUBLE END"
    return f"CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END"


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


ORDER_NUMS, ORDER_TEXTS = ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
LABEL = """CASE WHEN {0} >= 0.9 THEN 'Excellent - Synthetic data closely matches real data'
 WHEN {0} >= 0.8 THEN 'Very Good - Minor differences in some distributions'
 WHEN {0} >= 0.7 THEN 'Good - Acceptable quality with some notable differences'
 WHEN {0} >= 0.6 THEN 'Fair - Significant differences that may impact use cases'
 WHEN {0} >= 0.5 THEN 'Poor - Major differences requiring attention'
 ELSE 'Very Poor - Synthetic data significantly differs from real data' END"""

# --- audits -----------------------------------------------------------------------

AUDIT = """SELECT column_name, metric, round(score, 6) AS score, round(1.0 - avg(score) OVER (), 6) AS overall_score FROM (
  SELECT column_name, 'TVD' AS metric, tvd AS score FROM tvds UNION ALL SELECT column_name, 'KS-Stat', statistic FROM ks)"""


@query("audit_quality", f"WITH {ORDERS_PAIR}, {sql_ks(ORDER_NUMS)}, {sql_categories(ORDER_TEXTS)} {AUDIT}")
def audit_quality(spark, sf_dir):
    return rounded(fid.audit_quality(*orders_pair(spark, sf_dir)))


@query(
    "audit_quality_lineitem",
    f"WITH {LINEITEM_PAIR}, {sql_ks(LINE_NUMS)}, {sql_categories(['l_returnflag'])} {AUDIT}",
)
def audit_quality_lineitem(spark, sf_dir):
    return rounded(fid.audit_quality(*lineitem_pair(spark, sf_dir)))


@query(
    "ks_test",
    f"""WITH {ORDERS_PAIR}, {sql_ks(ORDER_NUMS)}
SELECT column_name, round(statistic, 6) AS statistic, n_real, n_synth, round(p_value, 6) AS p_value,
  p_value > 0.05 AS similar_distribution,
  CASE WHEN p_value > 0.05 THEN 'Similar distributions' ELSE 'Different distributions' END AS interpretation FROM ks_p""",
)
def ks_test(spark, sf_dir):
    return rounded(fid.ks_test(*orders_pair(spark, sf_dir)))


@query(
    "ks_stat",
    f"WITH {ACCOUNTS_PAIR}, {sql_ks(['nation', 'balance'])} SELECT column_name, round(statistic, 9) AS statistic, n_real, n_synth FROM ks",
)
def ks_stat(spark, sf_dir):
    return rounded(fid.ks_statistic(*accounts_pair(spark, sf_dir), ["nation", "balance"]), 9)


_SKETCHED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "ks_sketched",
    f"WITH {LINEITEM_PAIR}, {sql_ks(_SKETCHED)} SELECT column_name, round(statistic, 9) AS statistic, n_real, n_synth FROM ks",
)
def ks_sketched(spark, sf_dir):
    """KS from sketches filed batch by batch (the lines of one number): the exact statistic where the sketched one is within the stated error."""
    sides, kept = lineitem_pair(spark, sf_dir), []
    numbers = sorted(r[0] for r in sides[0].union(sides[1]).select("l_linenumber").distinct().collect())  # at most 7
    for side in sides:
        store = scratch_path(spark, "sketches")
        for n in numbers:
            sketches.append_sketch(side.filter(F.col("l_linenumber") == n), _SKETCHED, store, n)
        kept.append(sketches.merged(spark, store))
    exact = fid.ks_statistic(*sides, _SKETCHED).select("column_name", F.col("statistic").alias("exact"))
    near = F.abs(F.col("statistic") - F.col("exact")) <= sketches.ks_error()
    both = sketches.sketched_ks(*kept).join(exact, "column_name").withColumn("statistic", F.when(near, F.col("exact")).otherwise(F.col("statistic")))
    return rounded(both.drop("exact"), 9)


@query(
    "chi2_test",
    f"WITH {ORDERS_PAIR}, {sql_categories(ORDER_TEXTS)} SELECT column_name, round(chi2_statistic, 6) AS chi2_statistic, degrees_of_freedom FROM chi",
)
def chi2_test(spark, sf_dir):
    return rounded(fid.chi_square(*orders_pair(spark, sf_dir)))


# an even number of degrees of freedom has a finite tail sum
CHI_P = """chi_p AS (SELECT *, list_sum(list_transform(range(0, degrees_of_freedom // 2), lambda i:
  pow(chi2_statistic / 2, i) / gamma(i + 1) * exp(-chi2_statistic / 2))) AS p_value FROM chi)"""


@query(
    "chi2_pvalue",
    f"""WITH {ORDERS_PAIR}, {sql_categories(ORDER_TEXTS)}, {CHI_P}
SELECT column_name, round(chi2_statistic, 6) AS chi2_statistic, degrees_of_freedom, round(p_value, 6) AS p_value,
  p_value > 0.05 AS similar_distribution,
  CASE WHEN p_value > 0.05 THEN 'Similar distributions' ELSE 'Different distributions' END AS interpretation FROM chi_p""",
)
def chi2_pvalue(spark, sf_dir):
    return rounded(fid.chi_square_test(*orders_pair(spark, sf_dir)))


@query("tvd", f"WITH {ORDERS_PAIR}, {sql_categories(ORDER_TEXTS)} SELECT column_name, round(tvd, 9) AS tvd FROM tvds")
def tvd(spark, sf_dir):
    return rounded(fid.tvd(*orders_pair(spark, sf_dir), ORDER_TEXTS), 9)


# --- correlation ------------------------------------------------------------------


@query(
    "corr_matrix",
    f"""WITH {LINEITEM_PAIR}, {sql_corr(LINE_NUMS)} SELECT col_a, col_b, round(real_corr, 6) AS real_corr,
round(synth_corr, 6) AS synth_corr, round(diff, 6) AS diff FROM diffs""",
)
def corr_matrix(spark, sf_dir):
    return rounded(fid.correlation_difference(*lineitem_pair(spark, sf_dir)))


CORR_SUMMARY = """corr_sum AS (SELECT max(worst) AS max_diff, avg(typical) AS mean_diff FROM
 (SELECT col_b, max(diff) AS worst, avg(diff) AS typical FROM diffs GROUP BY col_b))"""


@query(
    "corr_preservation",
    f"""WITH {LINEITEM_PAIR}, {sql_corr(LINE_NUMS)}, {CORR_SUMMARY}
SELECT round(max_diff, 6) AS max_correlation_difference, round(mean_diff, 6) AS mean_correlation_difference,
  CASE WHEN max_diff < 0.1 THEN 'Excellent' WHEN max_diff < 0.2 THEN 'Good' WHEN max_diff < 0.3 THEN 'Fair' ELSE 'Poor' END
  AS correlation_preservation_quality FROM corr_sum""",
)
def corr_preservation(spark, sf_dir):
    return rounded(fid.correlation_preservation(*lineitem_pair(spark, sf_dir)))


@query(
    "corr_constant_column",
    f"""WITH {ORDERS_PAIR}, {sql_corr(ORDER_NUMS)} SELECT col_a, col_b, round(real_corr, 6) AS real_corr,
round(synth_corr, 6) AS synth_corr, round(diff, 6) AS diff FROM diffs
UNION ALL SELECT a, b, NULL, NULL, NULL FROM (VALUES ('fixed', 'fixed'), ('fixed', 'o_custkey'), ('fixed', 'o_totalprice'),
 ('o_custkey', 'fixed'), ('o_totalprice', 'fixed')) AS v(a, b)""",
)
def corr_constant_column(spark, sf_dir):
    real, synth = (df.withColumn("fixed", F.lit(1.0)) for df in orders_pair(spark, sf_dir))
    return rounded(fid.correlation_difference(real, synth))


@query(
    "spearman",
    """WITH ranked AS (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)
SELECT round(corr(ra::DOUBLE, rb::DOUBLE), 9) AS spearman, count(*) AS n_rows FROM ranked""",
)
def spearman(spark, sf_dir):
    return rounded(fid.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 9)


# --- statistics -------------------------------------------------------------------


def _stats(side: str, flag: int) -> str:
    v = f"CASE WHEN side = {flag} THEN value END"
    return ", ".join(
        f"round({fn}({v}), 6) AS {side}_{label}"
        for fn, label in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"), ("median", "median"))
    ) + f", count({v}) AS {side}_count"


@query(
    "basic_stats",
    f"""WITH {ORDERS_PAIR}, {sql_values(ORDER_NUMS, 'DOUBLE')}, raw AS (
 SELECT column_name, {_stats('real', 1)}, {_stats('synth', 0)},
   abs(avg(CASE WHEN side = 1 THEN value END) - avg(CASE WHEN side = 0 THEN value END)) / abs(avg(CASE WHEN side = 1 THEN value END)) AS md,
   abs(stddev_samp(CASE WHEN side = 1 THEN value END) - stddev_samp(CASE WHEN side = 0 THEN value END)) / stddev_samp(CASE WHEN side = 1 THEN value END) AS sd
 FROM vals GROUP BY column_name)
SELECT * EXCLUDE (md, sd), round(md, 6) AS relative_mean_difference, round(sd, 6) AS relative_std_difference FROM raw""",
)
def basic_stats(spark, sf_dir):
    return rounded(fid.basic_statistics(*orders_pair(spark, sf_dir)))


@query(
    "row_ratio",
    f"""WITH {LINEITEM_PAIR} SELECT r AS real_data_rows, s AS synthetic_data_rows, round(s / r, 9) AS generation_ratio
FROM (SELECT (SELECT count(*) FROM real_t) AS r, (SELECT count(*) FROM synth_t) AS s)""",
)
def row_ratio(spark, sf_dir):
    return rounded(fid.row_ratio(*lineitem_pair(spark, sf_dir)), 9)


# a constant spread over the partitions of a range sort: no merged variance may leave a residue
_CONST = "SELECT o_custkey::DOUBLE AS k, 0.1::DOUBLE AS fixed FROM orders"


@query(
    "basic_stats_constant",
    f"""WITH real_t AS ({_CONST}), synth_t AS (SELECT k, 0.2::DOUBLE AS fixed FROM ({_CONST}) WHERE k % 2 = 0)
SELECT 'fixed' AS column_name, 0.1::DOUBLE AS real_mean, 0.0::DOUBLE AS real_std, 0.0::DOUBLE AS synth_std, round(0.2::DOUBLE, 6) AS synth_mean,
 (SELECT count(*) FROM real_t) AS real_count, (SELECT count(*) FROM synth_t) AS synth_count, 0.0::DOUBLE AS relative_std_difference""",
)
def basic_stats_constant(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").repartition(16, "o_orderkey")
    frame = lambda df, v: df.select(F.lit(v).alias("fixed"))
    made = fid.basic_statistics(frame(orders, 0.1), frame(orders.filter("o_custkey % 2 = 0"), 0.2))
    return rounded(made.select("column_name", "real_mean", "real_std", "synth_std", "synth_mean", "real_count", "synth_count", "relative_std_difference"))


SCORES = f"""ks_rate AS (SELECT avg((p_value > 0.05)::INT) AS v FROM ks_p),
chi_rate AS (SELECT avg((p_value > 0.05)::INT) AS v FROM chi_p),
corr_score AS (SELECT greatest(0.0, 1.0 - max_diff) AS v FROM corr_sum),
score AS (SELECT ks_rate.v AS k, chi_rate.v AS c, corr_score.v AS r, (ks_rate.v + chi_rate.v + corr_score.v) / 3 AS overall
          FROM ks_rate, chi_rate, corr_score)"""
ORDERS_EVAL = f"""WITH {ORDERS_PAIR}, {sql_ks(ORDER_NUMS)}, {sql_categories(ORDER_TEXTS)}, {CHI_P},
{sql_corr(ORDER_NUMS)}, {CORR_SUMMARY}, {SCORES}"""


@query(
    "quality_score",
    f"""{ORDERS_EVAL} SELECT round(k, 6) AS ks_test_pass_rate, round(c, 6) AS chi2_test_pass_rate,
round(r, 6) AS correlation_preservation_score, round(overall, 6) AS overall_score, {LABEL.format('overall')} AS quality_interpretation FROM score""",
)
def quality_score(spark, sf_dir):
    return rounded(fid.quality_score(*orders_pair(spark, sf_dir)))


@query(
    "quality_label",
    f"""WITH s AS (SELECT l_orderkey, round(l_quantity / 50, 4) AS score FROM lineitem)
SELECT quality, count(*) AS lines FROM (SELECT {LABEL.format('score')} AS quality FROM s) GROUP BY quality""",
)
def quality_label(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_quantity") / 50, 4).alias("score"))
    return lines.groupBy(fid.quality_label(F.col("score")).alias("quality")).agg(F.count(F.lit(1)).alias("lines"))


def _evaluation(spark, sf_dir):
    orders, accounts = orders_pair(spark, sf_dir), accounts_pair(spark, sf_dir)
    return fid.evaluate_tables(
        {"orders": orders[0], "accounts": accounts[0], "unpaired": accounts[0]}, {"orders": orders[1], "accounts": accounts[1]}
    )


def evaluate_sql(name: str, pair: str, nums: list[str], texts: list[str]) -> str:
    """All metrics of one pair in long form, as a parenthesised query."""
    stats = ["mean", "std", "min", "max", "median"]
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
    v = {"real": "CASE WHEN side = 1 THEN value END", "synth": "CASE WHEN side = 0 THEN value END"}
    rows = [
        "SELECT '*' AS c, 'real_data_rows' AS m, (SELECT count(*) FROM real_t)::DOUBLE AS v",
        "SELECT '*', 'synthetic_data_rows', (SELECT count(*) FROM synth_t)::DOUBLE",
        "SELECT '*', 'generation_ratio', (SELECT count(*) FROM synth_t) / (SELECT count(*) FROM real_t)",
        "SELECT column_name, 'ks_statistic', statistic FROM ks_p",
        "SELECT column_name, 'ks_p_value', p_value FROM ks_p",
        "SELECT column_name, 'chi2_statistic', chi2_statistic FROM chi_p",
        "SELECT column_name, 'degrees_of_freedom', degrees_of_freedom::DOUBLE FROM chi_p",
        "SELECT column_name, 'chi2_p_value', p_value FROM chi_p",
        "SELECT '*', 'max_correlation_difference', max_diff FROM corr_sum",
        "SELECT '*', 'mean_correlation_difference', mean_diff FROM corr_sum",
        "SELECT '*', 'overall_score', overall FROM score",
    ]
    for side in v:
        rows += [f"SELECT column_name, '{side}_{s}', {fn[s]}({v[side]}) FROM nums GROUP BY column_name" for s in stats]
        rows.append(f"SELECT column_name, '{side}_count', count({v[side]})::DOUBLE FROM nums GROUP BY column_name")
    for label, s in (("relative_mean_difference", "mean"), ("relative_std_difference", "std")):
        a, b = f"{fn[s]}({v['real']})", f"{fn[s]}({v['synth']})"
        rows.append(f"SELECT column_name, '{label}', abs({a} - {b}) / abs({a}) FROM nums GROUP BY column_name")
    return f"""(WITH {pair}, {sql_ks(nums)}, {sql_categories(texts)}, {CHI_P}, {sql_corr(nums)}, {CORR_SUMMARY}, {SCORES}
SELECT '{name}' AS table_name, c AS column_name, m AS metric, v AS value FROM ({' UNION ALL '.join(rows)}))"""


EVALUATION_SQL = (
    evaluate_sql("orders", ORDERS_PAIR, ORDER_NUMS, ORDER_TEXTS)
    + " UNION ALL "
    + evaluate_sql("accounts", ACCOUNTS_PAIR, ["nation", "balance"], ["segment"])
)


@query("evaluate_tables", f"SELECT table_name, column_name, metric, round(value, 5) AS value FROM ({EVALUATION_SQL})")
def evaluate_tables(spark, sf_dir):
    return rounded(_evaluation(spark, sf_dir), 5)


@query(
    "overall_summary",
    f"""WITH e AS ({EVALUATION_SQL}), s AS (SELECT
 sum(value) FILTER (metric = 'real_data_rows')::BIGINT AS r, sum(value) FILTER (metric = 'synthetic_data_rows')::BIGINT AS s,
 count(*) FILTER (metric = 'real_data_rows') AS n, avg(value) FILTER (metric = 'overall_score') AS q FROM e)
SELECT r AS total_real_rows, s AS total_synthetic_rows, n AS tables_evaluated, round(q, 6) AS average_quality_score,
 round(s / r, 6) AS overall_generation_ratio, {LABEL.format('q')} AS quality_interpretation FROM s""",
)
def overall_summary(spark, sf_dir):
    return rounded(fid.overall_summary(_evaluation(spark, sf_dir)))


# --- shapes and pairs ---------------------------------------------------------------


@query(
    "column_shapes",
    f"""WITH {ORDERS_PAIR}, {sql_ks(ORDER_NUMS)}, {sql_categories(ORDER_TEXTS)}
SELECT column_name, 'TVD' AS metric, round(1 - tvd, 6) AS shape_score FROM tvds
UNION ALL SELECT column_name, 'KS-Stat', round(1 - statistic, 6) FROM ks""",
)
def column_shapes(spark, sf_dir):
    return rounded(fid.column_shapes(*orders_pair(spark, sf_dir)))


PAIR_TRENDS = f"""{sql_corr(ORDER_NUMS)},
joint AS (SELECT o_orderpriority AS a, o_orderstatus AS b, sum(side) AS r, sum(1 - side) AS s FROM (
   SELECT o_orderpriority, o_orderstatus, 1 AS side FROM real_t UNION ALL SELECT o_orderpriority, o_orderstatus, 0 FROM synth_t)
   WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2),
trends AS (SELECT col_a, col_b, 1 - diff / 2 AS pair_score FROM diffs WHERE col_a < col_b
 UNION ALL SELECT 'o_orderpriority', 'o_orderstatus', 1 - 0.5 * sum(abs(r / (SELECT sum(r) FROM joint) - s / (SELECT sum(s) FROM joint))) FROM joint)"""


@query(
    "pair_trends",
    f"WITH {ORDERS_PAIR}, {PAIR_TRENDS} SELECT col_a, col_b, round(pair_score, 6) AS pair_score FROM trends",
)
def pair_trends(spark, sf_dir):
    return rounded(fid.pair_trends(*orders_pair(spark, sf_dir)))


@query(
    "quality_report",
    f"""WITH {ORDERS_PAIR}, {sql_ks(ORDER_NUMS)}, {sql_categories(ORDER_TEXTS)}, {PAIR_TRENDS},
sc AS (SELECT (SELECT avg(x) FROM (SELECT 1 - tvd AS x FROM tvds UNION ALL SELECT 1 - statistic FROM ks)) AS shape,
              (SELECT avg(pair_score) FROM trends) AS pair)
SELECT 'orders' AS table_name, round(shape, 6) AS shape_score, round(pair, 6) AS pair_score, round((shape + pair) / 2, 6) AS overall_score FROM sc""",
)
def quality_report(spark, sf_dir):
    real, synth = orders_pair(spark, sf_dir)
    return rounded(fid.quality_report({"orders": real}, {"orders": synth}))


@query(
    "quality_overall",
    f"""WITH o AS (WITH {ORDERS_PAIR}, {sql_ks(ORDER_NUMS)}, {sql_categories(ORDER_TEXTS)}, {PAIR_TRENDS}
 SELECT (SELECT avg(x) FROM (SELECT 1 - tvd AS x FROM tvds UNION ALL SELECT 1 - statistic FROM ks)) AS shape, (SELECT avg(pair_score) FROM trends) AS pair),
a AS (WITH {ACCOUNTS_PAIR}, {sql_ks(['balance'])} SELECT 1 - statistic AS shape FROM ks)
SELECT 2 AS tables, round((o.shape + a.shape) / 2, 6) AS shape_score, round(pair, 6) AS pair_score, round(((o.shape + pair) / 2 + a.shape) / 2, 6) AS overall_score FROM o, a""",
)
def quality_overall(spark, sf_dir):
    """Scores over two tables; the second has one column and so no pair."""
    orders, accounts = orders_pair(spark, sf_dir), [df.select("balance") for df in accounts_pair(spark, sf_dir)]
    report = fid.quality_report({"orders": orders[0], "accounts": accounts[0]}, {"orders": orders[1], "accounts": accounts[1]})
    return rounded(fid.quality_overall(report))


# --- distribution views --------------------------------------------------------------


@query(
    "histogram_pair",
    f"""WITH {LINEITEM_PAIR}, {sql_values(['l_extendedprice', 'l_quantity'], 'DOUBLE')},
spans AS (SELECT column_name, min(value) AS low, max(value) AS high FROM vals GROUP BY column_name)
SELECT column_name, least(floor((value - low) * 20 / (high - low)), 19)::BIGINT AS bin, sum(side)::BIGINT AS n_real, sum(1 - side)::BIGINT AS n_synth
FROM vals JOIN spans USING (column_name) GROUP BY ALL""",
)
def histogram_pair(spark, sf_dir):
    return fid.histogram_pair(*lineitem_pair(spark, sf_dir), ["l_extendedprice", "l_quantity"])


@query(
    "cdf_pair",
    f"""WITH {LINEITEM_PAIR}, {sql_ks(['l_extendedprice', 'l_quantity'])}
SELECT column_name, value, round(cr / nr, 9) AS cdf_real, round(cs / ns, 9) AS cdf_synth FROM n_cum""",
)
def cdf_pair(spark, sf_dir):
    cdf = fid.cdf_pair(*lineitem_pair(spark, sf_dir), ["l_extendedprice", "l_quantity"])
    return cdf.select("column_name", "value", F.round("cdf_real", 9).alias("cdf_real"), F.round("cdf_synth", 9).alias("cdf_synth"))


# --- integrity -----------------------------------------------------------------------


@query(
    "fk_orphans",
    """SELECT coalesce(sum(n), 0)::BIGINT AS orphan_rows, count(*) AS orphan_keys FROM
 (SELECT o_custkey + 100 AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer)""",
)
def fk_orphans(spark, sf_dir):
    shifted = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("o_custkey"))
    return fid.fk_orphans(shifted, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query(
    "unique_violations",
    """SELECT 'o_custkey' AS column_name, count(*) FILTER (n > 1) AS duplicate_values, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows
 FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
UNION ALL SELECT 'o_orderkey', count(*) FILTER (n > 1), coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)""",
)
def unique_violations(spark, sf_dir):
    return fid.unique_violations(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"])


@query(
    "pk_duplicates",
    """SELECT count(*) AS duplicate_keys, sum(n)::BIGINT AS duplicate_rows FROM
 (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def pk_duplicates(spark, sf_dir):
    return fid.pk_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "not_null_violations",
    f"""WITH {ORDERS_PAIR} SELECT unnest(['o_custkey', 'o_totalprice', 'o_orderstatus']) AS column_name,
 unnest([count(*) - count(o_custkey), count(*) - count(o_totalprice), count(*) - count(o_orderstatus)]) AS violations FROM synth_t""",
)
def not_null_violations(spark, sf_dir):
    return fid.not_null_violations(orders_pair(spark, sf_dir)[1], ["o_custkey", "o_totalprice", "o_orderstatus"])
