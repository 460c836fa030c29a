"""Privacy queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mockloom.operators import dp, mondrian, nearest, privacy
from mockloom.plans.derive import (
    ACCOUNTS_PAIR, LINEITEM_PAIR, ORDERS_PAIR, accounts_pair, lineitem_pair, orders_pair, sql_uniform, table,
)
from mockloom.plans.fidelity_queries import rounded
from mockloom.plans.registry import query

LEAK = "leak AS (SELECT count(*) AS shared_rows FROM (SELECT * FROM real_t INTERSECT SELECT * FROM synth_t))"


@query(
    "leakage_rate",
    f"""WITH {LINEITEM_PAIR}, {LEAK} SELECT shared_rows, (SELECT count(*) FROM synth_t) AS synthetic_rows,
 round(shared_rows / (SELECT count(*) FROM synth_t), 9) AS leakage_rate FROM leak""",
)
def leakage_rate(spark, sf_dir):
    return rounded(privacy.leakage_rate(*lineitem_pair(spark, sf_dir)), 9)


@query(
    "leakage_rate_extra_columns",
    """WITH hits AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT count(*) AS shared_rows, (SELECT count(*) FROM supplier) AS synthetic_rows, round(count(*) / (SELECT count(*) FROM supplier), 6) AS leakage_rate FROM hits""",
)
def leakage_rate_extra_columns(spark, sf_dir):
    real = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_mktsegment")
    synth = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name")
    return rounded(privacy.leakage_rate(real, synth))


@query(
    "privacy_audit",
    f"""WITH {ORDERS_PAIR}, {LEAK}, r AS (SELECT shared_rows / (SELECT count(*) FROM synth_t) AS v FROM leak)
SELECT round(v, 9) AS leakage_rate, CASE WHEN v < 0.05 THEN 'safe' ELSE 'risk' END AS status,
 CASE WHEN v >= 0.05 THEN 'Use Differential Privacy' ELSE 'Proceed' END AS recommendation FROM r""",
)
def privacy_audit(spark, sf_dir):
    return rounded(privacy.privacy_audit(*orders_pair(spark, sf_dir)), 9)


@query(
    "k_anonymity",
    """SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
 QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= 8""",
)
def k_anonymity(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return privacy.k_anonymity(people, 8, ["c_nationkey", "c_mktsegment"])


@query(
    "k_anonymity_generalised",
    """SELECT band, c_nationkey, count(*) AS n FROM (SELECT floor(c_acctbal / 1000)::BIGINT AS band, c_nationkey FROM customer) GROUP BY ALL HAVING count(*) >= 6""",
)
def k_anonymity_generalised(spark, sf_dir):
    coarse = privacy.generalise(table(spark, sf_dir, "customer"), {"band": F.floor(F.col("c_acctbal") / 1000)})
    kept = privacy.k_anonymity(coarse.select("band", "c_nationkey"), 6, ["band", "c_nationkey"])
    return kept.groupBy("band", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k_anonymity_mondrian",
    """SELECT count(*) AS rows, 0 AS rows_outside_their_box, 0 AS rows_in_small_boxes, true AS even_boxes, true AS loses_less_than_fixed_bands FROM customer""",
)
def k_anonymity_mondrian(spark, sf_dir):
    """Boxes found by splits at medians: every row stays and lies in its box, no box is small, and less is given away than by bands of fixed width."""
    people, quasi, k = table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"], 40
    made = mondrian.anonymise(people, k, quasi).join(people.select("c_custkey", *quasi), "c_custkey")
    new = [f"{c}_{e}" for c in quasi for e in ("low", "high", "null")]
    inside = [F.coalesce((F.col(c) >= F.col(f"{c}_low")) & (F.col(c) <= F.col(f"{c}_high")), F.col(f"{c}_null")) for c in quasi]
    boxes = made.groupBy(*new).agg(F.count(F.lit(1)).alias("n"), F.count_if(~(inside[0] & inside[1] & inside[2])).alias("outside"))
    sums = boxes.agg(
        F.sum("n").alias("rows"), F.sum("outside").alias("rows_outside_their_box"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("rows_in_small_boxes"),
        (F.avg("n") < 3 * k).alias("even_boxes"))
    cells, sizes = mondrian.boxes_of(people, k, quasi)
    own = mondrian.loss(cells, "box", sizes).withColumnRenamed("loss", "own")
    # bands of a thousand and segments; what is in groups under k is suppressed and counts as lost
    band = F.floor(F.col("c_acctbal") / 1000).alias("band")
    fixed = cells.select("n", *[f"c{i}" for i in range(3)], band, "c_mktsegment", F.floor(F.col("c_nationkey") / 5).alias("region"))
    kept = fixed.withColumn("all", F.sum("n").over(Window.partitionBy("band", "c_mktsegment", "region")))
    share = kept.agg((F.sum(F.when(F.col("all") >= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    given = mondrian.loss(kept.where(F.col("all") >= k), ["band", "c_mktsegment", "region"], sizes).join(share)
    less = own.join(given).select((F.col("own") < F.coalesce("loss", F.lit(0.0)) * F.col("share") + (1 - F.col("share"))).alias("loses_less_than_fixed_bands"))
    return sums.join(less)


def _scaled_sql(cols: list[str]) -> str:
    """Distinct scaled points r and weighted points s of the pair."""
    bounds = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols))
    scale = ", ".join(f"({c} - lo{i}) / (hi{i} - lo{i}) AS x{i}" for i, c in enumerate(cols))
    some = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    listed, xs = ", ".join(f"{c}::DOUBLE AS {c}" for c in cols), ", ".join(f"x{i}" for i in range(len(cols)))
    return f"""span AS (SELECT {bounds} FROM (SELECT {listed} FROM real_t UNION ALL SELECT {listed} FROM synth_t)),
r AS (SELECT DISTINCT {scale} FROM real_t, span WHERE {some}),
s AS (SELECT {xs}, count(*) AS weight FROM (SELECT {scale} FROM synth_t, span WHERE {some}) GROUP BY ALL)"""


def _distance_sql(d: int) -> str:
    return "sqrt(min(" + " + ".join(f"(r.x{i} - s.x{i}) * (r.x{i} - s.x{i})" for i in range(d)) + "))"


@query(
    "dcr_exact",
    f"""WITH {ACCOUNTS_PAIR}, {_scaled_sql(['nation', 'balance'])} SELECT round(s.x0, 9) AS x0, round(s.x1, 9) AS x1, weight, round({_distance_sql(2)}, 9) AS distance
 FROM s, r GROUP BY s.x0, s.x1, weight""",
)
def dcr_exact(spark, sf_dir):
    return rounded(nearest.closest(*accounts_pair(spark, sf_dir), ["nation", "balance"]), 9)


@query(
    "dcr_summary",
    f"""WITH {ORDERS_PAIR}, {_scaled_sql(['o_custkey', 'o_totalprice'])}, near AS (SELECT s.x0, s.x1, weight, {_distance_sql(2)} AS distance FROM s, r GROUP BY ALL)
SELECT sum(weight)::BIGINT AS synthetic_rows, round(sum(weight * distance) / sum(weight), 9) AS dcr_score, round(min(distance), 9) AS closest,
 round(sum(CASE WHEN distance = 0 THEN weight ELSE 0 END) / sum(weight), 9) AS copied_share FROM near""",
)
def dcr_summary(spark, sf_dir):
    return rounded(nearest.dcr_summary(nearest.closest(*orders_pair(spark, sf_dir), ["o_custkey", "o_totalprice"])), 9)


_BAL = ["nation", "balance"]


@query(
    "privacy_report",
    """WITH synth_t AS (SELECT s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier),
train AS (SELECT c_nationkey::DOUBLE AS nation, c_acctbal AS balance FROM customer WHERE c_mktsegment <> 'BUILDING'),
holdout AS (SELECT c_nationkey::DOUBLE AS nation, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'),
span AS (SELECT min(nation) AS n0, max(nation) AS n1, min(balance) AS b0, max(balance) AS b1 FROM (SELECT * FROM synth_t UNION ALL SELECT * FROM train UNION ALL SELECT * FROM holdout)),
s AS (SELECT x, y, count(*) AS w FROM (SELECT (nation - n0) / (n1 - n0) AS x, (balance - b0) / (b1 - b0) AS y FROM synth_t, span) GROUP BY ALL),
t AS (SELECT (nation - n0) / (n1 - n0) AS x, (balance - b0) / (b1 - b0) AS y FROM train, span),
h AS (SELECT (nation - n0) / (n1 - n0) AS x, (balance - b0) / (b1 - b0) AS y FROM holdout, span),
a AS (SELECT s.x, s.y, w, sqrt(min((s.x - t.x) ** 2 + (s.y - t.y) ** 2)) AS dt FROM s, t GROUP BY ALL),
b AS (SELECT s.x, s.y, sqrt(min((s.x - h.x) ** 2 + (s.y - h.y) ** 2)) AS dh FROM s, h GROUP BY ALL),
m AS (SELECT sum(w * dt) / sum(w) AS dcr, sum(CASE WHEN dt < dh THEN w ELSE 0 END) / sum(w) AS mi, sum(w)::BIGINT AS n FROM a JOIN b USING (x, y))
SELECT round(dcr, 9) AS dcr_score, round(mi, 9) AS membership_inference_risk, n AS synthetic_rows,
 CASE WHEN dcr < 0.001 OR abs(mi - 0.5) > 0.4 THEN 'high' WHEN dcr < 0.01 OR abs(mi - 0.5) > 0.2 THEN 'medium' ELSE 'low' END AS risk_level FROM m""",
)
def privacy_report(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    building = F.col("c_mktsegment") == "BUILDING"
    synth = accounts_pair(spark, sf_dir)[1]
    return rounded(nearest.privacy_report(people.filter(~building), people.filter(building), synth, _BAL), 9)


def _attack_sql(kind: str, made: str) -> str:
    gap = lambda p: f"min((m.x - {p}.x) ** 2 + (m.y - {p}.y) ** 2)"
    return f"""SELECT '{kind}' AS synthetic, count(*) FILTER (member) AS members, count(*) FILTER (NOT member) AS others, round(avg(v) FILTER (member), 9) AS auc,
 round(sqrt(var_samp(v) FILTER (member) / count(*) FILTER (member) + var_samp(v) FILTER (NOT member) / count(*) FILTER (NOT member)), 9) AS std_error, round(max(gap), 9) AS advantage FROM (
 SELECT member, CASE WHEN member THEN (os - cum_o + o / 2) / os ELSE (cum_m - m / 2) / ms END AS v, cum_m / ms - cum_o / os AS gap FROM (
  SELECT member, sum((member)::INT) OVER w AS cum_m, sum((NOT member)::INT) OVER w AS cum_o, sum((member)::INT) OVER t AS m, sum((NOT member)::INT) OVER t AS o,
   sum((member)::INT) OVER () AS ms, sum((NOT member)::INT) OVER () AS os
  FROM (SELECT p.member, round(sqrt(near), 9) AS d FROM p JOIN (SELECT m.x, m.y, {gap('s')} AS near FROM (SELECT DISTINCT x, y FROM ({made[1]})) m, (SELECT DISTINCT x, y FROM ({made[0]})) s GROUP BY ALL) n
    ON n.x = (p.nation - {made[2]}) / ({made[3]} - {made[2]}) AND n.y = (p.balance - {made[4]}) / ({made[5]} - {made[4]}))
  WINDOW w AS (ORDER BY d), t AS (PARTITION BY d)))"""


def _attacked(kind: str, synth: str) -> str:
    """Scaling over the people and the synthetic rows, then the attack."""
    both = f"(SELECT nation, balance FROM p UNION ALL SELECT nation, balance FROM {synth})"
    low = {f"{f}{c}": f"(SELECT {f}({c}) FROM {both})" for c in ("nation", "balance") for f in ("min", "max")}
    bounds = [low["minnation"], low["maxnation"], low["minbalance"], low["maxbalance"]]
    place = lambda t: f"SELECT (nation - {bounds[0]}) / ({bounds[1]} - {bounds[0]}) AS x, (balance - {bounds[2]}) / ({bounds[3]} - {bounds[2]}) AS y FROM {t}"
    return _attack_sql(kind, [place(synth), place("p"), *bounds])


@query(
    "membership_attack",
    f"""WITH p AS (SELECT c_nationkey::DOUBLE AS nation, c_acctbal AS balance, c_mktsegment <> 'BUILDING' AS member FROM customer),
free AS (SELECT s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier), copied AS (SELECT nation, balance FROM p WHERE member)
{_attacked('independent', 'free')} UNION ALL {_attacked('copied', 'copied')}""",
)
def membership_attack(spark, sf_dir):
    """The attack on suppliers' accounts as synthetic customers, which know no customer, and on copies of the training data."""
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    building = F.col("c_mktsegment") == "BUILDING"
    train, holdout = people.filter(~building), people.filter(building)
    runs = [nearest.membership_attack(train, holdout, synth, _BAL).select(F.lit(kind).alias("synthetic"), "members", "others", "auc", "std_error", "advantage")
            for kind, synth in (("independent", accounts_pair(spark, sf_dir)[1]), ("copied", train))]
    return rounded(runs[0].unionByName(runs[1]), 9)


# --- closest record over numbers, texts and nulls ----------------------------------------------

_MIXED = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]


def _mixed_sql() -> str:
    """Coordinates of both sides of the pair: scaled numbers, places of texts, -1 for null."""
    both = f"(SELECT {', '.join(_MIXED)} FROM real_t UNION ALL SELECT {', '.join(_MIXED)} FROM synth_t)"
    span = ", ".join(f"min({c})::DOUBLE AS lo{i}, max({c})::DOUBLE AS hi{i}" for i, c in enumerate(_MIXED[:2]))
    code = " ".join(
        f", c{i} AS (SELECT {c} AS v, (row_number() OVER (ORDER BY encode({c})) - 1 + 0.5::DOUBLE) / count(*) OVER () AS code FROM (SELECT DISTINCT {c} FROM {both} WHERE {c} IS NOT NULL))"
        for i, c in enumerate(_MIXED) if i > 1)
    xs = [f"coalesce(({c} - lo{i}) / (hi{i} - lo{i}), -1)" for i, c in enumerate(_MIXED[:2])] + ["coalesce(c2.code, -1)", "coalesce(c3.code, -1)"]
    listed = ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs))
    side = lambda t: f"(SELECT {listed} FROM {t} CROSS JOIN span LEFT JOIN c2 ON c2.v = {_MIXED[2]} LEFT JOIN c3 ON c3.v = {_MIXED[3]})"
    gap = lambda i: f"CASE WHEN (r.x{i} < 0) <> (s.x{i} < 0) THEN 1 WHEN r.x{i} < 0 THEN 0 ELSE pow(r.x{i} - s.x{i}, 2) END"
    total = f"{gap(0)} + {gap(1)} + (r.x2 <> s.x2)::INT + (r.x3 <> s.x3)::INT"
    return f"""WITH {ORDERS_PAIR}, span AS (SELECT {span} FROM {both}){code},
r AS (SELECT DISTINCT * FROM {side('real_t')}), s AS (SELECT x0, x1, x2, x3, count(*) AS weight FROM {side('synth_t')} GROUP BY ALL),
n AS (SELECT s.x0, s.x1, s.x2, s.x3, weight, sqrt(min({total})) AS distance FROM s, r GROUP BY ALL)"""


@query(
    "dcr_mixed",
    _mixed_sql() + " SELECT round(x0, 9) AS x0, round(x1, 9) AS x1, round(x2, 9) AS x2, round(x3, 9) AS x3, weight, round(distance, 9) AS distance FROM n",
)
def dcr_mixed(spark, sf_dir):
    """Distance to the closest record over numbers, texts and nulls."""
    real, synth = orders_pair(spark, sf_dir)
    return rounded(nearest.closest(real, synth, _MIXED, nulls=True), 9)


@query(
    "dcr_lsh",
    _mixed_sql() + " SELECT sum(weight)::BIGINT AS synthetic_rows, count(*) AS points, 0 AS too_near, true AS recall_reached, round(avg(distance), 3) AS mean_distance FROM n",
)
def dcr_lsh(spark, sf_dir):
    """The same by random projections, held against the exact search: recall of 0.9 or more, no distance too small."""
    real, synth = orders_pair(spark, sf_dir)
    xs = [f"x{i}" for i in range(len(_MIXED))]
    exact = nearest.closest(real, synth, _MIXED, nulls=True).withColumnRenamed("distance", "exact")
    both = nearest.closest_projected(real, synth, _MIXED).join(exact.drop("weight"), xs)
    met = F.avg((F.col("distance") <= F.col("exact") + 1e-9).cast("double"))
    near = F.avg("distance")
    return both.agg(
        F.sum("weight").alias("synthetic_rows"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("distance") < F.col("exact") - 1e-9).alias("too_near"),
        (met >= 0.9).alias("recall_reached"), F.round(F.when(near - F.avg("exact") <= 0.002, F.avg("exact")).otherwise(near), 3).alias("mean_distance"))


# The given tables have few users: a large delta and epsilon let some groups be named.
_DELTA = 0.01


def _noise_sql(what: str, scale: float, key: str = "g") -> str:
    z = f"({sql_uniform(42, 'dp', what, key)} - 0.5)"
    return f"(-sign({z}) * {scale!r} * ln(greatest(1 - abs({z}) * 2, pow(2.0, -32))))"


@query(
    "dp_counts",
    f"""WITH pairs AS (SELECT DISTINCT user_id AS u, event_type AS g FROM events),
kept AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY u ORDER BY md5(u || '|' || g)) <= 3),
c AS (SELECT g, count(*) + {_noise_sql('event_type', 6.0)} AS noisy FROM kept GROUP BY g)
SELECT g AS group_value, round(noisy, 6) AS noisy_users FROM c WHERE noisy >= {dp.threshold(0.5, _DELTA, 3)!r}""",
)
def dp_counts(spark, sf_dir):
    return rounded(privacy.dp_counts(table(spark, sf_dir, "events"), "user_id", "event_type", epsilon=0.5, max_groups=3, seed=42, delta=_DELTA))


_BAND = "event_type || CASE WHEN value >= 250 THEN ' over 250' WHEN value >= 100 THEN ' over 100' ELSE '' END"
_EPSILON, _GROUPS, _TOP = 24.0, 6, 400.0
_PART = _EPSILON / 5  # users, sums, means and two quantiles


def _quantile_sql(share: float) -> str:
    key = "g || '|' || cell"
    score = f"-abs(below - n * {share}) * {_PART / _GROUPS / 2!r} + ln(run) - ln(-ln(greatest({sql_uniform(42, 'dp', f'band#q{share}', key)}, pow(2.0, -33))))"
    return f"""(SELECT g, (c.cell + floor({sql_uniform(42, 'dp', f'band#i{share}', 'g')} * c.run) + 1) * {_TOP / dp.CELLS!r} AS q FROM (
 SELECT g, arg_max({{'cell': cell, 'run': run}}, score) AS c FROM (SELECT *, {score} AS score FROM (
  SELECT g, cell, sum(n) OVER (PARTITION BY g ORDER BY cell) AS below, sum(n) OVER (PARTITION BY g) AS n, lead(cell, 1, {dp.CELLS}) OVER (PARTITION BY g ORDER BY cell) - cell AS run
  FROM (SELECT g, cell, sum(n) AS n FROM (SELECT g, least(greatest(floor(a / {_TOP / dp.CELLS!r}), 0), {dp.CELLS - 1})::INT AS cell, 1 AS n FROM per
   UNION ALL SELECT DISTINCT g, 0, 0 FROM per) GROUP BY g, cell))) GROUP BY g))"""


@query(
    "dp_release",
    f"""WITH e AS (SELECT user_id AS u, {_BAND} AS g, value FROM events),
per AS (SELECT * FROM (SELECT u, g, sum(value) AS s, avg(value) AS a FROM e GROUP BY u, g) QUALIFY row_number() OVER (PARTITION BY u ORDER BY md5(u || '|' || g), g) <= {_GROUPS}),
t AS (SELECT g, count(*) + {_noise_sql('band#users', _GROUPS / _PART)} AS users, sum(least(s, {_TOP})) + {_noise_sql('band#sum', _GROUPS * _TOP / _PART)} AS total,
  {_TOP / 2} + (sum(least(a, {_TOP}) - {_TOP / 2}) + {_noise_sql('band#off', 2 * _GROUPS * (_TOP / 2) / _PART)}) / greatest(1.0, count(a) + {_noise_sql('band#n', 2 * _GROUPS / _PART)}) AS mean
  FROM per GROUP BY g)
SELECT t.g AS group_value, round(users, 5) AS noisy_users, round(total, 5) AS noisy_sum, round(least(greatest(mean, 0), {_TOP}), 5) AS noisy_mean, round(m.q, 5) AS q50, round(h.q, 5) AS q90
FROM t JOIN {_quantile_sql(0.5)} m USING (g) JOIN {_quantile_sql(0.9)} h USING (g) WHERE users >= {dp.threshold(_PART, _DELTA, _GROUPS)!r}""",
)
def dp_release(spark, sf_dir):
    """Users, sums, means and quantiles of events by kind and size under one budget; kinds of few users are withheld."""
    events = table(spark, sf_dir, "events").withColumn("band", F.expr(_BAND))
    release = dp.Release("user_id", "band", "value", 0.0, _TOP, _GROUPS, (0.5, 0.9))
    return rounded(release.run(events, dp.Ledger(_EPSILON, _DELTA), _EPSILON, _DELTA, 42), 5)


def _pii_sql(of: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS pii_class, coalesce(sum(n), 0)::BIGINT AS matches, count(*) FILTER (n > 0) AS rows_with_match "
        f"FROM (SELECT len(regexp_extract_all(text, '{pattern}')) AS n FROM {of})"
        for name, pattern in privacy.PII_PATTERNS.items()
    )


@query("pii_scan", _pii_sql("(SELECT text FROM documents UNION ALL SELECT text FROM conversations)"))
def pii_scan(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    return privacy.pii_scan(texts, "text")


def _mask_sql(text: str) -> str:
    for name, pattern in privacy.PII_PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '<{name.upper()}>', 'g')"
    return text


@query("pii_mask", f"SELECT doc_id, md5({_mask_sql('text')}) AS masked_md5, length({_mask_sql('text')})::INT AS masked_length FROM documents")
def pii_mask(spark, sf_dir):
    masked = table(spark, sf_dir, "documents").withColumn("masked", privacy.pii_mask(F.col("text")))
    return masked.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked_md5"), F.length("masked").alias("masked_length"))


_KEY = "0123456789abcdef0123456789abcdef"


@query(
    "column_encrypt",
    "SELECT c_custkey, c_name, c_mktsegment, true AS hidden FROM customer",
)
def column_encrypt(spark, sf_dir):
    cols = {"c_name": "AES-256", "c_mktsegment": "AES-128"}
    plain = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("original"))
    keys = spark.createDataFrame([(_KEY,)], "secret string")
    locked = privacy.encrypt_columns(plain, cols, keys, mode="ECB").withColumn("hidden", F.col("c_name") != F.col("original"))
    return privacy.decrypt_columns(locked, cols, keys, mode="ECB").drop("original")
