"""Generation queries. Row counts come from the given tables, values from the row id."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mockloom.functions import vocabulary as voc
from mockloom.functions.rng import u32
from mockloom.functions.typemaps import FK_TAG, strategy
from mockloom.operators import generate as gen
from mockloom.operators.fidelity import fk_orphans
from mockloom.plans.derive import sql_normal, sql_pick, sql_u32, sql_uniform, table
from mockloom.plans.registry import query

SEED = 42

# --- the given star schema as a schema document ---------------------------------------

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
FOREIGN = {
    "n_regionkey": "region.r_regionkey", "c_nationkey": "nation.n_nationkey", "s_nationkey": "nation.n_nationkey",
    "o_custkey": "customer.c_custkey", "l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey",
    "l_suppkey": "supplier.s_suppkey",
}
STAR = ["lineitem", "orders", "customer", "supplier", "part", "nation", "region"]
DECLARED = {T.LongType: "BIGINT", T.IntegerType: "INT", T.DoubleType: "DECIMAL", T.StringType: "VARCHAR", T.TimestampNTZType: "DATETIME"}


def star_schema(spark, sf_dir) -> dict:
    """Schema document read off the given tables' own column types."""

    def attribute(name: str, field: T.StructField) -> dict:
        tags = ["PRIMARY_KEY", "NOT_NULL"] if KEYS.get(name) == field.name else []
        tags += [FK_TAG + FOREIGN[field.name]] if field.name in FOREIGN else []
        return {"name": field.name, "type": DECLARED[type(field.dataType)], "constraints": tags}

    tables = [{"name": t, "attributes": [attribute(t, f) for f in table(spark, sf_dir, t).schema]} for t in STAR]
    return {"databases": [{"name": "star", "tables": tables}]}


def star_rows(spark, sf_dir, scale: int = 2) -> dict[str, int]:
    return {t: table(spark, sf_dir, t).count() * scale for t in STAR}


def star_set(spark, sf_dir) -> gen.TableSet:
    return gen.TableSet(spark, star_schema(spark, sf_dir), star_rows(spark, sf_dir), SEED)


# --- SQL twins of the draws -------------------------------------------------------------


class SqlDraws:
    def __init__(self, table: str, column: str, row: str = "id"):
        self.table, self.column, self.row = table, column, row

    def _name(self, tag: str) -> str:
        return self.column + (f"#{tag}" if tag else "")

    def whole(self, below: int | str, tag: str = "") -> str:
        return f"({sql_u32(SEED, self.table, self._name(tag), self.row)} % {below})"

    def unit(self, tag: str = "") -> str:
        return sql_uniform(SEED, self.table, self._name(tag), self.row)

    def word(self, words: list[str], tag: str = "") -> str:
        return sql_pick(words, SEED, self.table, self._name(tag), self.row)

    def words(self, least: int, most: int, tag: str = "") -> str:
        inner = sql_pick(voc.WORDS, SEED, self.table, self._name(tag), f"{self.row} || '.' || i")
        return f"list_aggregate(list_transform(range(1, {self.whole(most - least + 1, tag + 'n')} + {least} + 1), lambda i: {inner}), 'string_agg', ' ')"

    def digits(self, n: int, tag: str) -> str:
        return f"lpad({self.whole(10**n, tag)}::VARCHAR, {n}, '0')"

    def moment(self) -> str:
        return f"strftime(TIMESTAMP '{gen.ANCHOR}' - to_seconds({self.whole(gen.TWO_YEARS_SECONDS)}), '%Y-%m-%d %H:%M:%S')"

    def day(self) -> str:
        return f"(DATE '{gen.ANCHOR[:10]}' - {self.whole(731)}::INT)::VARCHAR"

    def clock(self) -> str:
        return f"strftime(TIMESTAMP '2000-01-01' + to_seconds({self.whole(86400)}), '%H:%M:%S')"

    def user(self) -> str:
        return f"{self.word(voc.WORDS, 'user')} || {self.whole(10000, 'no')}"

    def email(self) -> str:
        return f"{self.user()} || '@' || {self.word(voc.DOMAINS, 'domain')}"

    def phone(self) -> str:
        return f"'+1-555-' || {self.digits(3, 'a')} || '-' || {self.digits(4, 'b')}"

    def first(self) -> str:
        return self.word(voc.LOCALES["en_US"][1], "first")

    def last(self) -> str:
        return self.word(voc.LOCALES["en_US"][2], "last")

    def city(self) -> str:
        return self.word(voc.LOCALES["en_US"][3], "city")

    def street(self) -> str:
        return f"({self.whole(999, 'no')} + 1) || ' ' || {self.word(voc.STREETS, 'street')} || ' Street'"


def ids_sql(of: str, times: int = 1) -> str:
    return f"ids AS (SELECT unnest(range(1, (SELECT count(*) FROM {of}) * {times} + 1)) AS id)"


def ids(spark, sf_dir, of: str, times: int = 1):
    return spark.range(1, table(spark, sf_dir, of).count() * times + 1)


def single(name: str, strategy_name: str, column: str, expression: str, of: str = "orders"):
    """Register one generated column over as many rows as a given table has."""

    @query(name, f"WITH {ids_sql(of)} SELECT id, {expression} AS {column} FROM ids")
    def run(spark, sf_dir):
        d = gen.Draws(SEED, "t", column, F.col("id"))
        return ids(spark, sf_dir, of).select("id", gen.strategy_value(strategy_name, column, d).alias(column))


def fields(name: str, columns: dict[str, str], of: str = "orders"):
    """Register several generator fields side by side."""

    listed = ", ".join(f"{sql} AS {field}" for field, sql in columns.items())

    @query(name, f"WITH {ids_sql(of)} SELECT id, {listed} FROM ids")
    def run(spark, sf_dir):
        made = [gen.field_value(f, gen.Draws(SEED, "t", f, F.col("id"))).alias(f) for f in columns]
        return ids(spark, sf_dir, of).select("id", *made)


def _sd(column: str) -> SqlDraws:
    return SqlDraws("t", column)


@query(
    "gen_strategy",
    """SELECT s AS strategy, count(*) AS n FROM (SELECT CASE
   WHEN l_linenumber = 1 THEN 'primary_key' WHEN l_linenumber = 2 THEN 'foreign_key'
   WHEN l_returnflag = 'A' THEN 'integer' WHEN l_returnflag = 'N' THEN 'datetime' ELSE 'string' END AS s FROM lineitem) GROUP BY s""",
)
def gen_strategy(spark, sf_dir):
    declared = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "bigint").when(F.col("l_returnflag") == "N", "Timestamp").otherwise("uuid").alias("type"),
        F.when(F.col("l_linenumber") == 1, F.array(F.lit("NOT_NULL"), F.lit("AUTO_INCREMENT")))
        .when(F.col("l_linenumber") == 2, F.array(F.lit(FK_TAG + "t.id")))
        .otherwise(F.array().cast("array<string>")).alias("constraints"),
    )
    return declared.groupBy(strategy(F.col("type"), F.col("constraints")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query("gen_pk", f"WITH {ids_sql('lineitem')} SELECT id FROM ids")
def gen_pk(spark, sf_dir):
    d = gen.Draws(SEED, "t", "id", F.col("id"))
    return ids(spark, sf_dir, "lineitem").select(gen.strategy_value("primary_key", "id", d).alias("id"))


single("gen_integer", "integer", "n", f"{_sd('n').whole(1000000)} + 1", "lineitem")
single("gen_decimal", "decimal", "amount", f"round({_sd('amount').unit()} * 10000, 2)", "lineitem")
single("gen_datetime", "datetime", "made_at", _sd("made_at").moment())
single("gen_date", "date", "made_on", _sd("made_on").day())
single("gen_time", "time", "clock", _sd("clock").clock())
single("gen_boolean", "boolean", "flag", f"{_sd('flag').whole(2)} = 0")
single("gen_enum", "enum", "state", _sd("state").word(voc.ENUM_VALUES))
single(
    "gen_json", "json", "body",
    f"""'{{"key":"' || {_sd('body').word(voc.WORDS, 'key')} || '","value":"' || {_sd('body').word(voc.WORDS, 'value')} || '"}}'""",
)
single("gen_text", "text", "note", _sd("note").words(5, 24), "customer")


@query(
    "gen_person",
    f"""WITH {ids_sql('orders')} SELECT id, {_sd('first_name').first()} AS first_name, {_sd('LastName').last()} AS LastName,
 {_sd('full_name').first()} || ' ' || {_sd('full_name').last()} AS full_name FROM ids""",
)
def gen_person(spark, sf_dir):
    cols = ["first_name", "LastName", "full_name"]
    return ids(spark, sf_dir, "orders").select(
        "id", *[gen.strategy_value("string", c, gen.Draws(SEED, "t", c, F.col("id"))).alias(c) for c in cols]
    )


@query(
    "gen_contact",
    f"""WITH {ids_sql('orders')} SELECT id, {_sd('email').email()} AS email, {_sd('phone_no').phone()} AS phone_no,
 {_sd('address').street()} || ', ' || {_sd('address').city()} AS address, {_sd('city').city()} AS city,
 'United States' AS country, {_sd('nickel').word(voc.WORDS)} AS nickel FROM ids""",
)
def gen_contact(spark, sf_dir):
    cols = ["email", "phone_no", "address", "city", "country", "nickel"]
    return ids(spark, sf_dir, "orders").select(
        "id", *[gen.strategy_value("string", c, gen.Draws(SEED, "t", c, F.col("id"))).alias(c) for c in cols]
    )


fields("gen_personal", {
    "first_name": _sd("first_name").first(), "last_name": _sd("last_name").last(),
    "full_name": f"{_sd('full_name').first()} || ' ' || {_sd('full_name').last()}", "email": _sd("email").email(),
    "phone_number": _sd("phone_number").phone(),
})
fields("gen_address", {
    "street_address": _sd("street_address").street(), "city": _sd("city").city(), "state": _sd("state").word(voc.STATES),
    "postal_code": _sd("postal_code").digits(5, ""), "country": "'United States'",
})
_initcap = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"
fields("gen_company", {
    "company_name": f"{_initcap(_sd('company_name').word(voc.WORDS, 'company'))} || ' ' || {_sd('company_name').word(voc.COMPANY_FORMS, 'form')}",
    "company_email": f"'office@' || {_sd('company_email').word(voc.WORDS, 'company')} || '.' || {_sd('company_email').word(voc.DOMAINS, 'domain')}",
    "job_title": _sd("job_title").word(voc.JOB_TITLES), "department": _sd("department").word(voc.DEPARTMENTS),
})
fields("gen_financial", {
    "credit_card": "'4000-' || " + " || '-' || ".join(_sd("credit_card").digits(4, t) for t in "abc"),
    "bank_account": f"'AC' || {_sd('bank_account').digits(8, 'a')} || {_sd('bank_account').digits(8, 'b')}",
    "currency": _sd("currency").word(voc.CURRENCIES), "amount": f"round({_sd('amount').unit()} * 10000, 2)",
})
fields("gen_internet", {
    "url": f"'https://' || {_sd('url').word(voc.DOMAINS, 'domain')} || '/' || {_sd('url').word(voc.WORDS, 'path')}",
    "domain": f"{_sd('domain').word(voc.WORDS, 'host')} || '.' || {_sd('domain').word(voc.DOMAINS, 'domain')}",
    "username": _sd("username").user(),
    "password": f"substr(sha256({sql_u32(SEED, 't', 'password', 'id')}::VARCHAR), 1, 16)",
    "ipv4": " || '.' || ".join(_sd("ipv4").whole(256, t) for t in "abcd"),
    "ipv6": " || ':' || ".join(f"lpad(lower(to_hex({_sd('ipv6').whole(65536, t)})), 4, '0')" for t in "abcdefgh"),
})
fields("gen_datetime_fields", {
    "date": _sd("date").day(), "time": _sd("time").clock(), "datetime": _sd("datetime").moment(),
    "timestamp": f"{_sd('timestamp').whole(gen.TWO_YEARS_SECONDS)} + 1672531200",
})
fields("gen_text_fields", {
    "sentence": f"{_initcap(_sd('sentence').word(voc.WORDS, 'head'))} || ' ' || {_sd('sentence').words(4, 11)} || '.'",
    "paragraph": _sd("paragraph").words(30, 60), "text": _sd("text").words(5, 24), "word": _sd("word").word(voc.WORDS),
}, of="customer")
fields("gen_numeric_fields", {
    "integer": f"{_sd('integer').whole(1000000)} + 1", "float": f"round({_sd('float').unit()} * 10000, 2)",
    "decimal": f"round({_sd('decimal').unit()} * 10000, 2)", "percentage": f"round({_sd('percentage').unit()} * 100, 1)",
})

_LOCALES = list(voc.LOCALES)


def _locale_values() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return ", ".join(f"('{k}', '{v[0]}', {quoted(v[1])}, {quoted(v[2])}, {quoted(v[3])})" for k, v in voc.LOCALES.items())


@query(
    "gen_locale",
    f"""WITH {ids_sql('orders')}, vocab(locale, country, first, last, cities) AS (VALUES {_locale_values()}),
tagged AS (SELECT id, {sql_pick(_LOCALES, SEED, 't', 'locale', 'id')} AS locale FROM ids)
SELECT id, locale, country, first[({sql_u32(SEED, 't', 'first', 'id')} % 3 + 1)::INT] AS first_name,
 last[({sql_u32(SEED, 't', 'last', 'id')} % 3 + 1)::INT] AS last_name, cities[({sql_u32(SEED, 't', 'city', 'id')} % 3 + 1)::INT] AS city
FROM tagged JOIN vocab USING (locale)""",
)
def gen_locale(spark, sf_dir):
    words = "array<string>"
    vocab = spark.createDataFrame(
        [(k, *v) for k, v in voc.LOCALES.items()], f"locale string, country string, first {words}, last {words}, cities {words}"
    )
    tagged = ids(spark, sf_dir, "orders").withColumn("locale", gen.Draws(SEED, "t", "locale", F.col("id")).word(_LOCALES))
    choose = lambda words_col, name: F.element_at(words_col, (u32(SEED, "t", name, F.col("id")) % F.size(words_col) + 1).cast("int"))
    return tagged.join(F.broadcast(vocab), "locale").select(  # one row per locale
        "id", "locale", "country", choose("first", "first").alias("first_name"), choose("last", "last").alias("last_name"),
        choose("cities", "city").alias("city"),
    )


# --- foreign keys --------------------------------------------------------------------


@query(
    "gen_fk",
    f"""WITH {ids_sql('lineitem')}, keys AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders),
drawn AS (SELECT id, {SqlDraws('fk', 'l_orderkey').whole('(SELECT count(*) FROM orders)')} AS n FROM ids)
SELECT id, o_orderkey AS l_orderkey FROM drawn JOIN keys USING (n)""",
)
def gen_fk(spark, sf_dir):
    return gen.fk_from_table(ids(spark, sf_dir, "lineitem"), "id", table(spark, sf_dir, "orders"), "o_orderkey", "l_orderkey", SEED)


@query("gen_fk_unknown_parent", f"WITH {ids_sql('orders')} SELECT {SqlDraws('t', 'x_id').whole(100)} + 1 AS x_id FROM ids")
def gen_fk_unknown_parent(spark, sf_dir):
    doc = {"databases": [{"tables": [{"name": "t", "attributes": [{"name": "x_id", "type": "INT", "constraints": [FK_TAG + "gone.id"]}]}]}]}
    return gen.TableSet(spark, doc, {"t": table(spark, sf_dir, "orders").count()}, SEED).table("t")


# --- whole tables -----------------------------------------------------------------------

_o = lambda c: SqlDraws("orders", c)
ORDERS_SQL = f"""SELECT id AS o_orderkey, {_o('o_custkey').whole('(SELECT 2 * count(*) FROM customer)')} + 1 AS o_custkey,
 {_o('o_orderstatus').word(voc.WORDS)} AS o_orderstatus, round({_o('o_totalprice').unit()} * 10000, 2) AS o_totalprice,
 {_o('o_orderdate').moment()} AS o_orderdate, {_o('o_orderpriority').word(voc.WORDS)} AS o_orderpriority FROM ids"""


@query("gen_table", f"WITH {ids_sql('orders', 2)} {ORDERS_SQL}")
def gen_table(spark, sf_dir):
    return star_set(spark, sf_dir).table("orders")


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, 2 * count(*) AS rows FROM {t}" for t in STAR)


@query("gen_tableset_counts", _COUNTS)
def gen_tableset_counts(spark, sf_dir):
    return star_set(spark, sf_dir).summary().select("table_name", "rows")


_COLS = {"lineitem": 11, "orders": 6, "customer": 5, "supplier": 4, "part": 6, "nation": 3, "region": 2}


@query(
    "gen_summary",
    f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, 2 * count(*) AS rows, {n} AS cols FROM {t}" for t, n in _COLS.items())})
SELECT table_name, rows, cols::BIGINT AS cols FROM c UNION ALL SELECT '*', sum(rows)::BIGINT, count(*) FROM c""",
)
def gen_summary(spark, sf_dir):
    per_table = star_set(spark, sf_dir).summary().withColumn("cols", F.col("cols").cast("bigint"))
    total = per_table.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("cols"))
    return per_table.unionByName(total.select(F.lit("*").alias("table_name"), "rows", "cols"))


_EDGES = [(c, *FOREIGN[c].split("."), t) for t, c in (
    ("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"),
    ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"))]


@query(
    "gen_fk_integrity",
    " UNION ALL ".join(
        f"SELECT '{child}.{col}' AS edge, (SELECT 2 * count(*) FROM {child}) AS child_rows, 0 AS orphan_rows, 0 AS orphan_keys"
        for col, _, _, child in _EDGES
    ),
)
def gen_fk_integrity(spark, sf_dir):
    made = star_set(spark, sf_dir)
    out = None
    for col, parent, key, child in _EDGES:
        rows = made.table(child)
        checked = fk_orphans(rows, col, made.table(parent), key).select(
            F.lit(f"{child}.{col}").alias("edge"), rows.agg(F.count(F.lit(1))).scalar().alias("child_rows"), "orphan_rows", "orphan_keys"
        )
        out = checked if out is None else out.unionByName(checked)
    return out


# --- plans and priors ---------------------------------------------------------------------


@query(
    "gen_row_plan",
    """WITH t AS (SELECT 'segment_' || o_orderpriority || '_' || o_orderstatus AS table_name, count(*) AS c, min(o_custkey) AS lo FROM orders GROUP BY 1),
p AS (SELECT table_name, floor((CASE WHEN c > 900 THEN c ELSE 10 END) * 2.0)::BIGINT AS planned_rows FROM t)
SELECT table_name, planned_rows, CASE WHEN (SELECT count(*) FROM p) > 30 THEN 'too many tables' WHEN planned_rows > 500 THEN 'too many rows' END AS violation FROM p""",
)
def gen_row_plan(spark, sf_dir):
    name = F.concat(F.lit("segment_"), F.col("o_orderpriority"), F.lit("_"), F.col("o_orderstatus")).alias("table_name")
    asked = table(spark, sf_dir, "orders").groupBy(name).agg(F.count(F.lit(1)).alias("requested_rows"))
    plan = gen.plan_rows(asked.select("table_name"), asked.filter("requested_rows > 900"), 10, 2.0)
    return gen.check_plan(plan)


PRIORS_SQL = """priors AS (SELECT p_brand AS column_name, ['Normal', 'Log-Normal', 'Uniform', 'Exponential'][(ascii(right(p_brand, 1)) % 4) + 1] AS dist_type,
  1.0::DOUBLE AS p1, 1.5::DOUBLE AS p2 FROM part GROUP BY p_brand)"""


@query(
    "prior_sample",
    f"""WITH {ids_sql('customer')}, {PRIORS_SQL}, d AS (SELECT id, column_name, dist_type, p1, p2,
  {sql_normal(SEED, 'prior', 'z', "column_name || '|' || id")} AS z, {sql_uniform(SEED, 'prior', 'u', "column_name || '|' || id")} AS u FROM ids, priors)
SELECT id, column_name, round(CASE dist_type WHEN 'Normal' THEN p1 + p2 * z WHEN 'Log-Normal' THEN exp(p1 + p2 * z)
  WHEN 'Uniform' THEN p1 + (p2 - p1) * u ELSE -ln(1.0 - u) / p1 END, 6) AS value FROM d""",
)
def prior_sample(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Normal", "Log-Normal", "Uniform", "Exponential")]),
                        F.ascii(F.right("p_brand", F.lit(1))) % 4 + 1)
    priors = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("column_name"), kind.alias("dist_type"), F.lit(1.0).alias("p1"), F.lit(1.5).alias("p2")
    ).distinct()
    drawn = gen.sample_priors(ids(spark, sf_dir, "customer"), "id", priors, SEED)
    return drawn.select("id", "column_name", F.round("value", 6).alias("value"))


# Priors fitted to orders; both engines round the parameters, so that they agree on every bit.
def _try(stream: str) -> str:
    return f"(({sql_u32(SEED, 'prior', stream, 'key')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _try_normal(stream: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({_try(stream + '#r')})) * cos(6.283185307179586::DOUBLE * {_try(stream + '#w')}))"


@query(
    "prior_rejection",
    f"""WITH {ids_sql('customer')}, total AS (SELECT avg(o_totalprice) / 1000 AS m, var_samp(o_totalprice) / 1e6 AS v, count(*) / count(DISTINCT o_custkey) AS a FROM orders),
fitted AS (SELECT round(m * m / v, 3) AS shape, round(v / m, 3) AS scale, round(m, 3) AS mean, round(sqrt(v), 3) AS dev, round(a * 10, 3) AS rate FROM total),
shares AS (SELECT list(n ORDER BY s) AS w FROM (SELECT o_orderstatus AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1)),
tries AS (SELECT id, t FROM ids, (SELECT unnest(range(64)) AS t)),
g AS (SELECT id, t, shape - 1.0::DOUBLE / 3 AS d, scale, {_try_normal('gamma')} AS x, {_try('gamma#u')} AS u FROM (SELECT *, 'gamma|' || id || '|' || t AS key FROM tries), fitted),
gv AS (SELECT *, (1.0 + 1.0 / sqrt(d * 9.0) * x) ** 3.0 AS v FROM g),
b AS (SELECT id, t, rate, sqrt(rate) * 2.53::DOUBLE + 0.931::DOUBLE AS b, {_try('poisson#w')} - 0.5 AS w, {_try('poisson#v')} AS v FROM (SELECT *, 'poisson|' || id || '|' || t AS key FROM tries), fitted),
ba AS (SELECT *, b * 0.02483::DOUBLE - 0.059::DOUBLE AS a, 0.5 - abs(w) AS us FROM b),
bk AS (SELECT *, floor((a * 2.0 / us + b) * w + rate + 0.43::DOUBLE) AS k FROM ba),
bj AS (SELECT id, t, k, CASE WHEN us >= 0.07 AND v <= 0.9277::DOUBLE - 3.6224::DOUBLE / (b - 2) THEN true WHEN k < 0 OR (us < 0.013 AND v > us) THEN false
   ELSE ln(v) + ln(1.1239::DOUBLE + 1.1328::DOUBLE / (b - 3.4::DOUBLE)) - ln(a / (us * us) + b) <= k * ln(rate) - rate - lgamma(CASE WHEN k < 0 THEN 1 ELSE k + 1 END) END AS fits FROM bk),
n AS (SELECT id, t, mean, dev, {_try_normal('truncated')} AS z FROM (SELECT *, 'truncated|' || id || '|' || t AS key FROM tries), fitted),
c AS (SELECT id, w, {_try('categorical')} * list_sum(w) AS goal FROM (SELECT *, 'categorical|' || id AS key FROM ids), shares)
SELECT id, 'gamma' AS column_name, round(arg_min(d * v * scale, t), 5) AS value FROM gv
 WHERE v > 0 AND ln(u) < x * x * 0.5 + d - d * v + d * CASE WHEN v > 0 THEN ln(v) END GROUP BY id
UNION ALL SELECT id, 'poisson', arg_min(k, t) FROM bj WHERE fits GROUP BY id
UNION ALL SELECT id, 'truncated', round(arg_min(mean + dev * z, t), 5) FROM n WHERE z >= (0 - mean) / dev AND z <= (3 * mean - mean) / dev GROUP BY id
UNION ALL SELECT id, 'categorical', CASE WHEN goal <= w[1] THEN 0 WHEN goal <= w[1] + w[2] THEN 1 ELSE 2 END FROM c""",
)
def prior_rejection(spark, sf_dir):
    """Rejection-sampled values for every customer, from priors whose parameters are those of all orders."""
    orders = table(spark, sf_dir, "orders")
    m, v = F.col("m"), F.col("v")
    fitted = orders.agg(
        (F.avg("o_totalprice") / 1000).alias("m"), (F.var_samp("o_totalprice") / 1e6).alias("v"), (F.count(F.lit(1)) / F.countDistinct("o_custkey")).alias("a")
    ).select(F.round(m * m / v, 3).alias("shape"), F.round(v / m, 3).alias("scale"), F.round(m, 3).alias("mean"), F.round(F.sqrt(v), 3).alias("dev"), F.round(F.col("a") * 10, 3).alias("rate"))
    shares = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))), lambda s: s["n"]).alias("weights")
    )
    none = F.lit(None).cast("double")
    row = lambda name, kind, p1, p2=none, p3=none, p4=none: F.struct(
        F.lit(name).alias("column_name"), F.lit(kind).alias("dist_type"), p1.alias("p1"), p2.alias("p2"), p3.alias("p3"), p4.alias("p4"))
    mean, dev = F.col("mean"), F.col("dev")
    kinds = fitted.select(F.inline(F.array(
        row("gamma", "gamma", F.col("shape"), F.col("scale")), row("poisson", "poisson", F.col("rate")),
        row("truncated", "truncated normal", mean, dev, F.lit(0.0), mean * 3), row("categorical", "categorical", none),
    )))
    drawn = gen.sample_priors(ids(spark, sf_dir, "customer"), "id", kinds.crossJoin(shares), SEED)
    places = F.when(F.col("column_name").isin("gamma", "truncated"), F.round("value", 5)).otherwise(F.col("value"))
    return drawn.select("id", "column_name", places.alias("value"))


_CUSTOM = {"databases": [{"tables": [{"name": "clients", "attributes": [
    {"name": "id", "type": "BIGINT", "constraints": ["PRIMARY_KEY"]}, {"name": "code", "type": "VARCHAR"}, {"name": "region", "type": "INT"}, {"name": "state", "type": "ENUM"}]}]}]}


@query(
    "gen_custom",
    f"""SELECT c_custkey AS id, 'C-' || lpad(c_custkey::VARCHAR, 8, '0') AS code, c_custkey % 7 AS region, {sql_pick(voc.ENUM_VALUES, 42, 'clients', 'state', 'c_custkey')} AS state
FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS c_custkey FROM customer)""",
)
def gen_custom(spark, sf_dir):
    """One row for each customer, two of the columns by generators of the caller's own."""
    own = {
        "clients.code": lambda row: F.concat(F.lit("C-"), F.lpad(row.cast("string"), 8, "0")),
        "clients.region": lambda row: row % 7,
    }
    rows = table(spark, sf_dir, "customer").count()
    return gen.TableSet(spark, _CUSTOM, {"clients": rows}, SEED, custom=own).table("clients")
