"""Seed rows of any size from a schema document.

Every value is an expression over the row id, so a table is one
``range().select()``. A foreign key picks a parent *row id* and, where the
parent column is generated too, evaluates the parent's own expression at that
id: referential integrity needs no join and no stored parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.functions import priors as draw
from mockloom.functions import vocabulary as voc
from mockloom.functions.rng import normal, pick, u32, uniform
from mockloom.functions.typemaps import FK_TAG, KEY_TAGS, STRATEGY
from mockloom.operators.scan import dense_index

ANCHOR = "2025-01-01 00:00:00"  # generated dates end here, so that reruns agree
TWO_YEARS_SECONDS = 730 * 86400


class Draws:
    """Random draws of one column; ``tag`` separates several draws of a row."""

    def __init__(self, seed, table: str, column: str, row: Column):
        self.seed, self.table, self.column, self.row = seed, table, column, row

    def _name(self, tag: str) -> str:
        return self.column + (f"#{tag}" if tag else "")

    def whole(self, below: int, tag: str = "") -> Column:
        """Uniform integer in [0, below)."""
        if below <= 1 << 32:
            return u32(self.seed, self.table, self._name(tag), self.row) % below
        high = u32(self.seed, self.table, self._name(tag + "hi"), self.row) % (1 << 30)
        return (high * (1 << 32) + u32(self.seed, self.table, self._name(tag), self.row)) % below

    def unit(self, tag: str = "") -> Column:
        return uniform(self.seed, self.table, self._name(tag), self.row)

    def word(self, words: list[str], tag: str = "") -> Column:
        return pick(words, self.seed, self.table, self._name(tag), self.row)

    def words(self, least: int, most: int, tag: str = "") -> Column:
        """Between ``least`` and ``most`` filler words."""
        count = self.whole(most - least + 1, tag + "n") + least
        one = lambda i: pick(
            voc.WORDS, self.seed, self.table, self._name(tag), F.concat_ws(".", self.row.cast("string"), i.cast("string"))
        )
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(1), count.cast("int")), one))


def _digits(d: Draws, n: int, tag: str) -> Column:
    return F.lpad(d.whole(10**n, tag).cast("string"), n, "0")


def _moment(d: Draws) -> Column:
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), d.whole(TWO_YEARS_SECONDS).cast("decimal(18,6)"))
    return (F.expr(f"TIMESTAMP_NTZ'{ANCHOR}'") - back).cast("string")


def _clock(d: Draws) -> Column:
    s = d.whole(86400)
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(s % 3600 / 60), two(s % 60))


def _first(d: Draws, locale: str) -> Column:
    return d.word(voc.LOCALES[locale][1], "first")


def _last(d: Draws, locale: str) -> Column:
    return d.word(voc.LOCALES[locale][2], "last")


def _full(d: Draws, locale: str) -> Column:
    return F.concat_ws(" ", _first(d, locale), _last(d, locale))


def _user(d: Draws) -> Column:
    return F.concat(d.word(voc.WORDS, "user"), d.whole(10000, "no").cast("string"))


def _email(d: Draws) -> Column:
    return F.concat(_user(d), F.lit("@"), d.word(voc.DOMAINS, "domain"))


def _phone(d: Draws) -> Column:
    return F.concat(F.lit("+1-555-"), _digits(d, 3, "a"), F.lit("-"), _digits(d, 4, "b"))


def _street(d: Draws) -> Column:
    return F.concat((d.whole(999, "no") + 1).cast("string"), F.lit(" "), d.word(voc.STREETS, "street"), F.lit(" Street"))


def _city(d: Draws, locale: str) -> Column:
    return d.word(voc.LOCALES[locale][3], "city")


def _company(d: Draws) -> Column:
    return F.concat_ws(" ", F.initcap(d.word(voc.WORDS, "company")), d.word(voc.COMPANY_FORMS, "form"))


def semantic_string(name: str, d: Draws, locale: str) -> Column:
    """String whose meaning is read off the column name; the first hit wins."""
    name = name.lower()
    if "name" in name:
        if "first" in name:
            return _first(d, locale)
        return _last(d, locale) if "last" in name else _full(d, locale)
    rules: list[tuple[str, Callable[[], Column]]] = [
        ("email", lambda: _email(d)),
        ("phone", lambda: _phone(d)),
        ("address", lambda: F.concat_ws(", ", _street(d), _city(d, locale))),
        ("city", lambda: _city(d, locale)),
        ("country", lambda: F.lit(voc.LOCALES[locale][0])),
    ]
    for needle, make in rules:
        if needle in name:
            return make()
    return d.word(voc.WORDS)


def field_value(field: str, d: Draws, locale: str = voc.DEFAULT_LOCALE) -> Column:
    """Value of a named generator field, independent of any schema."""
    makers: dict[str, Callable[[], Column]] = {
        "first_name": lambda: _first(d, locale),
        "last_name": lambda: _last(d, locale),
        "full_name": lambda: _full(d, locale),
        "email": lambda: _email(d),
        "phone_number": lambda: _phone(d),
        "street_address": lambda: _street(d),
        "city": lambda: _city(d, locale),
        "state": lambda: d.word(voc.STATES),
        "postal_code": lambda: _digits(d, 5, ""),
        "country": lambda: F.lit(voc.LOCALES[locale][0]),
        "company_name": lambda: _company(d),
        "company_email": lambda: F.concat(F.lit("office@"), d.word(voc.WORDS, "company"), F.lit("."), d.word(voc.DOMAINS, "domain")),
        "job_title": lambda: d.word(voc.JOB_TITLES),
        "department": lambda: d.word(voc.DEPARTMENTS),
        "credit_card": lambda: F.concat_ws("-", F.lit("4000"), *[_digits(d, 4, t) for t in "abc"]),
        "bank_account": lambda: F.concat(F.lit("AC"), _digits(d, 8, "a"), _digits(d, 8, "b")),
        "currency": lambda: d.word(voc.CURRENCIES),
        "amount": lambda: F.round(d.unit() * 10000, 2),
        "date": lambda: strategy_value("date", field, d, locale),
        "time": lambda: strategy_value("time", field, d, locale),
        "datetime": lambda: strategy_value("datetime", field, d, locale),
        "timestamp": lambda: d.whole(TWO_YEARS_SECONDS) + 1672531200,
        "sentence": lambda: F.concat(F.initcap(d.word(voc.WORDS, "head")), F.lit(" "), d.words(4, 11), F.lit(".")),
        "paragraph": lambda: d.words(30, 60),
        "text": lambda: d.words(5, 24),
        "word": lambda: d.word(voc.WORDS),
        "url": lambda: F.concat(F.lit("https://"), d.word(voc.DOMAINS, "domain"), F.lit("/"), d.word(voc.WORDS, "path")),
        "domain": lambda: F.concat(d.word(voc.WORDS, "host"), F.lit("."), d.word(voc.DOMAINS, "domain")),
        "username": lambda: _user(d),
        "password": lambda: F.substring(F.sha2(u32(d.seed, d.table, d.column, d.row).cast("string").cast("binary"), 256), 1, 16),
        "ipv4": lambda: F.concat_ws(".", *[d.whole(256, t).cast("string") for t in "abcd"]),
        "ipv6": lambda: F.concat_ws(":", *[F.lower(F.lpad(F.hex(d.whole(65536, t)), 4, "0")) for t in "abcdefgh"]),
        "integer": lambda: d.whole(1_000_000) + 1,
        "float": lambda: F.round(d.unit() * 10000, 2),
        "decimal": lambda: F.round(d.unit() * 10000, 2),
        "percentage": lambda: F.round(d.unit() * 100, 1),
    }
    if field not in makers:
        raise ValueError(f"Unknown generator field {field}")
    return makers[field]()


def strategy_value(strategy: str, name: str, d: Draws, locale: str = voc.DEFAULT_LOCALE) -> Column:
    """Value of one schema strategy other than a foreign key."""
    if strategy == "primary_key":
        return d.row
    if strategy == "integer":
        return d.whole(1_000_000) + 1
    if strategy in ("decimal", "float"):
        return F.round(d.unit() * 10000, 2)
    if strategy == "datetime":
        return _moment(d)
    if strategy == "date":
        return F.date_sub(F.lit(ANCHOR[:10]).cast("date"), d.whole(731).cast("int")).cast("string")
    if strategy == "time":
        return _clock(d)
    if strategy == "boolean":
        return d.whole(2) == 0
    if strategy == "enum":
        return d.word(voc.ENUM_VALUES)
    if strategy == "json":
        return F.to_json(F.struct(d.word(voc.WORDS, "key").alias("key"), d.word(voc.WORDS, "value").alias("value")))
    if strategy == "text":
        return d.words(5, 24)
    if strategy == "string":
        return semantic_string(name, d, locale)
    return F.concat(F.lit(name + "_"), d.row.cast("string"))


# --- schema documents on the driver -------------------------------------------------

FK_FORMS = [
    re.compile(r"^FOREIGN_KEY_REFERENCES_([^.]+)\.([^.]+)$"),
    re.compile(r"^FOREIGN KEY REFERENCES\s+(\w+)\s*\(\s*(\w+)\s*\)", re.IGNORECASE),
]


def references(attribute: Mapping) -> list[tuple[str, str]]:
    """(parent table, parent column) of an attribute, in either constraint spelling."""
    hits = [form.match(c) for c in attribute.get("constraints") or [] for form in FK_FORMS]
    return [m.groups() for m in hits if m]


def column_strategy(attribute: Mapping) -> str:
    tags = attribute.get("constraints") or []
    if any(t in KEY_TAGS or t.upper() == "PRIMARY KEY" for t in tags):
        return "primary_key"
    if any(t.startswith(FK_TAG) for t in tags) or references(attribute):
        return "foreign_key"
    return STRATEGY.get((attribute.get("type") or "").upper(), "string")


def tables_of(schema: Mapping) -> dict[str, Mapping]:
    return {t["name"]: t for db in schema.get("databases", []) for t in db.get("tables", [])}


def generation_order(schema: Mapping, strict: bool = False) -> list[str]:
    """Tables of one schema document, parents first, ordered by (level, name).

    A table's level is its longest foreign-key path; an edge that closes a
    cycle, or names an unknown table, is ignored; with ``strict`` a cycle is an
    error. One document is small; whole catalogues are levelled by ``catalog.generation_levels``.
    """
    tables = tables_of(schema)
    parents = {
        name: {p for a in t.get("attributes") or [] for p, _ in references(a) if p in tables and p != name}
        for name, t in tables.items()
    }
    level: dict[str, int] = {}
    left = set(tables)
    while left:
        ready = {t for t in left if not (parents[t] & left)}
        if strict and not ready:
            raise ValueError(f"foreign keys form a cycle among {', '.join(sorted(left))}")
        ready = ready or _cycle_heads(left, parents)
        for t in ready:
            level[t] = max((level[p] + 1 for p in parents[t] if p in level), default=0)
        left -= ready
    return sorted(tables, key=lambda t: (level[t], t))


def _cycle_heads(left: set[str], parents: Mapping[str, set[str]]) -> set[str]:
    """The smallest name of each cycle that nothing else leads into."""
    above: dict[str, set[str]] = {}
    for t in left:
        seen, stack = set(), [t]
        while stack:
            new = (parents[stack.pop()] & left) - seen
            seen |= new
            stack += new
        above[t] = seen
    return {t for t in left if t == min(above[t], default=None) and all(t in above[p] for p in above[t])}


class TableSet:
    """Generated tables of one schema document.

    ``rows`` gives the row count per table; ``custom`` maps "table.column" to a
    function of the row id.
    """

    def __init__(
        self,
        spark: SparkSession,
        schema: Mapping,
        rows: Mapping[str, int],
        seed: int | str = 42,
        locale: str = voc.DEFAULT_LOCALE,
        custom: Mapping[str, Callable[[Column], Column]] | None = None,
    ):
        self.spark, self.tables, self.rows = spark, tables_of(schema), dict(rows)
        self.order, self.seed, self.locale, self.custom = generation_order(schema), seed, locale, custom or {}

    def value(self, table: str, attribute: Mapping, row: Column, seen: tuple = ()) -> Column:
        name = attribute["name"]
        if f"{table}.{name}" in self.custom:
            return self.custom[f"{table}.{name}"](row)
        d = Draws(self.seed, table, name, row)
        how = column_strategy(attribute)
        if how != "foreign_key":
            return strategy_value(how, name, d, self.locale)
        here = (table, name)
        for parent, column in references(attribute):
            target = {a["name"]: a for a in self.tables.get(parent, {}).get("attributes") or []}.get(column)
            if target is not None and self.rows.get(parent) and here not in seen:
                return self.value(parent, target, d.whole(self.rows[parent]) + 1, (*seen, here))
        return d.whole(100) + 1  # unknown parent

    def table(self, name: str, partitions: int | None = None) -> DataFrame:
        attributes = self.tables[name].get("attributes") or []
        ids = self.spark.range(1, self.rows[name] + 1, 1, partitions)
        if not attributes:
            return self.spark.createDataFrame([], "empty string").drop("empty")
        return ids.select(*[self.value(name, a, F.col("id")).alias(a["name"]) for a in attributes])

    def all(self) -> dict[str, DataFrame]:
        """Every table with attributes, parents first."""
        return {t: self.table(t) for t in self.order if self.tables[t].get("attributes") and self.rows.get(t)}

    def summary(self) -> DataFrame:
        """Rows and columns per generated table, from the tables themselves."""
        parts = [
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows", F.lit(len(df.columns)).alias("cols"))
            for t, df in self.all().items()
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def fk_from_table(child: DataFrame, row_id: str, parent: DataFrame, key: str, name: str, seed=42) -> DataFrame:
    """Foreign key drawn uniformly from the keys of an existing table.

    Keys are numbered without a global window; the join key is the drawn
    number, uniform by construction, so no key is hot. Without any parent row
    the key is a whole number from 1 to 100, as for an unknown parent.
    """
    indexed = dense_index(parent.select(key), [key], "_n")
    size = indexed.count()
    draws = Draws(seed, "fk", name, F.col(row_id))
    if size == 0:
        return child.withColumn(name, (draws.whole(100) + 1).cast(parent.schema[key].dataType))
    drawn = child.withColumn("_n", draws.whole(size))
    return drawn.join(indexed.withColumnRenamed(key, name), "_n").drop("_n")


def check_plan(plan: DataFrame, max_tables: int = 30, max_rows: int = 500) -> DataFrame:
    """Oversized requests: rows above the limit, and every table once there are too many tables."""
    size = plan.agg(F.count(F.lit(1))).scalar()
    return plan.withColumn(
        "violation",
        F.when(size > max_tables, F.lit("too many tables")).when(F.col("planned_rows") > max_rows, F.lit("too many rows")),
    )


def plan_rows(tables: DataFrame, overrides: DataFrame, default_rows: int = 10, scale: float = 1.0) -> DataFrame:
    """Planned rows per table: the override, else the default, times the scale, rounded down."""
    return tables.join(overrides, "table_name", "left").select(
        "table_name", F.floor(F.coalesce("requested_rows", F.lit(default_rows)) * F.lit(scale)).alias("planned_rows")
    )


def sample_priors(ids: DataFrame, row_id: str, priors: DataFrame, seed=42) -> DataFrame:
    """One value per row and prior (column_name, dist_type, p1, p2); the result holds every row with every prior.

    | dist_type | parameters |
    | --- | --- |
    | normal, log-normal | mean and deviation (of the logarithm) |
    | uniform | bounds |
    | exponential | rate |
    | gamma | shape, scale |
    | beta | both shapes |
    | poisson | mean |
    | truncated normal | mean, deviation, and bounds in ``p3`` and ``p4`` (null: none) |
    | categorical | shares in ``weights`` (array); the value is an index from 0 |

    ``p3``, ``p4`` and ``weights`` may be missing. A kind that is not known, or parameters
    outside a kind's range, are an error when the rows are made.
    """
    key = F.concat_ws("|", "column_name", F.col(row_id).cast("string"))
    z = normal(seed, "prior", "z", key)
    u = uniform(seed, "prior", "u", key)
    p1, p2, p3, p4, weights, kind = F.col("p1"), F.col("p2"), F.col("p3"), F.col("p4"), F.col("weights"), F.lower("dist_type")
    positive = lambda *ps: reduce(lambda a, b: a & b, [F.coalesce((p > 0) & (p < float("inf")), F.lit(False)) for p in ps])
    low, high = F.coalesce(p3, F.lit(float("-inf"))), F.coalesce(p4, F.lit(float("inf")))
    shares = F.coalesce(F.forall("weights", lambda w: F.coalesce((w >= 0) & (w < float("inf")), F.lit(False))) & F.exists("weights", lambda w: w > 0), F.lit(False))
    name = F.coalesce("dist_type", F.lit("null"))

    def within(fits: Column, value: Column) -> Column:
        return F.when(fits, value).otherwise(F.raise_error(F.concat(F.lit("parameters out of range: "), name)).cast("double"))

    refused = F.raise_error(F.concat(F.lit("no such distribution: "), name)).cast("double")
    closed = (
        F.when(kind == "normal", p1 + p2 * z)
        .when(kind == "log-normal", F.exp(p1 + p2 * z))
        .when(kind == "uniform", p1 + (p2 - p1) * u)
        .when(kind == "exponential", -F.log(F.lit(1.0) - u) / p1)
        .otherwise(refused)
    )
    tried = (
        F.when(kind == "gamma", within(positive(p1, p2), draw.gamma(seed, "gamma", key, p1) * p2))
        .when(kind == "beta", within(positive(p1, p2), draw.beta(seed, key, p1, p2)))
        .when(kind == "poisson", within(positive(p1), draw.poisson(seed, key, p1)))
        .when(kind == "truncated normal", within(positive(p2) & p1.isNotNull() & (low < high), draw.truncated_normal(seed, key, p1, p2, p3, p4)))
        .when(kind == "categorical", within(shares, draw.categorical(seed, key, weights)))
        .otherwise(refused)
    )
    spare = {c: F.lit(None).cast(t) for c, t in (("p3", "double"), ("p4", "double"), ("weights", "array<double>")) if c not in priors.columns}
    listed = priors.withColumns(spare).select("column_name", "dist_type", "p1", "p2", "p3", "p4", "weights")
    by_tries = F.coalesce(kind.isin("gamma", "beta", "poisson", "truncated normal", "categorical"), F.lit(False))
    # apart, so that closed forms keep their compact generated code
    parts = [
        ids.select(row_id).crossJoin(listed.filter(which)).select(row_id, "column_name", value.alias("value"))
        for which, value in ((~by_tries, closed), (by_tries, tried))
    ]
    return parts[0].unionByName(parts[1])
