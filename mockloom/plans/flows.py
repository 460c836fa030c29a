"""Composite flows: seed, scale up, evaluate. Spark's lazy plans replace a step runner."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.operators import hierarchy
from mockloom.operators.fidelity import evaluate_tables
from mockloom.operators.generate import TableSet, column_strategy, generation_order, references, tables_of

# fixed values: request templates, with the scale and the synthesizer they name
TEMPLATES = {
    "quick": {"scale_factor": 2.0, "synthesizer_type": "HMA"},
    "balanced": {"scale_factor": 5.0, "synthesizer_type": "HMA"},
    "high_quality": {"scale_factor": 10.0, "synthesizer_type": "CTGAN"},
}


def from_template(spark: SparkSession, template: str, schema: Mapping, rows: Mapping[str, int], seed=42):
    """Complete flow at a template's scale. Sampling uses the copula whatever synthesizer is named."""
    if template not in TEMPLATES:
        raise ValueError(f"no template is called {template}")
    return complete(spark, schema, rows, TEMPLATES[template]["scale_factor"], seed)


def quick(spark: SparkSession, schema: Mapping, rows: Mapping[str, int], seed=42) -> dict[str, DataFrame]:
    """Seed tables, each scaled up by a copula fitted on it."""
    return scale_up(spark, schema, TableSet(spark, schema, rows, seed).all(), rows, 2.0, seed)


def table_keys(schema: Mapping, seeds: Mapping[str, DataFrame]) -> tuple[dict[str, dict], list[hierarchy.Edge]]:
    """Key columns of each table, (table, column) a foreign key points at or None, and the edge by which each child follows a parent.

    A table follows the first of its foreign keys whose table comes before it; its other keys are drawn evenly.
    """
    tables = tables_of(schema)
    keys, edges, before = {}, [], set()
    for t, df in seeds.items():
        keys[t] = {}
        for a in tables[t].get("attributes") or []:
            how = column_strategy(a)
            if a["name"] not in df.columns or how not in ("primary_key", "foreign_key"):
                continue
            known = [(p, c) for p, c in references(a) if p in seeds and c in seeds[p].columns]
            keys[t][a["name"]] = None if how == "primary_key" else (known or [("", "")])[0]
            if how == "foreign_key" and known and known[0][0] in before and not any(e.child == t for e in edges):
                edges.append(hierarchy.Edge(t, a["name"], *known[0]))
        before.add(t)
    return keys, edges


def scale_up(
    spark: SparkSession, schema: Mapping, seeds: Mapping[str, DataFrame], rows: Mapping[str, int], scale: float = 2.0, seed=42
) -> dict[str, DataFrame]:
    """Each table from a copula fitted on its seed rows, children following their parents.

    Keys are not modelled: primary keys number the new rows, foreign keys point
    at rows of the scaled parent. A table without a parent has its rows times
    ``scale``; a child as many as its parents draw, close to that.
    """
    seeds = {t: seeds[t] for t in generation_order(schema) if t in seeds}
    keys, edges = table_keys(schema, seeds)
    models = hierarchy.fit(seeds, edges, {t: list(k) for t, k in keys.items()})
    return hierarchy.sample(spark, models, {t: int(rows[t] * scale) for t in seeds}, keys, seed)


def evaluation_only(real: Mapping[str, DataFrame], synth: Mapping[str, DataFrame]) -> DataFrame:
    return evaluate_tables(dict(real), dict(synth))


def complete(spark: SparkSession, schema: Mapping, rows: Mapping[str, int], scale: float = 2.0, seed=42) -> tuple[dict[str, DataFrame], DataFrame]:
    """Scaled tables and their evaluation against the seeds."""
    seeds = TableSet(spark, schema, rows, seed).all()
    made = scale_up(spark, schema, seeds, rows, scale, seed)
    return made, evaluation_only(seeds, made)
