"""Named relations written once and planned by Spark.

A relation is a SQL text whose inputs stand in braces: ``{edges}`` is another relation or a base table. ``plan`` turns a
relation into a DataFrame; every input can be replaced by a DataFrame of the caller's own, so the operators run over any
graph. ``duckdb_sql`` renders the same relation as one statement of common table expressions, which is the oracle.

``$name(a; b)`` stands for a vector expression that both dialects spell differently, ``@name`` for a parameter: a value of
the caller's (``plan(..., lam=0.25)``) or its default.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.storage import cut

#: Relations that cost a self-join, a distinct or a similarity to every prototype: where a plan reads one more than
#: once, it is written to the shared folder first instead of being computed for each reader.
SHARED = {"edges", "nbr_comm", "sim", "sim_descr", "v_nbr_comm", "v_move_gain", "v_inter_edges", "semantic_move_gain", "descr_move_gain", "move_log", "log_signs", "signals", "semantic_merge_gain", "merge_side", "member_hits"}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SPARK: dict[str, Callable[..., str]] = {
    "dot": lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, t) -> s + t)",
    "vec": lambda x: f"transform({x}, v -> CAST(v AS DOUBLE))",
    "unit": lambda x: f"transform({x}, v -> v / greatest(sqrt(aggregate(zip_with({x}, {x}, (p, q) -> p * q), 0D, (s, t) -> s + t)), 1e-12))",
    "arr": lambda v, k: f"transform(array_sort(collect_list(struct({k}, {v}))), t -> t.{v})",
    "long": lambda rel, key: f"(SELECT {key}, pos, val FROM {rel} LATERAL VIEW posexplode(x) t AS pos, val)",
    "r": lambda x: f"round({x}, 9) + 0e0",
    "add": lambda a, b, g: f"zip_with({a}, {b}, (p, q) -> p + {g} * q)",
    "split": lambda rel, key, text: f"(SELECT {key}, word FROM {rel} LATERAL VIEW explode(split({text}, ' ')) t AS word)",
    "quantile": lambda x, p: f"percentile({x}, {p})",
    "bigint": lambda x: f"try_cast({x} AS BIGINT)",
    "intlist": lambda rel, key, x: f"(SELECT {key}, item FROM {rel} LATERAL VIEW explode(from_json({x}, 'array<bigint>')) t AS item)",
    "bucket": lambda t, n: f"CAST(conv(substr(md5({t}), 1, 8), 16, 10) AS BIGINT) % {n}",
    "joined": lambda v, o, s: f"array_join(transform(array_sort(collect_list(struct({o}, {v}))), t -> t.{v}), {s})",
}
_DUCK: dict[str, Callable[..., str]] = {
    "dot": lambda a, b: f"list_dot_product({a}, {b})",
    "vec": lambda x: f"CAST({x} AS DOUBLE[])",
    "unit": lambda x: f"list_transform({x}, lambda v: v / greatest(sqrt(list_dot_product({x}, {x})), 1e-12))",
    "arr": lambda v, k: f"list({v} ORDER BY {k})",
    "long": lambda rel, key: f"(SELECT {key}, unnest(range(len(x))) AS pos, unnest(x) AS val FROM {rel})",
    "r": lambda x: f"round({x}, 9) + 0e0",
    "add": lambda a, b, g: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + {g} * z[2])",
    "split": lambda rel, key, text: f"(SELECT {key}, unnest(string_split({text}, ' ')) AS word FROM {rel})",
    "quantile": lambda x, p: f"quantile_cont({x}, {p})",
    "bigint": lambda x: f"try_cast({x} AS BIGINT)",
    "intlist": lambda rel, key, x: f"(SELECT {key}, unnest(CAST({x} AS BIGINT[])) AS item FROM {rel})",
    "bucket": lambda t, n: f"CAST(concat('0x', substr(md5({t}), 1, 8)) AS BIGINT) % {n}",
    "joined": lambda v, o, s: f"string_agg({v}, {s} ORDER BY {o})",
}
_INPUT = re.compile(r"\{(\w+)\}")

_PARAMETER = re.compile(r"@(\w+)")

RELATIONS: dict[str, str] = {}

#: Weights of the semantic term and of the two of the three-factor objective, prototype parameters, the column that is
#: killed, the accuracy gap of a failure and the kind of non-local candidates.
PARAMETERS: dict[str, float | int | str] = {"lam": 0.5, "wc": 0.25, "wd": 0.25, "gamma": 0.5, "tau": 3.0, "tau_margin": 10.0, "fraction": 0.5, "killed": 0, "gap": 0.15, "mode": "agree", "domain": "document collection"}


def _literal(value: float | int | str) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value:.17e}" if isinstance(value, float) else str(value)


def define(relations: dict[str, str]) -> None:
    """Add relations; a name is given once."""
    for name, text in relations.items():
        if name in RELATIONS or name in TABLES:
            raise ValueError(f"relation {name} is defined already")
        RELATIONS[name] = text


def render(text: str, dialect: dict[str, Callable[..., str]]) -> str:
    """``text`` with its vector expressions spelled out, the last one first, so that no argument holds another."""
    while (at := text.rfind("$")) >= 0:
        opened = text.index("(", at)
        depth, end = 1, opened
        while depth:
            end += 1
            depth += {"(": 1, ")": -1}.get(text[end], 0)
        args = [a.strip() for a in text[opened + 1 : end].split(";")]
        text = text[:at] + dialect[text[at + 1 : opened]](*args) + text[end + 1 :]
    return text


def inputs(name: str) -> list[str]:
    return list(dict.fromkeys(_INPUT.findall(RELATIONS[name])))


def plan(spark: SparkSession, name: str, sf_dir: str | None = None, **given: DataFrame | float | int | str) -> DataFrame:
    """The relation ``name``; in ``given``, DataFrames replace relations or tables and values parameters of that name."""
    values = PARAMETERS | {k: v for k, v in given.items() if k in PARAMETERS}
    done: dict[str, DataFrame] = {k: v for k, v in given.items() if k not in PARAMETERS}
    text = lambda x: _PARAMETER.sub(lambda m: _literal(values[m[1]]), RELATIONS[x])
    readers: dict[str, int] = {}
    seen: set[str] = set()

    def count(x: str) -> None:
        if x in RELATIONS and x not in given and x not in seen:
            seen.add(x)
            for i in _INPUT.findall(RELATIONS[x]):
                readers[i] = readers.get(i, 0) + 1
                count(i)

    count(name)

    def of(x: str) -> DataFrame:
        if x not in done:
            if x in RELATIONS:
                done[x] = spark.sql(render(text(x), _SPARK), **{i: of(i) for i in inputs(x)})
                if x in SHARED and readers.get(x, 0) > 1:
                    done[x] = cut(done[x], x)
            elif sf_dir is not None and x in TABLES:
                done[x] = spark.read.parquet(f"{sf_dir}/{x}.parquet")
            else:
                raise KeyError(f"{name} needs the relation {x}")
        return done[x]

    return of(name)


def duckdb_sql(name: str) -> str:
    """One DuckDB statement for the relation, over the base tables."""
    order: list[str] = []

    def visit(x: str) -> None:
        if x in RELATIONS and x not in order:
            for i in inputs(x):
                visit(i)
            order.append(x)

    visit(name)
    ctes = ", ".join(f"{x}_ AS {'MATERIALIZED ' if x in SHARED else ''}({_INPUT.sub(lambda m: m[1] + '_' if m[1] in RELATIONS else m[1], render(_PARAMETER.sub(lambda m: _literal(PARAMETERS[m[1]]), RELATIONS[x]), _DUCK))})" for x in order)
    return f"WITH {ctes} SELECT * FROM {name}_"
