"""Triples as facts (s, p, o, kind, lex, dtype, lang): o is the object as one term string.

An IRI term is its id, a literal term starts with a double quote and carries its datatype and language, so terms are equal if
and only if their strings are. Filters on p, s and o reach the scan; a fact table written by `write_facts` is partitioned by
nothing but sorted by p and s, so row groups of other predicates are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL = "type.object.type", "rdfs:label"


def term(kind: Column, lex: Column, dtype: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), lex, F.lit('"'), F.coalesce(F.concat(F.lit("^^"), dtype), F.lit("")), F.coalesce(F.concat(F.lit("@"), lang), F.lit("")))
    return F.when(kind == "literal", quoted).otherwise(lex)


def facts(triples: DataFrame) -> DataFrame:
    """Facts of a triples table. A fact may come more than once; rows without s, p or object text are none."""
    o = triples.where("s IS NOT NULL AND p IS NOT NULL AND o.lex IS NOT NULL").select("s", "p", F.col("o.kind").alias("kind"), F.col("o.lex").alias("lex"), F.col("o.dtype").alias("dtype"), F.col("o.lang").alias("lang"))
    return o.select("s", "p", term(F.col("kind"), F.col("lex"), F.col("dtype"), F.col("lang")).alias("o"), "kind", "lex", "dtype", "lang")


def write_facts(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store facts clustered by predicate and subject, so that constant terms prune files and row groups."""
    spread = df.repartitionByRange(partitions, "p", "s") if partitions else df.repartitionByRange("p", "s")
    spread.sortWithinPartitions("p", "s").write.mode("overwrite").parquet(path)


# One row of the star adapter: table, subject, predicate, kind, lex, dtype, lang, condition. All in SQL both engines read.
_STAR = [
    ("customer", "'m.c' || c_custkey", "customer.customer.nation", "entity", "'m.n' || c_nationkey", None, None, "true"),
    ("customer", "'m.c' || c_custkey", "customer.customer.balance", "literal", "CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR(30))", "double", None, "true"),
    ("customer", "'m.c' || c_custkey", "customer.customer.segment", "entity", "'m.seg_' || lower(c_mktsegment)", None, None, "true"),
    ("customer", "'m.c' || c_custkey", TYPE, "class", "'customer.customer'", None, None, "true"),
    ("customer", "'m.c' || c_custkey", LABEL, "literal", "c_name", None, "en", "c_custkey % 7 <> 0"),
    ("customer", "'m.c' || c_custkey", LABEL, "literal", "'Client ' || c_custkey", None, "en-GB", "c_custkey % 9 = 0"),
    ("customer", "'m.c' || c_custkey", LABEL, "literal", "'Kunde ' || c_custkey", None, "de", "c_custkey % 10 = 0"),
    ("orders", "'m.o' || o_orderkey", "order.order.customer", "entity", "'m.c' || o_custkey", None, None, "true"),
    ("orders", "'m.o' || o_orderkey", "order.order.status", "entity", "'m.st_' || o_orderstatus", None, None, "true"),
    ("orders", "'m.o' || o_orderkey", "order.order.total", "literal", "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR(30))", "double", None, "o_orderkey % 13 <> 0"),
    ("orders", "'m.o' || o_orderkey", "order.order.total", "literal", "'n/a'", "double", None, "o_orderkey % 13 = 0"),
    ("orders", "'m.o' || o_orderkey", "order.order.total_whole", "literal", "CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR(30))", "integer", None, "true"),
    ("orders", "'m.o' || o_orderkey", "order.order.priority", "literal", "o_orderpriority", None, None, "true"),
    ("orders", "'m.o' || o_orderkey", "order.order.date", "literal", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(30))", "date", None, "true"),
    ("orders", "'m.o' || o_orderkey", TYPE, "class", "'order.order'", None, None, "true"),
    ("orders", "'m.o' || o_orderkey", "order.order.from", "literal", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(30))", "date", None, "o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0"),
    ("orders", "'m.o' || o_orderkey", "order.order.from", "literal", "'spring 1997'", "date", None, "o_orderkey % 11 = 0"),
    ("orders", "'m.o' || o_orderkey", "order.order.to", "literal", "CAST(year(o_orderdate) + 1 AS VARCHAR(30))", "gYear", None, "o_orderkey % 7 <> 0"),
    ("nation", "'m.n' || n_nationkey", "nation.nation.region", "entity", "'m.r' || n_regionkey", None, None, "true"),
    ("nation", "'m.n' || n_nationkey", "nation.nation.neighbour", "entity", "'m.n' || ((n_nationkey + 1) % 25)", None, None, "true"),
    ("nation", "'m.n' || n_nationkey", "nation.nation.neighbour", "entity", "'m.n' || n_nationkey", None, None, "n_nationkey % 6 = 0"),
    ("nation", "'m.n' || n_nationkey", "nation.nation.name", "literal", "n_name", None, None, "true"),
    ("nation", "'m.n' || n_nationkey", TYPE, "class", "'nation.nation'", None, None, "true"),
    ("nation", "'m.n' || n_nationkey", LABEL, "literal", "n_name", None, "en", "true"),
    ("region", "'m.r' || r_regionkey", LABEL, "literal", "r_name", None, "en", "true"),
    ("region", "'m.r' || r_regionkey", TYPE, "class", "'nation.region'", None, None, "true"),
    ("supplier", "'m.s' || s_suppkey", "supplier.supplier.nation", "entity", "'m.n' || s_nationkey", None, None, "true"),
    ("supplier", "'m.s' || s_suppkey", TYPE, "class", "'supplier.supplier'", None, None, "true"),
]


def _select(row: tuple, source: str) -> str:
    _, s, p, kind, lex, dtype, lang, cond = row
    dt = f"'{XSD}{dtype}'" if dtype else "CAST(NULL AS VARCHAR(99))"
    lg = f"'{lang}'" if lang else "CAST(NULL AS VARCHAR(99))"
    return f"SELECT {s} AS s, '{p}' AS p, '{kind}' AS kind, {lex} AS lex, {dt} AS dtype, {lg} AS lang FROM {source} WHERE {cond}"


def by_predicate(facts: DataFrame | StarStore, *predicates: str) -> DataFrame:
    """The facts of some predicates, from a table of facts or a store that knows where each predicate lies."""
    return facts.by(*predicates) if isinstance(facts, StarStore) else facts.where(F.col("p").isin(*predicates))


class StarStore:
    """The star-schema tables as facts. A plan is made of the branches that can hold its predicates only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def _branch(self, row: tuple) -> DataFrame:
        name, s, p, kind, lex, dtype, lang, cond = row
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.sf_dir, name)
        text = lambda x: F.lit(x).cast("string")
        part = self._tables[name].where(cond).select(F.expr(s).alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("kind"), F.expr(lex.replace("VARCHAR(30)", "STRING")).alias("lex"), text(XSD + dtype if dtype else None).alias("dtype"), text(lang).alias("lang"))
        return part.select("s", "p", term(F.col("kind"), F.col("lex"), F.col("dtype"), F.col("lang")).alias("o"), "kind", "lex", "dtype", "lang")

    def by(self, *predicates: str) -> DataFrame:
        rows = [r for r in _STAR if not predicates or r[2] in predicates]
        if not rows:
            return self._branch(_STAR[0]).where("false")
        parts = [self._branch(r) for r in rows]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out


def star_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the star-schema tables."""
    return StarStore(spark, sf_dir).by()


_TERM_SQL = """CASE WHEN kind = 'literal' THEN '"' || lex || '"' || coalesce('^^' || dtype, '') || coalesce('@' || lang, '') ELSE lex END"""
STAR_SQL = f"f AS (SELECT s, p, {_TERM_SQL} AS o, kind, lex, dtype, lang FROM (" + " UNION ALL ".join(_select(r, r[0]) for r in _STAR) + "))"
TRIPLES_SQL = f"f AS (SELECT s, p, {_TERM_SQL} AS o, kind, lex, dtype, lang FROM (SELECT s, p, o.kind AS kind, o.lex AS lex, o.dtype AS dtype, o.lang AS lang FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o.lex IS NOT NULL))"
