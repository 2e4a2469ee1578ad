"""Navigation of the fact graph: types, labels, relations one and two hops away, candidates for the next step.

Operators take a table of facts and return rows for all entities, or for those of a given table of seeds. Two-hop operators
reduce every node to its distinct relations first, so a hub with a third of all edges contributes as many rows as it has
relations, not as many as it has neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.triples import LABEL, TYPE

# Relations that say nothing about an entity.
NOISE = r"(?i)wikipedia|type\.object|common\.topic|_id|#type|#label|/ns/freebase"
NOISE_SPACES = r"^(common|type|kg|user|dataworld)\."
NAMESPACED = r"^[A-Za-z]\w*\.\w+"


def plain(p: Column) -> Column:
    """Whether a relation is in the data's namespace and no noise."""
    return p.rlike(NAMESPACED) & ~p.rlike(NOISE) & ~p.rlike(NOISE_SPACES)


def edges(facts: DataFrame) -> DataFrame:
    """(node, other, r, dir): each fact from both its ends; dir is in where node is the object."""
    real = facts.where(F.col("kind") != "literal")
    return facts.select(F.col("s").alias("node"), F.col("o").alias("other"), F.col("p").alias("r"), F.lit("out").alias("dir")).unionByName(
        real.select(F.col("o").alias("node"), F.col("s").alias("other"), F.col("p").alias("r"), F.lit("in").alias("dir")))


def types(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("p") == TYPE).select(F.col("s").alias("entity"), F.col("lex").alias("type")).distinct()


def incoming(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "entity").select(F.col("o").alias("entity"), F.col("p").alias("relation")).distinct()


def outgoing(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("s").alias("entity"), F.col("p").alias("relation")).distinct()


def one_hop(facts: DataFrame) -> DataFrame:
    both = incoming(facts).unionByName(outgoing(facts)).where(F.col("relation").rlike(NAMESPACED))
    return both.distinct()


def two_hop(facts: DataFrame, noise: bool = False) -> DataFrame:
    """(entity, dir0, r0, dir1, r1): relations of an entity and of its neighbours.

    A neighbour's relation counts if it leads to another node than back to the entity, where the directions differ. Noise
    relations are left out unless wanted.
    """
    e = edges(facts)
    if not noise:
        e = e.where(plain(F.col("r")))
    second = e.groupBy(F.col("node").alias("mid"), F.col("dir").alias("dir1"), F.col("r").alias("r1")).agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    first = e.where("node LIKE 'm.%' OR node LIKE 'g.%'").select(F.col("node").alias("entity"), F.col("dir").alias("dir0"), F.col("r").alias("r0"), F.col("other").alias("mid"))
    back = (F.col("dir0") != F.col("dir1")) & (F.col("lo") == F.col("entity")) & (F.col("hi") == F.col("entity"))
    return first.join(second, "mid").where(~back).select("entity", "dir0", "r0", "dir1", "r1").distinct()


def two_hop_sets(paths: DataFrame) -> DataFrame:
    """(entity, relations): all relations within two hops, sorted."""
    return paths.select("entity", F.explode(F.array("r0", "r1")).alias("r")).groupBy("entity").agg(F.sort_array(F.collect_set("r")).alias("relations"))


def role_paths(paths: DataFrame, roles: DataFrame) -> DataFrame:
    """Paths both of whose relations are roles; reversed hops are marked #R."""
    r = roles.select("relation").distinct()
    kept = paths.join(r.withColumnRenamed("relation", "r0"), "r0", "left_semi").join(r.withColumnRenamed("relation", "r1"), "r1", "left_semi")
    mark = lambda d, x: F.when(F.col(d) == "in", F.concat(x, F.lit("#R"))).otherwise(F.col(x))
    return kept.select("entity", mark("dir0", "r0").alias("first"), mark("dir1", "r1").alias("second"))


def first_labels(facts: DataFrame) -> DataFrame:
    """(entity, name): the first English label."""
    return facts.where((F.col("p") == LABEL) & F.col("lang").rlike("(?i)^en(-.*)?$")).groupBy(F.col("s").alias("entity")).agg(F.min("lex").alias("name"))


def described(facts: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(entity, one column per key): the least value of each given relation."""
    rows = facts.where(F.col("p").isin(list(keys)))
    return rows.groupBy(F.col("s").alias("entity")).agg(*[F.min(F.when(F.col("p") == p, F.col("lex"))).alias(c) for p, c in keys.items()])


def frequencies(facts: DataFrame) -> DataFrame:
    """(relation, n): in how many different facts each relation stands."""
    return facts.select("s", "p", "o").distinct().groupBy(F.col("p").alias("relation")).agg(F.count("*").alias("n"))


def next_relations(facts: DataFrame, answers: DataFrame, exclude: str | None = None) -> DataFrame:
    """(direction, relation, n): forward are relations into the current answers (x), reverse those out of them."""
    into = facts.join(answers.select(F.col("x").alias("o")), "o", "left_semi").select(F.lit("forward").alias("direction"), "p", F.col("s").alias("y"))
    out = facts.join(answers.select(F.col("x").alias("s")), "s", "left_semi").select(F.lit("reverse").alias("direction"), "p", F.col("o").alias("y"))
    both = into.unionByName(out)
    if exclude is not None:
        both = both.where(F.col("y") != exclude)
    return both.groupBy("direction", F.col("p").alias("relation")).agg(F.count("*").alias("n"))


def combine(candidates: DataFrame, lists: DataFrame, reverse_first: bool = True, literals: bool = False) -> DataFrame:
    """(relation, shown, kept, place) of candidate (direction, relation) rows: banned ones are dropped, others are kept if they
    are in a whitelist; kept ones come first, by direction, then name."""
    named = lists.select("relation", "list_name").distinct()
    ban = named.where("list_name = 'ban'").select("relation")
    white = named.where(F.col("list_name").isin(["relation", "literal"] if literals else ["relation"])).select("relation").distinct().withColumn("kept", F.lit(True))
    rows = candidates.select("direction", "relation").distinct().join(ban, "relation", "left_anti").join(white, "relation", "left")
    shown = F.when(F.col("direction") == "reverse", F.concat(F.lit("(R "), "relation", F.lit(")"))).otherwise(F.col("relation"))
    place = F.when(F.col("direction") == ("reverse" if reverse_first else "forward"), 0).otherwise(1)
    return rows.select("relation", shown.alias("shown"), F.coalesce("kept", F.lit(False)).alias("kept"), place.alias("place"))


def anonymous(facts: DataFrame) -> DataFrame:
    """(node, type, relations): nodes without any label, with their least type and first ten relations."""
    named = facts.where(F.col("p") == LABEL).select(F.col("s").alias("node"))
    rows = facts.select(F.col("s").alias("node"), "p", "lex").join(named, "node", "left_anti")
    return rows.groupBy("node").agg(F.min(F.when(F.col("p") == TYPE, F.col("lex"))).alias("type"), F.slice(F.sort_array(F.collect_set("p")), 1, 10).alias("relations"))
