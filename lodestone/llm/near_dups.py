"""Near-same texts (problem 5).

Sets of words or word runs become fingerprints, fingerprints become bit counts per segment, and the Manhattan distance of
two such vectors is a lower bound of the fingerprints' difference. A grid join finds all candidates, which are then verified
exactly on the sets.

Short sets (questions): of the difference allowed it follows that two sets agree in two of their rarest coordinates; every set
is entered in the cells of these (`prefix_cells`), and the packed popcounts of both partners must be within the allowed
Manhattan distance. This loses no pair. Long sets (outputs): the allowed difference is half of the set, and cells that no pair
can miss are so many and so full that their join grows with the square of the table (README has figures). The
fingerprint is therefore one bit in each of 256 min-hash slots, slots are grouped in 64 blocks of 4, and a pair is a
candidate if at least 2 blocks are at distance 0. A pair at similarity 0.6 is lost with probability 0.0015, one at 0.65 with
0.00005, one above 0.7 with less than 0.000001. `near_outputs(exact=True)` takes the way that loses none.

Joins that carry element arrays are sort-merge joins by hint: the size that the planner assumes for an array column is far
below the true one, and it would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sets import SEGMENTS, SLOTS, described, prefix_cells
from lodestone.session import cut

BLOCK_SLOTS = 4
LEAST_BLOCKS = 2
FILTER_BITS = 1 << 24


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed popcount vectors."""
    parts = [F.abs(F.shiftright(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * i).bitwiseAND(F.lit(15))) for i in range(SEGMENTS)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def classes(sets: DataFrame, *keys: str) -> DataFrame:
    """One row for each different set (and keys): the smallest id stands for all equal ones."""
    rest = [c for c in sets.columns if c not in ("id", "digest", *keys)]
    return sets.groupBy("digest", *keys).agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in rest])


def candidates(left: DataFrame, right: DataFrame, on: Column, num: int, den: int) -> DataFrame:
    """(a, b) of cells left (a, na, pa) and right (b, nb, pb) that meet and whose sizes and popcounts allow a similarity of num/den."""
    fit = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    bound = manhattan(F.col("pa"), F.col("pb")) * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)
    return left.join(right.hint("merge"), "cell").where(on & fit & bound).select("a", "b").distinct()


def named(cells: DataFrame, x: str) -> DataFrame:
    return cells.select("cell", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pops").alias(f"p{x}"))


def near_short(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b, of all different sets with Jaccard similarity of num/den or more. reps is read several times."""
    cells = prefix_cells(reps, num, den)
    pairs = candidates(named(cells, "a"), named(cells, "b"), F.col("a") < F.col("b"), num, den)
    return verified(pairs, reps.select("id", "els"), num, den)


def near_long(reps: DataFrame) -> DataFrame:
    """(a, b), a < b, of different sets that are candidates by their grid coordinates.

    A cell is one long, its low 16 bits the size of the set, so that a row of this large exchange has two fields.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(SLOTS // BLOCK_SLOTS - 1)))
    size = F.least("n", F.lit(0xFFFF)).cast("long")
    where = F.expr(f"xxhash64(substring(slots, {BLOCK_SLOTS} * k + 1, {BLOCK_SLOTS}), k)")
    cells = reps.select("id", size.alias("n"), "slots", blocks.alias("k")).select("id", F.shiftleft(where, 16).bitwiseOR(F.col("n")).alias("cell"))
    a = cells.select(F.col("cell").alias("ca"), F.col("id").alias("a"))
    b = cells.select(F.col("cell").alias("cb"), F.col("id").alias("b"))
    na, nb = F.col("ca").bitwiseAND(F.lit(0xFFFF)), F.col("cb").bitwiseAND(F.lit(0xFFFF))
    fit = F.least(na, nb) * 10 >= F.greatest(na, nb) * 6
    met = a.join(b.hint("merge"), (F.shiftright("ca", 16) == F.shiftright("cb", 16)) & (F.col("a") < F.col("b")) & fit)
    return met.groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_BLOCKS).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets have Jaccard similarity of num/den or more."""
    a = sets.select(F.col("id").alias("a"), F.col("els").alias("ea")).hint("merge")
    b = sets.select(F.col("id").alias("b"), F.col("els").alias("eb")).hint("merge")
    both = pairs.join(a, "a").join(b, "b").withColumn("s", F.size(F.array_intersect("ea", "eb")))
    return both.where((F.size("ea") + F.size("eb") - F.col("s")) * num <= F.col("s") * den).select("a", "b")


def expanded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a_id, b_id), the smaller first, of all members of near classes and of one class. sets: (id, digest) of all rows.

    The result holds all pairs of a class of equal sets, as problem 5 wants; `linked` doesn't expand them.
    """
    sets = sets.select("id", "digest").distinct()
    shared = sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1").select("digest", "rep")
    several = cut(sets.join(shared.hint("merge"), "digest").select("id", "rep"), "members")
    left = pairs.join(several.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left").select("b", F.coalesce("x", "a").alias("x"))
    cross = left.join(several.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
    inside = several.alias("l").join(several.hint("merge").alias("r"), "rep").where("l.id < r.id").select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    return cross.unionByName(inside).select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))


def perhaps_in(rows: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """The rows whose row_id stands in ids, and some others: ids are marked in FILTER_BITS bits, sent to all tasks as at most
    FILTER_BITS / 64 rows however many ids there are. It keeps texts that can't be wanted out of the exchange of an exact join."""
    place = F.pmod(F.xxhash64(row_id), F.lit(FILTER_BITS))
    marked = ids.select(F.shiftright(place, 6).alias("_w"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(`{row_id}`), 64)))").alias("_m"))
    bits = marked.groupBy("_w").agg(F.bit_or("_m").alias("_bits"))
    near = rows.withColumn("_w", F.shiftright(place, 6)).join(F.broadcast(bits), "_w")
    return near.where(F.expr(f"bit_get(_bits, int(pmod(xxhash64(`{row_id}`), 64))) = 1")).select(*rows.columns)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, class_id, links) of every row of sets: the smallest id of the equal sets, and how many other rows are near-same.

    Copies are counted by their classes, never expanded into pairs.
    """
    sets = sets.select("id", "digest").distinct()
    sizes = sets.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    sides = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = sides.join(sizes.select(F.col("class_id").alias("b"), "size").hint("merge"), "b").groupBy("a").agg(F.sum("size").alias("near"))
    counted = sizes.join(near.select(F.col("a").alias("class_id"), "near").hint("merge"), "class_id", "left")
    links = (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links")
    return sets.join(counted.select("digest", "class_id", links).hint("merge"), "digest").select("id", "class_id", "links")


def question_pairs(qa: DataFrame, row_id: str = "sample_no", text: str = "question") -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, sets) of questions with at least 5 distinct words, of which those in both are at least 0.75 of those
    in either."""
    sets = cut(described(qa, row_id, text, run=1, least_elements=5, keep_elements=True).select("id", "side", "n", "digest", "pops", "els"), "questions")
    return near_short(cut(classes(sets), "question-classes"), 3, 4), sets


def output_pairs(entries: DataFrame, row_id: str = "entry_id", text: str = "output", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, sets) of outputs with at least 40 words, of whose distinct runs of 3 words those in both are at least
    0.60 of those in either. exact: candidates by cells that no pair can miss."""
    if exact:
        sets = cut(described(entries, row_id, text, run=3, least_words=40, keep_elements=True).drop("slots"), "outputs")
        return near_short(cut(classes(sets), "output-classes"), 3, 5), sets
    sets = cut(described(entries, row_id, text, run=3, least_words=40, slots=True).select("id", "n", "digest", "slots"), "outputs")
    pairs = cut(near_long(classes(sets)), "output-pairs")
    ids = pairs.select(F.col("a").alias(row_id)).union(pairs.select(F.col("b").alias(row_id))).distinct()
    # an inner join, which stays behind the filter; a semi-join would be pushed below it
    again = perhaps_in(entries.select(row_id, text), ids, row_id).join(ids, row_id)
    els = cut(described(again, row_id, text, run=3, least_words=40, keep_elements=True).select("id", "els"), "elements")
    return verified(pairs, els, 3, 5), sets


def near_questions(qa: DataFrame, row_id: str = "sample_no", text: str = "question") -> DataFrame:
    """(a_id, b_id) of all near-same questions."""
    return expanded(*question_pairs(qa, row_id, text))


def near_outputs(entries: DataFrame, row_id: str = "entry_id", text: str = "output", exact: bool = False) -> DataFrame:
    """(a_id, b_id) of all near-same outputs."""
    return expanded(*output_pairs(entries, row_id, text, exact))


def near_same(qa: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, a_id, b_id), one row for every near-same pair of questions and of outputs.

    Null, empty and short texts take part in no pair; texts with equal sets are pairs; repeated rows with one id are one text.
    Word counts, candidates and checks cover whole texts and all rows.
    """
    q = near_questions(qa).select(F.lit("question").alias("kind"), "a_id", "b_id")
    return q.unionByName(near_outputs(entries).select(F.lit("output").alias("kind"), "a_id", "b_id"))


def near_groups(qa: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, id, class_id, links), one row for every question and output that takes part: its class of equal texts and the
    number of other rows that are near-same to it."""
    q = linked(*question_pairs(qa)).select(F.lit("question").alias("kind"), "id", "class_id", "links")
    return q.unionByName(linked(*output_pairs(entries)).select(F.lit("output").alias("kind"), "id", "class_id", "links"))
