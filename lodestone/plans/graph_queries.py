"""Queries of graph navigation (G) and vector similarity (V) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph, vectors
from lodestone.plans.logical_form import W, evaluate
from lodestone.sources.triples import STAR_SQL, TRIPLES_SQL, StarStore, facts, star_facts
from lodestone.session import table


def _kb(s: SparkSession, d: str) -> DataFrame:
    return facts(table(s, d, "triples"))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    kb = _kb(s, d)
    return kb.select(F.lit("reverse").alias("direction"), F.col("p").alias("relation")).unionAll(kb.where("kind = 'entity'").select(F.lit("forward"), "p")).distinct()


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return rows, rows.where("id % 20 = 0")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4))


def _top(s: SparkSession, d: str, k: int, least: float) -> DataFrame:
    rows, q = _vectors(s, d)
    return _rounded(vectors.scores(rows, q, k, least))


def _choose(s: SparkSession, d: str, least: float, k: int) -> DataFrame:
    rows, q = _vectors(s, d)
    same = q.select(F.col("id").alias("query_id"), "label").join(rows.select("id", "label"), "label").drop("label")
    return _rounded(vectors.chosen(same, vectors.scores(rows, q, 200), least, k))


def _best_label(s: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(s, d)
    per = vectors.scores(rows, q).join(rows.select("id", "label"), "id").groupBy("query_id", "label").agg(F.max("score").alias("score"))
    best = per.groupBy("query_id").agg(F.max(F.struct("score", -F.col("label"))).alias("b"))
    return _rounded(best.select("query_id", (-F.col("b.col2")).alias("label"), F.col("b.score").alias("score")).where("score >= 0.3"))


def _lists(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "relations")


def _containment(s: SparkSession, d: str) -> DataFrame:
    lits = _lists(s, d).where("list_name = 'literal'").select("relation").distinct()
    tokens = lits.select(F.explode(F.expr(r"regexp_extract_all(relation, '[\\w]+\\.[\\w]+\\.[\\w]+', 0)")).alias("token"), "relation")
    path = F.when(F.col("relation").startswith("(JOIN"), 0).otherwise(1)
    return tokens.groupBy("token").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(path.alias("k"), "relation"))), lambda x: x.relation), "; ").alias("expressions"))


_NEXT = "(JOIN customer.customer.nation m.n3)"


def queries() -> dict:
    return {
        "g01_types": lambda s, d: graph.types(_kb(s, d)),
        "g02_incoming": lambda s, d: graph.incoming(_kb(s, d)),
        "g03_outgoing": lambda s, d: graph.outgoing(_kb(s, d)),
        "g04_one_hop": lambda s, d: graph.one_hop(_kb(s, d)),
        "g05_two_hop_paths": lambda s, d: graph.role_paths(graph.two_hop(_kb(s, d)), _lists(s, d).where("list_name = 'relation'")),
        "g06_two_hop_all": lambda s, d: graph.two_hop(_kb(s, d), noise=True),
        "g07_two_hop_sets": lambda s, d: graph.two_hop_sets(graph.two_hop(_kb(s, d))),
        "g08_two_hop_in_in": lambda s, d: graph.two_hop(_kb(s, d)).where("dir0 = 'in' AND dir1 = 'in'").select("entity", "r0", "r1"),
        "g09_first_labels": lambda s, d: graph.first_labels(_kb(s, d)),
        "g10_entity_of_key": lambda s, d: StarStore(s, d).by("nation.nation.name").where("lex = 'NATION_03' OR lex = 'NATION_3'").select(F.col("s").alias("entity")),
        "g11_described": lambda s, d: graph.described(star_facts(s, d).where("s LIKE 'm.n%'"), {"nation.nation.region": "region", "nation.nation.name": "name", "rdfs:label": "label"}),
        "g12_type_list": lambda s, d: graph.types(_kb(s, d)).groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list("type")), ";").alias("types")),
        "g13_frequencies": lambda s, d: graph.frequencies(_kb(s, d)),
        "g14_plain_relations": lambda s, d: graph.frequencies(_kb(s, d)).where(F.col("relation").rlike(graph.NAMESPACED)).select("relation"),
        "g15_exists": lambda s, d: table(s, d, "qa_samples").select(F.explode(F.expr(r"array_distinct(regexp_extract_all(sexpr, '[mg]\\.\\w+', 0))")).alias("entity")).distinct().join(_kb(s, d).select(F.col("s").alias("entity")).distinct().withColumn("known", F.lit(True)), "entity", "left").select("entity", F.coalesce("known", F.lit(False)).alias("known")),
        "g16_next_relations": lambda s, d: graph.next_relations(star_facts(s, d), evaluate(StarStore(s, d), _NEXT, W, labels=False, limit=None)),
        "g17_template_relations": lambda s, d: star_facts(s, d).where("kind = 'literal' AND lex LIKE '1-U%'").groupBy(F.col("p").alias("relation")).agg(F.count("*").alias("n")),
        "g18_combined": lambda s, d: graph.combine(_candidates(s, d), _lists(s, d)),
        "g18_combined_forward_first": lambda s, d: graph.combine(_candidates(s, d), _lists(s, d), reverse_first=False, literals=True),
        "g19_without_names": lambda s, d: _candidates(s, d).where("relation <> 'type.object.name'"),
        "g20_lists": lambda s, d: _lists(s, d).groupBy("list_name").agg(F.countDistinct("relation").alias("n"), F.sum(F.col("relation").startswith("(JOIN").cast("long")).alias("paths")),
        "g21_anonymous": lambda s, d: graph.anonymous(_kb(s, d)).withColumn("relations", F.array_join("relations", ";")),
        "g22_both_directions": lambda s, d: graph.next_relations(star_facts(s, d), star_facts(s, d).where("s = 'm.n3'").select(F.col("s").alias("x")).distinct(), exclude="m.n3"),
        "v01_top_k": lambda s, d: _top(s, d, 10, 0.1),
        "v02_cosine": lambda s, d: _rounded(vectors.scores(*_vectors(s, d), cosine=True)),
        "v03_best_relations": lambda s, d: _choose(s, d, 0.1, 5),
        "v04_ranked": lambda s, d: _choose(s, d, float("-inf"), 20),
        "v05_best_group": _best_label,
        "v06_best_entity": lambda s, d: _top(s, d, 1, 0.5),
        "v07_lexical": lambda s, d: _lists(s, d).select("relation", vectors.lexical(F.lit("watch officer"), F.col("relation")).alias("score")).distinct(),
        "v09_time_relations": lambda s, d: graph.frequencies(_kb(s, d)).where(vectors.time_relation(F.col("relation"))),
        "v10_literal_containment": _containment,
    }


_PLAIN = r"regexp_matches(r, '^[A-Za-z]\w*\.\w+') AND NOT regexp_matches(r, '(?i)wikipedia|type\.object|common\.topic|_id|#type|#label|/ns/freebase') AND NOT regexp_matches(r, '^(common|type|kg|user|dataworld)\.')"


def _two_hop(where: str) -> str:
    return f"""{TRIPLES_SQL}, e AS (SELECT * FROM (SELECT s AS node, o AS other, p AS r, 'out' AS dir FROM f UNION ALL SELECT o, s, p, 'in' FROM f WHERE kind <> 'literal') WHERE {where}),
t AS (SELECT DISTINCT a.node AS entity, a.dir AS dir0, a.r AS r0, b.dir AS dir1, b.r AS r1 FROM e a JOIN e b ON b.node = a.other
 WHERE (a.node LIKE 'm.%' OR a.node LIKE 'g.%') AND (a.dir = b.dir OR b.other <> a.node))"""


_CANDIDATES = f"{TRIPLES_SQL}, c AS (SELECT DISTINCT 'reverse' AS direction, p AS relation FROM f UNION SELECT DISTINCT 'forward', p FROM f WHERE kind = 'entity')"


def _combine(first: str, lists: str) -> str:
    return f"""WITH {_CANDIDATES} SELECT relation, CASE WHEN direction = 'reverse' THEN '(R ' || relation || ')' ELSE relation END AS shown,
 relation IN (SELECT relation FROM relations WHERE list_name IN ({lists})) AS kept, CASE WHEN direction = '{first}' THEN 0 ELSE 1 END AS place FROM c WHERE relation NOT IN (SELECT relation FROM relations WHERE list_name = 'ban')"""


def _scored(fn: str) -> str:
    return f"s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {fn}(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score, q.label AS ql, r.label AS rl FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0)"


_DOT = _scored("list_dot_product")


def _chosen(least: float | None, k: int) -> str:
    bar = f"WHERE score >= {least}" if least is not None else ""
    return f"""WITH {_DOT}, ix AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s),
c AS (SELECT query_id, id, CASE WHEN k <= 200 THEN score ELSE 0.0 END AS score FROM ix WHERE ql = rl),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM c {bar})
SELECT query_id, id, round(score, 4) AS score, place::INT AS place FROM p WHERE place <= {k}"""


def oracle_sql() -> dict[str, str]:
    kb = f"WITH {TRIPLES_SQL} "
    star = f"WITH {STAR_SQL} "
    en = "regexp_matches(lang, '^[eE][nN](-.*)?$')"
    n3 = "(SELECT DISTINCT s FROM f WHERE p = 'customer.customer.nation' AND o = 'm.n3' AND s <> 'm.n3')"
    plain = _two_hop(_PLAIN)
    return {
        "g01_types": kb + "SELECT DISTINCT s AS entity, lex AS type FROM f WHERE p = 'type.object.type'",
        "g02_incoming": kb + "SELECT DISTINCT o AS entity, p AS relation FROM f WHERE kind = 'entity'",
        "g03_outgoing": kb + "SELECT DISTINCT s AS entity, p AS relation FROM f",
        "g04_one_hop": kb + r"SELECT o AS entity, p AS relation FROM f WHERE kind = 'entity' AND regexp_matches(p, '^[A-Za-z]\w*\.\w+') UNION SELECT s, p FROM f WHERE regexp_matches(p, '^[A-Za-z]\w*\.\w+')",
        "g05_two_hop_paths": f"WITH {plain}, ro AS (SELECT DISTINCT relation FROM relations WHERE list_name = 'relation') SELECT entity, r0 || CASE WHEN dir0 = 'in' THEN '#R' ELSE '' END AS first, r1 || CASE WHEN dir1 = 'in' THEN '#R' ELSE '' END AS second FROM t WHERE r0 IN (SELECT relation FROM ro) AND r1 IN (SELECT relation FROM ro)",
        "g06_two_hop_all": f"WITH {_two_hop('true')} SELECT * FROM t",
        "g07_two_hop_sets": f"WITH {plain} SELECT entity, list_sort(list(DISTINCT r)) AS relations FROM (SELECT entity, r0 AS r FROM t UNION SELECT entity, r1 FROM t) GROUP BY entity",
        "g08_two_hop_in_in": f"WITH {plain} SELECT entity, r0, r1 FROM t WHERE dir0 = 'in' AND dir1 = 'in'",
        "g09_first_labels": kb + f"SELECT s AS entity, min(lex) AS name FROM f WHERE p = 'rdfs:label' AND {en} GROUP BY s",
        "g10_entity_of_key": star + "SELECT s AS entity FROM f WHERE p = 'nation.nation.name' AND lex = 'NATION_3'",
        "g11_described": star + "SELECT s AS entity, min(lex) FILTER (p = 'nation.nation.region') AS region, min(lex) FILTER (p = 'nation.nation.name') AS name, min(lex) FILTER (p = 'rdfs:label') AS label FROM f WHERE s LIKE 'm.n%' AND p IN ('nation.nation.region', 'nation.nation.name', 'rdfs:label') GROUP BY s",
        "g12_type_list": kb + "SELECT entity, string_agg(type, ';' ORDER BY type) AS types FROM (SELECT DISTINCT s AS entity, lex AS type FROM f WHERE p = 'type.object.type') GROUP BY entity",
        "g13_frequencies": kb + "SELECT p AS relation, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM f) GROUP BY p",
        "g14_plain_relations": kb + r"SELECT DISTINCT p AS relation FROM f WHERE regexp_matches(p, '^[A-Za-z]\w*\.\w+')",
        "g15_exists": kb + r"SELECT entity, entity IN (SELECT s FROM f) AS known FROM (SELECT DISTINCT unnest(regexp_extract_all(sexpr, '[mg]\.\w+')) AS entity FROM qa_samples)",
        "g16_next_relations": star + f"SELECT 'forward' AS direction, p AS relation, count(*) AS n FROM f WHERE o IN {n3} GROUP BY p UNION ALL SELECT 'reverse', p, count(*) FROM f WHERE s IN {n3} GROUP BY p",
        "g17_template_relations": star + "SELECT p AS relation, count(*) AS n FROM f WHERE kind = 'literal' AND lex LIKE '1-U%' GROUP BY p",
        "g18_combined": _combine("reverse", "'relation'"),
        "g18_combined_forward_first": _combine("forward", "'relation', 'literal'"),
        "g19_without_names": f"WITH {_CANDIDATES} SELECT * FROM c WHERE relation <> 'type.object.name'",
        "g20_lists": "SELECT list_name, count(DISTINCT relation) AS n, sum(CASE WHEN starts_with(relation, '(JOIN') THEN 1 ELSE 0 END)::BIGINT AS paths FROM relations GROUP BY list_name",
        "g21_anonymous": kb + "SELECT node, type, array_to_string(list_sort(ps)[:10], ';') AS relations FROM (SELECT s AS node, min(lex) FILTER (p = 'type.object.type') AS type, list(DISTINCT p) AS ps FROM f WHERE s NOT IN (SELECT s FROM f WHERE p = 'rdfs:label') GROUP BY s)",
        "g22_both_directions": star + "SELECT 'forward' AS direction, p AS relation, count(*) AS n FROM f WHERE o = 'm.n3' AND s <> 'm.n3' GROUP BY p UNION ALL SELECT 'reverse', p, count(*) FROM f WHERE s = 'm.n3' AND o <> 'm.n3' GROUP BY p",
        "v01_top_k": f"WITH {_DOT} SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE score >= 0.1) WHERE k <= 10",
        "v02_cosine": f"WITH {_scored('list_cosine_similarity')} SELECT query_id, id, round(score, 4) AS score FROM s",
        "v03_best_relations": _chosen(0.1, 5),
        "v04_ranked": _chosen(None, 20),
        "v05_best_group": f"WITH {_DOT}, m AS (SELECT query_id, rl AS label, max(score) AS score FROM s GROUP BY query_id, rl) SELECT query_id, label, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS k FROM m) WHERE k = 1 AND score >= 0.3",
        "v06_best_entity": f"WITH {_DOT} SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE score >= 0.5) WHERE k = 1",
        "v07_lexical": r"SELECT DISTINCT relation, CASE WHEN contains(c, 'watch officer') THEN 0.8::DOUBLE WHEN contains(c, 'watch') OR contains(c, 'officer') THEN 0.5 ELSE 0.1 END AS score FROM (SELECT relation, lower(translate(regexp_replace(relation, '\(R |\)', '', 'g'), '_.', '  ')) AS c FROM relations)",
        "v09_time_relations": kb + "SELECT p AS relation, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM f) WHERE string_split(p, '.')[-1] IN ('from', 'end_date', 'from_date', 'start_date', 'to', 'date_written', 'year') GROUP BY p",
        "v10_literal_containment": r"SELECT token, string_agg(relation, '; ' ORDER BY k, relation) AS expressions FROM (SELECT DISTINCT unnest(regexp_extract_all(relation, '[\w]+\.[\w]+\.[\w]+')) AS token, relation, CASE WHEN starts_with(relation, '(JOIN') THEN 0 ELSE 1 END AS k FROM relations WHERE list_name = 'literal') GROUP BY token",
    }
