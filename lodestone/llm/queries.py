"""Queries of the training-data operators and the SQL that checks them.

p2, p6, p7 and p8 have no SQL: rules over prose, a tokenizer, an apportionment of tokens and corpus statistics. Their tests
use brute force, exact round trips and labelled fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import cross_split, format_dups, mixture, near_dups, pair_defects, stuffed_pages, tokens, top_n
from lodestone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: top_n.best_entries(table(s, d, "dump_entries")).select("entry_id"),
        "p1_ranked": lambda s, d: top_n.best_entries(table(s, d, "dump_entries")),
        "p2_found": lambda s, d: pair_defects.first_defect(table(s, d, "dump_entries")),
        "p2_all": lambda s, d: pair_defects.pair_defects(table(s, d, "dump_entries")),
        "p3_found": lambda s, d: format_dups.duplicate_lines(table(s, d, "dump_lines")),
        "p3_copies": lambda s, d: format_dups.record_copies(table(s, d, "dump_lines")),
        "p4_found": lambda s, d: cross_split.overlap_pairs(table(s, d, "qa_samples")),
        "p4_report": lambda s, d: cross_split.overlap_report(table(s, d, "qa_samples")),
        "p4_overlaps": lambda s, d: cross_split.overlap_fractions(table(s, d, "qa_samples")),
        "p5_groups": lambda s, d: near_dups.near_groups(table(s, d, "qa_samples"), table(s, d, "dump_entries")),
        "p5_found": lambda s, d: near_dups.near_same(table(s, d, "qa_samples"), table(s, d, "dump_entries")),
        "p6_ids": lambda s, d: tokens.encode_texts(table(s, d, "documents"), "doc_id", "text"),
        "p7_mixture": lambda s, d: mixture.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixture.reached_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: stuffed_pages.stuffed_pages(table(s, d, "documents")),
        "p8_scores": lambda s, d: stuffed_pages.page_scores(table(s, d, "documents")),
    }


def _words(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_BEST = """SELECT entry_id, row_number() OVER (PARTITION BY input ORDER BY score DESC, step ASC NULLS LAST, entry_id) AS "rank"
FROM dump_entries WHERE score IS NOT NULL AND NOT isnan(score) AND regexp_matches(input, '[^\\s\\p{Z}]')"""

_RECORDS = f"""WITH records AS (
  SELECT line_id, min(line_id) OVER (PARTITION BY i, o) AS keep_id FROM (
    SELECT line_id, {_words("json_extract_string(line, '$.input')")} AS i, {_words("json_extract_string(line, '$.output')")} AS o
    FROM (SELECT line_id, CASE WHEN json_valid(line) THEN line END AS line FROM dump_lines) WHERE json_type(line) = 'OBJECT')
  WHERE i IS NOT NULL AND o IS NOT NULL)
"""


def _near(name: str, elements: str, num: int, den: int) -> str:
    """CTEs: pairs of ids whose element sets have Jaccard similarity of num/den or more. elements: (id, e), distinct."""
    return f"""{name}_e AS ({elements}), {name}_n AS (SELECT id, count(*) AS n FROM {name}_e GROUP BY id),
{name}_s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM {name}_e a JOIN {name}_e b ON a.e = b.e AND a.id < b.id GROUP BY a.id, b.id),
{name} AS (SELECT a AS a_id, b AS b_id FROM {name}_s JOIN {name}_n x ON x.id = a JOIN {name}_n y ON y.id = b WHERE (x.n + y.n - s) * {num} <= s * {den})"""


_QUESTION_WORDS = f"""SELECT id, unnest(w) AS e FROM (SELECT sample_no AS id, list_distinct(string_split({_words("question")}, ' ')) AS w FROM qa_samples
  WHERE {_words("question")} <> '') WHERE len(w) >= 5"""
_OUTPUT_RUNS = f"""SELECT DISTINCT id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS e FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM (
  SELECT entry_id AS id, string_split({_words("output")}, ' ') AS w FROM dump_entries WHERE output IS NOT NULL) WHERE len(w) >= 40)"""

_OVERLAPS = f"""WITH {_near("q", _QUESTION_WORDS, 3, 4)},
rows AS (SELECT sample_no, lower(trim(split)) = 'train' AS tr, {_words("id")} AS i,
  CASE WHEN lower(trim(sexpr)) NOT IN ('null', '@bad_expression') THEN {_words("sexpr")} END AS x
  FROM qa_samples WHERE lower(trim(split)) IN ('train', 'dev', 'test')),
found AS (
  SELECT CASE WHEN a.tr THEN a_id ELSE b_id END AS train_no, CASE WHEN a.tr THEN b_id ELSE a_id END AS eval_no, 'question' AS "by"
  FROM q JOIN rows a ON a.sample_no = a_id JOIN rows b ON b.sample_no = b_id WHERE a.tr <> b.tr
  UNION ALL SELECT a.sample_no, b.sample_no, 'id' FROM rows a JOIN rows b ON a.i = b.i WHERE a.tr AND NOT b.tr AND a.i <> ''
  UNION ALL SELECT a.sample_no, b.sample_no, 'sexpr' FROM rows a JOIN rows b ON a.x = b.x WHERE a.tr AND NOT b.tr AND a.x <> '')
"""

# words cut after each place where 31 * (number of the word before) + (number of the word) is a multiple of 2; a word's number is the first 32 bits of its MD5 digest
_CHUNKS = f"""cw AS (SELECT sample_no, lower(trim(split)) = 'train' AS tr, k, w[k] AS word, ('0x' || md5(w[k])[1:8])::BIGINT AS v FROM (
    SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT sample_no, split, string_split({_words("question")}, ' ') AS w FROM qa_samples
      WHERE {_words("question")} <> '' AND lower(trim(split)) IN ('train', 'dev', 'test')))),
cr AS (SELECT *, (31 * coalesce(lag(v) OVER p, 0) + v) % 2 = 0 AS cut FROM cw WINDOW p AS (PARTITION BY sample_no ORDER BY k)),
cn AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY sample_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cr),
ck AS (SELECT sample_no, tr, part, string_agg(word, ' ' ORDER BY k) AS chunk, count(*) AS n FROM cn GROUP BY ALL),
cf AS (SELECT sample_no, sum(CASE WHEN chunk IN (SELECT chunk FROM ck WHERE tr) THEN n ELSE 0 END) / sum(n) AS overlap FROM ck WHERE NOT tr GROUP BY sample_no)
"""


def _linked(name: str, sets: str) -> str:
    """CTEs: (id, class_id, links) of every set of `sets` (id, e), from the pairs of _near."""
    return f"""{name}_k AS (SELECT id, min(id) OVER (PARTITION BY k) AS class_id FROM (SELECT id, list_sort(list(e)) AS k FROM {sets} GROUP BY id)),
{name}_l AS (SELECT id, count(*) AS links FROM (SELECT a_id AS id FROM {name} UNION ALL SELECT b_id FROM {name}) GROUP BY id),
{name}_g AS (SELECT k.id, class_id, coalesce(links, 0) AS links FROM {name}_k k LEFT JOIN {name}_l l ON k.id = l.id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f'SELECT entry_id FROM ({_BEST}) WHERE "rank" <= 3',
        "p1_ranked": f'SELECT entry_id, "rank"::INT AS "rank" FROM ({_BEST}) WHERE "rank" <= 3',
        "p3_found": _RECORDS + "SELECT keep_id, line_id FROM records WHERE line_id <> keep_id",
        "p3_copies": _RECORDS + "SELECT keep_id, count(*) AS copies FROM records GROUP BY keep_id",
        "p4_found": _OVERLAPS + "SELECT DISTINCT least(train_no, eval_no) AS a_no, greatest(train_no, eval_no) AS b_no FROM found",
        "p4_overlaps": "WITH " + _CHUNKS + "SELECT sample_no, overlap FROM cf",
        "p4_report": _OVERLAPS + ", " + _CHUNKS + """, per AS (SELECT eval_no, "by", count(*) AS pairs FROM found GROUP BY ALL)
SELECT lower(trim(split)) AS split, lower(trim(dataset)) AS dataset, "by", count(*) AS samples, sum(pairs)::BIGINT AS pairs, round(avg(overlap), 6) AS mean_overlap
FROM per JOIN qa_samples q ON q.sample_no = eval_no LEFT JOIN cf ON cf.sample_no = eval_no GROUP BY ALL""",
        "p5_groups": f"""WITH {_near("q", _QUESTION_WORDS, 3, 4)}, {_linked("q", "q_e")}, {_near("o", _OUTPUT_RUNS, 3, 5)}, {_linked("o", "o_e")}
SELECT 'question' AS kind, id, class_id, links FROM q_g UNION ALL SELECT 'output', id, class_id, links FROM o_g""",
        "p5_found": f"""WITH {_near("q", _QUESTION_WORDS, 3, 4)}, {_near("o", _OUTPUT_RUNS, 3, 5)}
SELECT 'question' AS kind, a_id, b_id FROM q UNION ALL SELECT 'output', a_id, b_id FROM o""",
    }
