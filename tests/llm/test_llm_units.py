"""The training-data operators on small tables with nulls, empty and very long texts, ties, repeated rows, no rows, and extra
columns whose names clash with those used inside."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import cross_split, format_dups, mixture, near_dups, pair_defects, stuffed_pages, tokens, top_n
from lodestone.llm.sets import SEGMENTS, _Hashes, elements, popcounts

CLASH = {"_g": 1, "_salt": 2, "_k": 3, "_id": 4, "_t": 5, "_s": 6, "rank": 7, "digest": 8, "key": 9, "els": 10}


def clashing(df):
    """df with columns named like those the operators use."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items() if k not in df.columns])


# 1 top n
ENTRIES = "entry_id long, input string, output string, score double, step int"


def test_best_entries(spark):
    rows = [(1, "a", "", 1.0, 5), (2, "a", "", 1.0, 3), (3, "a", "", 1.0, None), (4, "a", "", 1.0, 3), (5, "a", "", 0.5, 1), (6, "b", "", -0.0, 2), (7, "b", "", 0.0, 1), (8, "b", "", None, 1), (9, "b", "", float("nan"), 1), (10, None, "", 1.0, 1), (11, "  \t", "", 1.0, 1), (12, "B", "", -1.0, 1), (12, "B", "", -1.0, 1)]
    got = [(r.entry_id, r["rank"]) for r in top_n.best_entries(clashing(spark.createDataFrame(rows, ENTRIES))).collect()]
    assert sorted(got) == [(1, 3), (2, 1), (4, 2), (6, 2), (7, 1), (12, 1), (12, 2)]
    assert top_n.best_entries(spark.createDataFrame([], ENTRIES)).count() == 0


def test_top_n_of_one_hot_group_equals_sorting(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"g{i % 50}", "", float(rng.randint(0, 20)), rng.randint(0, 3)) for i in range(3000)]
    want = set()
    for g in {r[1] for r in rows}:
        want |= {r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[4], r[0]))[:3]}
    assert {r.entry_id for r in top_n.best_entries(spark.createDataFrame(rows, ENTRIES)).collect()} == want


# 2 broken pairs
Q = "<|im_start|>user\nEntities: ['A' (m.1)]\n\nQuestion: Who acted as choir leader for Ana Belo when Carl ran the old mill in 1900?\n<|im_end|>\n<|im_start|>assistant\n"
LONG = "<think>The list of the rows is what we want and it has the name. </think>" * 2000


@pytest.mark.parametrize(
    ("output", "found"),
    [
        (None, ["empty"]), ("", ["empty"]), ("  \n", ["empty"]), ("<|im_end|>", ["empty"]), ("<think>The rows agree.</think>\n<answer>[]</answer>", ["empty"]), ("<think>So it is.</think><ANSWER> '' </ANSWER>", ["empty"]),
        ("<think>The rows agree.</think>\n<answer>['m.1', 'm", ["truncated"]), ("<think>The rows are in the", ["truncated"]), ("The list has the rows and the first of them was", ["truncated"]), ("<think>a</think><action>Count [ expression1 ]</action>", ["truncated"]),
        ("<think>I see the rows.</think><answer>I'm sorry, but I cannot answer this question.</answer>", ["refusal"]), ("The list is long. I must decline the request. Please consult an expert.", ["refusal"]), ("<answer>Lo siento, no puedo responder esta pregunta.</answer>", ["refusal"]), ("Leider kann ich diese Frage nicht klären.", ["refusal"]),
        ("<answer>Who acted as choir leader for Ana Belo when Carl ran the old mill in 1900?</answer>", ["copies_question"]), ("who acted as choir leader for Ana Belo when Carl ran the old mill in 1900", ["copies_question"]),
        ("<think>Der Knoten gehört zu der Liste und wird nicht mit dem Wert geführt.</think><answer>m.1</answer>", ["other_language"]), ("<think>然后把列表与结果比较，还剩两个节点。</think><answer>m.1</answer>", ["other_language"]),
        ("<think>Sorry, I cannot answer that yet, the last action was wrong, so I redo it with the list.</think><answer>m.1</answer>", []), ("The rows agree with the list. Hence the answer is m.1.", []), (LONG + "<answer>m.1</answer>", []), ("<answer>false</answer>", []),
    ],
)
def test_defects(output, found):
    assert pair_defects.defects(Q, output) == found


@pytest.mark.parametrize(
    ("output", "found"),
    [
        ("Desculpe, não posso responder a essa pergunta.", ["refusal"]), ("Mi dispiace, non posso rispondere a questa domanda.", ["refusal"]), ("К сожалению, я не могу ответить на этот вопрос.", ["refusal", "other_language"]), ("申し訳ありませんが、その質問にはお答えできません。", ["refusal", "other_language"]), ("很抱歉，我無法回答這個問題。", ["refusal", "other_language"]),
        ("Sorry, I don't know.", ["refusal"]), ("As an AI language model I am not comfortable with that topic.", ["refusal"]), ("Es tut mir leid, das geht leider nicht.", ["refusal"]), ("Het spijt me, ik kan deze vraag niet beantwoorden.", ["refusal"]), ("Przykro mi, nie mogę odpowiedzieć na to pytanie.", ["refusal"]), ("Üzgünüm, bu konuda bilgi veremem.", ["refusal"]), ("죄송합니다. 답변을 드릴 수 없습니다.", ["refusal", "other_language"]),
        ("The mill was run by Carl (who had bought it.", ["truncated"]), ("The code is here:\n```\nselect 1.", ["truncated"]), ('The head of the choir said "it was Ana.', ["truncated"]), ("<answer>['m.1', 'm.2'</answer>", ["truncated"]), ("The mill (built in 1900) was run by Carl.", []), ("The rows are: a) Carl. b) Ana.", []),
        ("O moinho era do Carl e a lista não tem mais nomes, mas o nó foi lido por ela.", ["other_language"]), ("Il mulino era di Carl e la lista non ha altri nomi, ma il nodo è stato letto da lei.", ["other_language"]), ("De molen was van Carl en de lijst heeft geen namen, maar het is door haar gelezen.", ["other_language"]),
        ("Who acted as choir leader for Ana Belo when Carl ran the old mill in 1900? The list has one row with that role, and the row after it names the person who held it then: the answer is m.1.", [pair_defects.BEGINS]),
        ("The treaty prohibits to share; they refused to sign it.", []), ("In Europa will ich das Haus, das keine Tür hat.", ["other_language"]), ("We know that they refused to sign the list.", []),
    ],
)
def test_defects_in_other_words(output, found):
    assert [x for x in pair_defects.defects(Q, output) if x != "other_language" or "other_language" in found] == found


def test_defects_without_a_prompt():
    assert pair_defects.defects(None, None) == pair_defects.defects(" \n", "") == []


def test_pair_defects_table(spark):
    rows = [(1, Q, None, 0.0, 1), (1, Q, None, 0.0, 1), (2, None, None, None, None), (3, Q, "<answer>m.1</answer>", None, None)]
    df = pair_defects.pair_defects(clashing(spark.createDataFrame(rows, ENTRIES)))
    assert [(r.entry_id, r.defects) for r in df.collect()] == [(1, ["empty"]), (1, ["empty"])]
    begins = [(4, Q, Q.split("Question: ")[1].split("<|")[0] + " It was the woman whom the second row of the list names: m.1.", 0.0, 1)]
    assert pair_defects.pair_defects(spark.createDataFrame(begins, ENTRIES)).count() == 1 and pair_defects.first_defect(spark.createDataFrame(begins, ENTRIES)).count() == 0
    assert pair_defects.first_defect(spark.createDataFrame([], ENTRIES)).count() == 0


# 3 duplicates by format
LINES = "line_id long, line string"


def test_duplicate_lines(spark):
    long = "word " * 50_000
    rows = [
        (5, '{"input": "Hello, World!", "output": "One_two", "score": 1}'), (2, '\t{"output":"one TWO","input":"hello world"}\r'), (9, '{"input":"hello\\u00a0 world","step":3,"output":"one-two"}'), (3, '{"input":"hello world","output":"onetwo"}'), (4, '{"input":"hello world one","output":"two"}'),
        (6, '{"input":null,"output":"x"}'), (7, '{"output":"x"}'), (8, '{"input":"hello world","output":"one two"'), (10, "[]"), (11, None), (12, " "), (13, "null"), (14, '{"input":"","output":""}'), (15, '{"input":"...","output":"--"}'), (16, '{"input":"' + long + '","output":"a"}'), (17, '{"input":"' + long.upper() + '","output":"a"}'),
    ]
    df = clashing(spark.createDataFrame(rows, LINES))
    assert sorted(map(tuple, format_dups.duplicate_lines(df).collect())) == [(2, 5), (2, 9), (14, 15), (16, 17)]
    assert {r.keep_id: r.copies for r in format_dups.record_copies(df).collect()} == {2: 3, 3: 1, 4: 1, 14: 2, 16: 2}
    assert format_dups.duplicate_lines(spark.createDataFrame([], LINES)).count() == 0


def test_hot_keys_take_the_salted_way(spark, monkeypatch):
    monkeypatch.setattr(format_dups, "LEAST_HOT", 50)
    df = spark.range(1, 1001).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).alias("k"))
    got = {(r.id, r.keep_id) for r in format_dups.collapse(df, "k", "id").collect()}
    first = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        first.setdefault(r.k, r.id)
    assert got == {(r.id, first[r.k]) for r in df.collect()}


# 4 and 5 near-same texts
QA = "sample_no long, id string, question string, sexpr string, split string, dataset string"


def brute(sets: dict, num: int, den: int) -> set:
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


def test_near_questions_equal_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 80)}" for _ in range(rng.randint(4, 14))] for _ in range(60)]
    texts = {}
    for i in range(300):
        words = list(base[i % 60])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"W{rng.randint(0, 80)}"
        rng.shuffle(words)
        texts[i] = " ".join(words)
    rows = [(i, None, t, None, "train", None) for i, t in texts.items()] + [(900, None, None, None, None, None), (901, None, "", None, None, None), (902, None, "a b c", None, None, None)]
    sets = {i: set(t.lower().split()) for i, t in texts.items()}
    want = brute({i: s for i, s in sets.items() if len(s) >= 5}, 3, 4)
    got = {tuple(r) for r in near_dups.near_questions(clashing(spark.createDataFrame(rows, QA))).collect()}
    assert want and got == want


def test_near_outputs_equal_brute_force(spark):
    rng = random.Random(11)
    texts = {}
    for i in range(40):
        words = [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(45, 120))]
        for j in range(4):
            edited = list(words)
            for _ in range(rng.randint(0, 8)):
                edited[rng.randrange(len(edited))] = f"x{rng.randint(0, 3000)}"
            texts[i * 4 + j] = " ".join(edited)
    texts |= {500: "short text", 501: " ".join(["same"] * 5000), 502: "SAME, " * 5000}
    rows = [(i, "p", t, 0.0, 1) for i, t in texts.items()] + [(600, "p", None, 0.0, 1), (601, "p", "", 0.0, 1)]
    sets = {}
    for i, t in texts.items():
        w = t.lower().replace(",", " ").split()
        if len(w) >= 40:
            sets[i] = set(zip(w, w[1:], w[2:]))
    want = brute(sets, 3, 5)
    got = {tuple(r) for r in near_dups.near_outputs(clashing(spark.createDataFrame(rows, ENTRIES))).collect()}
    assert (501, 502) in got
    exact = {tuple(r) for r in near_dups.near_outputs(clashing(spark.createDataFrame(rows, ENTRIES)), exact=True).collect()}
    assert exact == want
    # a pair at the very bar may be missed with probability 0.0015
    assert got <= want and len(want - got) <= len(want) * 0.01


def test_links_count_copies_without_pairs(spark):
    words = [f"u{i}" for i in range(60)]
    text, edited, other = " ".join(words), " ".join(words[:58] + ["x", "y"]), " ".join(f"z{i}" for i in range(50))
    rows = [(1, "p", text, 0.0, 1), (2, "p", text.upper(), 0.0, 1), (2, "p", text.upper(), 0.0, 1), (3, "p", edited, 0.0, 1), (4, "p", other, 0.0, 1), (5, "p", "few words", 0.0, 1), (6, None, None, 0.0, 1)]
    df = clashing(spark.createDataFrame(rows, ENTRIES))
    got = near_dups.near_groups(spark.createDataFrame([(7, None, "a b c d e", None, None, None)], QA), df).collect()
    assert sorted(tuple(r) for r in got) == [("output", 1, 1, 2), ("output", 2, 1, 2), ("output", 3, 3, 2), ("output", 4, 4, 0), ("question", 7, 7, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd", "e1"]), max_size=60))
def test_chunks_are_the_words_cut_by_their_content(words):
    values = cross_split._Values()
    chunks = cross_split.chunks_of(words, values)
    assert [w for c in chunks for w in c] == words and all(chunks)
    ends = np.cumsum([len(c) for c in chunks]).tolist()
    rolled = [(31 * (values[words[i - 1]] if i else 0) + values[w]) % cross_split.CUT for i, w in enumerate(words)]
    assert [i + 1 for i, r in enumerate(rolled) if r == 0 or i == len(words) - 1] == ends


def test_overlap_fractions(spark):
    q = "who acted as choir leader for ana belo when carl ran the mill"
    rows = [(1, "", q, "", "train", ""), (2, "", q.upper(), "", "dev", ""), (3, "", "xx yy zz", "", " Test", ""), (4, "", None, "", "dev", ""), (5, "", " - ", "", "dev", ""), (6, "", q + " " + "word " * 50_000, "", "dev", ""), (7, "", q, "", None, "")]
    got = {r.sample_no: r.overlap for r in cross_split.overlap_fractions(clashing(spark.createDataFrame(rows, QA))).collect()}
    assert set(got) == {2, 3, 6} and got[2] == 1.0 and got[3] == 0.0 and 0 < got[6] < 0.001
    assert cross_split.overlap_fractions(spark.createDataFrame([], QA)).count() == 0


def test_near_same_of_empty_tables(spark):
    assert near_dups.near_same(spark.createDataFrame([], QA), spark.createDataFrame([], ENTRIES)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=80), st.sets(st.integers(0, 400), max_size=80))
def test_manhattan_distance_is_a_lower_bound(a, b):
    h = _Hashes()
    vec = lambda s: [(popcounts(elements([str(x) for x in sorted(s)], 1, h)) >> 4 * i) & 15 for i in range(SEGMENTS)] if s else [0] * SEGMENTS
    assert sum(abs(x - y) for x, y in zip(vec(a), vec(b))) <= len(a ^ b)


def test_overlaps(spark):
    q = "who acted as choir leader for ana belo when carl ran the mill"
    rows = [
        (1, "A-1", q, "(JOIN a.b m.1)", "train", "x"), (2, "b-2", q + " ?", None, "Dev", "x"), (3, "a 1", "other", "null", "test", "x"), (4, None, None, "(join a.b M.1)", "test", "X"), (5, "c", "", "@BAD_expression", "train", None), (6, "d", " ", "@bad_expression", "test", None), (7, "A-1", "more", None, "train", "x"), (8, "A-1", "else", None, None, None), (9, "-", "x", "", "train", "x"), (10, "-", "y", "", "dev", "x"),
    ]
    df = clashing(spark.createDataFrame(rows, QA))
    assert sorted(map(tuple, cross_split.overlap_pairs(df).collect())) == [(1, 2), (1, 3), (1, 4), (3, 7)]
    report = {(r.split, r.dataset, r.by): (r.samples, r.pairs) for r in cross_split.overlap_report(df).collect()}
    assert report == {("dev", "x", "question"): (1, 1), ("test", "x", "id"): (1, 2), ("test", "x", "sexpr"): (1, 1)}
    assert cross_split.overlap_pairs(spark.createDataFrame([], QA)).count() == 0


# 6 tokens
ENC = tokens.encoding(tokens.TOKENIZER)
ALPHABET = ["a", "b", "the", "ing", "é", "中", "हि", " ", "  ", "\n", "\n ", "'s", "1", ".", "--", "\t", " ", "😀", " x", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ALPHABET), st.sampled_from([1, 1, 2, 30])), max_size=40), st.sampled_from([3, 5, 16]))
def test_tree_equals_encoding_at_once(pieces, most):
    text = "".join(p * n for p, n in pieces)
    parts = list(tokens.parts_of(text, most))
    assert "".join(p for _, p in parts) == text and all(len(p) <= most for _, p in parts)
    ids = [(k, ENC.encode_to_numpy(p).astype(np.int32) if k == tokens.TEXT else np.asarray(ENC._encode_single_piece(p.encode()), dtype=np.int32)) for k, p in parts]
    assert tokens.concat_tree(ids, ENC).tolist() == ENC.encode_ordinary(text)


def test_encode_texts(spark):
    texts = [(1, None), (2, ""), (3, "Hello world <|endoftext|>"), (4, "ab" * 9_000), (5, "word " * 9_000), (6, " " * 20_000), (7, "中" * 20_000), (3, "again"), (None, "x")]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_texts(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i, ENC.encode_ordinary(t) if t else []) for i, t in texts), key=str)
    assert all(ENC.decode(ids) == dict(texts)[i] for i, ids in got if i in (4, 5, 6, 7))
    n = {r.doc_id: r.n_tokens for r in tokens.encode_texts(df.where("doc_id <> 3"), "doc_id", "text", count_only=True).collect()}
    assert n == {i: len(ids) for i, ids in got if i in n}
    assert tokens.encode_texts(df.where("false"), "doc_id", "text").count() == 0


# 7 mixture
def highest_quotients(weights, seats, caps):
    given_ = [0] * len(weights)
    for _ in range(min(seats, sum(c for w, c in zip(weights, caps) if w > 0))):
        i = max((i for i in range(len(weights)) if given_[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * given_[i] + 1), -i))
        given_[i] += 1
    return given_


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=7), st.integers(0, 90))
def test_sainte_lague(rows, seats):
    w, caps = [float(a) for a, _ in rows], [c for _, c in rows]
    assert mixture.sainte_lague(w, seats, caps) == highest_quotients(w, seats, caps)


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.randint(5, 60))), ["Big ", "big", "small", "unlisted", None][0 if i % 2 else rng.randint(1, 4)]) for i in range(2000)]
    rows += [(9001, None, "big"), (9002, "", "small"), (9003, "word " * 30_000, "big")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    targets = spark.createDataFrame([("BIG", 0.5, 1), (" small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture.mixture(docs, targets)
    assert mixed.columns == ["doc_id", "source", "n_tokens", "copies"]
    got = mixed.collect()
    assert {r.source for r in got} == {"big", "small"} and max(r.copies for r in got if r.source == "big") == 1 and max(r.copies for r in got) <= 3
    shares = {r.source: r for r in mixture.reached_shares(docs, targets).collect()}
    assert shares["absent"].n_tokens == 0 and set(shares) == {"big", "small", "absent"}
    small = [r for r in got if r.source == "small"]
    assert abs(shares["small"].actual_share - 4 / 9) < 0.15 and len(small) > 0
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    again = mixture.mixture(docs, targets).collect()
    assert sorted(again) == sorted(got)
    assert mixture.mixture(docs.where("false"), targets).count() == 0
    assert mixture.mixture(docs, targets.where("false")).count() == 0


# 8 stuffed pages
def test_sentence_share():
    assert stuffed_pages.sentence_share("") == ([], 1.0)
    assert stuffed_pages.sentence_share("cheap, free, bulk, download, excel, crack.")[1] == 0.0
    assert stuffed_pages.sentence_share("Home | Next | Cart\nLogin Sitemap")[1] == 0.0
    assert stuffed_pages.sentence_share("The mill was built in 1900. Who ran it then?\nTags: a, b")[1] > 0.7


def test_stuffed_pages(spark):
    rng = random.Random(5)
    people = [f"name{i}" for i in range(40)]
    templates = ["The mill of {a} was built near the river by {b}.", "In the spring {a} asked {b} for the key of the old mill.", "Nobody knows why {a} left the house that {b} had built."]
    sentence = lambda: rng.choice(templates).format(a=rng.choice(people), b=rng.choice(people))
    keys = ["cheap", "free", "download", "license", "excel", "crack", "online", "store", "offer", "bulk"]
    docs = [(i, " ".join(sentence() for _ in range(8))) for i in range(300)]
    docs += [(1000 + i, rng.choice([", ", " | ", "\n", " "]).join(rng.choice(keys) for _ in range(60))) for i in range(10)]
    docs += [(2000, "torrent license, " * 40), (2001, sentence() + "\n" + "cheap store, " * 60), (2002, " ".join(sentence() for _ in range(8)) + "\nTags: cheap, free, bulk"), (2003, None), (2004, ""), (2005, "..."), (2006, "word"), (2007, "Who built the mill? " * 20), (2008, "cheap " * 50_000)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {r.doc_id for r in stuffed_pages.stuffed_pages(df).collect()}
    assert found == {1000 + i for i in range(10)} | {2000, 2001, 2008}
    assert stuffed_pages.stuffed_pages(df.where("false")).count() == 0


def test_page_scores_dont_depend_on_the_tables_sent(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((2, 10, 60))]) for _ in range(rng.choice((1, 4, 30, 90))))) for i in range(400)]
    docs += [(1000, "cheap store, " * 60), (1001, "word " * 3000), (1002, None), (1003, "..."), (1004, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = lambda **most: {r.doc_id: r for r in stuffed_pages.page_scores(df, **most).collect()}
    whole = rows()
    assert len(whole) == 404
    for most in ({"most_words": 5, "most_pairs": 9}, {"most_words": 0, "most_pairs": 0}, {"most_words": 5}, {"most_pairs": 9}):
        some = rows(**most)
        assert some.keys() == whole.keys()
        assert all(tuple(some[i]) == pytest.approx(tuple(whole[i]), abs=1e-9) for i in whole)


def test_pairs_of_a_batch_that_ends_in_an_empty_text():
    h, ends = np.array([1, 2, 3], np.uint64), np.array([0, 0, 3, 3])
    assert [stuffed_pages._pairs(h, ends, lag)[1].tolist() for lag in (1, 2, 3)] == [[0, 1], [0], []]


def test_most_frequent_is_bounded(spark):
    counted = spark.createDataFrame([(k, n) for k, n in enumerate([1, 2, 3, 3, 5, 8, 100, 1000])], "key long, n long")
    keys, n, bar, total = stuffed_pages.most_frequent(counted, 100)
    assert sorted(n) == [3, 3, 5, 8, 100, 1000] and bar == 3 and total == 1122
    keys, n, bar, _ = stuffed_pages.most_frequent(counted, 3)
    assert sorted(zip(keys, n)) == [(5, 8), (6, 100), (7, 1000)] and 5 < bar <= 8
    assert len(stuffed_pages.most_frequent(counted.where("false"), 3)[0]) == len(stuffed_pages.most_frequent(counted, 0)[0]) == 0


def test_places_find_what_is_there():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    places = stuffed_pages._Places(keys)
    x = np.concatenate([keys[::7], rng.integers(0, 2**63, 500, dtype=np.uint64)])
    at, there = places.find(x)
    assert (there == np.isin(x, keys)).all() and (keys[at[there]] == x[there]).all()
    assert not stuffed_pages._Places(np.empty(0, np.uint64)).find(x)[1].any()
