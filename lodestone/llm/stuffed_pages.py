"""Keyword-stuffed and link-list pages (problem 8).

Corpus counts give the pointwise mutual information (PMI) of neighbouring words. Words of one topic have some of it in any
order, so what counts is the PMI of neighbours less that of the page's words some places apart: in sentences the order of
words matters, in word salad it doesn't. A word is *salad* if the mean over the NEAR pairs on either side of it is below
COHERENT, and *repeated* if it stands in a collocation that the page has REPEATS times or more and EXCESS times as often as
the rest of the corpus would let expect. The shares of such words decide: a page of which SURE or more is salad is stuffed, one of
which at most SAFE is salad or repeated is not. Between these, and for repetition, which may be that of whole sentences, the
page's form breaks the tie: less than half of its words in sentences.

The counts cover all words and all neighbour pairs of all texts. A pair seen fewer than LEAST_COUNT times says nothing unless its words
are so frequent that it should be: it then counts as if it were just below LEAST_COUNT. Rare words thus don't blur a page's mean.

The MOST_WORDS most frequent words and the MOST_PAIRS most frequent pairs are sent to every task, so the size of these tables is
bounded whatever that of the corpus. If there are more with LEAST_COUNT or more, the counts of the rest are joined to groups of texts, one row for each group and key
that a filter of at most 2^MARK_BITS bits lets pass. The scores are the same either way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sets import _LETTERS, _Hashes, _lists
from lodestone.session import cut

MOST_WORDS = 1 << 18
MOST_PAIRS = 1 << 20
LEAST_COUNT = 3
GROUP_WORDS = 1 << 17
MARK_BITS = 27
SMOOTH = 2.0
NEAR = 8
FAR = (5, 8, 13)
COHERENT = 1.0
REPEATS = 3
EXCESS = 50.0
SURE = 0.95
SAFE = 0.2
IN_SENTENCES = 0.5
LEAST_SENTENCE = 3
MOST_SEPARATED = 0.5
LEAST_WORDS = 5
FLUSH = 500_000
_ENDERS = ".!?。！？।؟"
_PLACE = re.compile("[.!?。！？।؟\r\n  ][\"'”’»)\\]]*(\\s*)")
_ENDS = frozenset(".!?。！？।؟…:;")
_AFTER_END = "\"'”’»)]*_ \t\x0b\x0c\u00a0\u3000"
_SEPARATORS = ",|;•·#\t"
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


class _Places:
    """Finds keys among known ones with two direct-address tables; keys both of whose places are taken are searched in order."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.uint64(max(10, (4 * max(1, len(keys))).bit_length()))
        self.tables, left = [], np.arange(len(keys))
        for turn in range(2):
            table = np.full(1 << int(self.bits), -1, dtype=np.int32)
            table[self._slot(keys[left], turn)[::-1]] = left[::-1]
            left = left[table[self._slot(keys[left], turn)] != left]
            self.tables.append(table)
        self.rest = left[np.argsort(keys[left])]

    def _slot(self, x: np.ndarray, turn: int) -> np.ndarray:
        return ((x * _ODD[turn]) >> (np.uint64(64) - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of x in keys, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = self.tables[0][self._slot(x, 0)]
        there = (at >= 0) & (self.keys[at] == x)
        if not there.all():
            miss = np.flatnonzero(~there)
            y = x[miss]
            again = self.tables[1][self._slot(y, 1)]
            hit = (again >= 0) & (self.keys[again] == y)
            if len(self.rest):
                known = self.keys[self.rest]
                k = np.minimum(np.searchsorted(known, y), len(known) - 1)
                found = known[k] == y
                again, hit = np.where(found, self.rest[k], again), hit | found
            at[miss[hit]] = again[hit]
            there[miss[hit]] = True
        return at, there

    def values(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """of[place of x], 0 where x isn't known."""
        at, there = self.find(x)
        return np.where(there, of[at], 0) if len(of) else np.zeros(len(x), of.dtype)


def _marks_at(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two places of each key among 2^bits marks."""
    return [(x * odd) >> np.uint64(64 - bits) for odd in _ODD]


def _perhaps(x: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
    """Whether both marks of each key are set; without marks none is."""
    there = np.full(len(x), marks is not None)
    for at in _marks_at(x, len(marks).bit_length() + 5) if marks is not None else ():
        there &= (marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return there


def _marks(keys: DataFrame) -> np.ndarray | None:
    """Marks of the keys (key), 64 to a number, None if there are no keys. At most 2^(MARK_BITS - 6) rows come to the driver."""
    if not (n := keys.count()):
        return None
    bits = min(MARK_BITS, max(10, (16 * n).bit_length()))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(np.concatenate(_marks_at(batch.column("key").to_numpy().view(np.uint64), bits)))
            word, bit = x >> np.uint64(6), np.uint64(1) << (x & np.uint64(63))
            start = np.flatnonzero(np.diff(word, prepend=~word[:1]))
            m = np.bitwise_or.reduceat(bit, start) if len(start) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[start].view(np.int64)), pa.array(m.view(np.int64))], names=["w", "m"])

    rows = keys.select("key").mapInArrow(go, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64).view(np.uint64)
    return marks


class _Table(_Places):
    """Counts of the keys sent to every task, and marks of the rest (None if there is none)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, marks: np.ndarray | None, total: int):
        super().__init__(keys)
        self.n, self.marks, self.total = n, marks, total

    def counts(self, x: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Counts of x, of which some are in more (sorted keys, counts)."""
        out = self.values(x, self.n)
        if more and len(more[0]):
            k = np.minimum(np.searchsorted(more[0], x), len(more[0]) - 1)
            out = np.where(more[0][k] == x, more[1][k], out)
        return out

    def known(self, x: np.ndarray) -> np.ndarray:
        return self.find(x)[1] | _perhaps(x, self.marks)

    def unsent(self, x: np.ndarray) -> np.ndarray:
        """The distinct ones of x that may be in the rest."""
        x = np.unique(x)
        x = x[_perhaps(x, self.marks)]
        return x[~self.find(x)[1]]


class _Short(_Hashes):
    """32-bit digests of words."""

    def __missing__(self, word: str) -> int:
        value = self[word] = super().__missing__(word) & 0xFFFFFFFF
        return value


def sentence_share(text: str) -> tuple[list[str], float]:
    """(words, share of them in sentences). A text is cut after the ends of sentences and lines; a part is a sentence if it ends as
    one and has few words set apart by commas, bars and the like."""
    low = text.lower()
    plain = low.translate(_LETTERS)
    words, inside, start = [], 0, 0
    cuts = [(m.start(), m.end()) for m in _PLACE.finditer(low) if m.end() > m.start(1) or low[m.start()] not in ".!?।؟"]
    for at, end in cuts + [(len(low), len(low))]:
        here = plain[start:at].split()
        words += here
        if len(here) >= LEAST_SENTENCE:
            part = low[start:at]
            if (low[at : at + 1] in _ENDERS if at < len(low) else False) or part.rstrip(_AFTER_END)[-1:] in _ENDS:
                if sum(map(part.count, _SEPARATORS)) <= MOST_SEPARATED * len(here):
                    inside += len(here)
        start = end
    return words, inside / len(words) if words else 1.0


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Short()
    group, size = None, 0
    for batch in batches:
        words, shares, ends, groups = [], [], [0], []
        for row, text in zip(batch.column("_row").to_pylist(), batch.column("_t").to_pylist()):
            here, share = sentence_share(text)
            words += here
            shares.append(share)
            ends.append(len(words))
            if group is None or size > GROUP_WORDS:
                group, size = row, 0
            size += len(here)
            groups.append(group)
        flat = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint32, count=len(words))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32))), pa.array(shares, pa.float64()), pa.array(groups, pa.int64())], names=["_id", "h", "in_sentences", "_group"])


def tokenised(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(_id, h, in_sentences, _group) of each text that isn't null: 32-bit digests of its words in order, the share of them in sentences,
    and a number that it shares with its neighbours, of some GROUP_WORDS words together."""
    kind = docs.schema[row_id].dataType.simpleString()
    slim = docs.where(F.col(text).isNotNull()).select(F.col(row_id).alias("_id"), F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    return slim.mapInArrow(_tokenised, f"_id {kind}, h array<int>, in_sentences double, _group long")


def _pairs(h: np.ndarray, ends: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places of the first word) of the words `lag` places apart in one text."""
    first = np.ones(len(h) + 1, bool)  # the last place is for empty texts at the end
    for k in range(1, lag + 1):
        first[np.maximum(ends[1:] - k, ends[:-1])] &= np.diff(ends) < k  # the last `lag` words of a text begin no pair
    at = np.flatnonzero(first[:-1])
    return (h[at] << np.uint64(32)) | h[at + lag], at


def _counts(known=None):
    """Counts of words, or with known words of the neighbour pairs made of these, summed within a task before they leave it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        table = None if known is None else _Table(*known.value)

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            h, ends = _lists(batch, "h")
            h = h & _LOW
            if table is not None:
                there = table.known(h)
                keys, at = _pairs(h, ends, 1)
                h = keys[there[at] & there[at + 1]]
            held.append(h)
            size += len(h)
            if size > FLUSH:
                yield flush()
                size = 0
        yield flush()

    return go


def most_frequent(counted: DataFrame, most: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keys, counts, the least count kept, sum of all counts) of the keys of counted (key, n) with at least `least`, or so many
    more that no more than `most` are kept. What comes to the driver is bounded by `most` and by the 16 steps of each power of 2."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r.s, r.keys, r.n) for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()), reverse=True)
    kept, low = 0, None
    for s, keys, _ in steps:
        kept += keys
        if kept > most:
            break
        low = s
    bar = least if low is None and not steps else max(least, int(np.ceil(2.0 ** (low / 16) - 1e-9))) if low is not None else 1 << 62
    rows = counted.where(F.col("n") >= bar).toPandas()
    return rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), bar, sum(n for _, _, n in steps)


def _runs(groups: np.ndarray) -> list[tuple[int, int]]:
    """(first, beyond the last) of each run of equal numbers."""
    at = [*np.flatnonzero(np.diff(groups, prepend=~groups[:1])), len(groups)]
    return list(zip(at[:-1], at[1:]))


def _wanted(tables):
    """(is_pair, key, _group): the words and pairs of each group of texts whose counts weren't sent to every task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (_Table(*x) for x in tables.value)
        for batch in batches:
            h, ends = _lists(batch, "h")
            h = h & _LOW
            groups = batch.column("_group").to_numpy()
            for first, last in _runs(groups):
                here, its_ends = h[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
                lone = words.unsent(here)
                two = pairs.unsent(np.concatenate([_pairs(here, its_ends, lag)[0] for lag in (1, *FAR)]))
                n = len(lone) + len(two)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) >= len(lone)), pa.array(np.concatenate([lone, two]).view(np.int64)), pa.array(np.full(n, groups[first]))], names=["is_pair", "key", "_group"])

    return go


_Lookup = Callable[[np.ndarray], np.ndarray]


def _scored(batch: pa.RecordBatch, word_count: _Lookup, pair_count: _Lookup, total: int) -> pa.RecordBatch:
    h, ends = _lists(batch, "h")
    h = h & _LOW
    size = np.diff(ends)
    text = np.repeat(np.arange(len(size)), size)
    c = word_count(h).astype(np.float64)

    def excess(keys: np.ndarray, at: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
        """(smoothed PMI, counts) of pairs."""
        n = pair_count(keys)
        by_chance = c[at] * c[at + lag] / max(1, total)
        return np.log((np.where(n > 0, n, np.minimum(by_chance, LEAST_COUNT - 1)) + SMOOTH) / (by_chance + SMOOTH)), n

    keys, at = _pairs(h, ends, 1)
    pmi, n = excess(keys, at, 1)
    apart, apart_n = np.zeros(len(size)), np.zeros(len(size))
    for lag in FAR:
        k, i = _pairs(h, ends, lag)
        apart += np.bincount(text[i], excess(k, i, lag)[0], minlength=len(size))
        apart_n += np.maximum(size - lag, 0)
    apart /= np.maximum(apart_n, 1)
    near = np.bincount(text[at], pmi, minlength=len(size)) / np.maximum(size - 1, 1)

    sums = np.zeros(len(h) + 1)
    sums[at + 1] = pmi
    sums = np.cumsum(sums)
    i = np.arange(len(h))
    low, high = np.maximum(i - NEAR, ends[text]), np.minimum(i + NEAR, ends[text + 1] - 1)
    salad = (sums[high] - sums[low]) / np.maximum(high - low, 1) - apart[text] < COHERENT

    order = np.lexsort((keys, text[at]))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[at][order][1:] != text[at][order][:-1])
    group = np.cumsum(new) - 1
    here = np.empty(len(keys), np.int64)
    here[order] = np.bincount(group)[group] if len(keys) else 0
    elsewhere = np.maximum(n - here, 1)
    often = (here >= REPEATS) & (here * float(max(1, total)) >= EXCESS * elsewhere * size[text[at]])
    repeated = np.zeros(len(h), bool)
    repeated[at[often]] = repeated[at[often] + 1] = True

    share = lambda marks: np.bincount(text, marks, minlength=len(size)) / np.maximum(size, 1)
    return pa.RecordBatch.from_arrays(
        [batch.column("_id"), pa.array(size.astype(np.int32)), *(pa.array(x.astype(np.float64)) for x in (near - apart, share(salad), share(repeated), share(salad | repeated))), batch.column("in_sentences")],
        names=["_id", "words", "coherence", "salad", "repeated", "marked", "in_sentences"],
    )


def _score(tables):
    """Scores from the tables alone, which hold all."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (_Table(*x) for x in tables.value)
        for batch in batches:
            yield _scored(batch, words.counts, pairs.counts, words.total)

    return go


def _score_group(tables):
    """Scores of a group of texts from the tables and the counts that were looked up for it: (is_pair, key, n, _group)."""
    made = []

    def go(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not made:
            made.extend(_Table(*x) for x in tables.value)
        words, pairs = made
        is_pair, key, n = (found.column(c).to_numpy() for c in ("is_pair", "key", "n"))
        order = np.argsort(key := key.view(np.uint64))
        lone, two = order[~is_pair[order]], order[is_pair[order]]
        batch = pa.RecordBatch.from_arrays([texts.column(c).combine_chunks() for c in ("_id", "h", "in_sentences")], names=["_id", "h", "in_sentences"])
        scored = _scored(batch, lambda x: words.counts(x, (key[lone], n[lone])), lambda x: pairs.counts(x, (key[two], n[two])), words.total)
        return pa.Table.from_batches([scored])

    return go


def page_scores(docs: DataFrame, row_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(row_id, words, coherence, salad, repeated, marked, in_sentences) of each text that isn't null.

    coherence is the mean PMI of neighbouring words less that of words FAR places apart (0 for a text of fewer than two words); salad,
    repeated and marked are the shares of its words in incoherent stretches, in excessively repeated collocations and in either;
    in_sentences is the share of words in sentences. Repeated rows are scored each.
    """
    context = docs.sparkSession.sparkContext
    texts = cut(tokenised(docs, row_id, text), "words")

    def frequent(most: int, known=None) -> tuple[tuple, DataFrame]:
        """The table of words, or of pairs of known ones, and the rest (key, n) that isn't in it."""
        counted = cut(texts.select("h").mapInArrow(_counts(known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
        keys, n, bar, total = most_frequent(counted, most)
        rest = counted.where((F.col("n") >= LEAST_COUNT) & (F.col("n") < bar))
        return (keys, n, _marks(rest) if bar > LEAST_COUNT else None, total), rest

    words, more_words = frequent(most_words)
    pairs, more_pairs = frequent(most_pairs, context.broadcast(words))
    tables = context.broadcast((words, pairs))
    kind = docs.schema[row_id].dataType.simpleString()
    columns = f"_id {kind}, words int, coherence double, salad double, repeated double, marked double, in_sentences double"
    if words[2] is not None or pairs[2] is not None:
        more = more_words.withColumn("is_pair", F.lit(False)).unionByName(more_pairs.withColumn("is_pair", F.lit(True)))
        wanted = texts.select("h", "_group").mapInArrow(_wanted(tables), "is_pair boolean, key long, _group long")
        found = wanted.hint("merge").join(more, ["is_pair", "key"])
        scored = texts.groupBy("_group").cogroup(found.groupBy("_group")).applyInArrow(_score_group(tables), columns)
    else:
        scored = texts.mapInArrow(_score(tables), columns)
    return scored.withColumnRenamed("_id", row_id)


def stuffed_pages(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id of each page most of whose words stand in repeated keywords, lists of keywords, links, menus or tags.

    Null and empty texts and those of fewer than LEAST_WORDS words are no such pages, nor are lists of whole sentences.
    """
    unsure = (F.col("marked") > SAFE) & (F.col("in_sentences") < IN_SENTENCES)
    return page_scores(docs, row_id, text).where((F.col("words") >= LEAST_WORDS) & ((F.col("salad") >= SURE) | unsure)).select(row_id)
