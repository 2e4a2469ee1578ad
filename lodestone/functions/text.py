"""Answer extraction, normalisation, tag grammars and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("think", "action", "information", "answer")
# Signs of a timeout in an output, in lower case.
TIMEOUTS = ("hyt00", "timeout")


def bound(x: Column, fn) -> Column:
    """fn(x) with x computed once, however often fn uses it: x is the only element of an array that fn maps."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def occurrences(x: Column, text: str) -> Column:
    """How often text stands in x, by the length it takes; no pattern is matched."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(text), F.lit("")))) / len(text)).cast("int")


def holds_any(x: Column, texts: tuple[str, ...]) -> Column:
    """Whether x holds one of some lower-case texts, in any case."""

    def look(low: Column) -> Column:
        found = low.contains(texts[0])
        for t in texts[1:]:
            found = found | low.contains(t)
        return found

    return bound(F.lower(x), look)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def _without_articles(x: Column) -> Column:
    return F.array_join(F.filter(F.split(squeeze(x), " "), lambda w: ~w.isin("a", "an", "the")), " ")


def normalize_spaced(x: Column) -> Column:
    """Lower case, punctuation to blanks, no articles, single blanks; empty for null."""
    return _without_articles(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def normalize_joined(x: Column) -> Column:
    """Lower case, ASCII punctuation removed, no articles, single blanks."""
    return _without_articles(F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", ""))


def tagged(x: Column, tag: str, any_case: bool = False) -> Column:
    """All contents of a tag, in order."""
    flags = "(?is)" if any_case else "(?s)"
    return F.regexp_extract_all(x, F.lit(f"{flags}<{tag}>(.*?)</{tag}>"), F.lit(1))


def first_answer(x: Column) -> Column:
    return F.coalesce(strip(F.get(tagged(x, "answer"), F.lit(0))), F.lit(""))


def last_answer(x: Column) -> Column:
    return strip(F.try_element_at(tagged(x, "answer"), F.lit(-1)))


def mid_list(x: Column) -> Column:
    """Values of the last answer tag: a JSON list, single quotes allowed, or else words; null without tag or values."""

    def values(content: Column) -> Column:
        listed = content.startswith("[") & content.endswith("]")
        json = F.when(listed, F.regexp_replace(content, "'", '"'))
        words = lambda t: F.filter(F.split(t, r"\s+"), lambda v: v != "")
        kept = lambda p: F.filter(F.transform(p, strip), lambda v: v.isNotNull() & (v != ""))
        return bound(F.from_json(json, "array<string>"), lambda p: F.when(p.isNotNull(), kept(p)).otherwise(bound(words(F.coalesce(json, content)), lambda w: F.when(F.size(w) > 0, w))))

    return bound(strip(F.try_element_at(tagged(x, "answer", any_case=True), F.lit(-1))), values)


def prf(gold: Column, pred: Column) -> Column:
    """struct(p, r, f1) of two lists as sets. No gold: recall 1, the rest 1 if there is no prediction either, else 0. No
    prediction: precision 1, the rest 0."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    hit = F.size(F.array_intersect(g, p)).cast("double")
    prec, rec = hit / F.size(p), hit / F.size(g)
    f1 = F.when(hit == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    make = lambda a, b, c: F.struct(a.alias("p"), b.alias("r"), c.alias("f1"))
    none = (F.size(p) == 0).cast("double")
    return F.when(F.size(g) <= 0, make(none, F.lit(1.0), none)).when(F.size(p) <= 0, make(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(make(prec, rec, f1))


def best_prf(golds: Column, pred: Column) -> Column:
    """prf of the gold list with the highest F1, the first of equals; empty gold lists are passed over."""
    scored = F.transform(F.transform(F.filter(golds, lambda g: F.size(g) > 0), lambda g: prf(g, pred)), lambda s, i: F.struct(s.f1.alias("k"), (-i).alias("i"), s.alias("s")))
    return F.coalesce(F.array_max(scored).s, prf(F.array().cast("array<string>"), pred))


def encoded(x: Column, middle: str = "action") -> Column:
    """x with every tag as one control character, so that "no tag" is a character class."""
    for i, tag in enumerate(("think", middle, "information", "answer")):
        x = F.replace(F.replace(x, F.lit(f"<{tag}>"), F.lit(chr(1 + 2 * i))), F.lit(f"</{tag}>"), F.lit(chr(2 + 2 * i)))
    return x


_C = r"[^\x01-\x08]*"
ACTION_GRAMMAR = rf"^\s*\x01{_C}\x02\s*(?:\x03{_C}\x04\s*\x05{_C}\x06{_C}\x01{_C}\x02\s*)*(?:\x03{_C}\x04\s*\x05{_C}\x06{_C})?\x07{_C}\x08\s*$"
SPARQL_GRAMMAR = rf"^\s*(?:\x01{_C}\x02\s*\x03{_C}\x04\s*\x05{_C}\x06\s*)+\x07{_C}\x08\s*$"
MARKER = "<|im_start|>assistant"


def after_marker(x: Column) -> Column:
    """x after its first assistant marker; x as it is without one."""
    at = F.locate(MARKER, x)
    return F.when(at > 0, F.substr(x, at + len(MARKER))).otherwise(x)


def valid_action_sequence(x: Column) -> Column:
    """think, then rounds of action, information and think, then answer, which may follow a thought or an information; free
    text is allowed inside tags and after information. Text up to an assistant marker is skipped."""
    return encoded(after_marker(x)).rlike(ACTION_GRAMMAR)


def valid_sparql_sequence(x: Column) -> Column:
    """Rounds of think, sparql and information, then answer; a marker is required and no text is allowed between tags."""
    return x.contains(MARKER) & encoded(after_marker(x), "sparql").rlike(SPARQL_GRAMMAR)


def tag_balance(x: Column) -> Column:
    """Sum over the tags of 1 if balanced, 0.5 if both kinds occur, 0.2 if one does, 0 if none."""
    total = F.lit(0.0)
    for t in TAGS:
        a, b = occurrences(x, f"<{t}>"), occurrences(x, f"</{t}>")
        total = total + F.when((a > 0) & (b > 0), F.when(a == b, 1.0).otherwise(0.5)).when((a > 0) | (b > 0), 0.2).otherwise(0.0)
    return total


def partial_format_reward(x: Column, base: float) -> Column:
    return tag_balance(x) / len(TAGS) * 0.3 * base


def mid_reward(x: Column, gold: Column, mids: Column, structure: float = 0.1, penalty: float = -1.0) -> Column:
    """struct(total, mid_f1, structure_reward, timeout_penalty): a timeout gives the penalty, no values give 0, otherwise F1 and,
    if it is above 0, a reward for structure. mids: the values, as mid_list gives them."""
    f1 = prf(F.filter(F.transform(F.coalesce(gold, F.array().cast("array<string>")), strip), lambda v: v != ""), mids).f1
    fmt = F.when(f1 > 0, F.when(valid_action_sequence(x), F.lit(structure)).otherwise(partial_format_reward(x, structure))).otherwise(0.0)
    make = lambda t, f, s, p: F.struct(t.alias("total"), f.alias("mid_f1"), s.alias("structure_reward"), p.alias("timeout_penalty"))
    zero = F.lit(0.0)
    return F.when(holds_any(x, TIMEOUTS), make(F.lit(penalty), zero, zero, F.lit(penalty))).when(mids.isNull(), make(zero, zero, zero, zero)).otherwise(make(f1 + fmt, f1, fmt, zero))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two texts' sets of words; 0 if either has none."""
    words = lambda t: F.filter(F.array_distinct(F.split(t, r"\s+")), lambda w: w != "")
    p, g = words(pred), words(gold)
    hit = F.size(F.array_intersect(p, g)).cast("double")
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (hit == 0), 0.0).otherwise(2 * hit / (F.size(p) + F.size(g)))


def exact_or_f1(pred: Column, golds: Column) -> Column:
    """1 if the normalised prediction is one of the golds, else the best token F1; 0 for an empty prediction."""
    p = normalize_spaced(pred)
    gs = F.transform(golds, normalize_spaced)
    best = F.coalesce(F.array_max(F.transform(gs, lambda g: token_f1(p, g))), F.lit(0.0))
    return F.when(pred.isNull() | (pred == ""), 0.0).when(F.array_contains(gs, p), 1.0).otherwise(best)


def exact(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize_joined(g) == normalize_joined(pred))


def contained(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize_joined(pred).contains(normalize_joined(g)))


def same_query(a: Column, b: Column, any_case: bool = False) -> Column:
    a, b = squeeze(a), squeeze(b)
    return F.lower(a) == F.lower(b) if any_case else a == b


def relevant(x: Column, golds: Column, ids: bool) -> Column:
    """Whether an information block holds a gold answer: ids as they are, other answers normalised."""
    blocks = tagged(x, "information")
    hit = (lambda b, g: b.contains(g)) if ids else (lambda b, g: normalize_joined(b).contains(normalize_joined(g)))
    return F.exists(blocks, lambda b: F.exists(golds, lambda g: hit(b, g)))


def progressive(reward: Column, step: Column, warmup: int = 10) -> Column:
    scale = F.when(step <= 0, 1.0).when(step <= warmup, 0.1 + step / warmup * 0.9).otherwise(1.0)
    return reward * scale


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def until_close(x: Column) -> Column:
    """x up to and with its first </action>, or else its first </answer>."""
    a, b = F.instr(x, "</action>"), F.instr(x, "</answer>")
    return F.when(a > 0, F.substr(x, F.lit(1), a + 8)).when(b > 0, F.substr(x, F.lit(1), b + 8)).otherwise(x)


def candidate_entities(prompt: Column) -> Column:
    """[struct(name, id)] of the candidate list of a prompt."""
    inner = F.regexp_extract(prompt, r"(?s)(?:Candidate Entities|Entities):\s*\[(.*?)\]", 1)
    pair = r"'([^']+)'\s*\(([^)]+)\)"
    return F.transform(F.arrays_zip(F.regexp_extract_all(inner, F.lit(pair), F.lit(1)).alias("a"), F.regexp_extract_all(inner, F.lit(pair), F.lit(2)).alias("b")), lambda p: F.struct(p.a.alias("name"), p.b.alias("id")))


NUMBER = r"(-?[0-9.,]+)"


def number_answer(x: Column, strict: bool) -> Column:
    """The number an output gives as its result: after the last "####" if strict, else the last one that isn't a mere point.

    Only the last 300 characters count. Thousands separators go if strict. Null if there is none.
    """
    tail = F.right(x, F.lit(300))
    if strict:
        return F.replace(F.try_element_at(F.regexp_extract_all(tail, F.lit("#### " + NUMBER), F.lit(1)), F.lit(-1)), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(tail, F.lit(NUMBER), F.lit(1))
    real = F.filter(found, lambda v: v != ".")
    return F.coalesce(F.try_element_at(real, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def boxed_answer(x: Column) -> Column:
    """Content of the last \\boxed{...}, whose braces may nest three deep; null without one."""
    inner = r"[^{}]*"
    for _ in range(3):
        inner = r"(?:[^{}]|\{" + inner + r"\})*"
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"\\boxed\s*\{(" + inner + r")\}"), F.lit(1)), F.lit(-1))


# Rewritings that make two writings of one mathematical value equal, in order.
MATH_FORMS = [
    (r"\n|\\!|\\left|\\right|\^\{?\\circ\}?|\\\$|\\?%", ""), (r"\\[td]frac", r"\\frac"), (r"\\text\{ .*$", ""), (r"^\.", "0."), (r"([ {])\.", "${1}0."), (r"^[^=]{0,2}=([^=]*)$", "$1"), (r"\\sqrt(\w)", r"\\sqrt{$1}"),
    (r"\s+", ""), (r"\\frac(\d)(\d)", r"\\frac{$1}{$2}"), (r"\\frac(\d)\{", r"\\frac{$1}{"), (r"^0\.5$", r"\\frac{1}{2}"), (r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}"),
]


def math_normal(x: Column) -> Column:
    """A mathematical answer in one writing of several equal ones."""
    for pattern, by in MATH_FORMS:
        x = F.regexp_replace(x, pattern, by)
    return x
