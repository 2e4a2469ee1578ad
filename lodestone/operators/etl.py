"""Dataset preparation: function lists to action text, prompts, nested records, clean-up, chat messages and filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.modes import COMPARISONS, EQUALITIES, MODE_WORDS, ORDERS, mode_key
from lodestone.functions.text import bound, strip

C = F.col
# What each function is called as an action.
ACTION_OF = {"START": "Extract_entity", "JOIN": "Find_relation", "AND": "Merge", "ARG": "Order", "CMP": "Compare", "TC": "Time_constraint", "COUNT": "Count", "STOP": "Finish"}
_PATTERNS = {
    "START": r"START\('(.*?)'\)", "JOIN": r"JOIN\('(?:\(R )?(.*?)\)?', expression(\d*)\)", "AND": r"AND\((expression\d*), (expression\d*)\)", "ARG": r"ARG\('(.*?)', expression\d*, '(.*?)'\)",
    "CMP": r"CMP\('(.*?)', '(.*?)', expression\d*\)", "TC": r"TC\(expression\d*, '(.*?)', '(.*?)'\)", "COUNT": r"COUNT\((expression\d*)\)", "STOP": r"STOP\((expression\d*)\)",
}


def shown_entity(x: Column) -> Column:
    """Classes in words, other operands as they are."""
    onto = x.rlike(r"\.") & ~x.rlike(r"^[mg]\.") & ~x.contains("^^") & ~x.startswith('"')
    return F.when(onto, F.initcap(F.translate(x, "._", "  "))).otherwise(x)


def action_line(f: Column, step: Column) -> Column:
    """"ActionN: Name [ arguments ]" of one function; null for other lines."""
    g = lambda k, i: F.regexp_extract(f, _PATTERNS[k], i)
    words = F.create_map(*[F.lit(x) for kv in MODE_WORDS.items() for x in kv])
    args = {
        "START": shown_entity(g("START", 1)), "JOIN": g("JOIN", 1), "AND": F.concat(g("AND", 1), F.lit(" | "), g("AND", 2)), "ARG": F.concat(g("ARG", 1), F.lit(" | "), g("ARG", 2)),
        "CMP": F.concat(F.coalesce(F.try_element_at(words, g("CMP", 1)), g("CMP", 1)), F.lit(" | "), g("CMP", 2)), "TC": F.concat(g("TC", 1), F.lit(" | "), g("TC", 2)), "COUNT": g("COUNT", 1), "STOP": g("STOP", 1),
    }
    kind = F.regexp_extract(f, r"= (START|JOIN|AND|ARG|CMP|TC|COUNT|STOP)\(", 1)
    text = None
    for k, a in args.items():
        line = F.concat(F.lit("Action"), step.cast("string"), F.lit(f": {ACTION_OF[k]} [ "), a, F.lit(" ]"))
        text = F.when(kind == k, line) if text is None else text.when(kind == k, line)
    return text


def action_lines(functions: Column) -> Column:
    return F.filter(F.transform(functions, lambda f, i: action_line(f, i + 1)), lambda x: x.isNotNull())


def entities(functions: Column) -> Column:
    """[struct(name, id)] of starts and of times other than NOW, in order."""
    start, tc = _PATTERNS["START"], _PATTERNS["TC"]
    one = lambda f: F.when(f.contains("= START("), F.struct(shown_entity(F.regexp_extract(f, start, 1)).alias("name"), F.regexp_extract(f, start, 1).alias("id"))).when(f.contains("= TC(") & (F.regexp_extract(f, tc, 2) != "NOW"), F.struct(F.regexp_extract(f, tc, 2).alias("name"), F.regexp_extract(f, tc, 2).alias("id")))
    return F.filter(F.transform(functions, one), lambda x: x.isNotNull())


def scratchpad(functions: Column) -> Column:
    """Action and observation of each step."""
    step = lambda f, i: F.concat(F.coalesce(action_line(f, i + 1), F.lit("")), F.lit("\nObservation"), (i + 1).cast("string"), F.lit(": "), f)
    return F.array_join(F.transform(functions, step), "\n")


# The actions a prompt offers; some datasets have no comparison and counting, others no times.
OFFERED = {"Find_relation": "[entity or expression | relation]", "Merge": "[expression | expression or class]", "Order": "[MAX or MIN | expression or class | relation]", "Compare": "[le, lt, ge or gt | relation | number]", "Time_constraint": "[relation | year or NOW]", "Count": "[expression]"}


def offered(dataset: Column) -> Column:
    d = F.lower(dataset)
    lines = [F.when(~d.isin("webqsp") if n in ("Compare", "Count") else ~d.isin("grailqa", "graphq") if n == "Time_constraint" else F.lit(True), F.lit(f"* {n} {a}")) for n, a in OFFERED.items()]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def with_mark(question: Column) -> Column:
    return F.when((question != "") & ~question.endswith("?"), F.concat(question, F.lit("?"))).otherwise(question)


def prompt(question: Column, ents: Column, dataset: Column) -> Column:
    shown = F.array_join(F.transform(F.slice(ents, 1, 10), lambda e: F.concat(F.lit("'"), e["name"], F.lit("' ("), e.id, F.lit(")"))), ", ")
    head = F.when(F.size(ents) > 0, F.concat(F.lit("Candidate Entities: ["), shown, F.when(F.size(ents) > 50, ", ...").otherwise(""), F.lit("]"))).otherwise("Entities: []")
    return F.concat(F.lit("Answer with one action at a time.\n"), offered(dataset), F.lit("\n"), head, F.lit("\nQuestion: "), question)


def response(functions: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\nThe steps follow from the question.\n</think>\n\n<action>\n"), F.array_join(action_lines(functions), "\n"), F.lit("\n</action>\n\n<answer>\n"), F.array_join(answer, ", "), F.lit("\n</answer>"))


# Fixed value: the ability that records name.
ABILITY = "kbqa-action-generation"


def rl_records(qa: DataFrame) -> DataFrame:
    """Nested training records of question samples; samples without a question or functions keep empty parts."""
    fl, ans = F.coalesce("function_list", F.array().cast("array<string>")), F.coalesce("answer", F.array().cast("array<string>"))
    q = with_mark(F.coalesce("question", F.lit("")))
    ents = entities(fl)
    source = F.lower("dataset")
    return qa.select(
        "sample_no", source.alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), prompt(q, ents, source).alias("content"))).alias("prompt"), response(fl, ans).alias("response"), F.lit(ABILITY).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.struct("sexpr", ans.alias("target"), "sparql", fl.alias("function_list"), ents.alias("candidate_entities")).alias("ground_truth")).alias("reward_model"),
        F.struct("id", q.alias("original_question"), "level", source.alias("dataset_type"), F.size(ents).alias("n_entities")).alias("extra_info"))


# Headings of hint blocks in prompts; clean-up removes what add_hint puts in.
REFERENCE, EXAMPLE = "**Reference Action Sequence (for guidance):**", "**Example Solution Approach:**"
# Fixed value: the guidance that stands after the question of a prompt with hints.
AFTER = (
    "The reference already provides a complete action sequence to solve the problem. You only need to provide concise, effective reasoning. "
    "Immediately after <think>, issue the next step using <action> so the environment can execute it. "
    "Keep your reasoning brief—just explain why you will take the next action."
)


def add_hint(text: Column, hint: Column, style: str) -> Column:
    """hint before the last part of text that begins with a line "Question:"; at the end if there is none."""
    block = {"reference": F.concat(F.lit(f"\n{REFERENCE}\n"), hint, F.lit("\n\n---\n\n")), "hidden": F.concat(F.lit("\n[HINT_PLACEHOLDER: "), hint, F.lit("]\n\n")), "example": F.concat(F.lit(f"\n{EXAMPLE}\n"), hint, F.lit("\n\n"))}[style]
    at = F.locate("\nQuestion:", text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit("\n"), block, F.substr(text, at + 1), F.lit(f"\n{AFTER}"))).otherwise(F.concat(text, F.lit("\n\n**Reference Action Sequence:**\n"), hint, F.lit("\n")))


def clean_hints(text: Column) -> Column:
    s = F.regexp_replace(text, r"(?is)\*\*Reference Action Sequence \(for guidance\):\*\*.*?\n---\n", "")
    s = F.regexp_replace(s, r"(?is)\*\*Example Solution Approach:\*\*.*?(?:\n\n|\n---\n)", "")
    s = F.regexp_replace(s, r"(?i)\[HINT_PLACEHOLDER:.*?\]", "")
    s = F.replace(F.replace(s, F.lit(f"\n{AFTER}"), F.lit("")), F.lit(AFTER), F.lit(""))
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def message_parts(x: Column) -> Column:
    """[struct(role, content, loss_mask)]: information blocks are tool messages without loss, what lies between is one assistant
    message, without the blanks between its tags."""
    tight = F.regexp_replace(x, r"(?i)(</(?:think|action|answer)>)\s+(<(?:think|action|answer)>)", "$1$2")
    parts = F.split(F.regexp_replace(tight, r"(?is)(<information>.*?</information>)", "\u0001$1\u0001"), "\u0001")
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    tool = lambda p: p.rlike(r"(?is)^<information>.*</information>$")
    made = F.transform(kept, lambda p: F.struct(F.when(tool(p), "tool").otherwise("assistant").alias("role"), p.alias("content"), F.when(tool(p), 0).otherwise(1).alias("loss_mask")))
    alone = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce(x, F.lit("")).alias("content"), F.lit(1).alias("loss_mask")))
    return bound(made, lambda m: F.when(F.size(m) > 0, m).otherwise(alone))


def sft_records(entries: DataFrame) -> DataFrame:
    """Chat records of dump entries; null outputs give one empty assistant message, and a NaN score is no reward: null."""
    user = F.array(F.struct(F.lit("user").alias("role"), clean_hints(F.coalesce("input", F.lit(""))).alias("content"), F.lit(0).alias("loss_mask")))
    return entries.select("entry_id", F.concat(user, message_parts(C("output"))).alias("messages"), clean_hints(F.coalesce("input", F.lit(""))).alias("prompt"), C("output").alias("response"), F.when(~F.isnan("score"), C("score")).alias("reward"), F.struct(F.lit("rule").alias("style"), C("gts").alias("ground_truth")).alias("reward_model"), F.struct("step", "mid_f1", "structure_reward").alias("extra_info"))


def by_metrics(entries: DataFrame, least_f1: float, structure: float | None, least_score: float | None) -> DataFrame:
    """Entries that reach the metrics; a missing one is not reached."""
    keep = C("mid_f1") >= least_f1
    if structure is not None:
        keep = keep & (F.abs(C("structure_reward") - structure) <= 1e-6)
    if least_score is not None:
        keep = keep & ~F.isnan("score") & (C("score") >= least_score)
    return entries.where(keep)


class HintFold:
    """Action lines rewritten with explicit expressions.

    State: how many expressions there are, whether the last line started one, and what each stands for. Find_relation and Order
    without an operand use the entity only right after its start; Merge of two expressions names the larger first and goes back to
    the smaller; Compare takes the literal before it, which is then forgotten; Finish and lines of other form are left out.
    """

    LINE = re.compile(r"^Action\d+:\s*([A-Za-z_]+)\s*\[\s*(.*?)\s*\]$")
    COMPARE = COMPARISONS | EQUALITIES

    def __init__(self, ids: list[str]):
        self.ids, self.started = ids, 0
        self.n, self.fresh = 0, False
        self.stands: dict[int, str] = {}

    def current(self) -> str:
        return f"expression{self.n or 1}"

    def token(self, x: str) -> str:
        return self.current() if x == "expression" else x

    def line(self, text: str) -> str | None:
        m = self.LINE.match(text.strip())
        fresh, self.fresh = self.fresh, False
        if not m or m.group(1) == "Finish":
            return None
        name, args = m.group(1), [a.strip() for a in m.group(2).split("|")]
        if name == "Extract_entity":
            self.n += 1
            self.stands[self.n] = self.ids[self.started] if self.started < len(self.ids) else args[0]
            self.started += 1
            self.fresh = True
            return None
        held = self.stands.get(self.n) if fresh else None
        if name == "Find_relation":
            args = [held or self.current(), args[0]] if len(args) == 1 else [self.token(args[0]), args[1]]
        elif name == "Order":
            mode = ORDERS.get(mode_key(args[0]), args[0].upper()).removeprefix("ARG")
            args = [mode, held or self.current(), args[1]] if len(args) == 2 else [mode, self.token(args[1]), *args[2:]]
        elif name == "Merge" and len(args) >= 2:
            shown, numbers = [], []
            for a in args[:2]:
                t = self.token(a)
                k = int(t[10:]) if re.fullmatch(r"expression\d+", t) else None
                known = self.stands.get(k) if k is not None else None
                onto = known is not None and re.fullmatch(r"[^.^\"]+\.[^.^\"]+", known) and not re.match(r"^[mg]\.", known)
                shown.append(known if onto else t)
                numbers.append(None if k is None else k)
            if None not in numbers and all(s.startswith("expression") for s in shown) and numbers[0] < numbers[1]:
                shown.reverse()
            left = [k for k in numbers if k is not None]
            self.n = min(left) if left else self.n
            args = shown
        elif name == "Compare" and len(args) >= 2:
            op = self.COMPARE.get(mode_key(args[0]), args[0].lower())
            value = self.token(args[2]) if len(args) > 2 else (held or self.current())
            k = int(value[10:]) if re.fullmatch(r"expression\d+", value) else None
            known = self.stands.get(k) if k is not None else None
            if known is not None and not re.match(r"^[mg]\.", known):
                value = known
                self.stands.pop(k)
            elif len(args) == 2 and held is not None:
                self.stands.pop(self.n, None)
            args = [op, args[1], value]
        elif name not in ("Time_constraint", "Merge", "Compare"):
            args = [self.token(a) for a in args]
        return f"{name} [ {' | '.join(args)} ]"


def rewritten_hints(functions: list[str] | None) -> str:
    """Action hint of a function list."""
    lines, ids = [], []
    for i, f in enumerate(functions or [], 1):
        for k, p in _PATTERNS.items():
            m = re.search(rf"= {p}", f or "")
            if m:
                if k == "START":
                    ids.append(m.group(1))
                args = {"JOIN": m.groups()[:1], "CMP": (MODE_WORDS.get(m.group(1), m.group(1)), *m.groups()[1:])}.get(k, m.groups())
                lines.append(f"Action{i}: {ACTION_OF[k]} [ {' | '.join(args)} ]")
                break
    fold = HintFold(ids)
    return "\n".join(x for x in map(fold.line, lines) if x)
