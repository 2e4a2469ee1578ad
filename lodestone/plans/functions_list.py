"""Function lists, actions and S-expressions: parsed, never executed."""

from __future__ import annotations

import re

from lodestone.functions.modes import COMPARISONS, ORDERS, mode_key

BAD = "@BAD_EXPRESSION"
_CALL = re.compile(r"^\s*expression(\d*)\s*=\s*(START|JOIN|AND|ARG|CMP|TC|COUNT|STOP)\s*\((.*)\)\s*$", re.DOTALL)
_ARG = re.compile(r"""\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|(expression\d*)|([^,'"]+))\s*(?:,|$)""")
_ARITY = {"START": 1, "JOIN": 2, "AND": 2, "ARG": 3, "CMP": 3, "TC": 3, "COUNT": 1, "STOP": 1}


def parse_call(line: str) -> tuple[str, str, list[tuple[bool, str]]] | None:
    """(target, function, arguments) of one line; an argument is (whether it names an expression, text)."""
    m = _CALL.match(line or "")
    if not m:
        return None
    args, pos = [], 0
    text = m.group(3)
    while pos < len(text):
        a = _ARG.match(text, pos)
        if not a or a.end() == pos:
            return None
        quoted = a.group(1) if a.group(1) is not None else a.group(2)
        args.append((True, a.group(3)) if a.group(3) else (False, quoted if quoted is not None else a.group(4).strip()))
        pos = a.end()
    return f"expression{m.group(1)}", m.group(2), args


def to_sexpr(lines: list[str] | None) -> str:
    """S-expression of a function list: the last STOP's operand, or else the last expression made. BAD if any line fails."""
    made: dict[str, str] = {}
    last = stopped = None
    for line in lines or []:
        call = parse_call(line)
        if call is None:
            return BAD
        target, fn, args = call
        if len(args) != _ARITY[fn]:
            return BAD
        values = []
        for ref, text in args:
            if ref and text not in made:
                return BAD
            values.append(made[text] if ref else text)
        if fn in ("START", "STOP"):
            made[target] = values[0]
            stopped = values[0] if fn == "STOP" else stopped
        elif fn == "ARG":
            if values[0] not in ("ARGMAX", "ARGMIN"):
                return BAD
            made[target] = f"({values[0]} {values[1]} {values[2]})"
        elif fn == "CMP":
            made[target] = f"({values[0]} {values[1]} {values[2]})"
        else:
            made[target] = "(" + " ".join([fn, *values]) + ")"
        last = made[target]
    return stopped or last or BAD


# Names of the actions and, in the order they are tried, how many arguments each takes.
ACTIONS = {"Find_relation": 2, "Merge": 2, "Order": 3, "Compare": 3, "Time_constraint": 2, "Count": 1}
_NEEDED = {n: re.compile(rf"(?:Action(\d+):\s*|^){n}\s*\[" + r"\|".join([r"\s*([^|\]]+?)\s*"] * k) + r"\]", re.IGNORECASE | re.MULTILINE) for n, k in ACTIONS.items()}


def parse_action(text: str) -> tuple[str, list[str], int] | None:
    """(name, arguments, step) of the first action in text; names are tried in the order of ACTIONS."""
    for name, pattern in _NEEDED.items():
        if m := pattern.search(text.strip()):
            return name, [a.strip() for a in m.groups()[1:]], int(m.group(1) or 0)
    return None


def parse_actions(response: str) -> list[tuple[str, list[str], int]]:
    """Actions of the first <action> block, line by line."""
    m = re.search(r"(?is)<action>(.*?)</action>", response or "")
    return [a for a in (parse_action(line) for line in (m.group(1).splitlines() if m else [])) if a]


def typed(value: str) -> str:
    return value if "^^" in value else f"{value}^^http://www.w3.org/2001/XMLSchema#{'float' if '.' in value else 'integer'}"


class Builder:
    """Function list of an action sequence, with the rules for numbering expressions.

    Find_relation on an entity starts a new expression, on expression N it overwrites N; Merge writes to the expression before
    the current one and makes it current; Compare starts a new one; Time_constraint and Count overwrite the current one; Order
    overwrites N, or starts a new one for a class. Invalid actions are skipped.
    """

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current = self.highest = 0

    @staticmethod
    def _name(i: int) -> str:
        return f"expression{i or ''}"

    def _new(self) -> int:
        self.highest += 1
        self.current = self.highest
        return self.current

    def add(self, name: str, args: list[str]) -> bool:
        ref = [re.fullmatch(r"expression(\d*)", a) for a in args]
        if name == "Find_relation":
            target, rel = args
            rel = rel if rel.startswith("(R ") else f"(R {rel[2:].strip()})" if rel.startswith("R ") else rel
            if ref[0]:
                n = int(ref[0].group(1) or 0)
                if not 0 < n <= self.highest:
                    return False
                self.current = n
            else:
                n = self._new()
                self.lines.append(f"{self._name(n)} = START('{target}')")
            self.lines.append(f"{self._name(n)} = JOIN('{rel}', {self._name(n)})")
        elif name == "Merge":
            if self.current < 1:
                return False
            into = max(1, self.current - 1)
            shown = [a if r else f"'{a}'" for a, r in zip(args, ref)]
            self.lines.append(f"{self._name(into)} = AND({shown[0]}, {shown[1]})")
            self.current = into
        elif name == "Compare":
            mode = COMPARISONS.get(mode_key(args[0]))
            if not mode:
                return False
            n = self._new()
            self.lines += [f"{self._name(n)} = START('{typed(args[2])}')", f"{self._name(n)} = CMP('{mode}', '{args[1]}', {self._name(n)})"]
        elif name == "Order":
            mode = ORDERS.get(mode_key(args[0]))
            if not mode:
                return False
            if ref[1]:
                n = int(ref[1].group(1) or 0)
                if not 0 < n <= self.highest:
                    return False
                self.current = n
                operand = self._name(n)
            else:
                n, operand = self._new(), f"'{args[1]}'"
            self.lines.append(f"{self._name(n)} = ARG('{mode}', {operand}, '{args[2]}')")
        elif name in ("Time_constraint", "Count"):
            if self.current < 1:
                return False
            me = self._name(self.current)
            self.lines.append(f"{me} = TC({me}, '{args[0]}', '{args[1]}')" if name == "Time_constraint" else f"{me} = COUNT({me})")
        else:
            return False
        return True

    def finished(self) -> list[str]:
        return [*self.lines, f"{self._name(self.current)} = STOP({self._name(self.current)})"] if self.lines else []


def build(actions: list[tuple[str, list[str], int]]) -> list[str]:
    b = Builder()
    for name, args, _ in actions:
        b.add(name, args)
    return b.finished()


_TRIPLE = re.compile(r"(\?\w+|ns:\S+)\s+ns:(\S+)\s+(\?\w+|ns:\S+)\s*\.?")


def from_sparql(query: str | None) -> str:
    """S-expression of a SELECT with one substantive triple pattern, a comparison or an ordering; "null" for other shapes."""
    m = re.search(r"(?is)select\s+(?:distinct\s+)?\?x\b.*?where\s*\{(.*)\}(.*)$", query or "")
    if not m:
        return "null"
    body, tail = re.sub(r"(?i)filter\s*\([^()]*(?:\([^()]*\)[^()]*)*\)|optional\s*\{[^{}]*\}", " ", m.group(1)), m.group(2)
    found = _TRIPLE.findall(body)
    if not found:
        return "null"
    s, rel, o = found[0]
    compare = re.search(r"filter\s*\(\s*(?:xsd:\w+\()?(\?\w+)\)?\s*(<=|>=|<|>)\s*([^)\s]+)", m.group(1), re.IGNORECASE)
    order = re.search(r"order\s+by\s+(desc\s*\()?\s*\(?(\?\w+)", tail, re.IGNORECASE)
    if compare and compare.group(1) == o:
        return f"({COMPARISONS[compare.group(2)]} {rel} {compare.group(3)})"
    if order and order.group(2) == o:
        kind = next((x[3:] for a, r, x in found if a == "?x" and r == "type.object.type" and x.startswith("ns:")), None)
        return f"({'ARGMAX' if order.group(1) else 'ARGMIN'} {kind} {rel})" if kind else "null"
    if s == "?x" and o.startswith("ns:"):
        return f"(JOIN {rel} {o[3:]})"
    if o == "?x" and s.startswith("ns:"):
        return f"(JOIN (R {rel}) {s[3:]})"
    return "null"
