"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base findings.  Beyond them a text is first lexed
into strings, comments and code.  The assignments of source and configuration
syntax - ``name = "..."``, ``"name": "..."``, ``name: str = "a" + b``,
triple-quoted and YAML block values, lists, ``NAME=value`` lines, ``--name
value``, ``<name>value</name>``, ``("name", "value")`` and ``#define name
"value"`` - become pairs of a name and a literal.  Assignments in code also make
constants: a name used as a value stands for its last assignment before, or
where there is none for its first one after, and so on until only literals are
left.  Those inside strings and comments are read too, as leaks stand there as
well, but neither make nor use constants.  A literal is scored by the most
sensitive name that it reaches and by its own make-up; a private key in PEM is a
secret under any name.  A literal scored at least ``THRESHOLD`` is reported
where it stands, even if the sensitive name is assigned far from it.

All patterns are linear and without bounds on lengths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import column_of, extended
from .runtime import ship

#: In the order that breaks ties between findings with one start.
KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 1.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)

_OPERATOR = re.compile(r"(?<![=!<>:+*/%&|^~-])(?::=|=>|[:=])(?![=:])", re.ASCII)
#: For a text read backwards from an operator: a target, and a target with its type.
_TARGET = re.compile(r"""\n?[ \t]*+\]?+(["'`]?+)([\w$.-]++)""", re.ASCII)
_TYPED = re.compile(r"""\n?[ \t]*+[\w.\[\]<>]*+(?<=[A-Za-z_])[ \t]*+:[ \t]*+([\w$.-]++)""", re.ASCII)
_FIRST = re.compile(r"[A-Za-z_$]", re.ASCII)
_QUOTED = re.compile(r'''[rbuf]{0,2}(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`((?:[^`\\]++|\\.)*+)`)''', re.ASCII)
_TRIPLE = re.compile(r"[rbuf]{0,2}(?:\"{3}((?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+)\"{3}|'{3}((?:[^'\\]++|\\[\s\S]|'(?!''))*+)'{3})", re.ASCII)
_BLOCK = re.compile(r"(?:[!&]\S*+[ \t]++)*+[|>][+-]?[1-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\r?(?:\n|$)", re.ASCII)
_KEY_INDENT = re.compile(r"\x20*+(?:-\x20++)*+", re.ASCII)
_PEM_HEADER = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----", re.ASCII)
_PEM = re.compile(r"""["']?(-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----(?:[^-]++|-(?!----))*+-----END [A-Z0-9 ]*+-----)""", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w$.]*+", re.ASCII)
_BARE = re.compile(r"""[^\s#;,"'`{}()\[\]<>]*+""")
_BARE_END = re.compile(r"[ \t]*+(?:[#;,\r\n]|$)")
_JOIN = re.compile(r"[ \t]*+\\?\r?\n?[ \t]*+[+.][ \t]*+\\?\r?\n?[ \t]*+(?=[\"'`A-Za-z_$])", re.ASCII)
_FLAG = re.compile(r"""(?<!\S)--?([A-Za-z][\w-]{2,}+)[ \t]++(?:"([^"\n]{6,}+)"|'([^'\n]{6,}+)'|([^\s"'-][^\s"']{5,}+))(?!\S)""", re.ASCII)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>]{6,}+)</\1>", re.ASCII)
_PAIR = re.compile(r"""(["'])([A-Za-z_][\w.-]{2,}+)\1[ \t]*+,[ \t]*+(["'])([^"'\n]{6,}+)\3""", re.ASCII)

_DEFINE = re.compile(r"""(?m)^[ \t]*+#[ \t]*+define[ \t]++([A-Za-z_]\w*+)[ \t]++["']([^"'\n]{6,}+)["']""", re.ASCII)
_LIST = re.compile(r"\[\s*+(?=[\"'])")
_LIST_NEXT = re.compile(r"\s*+,\s*+(?=[\"'])")
_ITEM = re.compile(r"[ \t]*+(?:#[^\n]*+)?\r?\n([ \t]*+)-[ \t]++")
#: Strings and comments; a quote right after a letter or digit opens nothing, unless as r"" or the like.
_LEX = re.compile(
    r"""(?<!\w)[rbuf]{0,2}(?:\"{3}(?:[^"\\]++|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]++|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')"""
    r"""|(?<![`\w])`(?!`)(?:[^`\\]++|\\.)*+`|(?<![^\s])\#[^\n]*+|(?<![:\w"'])//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|<!--(?:[^-]++|-(?!->))*+-->""",
    re.ASCII,
)
#: What every name that counts has in it; without one no literal scores, but for private keys.
_STEMS = "pass|pwd|secret|token|key|credential|bearer|conn|auth|pin|salt|signature|session|cookie|dsn|cert"

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)
_STRONG = re.compile(r"(?:^|_)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|(?:access|private|secret|signing|encryption|master|auth|account)_key|credential|bearer|conn(?:ection)?_str(?:ing)?)s?(?:_|$)", re.ASCII)
_WEAK = re.compile(r"(?:^|_)(?:key|auth|authorization|pin|salt|signature|session|cookie|dsn|cert)(?:_|$)", re.ASCII)
_HARMLESS = re.compile(r"(?:^|_)public_|_(?:id|name|file|path|url|uri|type|length|size|count|field|header|label|hint|policy|regex|ttl|expiry|version)$", re.ASCII)
_ENDS = r"<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$\(.*\)|x+|\*+|\.+|-+|0+|(?:your|my|the|an?)[_ -].*"
_WORD = r"example|changeme|change_me|placeholder|redacted|dummy|sample|todo|fixme"
_PLACEHOLDER = re.compile(rf"^(?:{_ENDS}|.*(?:{_WORD}).*|none|null|undefined|true|false)$", re.ASCII | re.IGNORECASE)
_PLACEHOLDER_ENDS = re.compile(rf"^(?:{_ENDS})$", re.ASCII | re.IGNORECASE)
_PLACEHOLDER_WORD = re.compile(_WORD, re.ASCII | re.IGNORECASE)
#: Characters that a make keeps of each end; more than a placeholder's word or a PEM header has.
_EDGE = 64
#: Characters up to which a make counts one by one.
_MOST = 1 << 40
#: A header, an end line and a key: those of the shortest kind, Ed25519, have 119 characters.
_KEY_LENGTH = 80


def name_weight(name: str) -> float:
    """How sensitive a target name is: 1, 0.5 or 0."""
    plain = "_".join(w.lower() for w in _WORDS.findall(name))
    if _HARMLESS.search(plain):
        return 0.0
    return 1.0 if _STRONG.search(plain) else 0.5 if _WEAK.search(plain) else 0.0


class Make:
    """What a weight depends on: length, counts of characters, both ends, and whether a placeholder's word or a PEM header stands inside.

    Makes of neighbouring texts add up to that of the whole, so texts that share parts are read once.
    """

    __slots__ = ("n", "counts", "head", "tail", "word", "pem")

    def __init__(self, text: str = ""):
        self.n, self.counts, self.head, self.tail = len(text), Counter(text), text[:_EDGE], text[-_EDGE:]
        self.word, self.pem = bool(_PLACEHOLDER_WORD.search(text)), bool(_PEM_HEADER.search(text))

    def add(self, other: Make) -> None:
        """Becomes the make of its text followed by another's."""
        between = self.tail + other.head
        self.word = self.word or other.word or bool(_PLACEHOLDER_WORD.search(between))
        self.pem = self.pem or other.pem or bool(_PEM_HEADER.search(between))
        self.head = (self.head + other.head if self.n < _EDGE else self.head)[:_EDGE]
        self.tail = (self.tail + other.tail if other.n < _EDGE else other.tail)[-_EDGE:]
        self.n += other.n
        for c, k in other.counts.items():
            self.counts[c] += k
        if self.n > _MOST:  # constants that double themselves; shares are all that counts then
            share = _MOST / self.n
            self.n, self.counts = _MOST, Counter({c: k * share for c, k in self.counts.items()})

    @staticmethod
    def joined(makes: Sequence[Make]) -> Make:
        if len(makes) == 1:
            return makes[0]
        out = Make()
        for m in makes:
            out.add(m)
        return out

    def is_placeholder(self) -> bool:
        """Whether _PLACEHOLDER matches; a word inside a long text without blanks, as keys have by chance, doesn't count."""
        if self.n <= _EDGE:
            return bool(_PLACEHOLDER.match(self.head))
        if self.word and (self.n <= 256 or self.has_space() and not self.pem) and self.counts["\n"] == self.tail.endswith("\n"):
            return True
        # one character stands for all between the ends
        inside = "\n" if self.counts["\n"] > self.tail.endswith("\n") else "" if self.counts.keys() <= {"x", "X"} or len(self.counts) == 1 else "\x01"
        return bool(_PLACEHOLDER_ENDS.match(self.head + inside + self.tail))

    def has_space(self) -> bool:
        return any(c.isspace() for c in self.counts)

    def weight(self, strong: bool = False) -> float:
        """-1 to 1; blanks tell less against a literal under a strong name, which may bear a passphrase."""
        if self.n < 6 or self.is_placeholder():
            return -1.0
        n = self.n
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c)
        weight = 0.5 if entropy >= 3 else 0.25 if entropy >= 2.5 else 0.0
        weight += 0.25 * (any(c.isdigit() for c in self.counts) and any(c.isalpha() for c in self.counts)) + 0.25 * (n >= 16)
        return weight - (0.25 if strong else 0.75) * self.has_space() - 0.5 * self.head.startswith(("http://", "https://", "/", "./"))

    def score(self, weight: float) -> float:
        """The score under a name of a weight; a PEM header with a key after it is a full secret under any."""
        if self.pem and self.n >= _KEY_LENGTH and not self.is_placeholder():
            return 2.0
        return weight + self.weight(weight >= 1)


def literal_weight(value: str, strong: bool = False) -> float:
    """How much a literal looks like a secret, -1 to 1, under a strong name or another."""
    return Make(value).weight(strong)


def _makes(text: str, spans: set[tuple[int, int]]) -> dict[tuple[int, int], Make]:
    """The make of each stretch; of those that end at one place the longer adds to the shorter."""
    out: dict[tuple[int, int], Make] = {}
    last = None
    for end, start in sorted(((b, a) for a, b in spans), key=lambda x: (x[0], -x[1])):
        if last and last[1] == end:
            out[start, end] = Make.joined([Make(text[start : last[0]]), out[last]])
        else:
            out[start, end] = Make(text[start:end])
        last = start, end
    return out


def _base(text: str) -> list[tuple]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m.start(2), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), "", 1.0) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end(), m.start(), "", 1.0) for m in _HEX.finditer(text)]


def _bare(text: str, at: int) -> tuple[int, int, int]:
    """Begin and end of a run of bare characters, and its last digit (-1 if none, or if no value may end there)."""
    end = _BARE.match(text, at).end()
    digits = (i for i in range(end - 1, at - 1, -1) if text[i].isdigit())
    return at, end, next(digits, -1) if _BARE_END.match(text, end) else -1


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A stretch without the blanks around it."""
    while end > start and text[end - 1].isspace():
        end -= 1
    while start < end and text[start].isspace():
        start += 1
    return start, end


def _block(text: str, key: int, at: int) -> tuple[int, int]:
    """Begin and end of the lines from a place on that are indented more than a key that ends before them."""
    line = text.rfind("\n", 0, key) + 1
    indent = _KEY_INDENT.match(text, line).end() - line
    begin = end = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        own = len(text[at:stop]) - len(text[at:stop].lstrip(" "))
        if text[at:stop].strip():
            if own <= indent:
                break
            end = stop
        at = stop + 1
    return _trimmed(text, begin, end)


def _target(text: str, back: str, op: re.Match) -> str | None:
    """The name before an operator; back: the text backwards."""
    at = len(text) - op.start()
    if op[0] == "=" and (m := _TYPED.match(back, at)):
        name = m[1][::-1]
        if f := _FIRST.search(name):  # name: type = value, unless "type" is the more telling name
            name, own = name[f.start() :], _TARGET.match(back, at)
            kind = own[2][::-1] if own else ""
            return kind if name_weight(kind) > name_weight(name) else name
    if not (m := _TARGET.match(back, at)):
        return None
    name = m[2][::-1]
    f = _FIRST.search(name)
    if f and m[1]:  # a quoted name is whole
        return name if f.start() == 0 and back.startswith(m[1], m.end()) else None
    return name[f.start() :] if f else None


def _regions(text: str) -> tuple[list[int], list[int]]:
    """Begins and ends of strings and comments, in order."""
    begin, end = [], []
    for m in _LEX.finditer(text):
        begin.append(m.start())
        end.append(m.end())
    return begin, end


#: A part of a value: the place of a literal, the number of another value, or a name with the literal that it is if nothing defines it.
Part = tuple[int, int] | int | tuple[str, tuple[int, int] | None]


def _values(text: str) -> list[tuple[str, list[Part]]]:
    """(target name, what its value is made of) in the order of the text; all names are resolved to numbers of values."""
    out: list[tuple[str, list[Part]]] = []
    constants: dict[str, int] = {}
    first_of: dict[str, int | None] = {}  # the first assignment of each name, None if that is no constant
    back = text[::-1]
    begins, ends = _regions(text)
    region = 0
    bare = (0, 0, -1)  # begin, end and last digit of the run of bare characters met last, read once for all places in it
    for op in _OPERATOR.finditer(text):
        at = op.end()
        if text.startswith("//", at):
            continue
        while region < len(begins) and ends[region] <= op.start():
            region += 1
        code = region == len(begins) or op.start() < begins[region]
        if not (name := _target(text, back, op)):
            continue
        while at < len(text) and text[at] in " \t":
            at += 1
        if m := _LIST.match(text, at):
            out += [(name, [p]) for p in _listed(text, m.end())]
            continue
        parts: list[Part] = []
        whole = True
        while True:
            if q := _TRIPLE.match(text, at):
                parts.append(_trimmed(text, *q.span(q.lastindex)))
                at = q.end()
            elif q := _QUOTED.match(text, at):
                parts.append(q.span(q.lastindex))
                at = q.end()
            elif code and (i := _NAME.match(text, at)) and i[0] in constants:
                parts.append(constants[i[0]])
                at = i.end()
            else:
                if not parts:
                    if p := _PEM.match(text, at):
                        parts.append(p.span(1))
                        break
                    if op[0] == ":" and (k := _BLOCK.match(text, at)):
                        parts.append(_block(text, op.start(), k.end()))
                        break
                    if op[0] == ":" and (items := _items(text, op.start(), at)):
                        out += [(name, [p]) for p in items]
                        whole = False
                        break
                    if not bare[0] <= at < bare[1]:
                        bare = _bare(text, at)
                    plain = (at, bare[1]) if bare[2] >= at and bare[1] - at >= 6 else None
                    if code and i and i[0] not in first_of and (_BARE_END.match(text, i.end()) or _JOIN.match(text, i.end())):
                        parts.append((i[0], plain if plain and i.end() == plain[1] else None))
                        at = i.end()
                        if j := _JOIN.match(text, at):
                            at = j.end()
                            continue
                        break
                    if plain:
                        parts.append(plain)
                        break
                elif code and i and i[0] not in first_of and not text.startswith(("(", "["), i.end()):
                    parts.append((i[0], None))
                    at = i.end()
                    if j := _JOIN.match(text, at):
                        at = j.end()
                        continue
                    break
                whole = False
                break
            if not (j := _JOIN.match(text, at)):
                break
            at = j.end()
        if parts:
            out.append((name, parts))
        if not code:
            continue
        if whole and parts:
            constants[name] = len(out) - 1
        else:
            constants.pop(name, None)
        first_of.setdefault(name, constants.get(name))
    for i, (_, parts) in enumerate(out):
        for k, p in enumerate(parts):
            if isinstance(p, tuple) and isinstance(p[0], str):  # a name without an assignment before it
                later = first_of.get(p[0])
                parts[k] = p[1] if later is None or later == i else later
        parts[:] = [p for p in parts if p is not None]
    for pattern, name in ((_FLAG, 1), (_ELEMENT, 1), (_PAIR, 2), (_DEFINE, 1)):
        out += [(m[name], [_trimmed(text, *m.span(m.lastindex))]) for m in pattern.finditer(text)]
    return out


def _listed(text: str, at: int) -> list[tuple[int, int]]:
    """The quoted strings of a list in brackets."""
    out = []
    while q := _QUOTED.match(text, at):
        out.append(q.span(q.lastindex))
        if not (j := _LIST_NEXT.match(text, q.end())):
            break
        at = j.end()
    return out


def _items(text: str, key: int, at: int) -> list[tuple[int, int]]:
    """The plain and quoted items of a YAML list that begins on the line after its key."""
    line = text.rfind("\n", 0, key) + 1
    indent = _KEY_INDENT.match(text, line).end() - line
    out = []
    while (m := _ITEM.match(text, at)) and len(m[1]) >= indent:
        at = m.end()
        if q := _QUOTED.match(text, at):
            span, at = q.span(q.lastindex), q.end()
        else:
            span = at, _BARE.match(text, at).end()
            at = span[1]
        if not _BARE_END.match(text, at):  # an item of more than a value
            break
        out.append(span)
    return out


def _order(values: list[tuple[str, list[Part]]]) -> list[int]:
    """Numbers of all values, those that a value is made of before it; a value that would be made of itself loses that part."""
    state, out = bytearray(len(values)), []
    for i in range(len(values)):
        stack = [(i, 0)]
        while stack:
            k, at = stack.pop()
            parts = values[k][1]
            if at == 0:
                if state[k]:
                    continue
                state[k] = 1
            while at < len(parts):
                p = parts[at]
                if isinstance(p, int):
                    if state[p] == 1:
                        del parts[at]
                        continue
                    if not state[p]:
                        stack += [(k, at + 1), (p, 0)]
                        break
                at += 1
            else:
                state[k] = 2
                out.append(k)
    return out


def _literals(text: str) -> dict[tuple[int, int], tuple[float, str]]:
    """Score and name of each literal that reaches a name under which it is a secret."""
    values = _values(text)
    order = _order(values)
    pem = "-----BEGIN" in text and "PRIVATE KEY" in text
    weights = [name_weight(name) for name, _ in values]
    uses = [int(pem or w > 0) for w in weights]
    for i in reversed(order):
        if uses[i]:
            for p in values[i][1]:
                if isinstance(p, int):
                    uses[p] += 1
    makes = _makes(text, {p for (_, parts), n in zip(values, uses, strict=True) if n for p in parts if not isinstance(p, int)})
    known: dict[int, Make] = {}
    reached: dict[int, tuple[float, str]] = {}
    for i in order:
        name, parts = values[i]
        if not uses[i]:
            continue
        known[i] = Make.joined([known[p] if isinstance(p, int) else makes[p] for p in parts])
        if weights[i] or pem:
            uses[i] -= 1
            if (score := known[i].score(weights[i])) >= THRESHOLD:
                reached[i] = score, name
        for p in [i, *parts]:  # lets go of makes that no later value needs
            if isinstance(p, int):
                uses[p] -= p != i
                if not uses[p]:
                    known.pop(p, None)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for i in reversed(order):
        if i in reached:
            for p in values[i][1]:
                if isinstance(p, int):
                    reached[p] = max(reached.get(p, (0.0, "")), reached[i])
                elif p[1] > p[0]:
                    best[p] = max(best.get(p, (0.0, "")), reached[i])
    return best


def findings(text: str | None) -> list[tuple[str, int, int, int, str, float]]:
    """(kind, start, end, start of the secret itself, name, score) by start, then kind; places count code points."""
    if not text:
        return []
    found = _base(text)
    if _NAMED.search(text):
        found += [("literal", a, b, a, name, score) for (a, b), (score, name) in _literals(text).items()]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


_NAMED = re.compile(_STEMS + "|PRIVATE KEY", re.IGNORECASE | re.ASCII)


def _to_read(column: pa.Array) -> list[int]:
    """Rows whose text may hold a finding, told by Arrow: only they become Python strings."""
    column = column.cast(pa.large_string())
    named = pc.and_(pc.match_substring_regex(column, rf"(?i:{_STEMS})|PRIVATE KEY"), pc.match_substring_regex(column, r"[=:,#<]|-[A-Za-z]"))
    other = pc.match_substring_regex(column, r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    return np.flatnonzero(pc.fill_null(pc.or_(named, other), False).to_numpy(zero_copy_only=False)).tolist()


_FINDING = T.StructType([T.StructField(n, k) for n, k in (("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("secret_start", T.IntegerType()), ("name", T.StringType()), ("score", T.DoubleType()))])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))


def secrets(docs: DataFrame, text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """Adds column secrets: array of (kind, start, end, secret_start, name, score), by start, then kind.

    One narrow pass over whole texts.  Null and empty texts have no findings.
    A column of docs named secrets is replaced, those in drop are left out.
    """

    def make():
        names = _FINDING.names

        def run(batch):
            column = column_of(batch, text)
            out: list[list[dict]] = [[]] * len(column)
            for i in _to_read(column):
                out[i] = [dict(zip(names, f, strict=True)) for f in findings(column[i].as_py())]
            return [pa.array(out, _ARROW)]

        return run

    return extended(docs, [T.StructField("secrets", T.ArrayType(_FINDING))], make, drop)


def redacted(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by a mark; n_chars, if there, follows.

    Overlapping secrets become one mark; a null text stays null.  Other columns
    may bear any names; an empty table gives one.
    """
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text)
    like = docs.schema
    n_chars = next((i for i, f in enumerate(like) if f.name == "n_chars"), None)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            out: dict[int, str] = {}
            for i in _to_read(column):
                value = column[i].as_py()
                done, end = [], 0
                for a, b in sorted((f[3], f[2]) for f in findings(value)):
                    if b <= end:
                        continue
                    if a >= end:
                        done += [value[end:a], mark] if a > end or not done else []
                    end = b
                if done:
                    out[i] = "".join([*done, value[end:]])
            columns = list(batch.columns)
            if out:
                columns[at] = _replaced(column, out)
                if n_chars is not None:
                    old = columns[n_chars]
                    columns[n_chars] = _replaced(old, {i: len(t) for i, t in out.items() if old[i].is_valid})
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, like)


def _replaced(column: pa.Array, new: dict[int, object]) -> pa.Array:
    """The column with some of its values replaced."""
    mask = np.zeros(len(column), bool)
    rows = sorted(new)
    mask[rows] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in rows], column.type))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets(docs.select("doc_id", "text"), drop=["text"])

    def spelled(kept):
        return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda f: f["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda f: f["kind"] != "literal")
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))
