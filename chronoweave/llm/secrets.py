"""Secret scan by assignment-aware lexing.

Three base patterns (assign, access, hex) are matched on the whole text. Besides, source and configuration syntax is
read into name-literal pairs (`name = "x"`, `"name": "x"`, `export NAME=x`, `name := 'x' + "y"`), constants are
propagated through plain names and concatenations, and a literal that reaches a sensitive name is a `lexed` span.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import bounded_batches, fresh_name, query, table, whole_text

KINDS = ("assign", "access", "hex", "lexed")
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))
MIN_SCORE = 0.5

_ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run holds no longer match further on
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPERATOR = re.compile(r"[:=]")
_TARGET = re.compile(r"(?<![A-Za-z0-9_.\-])([A-Za-z_][A-Za-z0-9_.\-]*+)(?:[\"'`]\]?)?[ \t]*+(?::=|=>|=(?![=~>])|:(?!//))[ \t]*+")
_OPERAND = re.compile(r"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s,;\"'`{}()\[\]<>+]++)")
#: Type and equals sign behind `name:`. Every repetition is bounded and possessive, so long lines stay linear.
_INSIDE = r"[^\[\]<>=\n]{0,200}+"
_GENERIC = rf"[\[<]{_INSIDE}(?:[\[<]{_INSIDE}(?:[\[<]{_INSIDE}[\]>]{_INSIDE}){{0,8}}+[\]>]{_INSIDE}){{0,8}}+[\]>]"
_TYPE = rf"(?:[&*]|'[a-z]+[ \t]+|mut[ \t]+|dyn[ \t]+){{0,8}}+(?:[A-Za-z_][A-Za-z0-9_.:]{{0,200}}+(?:{_GENERIC})?+|{_GENERIC}|\"[^\"=\n]{{1,200}}+\"|'[^'=\n]{{1,200}}+')[?!]?+(?:\[\]){{0,8}}+"
_ANNOTATION = re.compile(rf"{_TYPE}(?:[ \t]*+[|&][ \t]*+{_TYPE}){{0,20}}+[ \t]*+=(?![=~>])[ \t]*+")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`A-Za-z_])")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)(?:your|my|example|sample|dummy|test|change|placeholder|xxx|todo|none|null|true|false|env|process|os\.|\$|%|<|\*{3})")
#: Weight of a word, or of two neighbouring words, in a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api key": 1.0, "private key": 1.0,
    "access key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "auth key": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.9, "authorization": 0.8, "auth": 0.6, "connection string": 0.8, "pin": 0.5, "salt": 0.5, "session": 0.5,
}


def name_weight(name: str) -> float:
    parts = [w.lower() for w in _WORD.findall(name)]
    pairs = [f"{x} {y}" for x, y in zip(parts, parts[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in parts + pairs), default=0.0)


def literal_weight(text: str) -> float:
    """How much a literal looks like a drawn secret: length, characters in use, bits per character; 0 for placeholders."""
    return counted_weight(Counter(text), text[:64])


def counted_weight(counts: Counter, beginning: str) -> float:
    """The same from character counts and the beginning of the literal."""
    n = counts.total()
    if n < 8 or _PLACEHOLDER.match(beginning) or any(c.isspace() for c in counts):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = sum((any(c.isdigit() for c in counts), any(c.islower() for c in counts), any(c.isupper() for c in counts), any(not c.isalnum() for c in counts)))
    return min(1.0, 0.25 * min(n, 16) / 16 + 0.5 * min(bits, 3.5) / 3.5 + 0.125 * min(kinds, 2)) * (0.5 if kinds == 1 else 1.0)


def assignments(text: str) -> list[tuple[str, list[tuple[str, int, int, bool]], bool, bool]]:
    """(name, operands, typed, colon) for each assignment; an operand is (text, start, end, quoted).

    `name: type = literal` is one pair of name and literal. The type is kept as an assigned name too, as in `run: NAME=x`,
    but `typed`: a later `other: type` is then no reference to it.
    """
    found, notes_end = [], 0
    for m in _TARGET.finditer(text):
        at, typed = m.end(), m.start(1) < notes_end
        colon = text[m.start() : at].rstrip().endswith(":")
        if colon and (note := _ANNOTATION.match(text, at)):
            notes_end = note.end()
            if behind := _operands(text, notes_end):
                found.append((m[1], behind, False, False))
                # what may be a value with = in it stays a value
                plain = _OPERAND.match(text, at)
                if plain and "=" not in plain[0]:
                    continue
        if operands := _operands(text, at):
            found.append((m[1], operands, typed, colon))
    return found


def _operands(text: str, at: int) -> list[tuple[str, int, int, bool]]:
    operands = []
    while piece := _OPERAND.match(text, at):
        group = piece.lastindex
        operands.append((piece[group], piece.start(group), piece.end(group), group < 4))
        at = piece.end()
        more = _PLUS.match(text, at)
        if not more:
            break
        at = more.end()
    return operands


def lexed(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals that reach a sensitive name, directly or through other names.

    A name stands for the union of its definitions: each is scored by itself, and in a concatenation the latest earlier
    one counts (the first one, if none is earlier). So the order of lines does not matter. A literal goes to the target that
    gives it the highest score.
    """
    pairs = assignments(text)
    defined: dict[str, list[int]] = {}
    types = {name for name, _, typed, _ in pairs if typed}
    for i, (name, *_) in enumerate(pairs):
        defined.setdefault(name, []).append(i)

    # per pair: literal spans, names referred to
    literals, names = [], []
    for _, operands, _, colon in pairs:
        refers = [not o[3] and o[0] in defined for o in operands]
        literals.append([o[1:3] for o, r in zip(operands, refers) if not r])
        names.append([o[0] for o, r in zip(operands, refers) if r and not (colon and o[0] in types)])

    following = [sorted({defined[n][max(0, bisect_left(defined[n], j) - 1)] for n in refers} - {j}) for j, refers in enumerate(names)]
    weights = _Reached(text, literals, following)

    # each look: a sensitive target and a pair it reaches by names, with the score of that pair's literals under the target
    looks: list[tuple[float, int, str, int]] = []
    used: set[str] = set()
    targets = sorted(((name_weight(name), i) for i, (name, *_) in enumerate(pairs)), key=lambda x: (-x[0], x[1]))
    for weight, i in targets:
        if weight <= 0:
            break
        # the pair, then every definition of the names behind it; a name met before has had at least this weight
        todo, target = [i], pairs[i][0]
        while todo:
            j = todo.pop()
            score = weight * weights.of(j)
            if score >= MIN_SCORE:
                looks.append((-score, len(looks), target, j))
            for name in names[j]:
                if name not in used:
                    used.add(name)
                    todo += defined[name]

    # best looks first: what they reach needs no other look, so every pair is walked once
    best: dict[tuple[int, int], tuple[str, float]] = {}
    walked: set[int] = set()
    for score, _, target, i in sorted(looks):
        todo = [i]
        while todo:
            j = todo.pop()
            if j in walked:
                continue
            walked.add(j)
            for span in literals[j]:
                if span[1] > span[0]:
                    best.setdefault(span, (target, -score))
            todo += following[j]
    return [(s, e, n, round(w, 6)) for (s, e), (n, w) in sorted(best.items())]


class _Reached:
    """How much the literals that each pair reaches look like a secret, taken together in the order of the text.

    A pair that only names another one shares its result. One with literals of its own behind which one other pair stands
    adds them to that pair's character counts, so chains of names take linear time. Where several pairs stand behind one,
    or a span is read in two pairs, the pairs behind are walked.
    """

    HEAD = 16  # characters, as many as a placeholder's beginning has at most

    def __init__(self, text: str, literals: list[list[tuple[int, int]]], following: list[list[int]]):
        self.text, self.literals, self.following = text, literals, following
        times = Counter(span for spans in literals for span in set(spans))
        self.apart = [all(times[span] == 1 for span in spans) and len(set(spans)) == len(spans) for spans in literals]
        self.known: dict[int, float] = {}
        self.counts: dict[int, tuple[Counter, list[tuple[int, int]]]] = {}  # of chains: characters, first spans
        self.inside: dict[int, set[int] | None] = {}  # pairs that a walk from the end of the chain has met

    def of(self, i: int) -> float:
        path, seen = [], set()
        while i not in self.known and i not in seen and len(self.following[i]) == 1 and self.apart[i]:
            path.append(i)
            seen.add(i)
            i = self.following[i][0]
        if i not in self.known:
            self._walk(i)
        if i in seen:  # names in a circle: all of them reach the same
            first = path.index(i)
            for j in path[first + 1 :]:
                self.known[j], self.counts[j], self.inside[j] = self.known[i], self.counts[i], self.inside[i]
            path = path[:first]
        for j in reversed(path):
            self._add(j, i)
            i = j
        return self.known[i]

    def _walk(self, i: int) -> None:
        met, todo = {i}, [i]
        while todo:
            for k in self.following[todo.pop()]:
                if k not in met:
                    met.add(k)
                    todo.append(k)
        spans = sorted({span for j in met for span in self.literals[j]})
        whole = "".join(self.text[s:e] for s, e in spans)
        self.known[i] = literal_weight(whole)
        self.counts[i] = Counter(whole), self._head(spans)
        self.inside[i] = met if len(met) > 1 else None

    def _add(self, i: int, behind: int) -> None:
        met = self.inside[behind]
        counts, head = self.counts[behind]
        if self.literals[i] and not (met and i in met):
            counts = counts + Counter("".join(self.text[s:e] for s, e in self.literals[i]))
            head = self._head(sorted([*head, *self.literals[i]]))
            self.known[i] = counted_weight(counts, "".join(self.text[s:e] for s, e in head))
        else:
            self.known[i] = self.known[behind]
        self.counts[i], self.inside[i] = (counts, head), met

    def _head(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        length = 0
        for n, (s, e) in enumerate(spans, 1):
            length += e - s
            if length >= self.HEAD:
                return spans[:n]
        return spans


def spans_of(text: str) -> list[dict]:
    """All spans by start, then in the order of KINDS."""
    found = [("access", m.start(), m.end(), None, 1.0) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", m.start(), m.end(), None, 1.0) for m in _HEX.finditer(text)]
    if _OPERATOR.search(text):
        found += [("assign", m.start(), m.end(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [("lexed", s, e, name, score) for s, e, name, score in lexed(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [dict(zip(("kind", "start", "end", "name", "score"), x)) for x in found]


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([spans_of(t) if t else [] for t in texts])


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series, mask: pd.Series) -> pd.Series:
    out = []
    for text, found, word in zip(texts, spans, mask):
        parts, at = [], 0
        for s in sorted(found, key=lambda x: (x["start"], -x["end"])) if found is not None else ():
            if s["end"] <= at:
                continue
            parts += [text[at : s["start"]], word] if s["start"] >= at else []
            at = s["end"]
        out.append("".join(parts) + text[at:] if parts else text)
    return pd.Series(out)


def find_secrets(df: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """`df` with `into`: array of (kind, start, end, name, score), code points, end exclusive.

    A null text counts as empty and an empty one has no spans. Texts are read whole, one row at a time, in time linear in
    the text as long as names stand in chains or circles of their own (sums of several shared names are walked); repeated rows give repeated results. A column already named `into` is replaced; other columns pass through.
    """
    bounded_batches(df.sparkSession)
    return df.withColumn(into, _spans.asNondeterministic()(whole_text(text)))


def mask_secrets(df: DataFrame, text: str = "text", mask: str = "<secret>") -> DataFrame:
    """`df` with each span (overlapping ones as one) replaced by `mask`; a null text stays null."""
    given, spans = fresh_name(df, "given"), fresh_name(df, "spans")
    found = find_secrets(df.withColumn(given, F.col(text)), text, spans)
    hit = F.size(spans) > 0
    done = F.when(hit, _masked(F.when(hit, F.col(given)), F.when(hit, F.col(spans)), F.lit(mask)))
    return found.withColumn(text, F.coalesce(done, F.col(given))).drop(given, spans)


def digest_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of `kinds`, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query()
def op1_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest_text(F.col("found"), KINDS[:3]), 256).alias("base_sha256"),
        digest_text(F.col("found"), KINDS).alias("spans"), n("lexed"),
    )
