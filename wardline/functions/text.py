"""Column expressions that scanners are made of.  All stay within the JVM.

Patterns are written once, in the syntax that Java and RE2 share; :func:`java` makes word boundaries ASCII and
the dot exclude the line feed alone, as in the engines the catalogs come from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import any_bit, phrase_bits

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: White space of Unicode, beyond Java's ASCII class.
SPACE = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Added where a score meets a threshold, since sums of decimal fractions are inexact.
EPSILON = 1e-6


def shared(pattern: str) -> str:
    """A catalog pattern with code points written as Java and RE2 both read them."""
    return re.sub(r"(?<!\\)\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern)


def _group_end(pattern: str, at: int) -> int:
    """Where the group that opens at ``at`` closes; brackets and escapes don't count."""
    depth, inside, i = 0, False, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth == 0:
                return i
        i += 1
    return -1


_CLASS = re.compile(r"\[((?:[0-9A-Za-z_](?:-[0-9A-Za-z_])?)+)\]")


def _first_letters(pattern: str, at: int) -> str:
    """What a class must hold that the first character of what stands at ``at`` is in: word characters alone, else none.

    That is a letter or digit, a class of them, or a group whose alternatives all begin with one.
    """
    if at < len(pattern) and pattern[at].isalnum() and pattern[at].isascii():
        first, end = pattern[at], at
    elif pattern.startswith(r"\d", at):
        first, end = "0-9", at + 1
    elif m := _CLASS.match(pattern, at):
        first, end = m.group(1), m.end() - 1
    elif pattern[at : at + 1] == "(" and (end := _group_end(pattern, at)) >= 0:
        body = pattern[at + 1 : end].removeprefix("?:")
        if "(" in body or body.startswith("?"):
            return ""  # an alternative with an inner group: not worth the parsing
        each = [_first_letters(a, 0) for a in body.split("|")]
        first = "".join(sorted(set(each))) if all(each) else ""
    else:
        return ""
    return "" if pattern[end + 1 : end + 2] in ("?", "*") or pattern[end + 1 : end + 3] in ("{0", "{,") else first


def _literals(tree) -> tuple[str, ...]:
    """Strings of which one at least stands in whatever a parsed pattern matches; the longest that are known, or none."""
    known: list[tuple[str, ...]] = []
    run = ""

    def done():
        nonlocal run
        if run:
            known.append((run,))
        run = ""

    for op, of in tree:
        name = str(op)
        if name == "LITERAL" and 32 < of < 127:
            run += chr(of).lower()
        elif name != "AT":
            done()
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and of[0] >= 1:
                known.append(_literals(of[2]))
            elif name == "SUBPATTERN":
                known.append(_literals(of[3]))
            elif name == "BRANCH":
                each = [_literals(b) for b in of[1]]
                known.append(tuple(dict.fromkeys(x for e in each for x in e)) if all(each) else ())
    done()
    known = [k for k in known if 0 < len(k) <= 24]
    return max(known, key=lambda k: (min(map(len, k)), -len(k)), default=())


@cache
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which any match of a catalog pattern holds one, in whatever case; none if that isn't known."""
    import warnings
    from re import _parser

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return _literals(_parser.parse(pattern))
        except (re.error, OverflowError):
            return ()


def _clauses(tree) -> list[tuple[str, ...]]:
    """Alternatives of strings, of each of which whatever a parsed pattern matches holds one at least."""
    known: list[tuple[str, ...]] = []
    run = ""

    def done():
        nonlocal run
        if len(run) > 2:
            known.append((run,))
        run = ""

    for op, of in tree:
        name = str(op)
        if name == "LITERAL" and 32 < of < 127:
            run += chr(of).lower()
        elif name != "AT":
            done()
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and of[0] >= 1:
                known += _clauses(of[2])
            elif name == "SUBPATTERN":
                known += _clauses(of[3])
            elif name == "BRANCH":
                each = [max(_clauses(b), key=lambda k: (min(map(len, k)), -len(k)), default=()) for b in of[1]]
                if all(each):
                    known.append(tuple(dict.fromkeys(x for e in each for x in e)))
    done()
    return known


@cache
def clauses(pattern: str) -> tuple[tuple[str, ...], ...]:
    """What :func:`required` gives and more: any match of a catalog pattern holds, in whatever case, one string of each tuple."""
    import warnings
    from re import _parser

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            more = _clauses(_parser.parse(pattern))
        except (re.error, OverflowError):
            return ()
    one = required(pattern)
    return tuple(dict.fromkeys([*([one] if one else []), *(c for c in more if all(len(x) > 2 for x in c))]))


_DIGITS = frozenset(range(48, 58))


def _is_digit(op, of) -> bool:
    """Whether an element of a parsed pattern matches one digit and nothing else."""
    name = str(op)
    if name == "LITERAL":
        return of in _DIGITS
    if name != "IN":
        return False
    one = {"LITERAL": lambda x: x in _DIGITS, "RANGE": lambda x: x[0] in _DIGITS and x[1] in _DIGITS, "CATEGORY": lambda x: str(x) == "CATEGORY_DIGIT"}
    return all(str(o) in one and one[str(o)](x) for o, x in of)


def _needs(tree) -> tuple[list[tuple[str, ...]], int]:
    known: list[tuple[str, ...]] = []
    most, digits, run = 0, 0, ""
    for op, of in [*tree, (None, None)]:
        name = str(op)
        least, inner = 1, None
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, _, inner = of
        if _is_digit(op, of):
            digits += 1
        elif inner is not None and len(inner) == 1 and least and _is_digit(*inner[0]):
            digits += least
        elif name != "AT":
            digits = 0
        most = max(most, digits)
        if name == "LITERAL":
            run += chr(of)
            continue
        if name == "AT":
            continue
        if run:
            known.append((run,))
        run = ""
        within: tuple[list[tuple[str, ...]], int] = ([], 0)
        if inner is not None and least:
            within = _needs(inner)
        elif name == "SUBPATTERN" and not of[1] and not of[2]:
            within = _needs(of[3])
        elif name == "ATOMIC_GROUP":
            within = _needs(of)
        elif name == "BRANCH":
            each = [_needs(x) for x in of[1]]
            best = [max(strings, key=lambda c: min(map(len, c)), default=None) for strings, _ in each]
            within = ([tuple(dict.fromkeys(x for c in best for x in c))] if all(best) else [], min(n for _, n in each))
        known += within[0]
        most = max(most, within[1])
    return known, most


def needs(pattern: str) -> tuple[bool, tuple[tuple[str, ...], ...], int]:
    """(folded, strings, digits): a match, in lower case if ``folded``, holds one string of each tuple and a run of so many digits.

    For Python's patterns with ASCII classes; what isn't understood asks for nothing.
    """
    import warnings
    from re import _parser

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = _parser.parse(pattern)
    if tree.state.flags & re.VERBOSE:
        return False, (), 0
    folded = bool(tree.state.flags & re.IGNORECASE)
    strings, digits = _needs(tree)
    if folded:  # beyond ASCII the lower case of a letter depends on its neighbours
        strings = [tuple(x.lower() for x in c) for c in strings if all(map(str.isascii, c))]
    return folded, tuple(dict.fromkeys(strings)), digits


class Gate:
    """A text and the phrases that it holds, for patterns that run only where all that they require stands."""

    def __init__(self, fields: Column, places: dict[str, int]):
        self.t, self.bits, self.places = fields["t"], fields["bits"], places

    def count(self, pattern: str) -> Column:
        n = F.regexp_count(self.t, F.lit(java(pattern)))
        if not (needed := clauses(pattern)):
            return n
        there = reduce(lambda a, b: a & b, [any_bit(self.bits, [self.places[x] for x in c]) for c in needed])
        return F.when(there, n).otherwise(F.when(self.t.isNotNull(), F.lit(0)))


def gated(text: Column, patterns: list[str], then) -> Column:
    """``then`` of a :class:`Gate` for ``patterns``: what they all require is looked for at once."""
    places = {x: i for i, x in enumerate(sorted({x for p in patterns for c in clauses(p) for x in c}))}
    return let({"t": text, "bits": phrase_bits(F.lower(text), tuple(places))}, lambda fields: then(Gate(fields, places)))


def java(pattern: str) -> str:
    """A catalog pattern in Java's dialect.  A boundary before known letters is tested after them, since they rarely stand there."""
    parts = shared(pattern).split(r"\b")
    out = parts[0]
    for part in parts[1:]:
        first = _first_letters(part, 0)
        out += (f"(?=[{first}])(?<!{_WORD})" if first else _BOUNDARY) + part
    return "(?d)" + out


def count(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Matches of a catalog pattern.  With ``low``, the lower-cased text, the pattern runs only where a string that it requires stands."""
    n = F.regexp_count(text, F.lit(java(pattern)))
    if low is None or not (needed := required(pattern)):
        return n
    return F.when(reduce(lambda a, b: a | b, [has(low, x) for x in needed]), n).otherwise(F.when(low.isNotNull(), F.lit(0)))


def found(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def has(text: Column, phrase: str) -> Column:
    return F.contains(text, F.lit(phrase))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0)) if columns else F.lit(0)


def hits(text: Column, phrases: list) -> Column:
    """How many of the phrases (or (phrase, weight) pairs) a text contains."""
    return total([has(text, p if isinstance(p, str) else p[0]).cast("int") for p in phrases])


def weight_sum(text: Column, phrases: list[tuple[str, float]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(has(text, p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in phrases])


def best_weight(text: Column, phrases: list[tuple[str, float]]) -> Column:
    """The greatest weight of a contained phrase, 0 without any; one test for all phrases of a weight."""
    by: dict[float, list[str]] = {}
    for p, w in phrases:
        by.setdefault(w, []).append(p)
    chain = F
    for w in sorted(by, reverse=True):
        chain = chain.when(reduce(lambda a, b: a | b, [has(text, p) for p in by[w]]), F.lit(w))
    return chain.otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda x: x != "")


def band(score: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """Severity by the first cut that the score reaches."""
    chain = F
    for at, name in cuts:
        chain = chain.when(score >= at - EPSILON, name)
    return chain.otherwise(rest)


RISK_BANDS = [(0.9, "critical"), (0.7, "high"), (0.4, "medium")]


def severity_of(risk: Column) -> Column:
    """none, low, medium, high or critical, as results are ranked."""
    return F.when(risk <= 0, "none").otherwise(band(risk, RISK_BANDS, "low"))


def entropy(text: Column) -> Column:
    """Shannon bits of a text's characters, 0 if it is empty."""
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double") / n
    bits = F.aggregate(F.transform(F.array_distinct(F.split(text, "")), share), F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def text_entropy(text: Column) -> Column:
    """What :func:`entropy` gives, for long texts: their characters are counted in Arrow batches.  Not for use within a lambda."""

    @F.arrow_udf("double")
    def bits(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            shares = [n / len(t) for n in Counter(t).values()] if t else []
            out.append(-sum(p * math.log2(p) for p in shares) + 0.0)
        return pa.array(out, pa.float64())

    return bits(text)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bound(text: Column, then) -> Column:
    """``then`` of a struct of the text, t, and the lower-cased text, low, which is made once."""
    return let({"t": text, "low": F.lower(text)}, then)


class Fields(dict):
    """Columns by name that are fields of one struct; :func:`with_fields` computes it once for all of them."""

    def __init__(self, struct: Column, names):
        super().__init__({n: struct[n] for n in names})
        self.struct = struct


def once(struct: Column, then) -> Fields:
    """The columns that ``then`` makes of a struct, as fields of one struct in which each part is computed once."""
    names = list(then(struct))
    return Fields(F.get(F.transform(F.array(struct), lambda x: F.struct(*(c.alias(n) for n, c in then(x).items()))), F.lit(0)), names)


def with_fields(df: DataFrame, columns: dict[str, Column], prefix: str = "") -> DataFrame:
    """``df`` with ``columns``, each under its name with ``prefix`` before it."""
    if not isinstance(columns, Fields):
        return df.withColumns({prefix + k: v for k, v in columns.items()})
    held = "__fields"
    while held in df.columns:
        held = "_" + held
    return df.withColumn(held, columns.struct).withColumns({prefix + k: F.col(held)[k] for k in columns}).drop(held)


def let(fields: dict[str, Column], then) -> Column:
    """``then`` of a struct of the fields, each of which is computed once however often ``then`` names it."""
    bound = F.array(F.struct(*(c.alias(n) for n, c in fields.items())))
    return F.get(F.transform(bound, then), F.lit(0))
