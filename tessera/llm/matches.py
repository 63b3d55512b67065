"""Places of regular-expression matches, with SQL functions only.

A text split by a pattern gives the gaps between its matches, so a match's place
is the sum of the lengths before it.  Sums run in groups of ``GROUP``, which
keeps many matches in one long text from taking quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 128
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string,before:string,after:string>>"
#: Characters of context kept on either side of a match, and the other matches that may lie in them.
NEAR = 40
REACH = 8


def _running(numbers: str, step: str = "{a} + {b}", zero: str = "0") -> str:
    """SQL for the running sums (or what ``step`` makes of two numbers, ``zero`` being neutral) of an array of integers that isn't empty."""
    groups = f"transform(sequence(0, (size({numbers}) - 1) div {GROUP}), b -> slice({numbers}, b * {GROUP} + 1, {GROUP}))"
    within = f"aggregate({{x}}, array({{zero}}), (acc, v) -> concat(acc, array({step.format(a='element_at(acc, -1)', b='v')})))"
    bases = within.format(x=f"transform({groups}, x -> aggregate(x, {zero}, (a, v) -> {step.format(a='a', b='v')}))", zero=zero)
    inner = within.format(x="x", zero="base")
    return f"flatten(zip_with({groups}, slice({bases}, 1, size({groups})), (x, base) -> slice({inner}, 2, {GROUP})))"


def with_matches(df: DataFrame, text: str, name: str, rank: int, pattern: str, gate: Column, context: bool = True) -> DataFrame:
    """Adds column ``name``: the pattern's leftmost non-overlapping matches as spans.

    Offsets are code points from 0, ends exclusive; ``rank`` orders kinds that start
    at one place.  ``gate`` is a cheap condition that must hold wherever the pattern
    matches; elsewhere, and for null, the array is empty.  With ``context`` a span has
    up to ``NEAR`` characters of the text before and after it, other matches included.
    """
    gaps, found, ends, left, right = (f"__{name}_{x}" for x in ("gaps", "found", "ends", "left", "right"))
    empty = F.array().cast("array<string>")
    regex = F.lit(pattern)
    some = f"size({found}) > 0"
    df = df.withColumn(found, F.when(gate, F.regexp_extract_all(F.col(text), regex, F.lit(0))).otherwise(empty))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(F.col(text), pattern, -1)).otherwise(empty))
    steps = f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> length(g) + length(m))"
    df = df.withColumn(ends, F.expr(f"CASE WHEN {some} THEN {steps} ELSE cast(array() AS array<int>) END"))
    df = df.withColumn(ends, F.expr(f"CASE WHEN {some} THEN {_running(ends)} ELSE cast(array() AS array<int>) END"))
    before = after = "''"
    if context:
        # Gaps and matches in turn, what lies nearest to each side; a match has five characters or more.
        for side, piece in ((left, f"right({{}}, {NEAR})"), (right, f"left({{}}, {NEAR})")):
            pair = f"array({piece.format('g')}, {piece.format(chr(109))})"
            df = df.withColumn(side, F.expr(f"CASE WHEN {some} THEN flatten(zip_with({gaps}, {found}, (g, m) -> {pair})) ELSE cast(array() AS array<string>) END"))
        before = f"right(array_join(slice({left}, greatest(1, 2 * i + 1 - {2 * REACH}), least({2 * REACH + 1}, 2 * i + 1)), ''), {NEAR})"
        after = f"left(array_join(slice({right}, 2 * i + 3, {2 * REACH + 1}), ''), {NEAR})"
    span = (
        f"transform(arrays_zip({ends}, {found}), (z, i) -> named_struct("
        f"'start', z.{ends} - length(z.{found}), 'rank', {rank}, 'end', z.{ends}, 'kind', '{name}', 'match', z.{found}, 'before', {before}, 'after', {after}))"
    )
    df = df.withColumn(name, F.expr(f"CASE WHEN {some} THEN {span} ELSE cast(array() AS {SPAN}) END"))
    return df.drop(gaps, found, ends, left, right)


def with_meeting(df: DataFrame, name: str, parts: str, others: str, scope: int, meet: bool = True) -> DataFrame:
    """Adds column ``name``: the spans of ``parts`` that overlap the scope of some of ``others``, or with ``meet`` false the rest.

    An interval join within a row: all spans are sorted by place once, and a running
    maximum over those of ``others`` says how far the scopes that begin before a part's
    end reach.  The work doesn't grow with the product of the two sides.  The result is
    in the order of ends.
    """
    events, reach = "__events", "__reach"
    other = f"transform({others}, a -> named_struct('at', a.start - {scope}, 'rank', 1, 'reach', a.end + {scope}, 'place', -1))"
    own = f"transform({parts}, (s, i) -> named_struct('at', s.end, 'rank', 0, 'reach', -2147483648, 'place', i))"
    both = f"size({parts}) > 0 AND size({others}) > 0"
    none = "cast(array() AS array<int>)"
    df = df.withColumn(events, F.expr(f"CASE WHEN {both} THEN array_sort(concat({own}, {other})) END"))
    df = df.withColumn(reach, F.expr(f"CASE WHEN {both} THEN {_running(f'transform({events}, e -> e.reach)', 'greatest({a}, {b})', '-2147483648')} ELSE {none} END"))
    test = f"{parts}[x.place].start < x.reach"
    met = f"zip_with({events}, {reach}, (e, r) -> named_struct('place', e.place, 'reach', r))"
    chosen = f"transform(filter({met}, x -> x.place >= 0 AND {'' if meet else 'NOT '}({test})), x -> {parts}[x.place])"
    return df.withColumn(name, F.expr(f"CASE WHEN {both} THEN {chosen} ELSE {f'slice({parts}, 1, 0)' if meet else parts} END")).drop(events, reach)


def joined(spans: str) -> str:
    """SQL for ``kind:start:end`` of the spans by start and then kind, joined by commas."""
    return f"array_join(transform(array_sort({spans}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def with_masked(df: DataFrame, text: str, spans: str, mask: str) -> DataFrame:
    """``text`` with its spans (sorted by start; they may overlap) replaced: each run of overlapping spans by one ``mask``."""
    reach, runs, inner = "__reach", "__runs", "__parts"
    some = f"size({spans}) > 0"
    df = df.withColumn(reach, F.expr(f"CASE WHEN {some} THEN {_running(f'transform({spans}, s -> s.end)', 'greatest({a}, {b})')} ELSE cast(array() AS array<int>) END"))
    # A run ends where the next span starts behind all ends so far.
    df = df.withColumn(runs, F.expr(f"filter(transform({spans}, (s, i) -> named_struct('start', s.start, 'before', CASE WHEN i = 0 THEN 0 ELSE {reach}[i - 1] END)), (s, i) -> i = 0 OR s.start >= s.before)"))
    df = df.withColumn(inner, F.expr(f"transform({runs}, s -> substring({text}, s.before + 1, s.start - s.before))"))
    masked = F.expr(f"concat(array_join({inner}, '{mask}'), '{mask}', substring({text}, element_at({reach}, -1) + 1))")
    return df.withColumn(text, F.when(F.expr(some), masked).otherwise(F.col(text))).drop(reach, runs, inner)
