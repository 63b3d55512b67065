"""Fill-in-the-middle transformation by a two-pass streaming matcher.

A text is cut into units by a pattern, matched from left to right.  The first pass counts
the matches; the second advances a lazy iterator over them to both ranks that the
document's hash chooses.  Neither keeps an array of units, so beside the text and its
output memory is constant, however many units there are.

The middle moves to the end, behind the prefix and suffix (``psm``) or suffix and prefix
(``spm``), each part led by its sentinel.  A text that is empty or contains a sentinel,
or that the rate passes over, stays as it is (``plain``); so ``restored`` can always tell
the parts.

A null text counts as empty.  Texts are handled whole, one at a time.  A null id is hashed
as the empty text.  Repeated rows get equal results, an empty table none; other columns,
also those named like results, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A task hands on outputs when it holds so many characters.
HELD = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def count(unit: re.Pattern[str], text: str) -> int:
    return sum(1 for _ in unit.finditer(text))


def ends(unit: re.Pattern[str], text: str, first: int, second: int) -> tuple[int, int]:
    """Where the unit of the first rank ends and that of the second, which isn't smaller; rank 0 is the text's start."""
    matches, at = unit.finditer(text), 0
    for match in islice(matches, first):
        at = match.end()
    until = at
    for match in islice(matches, second - first):
        until = match.end()
    return at, until


def transformed(text: str, key: str, unit: re.Pattern[str], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    n = count(unit, text)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = ends(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    before, after = PREFIX + text[:a], SUFFIX + text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, a, b - a, (after + before if form == "spm" else before + after) + MIDDLE + text[a:b]


def fill_in_middle(docs: DataFrame, unit: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars and output.

    Of 100 documents ``rate`` are transformed, and of 100 of those ``spm`` have the suffix first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
        for batch in batches:
            held, size = [], 0
            for i, body in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                i, body = i.as_py(), body.as_py()
                held.append((i, *transformed(body, f"{seed}:{'' if i is None else i}", pattern, rate, spm)))
                size += len(body)
                if size >= HELD:
                    yield _batch(held, kinds)
                    held, size = [], 0
            if held:
                yield _batch(held, kinds)

    return rows.mapInArrow(apply, SCHEMA)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from its output and form alone."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", 3)
    return F.when(form == "psm", F.concat(parts[0], parts[2], parts[1])).when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(output)


#: For DuckDB: units as a list, cut at both ranks.
FILL_IN_MIDDLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
ranks AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM ranks)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
