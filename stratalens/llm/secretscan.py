"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings. DataFrame functions only.

Fixed patterns give the spans that an ordinary scan finds: leftmost, not overlapping, each kind on its own. Beside
them, strings of credential-like characters with a digit among them are candidates: a window of WINDOW characters
slides along each, the counts of its characters are kept up one character in and one out at a time, and the windows
whose Shannon entropy reaches the threshold of the string's character class (hexadecimal, one-case alphanumeric, or
mixed) make a span, unless the string is on the allow-list or a fixed pattern's span overlaps it.

Every function is evaluated within a row; there is no shuffle. Texts without a candidate cost a few searches. A candidate
is split into characters once and costs the same for each of them, however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns, the group that is measured, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

WINDOW, CHUNK = 20, 256
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Bits a character at which a window of each class counts as random.
THRESHOLDS = {"hex": 2.9, "alnum": 3.45, "mixed": 3.75}
#: Identifiers that look random and are no secrets: UUIDs, content digests with their name, sample credentials, and
#: names of short words and numbers that hyphens or underscores join.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^sha(1|256|384|512)[-_=]",
    r"(?i)example|sample|dummy|placeholder",
    # parts of at most 12 letters or 8 digits, a word first: said by what must not occur, as a loop over the parts would
    # need a stack as deep as there are parts
    r"^(?=[A-Za-z]{1,12}[-_])(?!.*(?:[A-Za-z]{13}|[0-9]{9}|[A-Za-z][0-9]|[0-9][A-Za-z]|[^A-Za-z0-9_-]|[-_][-_]|[-_]$))",
]
#: The characters of candidates, and where each one's count stands in the accumulator: SLOTS counts of five bits a number.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SLOTS = 12


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(text: str, pattern: str, *groups: int) -> str:
    """SQL: array<struct<`0`, `1`, ...>> of the matches: the text from the end of the last match to the end of this
    one, and the groups asked for. The two extractions walk alike. \\G holds each step to where the last one ended:
    what follows the last match is looked through once."""
    whole, p = _literal(rf"\G(?s:.*?)(?:{pattern})"), _literal(pattern)
    return f"arrays_zip(regexp_extract_all({text}, {whole}, 0), {', '.join(f'regexp_extract_all({text}, {p}, {g})' for g in groups)})"


def _placed(parts: str, kind: str, made: str, wanted: str) -> str:
    """SQL: array<kind> of what `made` gives for each part x that is `wanted`, where acc.at is the code points before x.

    Lengths add up to places. Blocks of CHUNK matches are added up first and then walked from where they begin, so that
    arrays that grow match by match stay short.
    """
    chunks = f"CASE WHEN size({parts}) > 0 THEN sequence(0, (size({parts}) - 1) div {CHUNK}) ELSE CAST(array() AS array<int>) END"
    one = f"aggregate(slice({parts}, k * {CHUNK} + 1, {CHUNK}), 0, (n, x) -> n + length(x.`0`))"
    begins = f"aggregate({chunks}, struct(0 AS at, CAST(array() AS array<int>) AS begins), (acc, k) -> struct(acc.at + {one} AS at, concat(acc.begins, array(acc.at)) AS begins), acc -> acc.begins)"
    step = f"(acc, x) -> struct(acc.at + length(x.`0`) AS at, CASE WHEN {wanted} THEN concat(acc.found, array({made})) ELSE acc.found END AS found)"
    walk = f"aggregate(slice({parts}, k * {CHUNK} + 1, {CHUNK}), struct(begin AS at, CAST(array() AS array<{kind}>) AS found), {step}, acc -> acc.found)"
    return f"flatten(transform({begins}, (begin, k) -> {walk}))"


def _codes(text: str) -> str:
    """SQL: array<int> of where the counts of a candidate's characters stand: 64 times the number, plus its shift."""
    place = {c: 64 * (i // SLOTS) + 5 * (i % SLOTS) for i, c in enumerate(ALPHABET)}
    table = "array(" + ", ".join(str(place.get(chr(i), 0)) for i in range(128)) + ")"
    return f"transform(split({text}, ''), x -> {table}[ascii(x)])"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _entropy(window: int) -> str:
    """SQL lambda of a candidate struct<start, codes, threshold>: it with the least start and greatest end of its random
    windows.

    One character goes out of the window and one comes in: the accumulator's counts of these two change by one, and
    with them two terms of the sum of n log2 n. Counts are packed, SLOTS to a number, as they are at most `window`.
    """
    if window > 30:
        raise ValueError("windows have at most 30 characters")
    bits = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(window + 2)) + ")"
    words = range(-(-len(ALPHABET) // SLOTS))
    held = lambda code: f"CAST(shiftright(CASE shiftright({code}, 6) " + " ".join(f"WHEN {k} THEN acc.w{k}" for k in words) + f" END, {code} & 63) & 31 AS INT)"
    # what comes, and what goes (-1: nothing yet); then their counts without each other
    moved = f"struct(c.codes[i - 1] AS a, CASE WHEN i > {window} THEN c.codes[i - {window + 1}] ELSE -1 END AS b)"
    count = f"struct({held('z.a')} - CASE WHEN z.b = z.a THEN 1 ELSE 0 END AS a, CASE WHEN z.b >= 0 THEN {held('z.b')} ELSE 1 END AS b)"
    total = f"acc.total + {bits}[y.a + 1] - {bits}[y.a] + CASE WHEN z.b >= 0 THEN {bits}[y.b - 1] - {bits}[y.b] ELSE 0D END"
    change = lambda code, k: f"CASE WHEN shiftright({code}, 6) = {k} THEN shiftleft(1L, {code} & 63) ELSE 0L END"
    counts = ", ".join(f"acc.w{k} + {change('z.a', k)} - {change('z.b', k)} AS w{k}" for k in words)
    random = f"i >= {window} AND log2({window}) - t / {window} >= c.threshold"
    kept = f"struct(t AS total, CASE WHEN r AND acc.low < 0 THEN i - {window} ELSE acc.low END AS low, CASE WHEN r THEN i ELSE acc.high END AS high, {counts})"
    step = f"(acc, i) -> {_let('z', moved, _let('y', count, _let('t', total, _let('r', random, kept))))}"
    zero = ", ".join(f"0L AS w{k}" for k in words)
    return f"c -> aggregate(sequence(1, size(c.codes)), struct(0D AS total, -1 AS low, -1 AS high, {zero}), {step}, acc -> struct(c.start + acc.low AS start, 3 AS kind, c.start + acc.high AS end, acc.low AS low))"


def scan(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), allow: Sequence[str] = ALLOW, thresholds: dict[str, float] = THRESHOLDS, window: int = WINDOW) -> DataFrame:
    """keep, assign, access, hex and entropy: arrays of struct<start, kind, end> found in each whole text.

    Places are code points, ends exclusive. Null and empty texts have none. Rows that repeat are scanned each. An empty
    table gives no rows. A kept column that is named like one of the kinds comes out with kept_ before its name.
    Letters of the keywords count in either case, of ASCII only.
    """
    kinds = [*[k for k, *_ in KINDS], "entropy"]
    names = [f"kept_{c}" if c in kinds else c for c in keep]
    held = [f"_keep_{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    low = F.lower("_text")
    named = F.lit(False)
    for w in WORDS:
        named = named | low.contains(w)
    may = {"assign": named, "access": F.contains(F.col("_text"), F.lit("AKIA")), "hex": F.col("_text").rlike("[0-9a-f]{24}"), "entropy": F.col("_text").rlike(CANDIDATE)}
    parts = {k: _parts("_text", p, 0, g) for k, p, g, _ in KINDS} | {"entropy": _parts("_text", CANDIDATE, 0)}
    found = rows.select("*", *[F.when(may[k], F.expr(p)).alias(f"_{k}") for k, p in parts.items()])
    span = "struct<start: int, kind: int, end: int>"
    none = F.expr(f"CAST(array() AS array<{span}>)")
    made = "struct(acc.at + length(x.`0`) - length(x.`1`) AS start, {} AS kind, acc.at + length(x.`0`) AS end)"
    spans = [F.when(F.col(f"_{k}").isNotNull(), F.expr(_placed(f"_{k}", span, made.format(i), f"length(x.`2`) >= {n}"))).otherwise(none).alias(k) for i, (k, _, _, n) in enumerate(KINDS)]
    # candidates: their places, their texts, the threshold of their class; those on the allow-list go
    level = f"CASE WHEN x.`1` RLIKE '^[0-9a-f]+$' OR x.`1` RLIKE '^[0-9A-F]+$' THEN {thresholds['hex']}D WHEN x.`1` RLIKE '^([0-9a-z_-]+|[0-9A-Z_-]+)$' THEN {thresholds['alnum']}D ELSE {thresholds['mixed']}D END"
    suspect = " AND ".join(f"NOT x.`1` RLIKE {_literal(a)}" for a in allow) or "true"
    candidates = _placed("_entropy", "struct<start: int, codes: array<int>, threshold: double>", f"struct(acc.at + length(x.`0`) - length(x.`1`) AS start, {_codes('x.`1`')} AS codes, {level} AS threshold)", suspect)
    loose = F.when(F.col("_entropy").isNotNull(), F.expr(f"transform(filter(transform({candidates}, {_entropy(window)}), e -> e.low >= 0), e -> struct(e.start AS start, e.kind AS kind, e.end AS end))")).otherwise(none)
    found = found.select(*held, *spans, loose.alias("_loose"))
    clear = F.filter("_loose", lambda e: ~F.exists(F.concat(*kinds[:-1]), lambda b: (b.start < e.end) & (e.start < b.end)))
    return found.select(*[F.col(h).alias(n) for h, n in zip(held, names, strict=True)], *kinds[:-1], clear.alias("entropy"))


def listing(*columns: str) -> Column:
    """kind:start:end of spans, by start, then by kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("entropy"))
    ordered = F.array_sort(F.concat(*columns))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")
