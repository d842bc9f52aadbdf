"""Quality rules: document statistics, and decision lists learned from labelled ones.

A decision list is learned by sequential covering: a conjunction of thresholds is grown on two thirds of the labelled
rows by FOIL's gain, pruned on the other third, accepted if it is precise enough there, and the rows it covers are
taken out before the next one is grown. The list becomes one ordered Spark conditional expression.

Statistics are computed over whole texts by numpy, a few MB at a time; only a bounded sample of labelled rows
(max_labelled, in a seeded order) reaches the driver, to fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm import kernels

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper", "n_digits", "n_ends", "n_distinct"]

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_END = np.zeros(256, np.int64)
_END[list(b".!?")] = 1


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeats(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each item occurs twice or more in its row, and the number of distinct items of each row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keyed = kernels.mix(hashes ^ kernels.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed)
    ranked = keyed[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), bool)
    twice[order] = same[1:] | same[:-1]
    first = np.zeros(len(ranked), np.int64)
    first[order] = ~same[:-1]
    return twice, _per_row(first, offsets)


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns COUNTS of the rows of a slice."""
    starts, ends, rows = kernels.words(data, offsets)
    hashes = kernels.span_hashes(data, starts, ends)
    head = (data & 0xC0) != 0x80
    solid = ~kernels._SPACE[data]
    runs, run_rows = kernels.windows(hashes, rows, 3)
    twice, _ = _repeats(runs, run_rows)
    covered = np.zeros(len(starts) + 1, bool)
    if twice.any():
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(run_rows))
        at = (np.arange(len(runs)) - run_rows[:-1][row_of] + rows[:-1][row_of])[twice]
        for i in range(3):
            covered[at + i] = True
    _, distinct = _repeats(hashes, rows)
    line_starts, line_ends, line_rows = kernels.lines(data, offsets)
    n_lines = np.diff(line_rows)
    _, distinct_lines = _repeats(kernels.span_hashes(data, line_starts, line_ends), line_rows)
    return [
        np.diff(rows), _per_row(head & solid, offsets), _per_row(_SYMBOL[data], offsets), n_lines - distinct_lines, _per_row(covered[:-1], rows),
        n_lines, _per_row(head, offsets), _per_row(_UPPER[data], offsets), _per_row(_DIGIT[data], offsets), _per_row(_END[data], offsets), distinct,
    ]


def statistics(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns keep and the columns COUNTS (bigint) of each whole text. Null and empty texts count 0 throughout.
    Columns in keep must not be named like COUNTS (see cut.hidden); text may be one of them."""
    keep = list(keep)
    src = df.select(*keep) if text in keep else df.select(*keep, text)
    at = src.columns.index(text)
    schema = T.StructType([*src.schema.fields[: len(keep)], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((len(COUNTS), len(b)), np.int64)
            for x, y, data, offsets in kernels.text_slices(b.column(at)):
                out[:, x:y] = counts(data, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(c) for c in out]], schema.names)

    return src.mapInArrow(count, schema)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def ratios() -> dict[str, Column]:
    """What thresholds are learned on: ratios of statistics that do not depend on a text's length, and its length."""
    return {
        "words": F.col("n_words").cast("double"), "word_length": _ratio("word_chars", "n_words"), "symbols": _ratio("n_symbols", "n_words"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"), "repeats": _ratio("n_repeat_words", "n_words"), "line_words": _ratio("n_words", "n_lines"),
        "upper": _ratio("n_upper", "n_chars_all"), "digits": _ratio("n_digits", "n_chars_all"), "sentence_ends": _ratio("n_ends", "n_words"), "distinct": _ratio("n_distinct", "n_words"),
    }


@dataclass
class Rule:
    """A conjunction of (feature, "<=" or ">=", threshold)."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.tests:
            hit &= x[name] <= at if sign == "<=" else x[name] >= at
        return hit

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & (columns[name] <= at if sign == "<=" else columns[name] >= at)
        return out


@dataclass
class DecisionList:
    """Rules that reject, in order; what none covers is kept."""

    rules: list[Rule]

    def keeps(self, columns: dict[str, Column] | None = None) -> Column:
        columns, out = columns or ratios(), F
        for rule in self.rules:
            out = out.when(rule.column(columns), F.lit(False))
        return out.otherwise(F.lit(True)) if self.rules else F.lit(True)

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        kept = np.ones(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            kept &= ~rule.covers(x)
        return kept


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, most_tests: int) -> Rule:
    rule, hit = Rule(), np.ones(len(bad), bool)
    while len(rule.tests) < most_tests and (~bad[hit]).any() and bad[hit].any():
        p0, n0 = bad[hit].sum(), hit.sum()
        best = (0.0, None, None)
        for name, v in x.items():
            for at in np.unique(np.quantile(v[hit], np.linspace(0, 1, cuts + 1), method="nearest")):
                for sign in ("<=", ">="):
                    now = hit & (v <= at if sign == "<=" else v >= at)
                    p, n = bad[now].sum(), now.sum()
                    if 0 < p and n < n0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, (name, sign, float(at)), now)
        if best[1] is None:
            break
        rule.tests.append(best[1])
        hit = best[2]
    return rule


def _widen(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """rule with each threshold moved out over further bad rows, to midway between the last of them and the first good
    row that the other tests let through."""
    tests = list(rule.tests)
    for i, (name, sign, at) in enumerate(tests):
        rest = Rule(tests[:i] + tests[i + 1 :]).covers(x)
        side = 1.0 if sign == ">=" else -1.0
        v = side * x[name]
        good = v[rest & ~bad & (v < side * at)]
        if len(good) and (reached := v[rest & bad & (v > good.max())]).size:
            tests[i] = (name, sign, float(side * (good.max() + min(reached.min(), side * at)) / 2))
    return Rule(tests)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, least: int = 3, cuts: int = 24, most_tests: int = 4, most_rules: int = 12, seed: int = 7) -> DecisionList:
    """Sequential covering of the bad rows. A rule counts only if it is right with at least the given precision both
    on the rows left and on those of them that it was not grown on, and there on at least `least` rows (with few
    labels: on a quarter of the bad ones); so few clean documents go. The bad rows that a refused rule was grown from
    are set aside, and covering goes on without them. Without both classes: no rules."""
    rules: list[Rule] = []
    left, tried = np.ones(len(bad), bool), np.zeros(len(bad), bool)
    spun = np.empty(len(bad), bool)
    rng = np.random.default_rng(seed)
    for kind in (bad, ~bad):  # two thirds of either class to grow on
        spun[kind] = rng.permutation(int(kind.sum())) % 3 > 0
    enough = max(1, min(least, int((bad & ~spun).sum()) // 4))
    take = lambda at: {k: v[at] for k, v in x.items()}
    while len(rules) < most_rules and (left & spun & bad & ~tried).any() and (left & ~bad).any():
        grow, prune = left & spun & ~tried, left & ~spun
        rule = _widen(_grow(take(grow), bad[grow], cuts, most_tests), take(grow), bad[grow])
        xp, bp = take(prune), bad[prune]
        score = lambda r: (2 * bp[h].sum() - h.sum()) / max(1, h.sum()) if (h := r.covers(xp)).any() else -1.0
        pruned = max((Rule(rule.tests[:n]) for n in range(len(rule.tests), 0, -1)), key=score, default=None)
        if pruned is None:
            break
        covered = pruned.covers(x) & left
        held = covered & ~spun
        if held.sum() >= enough and bad[held].mean() >= precision and bad[covered].mean() >= precision:
            rules.append(pruned)
            left &= ~covered
        elif (grown := rule.covers(x) & grow & bad).any():
            tried |= grown
        else:
            break
    return DecisionList(rules)


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_labelled: int = 20_000, seed: int = 7, **how) -> DecisionList:
    """A decision list from labelled statistics: a seeded sample of at most max_labelled labelled rows is collected.

    Labels that are null, and labels of unknown documents, do not count. Rows that fail the base rules are left out:
    they are rejected anyway. No labels: a list that keeps everything.
    """
    columns = ratios()
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    rows = stats.where(~base_failed()).join(known, stats[key] == F.col("_key")).select("_key", "_label", *[c.alias(n) for n, c in columns.items()])
    # a seeded hash keeps about as many rows as are asked for; what is over that is cut off in order
    order = F.xxhash64(F.lit(seed), F.col("_key"))
    n = rows.count()
    if n > max_labelled:
        rows = rows.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 0.97 * max_labelled / n))
    sample = rows.orderBy(order, "_key", "_label", *columns).limit(max_labelled).toPandas()
    x = {n: sample[n].to_numpy(float) for n in columns}
    return learn(x, sample["_label"].to_numpy() == 0, seed=seed, **how)
