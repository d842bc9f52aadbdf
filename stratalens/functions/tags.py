"""One dictionary classifier for every vocabulary: labels whose keywords a text contains.

All keywords of all vocabularies that are asked of a text make one Aho-Corasick automaton, which reads the text once,
however many they are. It runs over Arrow batches of lower-cased texts and is built once a task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Vocabulary = dict[str, list[str]] | list[str]


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of a few words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _table(vocabulary: Vocabulary) -> dict[str, list[str]]:
    return vocabulary if isinstance(vocabulary, dict) else {w.title(): [w] for w in vocabulary}


def _in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc")


class Matcher:
    """The automaton of some vocabularies. A label is a bit of a number, each keyword carries its labels' bits."""

    def __init__(self, vocabularies: Mapping[str, Vocabulary], whole_words: bool = False) -> None:
        import ahocorasick

        self.whole_words, self.found = whole_words, {}
        entries = [(name, label, words) for name, v in vocabularies.items() for label, words in _table(v).items()]
        self.bits = [(name, label) for name, label, _ in entries]
        masks: dict[str, int] = {}
        for i, (*_, words) in enumerate(entries):
            for word in words:
                if word:
                    masks[word.lower()] = masks.get(word.lower(), 0) | 1 << i
        self.names = list(vocabularies)
        self.automaton = ahocorasick.Automaton()
        for word, mask in masks.items():
            self.automaton.add_word(word, (len(word), mask))
        self.automaton.make_automaton()
        self.empty = not masks

    def mask(self, low: str) -> int:
        """The bits of the labels that a lower-cased text names."""
        found = 0
        if not self.empty:
            for end, (n, mask) in self.automaton.iter(low):
                if found | mask != found and (not self.whole_words or self._apart(low, end - n + 1, end + 1)):
                    found |= mask
        return found

    @staticmethod
    def _apart(low: str, start: int, end: int) -> bool:
        before = start and _in_word(low[start]) and _in_word(low[start - 1])
        return not before and not (end < len(low) and _in_word(low[end - 1]) and _in_word(low[end]))

    def labels(self, low: str) -> dict[str, list[str]]:
        """Sorted distinct labels by vocabulary. Texts name few different sets of labels, so these are kept."""
        mask = self.mask(low)
        if mask not in self.found:
            if len(self.found) > 100_000:
                self.found.clear()
            out: dict[str, set[str]] = {n: set() for n in self.names}
            for i, (name, label) in enumerate(self.bits):
                if mask >> i & 1:
                    out[name].add(label)
            self.found[mask] = {n: sorted(x, key=lambda s: s.encode()) for n, x in out.items()}
        return self.found[mask]


def labels_of(text: Column, vocabularies: Mapping[str, Vocabulary], whole_words: bool = False) -> Column:
    """struct<name: array<string>, ...>: for each vocabulary the sorted distinct labels whose keywords occur in the
    text, in any case; null texts have none. A list's keywords are their own labels, in title case. whole_words:
    keywords must not stand inside a longer word (by default they may)."""
    vocabularies = dict(vocabularies)
    kind = pa.struct([(n, pa.list_(pa.string())) for n in vocabularies])

    @F.arrow_udf("struct<" + ", ".join(f"`{n}`: array<string>" for n in vocabularies) + ">")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(vocabularies, whole_words)
        for b in batches:
            yield pa.array([matcher.labels(t.as_py()) for t in b], kind)

    return find(F.lower(F.coalesce(text, F.lit(""))))


def labels(text: Column, vocabulary: Vocabulary, whole_words: bool = False) -> Column:
    """labels_of() one vocabulary: array<string>."""
    return labels_of(text, {"labels": vocabulary}, whole_words)["labels"]
