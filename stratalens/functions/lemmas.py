"""English lemmas by rules: irregular forms from a table, regular ones by their endings.

A word loses its plural, third-person, -ing or -ed ending; the stem then loses a doubled consonant or gets back its e, by
what it ends with. That is a rule of thumb: it knows no parts of speech, so nouns in -ing lose it, too, but for those in
the table. Other languages' words pass unchanged unless they end like English ones. Arrow batches, each word once a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_VOWEL = re.compile("[aeiouy]")

#: Irregular forms, by their lemma.
IRREGULAR = {
    "be": "am is are was were been being", "have": "has had having", "do": "does did done", "go": "goes went gone", "begin": "began begun", "bring": "brought",
    "build": "built", "buy": "bought", "catch": "caught", "choose": "chose chosen", "come": "came", "deal": "dealt", "draw": "drew drawn", "drive": "drove driven",
    "fall": "fell fallen", "feel": "felt", "find": "found", "give": "gave given", "get": "got gotten getting", "grow": "grew grown", "hold": "held", "keep": "kept",
    "know": "knew known", "lead": "led", "leave": "left leaves", "lose": "lost losing", "make": "made", "mean": "meant", "meet": "met", "pay": "paid", "rise": "rose risen",
    "run": "ran", "say": "said", "see": "saw seen", "seek": "sought", "sell": "sold", "send": "sent", "show": "shown", "speak": "spoke spoken", "spend": "spent",
    "stand": "stood", "take": "took taken", "teach": "taught", "tell": "told", "think": "thought", "understand": "understood", "win": "won", "write": "wrote written",
    "man": "men", "woman": "women", "child": "children", "foot": "feet", "tooth": "teeth", "mouse": "mice", "life": "lives", "half": "halves", "shelf": "shelves",
    "analysis": "analyses", "crisis": "crises", "hypothesis": "hypotheses", "criterion": "criteria", "phenomenon": "phenomena", "index": "indices", "matrix": "matrices",
    "die": "dying dies died", "lie": "lying lies lied", "tie": "tying ties tied", "focus": "focuses focused focusing", "bus": "buses", "gas": "gases", "axis": "axes",
    "cache": "caches", "shoe": "shoes", "use": "uses used using", "agree": "agreeing agreed", "oversee": "overseeing overseen oversaw", "benefit": "benefited benefiting",
}
#: Words that look inflected and are not.
BASE = "during morning evening nothing something anything everything ceiling wedding news series species business always perhaps thus whereas across less besides towards afterwards indeed need speed feed seed proceed exceed succeed hundred sacred interested building red bed".split()
_TABLE = {form: lemma for lemma, forms in IRREGULAR.items() for form in forms.split()} | {w: w for w in BASE}
#: Endings of stems that have lost an e, and those among them that have not.
_LOST_E = re.compile(r"(?:[^aeiou]l|(?<!e)at|[iy]z|[vc]|u|[^aeo]ur|[aeq]u?ir|(?<![eo])ar|[^t]or|stor|(?<!o)ud|(?<![eo])ad|(?<![aeo])in|(?<!o)id|[aeiou]g|dg|rg|lg|(?:h|l)eng|hang|rang|[ai]k|[aeio]s|[rpn]s|(?:b|c|r|l)ut|(?<!e)t[iy]r|om|[^aeo]am|(?<![aeo])ap|yp|(?<!c)ern)$")
_KEPT = re.compile(r"(?:[rl]l|monitor|factor|author|favor|labor|honor|occur|refer|enter|offer|train|explain|contain|(?:be|re|ob|at|sus|main|enter|per)tain|eg?in|ex?it|limit|visit|credit|audit|edit|question|condition|access|process|address|discuss|assess|express|possess|pass|miss|cross|press|log|plan|begin|margin|origin|develop|speak|seek|look|book|peak|leak|break|soak|treat|repeat|heat|seat|beat|combat|format|threat|float|boat|kill|open|listen|target|market|cancel|model|travel|signal|total|label|level|fuel|claim|aim|become?)$")


def _stem(stem: str) -> str:
    if stem[-1] == stem[-2] and stem[-1] not in "aeiouslz":
        return stem[:-1]
    if stem.endswith("ll"):
        return stem[:-1] if len(re.findall("[aeiouy]+", stem)) > 1 and not re.search("(?:stall|[^t]roll|fill|sell|tall)$", stem) else stem
    if len(stem) <= 3 and re.fullmatch("[^aeiou]*[aeiouy][^aeiouywx]", stem):
        return stem + "e"
    return stem + "e" if _LOST_E.search(stem) and not _KEPT.search(stem) else stem


def lemma(word: str) -> str:
    """The lemma of a word, in lower case. A possessive ending goes."""
    w = word.lower().replace("’", "'")
    w = w[:-2] if w.endswith("'s") else w
    if w in _TABLE:
        return _TABLE[w]
    if len(w) <= 3 or not w.isalpha() or not w.isascii():
        return w
    if w.endswith(("ies", "ied")) and len(w) > 4:
        return w[:-3] + "y"
    if w.endswith(("sses", "shes", "ches", "xes", "zzes")) or w.endswith("oes") and len(w) > 4:
        return w[:-2]
    if w.endswith("s"):
        return w if w.endswith(("ss", "us", "is")) else lemma(w[:-1]) if w.endswith("ings") and _VOWEL.search(w[:-4]) else w[:-1]
    for ending in ("ing", "ed"):
        stem = w[: -len(ending)]
        if w.endswith(ending) and len(stem) >= 2 + (ending == "ed") * 0 and _VOWEL.search(stem) and not w.endswith("eed"):
            return _stem(stem) if len(stem) > 2 else w
    return w


def lemmas(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """The lemmas of a text's words that are no stop words (as words or as lemmas), joined by spaces: no punctuation,
    lower case. A null text gives an empty one."""
    stop = frozenset(w.lower() for w in stop_words)

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for b in batches:
            out = []
            for t in b:
                words = []
                for w in _WORD.findall(t.as_py() or ""):
                    if w not in known:
                        if len(known) > 500_000:
                            known.clear()
                        low = lemma(w)
                        known[w] = "" if w.lower() in stop or low in stop else low
                    words.append(known[w])
                out.append(" ".join(x for x in words if x))
            yield pa.array(out, pa.string())

    return convert(text)
