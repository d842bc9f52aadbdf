"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, scores of texts.

P(w | h) is d c(hw) / c(h) for an n-gram that was seen in training, and a(h) P(w | h without its first word) for one
that was not, down to single words, where what the discounts leave is the share of the one event "unknown word". d is
Katz's discount of counts up to GT_MOST, 1 above; a(h) makes the words after h add up to 1. A context whose counts are
all above GT_MOST leaves nothing for unseen words: then one is added to its total, which keeps it normalised.

How it runs. Texts are tokenised once and kept as chunks of about CHUNK tokens: the sorted distinct words and a number
for each token, in a table bucketed by chunk. Everything a chunk must know of the corpus it asks for: it sends its distinct
n-grams, each once, to the bucket of their hash; a bucket adds up all chunks' training counts, writes them to the
model's table, and answers each chunk in the order of its question. So a hot word or n-gram is one item for each
chunk and all buckets are alike. One chunk of those that have an n-gram is told to own it; owners' sums, by context, of
counts, discounted counts and lower-order probabilities go the same way, and come back as totals and backoff weights. A
chunk then evaluates its tokens, order by order. Answers meet their chunks by the table's buckets: the texts are shuffled
never. Of the corpus, the driver holds counts of counts, a few numbers for each order.

Words and n-grams go by 64-bit hashes, and nothing decides equality beside them: among a hundred million different
words two share a hash with odds of 3e-4. A row that travels holds a chunk's n-grams of one bucket. They get fewer as chunks
times buckets grow: some 15 at a terabyte. BUCKET and CHUNK are parameters that should grow with executors' memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm import kernels
from stratalens.llm.cut import cut, discard, hidden, shared_dir

CHUNK, BUCKET, GT_MOST = 3 << 19, 2 << 20, 5
#: Stand-ins for the end of a text (a token) and for its start (only ever a context).
END, START = np.uint64(0x7E57C0DE00000001), np.uint64(0x7E57C0DE00000002)
_STEP = np.uint64(0x9DDFEA08EB382D69)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their bytes' significance, compressed: small numbers and repeats cost little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw, np.uint64), dtype=np.uint64)


def chunked(df: DataFrame, key: str, text: str, held: Column, chunk: int) -> DataFrame:
    """(chunk, n, words, tokens, lengths, keys, held): the texts of about `chunk` tokens: distinct word hashes, the
    place of each token among them, tokens of each text, the rows' keys, and which of them are held out."""
    plain, (key_, text_) = hidden(df, key, text)
    rows = plain.select(F.col(key_).alias("key"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_).cast("string").alias("text"))
    kind = T.StructType([*T.StructType.fromDDL("chunk bigint, n bigint, words binary, tokens binary, lengths binary").fields, T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType()))])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held_, n = TaskContext.get().partitionId() << 32, [], 0
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[pa.Array] = []

        def done() -> pa.RecordBatch:
            nonlocal number, n
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            own = [pa.concat_arrays(x) for x in (keys, held_)]
            columns = [pa.array([number], pa.int64()), pa.array([n], pa.int64()), *[pa.array([x], pa.binary()) for x in (_pack_sorted(words), _planes(tokens.astype(np.uint32)), _planes(np.concatenate(lengths).astype(np.uint32)))], *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in own]]
            for x in (hashes, lengths, keys, held_):
                x.clear()
            number, n = number + 1, 0
            return pa.RecordBatch.from_arrays(columns, kind.names)

        for b in batches:
            for x, y, data, offsets in kernels.text_slices(b.column(2)):
                starts, ends, at = kernels.words(data, offsets)
                found = np.insert(kernels.span_hashes(data, starts, ends, lower=True), at[1:], END)
                hashes.append(found)
                lengths.append(np.diff(at) + 1)
                keys.append(b.column(0).slice(x, y - x))
                held_.append(b.column(1).slice(x, y - x))
                n += len(found)
                if n >= chunk:
                    yield done()
        if n:
            yield done()

    return rows.mapInArrow(tokenise, kind)


def bucketed(df: DataFrame, name: str, by: str, n: int) -> tuple[DataFrame, str]:
    """df in a table of the shared folder that is bucketed by a column, and the table's name: joins on that column
    leave it where it is."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("compression", "none").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table), table


class Texts:
    """A chunk's tokens: their n-grams' hashes of each order, and where they are whole."""

    def __init__(self, words: bytes, tokens: bytes, lengths: bytes, held: Sequence[bool]) -> None:
        self.words, self.tokens, self.lengths = _sorted(words), _numbers(tokens, np.uint32), _numbers(lengths, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(held, bool), self.lengths)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.first, self.lengths)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, context, tokens that have one): n-grams may begin with the start of the text, once."""
        gram, context = self.words[self.tokens], None
        for _ in range(order - 1):
            context = np.empty_like(gram)
            context[1:] = gram[:-1]
            context[self.first] = START
            gram = kernels.mix(context * _STEP + self.words[self.tokens])
        return gram, context, self.place >= order - 2

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct grams, a token of each, each whole token's place among them)."""
        if order == 1:
            first = np.zeros(len(self.words), np.int64)
            first[self.tokens[::-1]] = np.arange(len(self.tokens))[::-1]
            return self.words, first, self.tokens
        gram, _, whole = self.grams(order)
        at = np.flatnonzero(whole)
        keys, first, place = np.unique(gram[at], return_index=True, return_inverse=True)
        return keys, at[first], place


def _texts(row: dict) -> Texts:
    return Texts(row["words"], row["tokens"], row["lengths"], row["held"])


def _edges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets of sorted keys: their first bits."""
    buckets = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return [(int(buckets[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def discounts(n: Sequence[int]) -> np.ndarray:
    """What each count's Katz discount is, from counts of counts n[0] (seen once) to n[GT_MOST]: at 1 to GT_MOST; at 0
    and above 1. Counts that Good-Turing does not lower, or cannot, as a count of counts is missing, stay whole."""
    d = np.ones(GT_MOST + 2)
    if n[0]:
        rest = (GT_MOST + 1) * n[GT_MOST] / n[0]
        for r in range(1, GT_MOST + 1):
            if n[r - 1] and rest < 1:
                value = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest)
                d[r] = value if 0 < value < 1 else 1
    return d


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, GT_MOST + 1)] * counts


def single(stats: dict) -> tuple[np.ndarray, float, float]:
    """(discounts, total, share of unknown words) of single words."""
    d = discounts(stats["n"])
    kept = sum((d[r] - 1) * r * stats["n"][r - 1] for r in range(1, GT_MOST + 1)) + stats["tokens"]
    total = stats["tokens"] if kept < stats["tokens"] else stats["tokens"] + 1
    return d, float(total), 1 - kept / total


_QUESTION = "order int, bucket int, chunk bigint, keys binary, a binary, b binary, c binary"
_ANSWER = "part string, order int, bucket int, chunk bigint, keys binary, a binary, b binary, types bigint, tokens bigint, n array<bigint>"
_KINDS = pa.schema([("part", pa.string()), ("order", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("n", pa.list_(pa.int64()))])


def _gathered(asked: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """A bucket's questions by chunk; their distinct keys, each one's first place, each item's key; and the questions'
    slices of the items."""
    asked = asked.sort_by("chunk")
    parts = [_sorted(k) for k in asked.column("keys").to_pylist()]
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    keys, first, place = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    return asked, keys, first, place, [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _answers(asked: pa.Table, rows: Sequence[dict], model: dict) -> pa.Table:
    order, bucket = asked.column("order")[0].as_py(), asked.column("bucket")[0].as_py()
    own = [{"part": "answer", "chunk": c, **r} for c, r in zip(asked.column("chunk").to_pylist(), rows, strict=True)]
    return pa.Table.from_pylist([{"order": order, "bucket": bucket, **r} for r in [*own, {"part": "model", **model}]], _KINDS)


def _count(asked: pa.Table) -> pa.Table:
    """Training counts of a bucket's n-grams: as the model has them, and for each chunk (a), with what it owns (b)."""
    asked, keys, first, place, slices = _gathered(asked)
    given = np.concatenate([_numbers(x, np.uint32) for x in asked.column("a").to_pylist()])
    counts = np.bincount(place, given).astype(np.int64)
    owned = np.zeros(len(place), bool)
    owned[first] = True
    seen = counts > 0
    n = np.bincount(np.minimum(counts[seen], GT_MOST + 2), minlength=GT_MOST + 3)[1 : GT_MOST + 2]
    model = {"keys": _pack_sorted(keys[seen]), "a": _planes(counts[seen]), "types": int(seen.sum()), "tokens": int(counts.sum()), "n": n.tolist()}
    return _answers(asked, [{"a": _planes(counts[place[s]]), "b": np.packbits(owned[s]).tobytes()} for s in slices], model)


def _weigh(asked: pa.Table) -> pa.Table:
    """Totals (a, 0: never seen) and backoff weights (b) of a bucket's contexts."""
    asked, keys, _, place, slices = _gathered(asked)
    add = lambda name, kind: np.bincount(place, np.concatenate([_numbers(x, kind) for x in asked.column(name).to_pylist()]))
    total, kept, lower = add("a", np.int64), add("b", np.float64), add("c", np.float64)
    seen = total > 0
    # contexts whose every count stays whole
    full = seen & (kept >= total)
    total = total + full
    weight = np.ones(len(keys))
    weight[seen] = (total[seen] - kept[seen]) / total[seen] / (1 - lower[seen])
    total = total.astype(np.int64)
    model = {"keys": _pack_sorted(keys[seen]), "a": _planes(total[seen]), "b": _planes(weight[seen]), "types": int(seen.sum())}
    return _answers(asked, [{"a": _planes(total[place[s]]), "b": _planes(weight[place[s]])} for s in slices], model)


def _exchange(questions: DataFrame, answer, name: str) -> tuple[DataFrame, DataFrame]:
    """(answers, model): the questions of each order and bucket answered together; tables partitioned by what they
    are and by order."""
    spark, path = questions.sparkSession, f"{shared_dir(questions.sparkSession)}/{name}-{uuid.uuid4().hex}"
    questions.groupBy("order", "bucket").applyInArrow(answer, _ANSWER).write.partitionBy("part", "order").option("compression", "none").parquet(path)
    answers, model = (spark.read.schema(_ANSWER).option("basePath", path).parquet(f"{path}/part={x}") for x in ("answer", "model"))
    return answers, model


def _ask_counts(orders: int, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                texts = _texts(row)
                for order in range(1, orders + 1):
                    keys, _, place = texts.distinct(order)
                    train = texts.train if order == 1 else texts.train[texts.grams(order)[2]]
                    counts = np.bincount(place[train], minlength=len(keys)).astype(np.uint32)
                    rows = [{"order": order, "bucket": k, "chunk": row["chunk"], "keys": _pack_sorted(keys[s:e]), "a": _planes(counts[s:e])} for k, s, e in _edges(keys, bits)]
                    yield from pa.Table.from_pylist(rows, _QUESTIONS).to_batches()

    return ask


_QUESTIONS = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


class Known:
    """What a chunk has been told: training counts by order, and its contexts' totals and weights."""

    def __init__(self, told: pa.Table) -> None:
        self.rows: dict = {}
        for r in told.sort_by([("order", "ascending"), ("bucket", "ascending")]).to_pylist():
            self.rows.setdefault((r["what"], r["order"]), []).append(r)

    def counts(self, order: int) -> np.ndarray:
        return np.concatenate([_numbers(r["a"], np.int64) for r in self.rows["counts", order]])

    def owned(self, order: int) -> np.ndarray:
        counts = [(len(_numbers(r["a"], np.int64)), r["b"]) for r in self.rows["counts", order]]
        return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in counts]).astype(bool)

    def contexts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows["contexts", order]
        return np.concatenate([_numbers(r["a"], np.int64) for r in rows]), np.concatenate([_numbers(r["b"], np.float64) for r in rows])


def probabilities(texts: Texts, known: Known, stats: dict[int, dict], order: int) -> np.ndarray:
    """P of each token by n-grams of at most `order` words: the recursion from single words up."""
    d, total, unknown = single(stats[1])
    counts = known.counts(1)
    p = np.where(counts > 0, _discounted(counts, d) / total, unknown)[texts.tokens]
    for k in range(2, order + 1):
        _, _, place = texts.distinct(k)
        _, context, whole = texts.grams(k)
        counts = known.counts(k)[place]
        totals, weights = known.contexts(k)
        _, where = np.unique(context[whole], return_inverse=True)
        seen = counts > 0
        lower = weights[where] * p[whole]
        p[whole] = np.where(seen, _discounted(counts, discounts(stats[k]["n"])) / np.maximum(totals[where], 1), lower)
    return p


def _ask_contexts(order: int, stats: dict[int, dict], bits: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        texts, known = _texts(row), Known(right)
        p = probabilities(texts, known, stats, order - 1)
        _, first, _ = texts.distinct(order)
        _, context, whole = texts.grams(order)
        counts = known.counts(order)
        mine = known.owned(order) & (counts > 0)
        keys = np.unique(context[whole])
        at = np.searchsorted(keys, context[first[mine]])
        add = lambda x: np.bincount(at, x, minlength=len(keys))
        total, kept, lower = add(counts[mine]).astype(np.int64), add(_discounted(counts[mine], discounts(stats[order]["n"]))), add(p[first[mine]])
        rows = [{"order": order, "bucket": k, "chunk": row["chunk"], "keys": _pack_sorted(keys[s:e]), "a": _planes(total[s:e]), "b": _planes(kept[s:e]), "c": _planes(lower[s:e])} for k, s, e in _edges(keys, bits)]
        return pa.Table.from_pylist(rows, _QUESTIONS)

    return ask


def score(df: DataFrame, *, key: str = "doc_id", text: str = "text", held_out: Column | None = None, order: int = 2, chunk: int = CHUNK, bucket: int = BUCKET) -> tuple[DataFrame, dict[str, DataFrame]]:
    """((key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, the model's tables).

    Tokens are words, A-Z lower-cased, and one end for each text; held_out (null: no) says which rows are not learned
    from. score: log10 of the text's probability; base_score: that of single words, each count half a unit higher, with
    one event for all unknown words. Null and empty texts are an end alone. Rows without a key, or that repeat, count
    as any other. Without a training row, an unknown word's probability is 1. An empty table: no rows. held_out is
    evaluated on df's columns; other columns are not read. Tables: `counts` (order, bucket, packed keys and counts)
    and `contexts` (order, bucket, packed keys, totals and weights); see grams().
    """
    spark = df.sparkSession
    marked = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (held_out if held_out is not None else F.lit(False)).alias("_held"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state, name = bucketed(chunked(marked, "_key", "_text", F.col("c2_"), chunk), "lm-chunks", "chunk", buckets)
    tokens = state.agg(F.sum("n")).first()[0]
    kind = T.StructType([T.StructField(key, state.schema["keys"].dataType.elementType), *T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])
    if not tokens:
        none = spark.createDataFrame([], T.StructType.fromDDL(_ANSWER))
        return spark.createDataFrame([], kind), {"counts": none.select("order", "bucket", "keys", "a", "types"), "contexts": none.select("order", "bucket", "keys", "a", "b", "types")}
    bits = max(0, (tokens // bucket).bit_length())
    columns = ["chunk", "words", "tokens", "lengths", "held"]
    counts, model = _exchange(state.select(*columns).mapInArrow(_ask_counts(order, bits), _QUESTION), _count, "lm-counts")
    tables = {"counts": model.select("order", "bucket", "keys", "a", "types")}
    sums = [F.sum(F.get("n", i)).alias(f"n{i}") for i in range(GT_MOST + 1)]
    told = model.groupBy("order").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), *sums).collect()
    stats = {k: {"types": 0, "tokens": 0, "n": [0] * (GT_MOST + 1)} for k in range(1, order + 1)} | {r["order"]: {"types": r["types"], "tokens": r["tokens"], "n": [r[f"n{i}"] for i in range(GT_MOST + 1)]} for r in told}
    answers = [_told(counts, "counts")]
    contexts = []
    for k in range(2, order + 1):
        asked = _meet(state.select(*columns), answers, _ask_contexts(k, stats, bits), T.StructType.fromDDL(_QUESTION))
        found, model = _exchange(asked, _weigh, f"lm-contexts-{k}")
        contexts.append(model.select("order", "bucket", "keys", "a", "b", "types"))
        answers.append(_told(found, "contexts"))
    if contexts:
        tables["contexts"] = reduce(DataFrame.unionByName, contexts)
    n_train, types = stats[1]["tokens"], stats[1]["types"]

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).select(["words", "tokens", "lengths", "held"]).to_pylist()[0]
        texts, known = _texts(row), Known(right)
        count = known.counts(1)[texts.tokens]
        per = lambda x: np.add.reduceat(x, texts.first)
        base = per(np.log10((count + 0.5) / (n_train + 0.5 * (types + 1))))
        own = per(np.log10(probabilities(texts, known, stats, order)))
        keys, held = (left.column(c).combine_chunks().flatten() for c in ("keys", "held"))
        columns = [keys, held, pa.array(texts.lengths), pa.array(per((count > 0).astype(np.int64))), pa.array(np.full(len(held), n_train, np.int64)), pa.array(base), pa.array(own)]
        return pa.Table.from_arrays(columns, kind.names)

    result = cut(_meet(state, answers, evaluate, kind), "lm-scores")
    _forget(spark, name, state, answers)
    return result, tables


def _told(answers: DataFrame, what: str) -> DataFrame:
    return answers.select("chunk", F.lit(what).alias("what"), "order", "bucket", "a", "b")


def _meet(state: DataFrame, answers: Sequence[DataFrame], made, kind: T.StructType) -> DataFrame:
    """made(chunk's row, its answers) for every chunk. The chunks are bucketed, so only answers move."""
    told = reduce(DataFrame.unionByName, answers)
    return state.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(made, kind)


def _forget(spark: SparkSession, name: str, state: DataFrame, answers: Sequence[DataFrame]) -> None:
    """The chunks and the answers go; the model's tables stay."""
    discard(state, *answers)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def grams(table: DataFrame) -> DataFrame:
    """(order, key, a, b) of a packed model table, a row for each n-gram (a: its count) or context (a: its total, b:
    its backoff weight). key is the hash of the words as Texts.grams() makes it."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, a = _sorted(r["keys"]).view(np.int64), _numbers(r["a"], np.int64)
                weights = _numbers(r["b"], np.float64) if r.get("b") is not None else np.ones(len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), r["order"], np.int32)), pa.array(keys), pa.array(a), pa.array(weights)], ["order", "key", "a", "b"])

    return table.mapInArrow(unpack, "order int, key bigint, a bigint, b double")
