"""Models behind plain functions: deterministic stand-ins by default, any callable on Columns in their place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens import schemas
from stratalens.functions import tags, vocab
from stratalens.functions import text as T

Model = Callable[[Sequence[str]], np.ndarray]

def embed(text: Column, size: int = 64) -> Column:
    """A hashing embedder: counts of words by hash, of length one; zero for no words. Words are split and hashed as
    Column expressions, and counted once over Arrow batches."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")

    @F.arrow_udf("array<float>")
    def count(slots: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(slots).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        counts = np.bincount(rows * size + slots.flatten().to_numpy(zero_copy_only=False), minlength=len(lengths) * size).reshape(-1, size)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return _vectors(counts / np.where(norm == 0, 1, norm))

    return count(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")))


def _vectors(x: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


_LOADED: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    """The worker's model of that name: this module's table outlives the functions that are sent to the worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def embedder(load: Callable[[], Model], size: int, most_words: int = 4096) -> Callable[[Column], Column]:
    """A model in place of embed(): load() gives a function of texts that returns their vectors, of `size` components.

    A Python worker loads the model once and keeps it for all its tasks and batches. Texts go to it in batches of at
    most most_words words, counting each as long as the longest of its batch (a longer text goes alone), shortest first,
    so that batches are even and little is padded. Null and blank texts have no vector. A model that gives another
    number of vectors, or vectors of another size, is an error.
    """
    name = uuid.uuid4().hex

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = b.to_pylist()
            length = [len(t.split()) if t else 0 for t in texts]
            order = sorted((i for i, n in enumerate(length) if n), key=length.__getitem__)
            found: list = [None] * len(texts)
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and (end - at + 1) * length[order[end]] <= most_words:
                    end += 1
                vectors = np.asarray(_model(name, load)([texts[i] for i in order[at:end]]), np.float32)
                if vectors.shape != (end - at, size):
                    raise ValueError(f"the model gave vectors of shape {vectors.shape}, not {(end - at, size)}")
                for i, v in zip(order[at:end], vectors, strict=True):
                    found[i] = v
                at = end
            yield pa.array(found, pa.list_(pa.float32()))

    return run


def summary(text: Column, most: int = 8000, shown: int = 500) -> Column:
    """The first sentences that fit; without a model, the beginning and an ellipsis."""
    return T.truncate(F.substring(F.coalesce(text, F.lit("")), 1, most), shown)


def extract(text: Column) -> Column:
    """The reply's structure, from dictionaries: countries, products none, sectors by affected areas, no suppliers."""
    none = F.array().cast("array<string>")
    head = F.substring(F.coalesce(text, F.lit("")), 1, 10_000)
    relations = F.array().cast("array<struct<source: string, target: string, type: string>>")
    return F.struct(none.alias("suppliers"), tags.labels(head, vocab.REGIONS).alias("countries"), none.alias("products"), tags.labels(head, vocab.AREAS).alias("sectors"), relations.alias("relationships"))


def parse_extracted(reply: Column) -> Column:
    """A model's JSON reply; lists that are missing, and replies that are no JSON, give empty lists."""
    got = F.from_json(reply, schemas.EXTRACTED)
    none = F.array().cast("array<string>")
    relations = F.array().cast("array<struct<source: string, target: string, type: string>>")
    return F.struct(*[F.coalesce(got[c], none).alias(c) for c in ("suppliers", "countries", "products", "sectors")], F.coalesce(got["relationships"], relations).alias("relationships"))


def parse_advice(reply: Column) -> Column:
    """A model's recommendation; an action that is none of buy, sell, hold or neutral is neutral."""
    got = F.from_json(reply, schemas.ADVICE)
    action = F.lower(F.coalesce(got["action"], F.lit("neutral")))
    return F.struct(F.when(action.isin("buy", "sell", "hold", "neutral"), action).otherwise("neutral").alias("action"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(got["kelly_fraction"], F.lit(0.0)).alias("kelly_fraction"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning"))
