"""A character trigram model over a whole corpus."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_HIGH, LAST_HIGH = 0xDF, 0xFF  # letters of the Latin-1 supplement have symbols of their own
OTHER = 26 + LAST_HIGH - FIRST_HIGH + 2
SYMBOLS = OTHER + 1  # 0 is anything but a letter


@functools.cache
def symbol_table() -> np.ndarray:
    """The symbol of each code point below 0x3000; case is folded, other letters share a symbol."""
    out = np.zeros(0x3000, np.int32)
    for point in range(len(out)):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            at = ord(low) if len(low) == 1 else point
            out[point] = at - 96 if 97 <= at <= 122 else at - FIRST_HIGH + 27 if FIRST_HIGH <= at <= LAST_HIGH else OTHER
    return out


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return symbol_table()[np.minimum(points, 0x2FFF)]


def count_trigrams(texts: list[str], total: np.ndarray) -> None:
    """Adds the texts' trigrams to ``total``, a few million characters at a time."""
    part, length = [], 0
    for i, text in enumerate(texts):
        part.append(text)
        length += len(text)
        if length > 2_000_000 or i + 1 == len(texts):
            s = symbols("\n\n" + "\n\n".join(part) + "\n\n")
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
            part, length = [], 0


def trigram_counts_by(docs: DataFrame, key: str) -> dict[str, np.ndarray]:
    """Counts [a, b, c] over all texts of each value of ``key`` that isn't null. Each task adds up its own; at most
    SYMBOLS ** 3 sums a value reach the driver."""
    size = SYMBOLS**3

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            own: dict[str, list[str]] = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.setdefault(k, []).append(text or "")
            for k, texts in own.items():
                count_trigrams(texts, totals.setdefault(k, np.zeros(size, np.int64)))
        for k, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(found), pa.array(total[found])], names=["key", "code", "n"])

    own = docs.select(F.col(key).cast("string").alias("key"), "text").where("key is not null")
    rows = own.mapInArrow(run, "key string, code long, n long").groupBy("key", "code").agg(F.sum("n").alias("n")).toPandas()
    out: dict[str, np.ndarray] = {}
    for k, part in rows.groupby("key"):
        out[k] = np.zeros(size, np.int64)
        out[k][part["code"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
    return {k: v.reshape(SYMBOLS, SYMBOLS, SYMBOLS) for k, v in sorted(out.items())}


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts [a, b, c] over all texts."""
    found = trigram_counts_by(docs.select("text", F.lit("").alias("all")), "all")
    return found.get("", np.zeros((SYMBOLS,) * 3, np.int64))


def log_model(counts: np.ndarray, keep: float = 4.0) -> np.ndarray:
    """log P(c | a, b), each order smoothed by the one below it."""
    one = counts.sum((0, 1)) + 1.0
    p = one / one.sum()
    two = counts.sum(0)
    p = (two + keep * p) / (two.sum(1, keepdims=True) + keep)
    p = (counts + keep * p[None]) / (counts.sum(2, keepdims=True) + keep)
    return np.log(p).astype(np.float32)
