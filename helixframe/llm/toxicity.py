"""Toxicity over deobfuscated text.

Noisy channel: a token with look-alike signs, separators or stretched letters becomes a lattice of what each of its
characters may stand for, and Viterbi decoding under a character trigram model of the whole corpus picks the text most
likely meant. Restored words are scored by a lexicon of words and word beginnings learnt from labelled rows, and a
logistic function of the strongest hits gives the probability. A token of plain letters, none of which repeats the one
before it, has one path, itself; one with repeated letters is also read as written and with each letter once. A plain
number (digits, with a currency sign or separators) is a number and never decoded.

Bounds: the labelled sample is at most ``max_rows`` rows (those with the smallest hashes); the lexicon comes from it.
The character model counts all texts.

Edge cases: a null or empty text has no hit and gets the base score; repeated rows score alike; a null id or label
never trains; with no labelled rows, or labels of one kind, every score is the smoothed share of toxic rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .charlm import FIRST_HIGH, LAST_HIGH, OTHER, log_model, trigram_counts
from .common import Scratch, documents

MAX_ROWS = 20_000
PREFIXES = (4, 5, 6)
MIN_DOCS = 5
MIN_WEIGHT = 3.0
DOUBT = 2.0  # clean documents that any feature is taken to have besides those met

#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'`^:/\\,;=#·​‌‍﻿ ")
SWAP, STAY, DROP = math.log(0.95), math.log(0.005), math.log(1e-5)  # of a look-alike: meant a letter, itself, nothing
JOIN, SPLIT = math.log(0.5), math.log(0.5)  # of a separator: nothing was there, or a break
SINGLE, DOUBLE = math.log(0.3), math.log(0.7)  # of a letter that repeats the one before it: dropped, kept
STRETCHED, KEPT = math.log(0.95), math.log(0.05)  # from the third on: dropped, kept
SPACED = re.compile(r"(?<!\S)[^\W_](?:(?:\s+|[.\-_*])[^\W_]|(?:\s+|[.\-_*])?[@$!|+]){3,}(?!\S)|(?<!\S)\S(?:\s+\S){3,}(?!\S)")
PLAIN = re.compile(r"[^\W\d_]*\Z")
REPEAT = re.compile(r"([^\W\d_])\1+")
NUMBER = re.compile(r"[$€£+]?[\d.,:/\-]+[%€$£+]?\Z")
EDGE = re.compile(r"^[^\w@$!|+(<€£¡]+|[^\w@$€£]+$|^([!$@|+(<])\1+|([$@€£])\2+$")


def symbol(c: str) -> int:
    at = ord(c)
    return at - 96 if 97 <= at <= 122 else at - FIRST_HIGH + 27 if FIRST_HIGH <= at <= LAST_HIGH else OTHER if c.isalpha() else 0


def decode(observed: str, lm: np.ndarray, breaks: bool = True) -> str:
    """The most likely text behind ``observed`` (lower case); breaks are spaces. Time grows with its length. Without
    ``breaks`` the answer is one word, if there is one."""
    at: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    run = 0
    for c in observed:
        letter = c.isalpha()
        run = run + 1 if letter and c == last else 1
        options: list[tuple[str | None, float]]
        if letter:
            options = [(c, 0.0)] if run == 1 else [(c, DOUBLE), (None, SINGLE)] if run == 2 else [(c, KEPT), (None, STRETCHED)]
        elif c in LOOKALIKES:
            options = [(x, SWAP - math.log(len(LOOKALIKES[c]))) for x in LOOKALIKES[c]] + [(" ", STAY), (None, DROP)]
        elif c in SEPARATORS:
            options = [(None, JOIN), (" ", SPLIT)]
        else:
            options = [(" ", 0.0)]
        if not breaks and (own := [(x, cost) for x, cost in options if x != " "]):
            options = own
        last = c
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in at.items():
            for x, cost in options:
                if x is None or (x == " " and b == 0):
                    state, s, path = (a, b), score + cost, back
                else:
                    k = symbol(x) if x != " " else 0
                    state, s, path = (b, k), score + cost + float(lm[a, b, k]), (back, x)
                if state not in new or s > new[state][0]:
                    new[state] = (s, path)
        at = new
    best = max(at.items(), key=lambda v: v[1][0] + float(lm[v[0][0], v[0][1], 0]) * (v[0][1] != 0))[1][1]
    out = []
    while best is not None:
        best, x = best
        out.append(x)
    return "".join(reversed(out)).strip()


def might_be_word(token: str) -> bool:
    """Whether a token's letters and look-alikes can make a word of three letters or more."""
    return not NUMBER.match(token) and sum(c.isalpha() or c in LOOKALIKES for c in token) >= 3 and any(c.isalpha() for c in token) | any(c in LOOKALIKES and not c.isdigit() for c in token)


def despaced(m: re.Match) -> str:
    return " ".join(m[0].split())


class Restorer:
    """Words of a token as they were meant, remembered up to a limit."""

    def __init__(self, lm: np.ndarray, limit: int = 300_000):
        self.lm, self.limit, self.known = lm, limit, {}

    def words(self, token: str) -> list[str]:
        if token not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[token] = self._words(token)
        return self.known[token]

    def _words(self, token: str) -> list[str]:
        core = EDGE.sub("", token)
        if PLAIN.match(core):
            if not REPEAT.search(core):
                return [core] if core else []
            return list(dict.fromkeys([core, *decode(core, self.lm).split(), REPEAT.sub(r"\1", core)]))
        if " " not in core and not might_be_word(core):
            core = token  # signs at the edge may be letters
            if not might_be_word(core):
                return []
        out = decode(core, self.lm).split()
        whole = decode(core, self.lm, breaks=False)  # separators may have been put into one word
        return out if whole in out else [*out, *whole.split()]

    def first(self, token: str) -> str:
        core = EDGE.sub("", token)
        whole = decode(core, self.lm, breaks=False)
        return whole if " " not in whole else decode(core, self.lm)

    def text(self, text: str) -> str:
        """The whole text restored: the operator's readable output."""
        spread = SPACED.sub(lambda m: decode(despaced(m).lower(), self.lm), text)
        return re.sub(r"\S+", lambda m: m[0] if PLAIN.match(EDGE.sub("", m[0])) and not REPEAT.search(m[0].lower()) else self.first(m[0].lower()) or m[0], spread)


def features(word: str) -> list[str]:
    """The word, and its beginnings, marked by a star, as endings vary."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if len(word) > 2 else []


def tokens(text: str, restorer: Restorer) -> set[str]:
    """Distinct tokens in lower case, those that spacing hides too."""
    low = text.lower()
    out = set(low.split())
    out.update(w for m in SPACED.finditer(low) for w in decode(despaced(m), restorer.lm).split())
    return out


class Scorer:
    """lexicon: the weight of each feature; fit: the logistic function's weights."""

    def __init__(self, lm, lexicon: dict[str, float], fit: list[float], limit: int = 600_000):
        self.restorer, self.lexicon, self.fit, self.limit, self.hits, self.misses = Restorer(lm), lexicon, fit, limit, {}, set()
        self.heads = {f[:3] for f in lexicon}
        #: what a token of plain letters must begin with, each letter once, if a reading of it is to hit
        self.once = {REPEAT.sub(r"\1", f.rstrip("*"))[:3] for f in lexicon}

    def hopeless(self, token: str) -> bool:
        """Whether no reading of a token of plain letters can hit: readings differ in how often letters repeat only."""
        core = EDGE.sub("", token)
        if not PLAIN.match(core):
            return False
        c = REPEAT.sub(r"\1", core)
        return c[:3] not in self.once and c[:2] not in self.once and c[:1] not in self.once

    def hit(self, token: str) -> tuple | None:
        best = None if self.hopeless(token) else max(((self.lexicon[f], f) for w in self.restorer.words(token) if w[:3] in self.heads for f in features(w) if f in self.lexicon), default=None)
        if len(self.hits) + len(self.misses) >= self.limit:
            self.hits.clear()
            self.misses.clear()
        if best is None:
            self.misses.add(token)
        else:
            self.hits[token] = best
        return best

    def evidence(self, text: str) -> tuple[float, float, float]:
        known, found = self.hits, {}
        for t in tokens(text, self.restorer) - self.misses:
            h = known[t] if t in known else self.hit(t)
            if h is not None:
                found[h[1]] = h[0]
        top = sorted(found.values(), reverse=True)
        return (top[0], sum(top[1:3]), math.log1p(len(top) - 1)) if top else (0.0, 0.0, 0.0)

    def score(self, text: str) -> float:
        z = self.fit[0] + sum(w * x for w, x in zip(self.fit[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, start: list[float], ridge: float = 5.0, steps: int = 100) -> list[float]:
    """Newton's method with a ridge around ``start``, which is what naive Bayes says: the prior's log odds and each
    weight taken as it is. Few labels leave it there."""
    x = np.column_stack((np.ones(len(x)), x))
    w0 = np.array(start)
    w = w0.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - w0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def labelled(docs: DataFrame, labels: DataFrame, column: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, y of the labelled rows that may train: at most max_rows labels, those with the smallest hashes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "y")


def held_out(column: str):
    """Rows that never train."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_ROWS) -> Scorer:
    lm = log_model(trigram_counts(docs))
    sample = scratch.save(labelled(docs, labels, "toxic", max_rows).repartition(12), "toxic-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.countDistinct("text").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    base = [math.log((pos + 0.5) / (neg + 0.5)), 0.0, 0.0, 0.0] if pos + neg else [-2.0, 0.0, 0.0, 0.0]
    if not pos or not neg:
        return Scorer(lm, {}, base)
    sample = scratch.save(sample.distinct(), "toxic-texts")

    def count(batches, wanted: int, only: set | None):
        restorer, total = Restorer(lm), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if y == wanted:
                    own = {f for t in tokens(text or "", restorer) for w in restorer.words(t) for f in features(w)}
                    total.update(own if only is None else own & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["f", "n"])

    def counts(wanted: int, least: int, only: set | None = None) -> dict[str, int]:
        rows = sample.mapInArrow(lambda b: count(b, wanted, only), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r["f"]: r["n"] for r in rows.collect()}  # features of a bounded sample

    toxic = counts(1, MIN_DOCS)
    clean = counts(0, 1, set(toxic))
    weights = {f: math.log((t + 0.5) / (pos + 1)) - math.log((clean.get(f, 0) + DOUBT) / (neg + 1)) for f, t in toxic.items()}
    scorer = Scorer(lm, {f: w for f, w in weights.items() if w >= MIN_WEIGHT}, base)

    def evidence(batches):
        for batch in batches:
            e = [scorer.evidence(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in e], pa.float64()) for i in range(3)] + [batch.column(1)], names=["a", "b", "c", "y"])

    rows = sample.mapInArrow(evidence, "a double, b double, c double, y int").toPandas()
    scorer.fit = logistic(rows[["a", "b", "c"]].to_numpy(), rows["y"].to_numpy(), [base[0], 1.0, 1.0, 0.0])
    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, scratch: Scratch | None = None, name: str = "toxicity") -> DataFrame:
    """All columns of docs and, under ``name``, the probability of label 1."""
    scorer = train(docs, labels, scratch or Scratch(docs.sparkSession, "toxicity"), max_rows)
    return with_score(docs, name, lambda texts: [scorer.score(t) for t in texts])


def with_score(docs: DataFrame, name: str, score) -> DataFrame:
    """docs with one more column, a score of the texts; a column of that name would be replaced."""
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = score([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).selectExpr("cast(doc_id as long) as doc_id", "text")
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "toxicity"))

    out = with_score(docs, "score", lambda texts: [scorer.score(t) for t in texts])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
