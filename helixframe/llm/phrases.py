"""Phrases of words that stand together more often than chance, by growing patterns to the right.

Patterns grow in two rounds. Words are counted first. In the first round every place where two frequent words stand sends
them, and a third that is frequent, to the pair's task; in the second every place where two frequent runs of three begin
in a row sends what stands there, up to five words, to the first run's task. Each task adds up what it can before the
shuffle. There the pointers to a prefix's occurrences are a range of sorted rows; its frequent extensions are ranges of
that range, and each is grown before the next. A prefix that may have a large share of all places is dealt over many
tasks by its extensions, whose counts are added up. Counts of phrases are exact: words are told apart by 64 bits, and two
frequent words of a language with one hash are an error.

What tasks are told is bounded: bit tables of fixed size that say which words and which runs of three may be frequent (on
very large tables they rule out less, and more rows are sent), and the hot ones of each, of which there can be two a task.

Edge cases: a null text is the empty text, a null language ``und``; repeated rows count each; a text without words adds
nothing; ties go to the phrase whose bytes come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents
from .hashing import _powers, mix

LONGEST = 5  # words of a phrase
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
RUN = 3  # words of what the first round looks for at most
TABLE_BITS = 26  # of a table of what may be frequent: 8 MB
PARTS = 1024  # a prefix with more than half a task's share of all places is dealt in so many parts
HELD = 400_000  # rows of a prefix that are worked on together; a task holds a quarter as many words
HELD_WINDOWS = 1_000_000  # places that a task adds up before it sends them
BLOCK = 1 << 20  # bytes of text that are looked at together

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 2 ends a piece, 1 ends a word.
_ENDS = np.zeros(256, np.uint8)
_ENDS[[9, 32]] = 1
_ENDS[[*b".,;:!?", *range(10, 14)]] = 2
_PIECE_END = re.compile(rb"[.,;:!?\n-\r]")


def tokenize(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, start and end of each word, and the number of the piece that it is in."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    kind = _ENDS[raw]
    inside = np.concatenate(([False], kind == 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return raw, edge[0::2], edge[1::2], np.cumsum(kind == 2)[edge[0::2]] if len(edge) else edge


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, never 0: differences of one running polynomial over the bytes."""
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return np.where(h == 0, np.uint64(1), h).view(np.int64)


def row_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    return h


def add_up(columns: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row and its count. Rows of equal hash that differ are kept apart."""
    h = row_hash(columns)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = h[order[1:]] != h[order[:-1]]
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(count[order], at) if len(at) else count[:0]


class _Sums:
    """Rows of a language that a task adds up while they are few enough; each language has a table of its own."""

    def __init__(self, width: int):
        self.width, self.held, self.rows = width, 0, {}

    def add(self, lang: str, columns: list[np.ndarray], count: np.ndarray) -> None:
        self.rows.setdefault(lang, []).append((columns, count))
        self.held += len(count)

    def settle(self) -> None:
        self.held = 0
        for lang, parts in self.rows.items():
            columns = [np.concatenate([p[0][i] for p in parts]) for i in range(self.width)]
            at, count = add_up(columns, np.concatenate([p[1] for p in parts]))
            self.rows[lang] = [([c[at] for c in columns], count)]
            self.held += len(count)

    def take(self):
        self.settle()
        for lang, parts in self.rows.items():
            for columns, count in parts:
                yield lang, columns, count
        self.rows, self.held = {}, 0


def _parts(raw: bytes):
    """Parts of about BLOCK bytes, cut where a piece ends."""
    at = 0
    while len(raw) - at > BLOCK and (cut := _PIECE_END.search(raw, at + BLOCK)):
        yield raw[at : cut.end()]
        at = cut.end()
    yield raw[at:]


def _texts(batches):
    """(lang, bytes of many texts): texts of a language are joined by a byte that ends a piece."""
    for batch in batches:
        got: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _parts(text.as_buffer().to_pybytes()):
                got.setdefault(lang, []).append(part)
                size += len(part)
                if size > BLOCK:
                    yield from ((k, b"\n".join(v)) for k, v in got.items())
                    got, size = {}, 0
        yield from ((k, b"\n".join(v)) for k, v in got.items())


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _batch(lang: str, columns: list[np.ndarray], more: list, names: list[str], step: int = 50_000):
    for i in range(0, len(columns[0]), step):
        n = len(columns[0][i : i + step])
        arrays = [pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), *(pa.array(c[i : i + step]) for c in [*columns, *more])]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", *names])


def count_words(docs: DataFrame) -> DataFrame:
    """lang, w1, word, c: how often each word occurs. A language's row with w1 = 0 has the number of all words."""
    names = ["w1", "word", "c"]

    def run(batches):
        words: dict[str, dict[int, list]] = {}
        totals: dict[str, int] = {}

        def send():
            for lang, found in words.items():
                keys = np.array(list(found), np.int64)
                yield from _batch(lang, [keys], [np.array([v[0] for v in found.values()], object), np.array([v[1] for v in found.values()], np.int64)], names)
            words.clear()

        for lang, text in _texts(batches):
            raw, start, end, _ = tokenize(text)
            h = hashes(raw, start, end)
            kept = words.setdefault(lang, {})
            totals[lang] = totals.get(lang, 0) + len(h)
            at, count = add_up([h], np.ones(len(h), np.int64))
            lower = raw.tobytes()
            for k, s, e, c in zip(h[at].tolist(), start[at].tolist(), end[at].tolist(), count.tolist()):
                if k in kept:
                    kept[k][1] += c
                else:
                    kept[k] = [lower[s:e].decode(), c]
            if sum(map(len, words.values())) > HELD // 4:
                yield from send()
        yield from send()
        for lang, n in totals.items():
            yield from _batch(lang, [np.zeros(1, np.int64)], [np.array([""], object), np.array([n])], names)

    rows = _own(docs).mapInArrow(run, "lang string, w1 long, word string, c long")
    return rows.groupBy("lang", "w1", "word").agg(F.sum("c").alias("c"))


def _key(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    raw = np.frombuffer(lang.encode() or b"\0", np.uint8)
    own = hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))
    return row_hash([np.repeat(own, len(columns[0])), *columns])


def _bit_table(df: DataFrame, words: list[str]) -> np.ndarray:
    """Bits of the keys of ``words``: rows of 64 bits are made by tasks and at most 2^TABLE_BITS / 64 come here."""

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]]
            names = np.array(batch.column(0).to_pylist(), object)
            for one in set(names.tolist()):
                key = _key(one, [c[names == one] for c in columns]) >> np.uint64(64 - TABLE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (key & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    rows = df.select("lang", *words).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def _listed(bits: np.ndarray, lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """Which rows a bit table may have."""
    key = _key(lang, columns) >> np.uint64(64 - TABLE_BITS)
    # a 64-bit row's bytes come lowest first
    return ((bits[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _hot(df: DataFrame, words: list[str], n: int):
    """Broadcast keys, sorted, of the rows of ``df`` with more than half a task's share of ``n``."""
    spark = df.sparkSession
    share = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col("c") * share > F.lit(n)).select("lang", *words).toArrow().to_pylist()
    return spark.sparkContext.broadcast(np.sort(np.array([_key(r["lang"], [np.array([r[w]]) for w in words])[0] for r in rows], np.uint64)))


def _is_hot(many: np.ndarray, key: np.ndarray) -> np.ndarray:
    return many[np.minimum(np.searchsorted(many, key), len(many) - 1)] == key if len(many) else np.zeros(len(key), bool)


def _sent(sums: _Sums, is_hot, dealt: int):
    """What a task has added up, with its part: 0, or by the words behind the first ``dealt`` where ``is_hot`` says so. It
    is sorted: equal words side by side take less room in a shuffle, and whoever gets them merges what is in order."""
    for lang, columns, count in sums.take():
        order = np.lexsort(columns[::-1])
        columns, count = [c[order] for c in columns], count[order]
        part = np.where(is_hot(lang, columns), 1 + (row_hash(columns[dealt:]) % np.uint64(PARTS)).astype(np.int32), 0).astype(np.int32)
        yield from _batch(lang, columns, [part, count], [*WORDS[: sums.width], "part", "c"])


def project_words(docs: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """lang, w1 to w3, part, c: each place where two of the ``words`` stand, and the third if it is one, else 0, with the
    number of equal ones in a task. ``part`` is 0 unless both words are hot, as no other pair can be."""
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(words, ["w1"]))
    hot = _hot(words, ["w1"], n_words)

    def is_hot(lang, columns):
        return _is_hot(hot.value, _key(lang, columns[:1])) & _is_hot(hot.value, _key(lang, columns[1:2]))

    def run(batches):
        bits = table.value
        sums = _Sums(RUN)
        for lang, text in _texts(batches):
            raw, start, end, piece = tokenize(text)
            h = hashes(raw, start, end)
            if len(h) < 2:
                continue
            some = _listed(bits, lang, [h])
            goes_on = np.append((piece[1:] == piece[:-1]) & some[1:] & some[:-1], False)
            at = np.flatnonzero(goes_on)
            columns = [h[at], h[at + 1], np.where(goes_on[at + 1], np.append(h, 0)[at + 2], 0)]
            one, count = add_up(columns, np.ones(len(at), np.int64))
            sums.add(lang, [c[one] for c in columns], count)
            if sums.held > HELD_WINDOWS:
                sums.settle()
                if sums.held > HELD_WINDOWS // 2:
                    yield from _sent(sums, is_hot, 2)
        yield from _sent(sums, is_hot, 2)

    return _own(docs).mapInArrow(run, "lang string, " + ", ".join(f"{w} long" for w in WORDS[:RUN]) + ", part int, c long")


def project(docs: DataFrame, triples: DataFrame, n_places: int) -> DataFrame:
    """lang, w1 to w5, part, c: what stands right of each place where two of the ``triples`` begin in a row, 0 where it
    ends, with the number of equal ones in a task. ``part`` is 0 for a prefix that one task holds."""
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(triples, WORDS[:RUN]))
    hot = _hot(triples, WORDS[:RUN], n_places)

    def is_hot(lang, columns):
        return _is_hot(hot.value, _key(lang, columns[:RUN]))

    def run(batches):
        bits = table.value
        sums = _Sums(LONGEST)
        for lang, text in _texts(batches):
            raw, start, end, piece = tokenize(text)
            h = hashes(raw, start, end)
            if len(h) <= RUN:
                continue
            # places whose run of three is in a piece and may be frequent
            goes_on = (piece[2:] == piece[:-2]) & _listed(bits, lang, [h[:-2], h[1:-1], h[2:]])
            goes_on = np.concatenate((goes_on, np.zeros(LONGEST, bool)))
            at = np.flatnonzero(goes_on[: len(h)] & goes_on[1 : len(h) + 1])
            padded = np.concatenate((h, np.zeros(LONGEST, np.int64)))
            columns, open_ = [padded[at + i] for i in range(RUN + 1)], np.ones(len(at), bool)
            for i in range(RUN + 1, LONGEST):
                open_ &= goes_on[at + i + 1 - RUN]
                columns.append(np.where(open_, padded[at + i], 0))
            one, count = add_up(columns, np.ones(len(at), np.int64))
            sums.add(lang, [c[one] for c in columns], count)
            if sums.held > HELD_WINDOWS:
                sums.settle()
                if sums.held > HELD_WINDOWS // 2:
                    yield from _sent(sums, is_hot, RUN)
        yield from _sent(sums, is_hot, RUN)

    return _own(docs).mapInArrow(run, "lang string, " + ", ".join(f"{w} long" for w in WORDS) + ", part int, c long")


def grow(rows: list[np.ndarray], count: np.ndarray, first: int, last: int, length: int, least: int, found: list) -> None:
    """Adds (place of a row, length, count) of each pattern of at least ``least`` occurrences that extends the first
    ``length`` words of the sorted rows first to last, each with its own extensions before the next."""
    if length == len(rows):
        return
    word = rows[length][first:last]
    at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) + first
    sums = np.add.reduceat(count, np.append(at, last))[:-1] if last < len(count) else np.add.reduceat(count, at)
    ends = np.append(at[1:], last)
    for i in np.flatnonzero((sums >= least) & (rows[length][at] != 0)).tolist():
        found.append((at[i], length + 1, sums[i]))
        grow(rows, count, at[i], ends[i], length + 1, least, found)


def grow_all(rows: list[np.ndarray], count: np.ndarray, own: np.ndarray, new: np.ndarray, length: int):
    """Places, lengths and counts of every pattern, whatever its count, that extends the first ``length`` words of the
    sorted rows ``own``, where a prefix begins at ``new``."""
    new, count = new[own], count[own]
    for i in range(length, len(rows)):
        word = rows[i][own]
        new[1:] |= word[1:] != word[:-1]
        at = np.flatnonzero(new)
        sums = np.add.reduceat(count, at)
        some = word[at] != 0
        yield own[at[some]], np.full(int(some.sum()), i + 1), sums[some]


def grow_prefixes(projected: DataFrame, least: int, held: int = HELD, dealt: int = 2, known: int = 2) -> DataFrame:
    """lang, w1 to w5, c of phrases of more than ``known`` words. Rows are dealt by their first ``dealt`` words, a prefix,
    and come sorted; where a prefix has more than ``held`` rows they are worked on in runs. Runs and parts of a hot prefix
    give all that they find, to be added up."""
    given = [w for w in WORDS if w in projected.columns]
    by = [*WORDS[:dealt], "part", "lang"]
    rows = projected.repartition(*by).sortWithinPartitions(*by, *given[dealt:])

    def run(batches):
        waiting, n, due, begun = [], 0, held // 8, None
        for batch in chain(batches, (None,)):
            if batch is not None:
                waiting.append(batch)
                n += batch.num_rows
                if n < due:
                    continue
            if not n:
                continue
            table = pa.Table.from_batches(waiting)
            words = [table[w].to_numpy() for w in given]
            part, count = table["part"].to_numpy(), table["c"].to_numpy()
            langs = pa.chunked_array(table["lang"]).combine_chunks().dictionary_encode()
            lang, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            new = np.ones(n, bool)
            new[1:] = lang[1:] != lang[:-1]
            for c in (*words[:dealt], part):
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            last = batch is None
            cut_off = not last and len(at) == 1 and n > held
            end = n if last or cut_off else int(at[-1])
            ends = np.append(at[1:], n)
            whole = ends <= end
            at, ends = at[whole], ends[whole]
            if len(at):
                in_parts = (part[at] != 0) | cut_off
                in_parts[0] |= (names[lang[0]], *(w[0] for w in words[:dealt]), part[0]) == begun
                own = np.flatnonzero(np.repeat(in_parts, ends - at))
                found: list = []
                for i in np.flatnonzero(~in_parts & (np.add.reduceat(count[:end], at) >= least)).tolist():
                    grow(words, count, at[i], ends[i], known, least, found)
                some = [tuple(np.array(x, np.int64) for x in zip(*found))] if found else []
                some += grow_all(words, count, own, new, known) if len(own) else []
                for place, length, c in some:
                    out = [np.where(length > i, words[i][place], 0) if i < len(words) else np.zeros(len(place), np.int64) for i in range(LONGEST)]
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[place])), *map(pa.array, out), pa.array(c)], names=["lang", *WORDS, "c"])
            if cut_off:
                begun = (names[lang[0]], *(w[0] for w in words[:dealt]), part[0])
            waiting, n = table.slice(end).to_batches(), n - end
            due = max(held // 8, 2 * n)

    return rows.mapInArrow(run, "lang string, " + ", ".join(f"{w} long" for w in WORDS) + ", c long")


def frequent_phrases(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 1 to 5 words with at least ``least`` occurrences (lang, w1 to w5, c), the frequent words (lang, w1,
    word) and each language's number of words (lang, n)."""
    counted = scratch.save(count_words(docs).where((F.col("c") >= least) | (F.col("w1") == 0)), "words")
    total = counted.where("w1 = 0").select("lang", F.col("c").alias("n"))
    words = counted.where((F.col("w1") != 0) & (F.col("c") >= least))
    names = words.select("lang", "w1", "word")
    if names.groupBy("lang", "w1").count().where("count > 1").limit(1).count():
        raise ValueError("two frequent words of a language have one hash")

    def grown(projected: DataFrame, dealt: int, known: int) -> DataFrame:
        found = grow_prefixes(projected, least, dealt=dealt, known=known)
        return found.groupBy("lang", *WORDS).agg(F.sum("c").alias("c")).where(F.col("c") >= least)

    n_words = total.agg(F.sum("n")).first()[0] or 0
    runs = scratch.save(grown(project_words(docs, words, n_words), 2, 1), "runs")
    triples = runs.where("w3 <> 0")
    n_places = triples.agg(F.sum("c")).first()[0] or 0
    longer = grown(project(docs, triples, n_places), RUN, RUN)
    words = words.select("lang", "w1", *(F.lit(0).cast("long").alias(w) for w in WORDS[1:]), "c")
    return scratch.save(words.unionByName(runs).unionByName(longer), "phrases"), names, total


def _words(length: int, start: int = 0):
    """The phrase of ``length`` words that begins behind ``start`` words, as columns."""
    zero = F.lit(0).cast("long")
    return [F.col(WORDS[start + i]) if i < length else zero for i in range(LONGEST)]


def score_phrases(phrases: DataFrame, names: DataFrame, total: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that are not part of one as frequent."""
    size = sum(((F.col(w) != 0).cast("int") for w in WORDS), F.lit(0))
    cand = phrases.where("w2 <> 0").withColumn("size", size)
    # a row for each cut of a candidate: the part before it and the rest
    cuts = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            cuts.append(F.when(F.col("size") == n, F.struct(F.lit(k).alias("k"), F.struct(*(c.alias(w) for c, w in zip(_words(k), WORDS))).alias("left"), F.struct(*(c.alias(w) for c, w in zip(_words(n - k, k), WORDS))).alias("right"))))
    cut = cand.select("*", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("cut"))
    known = phrases.select("lang", *WORDS, F.col("c").alias("f"))
    cut = cut.select("lang", F.struct(*WORDS).alias("own"), F.col("c").alias("a"), "size", "cut.*")
    left = known.select(F.col("lang"), F.struct(*WORDS).alias("left"), F.col("f").alias("l"))
    right = known.select(F.col("lang"), F.struct(*WORDS).alias("right"), F.col("f").alias("r"))
    cut = scratch.save(cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(F.broadcast(total), "lang"), "cuts")
    long = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    over, under = (F.lit(1000).cast("decimal(4,0)") * (long("a", 16) * long("n", 16))), long("l", 18) * long("r", 18)
    cut = cut.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under")).drop("over", "under")
    best = cut.groupBy("lang", "own").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b"))
    # a part one word shorter with no more occurrences than its whole goes; shorter parts then go by their own
    part = F.when(F.col("k") == 1, F.col("right")).otherwise(F.col("left"))
    ends = cut.where("size > 2 and (k = 1 or k = size - 1)").select("lang", "a", part.alias("own"))
    whole = ends.groupBy("lang", "own").agg(F.max("a").alias("whole"))
    best = best.join(whole, ["lang", "own"], "left").where("whole is null or whole < b.a").select("lang", "own", "b.*")
    # words for hashes: a row for each word of a candidate
    spelt = best.select("lang", "own", F.posexplode(F.array(*(F.col("own")[w] for w in WORDS))).alias("i", "w1")).where("w1 <> 0")
    spelt = spelt.join(names, ["lang", "w1"]).groupBy("lang", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return best.join(spelt, ["lang", "own"]).select("lang", "phrase", "a", "l", "r", "n", "score")


def mine_phrases(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    scored = score_phrases(*frequent_phrases(docs, least, scratch), scratch)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of parts of a language first, so that no task sorts a language
    part = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return scratch.save(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "best")


#: The query over, in another form: all runs of one to five words are listed, and all parts of each candidate.
OP13_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') lang, unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) piece
    from documents
), words as (
    select lang, [x for x in string_split(replace(piece, chr(9), ' '), ' ') if x <> ''] w from pieces
), runs as (
    select lang, w, m, unnest(range(1, len(w) - m + 2)) i from words cross join (select unnest(range(1, 6)) m) where len(w) >= m
), f as materialized (
    select lang, array_to_string(p, ' ') p, p w, f from (select lang, w[i : i + m - 1] p, count(*) f from runs group by all)
), n as materialized (
    select lang, sum(f)::bigint n from f where len(w) = 1 group by lang
), cand as materialized (
    select lang, p, w, f a from f where len(w) > 1 and f >= 100
), keys as materialized (
    select lang, p, a, k, array_to_string(w[1 : k], ' ') lp, array_to_string(w[k + 1 : len(w)], ' ') rp from cand cross join (select unnest(range(1, 5)) k) where k < len(w)
), cuts as materialized (
    select c.lang, c.p, a, k, l.f l, r.f r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint score
    from keys c join n on n.lang = c.lang join f l on l.lang = c.lang and l.p = c.lp join f r on r.lang = c.lang and r.p = c.rp
), parts as materialized (
    select lang, array_to_string(w[i : i + m - 1], ' ') p, max(a) whole
    from (select lang, w, a, m, unnest(range(1, len(w) - m + 2)) i from cand cross join (select unnest(range(2, 5)) m) where len(w) > m) group by all
), best as (
    select *, row_number() over (partition by lang, p order by score, k) o from cuts
), ranked as (
    select b.lang, b.p phrase, a, l, r, n, score
    from best b left join parts q on q.lang = b.lang and q.p = b.p where o = 1 and (whole is null or 100 * whole < 100 * a)
)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score from ranked) where rank <= 2000
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir))
