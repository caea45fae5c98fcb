"""Repeated passages by sparse suffix arrays.

A passage is repeated where a window of ``length`` words occurs more than once, in one document or in several. The
first occurrence (smallest doc_id, then position) stays, the words of the others are repeated.

Not every suffix is kept: a window's minimiser is the position with the smallest hash of ``gram`` words in it, the first
of several, so equal windows keep the same position. Windows that a text itself has before are found in the text; what
is left is compared between texts, and such a window is a repeat of what the one before it is a repeat of. Suffixes are
dealt by the minimiser's hash, and those whose hash is alone go, before any text moves. Those left are sorted by their
words and compared with their neighbours: a run of suffixes with a common prefix of r words, extended to the left by
``length - r`` equal words, is a repeated window. Every split of the window between left and right is tried, so the
result is that of comparing all windows.

A hash with more than ``crowd`` suffixes (a passage that a third of all documents share) isn't sorted in one task. Its
suffixes are extended to whole windows, whose first occurrence is a grouped minimum with partial results before the
shuffle; the join that gives it back to the windows reads two written tables, so adaptive execution can split a window
that very many texts have.

Whole copies are found by their texts' hashes and take no part; each copy of at least ``length`` words is repeated as a
whole.

Words are what stands between ASCII blanks. They are compared by hash, 32 bits for each word of a window, or 128 bits for
a window as a whole.

Edge cases: null and empty texts and those shorter than a window have no repeated words, however often they occur;
rows with the same id and text are one document; a null id counts as the largest, ids are below 2^63 - 1; an empty table
gives an empty result; other columns are carried along by ``remove_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, one_row_each, row_keys
from .hashing import BASE, mix, run_hashes, word_hashes, words_of

LENGTH = 50
GRAM = 10
CROWD = 20_000  # suffixes of one hash that are sorted in one task
BUCKETS = 1 << 16
NO_ID = (1 << 63) - 1


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` words. Runs of one word come last in order, as they say little."""
    n = len(words) - gram + 1
    out, same = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(gram):
        out = out * np.uint64(BASE) + words[i : i + n]
        same &= words[i : i + n] == words[:n]
    return (mix(out) >> np.uint64(1)) | (same.astype(np.uint64) << np.uint64(63))


def minimisers(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, position, and the least and most words by which the windows of that minimiser begin before it."""
    if len(words) < length:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    g = gram_hashes(words, gram)
    at = sliding_window_view(g, length - gram + 1).argmin(1) + np.arange(len(words) - length + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return g[at[first]], at[first], at[first] - last, at[first] - first


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """128 bits for each window, as two columns."""
    return np.stack([run_hashes(words, length), run_hashes(mix(words + np.uint64(1)), length)], 1)


def own_repeats(words: np.ndarray, rows: tuple, length: int) -> tuple[tuple, np.ndarray]:
    """The suffixes without windows that the text itself has before, and those windows: start, number, first start."""
    m, p, lo, hi = rows
    none = np.empty((0, 3), np.int64)
    _, code, count = np.unique(m, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[code] > 1)
    if not len(again):
        return rows, none
    size = hi[again] - lo[again] + 1
    row = np.repeat(again, size)
    start = np.repeat(p[again] - hi[again], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    w = window_hashes(words, length)[start]
    _, first, back = np.unique(w.view("V16").ravel() if w.flags.c_contiguous else np.ascontiguousarray(w).view("V16").ravel(), return_index=True, return_inverse=True)
    source = start[first[back]]  # starts are in order, so the first of equals is the least
    new = source == start
    if new.all():
        return rows, none
    kept = np.ones(len(m), bool)
    kept[again] = False
    lo, hi = lo.copy(), hi.copy()
    offset = p[row] - start
    lo[again], hi[again] = length, -1
    np.minimum.at(lo, row[new], offset[new])
    np.maximum.at(hi, row[new], offset[new])
    kept[again] = hi[again] >= 0
    out = ~new & ((offset < lo[row]) | (offset > hi[row]))
    start, source = start[out], source[out]
    begins = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1] + 1)))) if len(start) else np.empty(0, np.int64)
    runs = np.stack([start[begins], np.diff(np.concatenate((begins, [len(start)]))), source[begins]], 1) if len(begins) else none
    return (m[kept], p[kept], lo[kept], hi[kept]), runs


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """m, th, p, doc, lo, hi: a row for each kept suffix. With a null m a run of windows that the text has before: p is
    its start, lo the number of windows, hi where they are first. A text that a task has met with a smaller id is
    skipped."""

    def run(batches):
        met: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                cols: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)]
                own: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)]
                for doc, th, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary())):
                    if met.get(th, doc + 1) <= doc:
                        continue
                    met[th] = doc
                    words = word_hashes(text.as_py() or b"")
                    (m, p, lo, hi), runs = own_repeats(words, minimisers(words, length, gram), length)
                    for col, x in zip(cols, (m.view(np.int64), np.full(len(m), th), p, np.full(len(m), doc), lo, hi)):
                        col.append(x)
                    for col, x in zip(own, (runs[:, 0], np.full(len(runs), th), runs[:, 0], np.full(len(runs), doc), runs[:, 1], runs[:, 2])):
                        col.append(x)
                names = ["m", "th", "p", "doc", "lo", "hi"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)
                rest = [pa.array(np.concatenate(c)) for c in own]
                if len(rest[0]):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(rest[0]), pa.int64()), *rest[1:]], names=names)

    return docs.select("doc", "th", "text").mapInArrow(run, "m long, th long, p long, doc long, lo long, hi long")


def _groups(batches, key: list[int]):
    """Tables that hold whole groups of rows with equal keys, from batches in the keys' order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows - 1, bool)
        for k in key:
            x = batch.column(k).to_numpy()
            differs |= x[1:] != x[:-1]
        same = bool(held) and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in key)
        cut = np.flatnonzero(differs) + 1
        if not same and held:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))])
            held = [batch.slice(int(cut[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def crowds(found: DataFrame, crowd: int) -> DataFrame:
    """m: the hashes with more than ``crowd`` suffixes. Counts of buckets (BUCKETS rows at most) tell where they can be."""
    bucket = F.pmod("m", F.lit(BUCKETS))
    full = found.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("bucket")
    some = found.select("m", bucket.alias("bucket")).join(F.broadcast(full), "bucket", "left_semi")
    return some.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("m")


def shared_suffixes(found: DataFrame, parts: int) -> DataFrame:
    """The suffixes whose hash occurs again, in another text or at another place. Of the same place in copies of a text
    the one with the smallest id stays."""

    def run(batches):
        last, pending = None, None  # the row before, and it as a row while its hash has been met once
        for batch in batches:
            if not batch.num_rows:
                continue
            m, th, p = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate(([last is None or m[0] != last[0]], m[1:] != m[:-1]))
            fresh = new | np.concatenate(([last is None or th[0] != last[1] or p[0] != last[2]], (th[1:] != th[:-1]) | (p[1:] != p[:-1])))
            own = np.flatnonzero(fresh)
            if len(own):
                starts = new[own]
                ends = np.concatenate((starts[1:], [False]))  # unknown for the last
                alone = starts & ends
                out = []
                if not starts[0] and pending is not None:
                    out.append(pending)
                pending = None
                if starts[-1]:
                    pending = batch.slice(int(own[-1]), 1)
                    alone[-1] = True
                out.append(batch.take(pa.array(own[~alone])))
                yield from out
            last = (m[-1], th[-1], p[-1])

    dealt = found.repartition(parts, "m").sortWithinPartitions("m", "th", "p", "doc")
    return dealt.mapInArrow(run, "m long, th long, p long, doc long, lo long, hi long")


def with_places(docs: DataFrame, suffixes: DataFrame, cols: list[str]) -> DataFrame:
    """doc, th, text and s, the suffixes of each text."""
    places = suffixes.groupBy("doc", "th").agg(F.collect_list(F.struct(*cols)).alias("s"))  # bounded by the text
    return docs.select("doc", "th", "text").join(places, ["doc", "th"])


def crowd_runs(docs: DataFrame, crowded: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Runs of single windows: doc, th, start, n, first_doc, first_th, first_start, of the suffixes of crowds."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[tuple] = []
                for doc, th, text, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()), part.column(3)):
                    p, lo, hi = (c.to_numpy() for c in s.values.flatten())
                    size = hi - lo + 1
                    start = np.repeat(p - hi, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    w = window_hashes(word_hashes(text.as_py()), length)[start].view(np.int64)
                    out.append((np.full(len(start), doc), np.full(len(start), th), start, w[:, 0], w[:, 1]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc", "th", "start", "w0", "w1"])

    once = crowded.groupBy("m", "th", "p").agg(F.min(F.struct("doc", "lo", "hi")).alias("x")).select("th", "p", "x.*")  # one of copies
    at = with_places(docs, once, ["p", "lo", "hi"])
    windows = scratch.save(at.mapInArrow(run, "doc long, th long, start long, w0 long, w1 long"), "windows")
    firsts = windows.groupBy("w0", "w1").agg(F.min(F.struct("doc", "th", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.save(firsts.select("w0", "w1", F.col("f.doc").alias("first_doc"), F.col("f.th").alias("first_th"), F.col("f.start").alias("first_start")), "firsts")
    same = (F.col("doc") == F.col("first_doc")) & (F.col("th") == F.col("first_th")) & (F.col("start") == F.col("first_start"))
    return windows.join(firsts, ["w0", "w1"]).where(~same).select("doc", "th", "start", F.lit(1).cast("long").alias("n"), "first_doc", "first_th", "first_start")


def contexts(docs: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """Each shared suffix with the hashes of the words around it: those before it, nearest first, then its own."""
    left = length - gram
    width = 4 * (left + length)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[tuple] = []
                for doc, th, text, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()), part.column(3)):
                    w = (word_hashes(text.as_py()) >> np.uint64(32)).astype(">u4")
                    w = np.concatenate((np.zeros(left, ">u4"), w, np.zeros(length, ">u4")))
                    rows = s.values.flatten()
                    p = rows[0].to_numpy()
                    around = np.concatenate((w[p[:, None] + (left - 1 - np.arange(left))], w[p[:, None] + left + np.arange(length)]), axis=1)
                    out.append((rows, np.full(len(p), doc), np.full(len(p), th), around.astype(">u4")))
                if not out:
                    continue
                raw = b"".join(x[3].tobytes() for x in out)
                n = len(raw) // width
                words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(raw)])
                cols = [pa.concat_arrays([x[0][i] for x in out]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([cols[1], pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out])), cols[0], cols[2], cols[3], words], names=["m", "doc", "th", "p", "lo", "hi", "words"])

    return with_places(docs, shared, ["p", "m", "lo", "hi"]).mapInArrow(run, "m long, doc long, th long, p long, lo long, hi long, words binary")


def compare(table: pa.Table, length: int, gram: int, sources: bool = True) -> dict:
    """Sorts the suffixes of whole groups, compares neighbours and extends runs to the left.

    Returns the repeated windows as runs: row, start, windows, row and start of the first occurrence. ``table`` is in
    the order of doc, th and p. Unless ``sources`` is set a run
    goes on whatever its windows' first occurrences are, so a suffix has few runs however many texts it shares words
    with."""
    left, n = length - gram, table.num_rows
    words = np.frombuffer(b"".join(table["words"].to_pylist()), ">u4").reshape(n, left + length)
    m, p, lo, hi = (table[c].to_numpy() for c in ("m", "p", "lo", "hi"))
    suffix = np.ascontiguousarray(np.concatenate((m.astype(">i8").view(">u4").reshape(n, 2), words[:, left:]), axis=1)).view(f"V{4 * (length + 2)}").ravel()
    order = np.argsort(suffix, kind="stable")
    own = words[order, left:]
    equal = (own[1:] == own[:-1]) & (m[order][1:] == m[order][:-1])[:, None]
    common = np.where(equal.all(1), length, equal.argmin(1))  # words that neighbours share
    before = np.zeros(n, np.uint64)
    rows, offs, firsts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for o in range(left + 1):
        if o:
            before = mix(before * np.uint64(BASE) + words[:, o - 1].astype(np.uint64) + np.uint64(1))
        run_of = np.empty(n, np.int64)
        run_of[order] = np.concatenate(([0], np.cumsum(common < length - o)))
        here = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(here):
            continue
        key = mix(before[here] + mix(run_of[here].astype(np.uint64) + np.uint64(1)))
        by = np.argsort(key, kind="stable")  # equal keys stay in the documents' order
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        rows.append(here[by[~new]])
        firsts.append(here[first[~new]])
        offs.append(np.full(int((~new).sum()), o))
    row, off, first = map(np.concatenate, (rows, offs, firsts))
    by = np.lexsort((-off, row))
    row, off, first = row[by], off[by], first[by]
    if not len(row):
        return {"row": row, "start": row, "n": row, "first": row, "first_start": row}
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] - 1) | (sources & (first[1:] != first[:-1]))))
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(row)])))
    return {"row": row[at], "start": p[row[at]] - off[at], "n": size, "first": first[at], "first_start": p[first[at]] - off[at]}


RUN = ["doc", "th", "start", "n", "first_doc", "first_th", "first_start"]


def repeats(rows: DataFrame, length: int, gram: int, parts: int, sources: bool) -> DataFrame:
    """Runs of repeated windows within groups of m, which have no more than a crowd's rows."""

    def run(batches):
        batch_rows = 0
        held: list[pa.Table] = []
        for group in _with_end(_groups(batches, [0])):
            if group is not None:
                held.append(group)
                batch_rows += group.num_rows
            if held and (group is None or batch_rows > 30_000):
                table = pa.concat_tables(held).combine_chunks()
                held, batch_rows = [], 0
                by = np.lexsort([table[c].to_numpy() for c in ("p", "th", "doc")])
                table = table.take(pa.array(by))
                key = np.stack([table[c].to_numpy() for c in ("th", "p", "doc")])
                once = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))  # repeated rows are one document
                table = table.filter(pa.array(once))
                found = compare(table, length, gram, sources)
                doc, th = table["doc"].to_numpy(), table["th"].to_numpy()
                cols = [doc[found["row"]], th[found["row"]], found["start"], found["n"], doc[found["first"]], th[found["first"]], found["first_start"]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=RUN)

    return rows.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(run, ", ".join(f"{c} long" for c in RUN))


def _with_end(groups):
    yield from groups
    yield None


def with_keys(docs: DataFrame) -> DataFrame:
    """doc, th (the hash of the text) and text; the first two identify a document."""
    doc = F.when(F.col("none"), NO_ID).otherwise(F.col("id")).alias("doc")
    return row_keys(docs).where(F.col("text").isNotNull()).select(doc, "th", "text")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, sources: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """RUN: runs of n repeated windows."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = with_keys(docs)
    every = scratch.save(suffixes(docs, length, gram), "suffixes")
    found = every.where("m is not null")
    full = scratch.save(crowds(found, crowd), "crowds")
    any_full = bool(full.take(1))
    shared = scratch.save(shared_suffixes(found.join(full, "m", "left_anti") if any_full else found, 2 * parts), "shared")
    runs = repeats(contexts(docs, shared, length, gram), length, gram, 4 * parts, sources)
    if any_full:
        runs = runs.unionByName(crowd_runs(docs, found.join(full, "m", "left_semi"), length, scratch))
    runs = scratch.save(runs, "runs")
    own = every.where("m is null").groupBy("th", "p", "lo", "hi").agg(F.min("doc").alias("doc"))  # one of copies
    own = own.select("doc", "th", F.col("p").alias("start"), F.col("lo").alias("n"), F.col("doc").alias("first_doc"), F.col("th").alias("first_th"), F.col("hi").alias("first_start"))
    runs = scratch.save(runs.unionByName(through_firsts(own, runs) if sources else own), "all")
    scratch.drop("suffixes", "crowds", "shared", "windows", "firsts", "runs")
    return runs


def through_firsts(own: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs against windows of the same text, as runs against what these are repeats of."""
    at = runs.select(F.col("doc").alias("first_doc"), F.col("th").alias("first_th"), F.col("start").alias("s"), F.col("n").alias("k"), F.col("first_doc").alias("to_doc"), F.col("first_th").alias("to_th"), F.col("first_start").alias("to_start"))
    hit = own.join(at, ["first_doc", "first_th"], "left").withColumn("hit", F.expr("s < first_start + n and first_start < s + k"))
    piece = F.when(F.col("hit"), F.struct("s", "k", "to_doc", "to_th", "to_start"))
    pieces = hit.groupBy(*RUN).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))  # bounded by the text

    def split(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                done, end = r["first_start"], r["first_start"] + r["n"]
                shift = r["start"] - r["first_start"]
                for x in r["pieces"]:
                    lo, hi = max(done, x["s"]), min(end, x["s"] + x["k"])
                    if lo < hi:
                        if done < lo:
                            out.append((r["doc"], r["th"], done + shift, lo - done, r["first_doc"], r["first_th"], done))
                        out.append((r["doc"], r["th"], lo + shift, hi - lo, x["to_doc"], x["to_th"], x["to_start"] + lo - x["s"]))
                        done = hi
                if done < end:
                    out.append((r["doc"], r["th"], done + shift, end - done, r["first_doc"], r["first_th"], done))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=RUN)

    return pieces.mapInArrow(split, ", ".join(f"{c} long" for c in RUN))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """doc, th, start, end, first_doc, first_start: repeated words [start, end) and where they occur first."""
    return joined_runs(repeated_runs(docs, length, gram, crowd, True, scratch), length)


def joined_runs(runs: DataFrame, length: int) -> DataFrame:
    """Runs of windows that go on, against the same first occurrence, as one span."""
    from pyspark.sql import Window

    shift = F.col("first_start") - F.col("start")
    own = Window.partitionBy("doc", "th").orderBy("start", "n", "first_doc", "first_start")  # bounded by the text
    goes_on = (F.lag("first_doc").over(own) == F.col("first_doc")) & (F.lag(shift).over(own) == shift) & (F.lag(F.col("start") + F.col("n")).over(own) >= F.col("start"))
    runs = runs.withColumn("part", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("part").over(own))
    return runs.groupBy("doc", "th", "part").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + length - 1).alias("end"), F.min("first_doc").alias("first_doc"), F.min("first_start").alias("first_start")
    ).drop("part")


def has_words(column: str, n: int):
    """Whether a text has n words; only few texts need more than their beginning for that."""
    count = lambda c: F.size(F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    return F.when(count(F.substring(column, 1, 16 * n)) > n, True).otherwise(count(F.col(column)) >= n)


def copies(docs: DataFrame, length: int) -> DataFrame:
    """doc, th, first_doc: texts of at least ``length`` words that an earlier document has as a whole."""
    own = with_keys(docs).select("doc", "th", F.crc32(F.col("text").cast("binary")).alias("crc"), F.octet_length("text").alias("bytes"), has_words("text", length).alias("long"))
    own = own.where("long").drop("long")
    least = own.groupBy("th", "crc", "bytes").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc")
    return own.join(least, ["th", "crc", "bytes"]).where("doc > first_doc").select("doc", "th", "first_doc").distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """docs with repeated words cut out of the texts; documents of which nothing is left go, and of rows equal in id and
    text one stays."""
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    names = docs.columns
    schema, at = docs.schema, names.index("text")
    runs = repeated_runs(docs, length, gram, crowd, False, scratch)
    span = F.struct("start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    spans = runs.groupBy("doc", "th").agg(F.collect_list(span).alias("cut"))  # bounded by the text
    whole = copies(docs, length).select("doc", "th", F.lit(True).alias("whole"))
    what = scratch.save(spans.join(whole, ["doc", "th"], "full").select("doc", "th", "cut", "whole"), "cuts")
    scratch.drop("all")
    none = F.col("doc") == NO_ID
    keyed = what.select(none.alias("none"), F.when(none, 0).otherwise(F.col("doc")).cast("long").alias("id"), "th", "cut", "whole")
    own = one_row_each(docs, keyed, "left").where("whole is null").select("row", "cut")

    def run(batches):
        for batch in batches:
            cols = batch.column(0).flatten()
            out, keep = [], []
            for text, cut in zip(cols[at], batch.column(1)):
                spans = cut.as_py()
                out.append(without(text.as_py(), [(c["start"], c["end"]) for c in spans]) if spans else text.as_py())
                keep.append(not spans or bool(out[-1].strip()))
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    out = own.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in spans and the blanks behind them."""
    raw = text.encode()
    start, _ = words_of(raw)
    keep, at = [], 0
    begin = np.concatenate((start, [len(raw)]))
    for a, b in sorted(spans):
        a, b = int(begin[a]), int(begin[min(b, len(start))])
        if a > at:
            keep.append(raw[at:a])
        at = max(at, b)
    return b"".join([*keep, raw[at:]]).decode()


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, n_words and, for where they occur first, first_doc_id and first_word. A copy of a whole text
    has no n_words."""
    docs = documents(spark, sf_dir)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    whole = copies(docs, LENGTH).select("doc", zero.alias("start"), none.alias("n_words"), "first_doc", zero.alias("first_start"))
    out = repeated_spans(docs).select("doc", "start", (F.col("end") - F.col("start")).alias("n_words"), "first_doc", "first_start").unionByName(whole)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.col("start").alias("start_word"), "n_words", real("first_doc").alias("first_doc_id"), F.col("first_start").alias("first_word"))
