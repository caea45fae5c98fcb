"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids, with the end id behind them, are cut at multiples of the window: full windows stand alone, and the
rest is cut once more if it is longer than half a window, as windows of two whole rests would leave 7 % empty. Rests
are dealt into groups of about ``group_size`` by their rows in a written table, so a rerun task gives the same groups,
and each group is packed by itself: every rest starts as a partial partition of k sums with one entry, the two
partitions with the widest spread merge largest against smallest, and k rises by one while a window would hold more
than its capacity.

Edge cases: a null or empty text has only the end id; very long texts give many full windows; repeated rows are packed
one by one; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec
from .common import Scratch, documents

WINDOW = 1024
END_ID = 0
GROUP_SIZE = 4000


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each size, and the windows' sums, by multiway differencing over k windows.

    A partial partition holds its nonzero sums in falling order and, for each, a chain of sizes; its spread is its
    largest sum less its smallest, which is 0 while some of the k are empty. The two with the widest spreads merge,
    largest against smallest. Sizes not yet merged are partitions with one sum; those that would only fill empty
    windows, one after the other, are taken together.
    """
    n = len(sizes)
    size = np.asarray(sizes, np.int64)
    follow = np.full(n, -1)
    single = np.argsort(-size, kind="stable")
    value = size[single]
    at = tie = 0
    heap: list[tuple] = []  # merged partitions: spread, tie, sums, heads and tails of the chains

    def take(room: int) -> np.ndarray:
        """The next single sizes, as long as no merged partition has a wider spread."""
        nonlocal at
        rival = -heap[0][0] if heap else 0
        end = min(at + room, int(np.searchsorted(-value, -rival, side="right")), n)
        end = max(end, at + 1)
        out, at = single[at:end], end
        return out

    def pop(room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if at < n and (not heap or (value[at] if k > 1 else 0) >= -heap[0][0]):
            own = take(room)
            return size[own], own, own
        return heapq.heappop(heap)[2:]

    while n - at + len(heap) > 1 or (heap and at < n) or (not heap and at < n):
        before = at
        sa, ha, ta = pop(k)
        if at - before > 1:
            pass  # single sizes that have met already
        elif len(sa) < k and at < n and (not heap or value[at] >= -heap[0][0]):
            own = take(k - len(sa))
            sa, ha, ta = np.concatenate((sa, size[own])), np.concatenate((ha, own)), np.concatenate((ta, own))
        elif heap or at < n:
            sb, hb, tb = pop(1)
            own = min(len(sb), k - len(sa))  # empty windows of the first take the largest of the second
            over = len(sb) - own
            if over:  # the largest of what is left meets the smallest of the first
                to = len(sa) - 1 - np.arange(over)
                sa, ta = sa.copy(), ta.copy()
                sa[to] += sb[own:]
                follow[ta[to]] = hb[own:]
                ta[to] = tb[own:]
            sa, ha, ta = (np.concatenate(x) for x in ((sa, sb[:own]), (ha, hb[:own]), (ta, tb[:own])))
        order = np.argsort(-sa, kind="stable")
        sa, ha, ta = sa[order], ha[order], ta[order]
        spread = int(sa[0]) - (int(sa[-1]) if len(sa) == k else 0)
        heapq.heappush(heap, (-spread, tie, sa, ha, ta))
        tie += 1
    window, sums = np.full(n, -1), heap[0][2] if heap else np.empty(0, np.int64)
    for w, i in enumerate(heap[0][3].tolist() if heap else ()):
        while i >= 0:
            window[i] = w
            i = follow[i]
    return window, sums


def pack_sizes(sizes: list[int], capacity: int = WINDOW) -> np.ndarray:
    """The window of each size; no window holds more than capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, sums = difference(sizes, k)
        if not len(sums) or sums[0] <= capacity:
            return window
        k += 1


@functools.cache
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks from the tokenizer's own file: in a byte-level vocabulary of this kind ids follow the order of merges,
    which is checked, so that merging the lowest id first is what the file asks for."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merged)):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}


class Encoder:
    """ids of the tokenizers library without special tokens around a text; those that stand in it count."""

    def __init__(self, code: Codec, added: dict[str, int]):
        self.code, self.added = code, added
        longest = sorted(added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None

    def encode(self, text: str) -> list[int]:
        if not self.split or not self.split.search(text):
            return self.code.encode(text)
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.code.encode(part)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    import public_tokenizers as tokenizers_files

    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens with conditions")
    return Encoder(Codec(vocabulary(path), tokenizers_files.PATTERN), {t["content"]: t["id"] for t in added})


PROBE = ["", " ", "a", "It's  we'll\n\n x", "Straße, ÀÉ ñandú  12 345!?", "tab\tend \n", "日本語 text", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext", "e\u0301 \u200b \u00a0 z", "aaaaaaaaaaaaaaaaaaaaaaaa 0000000"]


def agrees(path: str, texts: list[str] = PROBE) -> bool:
    """Whether the ids are those of the tokenizers library. Its own merging is about three times slower."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    return [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)] == [encoder(path).encode(t) for t in texts]


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    full = n // window * window
    out = [(at, window) for at in range(0, full, window)]
    if n - full > window // 2:
        out.append((full, window // 2))
        full += window // 2
    return [*out, (full, n - full)] if n > full else out


def token_pieces(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of at most a window: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * ids

    def run(batches):
        code = encoder(tokenizer_file)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                cols: list[list] = [[] for _ in range(5 + ids)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = array("I", code.encode(text.as_py() or "")).tobytes() + end
                    n = len(raw) // 4
                    for start, length in cuts(n, window):
                        own = raw[4 * start : 4 * (start + length)]
                        for col, x in zip(cols, (doc, start, length, zlib.crc32(own), n, np.frombuffer(own, "<u4"))):
                            col.append(x)
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, group_size: int = GROUP_SIZE, ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset. Full pieces have a sequence each; the others are packed in groups."""
    if not agrees(tokenizer_file):
        raise ValueError(f"{tokenizer_file}: other ids than the tokenizers library gives")
    scratch = Scratch(docs.sparkSession, "packing")  # the result reads it
    pieces = scratch.save(token_pieces(docs, tokenizer_file, window, end_id, ids), "pieces").withColumn("row", F.monotonically_increasing_id())
    rests = pieces.where(F.col("length") < window)
    groups = max(1, -(-rests.count() // group_size))
    # consecutive rows of the written table go to different groups
    dealt = rests.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    out = [f for f in pieces.schema if f.name != "row"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["row"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        size = table["length"].to_numpy()
        bins = pack_sizes(size.tolist(), window)
        order = np.argsort(bins, kind="stable")
        table, size, bins = table.take(pa.array(order)), size[order], bins[order]
        ends = np.cumsum(size)
        first = np.concatenate(([True], np.diff(bins) != 0))
        begin = ends - size
        offset = begin - np.maximum.accumulate(np.where(first, begin, 0))
        grp = int(table["grp"][0].as_py())
        return table.drop_columns(["row", "grp"]).append_column("sequence_id", pa.array(((grp << 24) + bins) * 2 + 1)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("grp").applyInArrow(pack, schema)
    full = pieces.where(F.col("length") == window).select(*(f.name for f in out), (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_files

    return pack_documents(documents(spark, sf_dir), tokenizers_files.path("byte_bpe_50k.json"))
