"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into ``segments`` parts, so few that of two fingerprints within ``max_bits`` one part
differs by one bit at most (max_bits < 2 * segments). Each part is indexed once for each of its bits with that bit
wild: 64 keys for a fingerprint. Two parts that differ in one bit share the key with this bit wild, equal parts share
all. Fingerprints that share a key are compared, and links become components.

Rows are first reduced to distinct fingerprints, so that copies, however many, are one entry. Within a key, links are
found by a search that grows components and emits one link for each new member, never all pairs, and of these only the
links whose two ends share no key before this one. In a key with many different fingerprints the bits that vary are cut
and indexed in the same way once more, so that few are compared.

``near_copies`` uses the same index for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Such sets differ in 15 % of the bits of their fingerprints at most, on average, which no 64 bits can tell from chance:
its fingerprints have 256 bits in 14 segments, so that differences in up to 27 bits are certain to be met, and those
that similarity 0.8 gives nearly always. Pairs that meet and come near as a whole are checked exactly on their sets.

Edge cases: a null text counts as empty; a text without words has fingerprint zero (an empty set) and links like any
other; fewer words than a shingle make one shingle; repeated rows get the same component; null ids take part, and a
component's id is its smallest id that isn't null; an empty table gives an empty result; other columns are carried along
by ``one_of_each`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, ROW_SCHEMA, Scratch, connected_components, documents, one_row_each, row_keys
from .hashing import BASE, mix, word_hashes

WIDTH = 4
MAX_BITS = 4
SEGMENTS = 3

SET_WIDTH = 5
SIMILAR = 0.8
WIDE = 256  # bits of a near copy's fingerprint
WIDE_SEGMENTS = 14
NEAR_BITS = 33  # of 128: at similarity 0.8 two texts differ in 19.4 of them, with a deviation of 4.1
KEY_ROWS = 2048  # sets whose keys a task makes
CROWD = 20_000  # rows of one key that a task takes
BLOCKS = 3  # of a segment: keys whose wild bits are in one block are dealt together


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """A bit is one if it is set in more than half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    n = len(words) - width + 1
    if n <= 1:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    s, e = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 4096):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(s[at : at + 4096], e[at : at + 4096])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, "doc_id long, th long, fp long")


def segment_bounds(segments: int, bits: int = 64) -> list[tuple[int, int]]:
    cuts = [round(bits * i / segments) for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:]))


def wildcard_keys(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """key, fp: one row for each wildcard bit. The key holds the bit's place and its segment with that bit cleared."""
    masked = None
    for lo, hi in segment_bounds(segments):
        mask = ((1 << (hi - lo)) - 1) << lo
        value = F.expr(f"shiftrightunsigned(fp & {mask - (1 << 64) if mask >> 63 else mask}L & ~shiftleft(1L, w), {lo})")
        masked = F.when((F.col("w") >= lo) & (F.col("w") < hi), value) if masked is None else masked.when((F.col("w") >= lo) & (F.col("w") < hi), value)
    width = max(hi - lo for lo, hi in segment_bounds(segments))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")).select((F.expr(f"shiftleft(cast(w as long), {width})") + masked).alias("key"), "fp")


def forest(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs (rows of two) that join what the pairs before them leave apart."""
    ids, at = np.unique(pairs, return_inverse=True)
    root, kept = list(range(len(ids))), []
    for i, (a, b) in enumerate(at.reshape(-1, 2).tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            kept.append(i)
    return pairs[kept]


def link_run(fps: np.ndarray, max_bits: int, most: int | None = None) -> np.ndarray | None:
    """Links, rows of two, that join the distinct fingerprints of one key into their components: a search from each
    unseen fingerprint compares it with those unseen still, so each member yields one link. None if that takes more than
    ``most`` comparisons."""
    rest, out, done = fps, [np.empty((0, 2), np.uint64)], 0
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            done += len(rest)
            if most is not None and done > most:
                return None
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                out.append(np.stack((np.full(len(found), x), found), 1))
                frontier += list(found)
                rest = rest[~near]
    return np.concatenate(out)


def link_group(fps: np.ndarray, max_bits: int, segments: int, few: int = 256) -> np.ndarray:
    """``link_run`` for many fingerprints: unless a search ends soon, as in a crowd of near ones, it compares those that
    agree in a part of the varying bits, but for one bit. What the parts find is cut to one link for each member too."""
    if len(fps) <= few:
        return link_run(fps, max_bits)
    if (out := link_run(fps, max_bits, few * len(fps))) is not None:
        return out
    varying = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [np.uint64(1 << i) for i in range(64) if int(varying) >> i & 1]
    out = np.empty((0, 2), np.uint64)
    for part in range(segments):
        own = bits[part::segments]
        mask = np.bitwise_or.reduce(np.array([*own, 0], np.uint64))
        for wild in own or [np.uint64(0)]:
            key = fps & (mask & ~wild)
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            size = np.diff(np.concatenate((begin, [len(key)])))
            found = [out]
            for at, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
                group = fps[order[at : at + n]]
                found.append(link_group(group, max_bits, segments, few) if n <= len(fps) // 2 else link_run(group, max_bits))
            if len(found) > 1:
                out = forest(np.concatenate(found))
    return out


def first_wildcard(a: np.ndarray, b: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The wildcard bit of the first key that two fingerprints share, -1 for none."""
    out = np.full(len(a), -1)
    for lo, hi in segment_bounds(segments)[::-1]:
        d = (a ^ b) >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
        n = np.bitwise_count(d)
        out = np.where(n == 0, lo, np.where(n == 1, lo + np.bitwise_count(d - np.uint64(1)).astype(np.int64), out))
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints within max_bits, enough of them to give the components, each once."""
    if max_bits >= 2 * segments:
        raise ValueError("a segment may differ by more than one bit: more segments are needed")

    width = max(hi - lo for lo, hi in segment_bounds(segments))

    def run(batches):
        keys, vals = np.empty(0, np.int64), np.empty(0, np.uint64)

        def settle(keys, vals):
            cut = np.flatnonzero(np.diff(keys)) + 1
            starts = np.concatenate(([0], cut))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            twos = starts[sizes == 2]
            a, b = vals[twos], vals[twos + 1]
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            out = [(keys[twos[near]], a[near], b[near])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if len(pairs := link_group(np.unique(vals[s : s + n]), max_bits, segments)):
                    out.append((np.full(len(pairs), keys[s]), pairs[:, 0], pairs[:, 1]))
            key, a, b = (np.concatenate(x) for x in zip(*out))
            # two fingerprints may share many keys: their first one joins them already
            first = first_wildcard(a, b, segments) == key >> width
            a, b = a[first].view(np.int64), b[first].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            vals = np.concatenate((vals, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) and keys[0] != keys[-1]:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                yield settle(keys[:whole], vals[:whole])
                keys, vals = keys[whole:], vals[whole:]
        if len(keys):
            yield settle(keys, vals)

    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = wildcard_keys(fps, segments).repartition(4 * parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, segments: int = SEGMENTS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th, fp, first: components of documents whose fingerprints differ by max_bits at most. ``first`` is the
    component's smallest (doc_id, th), null ids last."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, width), "fp")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    own = rows.groupBy("fp").agg(F.min(key).alias("first"))
    edges = scratch.save(links(own.select("fp"), max_bits, segments), "links")
    comp = connected_components(edges, scratch)
    joined = own.join(comp.withColumnRenamed("id", "fp"), "fp")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    linked = scratch.save(joined.join(least, "component").select("fp", "least"), "linked")
    known = scratch.save(own.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "known")
    scratch.drop("links", "linked", "cc")
    # two written tables: adaptive execution can split a fingerprint with very many rows
    return rows.join(known, "fp").select("doc_id", "th", "fp", "first")


# ------------------------------------------------------------------------------------------------ near copies of texts


def shingle_set(text: bytes, width: int = SET_WIDTH) -> np.ndarray:
    """Hashes of 32 bits of the text's shingles, in order, each once. Fewer words make one shingle, none an empty set."""
    w = word_hashes(text.lower())
    n = max(1, len(w) - width + 1) if len(w) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        out = out * np.uint64(BASE) + w[i : i + n]
    return np.unique((mix(out) >> np.uint64(32)).astype(np.uint32))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """``WIDE`` bits as words of 64: SimHash with each shingle once. Where half of the shingles have a bit, the smallest
    decides, so that small sets have no more zeros than ones."""
    counts, first = np.zeros(WIDE, np.int64), np.zeros(WIDE, bool)
    for at in range(0, len(own), 4096):
        h = mix(own[at : at + 4096, None].astype(np.uint64) * np.uint64(BASE) + np.arange(1, WIDE // 64 + 1, dtype=np.uint64))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
        if not at:
            first = bits[0] > 0
    return np.packbits(np.where(2 * counts == len(own), first, 2 * counts > len(own)), bitorder="little").view("<u8")


def sketches(docs: DataFrame, width: int = SET_WIDTH) -> DataFrame:
    """ROW_KEY (a row's id and the hash of its text), sh (a hash of the set), f0 f1 .. (the fingerprint), and the set."""
    names = [f"f{i}" for i in range(WIDE // 64)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py() or b"", width) for t in part.column(len(ROW_KEY)).cast(pa.binary())]
                fp = np.stack([wide_fingerprint(s) for s in sets]).view(np.int64)
                sh = np.array([mix(mix(s.astype(np.uint64) + np.uint64(1)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0] for s in sets], np.uint64).view(np.int64)
                cols = [*part.columns[: len(ROW_KEY)], pa.array(sh), *(pa.array(np.ascontiguousarray(x)) for x in fp.T), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*ROW_KEY, "sh", *names, "own"])

    schema = f"{ROW_SCHEMA}, sh long, {', '.join(f'{n} long' for n in names)}, own binary"
    return row_keys(docs).select(*ROW_KEY, "text").mapInArrow(run, schema)


def wide_keys(sets: DataFrame, segments: int = WIDE_SEGMENTS) -> DataFrame:
    """key, rid, c0, c1: a row for each wildcard bit. The key holds the bit's place, the segment with that bit cleared
    and, last, the bit; c0 and c1 are the fingerprint's first 128 bits, by which most false candidates go at once."""
    bounds = segment_bounds(segments, WIDE)
    power = np.concatenate([1 << np.arange(hi - lo, dtype=np.int64) for lo, hi in bounds])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.stack([c.to_numpy() for c in part.columns[1:]], 1)
                bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").astype(np.int64) * power
                value = np.add.reduceat(bits, [lo for lo, _ in bounds], axis=1).repeat([hi - lo for lo, hi in bounds], 1)
                keys = (((np.arange(WIDE) << 32) | (value - bits)) << 1) | (bits > 0)
                ends = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * WIDE)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), *part.columns[:3]], names=["keys", "rid", "c0", "c1"])

    found = sets.select("rid", *(f"f{i}" for i in range(WIDE // 64))).mapInArrow(run, "keys array<long>, rid long, c0 long, c1 long")
    return found.select(F.explode("keys").alias("key"), "rid", "c0", "c1")


def dealt_keys(rows: DataFrame, parts: int, salts: list, segments: int = WIDE_SEGMENTS) -> DataFrame:
    """Rows of ``wide_keys`` with equal keys in one task, by the bits of the segment outside the wild bit's block. So a
    set's keys, 256 of them, go to 42 places, where its other columns lie side by side and are compressed as one."""
    block, others = [], []
    for lo, hi in segment_bounds(segments, WIDE):
        for first, last in segment_bounds(BLOCKS, hi - lo):
            block += [lo + first] * (last - first)
            others += [(1 << 32) - 1 - ((1 << last) - (1 << first))] * (last - first)
    of = lambda table: F.get(F.array(*map(F.lit, table)), F.shiftright("key", 33).cast("int"))
    return rows.repartition(parts, of(block), F.shiftright("key", 1).bitwiseAND(of(others)), *salts)


def like_leaders(rows: DataFrame, parts: int, segments: int, salts: list) -> DataFrame:
    """a, b: pairs of a row and a leader of its key that it may be like; key, rid, c0, c1: the leaders of hot keys.

    In a pseudo-random order of its own for each key, a row that is like no leader before it is a leader. Many rows are
    settled at once: each is compared with the first of its key, those unlike it go on with the first of them. Of a key
    that goes on in the next batch only leaders are held. Equal segments meet under each of their bits; the pair counts
    under the first."""

    def run(batches):
        held = [np.empty(0, np.int64) for _ in range(4)]
        hot = False
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i).to_numpy() for i in range(4)]
            salted = batch.column(4).to_numpy(zero_copy_only=False)
            done = len(held[0]) and held[0][0] >> 1 != own[0][0] >> 1
            if done and hot:
                yield leaders(held)
            if done:
                held = [x[:0] for x in held]
            n_held = len(held[0])
            key, rid, c0, c1 = (np.concatenate(x) for x in zip(held, own))
            salted = np.concatenate((np.full(n_held, hot), salted))
            group, at, a, b, lead = key >> 1, np.arange(len(key)), [], [], []
            while len(at):
                g = group[at]
                new = np.concatenate(([True], g[1:] != g[:-1]))
                first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))][~new]
                lead.append(at[new])
                at = at[~new]
                near = sum(np.bitwise_count((c[at] ^ c[first]).view(np.uint64)).astype(np.int64) for c in (c0, c1)) <= NEAR_BITS
                counts = near & (rid[at] != rid[first]) & ((key[at] != key[first]) | np.isin(key[at] >> 33, starts))
                a.append(rid[at[counts]])
                b.append(rid[first[counts]])
                at = at[~near]
            lead = np.sort(np.concatenate(lead))
            a, b = np.concatenate(a), np.concatenate(b)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), none, none, none, none], names=names)
            last = group[lead] == group[-1]
            if (out := lead[~last & salted[lead]]).size:
                yield leaders([x[out] for x in (key, rid, c0, c1)])
            held, hot = [x[lead[last]] for x in (key, rid, c0, c1)], bool(salted[-1])
        if hot:
            yield leaders(held)

    def leaders(cols):
        none = pa.nulls(len(cols[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *map(pa.array, cols)], names=names)

    names = ["a", "b", "key", "rid", "c0", "c1"]
    starts = [lo for lo, _ in segment_bounds(segments, WIDE)]
    group = F.shiftright("key", 1)
    dealt = dealt_keys(rows.select("key", "rid", "c0", "c1", "hot", *salts), parts, salts, segments)
    dealt = dealt.sortWithinPartitions(group, *salts, F.xxhash64(group, "rid")).select("key", "rid", "c0", "c1", "hot")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def candidates(sets: DataFrame, segments: int = WIDE_SEGMENTS, crowd: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints agree in a segment but for one bit, and come near as a whole.

    A key that a sixteenth of the sets shows to be hot is dealt over several tasks, whose leaders meet in a second step;
    that sixteenth decides nothing but how rows are dealt."""
    scratch = scratch or Scratch(sets.sparkSession, "near-copies")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # so many tasks that the keys of each, a row for each bit, can be sorted in its memory
    sets = scratch.save(sets.repartition(max(parts, sets.count() // KEY_ROWS + 1), "rid"), "dealt")
    some = wide_keys(sets.where(F.pmod(F.xxhash64("rid"), F.lit(16)) == 0), segments)
    hot = some.groupBy(F.shiftright("key", 1).alias("g")).agg((F.count(F.lit(1)) * 16).alias("n")).where(F.col("n") > crowd)
    hot = scratch.save(hot.select("g", F.ceil(F.col("n") / crowd).cast("int").alias("salts")), "hot")
    rows = wide_keys(sets, segments)
    any_hot = bool(hot.take(1))
    if any_hot:
        rows = rows.join(hot, F.shiftright("key", 1) == F.col("g"), "left").drop("g")
        rows = rows.withColumn("hot", F.col("salts").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("rid"), F.coalesce("salts", F.lit(1))).cast("int"))
    else:
        rows = rows.withColumn("hot", F.lit(False))
    found = like_leaders(rows, 4 * parts, segments, ["salt"] if any_hot else [])
    if not any_hot:
        return found.select("a", "b").distinct()
    found = scratch.save(found, "found")
    again = like_leaders(found.where("key is not null").select("key", "rid", "c0", "c1", F.lit(False).alias("hot")), parts, segments, [])
    return found.where("a is not null").select("a", "b").unionByName(again.select("a", "b")).distinct()


def checked(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs whose sets have that Jaccard similarity. sets: rid, own."""

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint32) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both / max(1, len(a) + len(b) - both) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = sets.select("rid", "own")
    both = pairs.join(own.select(F.col("rid").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("rid").alias("b"), F.col("own").alias("own_b")), "b")
    return both.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, similar: float = SIMILAR, width: int = SET_WIDTH, segments: int = WIDE_SEGMENTS, crowd: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """ROW_KEY of each row and, in ``first``, that of the first of its component."""
    scratch = scratch or Scratch(docs.sparkSession, "near-copies")
    fp = [f"f{i}" for i in range(WIDE // 64)]
    rows = scratch.save(sketches(docs, width), "sketches")
    firsts = rows.groupBy("sh").agg(F.min(F.struct(*ROW_KEY)).alias("first"), *(F.min(f).alias(f) for f in fp))
    firsts = scratch.save(firsts.withColumn("rid", F.monotonically_increasing_id()), "firsts")
    pairs = scratch.save(candidates(firsts, segments, crowd, scratch), "pairs")
    needed = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    needed = firsts.join(needed, "rid", "left_semi").select("rid", "sh", *(F.col(f"first.{k}").alias(k) for k in ROW_KEY))
    # of repeated rows one, told by the join's keys, so that sets are dealt once
    sets = rows.join(needed, ["sh", *ROW_KEY]).dropDuplicates(["sh", *ROW_KEY])
    sets = scratch.save(sets.select("rid", "own"), "sets")
    edges = scratch.save(checked(pairs, sets, similar), "links")
    comp = connected_components(edges, scratch)
    own = firsts.select("rid", "sh", "first").join(comp.withColumnRenamed("id", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    own = scratch.save(own.select("sh", "first", "component"), "own")
    least = own.groupBy("component").agg(F.min("first").alias("least"))
    known = scratch.save(own.join(least, "component").select("sh", F.col("least").alias("first")), "known")
    out = scratch.save(rows.select(*ROW_KEY, "sh").join(known, "sh").select(*ROW_KEY, "first"), "near-copies")
    scratch.drop("sketches", "firsts", "dealt", "hot", "found", "pairs", "sets", "links", "cc", "own", "known")
    return out


def one_of_each(docs: DataFrame, similar: float = SIMILAR, width: int = SET_WIDTH, segments: int = WIDE_SEGMENTS, crowd: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """The first document of each component of near copies, with all columns; of rows equal in id and text one."""
    found = near_copies(docs, similar, width, segments, crowd, scratch)
    own = F.struct(*ROW_KEY)
    kept = found.where(own == F.col("first")).select(*ROW_KEY)
    return one_row_each(docs, kept, "left_semi")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
