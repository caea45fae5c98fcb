"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables, with nulls,
empty and long texts, repeated rows, ties, clashing columns and empty tables."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bpe, charlm, common, language, packing, permutation_index, quality, sharding, simhash, suffix_dedup, toxicity, voronoi_knn

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """All documents of the smallest table and edge cases."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows += [(1000, None, "en", "x", None), (1001, "", "en", "x", 0), (1002, long, None, None, 1), (None, "no id here", "en", "x", 3), (1003, rows[0][1], "en", "x", 1), (1003, rows[0][1], "en", "x", 1), (1004, " \n\t ", "en", "x", 4), (1005, "x" * 9000, "en", "x", 9000)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---------------------------------------------------------------- sharding


def test_shards(spark, docs, empty):
    got = sharding.shard_documents(docs, 8).toPandas()
    texts = {(None if pd.isna(r.doc_id) else r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.toPandas().itertuples()}
    assert len(got) == docs.count() and {(None if pd.isna(a) else a, b, c) for a, b, c in zip(got["doc_id"], got["size"], got["text_crc32"])} == texts
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= got["size"].max()
    assert sharding.shard_documents(empty, 8).count() == 0


def test_slot_map(spark, tmp_path):
    rng = random.Random(1)
    weights = [rng.randint(0, 1000) for _ in range(512)]
    m = sharding.SlotMap.initial(512, 8)
    moved = m.rebalance(weights)
    loads = m.loads(weights)
    assert max(loads) - min(loads) <= 2 and 0 < moved < 256 and len(m.versions) == 2
    before = list(m.current)
    m.add_shard(weights)
    assert all(a == b or b == 8 for a, b in zip(before, m.current))
    assert abs(m.loads(weights)[8] - sum(weights) / 9) < sum(weights) / 90
    m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == m
    m.n_shards += 1  # an empty last shard is a shard
    m.versions.append(list(m.current))
    m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).n_shards == 10
    assert sharding.SlotMap.load(spark, str(tmp_path / "none")) is None


def test_a_kept_map_is_edited(spark, docs, tmp_path):
    """The next run starts from the last version: the same rows move nowhere, more rows and shards move a part."""
    path = str(tmp_path / "map")
    own = lambda df: {(r.doc_id, r.text_crc32): (r.vslot, r.shard) for r in df.collect()}
    a = own(sharding.shard_documents(docs, 4, 256, path))
    versions = len(sharding.SlotMap.load(spark, path).versions)
    assert own(sharding.shard_documents(docs, 4, 256, path)) == a
    assert len(sharding.SlotMap.load(spark, path).versions) == versions
    b = own(sharding.shard_documents(docs, 5, 256, path))
    kept = sharding.SlotMap.load(spark, path)
    assert kept.n_shards == 5 and len(kept.versions) > versions and all(a[k][0] == b[k][0] for k in a)
    assert {s for _, s in b.values()} == set(range(5))
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 4, 256, path)


# ---------------------------------------------------------------- byte-level BPE


def test_bpe(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    code = bpe.codec(path, public_tokenizers.PATTERN)
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    expect = set()
    for r in docs.collect():
        ids = code.lib.encode_ordinary(r.text or "")
        assert code.decode(ids) == (r.text or "").encode()
        expect.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert rows == expect
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_cuts():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    small = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN, chunk=40, long_piece=16)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Z", " ", "  ", "\n", "'s", "9", "é", "!", "漢", " ", "\t", "aaaaaaaaaaaaaaaaaaaaaa", "'"]) for _ in range(rng.randint(0, 120)))
        assert small.encode(text) == small.lib.encode_ordinary(text)
        assert "".join(bpe.safe_boundaries(text, 10)) == text


# ---------------------------------------------------------------- packing


def plain_difference(sizes, k):
    import heapq

    heap = [(-(s if k > 1 else 0), i, [s]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        a, b = sorted(a + [0] * (k - len(a)), reverse=True), sorted(b + [0] * (k - len(b)))
        c = sorted((x + y for x, y in zip(a, b)), reverse=True)
        heapq.heappush(heap, (-(c[0] - c[-1]), tie, c))
        tie += 1
    return [x for x in sorted(heap[0][2] + [0] * 0, reverse=True) if x]


def test_differencing():
    rng = random.Random(3)
    for _ in range(100):
        sizes, k = [rng.randint(1, 512) for _ in range(rng.randint(1, 30))], rng.randint(1, 9)
        window, sums = packing.difference(sizes, k)
        got = np.bincount(window, weights=sizes, minlength=k)
        assert sorted(got[got > 0].astype(int)) == sorted(sums.tolist()) == sorted(plain_difference(sizes, k))
    sizes = [rng.randint(1, 512) for _ in range(3000)]
    window = packing.pack_sizes(sizes)
    assert np.bincount(window, weights=sizes).max() <= 1024
    assert sum(sizes) / ((window.max() + 1) * 1024) > 0.98
    assert len(packing.pack_sizes([])) == 0


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    marked = [(2000, "a <|endoftext|> b", 1), (2001, "<|endoftext|><|endoftext|>x<|endoftext", 1), (2001, "<|endoftext|>", 2)]
    docs = docs.select("doc_id", "text").withColumn("offset", F.lit(1)).unionByName(spark.createDataFrame(marked, "doc_id long, text string, offset int"))
    got = packing.pack_documents(docs, path, ids=True).toPandas()
    want = sorted(tuple(lib.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in docs.collect())
    whole = []
    for (_, n), part in got.sort_values("start").groupby(["doc_id", "doc_tokens"], dropna=False):
        copies = (part["start"] == 0).sum()
        for c in range(copies):
            own = part.groupby("start").nth(c)
            own = own.sort_values("start")
            ids = [i for x in own["ids"] for i in x]
            assert len(ids) == n and all(zlib.crc32(np.array(x, "<u4").tobytes()) == y for x, y in zip(own["ids"], own["ids_crc32"]))
            whole.append(tuple(ids))
    assert sorted(whole) == want
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["length"].sum() <= 1024 and (part["offset"].to_numpy() == np.cumsum(part["length"]) - part["length"]).all()
    assert packing.pack_documents(empty, path).count() == 0 and packing.agrees(path, [r.text or "" for r in docs.limit(50).collect()])


# ---------------------------------------------------------------- SimHash


def brute_simhash(texts, width=4, bits=4):
    from xxhash import xxh64_intdigest

    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        h = [xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, empty):
    rows = sorted(((r.doc_id, r.text) for r in docs.where("doc_id is not null").distinct().collect()), key=lambda r: r[0])
    rng = random.Random(4)
    near = [(2000 + i, " ".join(w if rng.random() > 0.004 else "zz" for w in rows[k][1].split())) for i, k in enumerate(list(range(40)) * 3)]
    rows = sorted({*rows, *near}, key=lambda r: r[0])
    fps = brute_simhash([t for _, t in rows])
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    comp = components(len(rows), linked)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["first"]["doc_id"]) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 20
    assert got == {d: (fps[i], rows[comp[i]][0]) for i, (d, _) in enumerate(rows)}
    assert simhash.simhash_components(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 6, 3)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(12)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    at = {f: i for i, f in enumerate(fps)}
    got = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in simhash.links(frame).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in got)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert components(len(fps), got) == components(len(fps), want)
    whole = simhash.link_group(np.array(fps, np.uint64), 4, 3, few=8)  # as if all shared a key
    assert components(len(fps), [(at[int(a)], at[int(b)]) for a, b in whole]) == components(len(fps), want)


def test_links_of_a_crowd_are_few(spark):
    """Many near fingerprints share most keys; their links grow with them, not with the keys or the square."""
    rng = random.Random(11)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for _ in range(1500)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    at = {f: i for i, f in enumerate(fps)}
    got = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in simhash.links(frame).collect()]
    assert len({*got}) == len(got) < 4 * len(fps) and len(fps) > 600
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in got)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert components(len(fps), got) == components(len(fps), want)
    for few in (8, 256):
        assert len(simhash.link_group(np.array(fps, np.uint64), 4, 3, few)) == len(fps) - len({*components(len(fps), want)})


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(900, i) for i in range(901, 960)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()}
    comp = components(1000, edges)
    assert got == {x: comp[x] for e in edges if e[0] != e[1] for x in e}


def test_near_copies_of_the_pipeline(spark, docs, empty):
    """Copies with some words changed: five-word similarity 0.8 and more goes, clearly less stays."""
    import corpus_pipeline

    rng = random.Random(10)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, alike = [], {}
    for i in range(300):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        rate = rng.choice([0.003, 0.01, 0.02, 0.1])
        copy = [w if rng.random() > rate else f"x{rng.randint(0, 5000)}" for w in text]
        rows += [(i, " ".join(text), "en", "x", 1), (1000 + i, " ".join(copy), "en", "x", 1)]
        alike[1000 + i] = len(grams(text) & grams(copy)) / len(grams(text) | grams(copy))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    near = [d for d, j in alike.items() if j >= 0.8]
    far = [d for d, j in alike.items() if j < 0.8]
    assert kept >= {*range(300), *far} and len(far) > 50
    assert len(near) > 150 and sum(d not in kept for d in near) >= 0.97 * len(near)
    clash = docs.withColumns({c: F.lit(i) for i, c in enumerate(["none", "id", "th", "sh", "own", "row", "first", "rid"])})
    got = simhash.one_of_each(clash)
    assert got.columns == clash.columns and got.where("doc_id = 1003").count() == 0 and simhash.one_of_each(empty).count() == 0
    assert got.where("doc_id is null").count() == 1 and got.where("id = 1 and rid = 7").count() == got.count()


def test_keys_of_a_set_are_dealt_to_few_places(spark):
    """Equal keys meet in one task, and a set's keys lie in no more places than the segments have blocks."""
    rng = random.Random(6)
    rows = [(i, *(rng.getrandbits(64) - (1 << 63) for _ in range(4))) for i in range(30)]
    rows += [(100 + i, r[1] ^ 1 << i, *r[2:]) for i, r in enumerate(rows)]
    keys = simhash.wide_keys(spark.createDataFrame(rows, "rid long, f0 long, f1 long, f2 long, f3 long"))
    dealt = simhash.dealt_keys(keys, 256, []).withColumn("at", F.spark_partition_id()).cache()
    assert dealt.count() == keys.count() == 256 * len(rows)
    assert dealt.groupBy(F.shiftright("key", 1)).agg(F.count_distinct("at").alias("n")).where("n > 1").count() == 0
    places = dealt.groupBy("rid").agg(F.count_distinct("at").alias("n")).agg(F.max("n")).first()[0]
    assert places <= simhash.BLOCKS * simhash.WIDE_SEGMENTS


def test_near_copies_in_a_hot_key(spark):
    """A crowd of near copies, dealt over several tasks, and unlike texts: components equal those of all pairs."""
    rng = random.Random(14)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = [" ".join(w if rng.random() > 0.004 else f"x{rng.randint(0, 5000)}" for w in base) for _ in range(150)]
    texts += [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(40)) for _ in range(50)]
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    comp = components(len(sets), pairs)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (simhash.CROWD, 16):
        got = {r["id"]: r["first"]["id"] for r in simhash.near_copies(frame, crowd=crowd).collect()}
        assert got == {i: comp[i] for i in range(len(texts))}


# ---------------------------------------------------------------- repeated passages


def brute_repeats(rows, n):
    first, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in first:
                hit[i : i + n] = True
            first.add(key)
        out[doc] = hit
    return out


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3])
def test_repeats(spark, docs, crowd):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null and doc_id <> 1003").collect()]
    passages = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(70)) for _ in range(3)]
    for i in range(60):
        own = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 80))]
        own.insert(rng.randint(0, len(own)), rng.choice(passages))
        rows.append((3000 + i, " ".join(own)))
    for i in range(12):  # texts that repeat themselves
        own = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        rows.append((4000 + i, " ".join([*own, *(["is", "one"] * rng.randint(20, 90)), *own, *rng.choice(passages).split(), "x", *rng.choice(passages).split(), *(["z"] * rng.randint(0, 120))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, 50)
    got = {d: np.zeros(len(h), bool) for d, h in want.items()}
    for r in suffix_dedup.repeated_spans(frame, crowd=crowd).collect():
        got[r["doc"]][r["start"] : r["end"]] = True
    for r in suffix_dedup.copies(frame, 50).collect():
        got[r["doc"]][:] = True
    assert {d for d, h in want.items() if (h != got[d]).any()} == set()
    assert sum(h.any() for h in want.values()) > 50


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3])
def test_first_occurrences(spark, crowd):
    """Every repeated window names the smallest document and place that has it, however many tasks a crowd takes."""
    rng = random.Random(11)
    passages = [[f"p{rng.randint(0, 10**6)}" for _ in range(90)] for _ in range(3)]
    rows = []
    for i in range(80):
        lo = rng.randint(0, 25)
        rows.append((i, " ".join([*(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))), *rng.choice(passages)[lo : lo + rng.randint(50, 65)], f"v{i}"])))
    for i in range(12):  # texts that repeat themselves
        own = rng.choice(passages)
        rows.append((100 + i, " ".join([f"v{i}", *(["is", "one"] * rng.randint(20, 90)), *own[: rng.randint(50, 80)], *own[rng.randint(0, 20) :], *own, *["a", "b", "c"] * rng.randint(10, 40)])))
    first, want = {}, {}
    for doc, text in rows:
        w = text.split()
        for i in range(len(w) - 49):
            at = first.setdefault(tuple(w[i : i + 50]), (doc, i))
            if at != (doc, i):
                want[doc, i] = at
    got = {}
    for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect():
        for i in range(r["end"] - r["start"] - 49):
            assert (r["doc"], r["start"] + i) not in got
            got[r["doc"], r["start"] + i] = (r["first_doc"], r["first_start"] + i)
    assert got == want and len(want) > 300


def test_remove_repeats(spark, docs, empty):
    extra = docs.withColumns({"doc": F.lit(1), "th": F.lit(2), "cut": F.lit(3), "row": F.lit(4)})
    out = suffix_dedup.remove_repeats(extra)
    assert out.columns == extra.columns
    got = out.toPandas()
    assert (got["doc_id"] == 1003).sum() == 0 and (got["doc_id"] == 1000).sum() == 1 and (got["doc_id"] == 1001).sum() == 1
    again = suffix_dedup.remove_repeats(spark.createDataFrame([(None if pd.isna(r.doc_id) else int(r.doc_id), r.text) for r in got.itertuples()], "doc_id long, text string"))
    assert again.count() <= len(got)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.without("a b  c\nd ", [(1, 3)]) == "a d "


# ---------------------------------------------------------------- embeddings


def vectors(seed=8, n=300):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    near = base[:80] + rng.normal(size=(80, 16)) * rng.uniform(0.02, 0.45, size=(80, 1)) * np.linalg.norm(base[:80], axis=1, keepdims=True) / 4
    hot = np.repeat(base[:1], 40, axis=0)
    crowd = base[1] + rng.normal(size=(60, 16)) * 0.05
    return np.concatenate((base, near, hot, crowd)).astype(np.float32)


def frame_of(spark, x, start=0):
    rows = [(start + i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_near_duplicates(spark):
    x = vectors()
    rows = frame_of(spark, x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in permutation_index.near_duplicates(rows, n_pivots=24).collect()}
    assert len(got) == len(x) + 5 and all(got[i] == (0, i) for i in range(9000, 9005))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    n = np.array([got[i][0] for i in range(len(x))])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.9 * links.sum() and links.sum() > 3000
    assert len({got[i][1] for i in range(380, 420)}) == 1  # copies
    assert permutation_index.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_duplicates_of_a_dense_group(spark):
    """A third of the rows around one centre, with the pivots that production takes for so many rows."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 64))
    x[:6667] = x[0] + 0.25 * rng.normal(size=(6667, 64))
    x[-500:] = x[-1000:-500] + 0.35 * rng.normal(size=(500, 64))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = permutation_index.near_duplicates(frame).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 1000] @ u.T >= 0.9).sum(1) for i in range(0, len(u), 1000)]) - 1
    n = got["n_links"].to_numpy()
    assert want.sum() > 40_000_000 and (n <= want).all() and n.sum() >= 0.98 * want.sum()
    assert n[6667:].sum() >= 0.9 * want[6667:].sum() > 800
    assert got["component_id"][:6667].nunique() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    x = vectors(seed)
    x[::7] *= 3  # norms differ
    rows = frame_of(spark, x).select("vec_id", voronoi_knn.scaled("embedding").alias("v"))
    got = sorted(tuple(r) for r in voronoi_knn.top_k(rows, F.col("vec_id") % 9 == 0, n_pivots=16).collect())
    e = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    e, ids = np.concatenate((e, np.zeros((1, 16), np.int64))), [*range(len(x)), 9002]
    want = []
    for i, q in enumerate(ids):
        if q % 9 == 0:
            best = sorted((-int(s), ids[j]) for j, s in enumerate(e @ e[i]) if j != i)[:10]
            want += [(q, k, v, -s) for k, (s, v) in enumerate(best, 1)]
    assert got == sorted(want)


def test_bounds_spare_rows():
    """Far clusters go to other groups' queries only where a bound lets them, and no row that counts is spared."""
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(8, 12)) * 3000, 200, axis=0) + r.normal(size=(1600, 12)) * 20
    x = x[r.permutation(1600)]
    x = np.floor(x * (10_000 / np.linalg.norm(x, axis=1, keepdims=True)))  # of like lengths: else the bounds are wide
    big, k = np.sqrt((x * x).sum(1).max()) * (1 + 1e-9), 10
    join = voronoi_knn.Join(np.unique(voronoi_knn._augment(x[:40], big, False), axis=0), big, k)
    cell, d = join.cells(x, False)
    nearest = [(c, d[i], i) for c in range(40) for i in np.flatnonzero(cell == c)[np.argsort(d[cell == c], kind="stable")][: k + 1]]
    q = np.arange(0, 1600, 20)
    own, far = join.cells(x[q], True)
    join.bound({c: far[own == c].max() for c in set(own.tolist())}, nearest)
    join.form_groups({c: int((own == c).sum()) for c in set(own.tolist())}, 1)
    row, group = join.wanted(x)
    dealt = set(zip(row.tolist(), group.tolist()))
    assert len(dealt) < 0.3 * len(x) * len(set(join.group[own].tolist()))
    for i, c in zip(q, own):
        score = x @ x[i]
        score[i] = -np.inf
        assert all((j, join.group[c]) in dealt for j in np.argsort(-score, kind="stable")[:k].tolist())


def test_top_k_of_few(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [0, 0])], "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in voronoi_knn.top_k(rows, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 5), (0, 2, 2, 0)]
    assert voronoi_knn.top_k(rows.limit(0), F.lit(True)).count() == 0


# ---------------------------------------------------------------- models


@pytest.fixture(scope="module")
def larger(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity(spark, larger, empty):
    docs, marks = larger
    scorer = toxicity.train(docs, marks, common.Scratch(spark, "t"))
    d = docs.toPandas().merge(marks.toPandas(), on="doc_id")
    held = d[[zlib.crc32(str(i).encode()) % 5 == 0 for i in d["doc_id"]]]
    right = [(scorer.score(t) >= 0.5) == bool(y) for t, y in zip(held["text"], held["toxic"])]
    assert np.mean(right) > 0.93
    clean = d[d["toxic"] == 0]["text"].iloc[0]
    assert scorer.score(clean) < 0.5
    found = sum(scorer.score(f"{clean[:200]} {w} and {w}") >= 0.5 for w in ("1d10t", "m0r0n", "s t u p i d", "pa-the-tic", "p4th3t1c", "cl0wn", "scuuuum", "$tupid", "w.o.r.t.h.l.e.s.s", "stupid"))
    assert found >= 7
    assert 0 <= scorer.score("") <= 1 and toxicity.score_toxicity(empty, marks).count() == 0
    nobody = toxicity.train(docs, marks.limit(0), common.Scratch(spark, "t"))
    assert 0 < nobody.score("idiot") < 0.5


def test_every_obfuscated_word_is_decoded():
    from helixframe.llm import charlm

    flat = np.zeros((toxicity.OTHER + 1) ** 3, np.int64)
    charlm.count_trigrams(["an idiot a loser scum stupid trash people said the clown was pathetic tonight with a letter"] * 50, flat)
    restorer = toxicity.Restorer(charlm.log_model(flat.reshape((toxicity.OTHER + 1,) * 3)))
    for seen, meant in (("iidiot", "idiot"), ("idiiot", "idiot"), ("scuum", "scum"), ("ssccum", "scum"), ("sstupid", "stupid"), ("trrassh", "trash"), ("1d107", "idiot"), ("!d!07", "idiot"), ("1053r", "loser"), ("letter", "letter")):
        assert meant in restorer.words(seen), seen
    for gap in ("  ", "\t", "\n", " \r\n "):
        assert "idiot" in toxicity.tokens("he is " + gap.join("idiot"), restorer)
    assert restorer.words("2019") == restorer.words("$1,000") == []


def test_decode():
    counts = np.zeros((toxicity.OTHER + 1,) * 3, np.int64)
    from helixframe.llm import charlm

    flat = counts.reshape(-1)
    charlm.count_trigrams(["stupid idiot moron worthless people said the clown was pathetic"] * 50, flat)
    lm = charlm.log_model(flat.reshape(counts.shape))
    for seen, meant in (("5tup1d", "stupid"), ("id!0t", "idiot"), ("m-o-r-o-n", "moron"), ("cloooown", "clown"), ("p4thet1c", "pathetic"), ("worthle55", "worthless"), ("stupid", "stupid")):
        assert toxicity.decode(seen, lm) == meant


def test_decode_against_all_paths():
    """Viterbi's answer has the probability of the best of all paths through small lattices."""
    import itertools
    import math

    rng = np.random.default_rng(4)
    lm = charlm.log_model(rng.integers(0, 9, (charlm.SYMBOLS,) * 3).astype(float))

    def options(word):
        run = 0
        for i, c in enumerate(word):
            run = run + 1 if i and c.isalpha() and c == word[i - 1] else 1
            if c.isalpha():
                yield [(c, 0.0)] if run == 1 else [(c, toxicity.DOUBLE), ("", toxicity.SINGLE)] if run == 2 else [(c, toxicity.KEPT), ("", toxicity.STRETCHED)]
            elif c in toxicity.LOOKALIKES:
                own = toxicity.LOOKALIKES[c]
                yield [(x, toxicity.SWAP - math.log(len(own))) for x in own] + [(" ", toxicity.STAY), ("", toxicity.DROP)]
            else:
                yield [("", toxicity.JOIN), (" ", toxicity.SPLIT)]

    def score(path):
        a = b = 0
        total = 0.0
        for x, cost in path:
            total += cost
            if x and not (x == " " and b == 0):
                k = 0 if x == " " else toxicity.symbol(x)
                total += float(lm[a, b, k])
                a, b = b, k
        return total + (float(lm[a, b, 0]) if b else 0.0)

    for word in ("1d10t", "sstt0p", "b.a.d", "a--b1", "aaa$", "h3ll0", "x", "6!6"):
        best = max(itertools.product(*options(word)), key=score)
        at = [p for p in itertools.product(*options(word)) if "".join(x for x, _ in p).split() == toxicity.decode(word, lm).split()]
        assert max(map(score, at)) == pytest.approx(score(best))


def test_toxicity_edges(spark, larger):
    docs, marks = larger
    rows = [(None, None, 1), (1, None, 2), (2, "", 3), (3, "x " * 200_000, 4), (3, "x " * 200_000, 4), (4, "a" * 50_000, 5)]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, held_out int"), marks, name="p").toPandas()
    assert len(got) == 6 and list(got.columns) == ["doc_id", "text", "held_out", "p"] and got["p"].between(0, 1).all()
    assert got["p"].nunique() == 1  # without labelled rows all have the base score


def test_pooling():
    """Pooled vectors against a loop over words."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(quality.BUCKETS, 2 * quality.DIMS)).astype(np.float32)
    for text in ("", "one", "a a b! b a 12", " \n", "It's a LONG, longer text: a LONG one"):
        words, shapes = quality.word_ids(text.encode())
        got, d = quality.pool(text.encode(), vectors), quality.DIMS
        assert len(words) <= len(text.split()) and len(shapes) == len(text.split())
        want = np.zeros(quality.WIDTH)
        for w in words:
            want[:d] += vectors[w, :d] / len(words)
        for s in shapes:
            want[d : 3 * d] += vectors[s] / len(shapes)
        seen = set()
        for i, w in enumerate(words):
            want[3 * d : 5 * d] += (i > 0 and w == words[i - 1]) * vectors[quality.AGAIN] / len(words)
            want[5 * d :] += (w in seen) * vectors[quality.SEEN] / len(words)
            seen.add(w)
        assert np.allclose(got, want, atol=1e-5)


def test_quality(spark, larger, empty):
    docs, marks = larger
    got = quality.score_quality(docs, marks, name="quality_score").select("doc_id", "quality_score").toPandas().merge(marks.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    assert ((held["quality_score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.93
    assert quality.score_quality(empty, marks).count() == 0
    none = quality.train(docs, marks.limit(0), common.Scratch(spark, "t")).score(["", "x"])
    assert list(none) == [0.5, 0.5]
    edge = spark.createDataFrame([(1, None, 2), (1, None, 2), (2, "", 3)], "doc_id long, text string, score int")
    assert quality.score_quality(edge, marks).count() == 3


def test_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(2000) < 0.1)).astype(float)
    net = quality.Network(8)
    net.fit(x, y, epochs=200)
    p = net.probability(x)
    assert ((p >= 0.5) == y).mean() > 0.85
    assert abs(p.mean() - y.mean()) < 0.05 and 0.25 <= net.temperature <= 8


def test_language(spark, larger):
    docs, _ = larger
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = spark.createDataFrame([(9000, None, None), (9001, "http://host.example.de/x", ""), (9001, "http://host.example.de/x", "")], "page_id long, url string, html string")
    got = language.identify(pages.unionByName(more), docs).toPandas()
    assert len(got) == pages.count() + 3
    own = got.merge(pages.toPandas(), on="page_id")
    assert (own["lang"] == own["html"].str.extract(r'lang="(\w+)"')[0]).mean() > 0.97
    # the declaration is an input: without it text, suffix and host must find it again
    hidden = pages.withColumn("html", F.regexp_replace("html", r'lang="\w+"', ""))
    blind = language.identify(hidden, docs).toPandas().merge(pages.toPandas(), on="page_id")
    assert (blind["declared"] == "").all() and (blind["lang"] == blind["html"].str.extract(r'lang="(\w+)"')[0]).mean() > 0.95
    assert got["confidence"].between(0, 1).all()
    assert language.identify(pages.limit(0), docs).count() == 0
    assert language.identify(pages, docs.limit(0)).where("lang is not null").count() == 0
    assert language.visible("<p>a<script>b</p></script>&amp;<!-- c -->d</p>").split() == ["a", "&", "d"]
    assert language.declared('<html class="x" lang=de-AT>') == "de" and language.declared("<p>") == ""
    assert language.declared('<meta http-equiv="Content-Language" content="fr">') == "fr" and language.declared("<html lang=") == ""
    assert language.visible("a <b> <script>c</SCRIPT > d<!-- e <p>f").split() == ["a", "d", "f"]


def test_pages_without_ends():
    """Long pages of tags that never end take time in proportion."""
    import time

    for part in ("<!--", "<script ", "<html ", "<", "<meta content-language "):
        began = time.time()
        language.visible(part * 100_000)
        language.declared(part * 100_000)
        assert time.time() - began < 5


def test_fusion(spark):
    """Against Bayes' rule in plain Python, on pages whose text evidence is given."""
    import math
    from urllib.parse import urlsplit

    rng = random.Random(3)
    langs = ["a", "b", "c"]
    rows = []
    for i in range(80):
        ll = [rng.uniform(-90, -20) for _ in langs]
        host = rng.choice(["x.example.fr", "y.example.fr", "www.z.co.uk", "t.de", ""])
        rows.append((i, f"http://{host}/p" if host else None, rng.choice(["a", "b", ""]), rng.choice([0, 40]), ll))
    frame = spark.createDataFrame(rows, "page_id long, url string, declared string, text_chars long, ll array<double>")
    got = {r.page_id: (r.lang, r.confidence) for r in language.fuse(frame, langs, common.Scratch(spark, "t")).collect()}
    parts = {}
    for i, url, said, chars, ll in rows:
        host = (urlsplit(url).hostname or "") if url else ""
        host = host.removeprefix("www.")
        labels = host.split(".")
        domain = ".".join(labels[-3:] if labels[-2:] == ["co", "uk"] else labels[-2:]) if len(labels) > 1 else ""
        parts[i] = {"declared": said, "suffix": labels[-1] if len(labels) > 1 else "", "host": host, "domain": domain, "best": ll.index(max(ll)) if chars else None, "ll": ll}
    for i, own in parts.items():
        others = [p for j, p in parts.items() if j != i and p["best"] is not None]
        n = lambda lang, key=None: sum(p["best"] == lang and (key is None or p[key] == own[key]) for p in others)  # noqa: E731, B023
        size = lambda key: sum(p[key] == own[key] for p in others)  # noqa: E731, B023
        score = []
        for x in range(3):
            overall = (n(x) + 1) / (len(others) + 3)
            domain = (n(x, "domain") + language.DOMAIN_WEIGHT * overall) / (size("domain") + language.DOMAIN_WEIGHT)
            host = (n(x, "host") + language.HOST_WEIGHT * domain) / (size("host") + language.HOST_WEIGHT)
            values = {k: len({p[k] for p in parts.values()}) for k in ("declared", "suffix")}
            fit = sum(math.log((n(x, k) + language.SMOOTH) / (n(x) + language.SMOOTH * values[k])) for k in values)
            score.append(language.TEMPER * own["ll"][x] + fit + math.log(host))
        top = max(score)
        assert got[i][0] == langs[score.index(top)]
        assert got[i][1] == pytest.approx(1 / sum(math.exp(s - top) for s in score))


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, larger):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, _ = larger
    sf = "/root/testdata/sf0.01"
    at = docs
    out = common.Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = out.save(stage(spark, at, sf), name)
        assert new.columns == docs.columns and 0 < new.count() <= at.count()
        at = new
    final = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    kept = {r["doc_id"] for r in at.select("doc_id").collect()}
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == kept
    texts = [r["text"] for r in at.collect()]
    assert len(texts) == len(set(texts))


def test_pipeline_edges(spark, docs, empty):
    """Nulls, empty and long texts, repeated rows and columns of the inputs that stages use names like go through."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    extra = {"toxicity": F.lit(0.5), "quality": F.lit("q"), "Score": F.lit(1), "row": F.lit(2), "cut": F.lit(3), "doc": F.lit(4)}
    for at in (docs.withColumns(extra), empty.withColumns(extra)):
        n, some = at.count(), at.count() > 0
        out = common.Scratch(spark, "test")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            new = out.save(stage(spark, at, SF), name)
            assert new.columns == at.columns and new.count() <= at.count()
            assert new.where("toxicity = 0.5 and quality = 'q' and Score = 1 and row = 2 and cut = 3 and doc = 4").count() == new.count()
            at = new
        assert at.count() == at.select("doc_id", "text").distinct().count()
        assert (corpus_pipeline.STAGES[-1][1](spark, at, SF).count() > 0) == some == (n > 0)


def test_a_result_outlives_other_runs(spark, docs):
    """Scratch tables belong to their results: one that is still to be read survives other operators and runs."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    early = simhash.simhash_components(docs)
    corpus_pipeline.run(spark, SF).count()
    assert early.count() == docs.count()


CONTRACTS = {
    "op1_toxicity": ("doc_id", "held_out boolean, score double, predicted int"),
    "op2_virtual_slots": ("doc_id", "size long, text_crc32 long, law string, shard int, slot long, grown_shard int"),
    "op3_quality": ("doc_id", "held_out boolean, score double, predicted int"),
    "op4_voronoi": ("query_id", "rank int, vec_id long, score long"),
    "op5_byte_bpe": ("doc_id", "n_tokens long, ids_sha256 string, decoded_sha256 string"),
    "op6_permutations": ("vec_id", "n_links long, component_id long, kept boolean"),
    "op7_simhash": ("doc_id", "fingerprint string, component_id long"),
    "op10_packing": ("doc_id", "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contracts(spark, name):
    """Names and types of the queries' results, and a row for each row of their tables."""
    from helixframe.llm.queries import QUERIES

    got = QUERIES[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in got.schema}
    key, cols = CONTRACTS[name]
    assert kinds[key] == "long" and {c: kinds[c] for c in (x.split()[0] for x in cols.split(", "))} == dict(x.split() for x in cols.split(", "))
    table = spark.read.parquet(f"{SF}/{'embeddings' if key in ('vec_id', 'query_id') else 'documents'}.parquet")
    if key == "query_id":
        assert got.select(key).distinct().count() == table.where("vec_id % 100 = 0").count()
    else:
        assert got.select(key).distinct().count() == table.count()


def test_nothing_else_imports_this():
    root = Path(__file__).resolve().parents[2] / "helixframe"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ("from .llm" in p.read_text() or "helixframe.llm" in p.read_text())]
