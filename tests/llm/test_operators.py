"""Each operator against brute force, the library it stands for, or SQL, over rows with every odd case."""

import hashlib
import math
import random
import sys
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import fingerprints, mixing, model_names, pieces, preferences, quality, rans, sharding, simhash, substrings, tokens, urls
from factloom.llm.components import connected_components


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


# fingerprints


def test_edited_neighbours_against_brute_force(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(own) // 3
        edited = own[: len(own) - k] + after[:k]
        a, b, c = (fingerprints.digest(x.encode()) for x in (own, edited, after))
        want.append((r[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert listed(fingerprints.edited_neighbours(docs)) == sorted(want, key=repr)


def test_edited_neighbours_of_few(spark, docs, none):
    assert fingerprints.edited_neighbours(none).count() == 0
    one = fingerprints.edited_neighbours(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_digest_pieces_and_bounds(monkeypatch):
    rnd = random.Random(1)
    data = bytes(rnd.randrange(97, 123) for _ in range(5000))
    whole = fingerprints.bucket_counts(data)
    for size in (7, 64, 4999, 5000, 5001):
        monkeypatch.setattr(fingerprints, "PIECE", size)
        assert (fingerprints.bucket_counts(data) == whole).all()
    assert whole.sum() == 2 * (len(data) - 3) + 1 * (len(data) - 2) + 3 * (len(data) - 4)
    a, b = fingerprints.digest(b""), fingerprints.digest(data)
    assert 0 <= fingerprints.likeness(a, b) <= 1 == fingerprints.likeness(b, b)
    assert fingerprints.difference(a, b) <= 6 * fingerprints.BUCKETS + 81


def test_fingerprint_keeps_columns(docs):
    got = fingerprints.fingerprint(docs)
    assert got.columns == [*docs.columns, "fingerprint"] and got.count() == docs.count()


# simhash


def brute_print(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_groups(prints, radius=4):
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    ps = sorted(set(prints))
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    return {p: root(p) for p in ps}


def test_simhash_against_brute_force(docs, rows):
    prints = [brute_print(r[1]) for r in rows]
    group = brute_groups(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[group[p]] = min(least.get(group[p], r[0]), r[0])
    want = [(r[0], f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints, strict=True)]
    found = simhash.near_duplicates(docs)
    assert listed(found.select("doc_id", simhash.hexadecimal(), "component_id")) == sorted(want, key=repr)


@pytest.mark.parametrize("most", [32, 4096])
def test_links_of_dense_clusters(spark, most):
    rnd = random.Random(5)
    prints = set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))))
    prints |= {rnd.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 1, 3, 7, 15, 31, 63}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    got = {r.node: r.component for r in connected_components(simhash.links(df, most)).collect()}
    classes = lambda of: Counter(frozenset(v) for v in of.values())
    a, b = defaultdict(set), defaultdict(set)
    for p, g in brute_groups(prints).items():
        a[g].add(simhash.signed(p))
        b[got.get(simhash.signed(p), simhash.signed(p))].add(simhash.signed(p))
    assert classes(a) == classes(b)


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps[100:] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    moved, to = simhash.bucket_links(fps, np.array([0]))
    assert dict(zip(moved.tolist(), to.tolist(), strict=True)) == {i: i - 100 for i in range(100, 200)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 24, 31])
def test_near_pairs_of_any_radius(radius):
    rng = np.random.default_rng(radius)
    fps = np.concatenate([rng.integers(0, 1 << 63, 150, dtype=np.uint64), np.arange(40, dtype=np.uint64)])
    starts = np.array([0, 1, 90])
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.searchsorted(starts, i, "right") == np.searchsorted(starts, j, "right") and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert {(int(x), int(y)) for a, b in simhash.near_pairs(fps, starts, radius) for x, y in zip(a, b, strict=True)} == want


def test_empty_simhash(none):
    assert simhash.near_duplicates(none).count() == 0


# quality


def test_quality_against_sql(docs):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    df = quality.judged(unique).selectExpr("doc_id", *quality.COUNTS, "base_failed", "kept", "round(js_chars, 6) js_chars", "round(js_words, 6) js_words")
    con = duckdb.connect()
    con.register("frame", unique.toPandas())
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT doc_id, text::VARCHAR AS text, lang::VARCHAR lang FROM frame")
    want = con.sql(quality.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = df.toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    sizes = {r.doc_id: words(r.text) for r in unique.collect()}
    assert all(r.n_words == len(sizes[r.doc_id]) and r.word_chars == sum(map(len, sizes[r.doc_id])) for r in df.collect())


def test_quality_windows(spark):
    texts = ["a b c d e f g h " * 2, "x " * 9, "x " * 8, "a b c d e f g h i a b c d e f g h j", ""]
    got = [r.n_repeat_words for r in quality.judged(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")).orderBy("doc_id").collect()]
    assert got == [16, 9, 0, 16, 0]


def test_quality_passing(docs, none):
    kept = quality.passing(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.passing(none).count() == 0


# token ids


def test_rans_round_trips_and_checksums():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 5000, 16385, 70000):
        v = np.minimum(rng.zipf(1.4, n), 50_256).astype(np.uint16)
        t = rans.Table.unpack(rans.table(v).pack()) if n else rans.Table(np.zeros(0, np.uint16), np.zeros(0, np.uint32))
        blocks = rans.encode(v, t)
        assert (rans.decode(blocks, t) == v).all()
        for b in blocks:  # every block by itself
            assert len(rans.decode([b], t)) == b["n"]
    blocks[0]["words"] = b"\1" + blocks[0]["words"][1:] if blocks[0]["words"][0] != 1 else b"\2" + blocks[0]["words"][1:]
    with pytest.raises(rans.DamagedBlock):
        rans.decode(blocks, t)
    every = rans.table(np.arange(50_257, dtype=np.uint16).repeat(2))
    assert every.freqs.sum() == 1 << 16 and every.freqs.min() == 1


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file(model_names()[0]))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_ids_against_the_library(spark, docs, rows, none, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 3000)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r, ids in zip(order, library_ids([r[1] for r in order]), strict=True):
        ids = [*ids, 0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    tokens.write_ids(docs, str(tmp_path / "t"), tokens.tokenizer_file(model_names()[0]))
    assert listed(tokens.read_sums(spark, str(tmp_path / "t"))) == sorted(want, key=repr)
    assert sorted(len(r.ids) for r in tokens.read_ids(spark, str(tmp_path / "t")).collect()) == sorted(w[2] for w in want)
    tokens.write_ids(none, str(tmp_path / "e"), tokens.tokenizer_file(model_names()[0]))
    assert tokens.read_sums(spark, str(tmp_path / "e")).count() == 0


def test_token_pieces_of_odd_spaces(monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 50)
    monkeypatch.setattr(tokens, "WORDS", 50)
    e = tokens.Encoder(tokens.tokenizer_file(model_names()[0]))
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab'sé  \n\t\u00a0\u2003.,1🙂") for _ in range(rnd.randrange(40))) for _ in range(800)] + ["", " ", "don't stop 're  it's", "x<|endoftext|> y"]
    for i in range(0, len(texts), 100):
        got = [np.frombuffer(x, dtype=np.uint16).tolist() for x in e.encode(pa.array(texts[i : i + 100]))]
        assert got == library_ids(texts[i : i + 100])


# substrings


def brute_removal(rows, size=20):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - size + 1):
            k, at = tuple(w[i : i + size]), (-1 if r[0] is None else r[0], i)
            first[k] = min(first.get(k, at), at)
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (-1 if r[0] is None else r[0], i):
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("piece", "bits"), [(4 << 20, 1 << 28), (3000, 1 << 28), (3000, 64)])
def test_substrings_against_brute_force(docs, rows, monkeypatch, piece, bits):
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "FILTER_BITS", bits)
    got = listed(substrings.removal(docs))
    assert got == brute_removal(rows)
    assert sum(r[2] for r in got) > 500


def test_substrings_of_few_words(spark, none):
    """Few different words give periods of every length, inside a window's reach too."""
    rnd = random.Random(9)
    made = [(i, " ".join(rnd.choice("ab") if i % 2 else "abcde"[j % (1 + i % 5)] for j in range(rnd.randrange(60))), "", "", 0, "", "") for i in range(40)]
    df = spark.createDataFrame(made, none.schema)
    assert listed(substrings.removal(df)) == brute_removal(made)
    assert substrings.removal(none).count() == 0


def test_without_repeats(docs, rows):
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns
    want = [w[3] for w in brute_removal(rows)]
    assert sorted(hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() for r in got.collect()) == sorted(want)


# mixing


def brute_fluid(blocks, weights):
    """``f(t)``: each source's exact progress at time ``t``, by weights among those that have blocks left."""
    marks, now, done = [], Fraction(0), {s: Fraction(0) for s, n in blocks.items() if n}
    left = set(done)
    while left:
        rate = {s: Fraction(str(weights[s])) / sum(Fraction(str(weights[x])) for x in left) for s in left}
        marks.append((now, dict(done), rate))
        step = min((blocks[s] - done[s]) / rate[s] for s in left)
        now += step
        for s in left:
            done[s] += step * rate[s]
        left = {s for s in left if done[s] < blocks[s]}
    marks.append((now, done, {}))

    def f(t):
        at, was, rate = [m for m in marks if m[0] <= t][-1]
        return {s: was[s] + (t - at) * rate.get(s, 0) for s in was}

    def when(s, k):
        for (at, was, rate), (_, then, _) in zip(marks, marks[1:]):
            if was[s] <= k <= then[s] and rate.get(s):
                return at + (k - was[s]) / rate[s]

    return f, when


def brute_plan(blocks, weights):
    """Slots of all blocks: each released block is tried, the earliest deadline first."""
    _, when = brute_fluid(blocks, weights)
    done, out = Counter(), []
    windows = {(s, k): (math.floor(when(s, k)), math.ceil(when(s, k + 1))) for s, n in blocks.items() for k in range(n)}
    for slot in range(sum(blocks.values())):
        deadline, s = min((windows[s, done[s]][1], s) for s, n in blocks.items() if done[s] < n and windows[s, done[s]][0] <= slot)
        out.append((s, done[s], slot, windows[s, done[s]][0], deadline))
        done[s] += 1
    return out


def unrolled(plan):
    for s, first, end, q, k, start, width, slot, release, deadline in plan:
        for turn in range((end - first) // q):
            yield (s, first + turn * q + k, *(start + turn * width + x for x in (slot, release, deadline)))


@pytest.mark.parametrize("seed", range(8))
def test_schedule_against_brute_force(seed):
    """Past every exhaustion of a source; each is less than a block off its target at every slot."""
    rnd = random.Random(seed)
    blocks = {f"s{i}": rnd.randrange(0, 150) for i in range(8)}
    weights = {s: rnd.choice([1, 2, 0.5, 7, 0.1, 3.25]) for s in blocks}
    got = sorted(unrolled(mixing.plan_of(mixing.schedule(blocks, mixing.whole(weights)))), key=lambda x: x[2])
    assert got == brute_plan(blocks, weights)
    assert all(r <= slot < d for _, _, slot, r, d in got)
    f, _ = brute_fluid(blocks, weights)
    done = Counter()
    for at, (s, *_) in enumerate(got, 1):
        done[s] += 1
        assert all(abs(done[x] - y) < 1 for x, y in f(at).items())


def test_a_long_schedule_is_few_stretches():
    blocks = {f"s{i}": 10_000 * (i + 1) + 7 * i for i in range(20)}
    weight = mixing.whole({s: {"s0": 4.0, "s1": 0.5, "s2": 2.0}.get(s, 1.0) for s in blocks})
    assert sum(weight.values()) == 47
    made = list(mixing.schedule(blocks, weight))
    assert len(made) < 7 * len(blocks) and sum(s.times * len(s.slots) for s in made) == sum(blocks.values())
    ends = defaultdict(list)
    for s, first, end, q, k, *_ in mixing.plan_of(made):
        if k == 0:
            ends[s].append((first, end))
    for s, own in ends.items():
        assert [a for a, _ in own] == [0, *(b for _, b in own)][:-1] and own[-1][1] == blocks[s]


def test_whole_weights():
    assert mixing.whole({"a": 1, "b": 3}) == {"a": 1, "b": 3} and mixing.whole({"a": 0.5, "b": 0.1}) == {"a": 5, "b": 1}
    with pytest.raises(ValueError):
        mixing.whole({"a": 0})
    with pytest.raises(ValueError):
        mixing.whole({"a": 1e-9, "b": 1})


def spark_hash(doc_id, text):
    """The hash that orders documents."""
    h = xxhash.xxh64_intdigest(b"mix", 42)
    for x in (-(1 << 63) if doc_id is None else doc_id, zlib.crc32((text or "").encode())):
        h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h


def test_mixed_against_brute_force(docs, rows, none):
    """The whole result and its order."""
    weights, rest, size = {"hot": 3.0, "a": 0.5, "gone": 2.0}, 1.0, 500
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3] if r[3] in weights else ""].append(r)
    spots, ends = [], {}
    for s, own in by_source.items():
        at = 0
        for r in sorted(own, key=lambda r: (x := spark_hash(r[0], r[1]), x >= 1 << 63)):
            spots.append((r, s, at, at // size))
            at += len(r[1] or "") + 1
        ends[s] = -(-at // size)
    slots = {(s, b): rest_ for s, b, *rest_ in brute_plan(ends, {**weights, "": rest})}
    want = sorted(((r, s, at, b, *slots[s, b]) for r, s, at, b in spots), key=repr)
    got = mixing.mixed(docs, weights, rest, size)
    assert got.columns == ["row", "source", "start", "block", "slot", "release", "deadline"]
    assert sorted(((tuple(x.row), *x[1:]) for x in got.collect()), key=repr) == want
    order = [tuple(x.row)[:2] for x in sorted(got.collect(), key=lambda x: (x.slot, x.start))]
    assert order == [x[0][:2] for x in sorted(want, key=lambda x: (x[4], x[2]))]
    assert mixing.mixed(none, weights).count() == 0
    laid = mixing.in_mixed_order(docs, weights)
    assert laid.columns == docs.columns and listed(laid) == listed(docs)


def test_mixed_stays_near_the_targets_in_characters(spark):
    """Less than two blocks and the longest document off the fluid share, at every slot before a source runs out."""
    rnd = random.Random(2)
    made = [(i, "x" * rnd.randrange(200), rnd.choice("aab")) for i in range(3000)]
    weights, size = {"a": 1.0, "b": 3.0}, 1000
    got = mixing.mixed(spark.createDataFrame(made, "doc_id bigint, text string, source string"), weights, 1.0, size).collect()
    chars, slot = Counter(), -1
    f, _ = brute_fluid({s: max(x.block for x in got if x.source == s) + 1 for s in "ab"}, weights)
    for x in sorted(got, key=lambda x: (x.slot, x.start)):
        if x.slot != slot:
            slot = x.slot
            assert all(abs(chars[s] - size * y) < 2 * size + 201 for s, y in f(slot).items())
        chars[x.source] += len(x.row.text) + 1
    assert slot > 50


def test_positions_of_a_written_mix(docs, spark, tmp_path):
    """The order survives a write and a read, whatever order the rows come back in."""
    weights = {"hot": 3.0, "a": 0.5}
    rows = docs.drop("starts").withColumn("position", F.lit("own"))
    mixing.in_mixed_order(rows, weights).write.parquet(str(tmp_path / "laid"))
    got = mixing.with_positions(spark.read.parquet(str(tmp_path / "laid")))
    got = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(docs.count()))
    want = sorted(mixing.mixed(rows, weights).collect(), key=lambda r: (r.slot, r.start))
    assert [tuple(r.row) for r in got] == [tuple(r.row) for r in want]


# sharding


def test_sharding_laws(docs, rows, none):
    got = sharding.placed(docs).toPandas()
    assert sorted(got["size"]) == sorted(len((r[1] or "").encode()) + 16 for r in rows)
    assert sorted(got.text_crc32) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 40)).all()
    assert sharding.placed(none).count() == 0


def brute_shard(key, leaves):
    """Down the tree, level by level: each child draws a waiting time for the weight below it."""

    def wait(path, weight):
        seed = xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
        u = ((xxhash.xxh64_intdigest(path.encode(), seed) >> 11) + 0.5) / 2**53
        return -math.log(u) / weight

    for level in (0, 1, 2):
        nodes = defaultdict(list)
        for leaf in leaves:
            nodes[leaf[: level + 1]].append(leaf)
        path = min(nodes, key=lambda p: wait("/".join(map(str, p)), sum(leaf[3] for leaf in nodes[p])))
        leaves = nodes[path]
    return leaves[0][2]


def test_sharding_against_brute_force(docs, rows):
    got = listed(sharding.placed(docs), "doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    id_ = lambda r: -(1 << 63) if r[0] is None else r[0]
    want = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "key", brute_shard(id_(r), sharding.tree(40)), brute_shard(id_(r), sharding.grown(sharding.tree(40)))) for r in rows]
    assert got == sorted(want, key=repr)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """For trees of every size, and shard after shard."""
    df, trees = spark.range(600), {n: sharding.tree(n) for n in (1, 4, 5, 7, 10, 23, 40)}
    for n, leaves in trees.items():
        for more in range(5):
            df = sharding.shard_of(df, F.col("id"), leaves, f"s{n}_{more}")
            leaves = sharding.grown(leaves)
    got = df.toPandas()
    for n in trees:
        for more in range(4):
            before, after = got[f"s{n}_{more}"], got[f"s{n}_{more + 1}"]
            assert (after[before != after] == n + more).all() and before.max() < n + more
        assert got[f"s{n}_4"].nunique() == n + 4


def test_sharding_moves_stay_in_the_changed_subtree(spark):
    """A shard that gets heavier takes keys into its region; inside the region into its rack; inside the rack into itself."""
    keys = spark.range(20_000)
    leaves = sharding.tree(20)
    heavy = [(r, k, s, 3.0 if s == 0 else w) for r, k, s, w in leaves]
    a = sharding.shard_of(keys, F.col("id"), leaves)
    b = sharding.shard_of(a, F.col("id"), heavy, "after")
    moved = b.where("shard <> after").toPandas()
    assert len(moved) and (moved.after < 10).all()
    inside = moved[moved.shard < 10]
    assert len(inside) and (inside.after < 5).all() and (inside[inside.shard < 5].after == 0).all()
    counts = b.groupBy("after").count().toPandas().set_index("after")["count"]
    assert abs(counts[0] / 20_000 - 3 / 22) < 0.02 and abs(counts[15] / 20_000 - 1 / 22) < 0.02


# URLs


def test_globs_against_regular_expressions():
    rnd = random.Random(6)
    patterns = ["*", "**", "a*b", "?", "a?b", "*.a/**", "**/b*", "", "*a*b*", "a**b?*", "a" * 70 + "*b"]
    texts = ["".join(rnd.choice("ab./") for _ in range(rnd.randrange(9))) for _ in range(400)] + ["", "a" * 70 + "xxb", "a" * 5000]
    got = urls.Automaton.of(patterns).matches([t.encode() for t in texts])
    for p, pattern in enumerate(patterns):
        r = re.compile("".join({"**": "(?s:.)*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", pattern)))
        assert [bool(r.fullmatch(t)) for t in texts] == got[:, p].tolist(), pattern


def test_urls_against_sql(spark):
    made = [None, "", "nothing", "http://", "http://a.org", "https://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "x://a.com/fr/b", "x://a.com/de/b", "x://com/de/", "x://a.net/.org/es/", "x://spam.net/a", "x://a.net/b.exe?c", "x://a.net/é/ü", "x://a.net:80/de/9", "x://u@b.com/fr/", "a://b://c.org/", "x://a.net#/org/", "x://a.net/t.html", "X://A.COM/DE/"] * 2
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(made)], "page_id bigint, url string, html string, rule string")
    con = duckdb.connect()
    con.register("frame", df.toPandas())
    con.sql("CREATE TABLE pages AS SELECT page_id::BIGINT page_id, url::VARCHAR AS url FROM frame")
    got = urls.judged(df)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    clean = lambda rows: sorted(tuple(None if isinstance(x, float) else x for x in r) for r in rows)
    assert clean((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == clean((a, b, c, d or "", e) for a, b, c, d, e in con.sql("SELECT page_id, host, path, rule, verdict FROM (" + urls.ORACLE + ")").fetchall())
    assert urls.judged(df.limit(0)).count() == 0
    odd = df.withColumns({"a.b": F.lit("x"), "`c`": F.lit(1), "row": F.lit(2), "url ": F.lit("y")})
    assert urls.judged(odd).columns == ["page_id", "url", "html", "a.b", "`c`", "row", "url ", "host", "path", "rule", "verdict"]
    assert {(r["a.b"], r["`c`"], r["row"], r["url "]) for r in urls.judged(odd).collect()} == {("x", 1, 2, "y")}


# preferences


def line(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def brute_segments(chosen, rejected):
    """Rows of ``segments``, by its definition."""

    def sides(rows):
        out = defaultdict(lambda: defaultdict(set))
        for pair, turn, role, text in rows:
            out[pair][preferences.LAST if turn is None else turn].add((role or "", text or ""))
        return out

    def shown(pair, part, turns):
        for t, ms in turns.items():
            for i, (role, text) in enumerate(sorted(ms)):
                learnt = part != "prompt" and role == "assistant"
                yield pair, part, None if t == preferences.LAST else t, i, line(role, text), (len(role) + 5) * learnt, (len(text) + 8) * learnt

    c, r = sides(chosen), sides(rejected)
    for pair in set(c) & set(r):
        differ = [t for t in {*c[pair], *r[pair]} if c[pair].get(t) != r[pair].get(t)]
        border = min(differ, default=None)
        if border is None or border > max(c[pair]) or border > max(r[pair]):
            continue
        yield from shown(pair, "prompt", {t: m for t, m in c[pair].items() if t < border})
        yield from shown(pair, "chosen", {t: m for t, m in c[pair].items() if t >= border})
        yield from shown(pair, "rejected", {t: m for t, m in r[pair].items() if t >= border})


TURNS = "pair_id bigint, turn bigint, role string, text string, src string, h string"


def test_preferences_against_brute_force(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "A"), (2, 0, "user", "q"), (3, 0, "user", "same"), (4, None, None, None), (1, 0, "user", "hi"), (6, 0, "user", "x"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "other"), (1, 3, "assistant", "A"), (3, 0, "user", "same"), (5, 7, "assistant", "x"), (4, None, "assistant", ""), (6, 0, "user", "x"), (6, 1, "user", "y"), (None, 0, "user", "n"), (None, 1, "assistant", "k"), (None, 1, "tool", "k")]
    made = lambda rows: spark.createDataFrame([(*x, "s", "h") for x in rows], TURNS)
    parts = preferences.segments(made(c), made(r))
    assert listed(parts) == sorted(brute_segments(c, r), key=repr)
    assert {x.pair_id for x in parts.collect()} == {1, 4, None}
    one = {x.pair_id: x for x in preferences.joined(parts).collect()}[1]
    assert one.prompt == line("user", "hi") + line("assistant", "yes")
    (span,) = one.chosen_mask
    assert one.chosen[span.start : span.start + span.length] == "A<|end|>\n"
    assert preferences.segments(made([]), made([])).count() == 0


def test_pairs_from_conversations(spark):
    rnd = random.Random(3)
    t = [(c, i, "user" if i % 2 == 0 else "assistant", f"{c % 5} {rnd.randrange(4)}") for c in range(30) for i in range(rnd.randrange(6))]
    t += [*t[:9], (None, 0, "user", "x"), (None, 1, "assistant", "y"), (40, 0, "user", "alone"), (40, 1, "assistant", "z"), (50, None, "assistant", "late"), (51, None, None, None), (50, 0, "user", "u"), (51, 0, "assistant", "v"), (60, 1, "assistant", "two"), (60, 1, "tool", "messages"), (61, 2, "assistant", "one"), *[(70, i, "assistant", f"a{i}") for i in range(-3, 200)], *[(71, 5 * i, "assistant", f"b{i}") for i in range(120)], *[(72, i, "user", "u") for i in range(70)], (72, 70, "assistant", "p"), (73, 3, "assistant", "q")]
    c, r = [], []
    turns = defaultdict(lambda: defaultdict(set))
    for conv, turn, role, text in t:
        turns[conv][preferences.LAST if turn is None else turn].add((role or "", text or ""))
    last = {conv: max((i for i, ms in own.items() if any(m[0] == "assistant" for m in ms)), default=None) for conv, own in turns.items() if conv is not None}
    for conv, at in last.items():
        other = conv ^ 1
        if at is None or last.get(other) is None:
            continue
        c += [(conv, i, *m) for i, ms in turns[conv].items() for m in ms]
        r += [(conv, i, *m) for i, ms in turns[conv].items() if i < at for m in ms] + [(conv, at, *m) for m in turns[other][last[other]]]
    df = spark.createDataFrame([(*x, "s", "h") for x in t], TURNS.replace("pair_id", "conv_id"))
    got = listed(preferences.from_conversations(df))
    blank = lambda x: tuple(None if i == 2 and v == preferences.LAST else v for i, v in enumerate(x))
    assert got == sorted(map(blank, brute_segments(c, r)), key=repr) and len(got) > 60
    for pair in {x[0] for x in got}:
        assert {"chosen", "rejected"} <= {x[1] for x in got if x[0] == pair}
    assert preferences.from_conversations(df.limit(0)).count() == 0


# pieces


def test_pieces_against_the_library(docs, rows, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file(model_names()[1]))
    want = []
    for r in rows:
        ids = sp.encode(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert listed(pieces.round_trips(docs, pieces.model_file(model_names()[1]))) == sorted(want, key=repr)
    assert pieces.round_trips(none, pieces.model_file(model_names()[1])).count() == 0
    assert pieces.encoded(docs.where("text = 'one'"), pieces.model_file(model_names()[1])).first().ids == sp.encode("one")


def test_frequent_cuts_stay_known(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    codec = pieces.Codec(pieces.model_file(model_names()[1]))
    texts, calls, plain = ["alphabeta of gammadelta", "gammadelta  alphabeta"], [], codec._cut_ids
    want = codec.encode(texts)
    codec.encode([" ".join(f"w{i}x{i}" for i in range(200))])
    monkeypatch.setattr(codec, "_cut_ids", lambda cut: calls.append(cut) or plain(cut))
    assert codec.encode(texts) == want and not calls
    assert len(codec.known) <= 50


def test_a_worker_keeps_few_cuts():
    codec = pieces.Codec(pieces.model_file(model_names()[1]))
    for k in range(3):
        codec.encode([" ".join(f"{'abcdefgh'[i % 8]}{i}x" for i in range(k * 70_000, (k + 1) * 70_000))])
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in codec.known.items()) + sys.getsizeof(codec.known) + sys.getsizeof(codec.fits) + sum(map(sys.getsizeof, codec.fits))
    assert held < 32 << 20


def test_piece_codec_on_random_texts(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "CACHE", 100)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file(model_names()[1]))
    codec = pieces.Codec(pieces.model_file(model_names()[1]))
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randrange(60))) for a in ("aeit nsr", "= -#", "abcdefgh  ▁.\n\tXYZéß0123🙂日") for _ in range(600)]
    got = codec.encode(texts)
    assert got == sp.encode(texts)
    assert [codec.decode(x) for x in got] == [sp.decode(x) for x in got]
    wild = [[rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259)]) for _ in range(rnd.randrange(12))] for _ in range(1500)]
    assert [codec.decode(x) for x in wild] == [sp.decode(x) for x in wild]
    assert all(codec.text[i] == "".join(codec.merged(codec.text[i])) and len(codec.merged(codec.text[i])) == 1 for i in rnd.sample(sorted(codec.split), 300))
