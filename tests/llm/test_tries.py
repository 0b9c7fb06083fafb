"""The prefix trie against a plain one, with blocks of every size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from factloom.llm import frames, tries
from tests.llm.test_operators import listed, words

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        out[c] = tuple((own.get(c - c % 20, [])[:h] if h else []) + turns[h:])
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(set)
    order = lambda c: (c is not None, c or 0)
    for c, turns in convs.items():
        ends[turns].add(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = defaultdict(set)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(own) - 1) * len(words(n[-1][1])) if n else 0
    sha = lambda cs: hashlib.sha256(",".join("" if c is None else str(c) for c in sorted(cs, key=order)).encode()).hexdigest()
    least = lambda n: min(members[n], key=order)
    return sorted(((least(n), len(n), least(n[:-1]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()), key=repr)


def made(seed, convs=150):
    rnd = random.Random(seed)
    said = ["", None, "one", "two  words", "è three\tmore words\n"]
    turn = lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(said[: rnd.choice([2, 5])]))
    known, rows = [[]], []
    for c in rnd.sample(range(10 * convs // 4), convs):
        base = rnd.choice(known)
        turns = base[: rnd.randrange(len(base) + 1)] + [turn() for _ in range(rnd.randrange(4))] or [turn()]
        known.append(turns)
        if rnd.random() < 0.3:
            turns = known[1]
        rows += [(c, i if i or rnd.random() < 0.5 else None, *t) for i, t in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 14])
def test_nodes_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(tries, "BLOCK", block)
    rows = made(block)
    got = listed(tries.from_conversations(spark.createDataFrame(rows, COLUMNS).repartition(5)))
    assert got == brute(rebuilt(rows))


def test_any_prefixes_in_any_blocks():
    """Without Spark: all shares of a node, from every way to cut the keys, add up."""
    rnd = random.Random(3)
    for _ in range(200):
        turn = lambda: rnd.choice([b"a", b"b", b"c"]) * 16 + rnd.randrange(3).to_bytes(8, "big")
        keys = sorted({b"".join(turn() for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(1, 30))})
        whole = [r[3:] for r in tries.nodes_of(keys, [1] * len(keys), list(range(len(keys))), ["x"] * len(keys), -1, -1)]
        cuts = sorted({0, len(keys), *(rnd.randrange(len(keys) + 1) for _ in range(4))})
        shares, done = defaultdict(list), []
        for a, b in zip(cuts, cuts[1:]):
            left = tries.common(keys[a - 1], keys[a]) if a else -1
            right = tries.common(keys[b - 1], keys[b]) if b < len(keys) else -1
            for r in tries.nodes_of(keys[a:b], [1] * (b - a), list(range(a, b)), ["x"] * (b - a), left, right):
                if r[0]:
                    shares[r[1]].append(r)
                else:
                    done.append(r)
        least = {h: min(r[4] for r in rs) for h, rs in shares.items()}
        merged = [(rs[0][3], least[h], least.get(rs[0][2]), *(sum(r[i] for r in rs) for i in (6, 7, 8, 9)), max((r[10] or "") for r in rs) or None) for h, rs in shares.items()]
        done = [(r[3], r[4], least[r[2]] if r[2] else r[5], *r[6:]) for r in done]
        assert sorted(merged + done, key=repr) == sorted(whole, key=repr)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x y"), (40, 1, "user", "a"), (41, 1, "user", "b"), (41, 1, "user", "b"), (45, 0, "u", None), (-7, 0, "user", "z" * 100_000), (61, 2, "user", "q")]
    wide = spark.createDataFrame([(*r, "p", "q") for r in rows], COLUMNS + ", key string, `a.b` string")
    want = brute(rebuilt([r for r in rows if r[0] != -7] + [(-7, 0, "user", "z" * 100_000)]))
    assert listed(tries.from_conversations(wide)) == want
    assert tries.from_conversations(wide.limit(0)).count() == 0


def test_a_group_of_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(5000, 9000) for t in range(3)] + [(1, t, "user", f"turn {t}") for t in range(3000)]
    got = listed(tries.from_conversations(spark.createDataFrame(rows, COLUMNS)))
    want = brute_fast(rebuilt(rows))
    assert len(got) == want[0] and max(r[3] for r in got) == want[1]


def brute_fast(convs):
    nodes = {hashlib.md5(repr(t[:d]).encode()).digest() for t in {v for v in convs.values() if len(v) < 10} for d in range(len(t) + 1)}
    long = next(v for v in convs.values() if len(v) > 10)
    return len(nodes) + len(long), len(convs)


def test_null_id_is_apart():
    assert rebuilt([(None, 1, "a", "b"), (0, 1, "c", "d")])[None] == (("a", "b"),) and frames.NULL_ID < 0
