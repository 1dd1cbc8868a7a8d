"""The conversation trie against a plain one, and its edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fleetspark.llm import conversation_trie as ct
from tests.compare import connection, same

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    turns, members = defaultdict(list), set()
    for c, turn, role, text in rows:
        if c is not None:
            members.add(c)
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for c in members:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        whole[c] = tuple(t[2:] for t in [*sorted(turns[c - c % 5])[:h], *sorted(turns[c])[h:]])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    out = {}
    for pre, who in nodes.items():
        below = [p for p in nodes if p[: len(pre)] == pre]
        inside = lambda p: [q for q in below if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in who if whole[c] == pre)))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out[min(who), len(pre)] = (min(nodes[pre[:-1]]) if pre else None, len(who), len(inside(pre)), sum(not inside(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows_of(df):
    got = {}
    for r in df.collect():
        assert (r.conv_id, r.depth) not in got
        got[r.conv_id, r.depth] = (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
    return got


def table(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(200), n):
        for turn in range(r.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", "", None, "long " * 30])))
    for c in range(300, 340):  # a hot conversation
        rows += [(c, t, "user", f"hot {t}") for t in range(4)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("per_shard", [3, 1_000_000])
def test_equals_the_plain_trie(spark, seed, per_shard):
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(ct.trie(ct.rebuilt(df), per_shard)) == plain(rows)
    if seed == 0:
        assert rows_of(ct.prefix_trie(df.repartition(7), per_shard)) == plain(rows, rebuild=False)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, None, None, None), (6, 1, "user", "z" * 300_000), (7, 0, "user", "z" * 300_000), (7, 0, "assistant", ""), (-3, 0, "user", "b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", id int, name string")
    assert rows_of(ct.trie(ct.rebuilt(df))) == plain([(c, t, r, x) for c, t, r, x in rows if c != -3] + [(-3, 0, "user", "b")])
    assert ct.trie(ct.rebuilt(spark.createDataFrame([], SCHEMA))).isEmpty()
    assert ct.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).isEmpty()


def test_turnless_members_are_of_the_root(spark):
    # conversation 1 loses its only turn to a base that is not there
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    got = rows_of(ct.trie(ct.rebuilt(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA))))
    assert got == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_digest_over_blocks(spark):
    ids = [*range(70_000, 70_010), *range(5), 200_000]
    members = spark.createDataFrame([(1, i) for i in ids] + [(2, 9)], "name long, conv_id long")
    want = {1: ",".join(map(str, sorted(ids))), 2: "9"}
    assert {r.name: r.sha256 for r in ct.digests(members).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_tree_is_balanced_by_medians():
    tree = ct.Tree()
    for i in ct.medians(1023):
        tree.insert([i], [1], 1, i)
    deepest, stack = 0, [(tree.same[0], 1)]
    while stack:
        node, depth = stack.pop()
        if node:
            deepest = max(deepest, depth)
            stack += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest == 10


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(ct.op13_conversation_trie(spark, sf), connection(sf), ct.OP13_SQL)
