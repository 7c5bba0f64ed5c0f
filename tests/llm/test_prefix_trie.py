"""The trie of conversations against one that is built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from quill.llm import prefix_trie


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    under = defaultdict(set)
    for node in members:
        for d in range(len(node) + 1):
            under[node[:d]].add(node)
    out = []
    for node, cs in members.items():
        ends = sorted(c for c in cs if len(paths[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^ \t-\r]+", x[-1][1])) for x in under[node] if x)
        leaves = sum(not kids[x] for x in under[node])
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, base int, path string, c int")
    got = prefix_trie.prefix_trie(df)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == plain(rows)


def test_families_share_nodes(spark):
    rng = random.Random(1)
    texts = ["a b", "a  b", "c", "", None, "d\te\n", "f", "word " * 30]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in rng.sample(range(-90, 700), 400) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", "the same") for c in range(1000, 1400) for t in range(3)]  # one conversation a hundred times and more
    rows += [(2001 + 20 * i, t, "user", f"deep {t}") for i in range(3) for t in range(150 + i)]  # long, without a base
    rows += [(5, None, "user", "first"), (5, None, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(-7, 1, "user", "of base zero"), (0, 0, "user", "base"), (7, 0, "user", "base"), (-27, 0, "user", "base of minus twenty"), (10**15 + 3, 0, None, None)]
    rng.shuffle(rows)
    check(spark, rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    ids = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:12]
    check(spark, [(c, 0, "user", "taken from a base that is not there") for c in ids])


def test_roles_and_texts_do_not_run_together(spark):
    check(spark, [(20, 0, "ab", "c"), (40, 0, "a", "bc"), (60, 0, "", "abc"), (80, 0, "1:a", "b"), (100, 0, None, "1:ab")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 100)
    monkeypatch.setattr(prefix_trie, "ROWS", 3)
    check(spark, [(c, t, "user", f"t{t}") for c in range(900) for t in range(2)])
