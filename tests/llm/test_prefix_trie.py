"""The prefix trie against a plain version with tuples."""

import hashlib
import re
import zlib

import numpy as np

from strataspark.llm import op13_prefix_trie as op
from tests.conftest import DATA

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    by = {c: [t[-1] for t in sorted(ts)] for c, ts in by.items()}
    members = {}
    seqs = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        seqs[c] = (*by.get(base, [])[:h], *own[h:])
        for d in range(len(seqs[c]) + 1):
            members.setdefault(seqs[c][:d], []).append(c)
    inner = {s[:-1] for s in members if s}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in inner
            saved[s[:d]] += (len(who) - 1) * words
    children = {}
    for s in members:
        if s:
            children[s[:-1]] = children.get(s[:-1], 0) + 1
    out = []
    for s, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if seqs[c] == s)))
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), children.get(s, 0), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, `key` string, n int")
    got = op.prefix_trie(df.repartition(5))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_oracle(spark, same):
    same(op.query(spark, DATA), op.ORACLE)


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(op, "IDS", 3)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(-45, 130):
        if c % 20 == 0 and c % 3 == 0:
            continue  # some heads are absent
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "bot", None]), rng.choice(["a b", "a\tb  c", "", None, "d\x0be é x"])))
    rows += [(500, 3, "user", "same"), (500, 3, "user", "same"), (500, 3, "bot", "other"), (None, 1, "user", "lost"), (None, None, None, None)]
    check(spark, rows)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(7, t, "user", f"w{t % 3} x") for t in range(700)] + [(27, t, "user", f"w{t % 3} x") for t in range(650)]
    rows += [(c, t, "bot", "hello all") for c in range(1000, 1400) for t in range(3)]
    check(spark, rows)


def test_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert op.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    assert op.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    check(spark, [(21, 0, None, None)])


def test_no_rounds_by_depth(spark):
    # sums of subtrees took a round of joins for each doubling of the depth, each with plans that the driver kept
    def stages(turns):
        tracker, group = spark.sparkContext.statusTracker(), f"depth {turns}"
        spark.sparkContext.setJobGroup(group, group)
        rows = [(c, t, "user", f"w{t} x") for c in (7, 27) for t in range(turns + c)]
        op.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    few, many = stages(4), stages(400)
    assert many <= few + 6
