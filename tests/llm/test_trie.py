import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyfold.llm import prefix_trie as trie
from tallyfold.llm.common import table

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Plain rebuild of conversations from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        made[c] = own.get(base, [])[:h] + ts[h:]
    return made


def brute(convs):
    members, below = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                below[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df, **how):
    turns = trie.ordered_turns(df)
    rows = trie.prefix_nodes(*trie.rebuilt_turns(turns), **how).collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {tuple(r[c] for c in FIELDS) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_double_array_holds_its_paths():
    rng = random.Random(5)
    paths = sorted({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(7))) for _ in range(500)})
    da = trie.DoubleArray([list(p) for p in paths])
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(da.order) == len(prefixes) == len(set(da.order))
    assert len({s for p in paths for s in da.walk(list(p))}) == len(prefixes)
    missing = next(p for p in ((a, b, 41) for a in range(1, 40) for b in range(1, 40)) if p not in prefixes)
    with pytest.raises(KeyError):
        list(da.walk(list(missing)))
    assert len(da.check) < 2 * len(prefixes) + 40  # packed


@pytest.mark.parametrize("how", [{}, {"least": 3}, {"least": 1, "most_upper": 10}])
def test_nodes_equal_plain_rebuild(spark, how):
    rng = random.Random(7)
    rows = []
    for c in range(160):
        if c % 11 == 0:
            continue  # absent, also as a base
        n = rng.randrange(1, 9) if c != 30 else 120
        for t in range(n):
            same = c % 3 == 0 and t < 6  # a third begins alike
            rows.append((c, t, "user" if t % 2 == 0 else None, f"é{t}" if same else rng.choice(["a", "b", "", None, f"long {rng.randrange(5)}"])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]  # equal conversations
    rows += [(-7, 1, "user", "x"), (-5, 0, "user", "y"), (300, None, "user", "null first"), (300, 0, "user", "second")]
    assert nodes(frame(spark, rows), **how) == brute(rebuilt(rows))


def test_odd_rows(spark):
    assert nodes(frame(spark, [])) == set()
    rows = [(None, 1, "user", "left out"), (5, None, None, None), (6, 1, "user", "x " * 50_000), (7, 2, "a", "b"), (7, 2, "a", "b")]
    extra = frame(spark, rows).selectExpr("*", "1 as n", "'x' as cut", "2 as depth", "3 as place", "4 as h")
    assert nodes(extra) == brute(rebuilt(rows))


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert nodes(df) == nodes(df, least=20) == brute(rebuilt(rows))
