import itertools

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import structure as st

# Molecules with known (atoms, bonds in rings, hydrogens, smallest rings, aromatic atoms).
KNOWN = {
    "CC(=O)Nc1ccc(O)cc1": (11, 6, 9, [6], 6),
    "CC(=O)Oc1ccccc1C(=O)O": (13, 6, 8, [6], 6),
    "Cn1cnc2c1c(=O)n(C)c(=O)n2C": (14, 10, 10, [5, 6], 9),
    "C[C@@H](N)C(=O)O.[Na+]": (7, 0, 7, [], 0),
    "C1=CC=CC=C1": (6, 6, 6, [6], 6),
    "C1=CC2=CC=CC=C2C=C1": (10, 11, 8, [6, 6], 10),
    "c1ccc2ccccc2c1": (10, 11, 8, [6, 6], 10),
    "C1CC%10CC1CC%10": (7, 8, 12, [5, 5], 0),
    "C1=CC=CC1": (5, 5, 6, [5], 0),
    "O=C1C=CC=CC1=O": (8, 6, 4, [6], 0),
    "c1cc[nH]c1": (5, 5, 5, [5], 5),
    "c1ccoc1": (5, 5, 4, [5], 5),
    "c1ccccc1c1ccccc1": (12, 12, 10, [6, 6], 12),
    "C1.CC1": (3, 0, 8, [], 0),
    "C1.C1": (2, 0, 6, [], 0),
    "[NH4+].[OH-]": (2, 0, 5, [], 0),
    "OS(=O)(=O)O": (5, 0, 2, [], 0),
    "C#N": (2, 0, 1, [], 0),
    "": (0, 0, 0, [], 0),
}


@pytest.fixture(scope="module")
def seen(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(KNOWN)], "i int, s string").repartition(3)
    return {r.s: r.x for r in st.perceive(df, "s", "x").collect()}


@pytest.mark.parametrize("text", KNOWN)
def test_known_structures(seen, text):
    x = seen[text]
    found = (len(x.atoms), sum(b.in_ring for b in x.bonds), sum(a.hydrogens for a in x.atoms), sorted(map(len, x.rings)), sum(a.aromatic for a in x.atoms))
    assert x.parse_ok and found == KNOWN[text]


def test_ring_bonds_are_those_that_are_no_bridges(seen):
    for text, x in seen.items():
        for i, b in enumerate(x.bonds):
            near, grown = {b.src}, True
            while grown:
                more = {v for j, e in enumerate(x.bonds) if j != i for u, v in ((e.src, e.dst), (e.dst, e.src)) if u in near}
                grown = not more <= near
                near |= more
            assert b.in_ring == (b.dst in near), text


def brute(pattern, x):
    """Distinct atom sets by trying all placings."""

    def fits(want, a):
        return (
            (not want.elements or a.element in want.elements)
            and (want.aromatic is None or a.aromatic == want.aromatic)
            and a.hydrogens >= want.min_hydrogens
            and (want.in_ring is None or a.in_ring == want.in_ring)
            and (not want.charged or a.charge != 0)
        )

    bonds = {}
    for b in x.bonds:
        bonds[b.src, b.dst] = bonds[b.dst, b.src] = b
    ok = lambda b, labels: b and (not labels or b.label in labels) and (pattern.ring_bonds is None or b.in_ring == pattern.ring_bonds)
    choices = [[i for i, a in enumerate(x.atoms) if fits(want, a)] for want in pattern.atoms]
    hits = set()
    for place in itertools.product(*choices) if len(choices) < 5 else []:
        if len(set(place)) == len(place) and all(ok(bonds.get((place[a], place[b])), labels) for a, b, labels in pattern.bonds):
            hits.add(frozenset(place))
    return len(hits)


def test_counts_equal_trying_all_placings(spark, seen):
    df = spark.createDataFrame([(s,) for s in KNOWN], "s string")
    keys = [k for k in st.STRUCTURE_KEYS if len(k.pattern.atoms) < 5]
    assert len({k.pattern for k in keys}) > 30
    got = {r.s: set(r.bits) for r in st.structure_key_bits(df, "s", keys).collect()}
    for s in KNOWN:
        assert got[s] == {k.key for k in keys if brute(k.pattern, seen[s]) >= k.min_count}, s


def test_tables_give_the_same_counts(spark, seen):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(KNOWN)], "i int, s string")
    nodes, edges = (t.cache() for t in st.structure_tables(df, "i", "s"))
    for name in ("amide", "geminal halogens", "three-ring", "one atom between", "biaryl", "six-ring", "aromatic bond"):
        pattern = next(p for p in st.PATTERNS if p.name == name)
        got = {r.graph_id: r.n for r in st.match_in_tables(nodes, edges, pattern).collect()}
        rows = df.select("i", F.lit(0).alias("_"), "s")
        own = st.perceive(rows, "s", "_s").withColumn(
            "_links",
            F.expr("flatten(transform(_s.bonds, b -> array(named_struct('src', b.src, 'dst', b.dst, 'label', b.label, 'in_ring', b.in_ring, 'far', _s.atoms[b.dst]), named_struct('src', b.dst, 'dst', b.src, 'label', b.label, 'in_ring', b.in_ring, 'far', _s.atoms[b.src]))))"),
        )
        want = {r.i: r.n for r in own.select("i", st.count_pattern(pattern, "_s.atoms", "_links").alias("n")).collect() if r.n}
        assert got == want, name


def test_unreadable_and_null_texts(spark):
    df = spark.createDataFrame([("C((",), (None,), ("C",)], "s string")
    assert [r.bits is None for r in st.structure_key_bits(df, "s").collect()] == [True, False, False]
    assert st.structure_key_bits(df.where("false"), "s").count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([("C",)], "s string")
    plan = st.structure_key_bits(df, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
