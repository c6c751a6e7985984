import pytest
from pyspark.sql import functions as F

from tallyfold.operators import graphs

# hand-counted (atoms, bonds)
KNOWN = {
    "CC(=O)Nc1ccc(O)cc1": (11, 11),
    "CC(=O)Oc1ccccc1C(=O)O": (13, 13),
    "Cn1cnc2c1c(=O)n(C)c(=O)n2C": (14, 15),
    "C[C@@H](N)C(=O)O.[Na+]": (7, 5),
    "C(C(F)(Cl)Br)(C)C": (7, 6),
    "C1CC%10CC1CC%10": (7, 8),
    "C": (1, 0),
    "": (0, 0),
}


@pytest.fixture(scope="module")
def molecules(spark):
    data = [(i, s) for i, s in enumerate(KNOWN)]
    return spark.createDataFrame(data, "id int, s string").repartition(3)


def test_atom_and_bond_counts(molecules):
    got = graphs.parse_notation(molecules, "s").select("s", F.size("graph.atoms"), F.size("graph.edges"), "graph.parse_ok")
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == KNOWN
    assert all(r[3] for r in got.collect())


def test_bond_labels(rows):
    got = graphs.parse_notation(rows([("C=CC#N",), ("c1ccc1",), ("C=1CC1",), ("F/C=C\\F",), ("CC(=O)O",)], "s string"), "s")
    edges = {r.s: sorted((e.src, e.dst, e.bond) for e in r.graph.edges) for r in got.collect()}
    assert edges["C=CC#N"] == [(0, 1, "="), (1, 2, "-"), (2, 3, "#")]
    assert edges["c1ccc1"] == [(0, 1, ":"), (0, 3, ":"), (1, 2, ":"), (2, 3, ":")]
    assert edges["C=1CC1"] == [(0, 1, "-"), (0, 2, "="), (1, 2, "-")]
    assert edges["F/C=C\\F"] == [(0, 1, "-"), (1, 2, "="), (2, 3, "-")]
    assert edges["CC(=O)O"] == [(0, 1, "-"), (1, 2, "="), (1, 3, "-")]


@pytest.mark.parametrize("text", ["C?C", "C(C", "CC)", "C1CC", "hello world"])
def test_bad_strings_are_flagged(rows, text):
    assert graphs.parse_notation(rows([(text,)], "s string"), "s").first().graph.parse_ok is False


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_table_and_row_forms_agree(molecules, radius):
    nodes, edges = graphs.notation_tables(molecules, "id", "s")
    table = {r.graph_id: r.bits for r in graphs.graph_bits(nodes, edges, radius, 256).collect()}
    row = {r.id: r.bits for r in graphs.notation_bits(molecules, "s", radius, 256).collect()}
    assert {i: b for i, b in row.items() if b} == table
    assert [i for i, b in row.items() if not b] == [list(KNOWN).index("")]


def test_writing_order_does_not_matter(rows):
    got = graphs.notation_bits(rows([("OCC(N)C",), ("CC(N)CO",), ("C(CO)(C)N",)], "s string"), "s", 2, 1024)
    assert len({tuple(r.bits) for r in got.collect()}) == 1


def test_neighbourhood_matters(rows):
    got = graphs.notation_bits(rows([("CCO",), ("COC",), ("C=CO",)], "s string"), "s", 1, 4096)
    assert len({tuple(r.bits) for r in got.collect()}) == 3


def test_hub_node(spark):
    nodes = spark.range(2001).select(F.lit(1).alias("graph_id"), F.col("id").cast("int").alias("node_id"), F.lit("C").alias("label"))
    edges = spark.range(1, 2001).select(F.lit(1).alias("graph_id"), F.lit(0).alias("src"), F.col("id").cast("int").alias("dst"), F.lit("-").alias("label"))
    hashes = graphs.graph_node_hashes(nodes, edges, 1)
    assert hashes.count() == 2001
    assert hashes.select("h1").distinct().count() == 2


def test_unreadable_texts_are_never_silent(rows):
    df = rows([(1, "CCO"), (2, "CC??O"), (3, "hello"), (4, "C1CC"), (5, None), (6, "")], "id int, s string")
    assert {r.id for r in graphs.unreadable(df, "id", "s").collect()} == {2, 3, 4, 5}
    bits = {r.id: r.bits for r in graphs.notation_bits(df, "s", 2, 256, bad="null").collect()}
    assert bits[1] and bits[2] is None and bits[3] is None and bits[4] is None
    nodes, edges = graphs.notation_tables(df, "id", "s", bad="null")
    assert {r.graph_id for r in nodes.collect()} == {1} == {r.graph_id for r in edges.collect()}
    with pytest.raises(Exception, match="not line notation"):
        graphs.notation_bits(df, "s", 2, 256).collect()
    with pytest.raises(ValueError):
        graphs.notation_bits(df, "s", 2, 256, bad="skip")
