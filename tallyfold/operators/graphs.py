"""Line-notation strings as graphs, and circular fingerprints of graphs.

A string is small and whole in its row, so it is read by one fold over its symbols: no shuffle.
Graphs held as node and edge tables may be of any size and shape; their fingerprint is joins and
pre-aggregated sums keyed by node, so neither a large graph nor a hub node lands in one task whole.
Both give the same bits for the same graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.hashing import fold, hasher
from tallyfold.functions.scalars import let
from tallyfold.operators.ranking import settled

# Symbols of the notation (bracket atom, two-letter atoms, one-letter atoms, ring labels, branches, bonds).
SYMBOL = r"(\[[^\]]+\]|Br|Cl|[BCNOSPFIbcnosp]|%[0-9]{2}|[0-9]|[()]|[-=#$:/\\.])"
ATOM = r"^(\[|[A-Za-z])"
LOWER_ATOM = r"^\[?[0-9]*[a-z]"
RING = r"^(%?[0-9]+)$"
BOND = r"^[-=#$:/\\]$"

_STATE = """struct<cur:int,stack:array<int>,bond:string,
    open:array<struct<ring:string,node:int,bond:string>>,
    atoms:array<string>,edges:array<struct<src:int,dst:int,bond:string>>,bad:boolean>"""


def _bond_label(first: Column, second: Column, left: Column, right: Column) -> Column:
    written = F.when(first != "", first).when(second != "", second)
    written = F.when(written.isin("/", "\\"), "-").otherwise(written)
    return F.coalesce(written, F.when(left.rlike(LOWER_ATOM) & right.rlike(LOWER_ATOM), ":").otherwise("-"))


# Kinds of symbols, told once per symbol before the fold.
_IS_ATOM, _IS_RING, _IS_BOND, _IS_OTHER = range(4)


def _with_kind(t: Column) -> Column:
    kind = F.when(t.rlike(ATOM), F.lit(_IS_ATOM)).when(t.rlike(RING), F.lit(_IS_RING)).when(t.rlike(BOND), F.lit(_IS_BOND)).otherwise(F.lit(_IS_OTHER))
    return F.struct(t.alias("t"), kind.alias("kind"))


def _step(s: Column, x: Column) -> Column:
    """State after one symbol: current atom, branch stack, pending bond, open rings, atoms and edges so far.

    Its types are those of the start, so that no step copies the lists so far by a cast.
    """
    t = x["t"]
    n = F.size(s["atoms"])
    is_atom = x["kind"] == _IS_ATOM
    is_ring = x["kind"] == _IS_RING
    is_bond = x["kind"] == _IS_BOND
    match = F.get(F.filter(s["open"], lambda o: o["ring"] == t), F.lit(0))
    closes = is_ring & match.isNotNull()
    here = F.get(s["atoms"], s["cur"])
    edge_type = "struct<src:int,dst:int,bond:string>"
    chain = F.struct(s["cur"].alias("src"), n.alias("dst"), _bond_label(s["bond"], F.lit(""), here, t).alias("bond"))
    opened = F.struct(t.alias("ring"), s["cur"].alias("node"), s["bond"].alias("bond"))

    def ring(m: Column) -> Column:
        return F.struct(
            m["node"].alias("src"),
            s["cur"].alias("dst"),
            _bond_label(m["bond"], s["bond"], F.get(s["atoms"], m["node"]), here).alias("bond"),
        ).cast(edge_type)

    return F.struct(
        F.when(is_atom, n)
        .when(t == ")", F.get(s["stack"], F.size(s["stack"]) - 1))
        .when(t == ".", F.lit(-1))
        .otherwise(s["cur"])
        .alias("cur"),
        F.when(t == "(", F.array_append(s["stack"], s["cur"]))
        .when(t == ")", F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0))))
        .otherwise(s["stack"])
        .alias("stack"),
        F.when(is_bond, t).when(t == "(", s["bond"]).otherwise(F.lit("")).alias("bond"),
        F.when(closes, F.filter(s["open"], lambda o: o["ring"] != t))
        .when(is_ring, F.array_append(s["open"], opened))
        .otherwise(s["open"])
        .alias("open"),
        F.when(is_atom, F.array_append(s["atoms"], t)).otherwise(s["atoms"]).alias("atoms"),
        F.when(is_atom & (s["cur"] >= 0), F.array_append(s["edges"], chain.cast(edge_type)))
        .when(closes, F.array_append(s["edges"], let(match, ring)))
        .otherwise(s["edges"])
        .alias("edges"),
        (s["bad"] | ((t == ")") & (F.size(s["stack"]) == 0)) | (is_ring & (s["cur"] < 0))).alias("bad"),
    )


_GRAPH = "struct<atoms:array<string>,edges:array<struct<src:int,dst:int,bond:string>>,parse_ok:boolean>"


def parse_notation(df: DataFrame, text: str, name: str = "graph") -> DataFrame:
    """Add ``struct(atoms: array<string>, edges: array<struct(src, dst, bond)>, parse_ok: boolean)``.

    ``parse_ok`` is false for characters outside the notation, unbalanced branches and open rings.
    No chemical perception: atoms are the symbols as written.
    """
    start = F.struct(
        F.lit(-1).alias("cur"),
        F.array().cast("array<int>").alias("stack"),
        F.lit("").alias("bond"),
        F.array().cast("array<struct<ring:string,node:int,bond:string>>").alias("open"),
        F.array().cast("array<string>").alias("atoms"),
        F.array().cast("array<struct<src:int,dst:int,bond:string>>").alias("edges"),
        F.lit(False).alias("bad"),
    ).cast(_STATE)
    source = F.coalesce(F.col(text), F.lit(""))

    def finish(symbols: Column, end: Column) -> Column:
        ok = (
            (F.length(F.array_join(symbols, "")) == F.length(source))
            & ~end["bad"]
            & (F.size(end["stack"]) == 0)
            & (F.size(end["open"]) == 0)
        )
        return F.struct(end["atoms"].alias("atoms"), end["edges"].alias("edges"), ok.alias("parse_ok"))

    symbols = F.regexp_extract_all(source, F.lit(SYMBOL), F.lit(1))
    return df.withColumn(name, let(symbols, lambda s: let(F.aggregate(F.transform(s, _with_kind), start, _step), lambda end: finish(s, end))))


BAD = ("error", "null")


def _readable(graph: Column, text: Column, bad: str) -> Column:
    """The parsed graph; for a text that cannot be read null, or an error that shows it."""
    if bad not in BAD:
        raise ValueError(f"bad must be one of {BAD}")
    note = F.concat(F.lit("not line notation: "), F.coalesce(F.substring(text, 1, 100), F.lit("null")))
    instead = F.raise_error(note).cast(_GRAPH) if bad == "error" else F.lit(None).cast(_GRAPH)
    return F.when(graph["parse_ok"], graph).otherwise(instead)


def unreadable(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, text)`` of the rows whose text is not line notation; null is not."""
    parsed = parse_notation(df.select(row_id, text), text, "_g")
    return parsed.where(~F.col("_g.parse_ok") | F.col(text).isNull()).select(row_id, text)


def notation_tables(df: DataFrame, row_id: str, text: str, bad: str = "error") -> tuple[DataFrame, DataFrame]:
    """Node table ``(graph_id, node_id, label)`` and edge table ``(graph_id, src, dst, label)``.

    A text that cannot be read is an error, or has no nodes and edges with ``bad="null"``.
    """
    parsed = parse_notation(df.select(F.col(row_id).alias("graph_id"), text), text)
    # stored, so that no string is parsed once for the nodes and once more for the edges
    parsed = settled(parsed.select("graph_id", _readable(F.col("graph"), F.col(text), bad).alias("graph")), "parsed")
    # the outer forms keep the optimizer from parsing every string a second time just to test for emptiness
    nodes = parsed.select("graph_id", F.posexplode_outer("graph.atoms").alias("node_id", "label"))
    edges = parsed.select("graph_id", F.inline_outer("graph.edges").alias("src", "dst", "label"))
    return nodes.where(F.col("node_id").isNotNull()), edges.where(F.col("src").isNotNull())


# Neighbour hashes are summed in two 30-bit halves: sums are order-free, pre-aggregate and cannot overflow.
_HALF = 30


def _high(h: Column) -> Column:
    return F.shiftright(h, _HALF)


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << _HALF) - 1))


def _node_text(k: int, own: Column, n: Column, high: Column, low: Column) -> Column:
    return F.concat_ws(":", F.lit(str(k)), own.cast("string"), n.cast("string"), high.cast("string"), low.cast("string"))


def _message_text(bond: Column, h: Column) -> Column:
    return F.concat_ws(":", bond, h.cast("string"))


def graph_node_hashes(nodes: DataFrame, edges: DataFrame, radius: int, hash: str = "md5") -> DataFrame:
    """Neighbourhood hashes ``(graph_id, node_id, h0 … hr)`` of every node.

    Round 0 hashes ``label:degree``; round k hashes a node's last value with the multiset of
    ``bond:last value`` of its neighbours.  A node sends itself its own row as well, so a round is one
    join and one pre-aggregated sum, and earlier rounds are read once.
    """
    h = hasher(hash)
    own = nodes.select(
        "graph_id",
        F.col("node_id").alias("src"),
        F.col("node_id").alias("dst"),
        F.lit(None).cast("string").alias("bond"),
        F.col("label").alias("atom"),
    )
    both = edges.select(
        "graph_id",
        F.inline(
            F.array(
                F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
            )
        ),
        F.col("label").alias("bond"),
        F.lit(None).cast("string").alias("atom"),
    )
    links = own.unionByName(both)
    ids = (
        links.groupBy("graph_id", "src")
        .agg(F.max("atom").alias("atom"), F.count("bond").alias("degree"))
        .select("graph_id", F.col("src").alias("dst"), h(F.concat_ws(":", "atom", F.col("degree").cast("string"))).alias("h0"))
    )
    links = links.select("graph_id", "src", "dst", "bond")
    for k in range(1, radius + 1):
        last = f"h{k - 1}"
        sent = h(_message_text(F.col("bond"), F.col(last)))
        is_own = F.col("bond").isNull()
        ids = (
            links.join(ids, ["graph_id", "dst"])
            .withColumn("_m", F.when(~is_own, sent))
            .groupBy("graph_id", "src")
            .agg(
                *[F.max(F.when(is_own, F.col(f"h{j}"))).alias(f"h{j}") for j in range(k)],
                F.count("_m").alias("_n"),
                F.coalesce(F.sum(_high(F.col("_m"))), F.lit(0)).alias("_hi"),
                F.coalesce(F.sum(_low(F.col("_m"))), F.lit(0)).alias("_lo"),
            )
            .withColumn(f"h{k}", h(_node_text(k, F.col(last), F.col("_n"), F.col("_hi"), F.col("_lo"))))
            .withColumnRenamed("src", "dst")
            .drop("_n", "_hi", "_lo")
        )
    return ids.withColumnRenamed("dst", "node_id")


def graph_bits(nodes: DataFrame, edges: DataFrame, radius: int, n_bits: int, hash: str = "md5") -> DataFrame:
    """Circular fingerprint ``(graph_id, bits)`` of graphs held as node and edge tables."""
    ids = graph_node_hashes(nodes, edges, radius, hash)
    rounds = F.array(*[F.col(f"h{k}") for k in range(radius + 1)])
    return (
        ids.select("graph_id", F.explode(rounds).alias("h"))
        .select("graph_id", fold(F.col("h"), n_bits).alias("bit"))
        .groupBy("graph_id")
        .agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    )


def notation_bits(
    df: DataFrame, text: str, radius: int, n_bits: int, name: str = "bits", hash: str = "md5", bad: str = "error"
) -> DataFrame:
    """The same fingerprint for graphs written as strings, as a projection of the row.

    A text that cannot be read is an error, or has null bits with ``bad="null"``.
    """
    parsed = parse_notation(df, text, "_g")
    graph = _readable(F.col("_g"), F.col(text), bad)
    bits = let(graph, lambda g: F.when(g.isNotNull(), _row_graph_bits(g["atoms"], g["edges"], radius, n_bits, hash)))
    return parsed.withColumn(name, bits).drop("_g")


def _row_graph_bits(atoms: Column, edges: Column, radius: int, n_bits: int, hash: str) -> Column:
    h = hasher(hash)

    def flip(e: Column) -> Column:
        return F.struct(e["dst"].alias("src"), e["src"].alias("dst"), e["bond"].alias("bond"))

    def neighbours(links: Column) -> Column:
        return F.transform(atoms, lambda a, i: F.filter(links, lambda e: e["src"] == i))

    def first(near: Column) -> Column:
        return F.transform(atoms, lambda a, i: h(F.concat_ws(":", a, F.size(F.get(near, i)).cast("string"))))

    def grow(near: Column, last: Column, k: int) -> Column:
        zero = F.lit(0).cast("bigint")

        def node(links: Column, i: Column) -> Column:
            total = F.aggregate(
                F.transform(links, lambda e: h(_message_text(e["bond"], F.get(last, e["dst"])))),
                F.struct(zero.alias("hi"), zero.alias("lo")),
                lambda s, m: F.struct((s["hi"] + _high(m)).alias("hi"), (s["lo"] + _low(m)).alias("lo")),
                lambda s: F.concat_ws(":", s["hi"].cast("string"), s["lo"].cast("string")),
            )
            own = F.get(last, i).cast("string")
            return h(F.concat_ws(":", F.lit(str(k)), own, F.size(links).cast("string"), total))

        return F.transform(near, node)

    def rounds_from(near: Column, last: Column, k: int) -> Column:
        bits = F.transform(last, lambda v: fold(v, n_bits))
        if k == radius:
            return bits
        return F.concat(bits, let(grow(near, last, k + 1), lambda v: rounds_from(near, v, k + 1)))

    links = F.concat(edges, F.transform(edges, flip))
    return F.array_sort(
        F.array_distinct(
            let(links, lambda ls: let(neighbours(ls), lambda near: let(first(near), lambda v: rounds_from(near, v, 0))))
        )
    )
