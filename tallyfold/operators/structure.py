"""Structure of parsed graphs: hydrogens, rings, aromatic bonds and counted substructures.

All of it is one projection over the graph of a row (:func:`tallyfold.operators.graphs.parse_notation`): no shuffle, no
Python.  Atoms are numbered as written, so every atom but the first of a part has a parent before it, and each remaining
bond closes one ring: the walk from its two ends up to where they meet.  A bond that no such walk takes is a bridge.
Parts that a ring number joins across a dot are joined by a plain bond.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.scalars import let
from tallyfold.operators.graphs import parse_notation

# Usual valences of the atoms that may be written without brackets, in ascending order.
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "P": [3, 5], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1]}
ORDERS = {"-": 1, ":": 1, "=": 2, "#": 3, "$": 4}
# Parts of a bracket atom: element, hydrogens, charge.
ELEMENT = r"^\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?)"
HYDROGENS = r"^\[[0-9]*(?:[A-Z][a-z]?|[a-z][a-z]?)@*(H[0-9]*)"
CHARGE = r"([+-]+[0-9]*)\]$"
AROMATIC_SIZES = (5, 6, 7)

_ATOM = "struct<element:string,aromatic:boolean,charge:int,bracket:boolean,written:int>"


def _pick(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def atom_parts(symbol: Column) -> Column:
    """Element, lower case (aromatic), charge, bracket and written hydrogens of an atom symbol."""

    def found(x: Column) -> Column:
        name, hs, sign = x["name"], x["hs"], x["sign"]
        digits = F.regexp_replace(sign, "[^0-9]", "")
        size = F.when(F.length(digits) > 0, F.expr("0")).otherwise(F.length(sign))
        number = F.coalesce(digits.try_cast("int"), F.lit(0)) + size
        return F.struct(
            F.initcap(name).alias("element"),
            (name == F.lower(name)).alias("aromatic"),
            F.when(sign == "", 0).when(sign.startswith("-"), -number).otherwise(number).cast("int").alias("charge"),
            symbol.startswith("[").alias("bracket"),
            F.when(hs == "", 0).otherwise(F.coalesce(F.substring(hs, 2, 3).try_cast("int"), F.lit(1))).alias("written"),
        ).cast(_ATOM)

    # each part is cut out once per atom
    name, hs, sign = F.regexp_extract(symbol, ELEMENT, 1), F.regexp_extract(symbol, HYDROGENS, 1), F.regexp_extract(symbol, CHARGE, 1)
    return let(F.struct(name.alias("name"), hs.alias("hs"), sign.alias("sign")), found)


def hydrogens(atom: Column, bonds: Column) -> Column:
    """Hydrogens of an atom whose bond orders sum up to ``bonds``: as written in brackets, else up to the next valence.

    An aromatic atom spends one more on its ring, and takes its lowest valence only.
    """
    known = F.array().cast("array<int>")
    for e, valences in VALENCES.items():
        known = F.when(atom["element"] == e, F.array(*map(F.lit, valences))).otherwise(known)
    ring = F.greatest(F.coalesce(F.get(known, F.lit(0)), F.lit(0)) - bonds - 1, F.lit(0))
    plain = F.coalesce(F.get(F.filter(known, lambda v: v >= bonds), F.lit(0)) - bonds, F.lit(0))
    return F.when(atom["bracket"], atom["written"]).when(atom["aromatic"], ring).otherwise(plain).cast("int")


def _parents(atoms: Column, edges: Column) -> Column:
    """Index of the first bond that leads to each atom from an earlier one, null at the start of a part."""
    positions = F.transform(edges, lambda e, i: F.struct(e["dst"].alias("dst"), e["src"].alias("src"), i.alias("at")))
    return let(positions, lambda ps: F.transform(atoms, lambda a, i: F.get(F.filter(ps, lambda e: (e["dst"] == i) & (e["src"] < i)), F.lit(0))))


def _ring_walk(parents: Column, n: Column, edge: Column) -> Column:
    """Bonds (child atoms) on the way between the ends of a closing bond; null if the ends lie in different parts."""
    state = "struct<x:int,y:int,way:array<int>>"
    start = F.struct(edge["src"].alias("x"), edge["dst"].alias("y"), F.array().cast("array<int>").alias("way")).cast(state)
    up = lambda v: F.coalesce(F.get(parents, v)["src"], F.lit(-1))

    def step(s: Column, _: Column) -> Column:
        far = F.greatest(s["x"], s["y"])
        moved = F.struct(
            F.when(s["x"] > s["y"], up(s["x"])).otherwise(s["x"]).alias("x"),
            F.when(s["x"] > s["y"], s["y"]).otherwise(up(s["y"])).alias("y"),
            F.array_append(s["way"], far).alias("way"),
        ).cast(state)
        return F.when(s["x"] == s["y"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.when(s["x"] >= 0, s["way"]))


def _smaller(rings: Column) -> Column:
    """Each ring, or the smallest ring that it forms together with another one."""

    def best(ring: Column) -> Column:
        def with_other(other: Column) -> Column:
            return F.concat(F.array_except(ring, other), F.array_except(other, ring))

        made = F.transform(rings, with_other)
        fits = F.filter(F.concat(F.array(ring), made), lambda r: F.size(r) > 2)
        return F.aggregate(fits, ring, lambda a, r: F.when(F.size(r) < F.size(a), r).otherwise(a))

    return F.transform(rings, best)


def perceive(df: DataFrame, text: str, name: str = "structure") -> DataFrame:
    """Add a struct of ``atoms`` (element, aromatic, charge, hydrogens, degree, in_ring), ``bonds`` (src, dst, label,
    in_ring), ``rings`` (lists of bond numbers) and ``parse_ok``.

    ``rings`` are the rings that closing bonds form, each exchanged for a smaller one it shares bonds with where there is
    one.  Rings of 5 to 7 atoms with 4k + 2 ring electrons make their bonds (label ``:``) and atoms aromatic, whether
    written in lower case or with alternating double bonds.  Null reads as an empty text.
    """
    parsed = parse_notation(df, text, "_g")
    g = F.col("_g")

    def build(atoms: Column, edges: Column) -> Column:
        return let(_parents(atoms, edges), lambda parents: with_parents(atoms, edges, parents))

    def with_parents(atoms: Column, edges: Column, parents: Column) -> Column:
        tree = F.transform(F.filter(parents, lambda p: p.isNotNull()), lambda p: p["at"])
        numbered = F.transform(edges, lambda e, i: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), i.alias("at")))
        closing = let(tree, lambda ts: F.filter(numbered, lambda e: ~F.array_contains(ts, e["at"])))

        def ring(e: Column) -> Column:
            bonds = F.transform(_ring_walk(parents, F.size(atoms), e), lambda v: F.get(parents, v)["at"])
            return F.array_append(bonds, e["at"])

        walks = F.filter(F.transform(closing, ring), lambda r: r.isNotNull())
        return let(walks, lambda w: let(_smaller(w), lambda rings: finish(atoms, edges, w, rings)))

    def finish(atoms: Column, edges: Column, walks: Column, rings: Column) -> Column:
        ringed = F.array_distinct(F.flatten(walks))

        def bond(e: Column, i: Column, on: Column) -> Column:
            held = F.array_contains(on, i)
            label = F.when((e["bond"] == ":") & ~held, "-").otherwise(e["bond"])  # between two rings
            return F.struct(e["src"].alias("src"), e["dst"].alias("dst"), label.alias("label"), held.alias("in_ring"))

        bonds = let(ringed, lambda on: F.transform(edges, lambda e, i: bond(e, i, on)))

        def described(a: Column, i: Column, bs: Column) -> Column:
            mine = F.filter(bs, lambda b: (b["src"] == i) | (b["dst"] == i))

            def atom(own: Column) -> Column:
                total = F.aggregate(own, F.lit(0), lambda s, b: s + _pick(ORDERS, b["label"], 1))
                return F.struct(
                    a["element"].alias("element"),
                    a["aromatic"].alias("aromatic"),
                    a["charge"].alias("charge"),
                    let(total, lambda t: hydrogens(a, t)).alias("hydrogens"),
                    F.size(own).alias("degree"),
                    F.exists(own, lambda b: b["in_ring"]).alias("in_ring"),
                )

            return let(mine, atom)

        def with_parts(parts: Column) -> Column:
            return let(bonds, lambda bs: let(F.transform(parts, lambda a, i: described(a, i, bs)), lambda xs: aromatic(xs, bs, rings)))

        return let(F.transform(atoms, atom_parts), with_parts)

    def aromatic(atoms: Column, bonds: Column, rings: Column) -> Column:
        def electrons(i: Column) -> Column:
            """Ring electrons of an atom; null where it has none to share."""
            mine = F.filter(bonds, lambda b: (b["src"] == i) | (b["dst"] == i))

            def count(own: Column) -> Column:
                a = F.get(atoms, i)
                double = F.filter(own, lambda b: b["label"] == "=")
                inside = F.exists(double, lambda b: b["in_ring"])
                # carbon gives up its electron to a hetero atom outside the ring
                drawn = F.exists(double, lambda b: ~F.get(atoms, F.when(b["src"] == i, b["dst"]).otherwise(b["src"]))["element"].isin("C"))
                pair = a["element"].isin("N", "O", "S", "P", "Se") & (a["charge"] <= 0)
                lower = F.when(pair & ((a["degree"] + a["hydrogens"] == 3) | a["element"].isin("O", "S", "Se")), 2).when(drawn, 0).otherwise(1)
                return F.when(a["aromatic"], lower).when(inside, 1).when(F.size(double) > 0, F.when(drawn, 0)).when(pair, 2)

            return let(mine, count)

        def is_aromatic(ring: Column) -> Column:
            members = F.array_distinct(F.flatten(F.transform(ring, lambda at: F.array(F.get(bonds, at)["src"], F.get(bonds, at)["dst"]))))
            shares = F.transform(members, electrons)
            total = F.aggregate(shares, F.lit(0), lambda s, x: s + x)
            return F.size(ring).isin(*AROMATIC_SIZES) & F.coalesce(F.pmod(total, F.lit(4)) == 2, F.lit(False))

        def mark(on: Column) -> Column:
            def bond(b: Column, i: Column) -> Column:
                return F.struct(b["src"].alias("src"), b["dst"].alias("dst"), F.when(F.array_contains(on, i), ":").otherwise(b["label"]).alias("label"), b["in_ring"].alias("in_ring"))

            ends = F.flatten(F.transform(on, lambda i: F.array(F.get(bonds, i)["src"], F.get(bonds, i)["dst"])))

            def atom(a: Column, i: Column, held: Column) -> Column:
                fields = ["charge", "hydrogens", "degree", "in_ring"]
                return F.struct(a["element"].alias("element"), (a["aromatic"] | F.array_contains(held, i)).alias("aromatic"), *[a[c].alias(c) for c in fields])

            marked = let(ends, lambda held: F.transform(atoms, lambda a, i: atom(a, i, held)))
            return F.struct(marked.alias("atoms"), F.transform(bonds, bond).alias("bonds"), rings.alias("rings"))

        return let(F.array_distinct(F.flatten(F.filter(rings, is_aromatic))), mark)

    made = let(g, lambda x: let(build(x["atoms"], x["edges"]), lambda s: F.struct(s["atoms"].alias("atoms"), s["bonds"].alias("bonds"), s["rings"].alias("rings"), x["parse_ok"].alias("parse_ok"))))
    return parsed.withColumn(name, made).drop("_g")


# ------------------------------------------------------------------------------------------ substructures


@dataclass(frozen=True)
class Atom:
    """What an atom of a pattern asks for; None and 0 ask for nothing."""

    elements: tuple[str, ...] = ()
    aromatic: bool | None = None
    min_hydrogens: int = 0
    in_ring: bool | None = None
    charged: bool = False


@dataclass(frozen=True)
class Pattern:
    """Atoms and bonds (first atom, second atom, labels allowed, "" for any); each atom but the first hangs on an earlier one."""

    name: str
    atoms: tuple[Atom, ...]
    bonds: tuple[tuple[int, int, str], ...] = ()
    ring_bonds: bool | None = None


@dataclass(frozen=True)
class StructureKey:
    """Bit ``key`` is set where ``pattern`` occurs at least ``min_count`` times."""

    key: int
    pattern: Pattern
    min_count: int = 1


def _a(text: str, **more) -> Atom:
    """Atom by element symbols with blanks between; lower case asks for an aromatic one, ``*`` for any."""
    names = () if text == "*" else tuple(t.capitalize() for t in text.split())
    return Atom(names, True if text.islower() else None, **more)


def _chain(name: str, *parts, **more) -> Pattern:
    """Pattern of a chain: atom, bond, atom, …"""
    atoms = tuple(_a(p) if isinstance(p, str) else p for p in parts[::2])
    return Pattern(name, atoms, tuple((i, i + 1, b) for i, b in enumerate(parts[1::2])), **more)


HETERO, HALOGEN = "N O S P", "F Cl Br I"

# What the keys look for.
PATTERNS = (
    _chain("fluorine", "F"), _chain("chlorine", "Cl"), _chain("bromine", "Br"), _chain("iodine", "I"), _chain("nitrogen", "N"), _chain("oxygen", "O"),
    _chain("sulfur", "S"), _chain("phosphorus", "P"), _chain("boron", "B"), _chain("charged atom", Atom(charged=True)), _chain("aromatic atom", Atom(aromatic=True)), _chain("ring atom", Atom(in_ring=True)),
    _chain("hydroxyl", "C", "-", _a("O", min_hydrogens=1)), _chain("primary amine", "C", "-", _a("N", min_hydrogens=2)), _chain("amine hydrogen", _a("N", min_hydrogens=1)), _chain("thiol", "C", "-", _a("S", min_hydrogens=1)),
    _chain("carbonyl", "C", "=", "O"), _chain("thiocarbonyl", "C", "=", "S"), _chain("imine", "C", "=", "N"), _chain("nitrile", "C", "#", "N"), _chain("alkene", "C", "=", "C"), _chain("alkyne", "C", "#", "C"), _chain("azo", "N", "=", "N"),
    _chain("ether", "C", "-", "O", "-", "C"), _chain("thioether", "C", "-", "S", "-", "C"), _chain("tertiary chain", "C", "-", "N", "-", "C"), _chain("amide", "O", "=", "C", "-", "N"), _chain("acid or ester", "O", "=", "C", "-", "O"),
    _chain("carbon halide", "C", "-", HALOGEN), _chain("aryl halide", _a("c"), "-", HALOGEN), _chain("aryl oxygen", _a("c"), "-", "O"), _chain("aryl nitrogen", _a("c"), "-", "N"), _chain("aryl carbon", _a("c"), "-", Atom(("C",), False)),
    _chain("biaryl", Atom(("C", "N"), True), "-", Atom(("C", "N"), True), ring_bonds=False), _chain("hetero pair", HETERO, "", HETERO), _chain("one atom between", HETERO, "", "C", "", HETERO), _chain("two atoms between", HETERO, "", "C", "", "C", "", HETERO),
    _chain("methyl", _a("C", min_hydrogens=3)), _chain("methylene pair", _a("C", min_hydrogens=2), "-", _a("C", min_hydrogens=2)), _chain("ring nitrogen", _a("N", in_ring=True)), _chain("ring oxygen", _a("O", in_ring=True)), _chain("ring sulfur", _a("S", in_ring=True)),
    _chain("side bond", Atom(in_ring=True), "-", Atom(), ring_bonds=False), _chain("aromatic bond", Atom(), ":", Atom()),
    Pattern("sulfonyl", (_a("S"), _a("O"), _a("O")), ((0, 1, "="), (0, 2, "="))), Pattern("nitro", (_a("N"), _a("O"), _a("O")), ((0, 1, "=-"), (0, 2, "=-"))), Pattern("geminal halogens", (_a("C"), _a(HALOGEN), _a(HALOGEN)), ((0, 1, "-"), (0, 2, "-"))),
    Pattern("trihalomethyl", (_a("C"), _a(HALOGEN), _a(HALOGEN), _a(HALOGEN)), ((0, 1, "-"), (0, 2, "-"), (0, 3, "-"))), Pattern("branched carbon", (_a("C"), _a("C"), _a("C"), _a("C")), ((0, 1, "-"), (0, 2, "-"), (0, 3, "-"))), Pattern("urea", (_a("C"), _a("O"), _a("N"), _a("N")), ((0, 1, "="), (0, 2, "-"), (0, 3, "-"))),
    Pattern("three-ring", (Atom(), Atom(), Atom()), ((0, 1, ""), (1, 2, ""), (2, 0, ""))), Pattern("four-ring", (Atom(),) * 4, ((0, 1, ""), (1, 2, ""), (2, 3, ""), (3, 0, ""))), Pattern("five-ring", (Atom(in_ring=True),) * 5, ((0, 1, ""), (1, 2, ""), (2, 3, ""), (3, 4, ""), (4, 0, ""))),
    Pattern("six-ring", (Atom(in_ring=True),) * 6, ((0, 1, ""), (1, 2, ""), (2, 3, ""), (3, 4, ""), (4, 5, ""), (5, 0, ""))),
)
MORE_THAN_ONCE = {"nitrogen": (2, 4), "oxygen": (2, 4), "carbonyl": (2,), "amide": (2,), "aromatic atom": (6, 12), "methyl": (2,), "fluorine": (3,), "six-ring": (2,)}


def _keys() -> tuple[StructureKey, ...]:
    wanted = [(p, n) for p in PATTERNS for n in (1, *MORE_THAN_ONCE.get(p.name, ()))]
    return tuple(StructureKey(i, p, n) for i, (p, n) in enumerate(wanted))


STRUCTURE_KEYS = _keys()


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _fits(want: Atom, of: str = "") -> str:
    """Condition on an atom whose fields are read with the prefix ``of``; conditions are text, as there are many."""
    tests = []
    if want.elements:
        tests.append(f"{of}element in ({_names(want.elements)})")
    if want.aromatic is not None:
        tests.append(f"{of}aromatic = {str(want.aromatic).lower()}")
    if want.min_hydrogens:
        tests.append(f"{of}hydrogens >= {want.min_hydrogens}")
    if want.in_ring is not None:
        tests.append(f"{of}in_ring = {str(want.in_ring).lower()}")
    if want.charged:
        tests.append(f"{of}charge <> 0")
    return " and ".join(tests) or "true"


def _bond_fits(pattern: Pattern, labels: str, of: str = "") -> str:
    tests = [f"{of}label in ({_names(labels)})"] if labels else []
    if pattern.ring_bonds is not None:
        tests.append(f"{of}in_ring = {str(pattern.ring_bonds).lower()}")
    return " and ".join(tests) or "true"


def _new_bonds(pattern: Pattern, k: int) -> list[tuple[int, str]]:
    """Bonds of atom ``k`` with atoms placed before it: (earlier atom, labels)."""
    return [(a if b == k else b, labels) for a, b, labels in pattern.bonds if max(a, b) == k]


NUMBERED = "transform({}, (a, i) -> struct(a, i))"
# the bonds are worked out before they are dealt to the atoms, not once more for each
NEAR = "get(transform(array({1}), ls -> transform({0}, (a, i) -> filter(ls, e -> e.src = i))), 0)"


def count_pattern(pattern: Pattern, atoms: str, links: str) -> Column:
    """How many different sets of atoms hold the pattern; ``links`` names every bond in both directions with its far atom."""
    numbered, near = NUMBERED.format(atoms), NEAR.format(atoms, links)
    return F.expr(f"get(transform(array({near}), near -> {_count_near(pattern, numbered, 'near')}), 0)")


def _count_near(pattern: Pattern, numbered: str, near: str) -> str:
    """The count from numbered atoms and the bonds that leave each of them.

    Placings grow by one atom at a time along the pattern's bonds, so only what fits so far is carried on, and a step
    reads the bonds of one atom, not those of the whole graph; bonds back to atoms already placed are tested on the way.
    Placings on the same atoms are one hit.
    """
    first = f"filter({numbered}, x -> {_fits(pattern.atoms[0], 'x.a.')})"
    if len(pattern.atoms) == 1:
        return f"size({first})"
    placed = f"transform({first}, x -> array(x.i))"
    for k in range(1, len(pattern.atoms)):
        (at, labels), *others = _new_bonds(pattern, k)
        tests = [_bond_fits(pattern, labels, "e."), _fits(pattern.atoms[k], "e.far."), "not array_contains(m, e.dst)"]
        tests += [f"exists(get({near}, m[{j}]), o -> o.dst = e.dst and {_bond_fits(pattern, also, 'o.')})" for j, also in others]
        tests = [t for t in tests if t != "true"]
        placed = f"flatten(transform({placed}, m -> transform(filter(get({near}, m[{at}]), e -> {' and '.join(tests)}), e -> array_append(m, e.dst))))"
    return f"size(array_distinct(transform({placed}, m -> array_sort(m))))"


def structure_key_bits(df: DataFrame, text: str, keys: Sequence[StructureKey] = STRUCTURE_KEYS, name: str = "bits") -> DataFrame:
    """Substructure fingerprint of line notation: sorted numbers of the keys that are set; null where it cannot be read."""
    seen = perceive(df, text, "_s")
    patterns = list(dict.fromkeys(k.pattern for k in keys))
    s = F.col("_s")

    def both_ways(b: Column) -> Column:
        way = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"), b["label"].alias("label"), b["in_ring"].alias("in_ring"), F.get(s["atoms"], dst).alias("far"))
        return F.array(way(b["src"], b["dst"]), way(b["dst"], b["src"]))

    # numbered atoms and the bonds of each once per row; then one count per pattern, whatever the number of keys
    seen = seen.withColumn("_links", F.flatten(F.transform(s["bonds"], both_ways)))
    seen = seen.withColumns({"_near": F.expr(NEAR.format("_s.atoms", "_links")), "_atoms": F.expr(NUMBERED.format("_s.atoms"))})
    counts = F.expr(f"array({', '.join(_count_near(p, '_atoms', '_near') for p in patterns)})")
    seen = seen.withColumn("_counts", F.when(s["parse_ok"], counts))
    hits = [F.when(F.get("_counts", F.lit(patterns.index(k.pattern))) >= k.min_count, F.lit(k.key)) for k in sorted(keys, key=lambda k: k.key)]
    bits = F.when(F.col("_counts").isNotNull(), F.array_compact(F.array(*hits)).cast("array<int>"))
    return seen.withColumn(name, bits).drop("_s", "_links", "_near", "_atoms", "_counts")


def match_in_tables(nodes: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """(graph_id, n): hits of a pattern in graphs of any size, held as tables, by one join per further atom.

    ``nodes`` has (graph_id, node_id, element, aromatic, charge, hydrogens, in_ring), ``edges`` (graph_id, src, dst, label,
    in_ring).  Each bond of the pattern is a join with the directed bonds that fit it, on graph and atom, so neither a
    graph nor a hub has to fit a task; placings on the same atoms are one hit.
    """
    turned = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "in_ring")
    both = edges.select("graph_id", "src", "dst", "label", "in_ring").unionByName(turned)
    fitting = lambda k: nodes.where(_fits(pattern.atoms[k])).select("graph_id", F.col("node_id").alias(f"p{k}"))
    placed = fitting(0)
    for k in range(1, len(pattern.atoms)):
        for i, (at, labels) in enumerate(_new_bonds(pattern, k)):
            way = both.where(_bond_fits(pattern, labels)).select("graph_id", F.col("src").alias(f"p{at}"), F.col("dst").alias(f"p{k}"))
            placed = placed.join(way, ["graph_id", f"p{at}"] if not i else ["graph_id", f"p{at}", f"p{k}"], "inner" if not i else "left_semi")
        fresh = F.lit(True)
        for j in range(k):
            fresh = fresh & (F.col(f"p{j}") != F.col(f"p{k}"))
        placed = placed.where(fresh).join(fitting(k), ["graph_id", f"p{k}"], "left_semi")
    hit = F.array_sort(F.array(*[F.col(f"p{k}") for k in range(len(pattern.atoms))])).alias("hit")
    return placed.select("graph_id", hit).distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


def structure_tables(df: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Perceived atoms and bonds of line notation as the tables that :func:`match_in_tables` reads."""
    seen = perceive(df.select(F.col(row_id).alias("graph_id"), text), text, "_s")
    nodes = seen.select("graph_id", F.posexplode("_s.atoms").alias("node_id", "_a")).select("graph_id", "node_id", "_a.*")
    return nodes, seen.select("graph_id", F.inline("_s.bonds"))
