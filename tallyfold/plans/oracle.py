"""Independent SQL twins of the registered queries, for an engine other than Spark."""

from __future__ import annotations


def h60(text: str) -> str:
    """First 15 hex digits of an md5 as a number."""
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def seeded(row_id: str, seed: int = 42) -> str:
    return h60(f"'{seed}:' || {row_id}")


def pseudo_score(text: str) -> str:
    """Score in steps of 1/1000, with many ties."""
    return f"({h60(text)} % 1000)::double / 1000"


def metrics_from(rows: str, by: str = "") -> str:
    """AUC, AP and accuracy of a query ``[by,] score, y``."""
    part = f"partition by {by} " if by else ""
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
    with r as ({rows}),
    g as (select {lead}score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg
          from r where y in (0, 1) and score is not null group by {lead}score),
    c as (select *, sum(pos) over ({part}order by score desc) as tp, sum(neg) over ({part}order by score desc) as fp from g),
    a as (select {lead}sum(neg * (2 * tp - pos))::double as pairs2, sum(pos * (tp::double / (tp + fp))) as ap,
                 sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg,
                 sum(case when score > 0.5 then pos else neg end)::double as hits
          from c {group})
    select {lead}round(pairs2 / (2.0::double * n_pos * n_neg), 6) as roc_auc, round(ap / n_pos, 6) as average_precision,
           round(hits / (n_pos + n_neg), 6) as accuracy, n_pos, n_neg from a"""


def histogram_of(rows: str) -> str:
    """Ten-bin histogram of a query ``v``, by comparing every value with the bin edges."""
    return f"""
    with v as ({rows}), s as (select min(v) as lo, max(v) as hi from v),
    e as (select i::int as bin, lo + i * ((hi - lo) / 10) as low,
                 case when i = 9 then hi else lo + (i + 1) * ((hi - lo) / 10) end as high
          from s, range(10) t(i))
    select bin, round(low, 6) as low, round(high, 6) as high, count(v.v)::bigint as n
    from e left join v on v.v >= e.low and (v.v < e.high or (bin = 9 and v.v <= e.high))
    group by bin, low, high"""


# ------------------------------------------------------------------------------------ notation graphs

FRAGMENTS = [
    "C", "CC(=O)N", "c1ccccc1", "N1CCOCC1", "C(F)(F)C", "[nH]",
    "C#C", "C=C", "S(=O)(=O)", "C1CC%10CC1CC%10", "[C@@H](N)", "O",
]
_LIST = "[" + ", ".join(f"'{f}'" for f in FRAGMENTS) + "]"

NOTATION = f"""
    strings as (
        select p_partkey as g,
               {_LIST}[p_partkey % 12 + 1] || {_LIST}[(p_partkey // 12) % 12 + 1] || {_LIST}[(p_partkey // 144) % 12 + 1]
               || case when p_size % 5 = 0 then '.[Na+]' else '' end as s
        from part)"""

SYMBOL = r"(\[[^\]]+\]|Br|Cl|[BCNOSPFIbcnosp]|%[0-9]{2}|[0-9]|[()]|[-=#$:/\\.])"

GRAPH = f"""
    {NOTATION},
    lists as (select g, regexp_extract_all(s, '{SYMBOL}', 1) as l from strings),
    tok as (select g, unnest(l) as t, generate_subscripts(l, 1) as p from lists),
    lvl as (
        select *, regexp_matches(t, '^(\\[|[A-Za-z])') as is_atom, lag(t) over (partition by g order by p) as prev,
               sum(case t when '(' then 1 when ')' then -1 else 0 end) over (partition by g order by p) as depth
        from tok),
    seg as (select *, sum((t = '(')::int) over (partition by g, depth order by p) as seg from lvl),
    atom as (
        select g, p, t, prev, depth, row_number() over (partition by g order by p) - 1 as n,
               lag(p) over (partition by g, depth, seg order by p) as same
        from seg where is_atom),
    parent as (
        select a.g, a.p, coalesce(any_value(a.same), max(b.p)) as q
        from atom a left join atom b on a.g = b.g and b.depth = a.depth - 1 and b.p < a.p
        group by a.g, a.p),
    ring_end as (
        select g, t, p, prev, row_number() over (partition by g, t order by p) - 1 as k,
               max(case when is_atom then p end) over (partition by g order by p) as owner
        from (select * from lvl)
        qualify regexp_matches(t, '^%?[0-9]+$')),
    ring as (
        select g, t, k // 2 as pair, min(owner) as q, max(owner) as p,
               max(case when regexp_matches(prev, '^[-=#$:]$') then prev end) as bond
        from ring_end group by g, t, k // 2),
    link as (
        select a.g, q, a.p, case when regexp_matches(a.prev, '^[-=#$:]$') then a.prev end as bond
        from atom a join parent using (g, p) where q is not null and coalesce(a.prev, '') <> '.'
        union all select g, q, p, bond from ring),
    edges as (
        select l.g as graph_id, x.n::int as src, y.n::int as dst,
               coalesce(bond, case when regexp_matches(x.t, '^\\[?[0-9]*[a-z]') and regexp_matches(y.t, '^\\[?[0-9]*[a-z]')
                                   then ':' else '-' end) as label
        from link l join atom x on l.g = x.g and l.q = x.p join atom y on l.g = y.g and l.p = y.p),
    nodes as (select g as graph_id, n::int as node_id, t as label from atom)"""


def graph_bits_sql(radius: int, n_bits: int) -> str:
    """Neighbourhood hashing as unrolled CTEs."""
    ctes = [
        GRAPH,
        """sym as (select graph_id, src, dst, label as bond from edges
                   union all select graph_id, dst, src, label from edges)""",
        """deg as (select n.graph_id, n.node_id, any_value(n.label) as label, count(s.bond) as d
                   from nodes n left join sym s on n.graph_id = s.graph_id and n.node_id = s.src group by 1, 2)""",
        f"h0 as (select graph_id, node_id, {h60('label || chr(58) || d')} as h from deg)",
    ]
    for k in range(1, radius + 1):
        ctes.append(
            f"""m{k} as (select s.graph_id, s.src, {h60("bond || ':' || h")} as m
                         from sym s join h{k - 1} i on s.graph_id = i.graph_id and s.dst = i.node_id)"""
        )
        ctes.append(
            f"""t{k} as (select graph_id, src, count(*) as n, sum(m >> 30)::bigint as hi, sum(m & 1073741823)::bigint as lo
                         from m{k} group by 1, 2)"""
        )
        text = f"'{k}:' || h || ':' || coalesce(n, 0) || ':' || coalesce(hi, 0) || ':' || coalesce(lo, 0)"
        ctes.append(
            f"""h{k} as (select i.graph_id, i.node_id, {h60(text)} as h from h{k - 1} i
                         left join t{k} t on i.graph_id = t.graph_id and i.node_id = t.src)"""
        )
    every = " union all ".join(f"select graph_id, h from h{k}" for k in range(radius + 1))
    ctes.append(f"b as (select distinct graph_id, (h % {n_bits})::int as bit from ({every}))")
    return f"with {', '.join(ctes)} select graph_id as p_partkey, string_agg(bit::varchar, ',' order by bit) as bits from b group by 1"


def token_chain_sql(radius: int, n_bits: int) -> str:
    """Word-chain fingerprint by slicing word lists."""
    rounds = " union all ".join(
        f"""select doc_id, ({h60(f"'{k}:' || array_to_string(w[greatest(1, i - {k}) : least(len(w), i + {k})], ' ')")}
                % {n_bits})::int as bit
            from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)"""
        for k in range(radius + 1)
    )
    return rf"""
    with words as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') as w
                   from documents),
    b as (select distinct doc_id, bit from ({rounds}))
    select d.doc_id, coalesce(string_agg(bit::varchar, ',' order by bit), '') as bits
    from documents d left join b using (doc_id) group by d.doc_id"""


def pattern_key_sql(table: str, row_id: str, text: str, keys) -> str:
    hits = ", ".join(
        f"case when len(regexp_extract_all({text}, '{k.pattern}')) >= {k.min_count} then {k.key} end"
        for k in sorted(keys, key=lambda k: k.key)
    )
    return f"select {row_id}, array_to_string(list_filter([{hits}], lambda x: x is not null), ',') as bits from {table}"


def structure_sql() -> str:
    """CTEs ``bond`` (src, dst, label, in_ring) and ``perceived`` (element, aromatic, charge, hydrogens, in_ring) of the notation strings.

    A bond is in a ring if its ends stay connected without it.  The strings write every aromatic ring in lower case.
    """
    from tallyfold.operators.structure import ELEMENT, VALENCES

    valences = "case el " + " ".join(f"when '{e}' then {v}" for e, v in VALENCES.items()) + " else []::int[] end"
    return rf"""
    {GRAPH},
    e as (select *, row_number() over (partition by graph_id order by src, dst) as k from edges),
    both_ways as (select graph_id, k, src, dst from e union all select graph_id, k, dst, src from e),
    reach as (
        select graph_id, k as without, dst as here from e
        union
        select r.graph_id, r.without, b.dst from reach r join both_ways b on b.graph_id = r.graph_id and b.src = r.here and b.k <> r.without),
    bond as (
        select e.graph_id, e.k, e.src, e.dst, case when e.label = ':' and r.here is null then '-' else e.label end as label, r.here is not null as in_ring
        from e left join reach r on r.graph_id = e.graph_id and r.without = e.k and r.here = e.src),
    sides as (select graph_id, src as node_id, label, in_ring from bond union all select graph_id, dst, label, in_ring from bond),
    held as (
        select n.graph_id, n.node_id, any_value(n.label) as symbol, coalesce(bool_or(s.in_ring), false) as in_ring,
               coalesce(sum(case s.label when '=' then 2 when '#' then 3 when '$' then 4 when '-' then 1 when ':' then 1 end), 0)::int as total
        from nodes n left join sides s using (graph_id, node_id) group by 1, 2),
    named as (
        select *, regexp_extract(symbol, '{ELEMENT}', 1) as raw, upper(raw[1]) || raw[2:] as el, raw = lower(raw) as aromatic,
               regexp_extract(symbol, '([+-]+)[0-9]*\]$', 1) as signs
        from held),
    perceived as (
        select graph_id, node_id, el as element, aromatic, in_ring, case when signs like '-%' then -len(signs) else len(signs) end as charge,
               case when symbol[1] = '[' then case when symbol like '%H%' then coalesce(try_cast(regexp_extract(symbol, 'H([0-9]+)', 1) as int), 1) else 0 end
                    when aromatic then greatest(coalesce(({valences})[1], 0) - total - 1, 0)
                    else coalesce(list_filter({valences}, lambda v: v >= total)[1] - total, 0) end as hydrogens
        from named)"""


def structure_counts_sql() -> str:
    return f"""with recursive {structure_sql()}
    select s.g as p_partkey, (select count(*) from perceived where graph_id = s.g) as n_atoms, (select count(*) from bond where graph_id = s.g) as n_bonds,
           (select count(*) from bond where graph_id = s.g and in_ring) as n_ring_bonds,
           (select coalesce(sum(hydrogens), 0)::bigint from perceived where graph_id = s.g) as n_hydrogens
    from strings s"""


def structure_keys_sql(keys) -> str:
    """Bits by one join per pattern and further atom, hits counted as distinct sets of atoms."""
    from tallyfold.operators.structure import _bond_fits, _fits

    patterns = list(dict.fromkeys(k.pattern for k in keys))
    ctes, counts = [], []
    for i, p in enumerate(patterns):
        tables, tests = ["perceived a0"], [_fits(p.atoms[0], "a0.")]
        for k in range(1, len(p.atoms)):
            tables.append(f"perceived a{k}")
            tests += [f"a{k}.graph_id = a0.graph_id", _fits(p.atoms[k], f"a{k}."), *[f"a{k}.node_id <> a{j}.node_id" for j in range(k)]]
        for j, (x, y, labels) in enumerate(p.bonds):
            tables.append(f"sym b{j}")
            tests += [f"b{j}.graph_id = a0.graph_id", f"b{j}.src = a{x}.node_id", f"b{j}.dst = a{y}.node_id", _bond_fits(p, labels, f"b{j}.")]
        hit = "[" + ", ".join(f"a{k}.node_id" for k in range(len(p.atoms))) + "]"
        ctes.append(f"p{i} as (select a0.graph_id, count(distinct list_sort({hit})) as n from {', '.join(tables)} where {' and '.join(tests)} group by 1)")
    for k in keys:
        counts.append(f"select graph_id, {k.key} as bit from p{patterns.index(k.pattern)} where n >= {k.min_count}")
    return f"""with recursive {structure_sql()},
    sym as (select graph_id, src, dst, label, in_ring from bond union all select graph_id, dst, src, label, in_ring from bond),
    {", ".join(ctes)},
    hits as ({" union all ".join(counts)})
    select s.g as p_partkey, coalesce(string_agg(bit::varchar, ',' order by bit), '') as bits from strings s left join hits on graph_id = s.g group by 1"""
