"""Persistence of small groups in SQL: boundary columns as bit strings, reduced by a recursive query.

A group of at most 17 nodes has no more than BITS simplices of a dimension up to 2; the last one is the first bit, so a column is smaller
than another if its last face comes earlier.  A step takes the next column of every group, adds earlier columns to it
wherever that makes it smaller, and keeps what is left: its last face is the creator that the column's simplex destroys.
Classes that die at the enclosing radius or later die at it.
"""

from __future__ import annotations


BITS = 704


def _mask(*places: str) -> str:
    out = f"cast(repeat('0', {BITS}) as bit)"
    for place in places:
        out = f"set_bit({out}, cast({BITS - 1} - {place} as integer), 1)"
    return out


def _last(column: str) -> str:
    """The place of the last face of a column."""
    return f"{BITS} - bit_position(cast('1' as bit), {column})"


def pair_distances(closure: str = "d3") -> str:
    """pd: complex_id, i, j (i < j), d with pairs out of reach one further than the furthest within reach."""
    return f"""reach as materialized (select x.complex_id, x.node as i, y.node as j, s.d from m x join m y on x.complex_id = y.complex_id and x.node < y.node
  left join {closure} s on s.complex_id = x.complex_id and s.i = x.node and s.j = y.node),
pd as materialized (select complex_id, i, j, cast(coalesce(d, max(d) over (partition by complex_id) + 1, 1) as double) as d from reach)"""


CORRELATION = "pd as materialized (select x.complex_id, x.node as i, y.node as j, 1 - coalesce(w, cast(0 as double)) as d from m x join m y on x.complex_id = y.complex_id and x.node < y.node left join e on e.a = x.node and e.b = y.node)"


def _reduction(cells: str, name: str = "steps") -> str:
    """A recursive part: cells has complex_id, dim, o (from 0 within both), mask; each step gives x, the reduced column."""
    reduced = "list_reduce(list_prepend(c.mask, {}), lambda p, q: least(p, xor(p, q)))"
    grown = "case when bit_count({0}) > 0 then list_reverse_sort(list_append({1}, {0})) else {1} end"
    none = "cast([] as bit[])"
    return f"""{name} as (
  select complex_id, dim, o, mask as x, case when bit_count(mask) > 0 then [mask] else {none} end as basis from {cells} where o = 0
  union all
  select c.complex_id, c.dim, c.o, {reduced.format("s.basis")}, {grown.format(reduced.format("s.basis"), "s.basis")}
  from {name} s join {cells} c on c.complex_id = s.complex_id and c.dim = s.dim and c.o = s.o + 1)"""


#: From pd: fb (complex_id, dim, birth, death, creator, destroyer) with positive length, the infinite bar included.
BARS = f"""vx as (select complex_id, node, row_number() over (partition by complex_id order by node) - 1 as k from m),
rad as (select complex_id, min(far) as r from (select complex_id, i, max(d) as far from (select complex_id, i, d from pd union all select complex_id, j, d from pd) group by complex_id, i) group by complex_id),
ed as materialized (select pd.complex_id, x.k as a, y.k as b, cast(d as float) as v from pd join vx x on x.complex_id = pd.complex_id and x.node = i join vx y on y.complex_id = pd.complex_id and y.node = j),
z1 as materialized (select *, row_number() over (partition by complex_id order by v, a, b) - 1 as o, {_mask("a", "b")} as mask from ed),
z2 as materialized (select p.complex_id, p.a, p.b, q.b as c, greatest(p.v, q.v, t.v) as v, row_number() over (partition by p.complex_id order by greatest(p.v, q.v, t.v), p.a, p.b, q.b) - 1 as o,
  {_mask("p.o", "q.o", "t.o")} as mask
  from z1 p join z1 q on q.complex_id = p.complex_id and q.a = p.a and q.b > p.b join z1 t on t.complex_id = p.complex_id and t.a = p.b and t.b = q.b),
z3 as materialized (select f.complex_id, greatest(f.v, g.v, h.v, l.v) as v, row_number() over (partition by f.complex_id order by greatest(f.v, g.v, h.v, l.v), f.a, f.b, f.c, g.c) - 1 as o,
  {_mask("f.o", "g.o", "h.o", "l.o")} as mask
  from z2 f join z2 g on g.complex_id = f.complex_id and g.a = f.a and g.b = f.b and g.c > f.c join z2 h on h.complex_id = f.complex_id and h.a = f.a and h.b = f.c and h.c = g.c
  join z2 l on l.complex_id = f.complex_id and l.a = f.b and l.b = f.c and l.c = g.c),
cells as materialized (select complex_id, 0 as dim, o, mask from z1 union all select complex_id, 1, o, mask from z2 union all select complex_id, 2, o, mask from z3),
{_reduction("cells")},
low as materialized (select complex_id, dim, o, {_last("x")} as l from steps where bit_count(x) > 0),
nm as (select z1.complex_id, z1.o, x.node || ',' || y.node as n from z1 join vx x on x.complex_id = z1.complex_id and x.k = z1.a join vx y on y.complex_id = z1.complex_id and y.k = z1.b),
n2 as (select z2.complex_id, z2.o, x.node || ',' || y.node || ',' || t.node as n from z2 join vx x on x.complex_id = z2.complex_id and x.k = z2.a join vx y on y.complex_id = z2.complex_id and y.k = z2.b join vx t on t.complex_id = z2.complex_id and t.k = z2.c),
raw as (
  select low.complex_id, 0 as dim, cast(0 as float) as birth, z1.v as death, '' as creator, nm.n as destroyer from low join z1 on z1.complex_id = low.complex_id and z1.o = low.o join nm on nm.complex_id = low.complex_id and nm.o = low.o where dim = 0
  union all
  select low.complex_id, 1, z1.v, z2.v, nm.n, n2.n from low join z1 on z1.complex_id = low.complex_id and z1.o = low.l join z2 on z2.complex_id = low.complex_id and z2.o = low.o
    join nm on nm.complex_id = low.complex_id and nm.o = low.l join n2 on n2.complex_id = low.complex_id and n2.o = low.o where dim = 1
  union all
  select low.complex_id, 2, z2.v, z3.v, n2.n, null from low join z2 on z2.complex_id = low.complex_id and z2.o = low.l join z3 on z3.complex_id = low.complex_id and z3.o = low.o join n2 on n2.complex_id = low.complex_id and n2.o = low.l where dim = 2),
fb as materialized (
  select raw.complex_id, dim, cast(birth as double) as birth, cast(death as double) as death, creator, case when death >= cast(r as float) then null else destroyer end as destroyer from raw join rad using (complex_id) where death > birth
  union all select complex_id, 0, 0, cast('inf' as double), '', null from m group by complex_id)"""

#: From fb: ps, the summary of each group with members, as features.diagram_summary() gives it.
SUMMARY = (
    "pc as (select m.complex_id, "
    + ", ".join(
        f"cast(count(*) filter (where dim = {d}) as double) as ph_dim{d}_count, cast(count(*) filter (where dim = {d} and death < 'inf') as double) as ph_dim{d}_finite_count, "
        f"round(coalesce(avg(death - birth) filter (where dim = {d} and death < 'inf'), 0), 5) as ph_dim{d}_mean_lifetime, round(coalesce(max(death - birth) filter (where dim = {d} and death < 'inf'), 0), 5) as ph_dim{d}_max_lifetime, "
        f"round(coalesce(sum(death - birth) filter (where dim = {d} and death < 'inf'), 0), 5) as ph_dim{d}_total_persistence"
        for d in range(3)
    )
    + """ from (select distinct complex_id from m) m left join fb using (complex_id) group by m.complex_id),
fin as (select complex_id, birth, death, min(birth) over (partition by complex_id) as lo, max(death) over (partition by complex_id) as hi from fb where dim = 1 and death < 'inf'),
ls as (select complex_id, s, v, row_number() over (partition by complex_id, s order by v desc) as level from (select complex_id, s, sqrt(2) * greatest(0, least(lo + s * (hi - lo) / 101 - birth, death - (lo + s * (hi - lo) / 101))) as v from fin cross join (select unnest(range(1, 101)) as s))),
ld as (select complex_id, round(sum(v), 4) as l1, round(max(v), 5) as top from ls where level <= 5 group by complex_id),
ps as (select pc.*, coalesce(l1, 0) as ph_dim1_landscape_l1, coalesce(top, 0) as ph_dim1_landscape_max from pc left join ld using (complex_id)),
dm as (select n.complex_id, cast(n as double) as num_nodes, cast(coalesce(k, 0) as double) as num_edges, round(2 * coalesce(s1, 0) / (n * n) + 1e-9, 5) as distance_matrix_mean,
  round(sqrt(greatest(0, 2 * coalesce(s2, 0) / (n * n) - pow(2 * coalesce(s1, 0) / (n * n), 2))) + 1e-9, 5) as distance_matrix_std
  from (select complex_id, count(*) as n from m group by complex_id) n left join (select complex_id, count(*) as k from ie group by complex_id) using (complex_id)
  left join (select complex_id, sum(d) as s1, sum(d * d) as s2 from pd group by complex_id) using (complex_id))"""
)

#: Persistence of the graphs filtered by their weights themselves: sk (complex_id, dim, birth, death).
SKELETON = f"""nb as (select complex_id, node, min(w) as born from (select complex_id, a as node, w from ie union all select complex_id, b, w from ie) group by complex_id, node),
vo as materialized (select *, row_number() over (partition by complex_id order by born, node) - 1 as k from nb),
kc as materialized (select ie.complex_id, 0 as dim, w, row_number() over (partition by ie.complex_id order by w, a, b) - 1 as o, {_mask("x.k", "y.k")} as mask
  from ie join vo x on x.complex_id = ie.complex_id and x.node = a join vo y on y.complex_id = ie.complex_id and y.node = b),
{_reduction("kc")},
kl as materialized (select s.complex_id, s.o, kc.w, bit_count(x) as faces, {_last("x")} as l from steps s join kc on kc.complex_id = s.complex_id and kc.o = s.o),
sk as (select complex_id, 1 as dim, w as birth, cast('inf' as double) as death from kl where faces = 0
  union all select vo.complex_id, 0, born, case when kl.w is null then cast('inf' as double) else kl.w end from vo left join kl on kl.complex_id = vo.complex_id and kl.faces > 0 and kl.l = vo.k where kl.w is null or kl.w > born)"""
