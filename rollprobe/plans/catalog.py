"""Registered queries and their SQL counterparts, which use brute-force pairs in place of the cell join."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import AMINO_ACIDS, BACKBONE, ELEMENT_RADII, RESIDUE_NAME_ALIASES, PROTEIN_NAMES, backbone_column, element_column, protor, radius_column
from ..functions.points import sphere_points
from ..operators import aggregate as A
from ..operators import features as X
from ..operators import timeseries as T
from ..operators.embedding import gram
from ..operators.kernels import lee_richards, shrake_rupley, surface_points
from ..operators.neighbors import expanded, neighbor_pairs
from ..sources.records import altloc_filter, frame_slice, residue_runs
from .selection import select
from .tables import EDGE, EMBEDDING, POINTS, PROBE, SERIES, SLICES, embedding_series, event_series, part_atoms, sql_atoms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rnd(c: str, n: int = 5) -> F.Column:
    return F.round(F.col(c), n).alias(c)


def heavy(df: DataFrame) -> DataFrame:
    return df.where("not is_h and not is_het")


# ---------------------------------------------------------------- SQL parts
POINT_ROWS = "points as (select * from (values " + ",".join(f"({k},{a!r}::double,{b!r}::double,{c!r}::double)" for k, (a, b, c) in enumerate(sphere_points(POINTS))) + ") t(k, ux, uy, uz))"


def sr_sql(universe: str = "true", context: bool = False, cast: str = "double", centers: str = "true") -> str:
    """Common table expressions up to ``sr``: brute-force pairs, points anti-joined."""
    key, join = (", context", "and a.context = b.context") if context else ("", "")
    c = f"::{cast}" if cast != "double" else ""
    d = [f"(a.{x}{c} + a.er{c} * p.u{x}{c} - a.o{x}{c})" for x in "xyz"]
    return f"""u as (select *, radius + {PROBE}::double as er from atoms where {universe}),
pairs as (select a.frame, a.atom{', a.context' if context else ''}, a.x, a.y, a.z, a.er, b.x as ox, b.y as oy, b.z as oz, b.er as oer from (select * from u where {centers}) a join u b on a.frame = b.frame {join} and a.atom <> b.atom
 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < (a.er + b.er) * (a.er + b.er)),
{POINT_ROWS},
hid as (select frame, atom{key}, count(distinct k) as hidden from pairs a, points p where {d[0]} * {d[0]} + {d[1]} * {d[1]} + {d[2]} * {d[2]} < a.oer{c} * a.oer{c} group by all),
sr as (select u.*, ({POINTS} - coalesce(hidden, 0))::int as exposed, {4.0 * math.pi!r}::double * er * er * ({POINTS} - coalesce(hidden, 0)) / {float(POINTS)!r}::double as sasa from (select * from u where {centers}) u left join hid using (frame, atom{key}))"""


def sr(spark: SparkSession, d: str, where: str = "not is_h and not is_het", **kw) -> DataFrame:
    return shrake_rupley(part_atoms(spark, d).where(where), PROBE, POINTS, edge=EDGE, **kw)


HEAVY = "not is_h and not is_het"
WITH = f"with {sql_atoms()}, {sr_sql(HEAVY)} "


# ---------------------------------------------------------------- kernels and sums
@query("sr_atom", WITH + "select frame, atom, exposed, round(sasa, 5) as sasa from sr")
def _(s, d):
    return sr(s, d).select("frame", "atom", "exposed", rnd("sasa"))


@query("sr_total", WITH + "select frame, round(sum(sasa), 5) as total_sasa from sr group by frame")
def _(s, d):
    return A.totals(sr(s, d)).select("frame", rnd("total_sasa"))


@query("sr_total_kahan", WITH + "select frame, round(sum(sasa), 5) as total_sasa from sr group by frame")
def _(s, d):
    return A.kahan_totals(sr(s, d)).select("frame", rnd("total_sasa"))


@query("sr_residue", WITH + "select frame, residue_id, round(sum(sasa), 5) as residue_sasa from sr group by all")
def _(s, d):
    return A.residue_sums(sr(s, d)).select("frame", "residue_id", rnd("residue_sasa"))


@query("sr_chain", WITH + "select frame, chain, round(sum(sasa), 5) as chain_sasa, min(atom) as first_atom from sr group by all")
def _(s, d):
    return A.chain_sums(sr(s, d)).select("frame", "chain", rnd("chain_sasa"), "first_atom")


@query("sr_rollup", WITH + "select frame, chain, residue_id, round(sum(sasa), 5) as sasa, grouping(frame, chain, residue_id)::bigint as level from sr group by rollup (frame, chain, residue_id)")
def _(s, d):
    return A.hierarchy(sr(s, d)).select("frame", "chain", "residue_id", rnd("sasa"), F.col("level").cast("long").alias("level"))


SELECTED = ["acid, resn ASP+GLU", "core, protein and not (name CA or chain B)", "range, resi 10-20+40-"]
SELECTED_SQL = {"acid": "residue_name in ('ASP','GLU')", "core": "not (atom_name = 'CA' or chain = 'B')", "range": "(residue_number between 10 and 20 or residue_number between 40 and (select max_by(residue_number, atom) from u))"}


def masks(atoms: DataFrame) -> dict:
    from .selection import select_all

    return {x.name: x.column for x in select_all(SELECTED, atoms)}


@query("sr_selection", WITH + "select frame, " + ", ".join(f"round(coalesce(sum(sasa) filter ({c}), 0), 5) as {n}" for n, c in SELECTED_SQL.items()) + " from sr group by frame")
def _(s, d):
    m = masks(heavy(part_atoms(s, d, 1)))
    return A.mask_sums(sr(s, d), m).select("frame", *map(rnd, m))


@query("sr_classes", WITH + "select frame, " + ", ".join(f"round(coalesce(sum(sasa) filter (atom_class = '{c}'), 0), 5) as {c}" for c in A.CLASSES) + " from sr group by frame")
def _(s, d):
    return A.class_sums(sr(s, d)).select("frame", *map(rnd, A.CLASSES))


@query("sr_class_by_selection", WITH + "select frame, " + ", ".join(f"round(coalesce(sum(sasa) filter (({w}) and atom_class = '{c}'), 0), 5) as {n}_{c}" for n, w in SELECTED_SQL.items() for c in A.CLASSES) + " from sr group by frame")
def _(s, d):
    m = masks(heavy(part_atoms(s, d, 1)))
    return A.class_by_selection(sr(s, d), m).select("frame", *(rnd(f"{n}_{c}") for n in m for c in A.CLASSES))


BONE = "atom_name in (" + ",".join("'" + b.replace("'", "''") + "'" for b in BACKBONE) + ")"


@query("residue_records", WITH + "select frame, residue_id, round(sum(sasa), 5) as total, " + ", ".join(f"round(coalesce(sum(sasa) filter ({w}), 0), 5) as {n}" for n, w in (("main_chain", BONE), ("side_chain", f"not {BONE}"), *((c, f"atom_class = '{c}'") for c in A.CLASSES))) + " from sr group by all")
def _(s, d):
    return A.residue_records(sr(s, d)).select("frame", "residue_id", *map(rnd, ("total", "main_chain", "side_chain", *A.CLASSES)))


@query("residue_type_totals", WITH + "select f.frame, ord::int as ord, k.residue_name, round(coalesce(s, 0), 5) as type_sasa from (select distinct frame from sr) f cross join (select * from (values " + ",".join(f"({i},'{r}')" for i, r in enumerate(AMINO_ACIDS)) + ") t(ord, residue_name)) k left join (select frame, residue_name, sum(sasa) s from sr group by all) x on x.frame = f.frame and x.residue_name = k.residue_name")
def _(s, d):
    return A.residue_type_sums(sr(s, d)).select("frame", "ord", "residue_name", rnd("type_sasa"))


@query("filter_then_sasa", f"with {sql_atoms()}, {sr_sql(HEAVY + chr(32) + chr(97) + 'nd chain = ' + chr(39) + 'A' + chr(39))} select frame, round(sum(sasa), 5) as total_sasa from sr group by frame")
def _(s, d):
    return A.totals(sr(s, d, f"{HEAVY} and chain = 'A'")).select("frame", rnd("total_sasa"))


@query("select_after_sasa", WITH + "select frame, round(sum(sasa), 5) as total_sasa from sr where chain = 'A' group by frame")
def _(s, d):
    return A.totals(sr(s, d).where(select("chain A").column)).select("frame", rnd("total_sasa"))


@query("selected_centers", f"with {sql_atoms()}, {sr_sql(HEAVY, centers='residue_id % 5 = 0')} select frame, atom, exposed from sr")
def _(s, d):
    return sr(s, d, centers=F.col("residue_id") % 5 == 0).select("frame", "atom", "exposed")


@query("fp32_sr", f"with {sql_atoms()}, {sr_sql(HEAVY, cast='float')} select frame, atom, exposed from sr")
def _(s, d):
    return sr(s, d, single=True).select("frame", "atom", "exposed")


@query("neighbor_pairs", WITH + "select frame, atom, count(*) as neighbors, round(sum((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)), 2) as sum_d2 from pairs group by all")
def _(s, d):
    pairs = neighbor_pairs(expanded(heavy(part_atoms(s, d)), PROBE), edge=EDGE)
    return pairs.groupBy("frame", "atom").agg(F.count("*").alias("neighbors"), F.round(F.sum("d2"), 2).alias("sum_d2"))


@query("surface_points", WITH + "select frame, atom, count(*) as points, round(sum(x + er * ux), 4) as sx, round(sum(y + er * uy), 4) as sy, round(sum(z + er * uz), 4) as sz from (select u.*, k, ux, uy, uz from u, points) e where not exists (select 1 from pairs a where a.frame = e.frame and a.atom = e.atom and (e.x + e.er * ux - ox) * (e.x + e.er * ux - ox) + (e.y + e.er * uy - oy) * (e.y + e.er * uy - oy) + (e.z + e.er * uz - oz) * (e.z + e.er * uz - oz) < oer * oer) group by all")
def _(s, d):
    p = surface_points(heavy(part_atoms(s, d)), PROBE, POINTS, edge=EDGE)
    return p.groupBy("frame", "atom").agg(F.count("*").alias("points"), *(F.round(F.sum(f"p{c}"), 4).alias(f"s{c}") for c in "xyz"))


PI2 = repr(2 * math.pi)
LR = f"""with {sql_atoms()}, {sr_sql(HEAVY)},
cut as (select a.frame, a.atom, s, sqrt(greatest(er*er-(h-z)*(h-z),0)) ri, oer*oer-(h-oz)*(h-oz) rj2, ox-x dx, oy-y dy from (select *, z - er + (s + 0.5::double) * (2.0::double*er/{SLICES}) h from pairs, (select unnest(range({SLICES})) s)) a),
c2 as (select *, sqrt(rj2) rj, sqrt(dx*dx+dy*dy) d from cut where rj2 > 0), c3 as (select *, (d+ri<rj or d<1e-14) whole from c2 where d<ri+rj and not d+rj<ri),
ang as (select frame, atom, s, whole, case when not whole then acos(least(greatest((ri*ri+d*d-rj*rj)/(2*ri*d),-1),1)) end alpha, case when not whole then atan2(dy,dx) end beta from c3),
lo as (select *, (beta-alpha) - floor((beta-alpha)/{PI2}::double)*{PI2}::double lo from ang),
arcs as (select frame, atom, s, 0.0::double a, {PI2}::double b from lo where whole union all select frame, atom, s, lo, least(lo+2*alpha, {PI2}::double) from lo where not whole union all select frame, atom, s, 0.0, lo+2*alpha-{PI2}::double from lo where not whole and lo+2*alpha > {PI2}::double),
runs as (select *, coalesce(max(b) over (partition by frame, atom, s order by a, b rows between unbounded preceding and 1 preceding), 0) reach from arcs),
free as (select frame, atom, s, sum(greatest(a-reach,0)) + {PI2}::double - max(b) free from runs group by all),
lost as (select frame, atom, sum({PI2}::double - free) lost from free group by all),
lr as (select u.frame, u.atom, (2.0::double*er/{SLICES})*er*({SLICES}*{PI2}::double - coalesce(lost,0)) sasa from u left join lost using (frame, atom)) """


@query("lr_atom", LR + "select frame, atom, round(sasa, 4) as sasa from lr")
def _(s, d):
    return lee_richards(heavy(part_atoms(s, d)), PROBE, SLICES, edge=EDGE).select("frame", "atom", rnd("sasa", 4))


@query("lr_total", LR + "select frame, round(sum(sasa), 4) as total_sasa from lr group by frame")
def _(s, d):
    return A.totals(lee_richards(heavy(part_atoms(s, d)), PROBE, SLICES, edge=EDGE)).select("frame", rnd("total_sasa", 4))


# ---------------------------------------------------------------- tables, selections, sources
CASES = {"sel_name": "name CA+CB", "sel_not": "not (symbol C or symbol O)", "sel_resi_range": "resi 5-15+30-", "sel_chain_range": "chain A-C and resn ALA+GLY", "sel_invalid": "not name ABCDE", "sel_protein": "protein and symbol N"}
CASES_SQL = {"sel_name": "atom_name in ('CA','CB')", "sel_not": "element not in ('C','O')", "sel_resi_range": "residue_number between 5 and 15 or residue_number >= 30 and residue_number <= (select max_by(residue_number, atom) from atoms)", "sel_chain_range": "chain between 'A' and 'C' and residue_name in ('ALA','GLY')", "sel_invalid": "true", "sel_protein": "element = 'N' and residue_name in (" + ",".join(f"'{x}'" for x in PROTEIN_NAMES) + ")"}


def _selection(text: str):
    def run(s, d):
        atoms = part_atoms(s, d, 1)
        return atoms.where(select(text, atoms).column).select("atom", "residue_number")

    return run


for _name, _text in CASES.items():
    query(_name, f"with {sql_atoms(1)} select atom, residue_number from atoms where {CASES_SQL[_name]}")(_selection(_text))

_pro = protor()
_odd = "case atom % 5 when 0 then 'HIE' when 1 then 'ILE' when 2 then 'LIG' when 3 then 'HSD' else residue_name end"
_oddname = "case when atom % 5 = 1 and atom_name = 'CB' then 'CD' when atom % 7 = 0 then 'OT1' else atom_name end"
_text = lambda x: "'" + x.replace("'", "''") + "'"
_map = lambda name, d: f"{name} as (select * from (values " + ",".join(f"({_text(k)},{v!r}::double)" if isinstance(v, float) else f"({_text(k)},{_text(v)})" for k, v in sorted(d.items())) + ") t(k, v))"


@query("radius_cascade", f"with {sql_atoms(1)}, {_map('tab', _pro.radii())}, {_map('ali', RESIDUE_NAME_ALIASES)}, {_map('ele', ELEMENT_RADII)}, n as (select atom, {_odd} as res, {_oddname} as name, element from atoms), m as (select n.*, coalesce(ali.v, res) as base from n left join ali on ali.k = res), r as (select m.*, case when base = 'ILE' and name = 'CD' then 'ILE:CD1' when name = 'OT1' and base in ({','.join(repr(x) for x in AMINO_ACIDS)}) then base || ':O' end as renamed from m) select atom, res as residue, name, coalesce(t1.v, t2.v, t3.v, e.v) as radius from r left join tab t1 on t1.k = res || ':' || name left join tab t2 on t2.k = base || ':' || name left join tab t3 on t3.k = renamed left join ele e on e.k = element")
def _(s, d):
    a = part_atoms(s, d, 1).withColumn("residue", F.expr(_odd)).withColumn("name", F.expr(_oddname))
    return a.select("atom", "residue", "name", radius_column(_pro, F.col("residue"), F.col("name"), F.col("element")).alias("radius"))


@query("element_infer", f"with {sql_atoms(1)}, n as (select atom, case atom % 4 when 0 then 'CL' || atom_name when 1 then '1H' || atom_name when 2 then 'zn' else atom_name end as name, case when atom % 3 = 0 then ' ' else element end as el from atoms), l as (select *, upper(regexp_extract(name, '([A-Za-z]+)', 1)) as letters from n) select atom, name, case when trim(el) <> '' then upper(trim(el)) when letters[1:2] in ('CL','BR','NA','MG','FE','ZN','CA') then letters[1:2] else letters[1:1] end as element from l")
def _(s, d):
    a = part_atoms(s, d, 1).withColumn("name", F.expr("case atom % 4 when 0 then concat('CL', atom_name) when 1 then concat('1H', atom_name) when 2 then 'zn' else atom_name end")).withColumn("el", F.expr("case when atom % 3 = 0 then ' ' else element end"))
    return a.select("atom", "name", element_column(F.col("el"), F.col("name")).alias("element"))


@query("unlisted_atoms", f"with {sql_atoms(1)}, {_map('tab', _pro.radii())} select residue_name, atom_name, count(*) as atoms from atoms left join tab on k = residue_name || ':' || atom_name where k is null group by all")
def _(s, d):
    a = part_atoms(s, d, 1).withColumn("listed", radius_column(_pro, F.col("residue_name"), F.col("atom_name"), F.lit(None).cast("string")))
    return a.where("listed is null").groupBy("residue_name", "atom_name").agg(F.count("*").alias("atoms"))


@query("residue_runs", f"with {sql_atoms(1)}, k as (select atom, chain || '/' || (size // 10) as key from atoms), c as (select atom, key, case when key is distinct from lag(key) over (order by atom) then 1 else 0 end as new from k) select atom, (sum(new) over (order by atom) - 1)::bigint as run from c")
def _(s, d):
    a = part_atoms(s, d, 1).select("atom", "chain", F.floor(F.col("size") / 10).alias("tens"))
    return residue_runs(a, ["chain", "tens"]).select("atom", F.col("residue_id").cast("long").alias("run"))


@query("altloc_dedup", f"with {sql_atoms(1)}, k as (select *, case when atom % 3 = 0 then ' ' else chr(65 + (atom % 2)::int) end as altloc from atoms) select atom from k where altloc = ' ' union all select min(atom)::int from k where altloc <> ' ' group by chain, size, residue_name, atom_name")
def _(s, d):
    a = part_atoms(s, d, 1).withColumn("altloc", F.expr("case when atom % 3 = 0 then ' ' else chr(65 + atom % 2) end"))
    return altloc_filter(a, ["chain", "size", "residue_name", "atom_name"], "atom").select("atom")


@query("frame_slice", f"with {sql_atoms(6)} select frame, count(*) as atoms from atoms where frame in (1, 3) group by frame")
def _(s, d):
    return frame_slice(part_atoms(s, d, 6), "1:5:2", 6).groupBy("frame").agg(F.count("*").alias("atoms"))


# ---------------------------------------------------------------- features
RSA = WITH + ", asa as (select * from (values " + ",".join(f"('{k}',{v!r}::double)" for k, v in X.MAX_ASA.items()) + ") t(residue_name, top)), res as (select frame, residue_id, min(residue_name) as residue_name, sum(sasa) as s from sr group by all), rsa as (select frame, residue_id, s / top as rsa from res left join asa using (residue_name)) "


def rsa(s, d):
    area = sr(s, d)
    names = heavy(part_atoms(s, d, 1)).select("residue_id", "residue_name").distinct()
    return X.relative(A.residue_sums(area), names)


@query("rsa_per_residue", RSA + "select frame, residue_id, round(rsa, 6) as rsa from rsa")
def _(s, d):
    return rsa(s, d).select("frame", "residue_id", rnd("rsa", 6))


@query("rsa_summary", RSA + "select frame, round(avg(rsa), 6) as mean_rsa, round(avg((rsa > 0.25)::int), 6) as exposed_fraction, round(1 - avg((rsa > 0.25)::int), 6) as buried_fraction from rsa group by frame")
def _(s, d):
    return X.relative_summary(rsa(s, d)).select("frame", *(rnd(c, 6) for c in ("mean_rsa", "exposed_fraction", "buried_fraction")))


@query("backbone_split", WITH + f"select frame, round(coalesce(sum(sasa) filter ({BONE}), 0), 5) as backbone, round(coalesce(sum(sasa) filter (not {BONE}), 0), 5) as sidechain from sr group by frame")
def _(s, d):
    b = backbone_column(F.col("atom_name"))
    return A.mask_sums(sr(s, d), {"backbone": b, "sidechain": ~b}).select("frame", rnd("backbone"), rnd("sidechain"))


def sides() -> tuple:
    return F.col("chain") == "A", F.col("chain") == "B"



def ctx_sql(pairs: dict[str, str]) -> str:
    return f"with {sql_atoms()}, plain as (select * from atoms where {HEAVY}), ctx as (" + " union all ".join(f"select *, '{n}' as context from plain where {w}" for n, w in pairs.items()) + "), " + sr_sql(context=True).replace("from atoms where", "from ctx where")


AB = ctx_sql({"a": "chain = 'A'", "b": "chain = 'B'", "ab": "chain in ('A','B')"})


@query("interface", AB + ", t as (select frame, coalesce(sum(sasa) filter (context='a'),0) a_free, coalesce(sum(sasa) filter (context='b'),0) b_free, coalesce(sum(sasa) filter (context='ab' and chain='A'),0) a_bound, coalesce(sum(sasa) filter (context='ab' and chain='B'),0) b_bound, coalesce(sum(sasa) filter (context='ab'),0) complex from sr group by frame) select frame, round(a_free,5) a_free, round(b_free,5) b_free, round(a_bound,5) a_bound, round(b_bound,5) b_bound, round(complex,5) complex, round(a_free+b_free-complex,5) buried, round((a_free+b_free-complex)/2,5) interface, round((a_free-a_bound)/greatest(a_free,1e-12),6) a_buried_fraction, round((b_free-b_bound)/greatest(b_free,1e-12),6) b_buried_fraction from t")
def _(s, d):
    out = X.interface(heavy(part_atoms(s, d)), *sides(), PROBE, POINTS, EDGE, check=False)
    return out.select("frame", *(rnd(c) for c in ("a_free", "b_free", "a_bound", "b_bound", "complex", "buried", "interface")), rnd("a_buried_fraction", 6), rnd("b_buried_fraction", 6))


@query("interface_residue", AB + ", t as (select frame, residue_id, coalesce(sum(sasa) filter (context<>'ab'),0) free, coalesce(sum(sasa) filter (context='ab'),0) bound from sr group by all) select frame, residue_id, round(free-bound,5)+0.0 as buried, case when free-bound > 1e-9 then round((free-bound)/greatest(free,1e-12),6) end as buried_fraction from t")
def _(s, d):
    out = X.interface_residues(heavy(part_atoms(s, d)), *sides(), PROBE, POINTS, EDGE)
    return out.select("frame", "residue_id", (F.round("buried", 5) + F.lit(0.0)).alias("buried"), rnd("buried_fraction", 6))


@query("interface_polar", AB + ", t as (select frame, coalesce(sum(case when context='ab' then -sasa else sasa end) filter (atom_class='polar'),0) p, coalesce(sum(case when context='ab' then -sasa else sasa end) filter (atom_class<>'polar'),0) q from sr group by frame) select frame, round(p,5) polar_buried, round(q,5) apolar_buried, round(round(q,5)/greatest(round(p,5)+round(q,5),1e-12),6) apolar_fraction from t")
def _(s, d):
    out = X.interface_polarity(heavy(part_atoms(s, d)), *sides(), F.col("atom_class") == "polar", PROBE, POINTS, EDGE)
    out = out.select("frame", rnd("polar_buried"), rnd("apolar_buried"))  # the share of rounded areas: of none it is 0
    return out.withColumn("apolar_fraction", F.expr("round(apolar_buried / greatest(polar_buried + apolar_buried, 1e-12D), 6)"))


@query("glycan_shielding", ctx_sql({"all": "true", "bare": "chain <> 'D'"}) + ", t as (select frame, coalesce(sum(sasa) filter (context='bare'),0) bare, coalesce(sum(sasa) filter (context='all'),0) shielded from sr where chain in ('A','B') group by frame) select frame, round(bare,5) bare, round(shielded,5) shielded, round(bare-shielded,5) shielding, round((bare-shielded)/greatest(bare,1e-12),6) shielding_fraction from t")
def _(s, d):
    out = X.shielding(heavy(part_atoms(s, d)), F.col("chain").isin("A", "B"), F.col("chain") == "D", PROBE, POINTS, EDGE)
    return out.select("frame", rnd("bare"), rnd("shielded"), rnd("shielding"), rnd("shielding_fraction", 6))


# ---------------------------------------------------------------- series
STATS = f"with {SERIES}, f as (select *, (value > 200)::int up, (value > 200)::int <> lag((value > 200)::int) over (partition by feature, idx order by frame) turn from series), m as (select feature, idx, quantile_cont(value, 0.5) med from series group by all), mad as (select feature, idx, quantile_cont(abs(value - med), 0.5) mad from series join m using (feature, idx) group by all), st as (select feature, idx, avg(value) mean, var_pop(value) variance, stddev_pop(value) std, min(value) min, max(value) max, quantile_cont(value, 0.5) median, quantile_cont(value, 0.05) q05, quantile_cont(value, 0.25) q25, quantile_cont(value, 0.75) q75, quantile_cont(value, 0.95) q95, avg(up) exposure_frequency, coalesce(sum(turn::int), 0)::bigint transitions from f group by all) "
ROUNDED = ("mean", "variance", "std", "min", "max", "median", "q05", "q25", "q75", "q95", "iqr", "mad", "exposure_frequency")


@query("ts_summary", STATS + "select feature, idx, " + ", ".join(f"round({'q75 - q25' if c == 'iqr' else c}, 5) as {c}" for c in ROUNDED) + ", transitions from st join mad using (feature, idx)")
def _(s, d):
    return T.summarize(event_series(s, d), 200.0).select("feature", "idx", *(rnd(c) for c in ROUNDED), "transitions")


@query("flatten_stats", STATS + "select feature || '.' || stat || '.' || idx as name, round(value, 5) as value from (select feature, idx, unnest([" + ",".join(f"'{n}'" for n in T.SUMMARY_STATISTIC_NAMES) + "]) stat, unnest([" + ",".join("q75 - q25" if n == "iqr" else n for n in T.SUMMARY_STATISTIC_NAMES) + "]) value from st join mad using (feature, idx))")
def _(s, d):
    return T.flatten(T.summarize(event_series(s, d), 200.0)).select("name", rnd("value"))


@query("ts_kinetics", f"with recursive {SERIES}, o as (select *, row_number() over (partition by feature, idx order by frame) i from series), st as (select feature, idx, i, (value > 200)::int state from o where i = 1 union all select o.feature, o.idx, o.i, case when st.state = 1 and o.value <= 150 then 0 when st.state = 0 and o.value > 250 then 1 else st.state end from st join o on o.feature = st.feature and o.idx = st.idx and o.i = st.i + 1), c as (select *, coalesce((state <> lag(state) over (partition by feature, idx order by i))::int, 0) turn from st), r as (select *, sum(turn) over (partition by feature, idx order by i) run from c), runs0 as (select feature, idx, run, state, count(*) n from r group by all), runs as (select *, max(run) over (partition by feature, idx) last from runs0), e as (select feature, idx, max(run) last, sum(n) frames, sum(n * state) up from runs group by all), w as (select feature, idx, avg(n) filter (state = 1) exposed_dwell, avg(n) filter (state = 0) buried_dwell from runs where run > 0 and run < last group by all) select feature, idx, last::bigint as transitions, round(last / (frames - 1), 6) as rate, round(up / frames, 6) as exposed_fraction, round(exposed_dwell, 6) exposed_dwell, round(buried_dwell, 6) buried_dwell from e left join w using (feature, idx)")
def _(s, d):
    return T.kinetics(event_series(s, d), 200.0, 50.0).select("feature", "idx", F.col("transitions").cast("long").alias("transitions"), *(rnd(c, 6) for c in ("rate", "exposed_fraction", "exposed_dwell", "buried_dwell")))


@query("ts_block_se", f"with {SERIES}, b as (select feature, idx, (row_number() over (partition by feature, idx order by frame) - 1) // 16 b, value from series), m as (select feature, idx, b, avg(value) m from b group by all having count(*) = 16) select feature, idx, count(*) as blocks, round(case when count(*) >= 2 then stddev_samp(m) / sqrt(count(*)) end, 6) as block_se from m group by all")
def _(s, d):
    return T.block_error(event_series(s, d), 16).select("feature", "idx", "blocks", rnd("block_se", 6))


@query("ts_autocorr", f"with {SERIES}, p as (select *, row_number() over (partition by feature, idx order by frame) i, avg(value) over (partition by feature, idx) mean from series), c as (select feature, idx, i, value - mean d from p), v as (select feature, idx, sum(d * d) v from c group by all) select a.feature, a.idx, (b.i - a.i)::int as lag, round(sum(a.d * b.d) / any_value(v), 6) as rho from c a join c b on a.feature = b.feature and a.idx = b.idx and b.i - a.i between 1 and 20 join v on v.feature = a.feature and v.idx = a.idx group by all")
def _(s, d):
    return T.autocorrelation(event_series(s, d), 20).select("feature", "idx", "lag", rnd("rho", 6))


for _kind, _expr in {"zscore": "(value - avg(value) over w) / greatest(stddev_pop(value) over w, 1e-12)", "minmax": "(value - min(value) over w) / greatest(max(value) over w - min(value) over w, 1e-12)"}.items():
    query(f"fingerprint_{_kind}", f"with {EMBEDDING} select idx, frame, round({_expr}, 6) as value from series window w as (partition by feature, idx)")(lambda s, d, k=_kind: T.fingerprint(embedding_series(s, d), k).select("idx", "frame", rnd("value", 6)))


@query("fingerprint_relative", f"with {EMBEDDING}, r as (select idx, max(abs(value)) ref from series group by idx) select idx, frame, round(value / greatest(ref, 1e-12), 6) as value from series join r using (idx)")
def _(s, d):
    e = embedding_series(s, d)
    ref = e.groupBy("feature", "idx").agg(F.max(F.abs("value")).alias("value"))
    return T.fingerprint(e, "relative", ref).select("idx", "frame", rnd("value", 6))


@query("gram_matrix", f"with {EMBEDDING}, c as (select idx, frame, value - avg(value) over (partition by idx) v from series) select a.idx as i, b.idx as j, round(sum(a.v * b.v), 4) as dot from c a join c b using (frame) where a.idx <= b.idx group by all")
def _(s, d):
    return gram(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v")), 64).select("i", "j", rnd("dot", 4))


from . import extended  # noqa: E402, F401  registers its queries here
