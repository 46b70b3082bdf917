"""Further registered queries: structures as keys, reports, readers, selection helpers, radii policies, feature bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import extract_features
from ..functions.chemistry import AMINO_ACIDS, ELEMENT_RADII, MASSES, RESIDUE_NAME_ALIASES, TWO_LETTERS, class_column, mass_element_column, protor
from ..operators import aggregate as A
from ..operators import features as X
from ..operators import timeseries as T
from ..operators.kernels import lee_richards, shrake_rupley, surface_points
from ..operators.neighbors import expanded, neighbor_pairs
from ..sources import sinks
from ..scratch import scratch_dir
from ..sources.structures import assign_radii, mmcif_atoms, pdb_atoms, psf_atoms, with_coordinates
from ..sources.trajectories import read_trajectory, write_trajectory
from .catalog import AB, BONE, HEAVY, LR, SELECTED, SELECTED_SQL, WITH, _map, _odd, _oddname, _pro, ctx_sql, heavy, masks, query, rnd, sides, sr, sr_sql
from .selection import compacted, unmatched_items, with_masks
from .tables import EDGE, POINTS, PROBE, SERIES, SLICES, SPACING, event_series, part_atoms, sql_atoms

CLASS_LIST = ",".join(f"'{c}'" for c in A.CLASSES)

# ---------------------------------------------------------------- several structures
TWO = ctx_sql({"whole": "true", "even": "residue_id % 2 = 0"})


def two_structures(s: SparkSession, d: str) -> DataFrame:
    """Two structures that lie in the same place: were they mixed, each would bury the other."""
    atoms = heavy(part_atoms(s, d))
    return atoms.withColumn("structure", F.explode(F.array(F.lit("whole"), F.when(F.col("residue_id") % 2 == 0, "even")))).where("structure is not null")


@query("structure_totals", TWO + "select context as structure, frame, round(sum(sasa), 5) as total_sasa from sr group by all")
def _(s, d):
    return A.totals(shrake_rupley(two_structures(s, d), PROBE, POINTS, edge=EDGE)).select("structure", "frame", rnd("total_sasa"))


@query("structure_residues", TWO + "select context as structure, frame, residue_id, round(sum(sasa), 5) as residue_sasa from sr group by all")
def _(s, d):
    return A.residue_sums(shrake_rupley(two_structures(s, d), PROBE, POINTS)).select("structure", "frame", "residue_id", rnd("residue_sasa"))


@query("structure_chains", TWO + "select context as structure, frame, chain, round(sum(sasa), 5) as chain_sasa, min(atom) as first_atom from sr group by all")
def _(s, d):
    return A.chain_sums(shrake_rupley(two_structures(s, d), PROBE, POINTS)).select("structure", "frame", "chain", rnd("chain_sasa"), "first_atom")


@query("topology_join", f"with {sql_atoms(3)}, two as (select *, 'whole' as structure from atoms union all select *, 'even' from atoms where residue_id % 2 = 0) select structure, frame, chain, count(*) as atoms, round(sum(x + 2 * y + 3 * z), 4) as moment from two group by all")
def _(s, d):
    atoms = part_atoms(s, d, 1).withColumn("structure", F.explode(F.array(F.lit("whole"), F.when(F.col("residue_id") % 2 == 0, "even")))).where("structure is not null")
    coords = part_atoms(s, d, 3).select(F.explode(F.array(F.lit("whole"), F.when(F.col("residue_id") % 2 == 0, "even"))).alias("structure"), "frame", "atom", "x", "y", "z").where("structure is not null")
    out = with_coordinates(atoms, coords, check=True)
    return out.groupBy("structure", "frame", "chain").agg(F.count("*").alias("atoms"), F.round(F.sum(F.expr("x + 2 * y + 3 * z")), 4).alias("moment"))


@query("empty_frames", WITH + ", frames as (select unnest(range(3))::int as frame) select f.frame, round(coalesce(sum(sasa), 0), 5) as total_sasa from frames f left join (select * from sr where frame = 1) sr on sr.frame = f.frame group by all")
def _(s, d):
    spine = s.range(3).select(F.col("id").cast("int").alias("frame"))
    return A.totals(sr(s, d, f"{HEAVY} and frame = 1"), spine=spine).select("frame", rnd("total_sasa"))


# ---------------------------------------------------------------- kernels on parts
CENTRES = "residue_id % 5 = 0"


@query("lr_centers", LR.replace(sr_sql(HEAVY), sr_sql(HEAVY, centers=CENTRES)).replace("from u left join lost", f"from (select * from u where {CENTRES}) u left join lost") + "select frame, atom, round(sasa, 4) as sasa from lr")
def _(s, d):
    return lee_richards(heavy(part_atoms(s, d)), PROBE, SLICES, F.expr(CENTRES), edge=EDGE).select("frame", "atom", rnd("sasa", 4))


@query("supplied_pairs", WITH.replace("a.atom <> b.atom", "a.atom <> b.atom and abs(a.atom - b.atom) <= 150") + "select frame, atom, exposed from sr")
def _(s, d):
    atoms = heavy(part_atoms(s, d))
    pairs = neighbor_pairs(expanded(atoms, PROBE), edge=EDGE).where("abs(atom - other) <= 150")
    return shrake_rupley(atoms, PROBE, POINTS, pairs=pairs).select("frame", "atom", "exposed")


@query("atom_layers", WITH + "select frame, least(exposed // 10, 9)::int as layer, count(*) as atoms, round(sum(sasa), 5) as area from sr group by all")
def _(s, d):
    return sr(s, d).groupBy("frame", F.least(F.floor(F.col("exposed") / 10), F.lit(9)).cast("int").alias("layer")).agg(F.count("*").alias("atoms"), F.round(F.sum("sasa"), 5).alias("area"))


# ---------------------------------------------------------------- radii, classes, elements
ODD_ELEMENT = "case when atom % 9 = 0 then 'XX' else element end"
ODD_NAME = "case when atom % 9 = 0 then 'Q1' else atom_name end"


@query("unknown_radius", f"with {sql_atoms(1)}, {_map('tab', _pro.radii())}, {_map('ele', ELEMENT_RADII)}, o as (select atom, residue_name, {ODD_ELEMENT} as el, {ODD_NAME} as nm from atoms), r as (select o.*, coalesce(tab.v, ele.v) as radius from o left join tab on tab.k = residue_name || ':' || nm left join ele on ele.k = el) select 'guess' as policy, count(*) as atoms, round(sum(coalesce(radius, 0)), 5) as radii from r union all select 'skip', count(*), round(sum(radius), 5) from r where radius is not null")
def _(s, d):
    a = part_atoms(s, d, 1).drop("radius", "atom_class").withColumn("element", F.expr(ODD_ELEMENT)).withColumn("atom_name", F.expr(ODD_NAME))
    out = [assign_radii(a, unknown=p).agg(F.lit(p).alias("policy"), F.count("*").alias("atoms"), F.round(F.sum("radius"), 5).alias("radii")) for p in ("guess", "skip")]
    return out[0].union(out[1]).select("policy", "atoms", "radii")


@query("config_class", f"with {sql_atoms(1)}, {_map('cls', _pro.classes())}, {_map('ali', RESIDUE_NAME_ALIASES)}, n as (select atom, {_odd} as res, {_oddname} as name from atoms), m as (select n.*, coalesce(ali.v, res) as base from n left join ali on ali.k = res) select atom, coalesce(c1.v, c2.v, 'unknown') as class from m left join cls c1 on c1.k = res || ':' || name left join cls c2 on c2.k = base || ':' || name")
def _(s, d):
    a = part_atoms(s, d, 1).withColumn("res", F.expr(_odd)).withColumn("name", F.expr(_oddname))
    return a.select("atom", class_column(protor(), F.col("res"), F.col("name"), F.col("element")).alias("class"))


MASS_LIST = [12.011, 14.007, 15.999, 1.008, 3.024, 40.078, 22.98977, 35.45, 9.995, 7.0, 0.5, 63.546, 13.983]
MASS_NAMES = ["CA", "N1", "O", "HB", "ZN2", "SOD", "CL", "X", "1HG", "CU", "OH"]
_cand = "cand as (select * from (values " + ",".join(f"({k * 100 + i},'{e}',{w - 2.016 * k!r}::double)" for k in range(4) for i, (e, w) in enumerate(MASSES.items())) + ") t(ord, e, w))"


@query("mass_elements", f"with {_cand}, m as (select p_partkey::int as atom, {MASS_LIST!r}[(p_partkey % 13 + 1)::int]::double as mass, {MASS_NAMES!r}[(p_partkey // 13 % 11 + 1)::int] as name from part), l as (select *, upper(regexp_replace(name, '[^A-Za-z]', '', 'g')) as letters from m), g as (select *, case when letters[1:2] in ({','.join(repr(t) for t in TWO_LETTERS)}) then letters[1:2] else letters[1:1] end as named from l) select atom, mass, name, case when mass < 0.9 then null when mass < 4.5 then 'H' else coalesce(arg_min(e, ord) filter (e = named or e = named[1:1]), arg_min(e, ord)) end as element from g left join cand on abs(mass - w) < 0.1 group by atom, mass, name")
def _(s, d):
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    a = F.col("p_partkey").cast("long")
    m = s.read.parquet(f"{d}/part.parquet").select(a.cast("int").alias("atom"), pick(MASS_LIST, a % 13).alias("mass"), pick(MASS_NAMES, F.floor(a / 13) % 11).alias("name"))
    return m.withColumn("element", mass_element_column(F.col("mass"), F.col("name")))


# ---------------------------------------------------------------- selections
ITEMS = ["a, name CA+ZZ+QQ", "b, resn ALA+XXX and chain A+Z", "c, resi 1+99999"]
ITEM_ROWS = "(values ('a','name CA','CA','n'),('a','name ZZ','ZZ','n'),('a','name QQ','QQ','n'),('b','resn ALA','ALA','r'),('b','resn XXX','XXX','r'),('b','chain A','A','c'),('b','chain Z','Z','c'),('c','resi 1','1','i'),('c','resi 99999','99999','i')) t(selection, item, v, kind)"


@query("item_warnings", f"with {sql_atoms(1)} select selection, item from {ITEM_ROWS} where not exists (select 1 from atoms where case kind when 'n' then atom_name when 'r' then residue_name when 'c' then chain else residue_number::varchar end = v)")
def _(s, d):
    return unmatched_items(part_atoms(s, d, 1), ITEMS)


@query("metadata_masks", f"with {sql_atoms(1)} select atom, (element = 'C' and chain = 'B') as sel_carbons, (residue_number between 3 and 9) as sel_start from atoms")
def _(s, d):
    meta = part_atoms(s, d, 1).select("atom", "atom_name", "residue_name", "residue_number", "chain", "element")
    return with_masks(meta, ["carbons, symbol C and chain B", "start, resi 3-9"])[0].select("atom", "sel_carbons", "sel_start")


@query("selection_in_filter", f"with {sql_atoms(1)}, u as (select * from atoms) " + " union all ".join(f"select '{n}' as selection, count(*) filter ({c}) as atoms, count(*) filter (({c}) and chain = 'A') as kept from u" for n, c in SELECTED_SQL.items()))
def _(s, d):
    return compacted(part_atoms(s, d, 1), SELECTED, F.col("chain") == "A")


# ---------------------------------------------------------------- relative areas under other names
RENAMED = {"HIS": "HSD", "CYS": "CYX", "LYS": "LYN", "GLU": "glh"}
_renamed = "case when residue_id % 7 = 0 then 'LIG' " + " ".join(f"when residue_name = '{k}' then '{v}'" for k, v in RENAMED.items()) + " else residue_name end"
_usual = lambda c: f"case upper({c}) " + " ".join(f"when '{k}' then '{v}'" for k, v in RESIDUE_NAME_ALIASES.items()) + f" else upper({c}) end"
ASA_TABLE = "asa as (select * from (values " + ",".join(f"('{k}'," + ",".join(f"{x!r}::double" for x in v) + ")" for k, v in X.MAX_ASA_PARTS.items()) + ") t(usual, m0, m1, m2, m3, m4))"


def renamed(s: SparkSession, d: str) -> DataFrame:
    return sr(s, d).withColumn("residue_name", F.expr(_renamed))


@query("rsa_aliases", WITH + f", {ASA_TABLE}, res as (select frame, residue_id, min({_renamed}) as name, sum(sasa) as s from sr group by all) select frame, residue_id, name as residue_name, round(s / m0, 6) as rsa from res left join asa on usual = {_usual('name')}")
def _(s, d):
    area = renamed(s, d)
    names = heavy(part_atoms(s, d, 1)).select("residue_id", F.expr(_renamed).alias("residue_name")).distinct()
    return X.relative(A.residue_sums(area), names).select("frame", "residue_id", "residue_name", rnd("rsa", 6))


_parts = {"total": "true", "main_chain": BONE, "side_chain": f"not {BONE}", "polar": "atom_class = 'polar'", "apolar": "atom_class = 'apolar'"}
RSA_ROWS = WITH + f", {ASA_TABLE}, nmd as (select *, {_renamed} as nm from sr), rec as (select frame, residue_id, min(chain) as chain, min(residue_number)::varchar as label, min(nm) as nm, " + ", ".join(f"coalesce(sum(sasa) filter ({w}), 0) as {n}" for n, w in _parts.items()) + f" from nmd group by frame, residue_id), rel as (select rec.*, " + ", ".join(f"case when m{i} > 0 then 100 * {n} / m{i} end as {n}_rel" for i, n in enumerate(_parts)) + f" from rec left join asa on usual = {_usual('nm')}), rr as (select frame, 'RES' as kind, residue_id::bigint as ord, chain, label as residue_label, nm as residue_name, " + ", ".join([*_parts, *(f"{n}_rel" for n in _parts)]) + " from rel union all select frame, 'CHAIN', (select min(atom) from sr x where x.chain = rel.chain and x.frame = rel.frame)::bigint, chain, null, null, " + ", ".join([*(f"sum({n})" for n in _parts), *["null"] * 5]) + " from rel group by frame, chain union all select frame, 'TOTAL', 0, null, null, null, " + ", ".join([*(f"sum({n})" for n in _parts), *["null"] * 5]) + " from rel group by frame) "


@query("report_rsa", RSA_ROWS + "select frame, kind, ord, chain, residue_label, residue_name, " + ", ".join(f"round({c}, 4) as {c}" for n in _parts for c in (n, f"{n}_rel")) + " from rr")
def _(s, d):
    out = sinks.rsa_rows(renamed(s, d))
    return out.select("frame", "kind", F.col("ord").cast("long").alias("ord"), "chain", "residue_label", "residue_name", *(rnd(c, 4) for n in _parts for c in (n, f"{n}_rel")))


# ---------------------------------------------------------------- reports
_sel_sum = lambda c: f"round(coalesce(sum(sasa) filter ({c}), 0), 2)"
LOG = WITH + ", t as (select frame, round(sum(sasa), 2) as total, " + ", ".join(f"round(coalesce(sum(sasa) filter (atom_class = '{c}'), 0), 2) as {c}" for c in A.CLASSES) + ", " + ", ".join(f"{_sel_sum(c)} as sel_{n}" for n, c in SELECTED_SQL.items()) + " from sr group by frame), log as (select frame, 0 as ord, 'total' as name, total as sasa from t union all select frame, 1, 'polar', polar from t union all select frame, 2, 'apolar', case when unknown = 0 then round(total - polar, 2) else apolar end from t union all select frame, 3, 'unknown', unknown from t union all " + " union all ".join(f"select frame, {2000 + i}, 'selection {n}', sel_{n} from t" for i, n in enumerate(SELECTED_SQL)) + " union all select frame, 1000 + ascii(chain), 'chain ' || chain, round(sum(sasa), 2) from sr group by frame, chain) "


@query("report_log", LOG + "select frame, ord, name, sasa from log")
def _(s, d):
    return sinks.log_rows(sr(s, d), masks(heavy(part_atoms(s, d, 1)))).select("frame", "ord", "name", "sasa")


@query("report_res", WITH + "select f.frame, printf('RES %s : %10.2f', k.residue_name, coalesce(s, 0)) as value from (select distinct frame from sr) f cross join (select unnest([" + ",".join(f"'{r}'" for r in AMINO_ACIDS) + "]) as residue_name) k left join (select frame, residue_name, sum(sasa) s from sr group by all) x on x.frame = f.frame and x.residue_name = k.residue_name")
def _(s, d):
    return sinks.res_lines(sr(s, d)).select("frame", "value")


_coded = "residue_number || case when residue_id % 3 = 0 then 'A' else '' end"


@query("report_seq", WITH + f", r as (select frame, residue_id, min(chain) as chain, min({_coded}) as label, min(residue_name) as name, sum(sasa) as area from sr group by all) select frame, residue_id::bigint as ord, case when label like '%A' then printf('SEQ %s %5s %s : %7.2f', chain, label, name, area) else printf('SEQ %s %4s %s : %7.2f', chain, label, name, area) end as value from r")
def _(s, d):
    return sinks.seq_lines(sr(s, d).withColumn("residue_label", F.expr(_coded))).select("frame", F.col("ord").cast("long").alias("ord"), "value")


@query("report_pdb", WITH + "select frame, atom, printf('%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', case when is_het then 'HETATM' else 'ATOM' end, atom % 99999 + 1, case when length(atom_name) < 4 then ' ' || atom_name else atom_name end, residue_name, chain, residue_number, case when residue_id % 3 = 0 then 'A' else '' end, x, y, z, radius, least(greatest(sasa, 0), 999.99), element) as value from sr")
def _(s, d):
    return sinks.pdb_lines(sr(s, d).withColumn("residue_label", F.expr(_coded))).select("frame", F.col("ord").alias("atom"), "value")


@query("report_cif", LOG + ", lines as (select frame, unnest(['loop_', '_sasa_results.name', '_sasa_results.area', 'loop_', '_atom_sasa.id', '_atom_sasa.radius', '_atom_sasa.area', 'loop_', '_residue_sasa.id', '_residue_sasa.area']) as value from (select distinct frame from sr) union all select frame, printf('''%s'' %.2f', name, sasa) from log union all select frame, printf('%d %.3f %.3f', atom + 1, radius, sasa) from sr union all select frame, printf('%d %.3f', residue_id, sum(sasa)) from sr group by frame, residue_id) select frame, value, count(*) as lines from lines group by all")
def _(s, d):
    return sinks.cif_lines(sr(s, d), masks(heavy(part_atoms(s, d, 1)))).groupBy("frame", "value").agg(F.count("*").alias("lines"))


@query("report_json", WITH + "select frame, round(sum(sasa), 5) as total, round(sum(sasa) filter (atom_class = 'polar'), 5) as polar, count(*) as atoms, count(distinct residue_id) as residues, 'ProtOr (built-in)' as radii, 100 as points, round(sum(sasa) filter (residue_id = 3), 5) as third from sr group by frame")
def _(s, d):
    doc = sinks.json_rows(sr(s, d), config=protor())
    kind = "total_sasa double, classes struct<polar double>, atoms array<struct<atom int>>, residues array<struct<residue_id int, sasa double>>, parameters struct<radii string, points int>"
    r = doc.select("frame", F.from_json("value", kind).alias("j"))
    return r.select("frame", F.round("j.total_sasa", 5).alias("total"), F.round("j.classes.polar", 5).alias("polar"), F.size("j.atoms").cast("long").alias("atoms"), F.size("j.residues").cast("long").alias("residues"), F.col("j.parameters.radii").alias("radii"), F.col("j.parameters.points").alias("points"), F.round(F.col("j.residues")[3]["sasa"], 5).alias("third"))


@query("report_xml", WITH + "select frame, round(sum(sasa), 5) as total, count(distinct residue_id) as residues from sr group by frame")
def _(s, d):
    r = sinks.xml_rows(sr(s, d), atoms=False)
    return r.select("frame", F.round(F.expr("xpath_double(value, 'result/total_sasa')"), 5).alias("total"), F.size(F.expr("xpath(value, 'result/residues/residue_id/text()')")).cast("long").alias("residues"))


@query("csv_residue", WITH + "select frame, residue_id as residue, round(sum(sum(sasa)) over (partition by frame), 4) as total_sasa, round(sum(sasa), 5) as residue_sasa from sr group by frame, residue_id")
def _(s, d):
    return sinks.trajectory_rows(sr(s, d), "residue").select("frame", "residue", rnd("total_sasa", 4), rnd("residue_sasa"))


_each = lambda names: " union all ".join(f"select frame, '{n}' as selection, round(coalesce(sum(sasa) filter ({c}), 0), 5) as selection_sasa from sr group by frame" for n, c in names.items())


@query("csv_selection", WITH + _each(SELECTED_SQL))
def _(s, d):
    return sinks.trajectory_rows(sr(s, d), "selection", masks(heavy(part_atoms(s, d, 1)))).select("frame", "selection", rnd("selection_sasa"))


@query("csv_class", WITH + f"select f.frame, class, round(coalesce(sum(sasa), 0), 5) as class_sasa from (select distinct frame from sr) f cross join (select unnest([{CLASS_LIST}]) as class) c left join sr on sr.frame = f.frame and sr.atom_class = class group by all")
def _(s, d):
    return sinks.trajectory_rows(sr(s, d), "class").select("frame", "class", rnd("class_sasa"))


@query("csv_class_selection", WITH + " union all ".join(f"select frame, '{n}' as selection, '{k}' as class, round(coalesce(sum(sasa) filter (({c}) and atom_class = '{k}'), 0), 5) as selection_sasa from sr group by frame" for n, c in SELECTED_SQL.items() for k in A.CLASSES))
def _(s, d):
    return sinks.trajectory_rows(sr(s, d), "class_selection", masks(heavy(part_atoms(s, d, 1)))).select("frame", "selection", "class", rnd("selection_sasa"))


_head = "count(distinct frame) as frames, count(distinct atom) as atoms, round(sum(sasa), 4) as total_sasa"


@query("summary_total", WITH + f"select {_head}, 'element (Bondi)' as radii from sr")
def _(s, d):
    return sinks.summary_row(sr(s, d)).select("frames", "atoms", rnd("total_sasa", 4), "radii")


@query("summary_selection", WITH + f"select {_head}, " + ", ".join(f"round(coalesce(sum(sasa) filter ({c}), 0), 4) as {n}" for n, c in SELECTED_SQL.items()) + " from sr")
def _(s, d):
    return sinks.summary_row(sr(s, d), "selection", masks(heavy(part_atoms(s, d, 1)))).select("frames", "atoms", rnd("total_sasa", 4), *(rnd(n, 4) for n in SELECTED_SQL))


@query("summary_class", WITH + f"select {_head}, " + ", ".join(f"round(coalesce(sum(sasa) filter (atom_class = '{c}'), 0), 4) as {c}" for c in A.CLASSES) + " from sr")
def _(s, d):
    return sinks.summary_row(sr(s, d), "class").select("frames", "atoms", rnd("total_sasa", 4), *(rnd(c, 4) for c in A.CLASSES))


@query("summary_class_selection", WITH + f"select {_head}, " + ", ".join(f"round(coalesce(sum(sasa) filter (({w}) and atom_class = '{c}'), 0), 4) as {n}_{c}" for n, w in SELECTED_SQL.items() for c in A.CLASSES) + " from sr")
def _(s, d):
    return sinks.summary_row(sr(s, d), "class_selection", masks(heavy(part_atoms(s, d, 1)))).select("frames", "atoms", rnd("total_sasa", 4), *(rnd(f"{n}_{c}", 4) for n in SELECTED_SQL for c in A.CLASSES))


FREE = WITH + ", free as (select e.frame, e.atom, e.k, e.x + e.er * e.ux as px, e.y + e.er * e.uy as py, e.z + e.er * e.uz as pz from (select u.*, k, ux, uy, uz from u, points) e where not exists (select 1 from pairs a where a.frame = e.frame and a.atom = e.atom and (e.x + e.er * ux - ox) * (e.x + e.er * ux - ox) + (e.y + e.er * uy - oy) * (e.y + e.er * uy - oy) + (e.z + e.er * uz - oz) * (e.z + e.er * uz - oz) < oer * oer)) "


def points_of(s: SparkSession, d: str) -> DataFrame:
    return surface_points(heavy(part_atoms(s, d)), PROBE, POINTS, edge=EDGE)


@query("point_lines", FREE + "select frame, atom, count(*) as lines, true as shaped from free group by all")
def _(s, d):
    lines = sinks.point_lines(points_of(s, d)).withColumn("shaped", F.col("value").rlike(r"^-?\d+\.\d{3} -?\d+\.\d{3} -?\d+\.\d{3} \d+$"))
    return lines.groupBy("frame", F.element_at(F.split("value", " "), -1).cast("int").alias("atom")).agg(F.count("*").alias("lines"), F.bool_and("shaped").alias("shaped"))


@query("xyz_lines", FREE + ", c as (select frame, count(*) c from free group by frame) select frame, (select max(c) from c) + 2 as lines, (select max(c) from c)::varchar as head, (select max(c) from c) as points from c")
def _(s, d):
    lines = sinks.xyz_lines(points_of(s, d))
    return lines.groupBy("frame").agg(F.count("*").alias("lines"), F.min_by("value", "ord").alias("head"), F.count(F.when(F.col("value").startswith("X "), 1)).alias("points"))


@query("padded_points", FREE + ", n as (select *, row_number() over (partition by frame order by atom, k) - 1 as nth from free), c as (select frame, count(*) c, max(count(*)) over () as most from free group by frame), f as (select n.frame, unnest(range(c, most)) as nth, px, py, pz from n join c using (frame) where nth = 0) select frame, nth, round(px, 4) as px, round(py, 4) as py, round(pz, 4) as pz from (select frame, nth, px, py, pz from n union all select * from f)")
def _(s, d):
    return sinks.padded_points(points_of(s, d)).select("frame", F.col("nth").cast("long").alias("nth"), rnd("px", 4), rnd("py", 4), rnd("pz", 4))


# ---------------------------------------------------------------- readers, on texts made from the tables
_alt = "case when atom % 6 = 1 then 'A' when atom % 6 = 2 then 'B' else ' ' end"
_same = "case when atom % 6 = 2 then 'CA' else atom_name end"  # location B of the atom before


FILE = 8000  # atoms of a file: its fields hold four digits of a residue number
BASE = f"({FILE} * {{}}) div 144 * {SPACING}D"  # z where a file begins: its fields hold four digits before the point
_label = "residue_id % 1000 + 1"


def pdb_text(s: SparkSession, d: str) -> DataFrame:
    """Files of two models of PDB lines, the second short; z counts from where the file begins, see :func:`pdb_placed`."""
    a = part_atoms(s, d, 1).withColumn("z", F.col("z") - F.expr(BASE.format(f"(atom div {FILE})"))).withColumn("alt", F.expr(_alt)).withColumn("nm", F.expr(_same)).withColumn("structure", F.concat(F.lit("m"), F.floor(F.col("atom") / FILE).cast("string")))
    line = F.format_string("%-6s%5d  %-3s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f  1.00  0.00      %-4s%2s", F.when(F.col("is_het"), "HETATM").otherwise("ATOM"), F.col("atom") % FILE + 1, "nm", "alt", "residue_name", "chain", F.expr(_label).cast("int"), F.when(F.col("residue_id") % 3 == 0, "A").otherwise(""), "x", "y", "z", F.lit("SEG"), F.when(F.col("atom") % 4 == 0, "").otherwise(F.col("element")))
    nth = F.col("atom") % FILE
    body = a.select("structure", (nth + 1).cast("long").alias("line"), line.alias("value"))
    again = a.where(nth < 100).select("structure", (nth + 20001).cast("long").alias("line"), line.alias("value"))
    marks = F.array(*(F.struct(F.lit(k).cast("long").alias("line"), F.lit(v).alias("value")) for k, v in ((0, "MODEL        1"), (19000, "ENDMDL"), (20000, "MODEL        2"), (99999, "END"))))
    files = a.where(nth == 0).select("structure", F.explode(marks).alias("m")).select("structure", "m.*")
    return files.union(body).union(again)


def pdb_placed(atoms: DataFrame) -> DataFrame:
    """Atoms read from :func:`pdb_text`, each file where it belongs."""
    return atoms.withColumn("z", F.round(F.col("z") + F.expr(BASE.format("cast(substring(structure, 2) as bigint)")), 3))


# the element of blank columns follows from the name; CA then reads as calcium
_read = f"case when atom % 4 = 0 then case when {_same} in ('CA') then 'CA' else {_same}[1:1] end else element end"
PDB_SQL = f"with {sql_atoms(1)}, a as (select 'm' || (atom // {FILE}) as structure, atom % {FILE} as atom, ({_label}) || case when residue_id % 3 = 0 then 'A' else '' end as residue_label, residue_name, chain, {_same} as atom_name, {_alt} as alt, {_read} as element, is_het, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from atoms)"
PDB_COLS = "atom_name, residue_name, chain, residue_label, element, x, y, z"


@query("pdb_read", PDB_SQL + f" select structure, line, {PDB_COLS} from (select (atom + 1)::bigint as line, *, row_number() over (partition by structure, chain, residue_label, residue_name, atom_name, alt = ' ' order by atom) as nth from a where not is_het and element not in ('H','D')) where alt = ' ' or nth = 1")
def _(s, d):
    return pdb_placed(pdb_atoms(pdb_text(s, d))).select("structure", "line", *PDB_COLS.split(", "))


@query("pdb_align", PDB_SQL + " select chain, count(*) as atoms, round(sum(x + y + z), 3) as moment from (select * from a union all select * from a where atom < 100) group by chain")
def _(s, d):
    return pdb_placed(pdb_atoms(pdb_text(s, d), align=True)).groupBy("chain").agg(F.count("*").alias("atoms"), F.round(F.sum(F.expr("x + y + z")), 3).alias("moment"))


@query("pdb_models", PDB_SQL + " select 1 as model, count(*) as atoms from a union all select 2, count(*) from a where atom < 100")
def _(s, d):
    out = pdb_atoms(pdb_text(s, d).withColumn("value", F.concat(F.substring("value", 1, 16), F.lit(" "), F.expr("substring(value, 18)"))), hetatm=True, hydrogen=True, join_models=True)
    return out.groupBy("model").agg(F.count("*").alias("atoms")).select(F.col("model").cast("int").alias("model"), "atoms")


@query("residue_runs_structures", f"with {sql_atoms(1)}, two as (select *, 'whole' as structure from atoms union all select *, 'even' from atoms where residue_id % 2 = 0), k as (select structure, atom, chain || '/' || (size // 10) as key from two), c as (select *, case when key is distinct from lag(key) over (partition by structure order by atom) then 1 else 0 end as new from k) select structure, atom, (sum(new) over (partition by structure order by atom) - 1)::bigint as run from c")
def _(s, d):
    from ..sources.records import residue_runs

    a = part_atoms(s, d, 1).withColumn("structure", F.explode(F.array(F.lit("whole"), F.when(F.col("residue_id") % 2 == 0, "even")))).where("structure is not null").select("structure", "atom", "chain", F.floor(F.col("size") / 10).alias("tens"))
    return residue_runs(a, ["chain", "tens"], within=("structure",)).select("structure", "atom", F.col("residue_id").cast("long").alias("run"))


CIF_TAGS = "group_PDB id type_symbol label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code auth_atom_id Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num".split()


def cif_text(s: SparkSession, d: str) -> DataFrame:
    """Lines of one mmCIF file for each chain, with quoted names, a text block and rows that span two lines."""
    a = part_atoms(s, d, 1)
    quoted = F.concat(F.lit('"'), "atom_name", F.lit("'\""))
    left = F.concat_ws(" ", F.when(F.col("is_het"), "HETATM").otherwise("ATOM"), (F.col("atom") + 1).cast("string"), "element", quoted, F.lit("."), "residue_name", "chain", F.col("residue_number").cast("string"), F.when(F.col("residue_id") % 3 == 0, "A").otherwise("?"), quoted)
    right = F.concat_ws(" ", F.format_string("%.3f", "x"), F.format_string("%.3f", "y"), F.format_string("%.3f", "z"), F.lit("1"))
    pieces = F.when(F.col("atom") % 5 == 0, F.array(left, right)).otherwise(F.array(F.concat_ws(" ", left, right)))
    body = a.select(F.col("chain").alias("structure"), F.posexplode(pieces).alias("k", "value"), "atom").select("structure", (F.col("atom").cast("long") * 2 + F.col("k") + 100).alias("line"), "value")
    head = ["data_x", "_entry.id 'x y'", "_entry.note", ";loop_", "_atom_site.fake", ";", "loop_", *(f"_atom_site.{c}" for c in CIF_TAGS)]
    frame = [*enumerate(head), *((10**9 + k, v) for k, v in enumerate(("# end", "loop_", "_other.a", "1 2")))]
    marks = F.array(*(F.struct(F.lit(k).cast("long").alias("line"), F.lit(v).alias("value")) for k, v in frame))
    return body.union(a.select("chain").distinct().select(F.col("chain").alias("structure"), F.explode(marks).alias("m")).select("structure", "m.*"))


@query("mmcif_read", f"with {sql_atoms(1)} select chain as structure, atom_name || '''' as atom_name, residue_name, residue_number || case when residue_id % 3 = 0 then 'A' else '' end as residue_label, element, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from atoms where not is_het and not is_h")
def _(s, d):
    return mmcif_atoms(cif_text(s, d)).select("structure", "atom_name", "residue_name", "residue_label", "element", "x", "y", "z")


PSF_MASS = {"N": 14.007, "C": 12.011, "O": 15.999, "S": 32.06, "H": 1.008}


@query("psf_read", f"with {sql_atoms(1)} select atom, chain as segment, residue_name, atom_name, residue_number::varchar as residue_label, element from atoms")
def _(s, d):
    a = part_atoms(s, d, 1)
    mass = F.element_at(F.create_map(*[F.lit(x) for kv in PSF_MASS.items() for x in kv]), F.col("element"))
    line = F.format_string("%8d %-4s %-4d %-4s %-4s %-4s %10.6f %13.4f %11d", F.col("atom") + 1, "chain", "residue_number", "residue_name", "atom_name", F.lit("T"), F.lit(0.0), mass, F.lit(0))
    head = a.agg(F.count("*").alias("n")).select(F.lit("m").alias("structure"), F.lit(2).alias("line"), F.format_string("%8d !NATOM", "n").alias("value"))
    rest = s.createDataFrame([("m", 0, "PSF"), ("m", 1, ""), ("m", 10_000_000, "       0 !NBOND")], "structure string, line int, value string")
    out = psf_atoms(head.union(rest).union(a.select(F.lit("m"), (F.col("atom") + 3).cast("int"), line)))
    return out.select("atom", "segment", "residue_name", "atom_name", "residue_label", "element")


# ---------------------------------------------------------------- trajectories, written from the tables and read back
HUNDREDTHS = f"with {sql_atoms()} select frame, atom, round(floor(x * 100) / 100, 2) as x, round(floor(y * 100) / 100, 2) as y, round(floor(z * 100) / 100, 2) as z from atoms"


def trajectory(s: SparkSession, d: str, kind: str) -> DataFrame:
    """All frames of the table in a file of that format, which hundredths survive."""
    at = scratch_dir(s).removeprefix("file://")
    write_trajectory(part_atoms(s, d).select("frame", "atom", *((F.floor(F.col(c) * 100) / 100).alias(c) for c in "xyz")), at, kind)
    return read_trajectory(s, at, kind=kind).select("frame", "atom", *((F.round(c, 2) + F.lit(0.0)).alias(c) for c in "xyz"))


@query("dcd_read", HUNDREDTHS)
def _(s, d):
    return trajectory(s, d, "dcd")


@query("xtc_read", HUNDREDTHS)
def _(s, d):
    return trajectory(s, d, "xtc")


@query("xtc_frames", HUNDREDTHS + " where frame >= 1")
def _(s, d):
    return trajectory(s, d, "xtc").where("frame >= 1")


# ---------------------------------------------------------------- features
@query("interface_outputs", AB + ", t as (select frame, coalesce(sum(sasa) filter (context='a'),0) af, coalesce(sum(sasa) filter (context='b'),0) bf, coalesce(sum(sasa) filter (context='ab' and chain='A'),0) ab, coalesce(sum(sasa) filter (context='ab' and chain='B'),0) bb from sr group by frame) select frame, round(af-ab,5)+0.0 a_buried, round(bf-bb,5)+0.0 b_buried, round((af+bf-ab-bb)/greatest(af+bf,1e-12),6)+0.0 buried_fraction from t")
def _(s, d):
    out = X.interface(heavy(part_atoms(s, d)), *sides(), PROBE, POINTS, EDGE, check=False)
    return out.select("frame", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("a_buried", 5), ("b_buried", 5), ("buried_fraction", 6))))


@query("feature_bundle", WITH + f", {ASA_TABLE}, res as (select frame, residue_id, min(residue_name) as rn, sum(sasa) as v from sr group by all), rsa as (select frame, residue_id, v / m0 as r from res left join asa on usual = rn), long as (select 'total_sasa' as feature, 0 as idx, frame, sum(sasa) as value from sr group by frame union all select 'residue_sasa', residue_id, frame, v from res union all select 'rsa', residue_id, frame, r from rsa where r is not null union all select 'mean_rsa', 0, frame, avg(r) from rsa group by frame union all select 'exposed_fraction', 0, frame, avg((r > 0.25)::int) from rsa where r is not null group by frame union all select 'buried_fraction', 0, frame, 1 - avg((r > 0.25)::int) from rsa where r is not null group by frame union all select 'backbone_sasa', 0, frame, coalesce(sum(sasa) filter ({BONE}), 0) from sr group by frame union all select 'sidechain_sasa', 0, frame, coalesce(sum(sasa) filter (not {BONE}), 0) from sr group by frame union all select 'chain_a', 0, frame, coalesce(sum(sasa) filter (chain = 'A'), 0) from sr group by frame) select feature, idx, frame, round(value, 5) as value from long")
def _(s, d):
    out = extract_features(heavy(part_atoms(s, d)), {"chain_a": F.col("chain") == "A"}, PROBE, POINTS)
    return out.select("feature", "idx", "frame", rnd("value"))


LAGS = f"with {SERIES}, p as (select feature, idx, row_number() over (partition by feature, idx order by frame) i, value - avg(value) over (partition by feature, idx) as d from series), n as (select feature, idx, count(*) frames, stddev_samp(d) sd, sum(d * d) v from p group by all), r as (select a.feature, a.idx, b.i - a.i as lag, sum(a.d * b.d) / any_value(v) as rho from p a join p b on a.feature = b.feature and a.idx = b.idx and b.i - a.i between 1 and 1000 join n on n.feature = a.feature and n.idx = a.idx group by all), stop as (select feature, idx, min(lag) filter (rho < 0) as stop from r group by all), t as (select r.feature, r.idx, 1 + 2 * coalesce(sum(rho) filter (stop is null or lag < stop), 0) as tau from r join stop using (feature, idx) group by all) "


@query("ts_uncertainty", LAGS + "select feature, idx, frames, round(greatest(tau, 1), 5) as tau, round(frames / greatest(tau, 1), 4) as effective_frames, round(sd * sqrt(greatest(tau, 1) / frames), 6) as standard_error from n join t using (feature, idx) where frames >= 8")
def _(s, d):
    out = T.uncertainty(event_series(s, d)).where("frames >= 8")
    return out.select("feature", "idx", "frames", rnd("tau"), rnd("effective_frames", 4), rnd("standard_error", 6))


@query("ts_block_default", f"with {SERIES}, q as (select feature, idx, frame, value, round_even(sqrt(count(*) over (partition by feature, idx)), 0)::int as size, row_number() over (partition by feature, idx order by frame) - 1 as i from series), m as (select feature, idx, size, i // size as b, avg(value) m from q group by all having count(*) = size) select feature, idx, any_value(size)::int as block_size, count(*) as blocks, round(case when count(*) >= 2 then stddev_samp(m) / sqrt(count(*)) end, 6) as block_se from m group by all")
def _(s, d):
    return T.block_error(event_series(s, d)).select("feature", "idx", "block_size", "blocks", rnd("block_se", 6))
