"""Features of frames: relative accessibility, burial at interfaces, shielding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import canonical_residue_column, canonical_residue_name, literal_map
from .kernels import shrake_rupley
from .neighbors import keys_of

# Reference areas of extended residues (total, main chain, side chain, polar, apolar), in square angstroms.
MAX_ASA_PARTS = {
    "ALA": (108.76, 43.96, 64.80, 37.75, 71.01), "ARG": (238.17, 42.00, 196.17, 165.00, 73.17), "ASN": (145.01, 41.53, 103.48, 103.46, 41.55), "ASP": (142.76, 42.29, 100.47, 100.27, 42.49),
    "CYS": (132.20, 42.55, 89.66, 92.74, 39.47), "GLN": (178.83, 42.00, 136.83, 131.85, 46.98), "GLU": (174.18, 42.00, 132.18, 122.48, 51.70), "GLY": (81.09, 81.09, 0.00, 44.65, 36.44),
    "HIS": (182.97, 39.09, 143.87, 85.94, 97.03), "ILE": (175.73, 41.49, 134.23, 36.85, 138.87), "LEU": (179.56, 39.78, 139.78, 37.16, 142.39), "LYS": (204.98, 42.00, 162.98, 93.88, 111.10),
    "MET": (193.10, 42.00, 151.10, 75.48, 117.62), "PHE": (199.88, 38.43, 161.45, 34.94, 164.94), "PRO": (137.21, 27.51, 109.70, 16.09, 121.12), "SER": (118.34, 43.41, 74.93, 71.38, 46.96),
    "THR": (140.60, 41.96, 98.64, 66.15, 74.45), "TRP": (249.19, 42.59, 206.60, 61.64, 187.55), "TYR": (214.19, 38.43, 175.76, 81.12, 133.07), "VAL": (151.97, 41.50, 110.46, 36.87, 115.09),
}
MAX_ASA = {residue: parts[0] for residue, parts in MAX_ASA_PARTS.items()}


def relative(residues: DataFrame, residue_names: DataFrame, max_asa: dict[str, float] | None = None) -> DataFrame:
    """rsa of every residue, looked up under its usual name; null where its type has no reference.

    ``residue_names``: residue_id, residue_name, and the structure where ``residues`` has it.
    """
    table = literal_map(max_asa or MAX_ASA)
    by = [c for c in ("structure", "residue_id") if c in residue_names.columns and c in residues.columns]
    return residues.join(residue_names, by).withColumn("rsa", F.col("residue_sasa") / table[canonical_residue_column(F.col("residue_name"))])


def relative_summary(rsa: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """Per frame: mean and the shares exposed and buried, of the residues with a reference."""
    return rsa.groupBy(*keys_of(rsa)).agg(F.avg("rsa").alias("mean_rsa"), F.avg(F.when(F.col("rsa").isNotNull(), (F.col("rsa") > cutoff).cast("double"))).alias("exposed_fraction")).withColumn("buried_fraction", 1 - F.col("exposed_fraction"))


def check_masks(atoms: DataFrame, a: Column, b: Column) -> None:
    """Two groups of an interface must hold atoms and share none; one pass over the atoms."""
    n = atoms.agg(F.count(F.when(a, 1)).alias("a"), F.count(F.when(b, 1)).alias("b"), F.count(F.when(a & b, 1)).alias("both")).first()
    if not n.a or not n.b:
        raise ValueError("both groups need atoms")
    if n.both:
        raise ValueError("the groups share atoms")


def contexts(atoms: DataFrame, groups: dict[str, Column], probe: float, n_points: int, edge: float | None = None) -> DataFrame:
    """Areas of every atom in each named subset of the atoms, in one plan keyed by (frame, context)."""
    own = F.filter(F.array(*[F.when(m, F.lit(n)) for n, m in groups.items()]), lambda x: x.isNotNull())
    spread = atoms.withColumn("context", F.explode(own))
    return shrake_rupley(spread, probe, n_points, keys=keys_of(atoms, "context"), edge=edge)


def interface(atoms: DataFrame, a: Column, b: Column, probe: float = 1.4, n_points: int = 100, edge: float | None = None, check: bool = True) -> DataFrame:
    """Per frame: free, bound and complex areas, buried area and its fractions; atoms of neither group take no part.

    Groups without atoms or with common atoms are refused; without ``check``, which saves a pass over the atoms, a group
    without atoms has the area 0.
    """
    if check:
        check_masks(atoms, a, b)
    rows = contexts(atoms, {"a": a, "b": b, "ab": a | b}, probe, n_points, edge).withColumn("in_a", a)
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("sasa"))), F.lit(0.0))
    at = F.col("context")
    out = rows.groupBy(*keys_of(atoms)).agg(s(at == "a").alias("a_free"), s(at == "b").alias("b_free"), s((at == "ab") & F.col("in_a")).alias("a_bound"), s((at == "ab") & ~F.col("in_a")).alias("b_bound"), s(at == "ab").alias("complex"))
    out = out.withColumn("a_buried", F.expr("a_free - a_bound")).withColumn("b_buried", F.expr("b_free - b_bound")).withColumn("buried", F.expr("a_free + b_free - complex")).withColumn("buried_fraction", F.expr("buried / greatest(a_free + b_free, 1e-12D)")).withColumn("interface", F.col("buried") / 2)
    return out.withColumn("a_buried_fraction", F.expr("(a_free - a_bound) / greatest(a_free, 1e-12D)")).withColumn("b_buried_fraction", F.expr("(b_free - b_bound) / greatest(b_free, 1e-12D)"))


def interface_residues(atoms: DataFrame, a: Column, b: Column, probe: float = 1.4, n_points: int = 100, edge: float | None = None) -> DataFrame:
    """Buried area of every residue of the two groups; its fraction is null off the interface."""
    rows = contexts(atoms, {"a": a, "b": b, "ab": a | b}, probe, n_points, edge)
    out = rows.where("residue_id >= 0").groupBy(*keys_of(atoms), "residue_id").agg(F.sum(F.when(F.col("context") == "ab", 0.0).otherwise(F.col("sasa"))).alias("free"), F.sum(F.when(F.col("context") == "ab", F.col("sasa")).otherwise(0.0)).alias("bound"))
    out = out.withColumn("buried", F.col("free") - F.col("bound"))
    return out.withColumn("buried_fraction", F.when(F.col("buried") > 1e-9, F.expr("buried / greatest(free, 1e-12D)")))


def interface_polarity(atoms: DataFrame, a: Column, b: Column, polar: Column, probe: float = 1.4, n_points: int = 100, edge: float | None = None) -> DataFrame:
    rows = contexts(atoms, {"a": a, "b": b, "ab": a | b}, probe, n_points, edge).withColumn("signed", F.when(F.col("context") == "ab", -F.col("sasa")).otherwise(F.col("sasa"))).withColumn("polar", polar)
    out = rows.groupBy(*keys_of(atoms)).agg(F.coalesce(F.sum(F.when(F.col("polar"), F.col("signed"))), F.lit(0.0)).alias("polar_buried"), F.coalesce(F.sum(F.when(~F.col("polar"), F.col("signed"))), F.lit(0.0)).alias("apolar_buried"))
    return out.withColumn("apolar_fraction", F.expr("apolar_buried / greatest(polar_buried + apolar_buried, 1e-12D)"))


def shielding(atoms: DataFrame, target: Column, shield: Column, probe: float = 1.4, n_points: int = 100, edge: float | None = None) -> DataFrame:
    """Area of the target lost to the shield (a glycan, say)."""
    rows = contexts(atoms, {"all": F.lit(True), "bare": ~shield}, probe, n_points, edge).where(target)
    out = rows.groupBy(*keys_of(atoms)).agg(F.coalesce(F.sum(F.when(F.col("context") == "bare", F.col("sasa"))), F.lit(0.0)).alias("bare"), F.coalesce(F.sum(F.when(F.col("context") == "all", F.col("sasa"))), F.lit(0.0)).alias("shielded"))
    return out.withColumn("shielding", F.expr("bare - shielded")).withColumn("shielding_fraction", F.expr("(bare - shielded) / greatest(bare, 1e-12D)"))


def max_asa(residue: str) -> float | None:
    return MAX_ASA.get(canonical_residue_name(residue))
