"""Atoms and series made from the driver's tables, in integer arithmetic and one division, alike in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import AMINO_ACIDS, ELEMENT_RADII, class_column, literal_map

SPACING = 4.0
PROBE = 1.4
POINTS = 100
SLICES = 20
FRAMES = 2
EDGE = 2.0 * (max(ELEMENT_RADII[e] for e in "CNOSH") + PROBE)  # the view's elements are known, so is the largest radius
ELEMENTS = ["N", "C", "C", "O", "C", "C", "S", "H"]
NAMES = ["N", "CA", "C", "O", "CB", "CG", "SG", "H"]
CHAINS = ["A", "B", "C", "D"]


def part_atoms(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """Atoms on a jittered lattice from the keys of ``part``, with ``frames`` frames."""
    a = F.col("p_partkey").cast("long")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    at = lambda cell, prime: (cell * SPACING + (a * prime % 1000) / F.lit(1000.0))
    res = F.floor(a / 8).cast("long")
    atoms = part.select(
        a.cast("int").alias("atom"), at(a % 12, 7919).alias("x0"), at(F.floor(a / 12).cast("long") % 12, 104729).alias("y"), at(F.floor(a / 144).cast("long"), 1299709).alias("z"),
        pick(ELEMENTS, a % 8).alias("element"), pick(NAMES, a % 8).alias("atom_name"), res.cast("int").alias("residue_id"), pick(AMINO_ACIDS, res % 20).alias("residue_name"),
        (res + 1).cast("int").alias("residue_number"), (res + 1).cast("string").alias("residue_label"), pick(CHAINS, F.floor(res / 25).cast("long") % 4).alias("chain"), F.lit("").alias("segment"),
        (F.col("p_brand") == "Brand#7").alias("is_het"), (a % 8 == 7).alias("is_h"), F.col("p_size").cast("int").alias("size"),
    )
    atoms = atoms.withColumn("radius", literal_map(ELEMENT_RADII)[F.col("element")]).withColumn("atom_class", class_column(None, F.col("residue_name"), F.col("atom_name"), F.col("element")))
    steps = F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))
    return atoms.withColumn("frame", steps).withColumn("x", F.col("x0") + F.col("frame") * F.lit(0.25) * (F.col("atom") % 3)).drop("x0")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series an event type and user group; the event number is the frame."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return e.select(F.col("event_type").alias("feature"), (F.col("user_id") % 4).cast("int").alias("idx"), F.col("event_id").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coordinate of the embeddings as a series over vec_id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return e.select(F.lit("embedding").alias("feature"), F.col("vec_id").cast("long").alias("frame"), F.posexplode("embedding").alias("idx", "value")).select("feature", "idx", "frame", F.col("value").cast("double").alias("value"))


# ---------------------------------------------------------------- the same in DuckDB's SQL
def sql_atoms(frames: int = FRAMES) -> str:
    lists = {k: "[" + ",".join(f"'{x}'" for x in v) + "]" for k, v in (("e", ELEMENTS), ("n", NAMES), ("r", AMINO_ACIDS), ("c", CHAINS))}
    radius = " ".join(f"when '{e}' then {ELEMENT_RADII[e]!r}::double" for e in dict.fromkeys(ELEMENTS))
    return f"""base as (select p_partkey::bigint a, p_brand, p_size::int as size from part),
named as (select a::int as atom, (a % 12) * {SPACING}::double + (a * 7919 % 1000)::double / 1000.0::double as x0, ((a // 12) % 12) * {SPACING}::double + (a * 104729 % 1000)::double / 1000.0::double as y,
 (a // 144) * {SPACING}::double + (a * 1299709 % 1000)::double / 1000.0::double as z, {lists['e']}[(a % 8 + 1)::int] as element, {lists['n']}[(a % 8 + 1)::int] as atom_name, (a // 8)::int as residue_id,
 {lists['r']}[((a // 8) % 20 + 1)::int] as residue_name, (a // 8 + 1)::int as residue_number, {lists['c']}[((a // 200) % 4 + 1)::int] as chain, p_brand = 'Brand#7' as is_het, a % 8 = 7 as is_h, size from base),
atoms as (select n.*, f.frame::int as frame, x0 + f.frame * 0.25::double * (atom % 3) as x, case element {radius} end as radius, case element when 'C' then 'apolar' when 'H' then 'unknown' else 'polar' end as atom_class
 from named n, (select unnest(range({frames})) as frame) f)"""


SERIES = "series as (select event_type as feature, (user_id % 4)::int as idx, event_id::bigint as frame, value::double as value from events)"
EMBEDDING = "series as (select 'embedding' as feature, (i - 1)::int as idx, vec_id::bigint as frame, embedding[i]::double as value from embeddings, (select unnest(range(1, 65)) as i))"
