"""Grouped sums of atom areas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import AMINO_ACIDS, backbone_column
from ..segments import once
from .neighbors import keys_of

CLASSES = ("polar", "apolar", "unknown")


def totals(sasa: DataFrame, *keys: str, spine: DataFrame | None = None) -> DataFrame:
    """Sum of each frame; frames of ``spine`` (the keys) without atoms have the sum 0."""
    keys = keys or keys_of(sasa)
    out = sasa.groupBy(*keys).agg(F.sum("sasa").alias("total_sasa"))
    return out if spine is None else with_spine(out, spine, keys, ("total_sasa",))


def with_spine(sums: DataFrame, spine: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """A row for every key of ``spine``, with 0 where nothing was summed."""
    return spine.select(*keys).distinct().join(sums, list(keys), "left").select(*keys, *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


RANGE = 4096  # atoms whose areas are summed in one row


def kahan_totals(sasa: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Compensated sum in atom order, the same to the last bit at any partitioning.

    Ranges of ``RANGE`` atom numbers are summed apart, and their sums, with what rounding took from them, in order.
    """
    keys = keys or keys_of(sasa)
    step = lambda acc, v: F.struct((acc["s"] + (v - acc["c"])).alias("s"), ((acc["s"] + (v - acc["c"])) - acc["s"] - (v - acc["c"])).alias("c"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    add = lambda rows: F.aggregate(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["sasa"]), zero, step)
    part = sasa.groupBy(*keys, F.floor(F.col("atom") / RANGE).alias("range")).agg(add(F.struct("atom", "sasa")).alias("p"))
    both = F.struct("range", F.lit(0).alias("i"), F.col("p.s").alias("sasa")), F.struct("range", F.lit(1).alias("i"), (-F.col("p.c")).alias("sasa"))
    return part.select(*keys, F.explode(F.array(*both)).alias("r")).groupBy(*keys).agg(add(F.col("r"))["s"].alias("total_sasa"))


def residue_sums(sasa: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Negative residue ids take no part."""
    return sasa.where("residue_id >= 0").groupBy(*(keys or keys_of(sasa)), "residue_id").agg(F.sum("sasa").alias("residue_sasa"))


def mask_sums(sasa: DataFrame, masks: Mapping[str, Column], keys: tuple[str, ...] | None = None) -> DataFrame:
    """One column a mask; masks may overlap; an empty mask gives 0."""
    return sasa.groupBy(*(keys or keys_of(sasa))).agg(*[F.coalesce(F.sum(F.when(m, F.col("sasa"))), F.lit(0.0)).alias(n) for n, m in masks.items()])


def class_sums(sasa: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    return mask_sums(sasa, {c: F.col("atom_class") == c for c in CLASSES}, keys)


def class_by_selection(sasa: DataFrame, masks: Mapping[str, Column], keys: tuple[str, ...] | None = None) -> DataFrame:
    return mask_sums(sasa, {f"{n}_{c}": m & (F.col("atom_class") == c) for n, m in masks.items() for c in CLASSES}, keys)


def residue_records(sasa: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Six areas a residue: total, main and side chain, polar, apolar, unknown."""
    main = backbone_column(F.col("atom_name"))
    masks = {"total": F.lit(True), "main_chain": main, "side_chain": ~main} | {c: F.col("atom_class") == c for c in CLASSES}
    return mask_sums(sasa.where("residue_id >= 0"), masks, (*(keys or keys_of(sasa)), "residue_id"))


def chain_sums(sasa: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """With ``first_atom``, by which chains sort as they first occur."""
    return sasa.groupBy(*(keys or keys_of(sasa)), "chain").agg(F.sum("sasa").alias("chain_sasa"), F.min("atom").alias("first_atom"))


def hierarchy(sasa: DataFrame) -> DataFrame:
    """Structure, chain and residue levels by rollup."""
    return sasa.rollup(*keys_of(sasa), "chain", "residue_id").agg(F.sum("sasa").alias("sasa"), F.grouping_id().alias("level"))


def residue_type_sums(sasa: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The 20 standard residue types, 0 where missing."""
    keys = keys or keys_of(sasa)
    sasa = once(sasa, *keys, "residue_name")
    kinds = sasa.sparkSession.createDataFrame([(i, r) for i, r in enumerate(AMINO_ACIDS)], "ord int, residue_name string")
    frames = sasa.select(*keys).distinct()
    sums = sasa.groupBy(*keys, "residue_name").agg(F.sum("sasa").alias("s"))
    return frames.crossJoin(F.broadcast(kinds)).join(sums, [*keys, "residue_name"], "left").select(*keys, "ord", "residue_name", F.coalesce("s", F.lit(0.0)).alias("type_sasa"))
