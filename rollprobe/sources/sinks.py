"""Reports of a calculation as DataFrames of text lines or rows, written with Spark's writers.

Every report is made for each structure and frame of its table; line reports carry ``ord``, by which the lines of a
frame sort, and the text in ``value``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import AMINO_ACIDS, RadiusConfig, canonical_residue_column, literal_map, provenance
from ..operators import aggregate as A
from ..operators.features import MAX_ASA_PARTS
from ..operators.neighbors import keys_of
from ..scratch import written

PARTS = ("total", "main_chain", "side_chain", "polar", "apolar")


def shared(sasa: DataFrame) -> DataFrame:
    """Areas for a report that reads them several times: the kernel runs once, and its rows are written to the scratch folder."""
    return written(sasa)


def res_lines(sasa: DataFrame) -> DataFrame:
    """Standard residue types in fixed order, 0.00 where missing."""
    return A.residue_type_sums(sasa).select(*keys_of(sasa), "ord", F.format_string("RES %s : %10.2f", "residue_name", "type_sasa").alias("value"))


def seq_lines(sasa: DataFrame) -> DataFrame:
    """Area of every residue; a label with an insertion code is one place wider."""
    by = (*keys_of(sasa), "residue_id")
    r = sasa.groupBy(*by).agg(F.min_by("chain", "atom").alias("chain"), F.min_by("residue_label", "atom").alias("label"), F.min_by("residue_name", "atom").alias("name"), F.sum("sasa").alias("area"))
    inserted = F.col("label").rlike("[A-Za-z]$")
    return r.select(*keys_of(sasa), F.col("residue_id").alias("ord"), F.when(inserted, F.format_string("SEQ %s %5s %s : %7.2f", "chain", "label", "name", "area")).otherwise(F.format_string("SEQ %s %4s %s : %7.2f", "chain", "label", "name", "area")).alias("value"))


def rsa_rows(sasa: DataFrame, reference: bool = True) -> DataFrame:
    """Absolute and relative areas of five parts: a row for each residue, each chain in order of first atoms, and the total.

    ``kind`` is RES, CHAIN or TOTAL. A relative area is null (N/A in text) without a positive reference; residues are
    looked up under their usual names; ``reference`` is false for tables other than the built-in one.
    """
    sasa, keys = shared(sasa), keys_of(sasa)
    rec = A.residue_records(sasa)
    names = sasa.where("residue_id >= 0").groupBy(*keys, "residue_id").agg(*[F.min_by(c, "atom").alias(c) for c in ("chain", "residue_label", "residue_name")])
    out = rec.join(names, [*keys, "residue_id"]).withColumn("kind", F.lit("RES"))
    for i, part in enumerate(PARTS):
        ref = literal_map({k: v[i] for k, v in MAX_ASA_PARTS.items()})[canonical_residue_column(F.col("residue_name"))]
        out = out.withColumn(f"{part}_rel", F.when((ref > 0) & F.lit(reference), 100 * F.col(part) / ref))
    cols = [*keys, "kind", "ord", "chain", "residue_label", "residue_name", *PARTS, *(f"{p}_rel" for p in PARTS)]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("residue_label", "residue_name")]
    no_rel = [F.lit(None).cast("double").alias(f"{p}_rel") for p in PARTS]
    first = sasa.where("residue_id >= 0").groupBy(*keys, "chain").agg(F.min("atom").alias("ord"))
    chains = out.groupBy(*keys, "chain").agg(*[F.sum(p).alias(p) for p in PARTS]).join(first, [*keys, "chain"]).withColumn("kind", F.lit("CHAIN"))
    total = out.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in PARTS]).withColumn("kind", F.lit("TOTAL")).withColumn("ord", F.lit(0)).withColumn("chain", F.lit(None).cast("string"))
    rows = out.withColumn("ord", F.col("residue_id")).select(*cols)
    for more in (chains, total):
        rows = rows.union(more.select(*keys, "kind", "ord", "chain", *nothing, *PARTS, *no_rel))
    return rows


def rsa_lines(sasa: DataFrame) -> DataFrame:
    """:func:`rsa_rows` as text: residues, then chains, then the total."""
    rows = rsa_rows(sasa)
    rel = lambda p: F.when(F.col(f"{p}_rel").isNull(), "  N/A").otherwise(F.format_string("%5.1f", f"{p}_rel"))
    head = F.when(F.col("kind") == "RES", F.format_string("RES %3s %1s%-5s", "residue_name", "chain", "residue_label")).when(F.col("kind") == "CHAIN", F.format_string("CHAIN  %1s     ", "chain")).otherwise("TOTAL        ")
    areas = [F.when(F.col("kind") == "RES", F.concat(F.format_string("%8.2f ", p), rel(p))).otherwise(F.format_string("%8.2f      ", p)) for p in PARTS]
    rank = F.when(F.col("kind") == "RES", 0).when(F.col("kind") == "CHAIN", 1).otherwise(2) * F.lit(2**32) + F.col("ord")
    return rows.select(*keys_of(sasa), rank.cast("long").alias("ord"), F.concat(head, *areas).alias("value"))


def pdb_lines(sasa: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """ATOM records with the radius as occupancy and the area, clamped to 0..999.99, as B factor.

    ``source`` (structure, line, value) re-emits the lines of the file that atoms came from (their ``line``), with those
    two columns replaced and all other lines as they were.
    """
    b = F.least(F.greatest("sasa", F.lit(0.0)), F.lit(999.99))
    if source is not None:
        own = sasa.select(*(c for c in ("structure",) if c in sasa.columns), "line", F.format_string("%6.2f%6.2f", "radius", b).alias("_new"))
        by = [c for c in ("structure", "line") if c in own.columns]
        whole = F.concat(F.rpad(F.substring("value", 1, 54), 54, " "), "_new", F.expr("substring(value, 67)"))
        return source.join(own, by, "left").select(*by[:-1], F.col("line").alias("ord"), F.when(F.col("_new").isNull(), F.col("value")).otherwise(whole).alias("value"))
    code = F.regexp_extract("residue_label", "([A-Za-z])$", 1) if "residue_label" in sasa.columns else F.lit("")
    line = F.format_string("%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.when(F.col("is_het"), "HETATM").otherwise("ATOM"), (F.col("atom") % 99999 + 1).cast("int"), F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), "atom_name")).otherwise(F.col("atom_name")), "residue_name", "chain", "residue_number", code, "x", "y", "z", "radius", b, "element")
    return sasa.select(*keys_of(sasa), F.col("atom").alias("ord"), line.alias("value"))


def cif_lines(sasa: DataFrame, masks: Mapping[str, Column] | None = None) -> DataFrame:
    """Result loops to follow the text of an mmCIF file: totals, atoms, residues."""
    sasa, keys, big = shared(sasa), keys_of(sasa), 2**32
    out = None
    for at, tags, rows in (
        (0, ("_sasa_results.name", "_sasa_results.area"), _log_rows(sasa, masks).select(*keys, F.col("ord").cast("long").alias("ord"), F.format_string("'%s' %.2f", "name", "sasa").alias("value"))),
        (1, ("_atom_sasa.id", "_atom_sasa.radius", "_atom_sasa.area"), sasa.select(*keys, F.col("atom").cast("long").alias("ord"), F.format_string("%d %.3f %.3f", (F.col("atom") + 1).cast("int"), "radius", "sasa").alias("value"))),
        (2, ("_residue_sasa.id", "_residue_sasa.area"), A.residue_sums(sasa).select(*keys, F.col("residue_id").cast("long").alias("ord"), F.format_string("%d %.3f", F.col("residue_id").cast("int"), "residue_sasa").alias("value"))),
    ):
        head = sasa.select(*keys).distinct().select(*keys, F.posexplode(F.array(*map(F.lit, ("loop_", *tags)))).alias("ord", "value")).select(*keys, (F.col("ord") - 100).cast("long").alias("ord"), "value")
        both = head.union(rows).select(*keys, (F.col("ord") + at * big).alias("ord"), "value")
        out = both if out is None else out.union(both)
    return out


def document(sasa: DataFrame, masks: Mapping[str, Column] | None = None, config: RadiusConfig | None = None, probe: float = 1.4, n_points: int = 100, atoms: bool = True) -> DataFrame:
    """One nested row a frame: source, parameters, totals, classes, atoms, residues, selections.

    The rows of a frame meet in one document, as the format asks; ``atoms`` false leaves the atoms out.
    """
    sasa, keys = shared(sasa), keys_of(sasa)
    res = sasa.where("residue_id >= 0").groupBy(*keys, "residue_id").agg(F.min_by("residue_name", "atom").alias("name"), F.min_by("chain", "atom").alias("chain"), F.sum("sasa").alias("sasa"))
    out = res.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("residue_id", "name", "chain", "sasa"))).alias("residues"))
    sums = sasa.groupBy(*keys).agg(F.sum("sasa").alias("total_sasa"), F.struct(*[F.coalesce(F.sum(F.when(F.col("atom_class") == c, F.col("sasa"))), F.lit(0.0)).alias(c) for c in A.CLASSES]).alias("classes"), *([F.array_sort(F.collect_list(F.struct("atom", "radius", "sasa"))).alias("atoms")] if atoms else []))
    if masks:
        sums = sums.join(A.mask_sums(sasa, masks).select(*keys, F.struct(*masks).alias("selections")), list(keys))
    parameters = F.struct(F.lit("Shrake-Rupley").alias("algorithm"), F.lit(float(probe)).alias("probe_radius"), F.lit(n_points).alias("points"), F.lit(provenance(config)).alias("radii"))
    source = F.col("structure") if "structure" in keys else F.lit("")
    return sums.join(out, list(keys), "left").select(*keys, F.struct(source.alias("source"), *[F.col(k) for k in keys if k != "structure"], parameters.alias("parameters"), "total_sasa", "classes", *(["atoms"] if atoms else []), "residues", *(["selections"] if masks else [])).alias("result"))


def json_rows(sasa: DataFrame, **options) -> DataFrame:
    """One JSON document a frame (:func:`document`)."""
    return document(sasa, **options).select(*keys_of(sasa), F.to_json("result").alias("value"))


def xml_rows(sasa: DataFrame, **options) -> DataFrame:
    """The same as XML."""
    return document(sasa, **options).select(*keys_of(sasa), F.to_xml("result", {"rowTag": "result"}).alias("value"))


def trajectory_rows(sasa: DataFrame, shape: str = "total", masks: Mapping[str, Column] | None = None) -> DataFrame:
    """CSV rows of frames: ``total``, ``residue``, ``selection``, ``class`` or ``class_selection``."""
    keys = keys_of(sasa)
    if shape == "total":
        return A.totals(sasa)
    if shape == "residue":
        return A.residue_sums(sasa).join(A.totals(sasa), list(keys)).select(*keys, F.col("residue_id").alias("residue"), "total_sasa", "residue_sasa")
    wide, names = {"selection": lambda: (A.mask_sums(sasa, masks), list(masks)), "class": lambda: (A.class_sums(sasa), list(A.CLASSES)), "class_selection": lambda: (A.class_by_selection(sasa, masks), [f"{n}_{c}" for n in masks for c in A.CLASSES])}[shape]()
    each = []
    for n in names:
        label = [F.lit(n.rsplit("_", 1)[0]).alias("selection"), F.lit(n.rsplit("_", 1)[1]).alias("class")] if shape == "class_selection" else [F.lit(n).alias(shape)]
        each.append(F.struct(*label, F.col(n).alias(f"{'class' if shape == 'class' else 'selection'}_sasa")))
    return wide.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*")


def summary_row(sasa: DataFrame, shape: str = "total", masks: Mapping[str, Column] | None = None, config: RadiusConfig | None = None) -> DataFrame:
    """One row over all frames: frames, atoms, sums of ``total``, ``selection``, ``class`` or ``class_selection``, radii.

    Frames are counted before they are summed, so that no set of all atoms is held.
    """
    keys = keys_of(sasa)
    chosen = {"total": {}, "selection": masks or {}, "class": {c: F.col("atom_class") == c for c in A.CLASSES}, "class_selection": {f"{n}_{c}": m & (F.col("atom_class") == c) for n, m in (masks or {}).items() for c in A.CLASSES}}[shape]
    frames = sasa.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("sasa").alias("total"), *[F.coalesce(F.sum(F.when(m, F.col("sasa"))), F.lit(0.0)).alias(f"sum_{n}") for n, m in chosen.items()])
    return frames.agg(F.count("*").alias("frames"), F.max("n").alias("atoms"), F.sum("total").alias("total_sasa"), *[F.sum(f"sum_{n}").alias(n) for n in chosen]).withColumn("radii", F.lit(provenance(config)))


def point_lines(points: DataFrame) -> DataFrame:
    """x y z atom of every exposed point."""
    return points.select(*keys_of(points), "atom", "k", F.format_string("%.3f %.3f %.3f %d", "px", "py", "pz", F.col("atom").cast("int")).alias("value"))


def padded_points(points: DataFrame) -> DataFrame:
    """Points numbered within each frame (``nth``), every frame filled up to the largest count with its own first point.

    Trajectory formats need equal counts. Numbers come from counts of ranges of atoms, so no frame is sorted in one task.
    Points are written once to the scratch folder, since several steps read them.
    """
    points, keys = written(points), keys_of(points)
    from pyspark.sql import Window

    sized = points.groupBy(*keys, F.floor(F.col("atom") / A.RANGE).alias("range")).agg(F.count("*").alias("c"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.select(*keys, "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "range").orderBy("atom", "k")
    own = points.withColumn("range", F.floor(F.col("atom") / A.RANGE)).withColumn("i", F.row_number().over(inside)).join(base, [*keys, "range"]).select(*keys, (F.col("base") + F.col("i") - 1).alias("nth"), "px", "py", "pz")
    counts = points.groupBy(*keys).agg(F.count("*").alias("c"), F.min_by(F.struct("px", "py", "pz"), F.struct("atom", "k")).alias("p"))
    most = counts.agg(F.max("c").alias("most"))
    fill = counts.crossJoin(F.broadcast(most)).where("c < most").select(*keys, F.explode(F.sequence("c", F.col("most") - 1)).alias("nth"), "p.*")  # one row a frame is crossed with one number
    return own.unionByName(fill)


def xyz_lines(points: DataFrame) -> DataFrame:
    """Frames of an XYZ trajectory: count, comment, one line a point."""
    points = written(points)
    keys, rows = keys_of(points), padded_points(points)
    counts = points.groupBy(*keys).agg(F.count("*").alias("c"))
    head = counts.select(*keys).crossJoin(F.broadcast(counts.agg(F.max("c").alias("c")))).select(*keys, F.posexplode(F.array(F.col("c").cast("string"), F.concat(F.lit("frame "), F.col("frame").cast("string")))).alias("i", "value")).select(*keys, (F.col("i") - 2).cast("long").alias("ord"), "value")
    return head.union(rows.select(*keys, F.col("nth").cast("long").alias("ord"), F.format_string("X %.3f %.3f %.3f", "px", "py", "pz").alias("value")))


def log_rows(sasa: DataFrame, masks: Mapping[str, Column] | None = None) -> DataFrame:
    """(ord, name, sasa) of every frame: total, classes, chains by name, selections; areas rounded to 0.01.

    Where no class is unknown, apolar is the rounded total less the rounded polar area, so that the lines add up.
    """
    return _log_rows(shared(sasa), masks)


def _log_rows(sasa: DataFrame, masks: Mapping[str, Column] | None) -> DataFrame:
    keys, masks = keys_of(sasa), masks or {}
    total = lambda m: F.round(F.coalesce(F.sum(F.when(m, F.col("sasa"))), F.lit(0.0)), 2)
    sums = sasa.groupBy(*keys).agg(total(F.lit(True)).alias("total"), *[total(F.col("atom_class") == c).alias(c) for c in A.CLASSES], *[total(m).alias(f"sel_{n}") for n, m in masks.items()])
    sums = sums.withColumn("apolar", F.when(F.col("unknown") == 0, F.round(F.col("total") - F.col("polar"), 2)).otherwise(F.col("apolar")))
    names = [("total", "total"), *((c, c) for c in A.CLASSES)]
    each = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(c).alias("sasa")) for i, (n, c) in enumerate(names)]
    each += [F.struct(F.lit(2000 + i).alias("ord"), F.lit(f"selection {n}").alias("name"), F.col(f"sel_{n}").alias("sasa")) for i, n in enumerate(masks)]
    one = sums.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*")
    chains = A.chain_sums(sasa).select(*keys, (F.lit(1000) + F.ascii("chain")).alias("ord"), F.concat(F.lit("chain "), "chain").alias("name"), F.round("chain_sasa", 2).alias("sasa"))
    return one.union(chains)


def log_lines(sasa: DataFrame, masks: Mapping[str, Column] | None = None, config: RadiusConfig | None = None, probe: float = 1.4, n_points: int = 100) -> DataFrame:
    sasa, keys = shared(sasa), keys_of(sasa)
    head = [f"algorithm : Shrake-Rupley, {n_points} points", f"probe radius : {probe:.3f}", f"radii : {provenance(config)}"]
    top = sasa.select(*keys).distinct().select(*keys, F.posexplode(F.array(*map(F.lit, head))).alias("i", "value")).select(*keys, (F.col("i") - 10).alias("ord"), "value")
    return top.union(_log_rows(sasa, masks).select(*keys, "ord", F.format_string("%s : %10.2f", "name", "sasa").alias("value")))


SINKS = {"res": res_lines, "seq": seq_lines, "rsa": rsa_lines, "pdb": pdb_lines, "cif": cif_lines, "json": json_rows, "xml": xml_rows, "log": log_lines, "csv": trajectory_rows, "summary": summary_row}


def write(sasa: DataFrame, path: str, formats: tuple[str, ...] = ("log",)) -> None:
    """Each format in a folder of its own below ``path``: text where rows are lines, CSV otherwise; areas are computed once.

    Lines lie in order of frames, and within each frame in that of the report, over as many files as there are ranges of them.
    """
    sasa = shared(sasa)
    for name in formats:
        df = SINKS[name](sasa)
        if "value" in df.columns:
            by = [*keys_of(df), *(c for c in ("ord",) if c in df.columns)]
            df.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(f"{path}/{name}")
        else:
            df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
