"""Text files read in blocks by many tasks, with the line numbers of the whole file; CIF loops found across blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import segments
from ..scratch import written
from ..segments import running

NAME = r"([^/]+?)(?:\.[^./]*)?$"


def one_block(spark: SparkSession, path: str) -> bool:
    """Whether every file at ``path`` is too small to be cut into blocks."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().conf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    sizes = [x.getLen() for f in found or [] for x in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]
    return max(sizes, default=0) <= min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """structure (the file's name), line (from 0), value.

    A file is read by as many tasks as it has blocks (``spark.sql.files.maxPartitionBytes``). Each numbers the lines of
    its blocks, and one row a block says how many lines come before it; files that are one block each need none.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nth = None, 0
        for b in batches:
            out = []
            for key in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                now, nth = key, nth + 1 if key == now else 0
                out.append(nth)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["file", "block", "value", "nth"])

    rows = raw.mapInArrow(number, "file string, block long, value string, nth long")
    if one_block(spark, path):
        return rows.select(F.regexp_extract("file", NAME, 1).alias("structure"), F.col("nth").alias("line"), "value")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0").drop("n")
    rows = rows.join(counts, ["file", "block"], "left")
    return rows.select(F.regexp_extract("file", NAME, 1).alias("structure"), (F.col("nth") + F.coalesce("before", F.lit(0))).alias("line"), "value")


def lines_of(texts: DataFrame) -> DataFrame:
    """structure, line, value of whole texts (structure, value)."""
    return texts.select("structure", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long"))


# ---------------------------------------------------------------- CIF
TOKEN = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\#.*)|(\S+)""")
CONTROL = ("_", "data_", "save_", "loop_", "stop_", "global_")


def line_tokens(line: str) -> list[tuple[bool, str]]:
    """(quoted, text) of the tokens of a line outside text blocks."""
    out = []
    for m in TOKEN.finditer(line):
        if m[3] is None:
            quoted = m[4] is None
            out.append((quoted, (m[1] if m[1] is not None else m[2]) if quoted else m[4]))
    return out


def tokenized(lines: DataFrame) -> DataFrame:
    """structure, line, tokens (quoted, text), first: the number of the first token in the file, marks, held.

    What a line needs to know of those before it is whether they leave a text block open (each line that begins with ;
    opens or closes one, ``marks`` counts them) and how many tokens they have; both are running sums. A text block is the
    token of the line that closes it; ``held`` is what a line adds to it.
    """
    semi = F.col("value").startswith(";")
    rows = running(lines.select("structure", "line", "value"), ("structure",), "line", {"marks": ("sum", semi.cast("long"))})
    inside = (F.col("marks") - semi.cast("long")) % 2 == 1
    rows = rows.withColumn("kind", F.when(inside & semi, 2).when(semi, 1).when(inside, 3).otherwise(0))  # closes a block, opens one, is in one, plain

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("quoted", pa.bool_()), ("text", pa.string())]))
        for b in batches:
            found, held = [], []
            for v, k in zip(b.column("value").to_pylist(), b.column("kind").to_pylist(), strict=True):
                found.append(line_tokens(v) if k == 0 else [(True, ""), *line_tokens(v[1:])] if k == 2 else [])
                held.append(v[1:] if k == 1 else v if k == 3 else None)
            tokens = pa.array([[{"quoted": q, "text": t} for q, t in x] for x in found], of)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("structure", "line", "marks", "kind")), tokens, pa.array(held, pa.string())], names=["structure", "line", "marks", "kind", "tokens", "held"])

    rows = rows.select("structure", "line", "marks", F.col("kind").cast("int").alias("kind"), "value").mapInArrow(take, "structure string, line long, marks long, kind int, tokens array<struct<quoted: boolean, text: string>>, held string")
    rows = running(rows, ("structure",), "line", {"through": ("sum", F.size("tokens").cast("long"))})
    return rows.select("structure", "line", "tokens", (F.col("through") - F.size("tokens")).alias("first"), "marks", "kind", "held")


def loop_rows(lines: DataFrame, category: str) -> DataFrame:
    """structure, row (from 0), heads, values: the rows of the first loop of a category in each file.

    Rows may span lines, and lines blocks. A loop that ends within a row and a text block that does not end are errors.
    Tokens and rows are written once to the shared scratch folder, since several steps read them.
    """
    tokens = written(tokenized(lines))
    word = lambda t: F.when(t["quoted"], "").otherwise(F.lower(t["text"]))
    control = lambda t: F.exists(F.array(*map(F.lit, CONTROL)), lambda c: word(t).startswith(c))

    # where the loop begins and ends: control words (tags, not values) in their order, one file after another
    numbered = F.transform("tokens", lambda t, k: F.struct((F.col("first") + k).alias("at"), word(t).alias("word"), t["text"].alias("text"), control(t).alias("control")))
    marks = tokens.select("structure", "line", F.explode(F.filter(numbered, lambda x: x["control"])).alias("x")).select("structure", "line", "x.at", "x.word", "x.text")
    by = Window.partitionBy("structure").orderBy("at")
    tag = F.col("word").startswith(category + ".")
    opens = tag & (F.lag("word").over(by) == "loop_") & (F.lag("at").over(by) == F.col("at") - 1)
    marks = marks.withColumn("opens", opens).withColumn("begin", F.min(F.when(F.col("opens"), F.col("at"))).over(Window.partitionBy("structure"))).where("at >= begin")
    nth = F.row_number().over(by) - 1
    marks = marks.withColumn("head", tag & (F.col("at") - F.col("begin") == nth)).withColumn("run", F.min(F.when(~F.col("head"), F.col("at"))).over(Window.partitionBy("structure")))
    marks = marks.withColumn("head", F.col("head") & (F.col("at") < F.coalesce("run", F.col("at") + 1)))
    name = F.struct("at", F.expr(f"substring(text, {len(category) + 2})").alias("tag"))
    info = marks.groupBy("structure").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("head"), name))), lambda x: x["tag"]).alias("heads"), (F.max(F.when(F.col("head"), F.col("at"))) + 1).alias("start"), F.max(F.when(F.col("head"), F.col("line"))).alias("from"), F.min(F.when(~F.col("head"), F.struct("at", "line"))).alias("end"))
    whole = tokens.groupBy("structure").agg(F.max(F.col("first") + F.size("tokens")).alias("total"), F.max("marks").alias("marks"), F.max("line").alias("last"))
    info = whole.join(info, "structure", "left")
    stop = F.coalesce("end.at", "total")
    broken = F.when(F.col("marks") % 2 == 1, F.raise_error(F.lit("a text block does not end")).cast("long"))
    over = (stop - F.col("start")) % F.size("heads")
    cut = F.when(over != 0, F.raise_error(F.concat(F.lit(category + ": "), (stop - F.col("start")).cast("string"), F.lit(" values for "), F.size("heads").cast("string"), F.lit(" columns"))).cast("long"))
    info = info.withColumn("stop", F.coalesce(broken, cut, stop)).where("stop >= 0 and heads is not null")
    info = info.select("structure", "heads", "start", "stop", "from", F.coalesce("end.line", "last").alias("to"))

    # a loop's facts go to every segment of lines that it touches; its lines give cells of rows
    info = info.withColumn("seg", F.explode(F.sequence(F.floor(F.col("from") / segments.SEGMENT), F.floor(F.col("to") / segments.SEGMENT))))
    mine = tokens.withColumn("seg", F.floor(F.col("line") / segments.SEGMENT)).join(info, ["structure", "seg"]).where("line between from and to")
    width = F.size("heads")
    cell = lambda at, v: F.struct((at - F.col("start")).alias("at"), F.col("line").alias("line"), v.alias("v"))
    plain = F.filter(F.transform("tokens", lambda t, k: F.when(~((F.col("kind") == 2) & (k == 0)), cell(F.col("first") + k, t["text"]))), lambda x: x.isNotNull())
    cells = F.when(F.col("held").isNotNull(), F.array(cell(F.col("first"), F.col("held")))).otherwise(plain)
    cells = F.filter(cells, lambda x: (x["at"] >= 0) & (x["at"] < F.col("stop") - F.col("start")))
    pieces = mine.select("structure", "heads", cells.alias("cells")).where("size(cells) > 0")
    row = lambda x: F.floor(x["at"] / width)
    low, high = row(F.element_at("cells", 1)), row(F.element_at("cells", -1))
    pieces = pieces.withColumn("row", F.explode(F.sequence(low, high))).withColumn("cells", F.when(low == high, F.col("cells")).otherwise(F.filter("cells", lambda x: row(x) == F.col("row"))))
    rows = pieces.groupBy("structure", "row").agg(F.first("heads").alias("heads"), F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    same = lambda i: F.filter("cells", lambda x: x["at"] == F.col("row") * width + i)
    values = F.when(F.size("cells") == width, F.transform("cells", lambda x: x["v"])).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.transform(same(i), lambda x: x["v"]), "\n")))
    return written(rows.select("structure", F.col("row").cast("long").alias("row"), "heads", values.alias("values")))


def cif_tokens(text: str) -> Iterator[tuple[bool, str]]:
    """(quoted, text) of every token; text blocks between lines that begin with ; are quoted tokens."""
    block: list[str] | None = None
    for line in text.splitlines():
        if line.startswith(";"):
            if block is None:
                block = [line[1:]]
            else:
                yield True, "\n".join(block)
                block = None
                line = line[1:]
            if block is not None:
                continue
        elif block is not None:
            block.append(line)
            continue
        yield from line_tokens(line)
    if block is not None:
        raise ValueError("a text block does not end")


def atom_site(text: str) -> pd.DataFrame:
    """The ``_atom_site`` loop of one text in one piece, read token by token; :func:`loop_rows` gives the same rows from blocks."""
    heads: list[str] = []
    values: list[str] = []
    state = ""
    for quoted, t in cif_tokens(text):
        word = "" if quoted else t.lower()
        if word == "loop_":
            if heads:
                break
            state = "tags"
        elif state == "tags" and word.startswith("_atom_site."):
            heads.append(t[11:])
        elif state == "tags" and heads and not word.startswith("_"):
            state = "rows"
            values.append(t)
        elif state == "rows" and (word.startswith(("_", "data_", "save_")) or word == "stop_"):
            break
        elif state == "rows":
            values.append(t)
        elif state == "tags" and not heads:
            state = ""
    if heads and len(values) % len(heads):
        raise ValueError(f"_atom_site: {len(values)} values for {len(heads)} columns")
    n = len(heads)
    return pd.DataFrame({h: values[i::n] for i, h in enumerate(heads)}, dtype=str)
