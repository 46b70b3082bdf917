"""Atom-selection language: text to a boolean Column.

``name, expression`` or ``expression``; selectors name, symbol, resn, resi, chain, segid, protein; and/or/not, brackets;
item lists a+b+c; ranges a-b, -b, a- for resi, A-C for chain. Matching ignores case. Items that cannot be valid are
dropped with a warning; a selector without valid items is false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import PROTEIN_NAMES

MOST = 31  # selections of one calculation
WORDS = {"name": "name", "atom": "name", "symbol": "symbol", "element": "symbol", "elem": "symbol", "resn": "resn", "resname": "resn", "residue": "resn", "resi": "resi", "resid": "resi", "resnum": "resi", "chain": "chain", "segid": "segid", "segname": "segid", "segment": "segid", "protein": "protein", "and": "and", "&": "and", "or": "or", "|": "or", "not": "not", "!": "not"}


@dataclass
class Selection:
    name: str
    column: Column
    warnings: list[str] = field(default_factory=list)
    items: list[tuple[str, Column]] = field(default_factory=list)  # single values, for warnings of those that match nothing


def split_command(text: str) -> tuple[str, str]:
    """(name, expression): split at the first comma; without a name one is made from the expression."""
    head, comma, tail = text.partition(",")
    name, expr = (head.strip(), tail.strip()) if comma else ("", text.strip())
    if not name:
        name = re.sub(r"[^0-9A-Za-z]+", "_", expr).strip("_") or "selection"
    return name[:50], expr


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, text): kind is one of ( ) + - or w for words; quoted and escaped characters are plain."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c.isspace() or c == "=":
            i += 1
        elif c in "()+-&|!":
            out.append((c if c in "()+-" else "w", c))
            i += 1
        else:
            word, plain = "", False
            while i < len(text) and not (text[i].isspace() or text[i] in "=()+-&|!"):
                c = text[i]
                if c == "\\" and i + 1 < len(text):
                    word, i, plain = word + text[i + 1], i + 2, True
                elif c in "'\"" and (end := text.find(c, i + 1)) > 0 and not word:
                    word, i, plain = word + text[i + 1 : end], end + 1, True
                else:
                    word, i = word + c, i + 1
            out.append(("q" if plain else "w", word))
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], bounds: tuple[int, int] | None, warnings: list[str]) -> None:
        self.t, self.i, self.bounds, self.warnings = tokens, 0, bounds, warnings
        self.single: list[tuple[str, Column]] = []

    def peek(self) -> tuple[str, str]:
        return self.t[self.i] if self.i < len(self.t) else ("", "")

    def word(self) -> str | None:
        kind, text = self.peek()
        return WORDS.get(text.lower()) if kind == "w" else None

    def either(self) -> Column:
        out = self.both()
        while self.word() == "or":
            self.i += 1
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.unary()
        while self.word() == "and":
            self.i += 1
            out = out & self.unary()
        return out

    def unary(self) -> Column:
        if self.word() == "not":
            self.i += 1
            return ~self.unary()
        if self.peek()[0] == "(":
            self.i += 1
            out = self.either()
            if self.peek()[0] != ")":
                raise ValueError("missing )")
            self.i += 1
            return out
        what = self.word()
        if what is None or what in ("and", "or"):
            raise ValueError(f"unknown selector {self.peek()[1]!r}")
        self.i += 1
        if what == "protein":
            return F.upper(F.trim("residue_name")).isin(PROTEIN_NAMES)
        found = [c for c in self.items(what) if c is not None]
        out = F.lit(False)
        for c in found:
            out = out | c
        return out

    def items(self, what: str) -> list[Column | None]:
        out = [self.item(what)]
        while self.peek()[0] == "+":
            self.i += 1
            out.append(self.item(what))
        return out

    def value(self) -> str | None:
        kind, text = self.peek()
        if kind in ("w", "q") and not (kind == "w" and text.lower() in WORDS):
            self.i += 1
            return text
        return None

    def item(self, what: str) -> Column | None:
        ranged = what in ("resi", "chain")
        if ranged and self.peek()[0] == "-":
            self.i += 1
            return self.span(what, None, self.value())
        low = self.value()
        if low is None:
            raise ValueError("a value is missing")
        if self.peek()[0] == "-":
            if not ranged:
                raise ValueError(f"{what} takes no ranges")
            self.i += 1
            return self.span(what, low, self.value())
        return self.one(what, low)

    def warn(self, text: str) -> None:
        self.warnings.append(f"ignored: {text}")

    def one(self, what: str, v: str) -> Column | None:
        u = v.upper()
        ok = {"name": len(v) <= 4, "symbol": len(v) <= 2 and v.isalpha(), "resn": len(v) <= 3, "resi": re.fullmatch(r"-?\d{1,5}|-?\d{1,4}[A-Za-z]", v) is not None, "chain": len(v) <= 1, "segid": True}[what]
        if not ok:
            self.warn(f"{what} {v}")
            return None
        col = {"name": "atom_name", "symbol": "element", "resn": "residue_name", "resi": "residue_label", "chain": "chain", "segid": "segment"}[what]
        same = F.upper(F.trim(F.col(col))) == u
        if what == "resi" and re.fullmatch(r"-?\d+", v):
            same = same | (F.col("residue_number") == int(v))
        self.single.append((f"{what} {v}", same))
        return same

    def span(self, what: str, low: str | None, high: str | None) -> Column | None:
        if what == "chain":
            if low is None or high is None:
                self.warn("open chain range")
                return None
            if low.isdigit() and high.isdigit():
                return F.col("chain").cast("int").between(int(low), int(high))
            if len(low) == len(high) == 1:
                return F.upper("chain").between(low.upper(), high.upper())
            self.warn(f"chain {low}-{high}")
            return None
        if any(x is not None and not re.fullmatch(r"-?\d+", x) for x in (low, high)):
            self.warn(f"resi {low}-{high}")
            return None
        if self.bounds is None and (low is None or high is None):
            raise ValueError("an open range needs the atoms or their bounds")
        first, last = self.bounds or (None, None)
        a, b = int(low) if low is not None else first, int(high) if high is not None else last
        n, out = F.col("residue_number"), F.lit(True)
        if a is not None:
            out = out & (n >= a)
        if b is not None:
            out = out & (n <= b)
        return out


def needs_bounds(expr: str) -> bool:
    t = tokenize(expr)
    return any(k == "-" for k, _ in t)


def bounds_of(atoms: DataFrame) -> tuple[int, int] | None:
    """Residue numbers of the first and last atom, which open ranges end at."""
    r = atoms.agg(F.min_by("residue_number", "atom").alias("a"), F.max_by("residue_number", "atom").alias("b")).first()
    return None if r is None or r.a is None else (r.a, r.b)


def select(command: str, atoms: DataFrame | None = None, bounds: tuple[int, int] | None = None) -> Selection:
    """Parse one command; open ranges are closed by ``bounds``, or measured on ``atoms``."""
    name, expr = split_command(command)
    tokens = tokenize(expr)
    # a backslash before - makes a negative number: \-10
    if not tokens:
        raise ValueError("empty selection")
    if bounds is None and atoms is not None and needs_bounds(expr):
        bounds = bounds_of(atoms)
    warnings: list[str] = []
    p = _Parser(tokens, bounds, warnings)
    column = p.either()
    if p.i != len(tokens):
        raise ValueError(f"unexpected {tokens[p.i][1]!r}")
    return Selection(name, F.coalesce(column, F.lit(False)), warnings, p.single)


def select_all(commands: list[str], atoms: DataFrame | None = None) -> list[Selection]:
    if len(commands) > MOST:
        raise ValueError(f"at most {MOST} selections")
    bounds = bounds_of(atoms) if atoms is not None and any(needs_bounds(c) for c in commands) else None
    return [select(c, atoms, bounds) for c in commands]


def unmatched_items(atoms: DataFrame, commands: list[str]) -> DataFrame:
    """(selection, item) of every valid single value that matches no atom; one pass over the atoms."""
    found = [(s.name, text, c) for s in select_all(commands, atoms) for text, c in s.items]
    if not found:
        return atoms.sparkSession.createDataFrame([], "selection string, item string")
    hits = atoms.agg(*[F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(f"i{k}") for k, (_, _, c) in enumerate(found)])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("selection"), F.lit(text).alias("item"), F.col(f"i{k}").alias("hit")) for k, (name, text, _) in enumerate(found)]))
    return hits.select(rows.alias("r")).select("r.*").where("hit = 0").select("selection", "item").distinct()


def with_masks(metadata: DataFrame, commands: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(metadata with a boolean column ``sel_<name>`` for each command, names, warnings).

    Columns that the metadata lacks (labels, segments, elements, chains) count as empty.
    """
    for c in ("atom_name", "residue_name", "residue_label", "chain", "segment", "element"):
        if c not in metadata.columns:
            metadata = metadata.withColumn(c, F.col("residue_number").cast("string") if c == "residue_label" and "residue_number" in metadata.columns else F.lit(""))
    found = select_all(commands, metadata)
    return metadata.withColumns({f"sel_{s.name}": s.column for s in found}), [s.name for s in found], [w for s in found for w in s.warnings]


def compacted(atoms: DataFrame, commands: list[str], universe: Column) -> DataFrame:
    """(selection, atoms, kept): how many atoms of each selection, made on all atoms, are in the universe of a filter."""
    found = select_all(commands, atoms)
    one = atoms.agg(*[F.count(F.when(s.column, 1)).alias(f"a{i}") for i, s in enumerate(found)], *[F.count(F.when(s.column & universe, 1)).alias(f"k{i}") for i, s in enumerate(found)])
    rows = F.explode(F.array(*[F.struct(F.lit(s.name).alias("selection"), F.col(f"a{i}").alias("atoms"), F.col(f"k{i}").alias("kept")) for i, s in enumerate(found)]))
    return one.select(rows.alias("r")).select("r.*")


def unmatched(atoms: DataFrame, commands: list[str]) -> list[str]:
    """Selections that match no atom (one pass over the atoms)."""
    found = select_all(commands, atoms)
    row = atoms.agg(*[F.max(s.column.cast("int")).alias(f"s{i}") for i, s in enumerate(found)]).first()
    return [s.name for i, s in enumerate(found) if not row[f"s{i}"]]
