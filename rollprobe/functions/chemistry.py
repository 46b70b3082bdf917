"""Elements, radii, aliases and classes: plain tables for planning, and the columns built from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bondi-type element radii.
ELEMENT_RADII = {"H": 1.10, "D": 1.10, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "CL": 1.75, "BR": 1.85, "I": 1.98, "NA": 2.27, "MG": 1.73, "K": 2.75, "CA": 2.31, "FE": 1.80, "ZN": 1.39}
# Residue names that count as another.
RESIDUE_NAME_ALIASES = {"HID": "HIS", "HIE": "HIS", "HIP": "HIS", "HSD": "HIS", "HSE": "HIS", "HSP": "HIS", "CYX": "CYS", "CYM": "CYS", "ASH": "ASP", "GLH": "GLU", "LYN": "LYS", "ARN": "ARG", "ADE": "A", "CYT": "C", "GUA": "G", "URA": "U", "THY": "DT"}
# Standard residues, those the keyword ``protein`` takes besides, backbone atoms.
RENAMED_IN = [*"SEC PYL".split()]  # residues besides the standard ones whose end atoms are renamed
AMINO_ACIDS = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
PROTEIN_NAMES = [*AMINO_ACIDS, *"SEC PYL ASX GLX HSD HSE HSP HID HIE HIP".split()]
BACKBONE = ["N", "CA", "C", "O", "OXT", "P", "OP1", "OP2", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "C1'"]
# Atoms of caps written inside an amino acid, of chain ends, of phosphates.
CAP_ATOMS = {"CAY": ("ACE", "CH3"), "CAT": ("ACE", "CH3"), "CY": ("ACE", "C"), "OY": ("ACE", "O"), "NT": ("NH2", "N")}
END_ATOMS = {"OT1": "O", "OC1": "O", "OT2": "OXT", "OC2": "OXT"}
PHOSPHATE_ATOMS = {"O1P": "OP1", "O2P": "OP2"}
# Tsai et al. 1999 united-atom types (radius, class).
PROTOR_TYPES = {"C3H0": (1.61, "apolar"), "C3H1": (1.76, "apolar"), "C4H1": (1.88, "apolar"), "C4H2": (1.88, "apolar"), "C4H3": (1.88, "apolar"), "N3H0": (1.64, "polar"), "N3H1": (1.64, "polar"), "N3H2": (1.64, "polar"), "N4H3": (1.64, "polar"), "O1H0": (1.42, "polar"), "O2H1": (1.46, "polar"), "S2H0": (1.77, "polar"), "S2H1": (1.77, "polar")}
# Further types of nucleic acids, water, selenium residues, ambiguous residues.
EXTRA_TYPES = {"P4H0": (1.80, "polar"), "O2H0": (1.46, "polar"), "O2H2": (1.46, "polar"), "SE2H1": (1.90, "polar"), "SE2H0": (1.90, "polar"), "X1H0": (1.50, "polar"), "N2H0": (1.64, "polar"), "N2H2": (1.64, "polar")}
# Side-chain atoms of each type, by residue (Tsai et al. 1999).
PROTOR_SIDE = {
    "ALA": "CB:C4H3", "ARG": "CB:C4H2 CG:C4H2 CD:C4H2 NE:N3H1 CZ:C3H0 NH1:N3H2 NH2:N3H2", "ASN": "CB:C4H2 CG:C3H0 OD1:O1H0 ND2:N3H2",
    "ASP": "CB:C4H2 CG:C3H0 OD1:O1H0 OD2:O2H1", "CYS": "CB:C4H2 SG:S2H1", "GLN": "CB:C4H2 CG:C4H2 CD:C3H0 OE1:O1H0 NE2:N3H2",
    "GLU": "CB:C4H2 CG:C4H2 CD:C3H0 OE1:O1H0 OE2:O2H1", "GLY": "", "HIS": "CB:C4H2 CG:C3H0 ND1:N3H1 CD2:C3H1 CE1:C3H1 NE2:N3H1",
    "ILE": "CB:C4H1 CG1:C4H2 CG2:C4H3 CD1:C4H3", "LEU": "CB:C4H2 CG:C4H1 CD1:C4H3 CD2:C4H3", "LYS": "CB:C4H2 CG:C4H2 CD:C4H2 CE:C4H2 NZ:N4H3",
    "MET": "CB:C4H2 CG:C4H2 SD:S2H0 CE:C4H3", "PHE": "CB:C4H2 CG:C3H0 CD1:C3H1 CD2:C3H1 CE1:C3H1 CE2:C3H1 CZ:C3H1", "PRO": "CB:C4H2 CG:C4H2 CD:C4H2",
    "SER": "CB:C4H2 OG:O2H1", "THR": "CB:C4H1 OG1:O2H1 CG2:C4H3", "TRP": "CB:C4H2 CG:C3H0 CD1:C3H1 CD2:C3H0 NE1:N3H1 CE2:C3H0 CE3:C3H1 CZ2:C3H1 CZ3:C3H1 CH2:C3H1",
    "TYR": "CB:C4H2 CG:C3H0 CD1:C3H1 CD2:C3H1 CE1:C3H1 CE2:C3H1 CZ:C3H0 OH:O2H1", "VAL": "CB:C4H1 CG1:C4H3 CG2:C4H3",
}
# Atoms besides N, CA, C, O, OXT of rarer residues; caps and water whole.
RARE_SIDE = {"ASX": "CB:C4H2 CG:C3H0 XD1:X1H0 XD2:X1H0", "GLX": "CB:C4H2 CG:C4H2 CD:C3H0 XE1:X1H0 XE2:X1H0", "MSE": "CB:C4H2 CG:C4H2 SE:SE2H0 CE:C4H3", "SEC": "CB:C4H2 SE:SE2H1", "PYL": "CB:C4H2 CG:C4H2 CD:C4H2 CE:C4H2 NZ:N3H1 C2:C3H0 O2:O1H0 CA2:C4H1 N2:N2H0 CE2:C3H1 CD2:C4H2 CG2:C4H1 CB2:C4H3"}
WHOLE = {"ACE": "C:C3H1 O:O1H0 CH3:C4H3", "NH2": "N:N2H2", "HOH": "O:O2H2"}
# Nucleotides are a phosphate and sugar, what the sugar has at C2', and a base.
PHOSPHATE_SUGAR = "OP3:O2H1 P:P4H0 OP1:O1H0 OP2:O2H1 O5':O2H0 C5':C4H2 C4':C4H1 O4':O2H0 C3':C4H1 O3':O2H1 C1':C4H1"
RIBOSE, DEOXYRIBOSE = "C2':C4H1 O2':O2H1", "C2':C4H2"
BASES = {
    "A": "N9:N3H0 C8:C3H1 N7:N2H0 C5:C3H0 C6:C3H0 N6:N3H2 N1:N2H0 C2:C3H1 N3:N2H0 C4:C3H0",
    "G": "N9:N3H0 C8:C3H1 N7:N2H0 C5:C3H0 C6:C3H0 O6:O1H0 N1:N3H1 C2:C3H0 N2:N3H2 N3:N2H0 C4:C3H0",
    "I": "N9:N3H0 C8:C3H1 N7:N2H0 C5:C3H0 C6:C3H0 O6:O1H0 N1:N3H1 C2:C3H1 N3:N2H0 C4:C3H0",
    "C": "N1:N3H0 C2:C3H0 O2:O1H0 N3:N2H0 C4:C3H0 N4:N3H2 C5:C3H1 C6:C3H1",
    "U": "N1:N3H0 C2:C3H0 O2:O1H0 N3:N3H1 C4:C3H0 O4:O1H0 C5:C3H1 C6:C3H1",
    "T": "N1:N3H0 C2:C3H0 O2:O1H0 N3:N3H1 C4:C3H0 O4:O1H0 C5:C3H0 C7:C4H3 C6:C3H1",
}
# Sugars by kind; a ring oxygen O5, hydroxyls at the other carbons.
HEXOSE = "C1:C4H1 C2:C4H1 C3:C4H1 C4:C4H1 C5:C4H1 C6:C4H2 O1:O2H1 O2:O2H1 O3:O2H1 O4:O2H1 O6:O2H1 O5:O2H0"
FUCOSE = "C1:C4H1 C2:C4H1 C3:C4H1 C4:C4H1 C5:C4H1 C6:C4H3 O1:O2H1 O2:O2H1 O3:O2H1 O4:O2H1 O5:O2H0"
XYLOSE = "C1:C4H1 C2:C4H1 C3:C4H1 C4:C4H1 C5:C4H2 O1:O2H1 O2:O2H1 O3:O2H1 O4:O2H1 O5:O2H0"
ACETYLGLUCOSAMINE = "C1:C4H1 C2:C4H1 C3:C4H1 C4:C4H1 C5:C4H1 C6:C4H2 C7:C3H0 C8:C4H3 N2:N3H1 O1:O2H1 O3:O2H1 O4:O2H1 O6:O2H1 O5:O2H0 O7:O1H0"
GLYCANS = dict.fromkeys("BGC BMA GAL GLA GLC MAN".split(), HEXOSE) | dict.fromkeys("FUC FUL".split(), FUCOSE) | dict.fromkeys("XYP XYS".split(), XYLOSE) | dict.fromkeys("NAG NDG".split(), ACETYLGLUCOSAMINE)
# Typical masses by which an element is recognised.
MASSES = {"C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "NA": 22.990, "MG": 24.305, "P": 30.974, "S": 32.06, "CL": 35.45, "K": 39.098, "CA": 40.078, "MN": 54.938, "FE": 55.845, "CO": 58.933, "NI": 58.693, "CU": 63.546, "ZN": 65.38, "SE": 78.971, "BR": 79.904, "I": 126.904}
TWO_LETTERS = ["CL", "BR", "NA", "MG", "FE", "ZN", "CA"]


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(sorted(d.items()))])


def canonical_residue_name(name: str) -> str:
    name = name.strip().upper()
    return RESIDUE_NAME_ALIASES.get(name, name)


def canonical_atom_name(residue: str, atom: str) -> tuple[str, str]:
    """(residue, atom) under which a renamed atom is looked up."""
    residue, atom = residue.strip().upper(), atom.strip().upper()
    base = RESIDUE_NAME_ALIASES.get(residue, residue)
    if base == "ILE" and atom == "CD":
        return base, "CD1"
    if base in AMINO_ACIDS or base in RENAMED_IN:
        return CAP_ATOMS.get(atom) or (base, END_ATOMS.get(atom, atom))
    if base == "DT" and atom == "C5M":
        return base, "C7"
    return base, PHOSPHATE_ATOMS.get(atom, atom)


@dataclass
class RadiusConfig:
    """Radius types and the types of (residue, atom)."""

    name: str
    types: dict[str, tuple[float, str]] = field(default_factory=dict)
    atoms: dict[str, str] = field(default_factory=dict)  # "RES:ATOM" -> type

    def radii(self) -> dict[str, float]:
        return {k: self.types[t][0] for k, t in self.atoms.items() if t in self.types}

    def classes(self) -> dict[str, str]:
        return {k: self.types[t][1] for k, t in self.atoms.items() if t in self.types}

    def radius(self, residue: str, atom: str, default: float | None = None) -> float:
        table = self.radii()
        for key in (f"{residue.upper()}:{atom.upper()}", f"{canonical_residue_name(residue)}:{atom.upper()}", ":".join(canonical_atom_name(residue, atom))):
            if key in table:
                return table[key]
        if default is None:
            raise KeyError(f"no radius for {residue} {atom}")
        return default


def parse_radius_config(text: str, first_wins: bool = False) -> RadiusConfig:
    """Sections ``types:`` (TYPE radius [class]) and ``atoms:`` (RES ATOM TYPE); # starts a comment.

    Of repeated entries the last holds, as for structures, or with ``first_wins`` the first, as for trajectories.
    """
    out, section = RadiusConfig("config"), None

    def put(table: dict, key: str, value) -> None:
        if not (first_wins and key in table):
            table[key] = value

    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        head = line.split()[0].lower()
        if head.endswith(":"):
            section = head[:-1]
            if section == "name":
                out.name = line.split(":", 1)[1].strip()
            continue
        words = line.upper().split()
        if section == "types":
            put(out.types, words[0], (float(words[1]), words[2].lower() if len(words) > 2 else "unknown"))
        elif section == "atoms":
            put(out.atoms, f"{words[0]}:{words[1]}", words[2])
    return out


def protor(glycans: bool = False) -> RadiusConfig:
    """United-atom radii of amino acids, caps, water and nucleotides, with ``glycans`` also of common sugars."""
    out = RadiusConfig("ProtOr", PROTOR_TYPES | EXTRA_TYPES)
    put = lambda residue, text: out.atoms.update({f"{residue}:{a}": k for a, k in (x.split(":") for x in text.split())})
    for residue, side in (PROTOR_SIDE | RARE_SIDE).items():
        put(residue, f"N:{'N3H1' if residue == 'PRO' else 'N3H2'} CA:{'C4H2' if residue == 'GLY' else 'C4H1'} C:C3H0 O:O1H0 OXT:O2H1 {side}")
    for base, text in BASES.items():
        put(f"D{base}", f"{PHOSPHATE_SUGAR} {DEOXYRIBOSE} {text}")
        put(base, f"{PHOSPHATE_SUGAR} {DEOXYRIBOSE if base == 'T' else RIBOSE} {text}")
    for residue, text in (WHOLE | (GLYCANS if glycans else {})).items():
        put(residue, text)
    return out


def element_from_mass(mass: float, name: str = "") -> str | None:
    """Element of a topology mass; hydrogens merged into it (heavier by 2.016 each when repartitioned away) are allowed for."""
    if mass < 0.9:
        return None
    if mass < 4.5:
        return "H"
    fits = [[e for e, w in MASSES.items() if abs(mass - (w - 2.016 * k)) < 0.1] for k in range(4)]
    letters = "".join(c for c in name.strip().upper() if c.isalpha())
    named = letters[:2] if letters[:2] in TWO_LETTERS else letters[:1]
    agreeing = [e for found in fits for e in found if e in (named, named[:1])]
    return next(iter(agreeing + fits[0] + [e for found in fits[1:] for e in found]), None)


def provenance(config: RadiusConfig | None, path: str | None = None) -> str:
    """Where radii come from, as reports say it."""
    return "element (Bondi)" if config is None else f"{config.name} ({path})" if path else f"{config.name} (built-in)"


# ---------------------------------------------------------------- columns
def mass_element_column(mass: Column, name: Column) -> Column:
    """:func:`element_from_mass` as an expression over literal arrays of candidates."""
    letters = F.upper(F.regexp_replace(name, r"[^A-Za-z]", ""))
    two = F.substring(letters, 1, 2)
    named = F.when(two.isin(TWO_LETTERS), two).otherwise(F.substring(letters, 1, 1))
    table = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(w - 2.016 * k).alias("w")) for k in range(4) for e, w in MASSES.items()])
    fits = F.filter(table, lambda t: F.abs(mass - t["w"]) < 0.1)
    agreeing = F.filter(fits, lambda t: (t["e"] == named) | (t["e"] == F.substring(named, 1, 1)))
    return F.when(mass < 0.9, F.lit(None).cast("string")).when(mass < 4.5, "H").otherwise(F.coalesce(F.get(agreeing, F.lit(0))["e"], F.get(fits, F.lit(0))["e"]))


def canonical_residue_column(residue: Column) -> Column:
    name = F.upper(F.trim(residue))
    return F.coalesce(literal_map(RESIDUE_NAME_ALIASES)[name], name)


def element_column(element: Column, atom_name: Column) -> Column:
    """The element column where filled, else by the name: known two-letter elements, else the first letter."""
    letters = F.upper(F.regexp_extract(atom_name, r"([A-Za-z]+)", 1))
    two = F.substring(letters, 1, 2)
    guess = F.when(two.isin(TWO_LETTERS), two).otherwise(F.substring(letters, 1, 1))
    return F.when(F.length(F.trim(element)) > 0, F.upper(F.trim(element))).otherwise(guess)


def radius_column(config: RadiusConfig | None, residue: Column, atom: Column, element: Column, any_residue: bool = True, unknown: float | None = None) -> Column:
    """Lookup cascade: residue and atom, canonical residue, any residue (optional), renamed atom, element."""
    steps: list[Column] = []
    res, name = F.upper(F.trim(residue)), F.upper(F.trim(atom))
    if config is not None and config.atoms:
        table = literal_map(config.radii())
        base = F.coalesce(literal_map(RESIDUE_NAME_ALIASES)[res], res)
        steps += [table[F.concat_ws(":", res, name)], table[F.concat_ws(":", base, name)]]
        if any_residue:
            steps.append(table[F.concat(F.lit("ANY:"), name)])
        renamed = {f"{r}:{a}": ":".join(canonical_atom_name(r, a)) for r in [*AMINO_ACIDS, *RENAMED_IN, "A", "C", "G", "U", "DT"] for a in ("CD", "OT1", "OC1", "OT2", "OC2", "CAY", "CAT", "CY", "OY", "NT", "O1P", "O2P", "C5M") if canonical_atom_name(r, a) != (r, a)}
        steps.append(table[literal_map(renamed)[F.concat_ws(":", base, name)]])
    steps.append(literal_map(ELEMENT_RADII)[F.upper(F.trim(element))])
    if unknown is not None:
        steps.append(F.lit(float(unknown)))
    return F.coalesce(*steps)


def class_column(config: RadiusConfig | None, residue: Column, atom: Column, element: Column) -> Column:
    """polar, apolar or unknown: by the table where one is loaded, by the element only where none is."""
    if config is None:
        e = F.upper(F.trim(element))
        return F.when(e == "C", "apolar").when(e.isin("H", "D") | e.isNull() | (e == ""), "unknown").otherwise("polar")
    res, name = F.upper(F.trim(residue)), F.upper(F.trim(atom))
    base = F.coalesce(literal_map(RESIDUE_NAME_ALIASES)[res], res)
    table = literal_map(config.classes())
    return F.coalesce(table[F.concat_ws(":", res, name)], table[F.concat_ws(":", base, name)], F.lit("unknown"))


def backbone_column(atom: Column) -> Column:
    return F.upper(F.trim(atom)).isin(BACKBONE)
