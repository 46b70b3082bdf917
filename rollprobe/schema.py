"""Fixed schemas of the data model, as DDL; nothing is inferred from data."""

ATOMS = "structure string, atom int, record string, atom_name string, residue_name string, residue_number int, residue_label string, chain string, segment string, element string, is_het boolean, is_h boolean, residue_id int, x double, y double, z double, radius double, atom_class string"
COORDS = "structure string, frame int, atom int, x double, y double, z double"
SERIES = "feature string, idx int, frame int, value double"
