"""Table schemas of the structure side."""

#: A row for each atom. atom_ord, residue_ord: places in the file, which row order can't carry.
ATOMS = (
    "structure_id string, model bigint, chain_id string, residue_name string, residue_serial bigint, insertion_code string, conformer_id string, atom_name string, "
    "atom_serial bigint, element string, x double, y double, z double, b_factor double, occupancy double, is_hetero boolean, is_backbone boolean, atom_ord bigint, residue_ord bigint"
)
#: What readers give: atoms, or for a file that can't be read one row with its path and error.
READ = f"path string, error string, {ATOMS}"
STRUCTURES = "structure_id string, atom_count bigint, residue_count bigint, chain_count bigint, model_count bigint, chains string"
#: Fixed shapes of per-residue tensors: inner sizes that array columns don't carry.
TENSOR_SHAPES = {"atom37_positions": (37, 3), "atom37_mask": (37,), "atom14_positions": (14, 3), "atom14_mask": (14,), "rigidgroups_frames": (8, 4, 4), "rigidgroups_exists": (8,), "chi_angles": (4,), "chi_mask": (4,)}


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
