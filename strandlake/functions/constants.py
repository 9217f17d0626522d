"""Fixed values that results depend on."""

from __future__ import annotations

from itertools import product

#: The standard genetic code: residues of codons whose bases run through T, C, A, G, the last fastest.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), _CODE, strict=True))
STOPS = ("TAA", "TAG", "TGA")
SENSE = tuple(c for c, a in CODONS.items() if a != "*")

#: Average residue masses, and the Kyte-Doolittle hydropathy scale.
RESIDUE_MASS = {"A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411, "I": 113.1594, "K": 128.1741, "L": 113.1594, "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760}
WATER_MASS = 18.0153
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
RESIDUES = tuple(sorted(RESIDUE_MASS))
