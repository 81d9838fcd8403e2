"""Published residue tables, given as data so that callers can pass their own."""

from __future__ import annotations

# The twenty standard residues.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"

# Side-chain charges used for reward shaping.
CHARGES = {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}

# Residues counted as hydrophobic by the reward terms.
HYDROPHOBIC = "AILMFWVCY"

# Eisenberg consensus hydrophobicity (sum conventions of 1984).
EISENBERG = {
    "A": 0.62, "R": -2.53, "N": -0.78, "D": -0.90, "C": 0.29,
    "Q": -0.85, "E": -0.74, "G": 0.48, "H": -0.40, "I": 1.38,
    "L": 1.06, "K": -1.50, "M": 0.64, "F": 1.19, "P": 0.12,
    "S": -0.18, "T": -0.05, "W": 0.81, "Y": 0.26, "V": 1.08,
}

# Kyte and Doolittle (1982) hydropathy.
KYTE_DOOLITTLE = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5,
    "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6,
    "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# Boman (2003) index, from Radzicka and Wolfenden (1988).
BOMAN = {
    "L": -4.92, "I": -4.92, "V": -4.04, "F": -2.98, "M": -2.35,
    "W": -2.33, "A": -1.81, "C": -1.28, "G": -0.94, "Y": 0.14,
    "T": 2.57, "S": 3.40, "H": 4.66, "Q": 5.54, "K": 5.55,
    "N": 6.64, "E": 6.81, "D": 8.72, "R": 14.92, "P": 0.0,
}

# Average masses of the free amino acids, and of water.
MASSES = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891,
    "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201,
    "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
WATER = 18.0153
# Fixed value: mass lost when the C-terminal acid becomes an amide (OH -> NH2).
AMIDATION = 0.9847

# Bjellqvist et al. (1993) pK values.
BJELLQVIST = {
    "positive": {"Nterm": 7.5, "K": 10.0, "R": 12.0, "H": 5.98},
    "negative": {"Cterm": 3.55, "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0},
    "first": {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7},
    "last": {"D": 4.55, "E": 4.75},
}
# Handbook pK values of the free amino acids.
HANDBOOK = {
    "positive": {"Nterm": 9.38, "K": 10.67, "R": 12.10, "H": 6.04},
    "negative": {"Cterm": 2.15, "D": 3.71, "E": 4.15, "C": 8.14, "Y": 10.10},
    "first": {},
    "last": {},
}

# Residues favouring helix, turn and sheet.
HELIX = "EMALK"
TURN = "NPGSD"
SHEET = "VIYFWLT"
AROMATIC = "FWY"
# Residues in the descriptor library's hydrophobic ratio.
HYDROPHOBIC_LIBRARY = "ACFILMV"
