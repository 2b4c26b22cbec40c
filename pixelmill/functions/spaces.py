"""Colour spaces: matrices derived from published primaries, and the log-space registry."""

from __future__ import annotations

import numpy as np

D65, PROPHOTO_WHITE = (0.3127, 0.3290), (0.3457, 0.3585)

#: Chromaticities xR,yR xG,yG xB,yB as published.
PRIMARIES = {
    "ProPhoto": (0.7347, 0.2653, 0.1596, 0.8404, 0.0366, 0.0001),
    "F-Gamut": (0.708, 0.292, 0.170, 0.797, 0.131, 0.046),
    "F-Gamut C": (0.7347, 0.2653, 0.0263, 0.9737, 0.1173, -0.0224),
    "V-Gamut": (0.730, 0.280, 0.165, 0.840, 0.100, -0.030),
    "N-Gamut": (0.708, 0.292, 0.170, 0.797, 0.131, 0.046),
    "ITU-R BT.2020": (0.708, 0.292, 0.170, 0.797, 0.131, 0.046),
    "Cinema Gamut": (0.740, 0.270, 0.170, 1.140, 0.080, -0.100),
    "S-Gamut3": (0.730, 0.280, 0.140, 0.855, 0.100, -0.050),
    "S-Gamut3.Cine": (0.766, 0.275, 0.225, 0.800, 0.089, -0.087),
    "ARRI Wide Gamut 3": (0.6840, 0.3130, 0.2210, 0.8480, 0.0861, -0.1020),
    "ARRI Wide Gamut 4": (0.7347, 0.2653, 0.1424, 0.8576, 0.0991, -0.0308),
    "REDWideGamutRGB": (0.780308, 0.304253, 0.121595, 1.493994, 0.095612, -0.084589),
    "DJI D-Gamut": (0.71, 0.31, 0.21, 0.88, 0.09, -0.08),
}
#: The CAT02 chromatic adaptation matrix.
CAT02 = np.array([[0.7328, 0.4296, -0.1624], [-0.7036, 1.6975, 0.0061], [0.0030, 0.0136, 0.9834]])

#: Log space -> (gamut, curve).
LOG_SPACES = {
    "F-Log": ("F-Gamut", "F-Log"),
    "F-Log2": ("F-Gamut", "F-Log2"),
    "F-Log2C": ("F-Gamut C", "F-Log2"),
    "V-Log": ("V-Gamut", "V-Log"),
    "N-Log": ("N-Gamut", "N-Log"),
    "L-Log": ("ITU-R BT.2020", "L-Log"),
    "Canon Log 2": ("Cinema Gamut", "Canon Log 2"),
    "Canon Log 3": ("Cinema Gamut", "Canon Log 3"),
    "S-Log3": ("S-Gamut3", "S-Log3"),
    "S-Log3.Cine": ("S-Gamut3.Cine", "S-Log3"),
    "Arri LogC3": ("ARRI Wide Gamut 3", "Arri LogC3"),
    "Arri LogC4": ("ARRI Wide Gamut 4", "Arri LogC4"),
    "Log3G10": ("REDWideGamutRGB", "Log3G10"),
    "D-Log": ("DJI D-Gamut", "D-Log"),
}


def _xyz(white) -> np.ndarray:
    x, y = white
    return np.array([x / y, 1.0, (1 - x - y) / y])


def to_xyz(space: str) -> np.ndarray:
    """RGB to XYZ under the space's own white."""
    p = np.array(PRIMARIES[space]).reshape(3, 2)
    m = np.array([p[:, 0], p[:, 1], 1 - p.sum(1)]) / 1.0
    return m * np.linalg.solve(m, _xyz(PROPHOTO_WHITE if space == "ProPhoto" else D65))


def gamut_matrix(target: str) -> np.ndarray:
    """Linear ProPhoto RGB to the target gamut, adapted from its white to D65 by CAT02."""
    a, b = CAT02 @ _xyz(PROPHOTO_WHITE), CAT02 @ _xyz(D65)
    adapt = np.linalg.inv(CAT02) @ np.diag(b / a) @ CAT02
    return np.linalg.inv(to_xyz(target)) @ adapt @ to_xyz("ProPhoto")


def luminance_row() -> tuple[float, float, float]:
    r, g, b = (float(v) for v in to_xyz("ProPhoto")[1])
    return r, g, b


def resolve(name: str) -> tuple[str, str, str]:
    """Log space (any case) -> its name, gamut and curve; unknown names fail at once."""
    for k, (gamut, curve) in LOG_SPACES.items():
        if k.lower() == name.lower():
            return k, gamut, curve
    raise ValueError(f"unknown log space {name!r}; one of {', '.join(LOG_SPACES)}")
