"""Planet, sensor encoding, catalogue, boxes and colour ramp.

Fixed values that have to be equal to the data producers' for right results.
"""

from __future__ import annotations

import math

# --- sphere and postings -------------------------------------------------------------
RADIUS_M = 6_051_800.0
M_PER_DEG = math.radians(1.0) * RADIUS_M
EARTH_RADIUS_M = 6_371_000.0
ALTIMETRY_NODATA = -32768
STEREO_SENTINEL = -1e6
QUAD_DEG = 12.0

# --- backscatter law and DN encoding ---------------------------------------------------
LAW_A = 0.0118
LAW_C = 0.111
DN_SCALE = 5.0
DN_OFFSET = 20.0
RV_MIN_DB = -20.0
RV_MAX_DB = 30.0
DN_NODATA = 0

# --- feature normalisers ---------------------------------------------------------------
GTDR_SCALE_M = 1000.0
EMISSIVITY_MEAN = 0.85
EMISSIVITY_SCALE = 0.05
RV_SCALE_DB = 5.0

# --- objective scales and weights ------------------------------------------------------
OBJECTIVE_SCALE = {
    "stereo_m": 75.0, "alt_m": 30.0, "earth_m": 30.0,
    "phys_db": 2.0, "slope_rad": 0.0175, "rms_rad": 0.0175,
}
OBJECTIVE_WEIGHT = {
    "earth": 1.0, "stereo": 1.0, "alt": 2.0, "phys": 0.3,
    "cross": 0.3, "rms": 0.05, "nll": 0.1, "reg": 0.01,
}
RAMPED_TERMS = ("phys", "cross")

# --- incidence profile per look: lat_peak, theta_peak, curvature, theta_min ---------------
INCIDENCE = {
    "left": (10.0, 45.0, 0.0040, 17.0),
    "right": (10.0, 45.0, 0.0040, 17.0),
    "stereo": (10.0, 25.0, 0.0025, 12.0),
}
TRACK_AZIMUTH_DEG = 180.0

# --- raster catalogue: key, file, kind, resolution m, GB -------------------------------------
PRODUCTS = [
    ("sar_left_75m", "Venus_Magellan_LeftLook_mosaic_global_75m_jpeg.tif", "sar", 75.0, 16.77),
    ("sar_right_75m", "Venus_Magellan_RightLook_mosaic_global_75m_jpeg.tif", "sar", 75.0, 7.15),
    ("sar_stereo_75m", "Venus_Magellan_StereoLook_mosaic_global_75m.tif", "sar", 75.0, 87.86),
    ("sar_left_225m", "Venus_Magellan_LeftLook_mosaic_global_225m.tif", "sar", 225.0, 13.01),
    ("gtdr", "Venus_Magellan_Topography_Global_4641m_v02.tif", "topography", 4641.06, 0.07),
    ("gsdr", "Venus_Magellan_MeterScaleSlope_Global_4641m.tif", "slope", 4641.06, 0.03),
    ("gedr", "Venus_Magellan_MicrowaveEmissivity_Global_4641m.tif", "emissivity", 4641.06, 0.07),
]

# --- region boxes: west, south, east, north (west > east crosses the meridian) -----------------
REGIONS = {
    "ovda": (75.0, -12.0, 100.0, 4.0),
    "thetis": (110.0, -20.0, 135.0, -3.0),
    "alpha": (0.0, -32.0, 16.0, -18.0),
    "mead": (50.0, 6.0, 65.0, 19.0),
    "guinevere": (325.0, 12.0, 350.0, 32.0),
    "lavinia": (340.0, -47.0, 5.0, -30.0),
    "eistla": (16.0, 8.0, 40.0, 26.0),
    "maxwell": (352.0, 60.0, 16.0, 72.0),
    "maat": (188.0, 2.0, 202.0, 14.0),
    "artemis": (125.0, -45.0, 150.0, -25.0),
}
HELD_OUT_REGIONS = ("ovda", "guinevere")

# --- hypsometric ramp: metres -> (red, green, blue) ---------------------------------------------
COLOUR_RAMP = [
    (-3000.0, (20, 30, 60)),
    (-1000.0, (40, 80, 110)),
    (0.0, (90, 120, 100)),
    (1000.0, (150, 140, 90)),
    (3000.0, (190, 150, 80)),
    (6000.0, (220, 180, 120)),
    (11000.0, (250, 245, 235)),
]

# --- mesh -----------------------------------------------------------------------------------------
QUANTISED_MAX = 32767
