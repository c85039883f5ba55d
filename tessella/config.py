"""Fixed values that results depend on, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: must equal the published behaviour for equal results -------------------------
GRID_X, GRID_Y, GRID_EDGE = 12, 32, 0.25
SIZE_EDGES = (0.12, 0.25)
TRIPLET_K, TRIPLET_MAX_BUTTONS, TRIPLET_ANGLE = 5, 80, 15.0
MIN_IDF, MAX_DF_FRACTION, DF_MIN_DOCS = 0.15, 0.25, 200
TOP_N, VERIFY_TOP_M, TOP_K = 100, 25, 5
W_GEOMETRIC, W_TIER1, W_BRAND, W_ASPECT = 0.55, 0.25, 0.15, 0.05
CODE_EXACT, CODE_FUZZY, CODE_DISTANCE = 0.40, 0.20, 2
ASPECT_TOLERANCE = 0.35
HIGH_SCORE, HIGH_MARGIN, MEDIUM_SCORE, LOW_SCORE, TIE_MARGIN = 0.65, 0.10, 0.50, 0.45, 0.01
MAX_PAIR_DISTANCE, MAX_SIZE_RATIO, COLOR_COST = 0.25, 2.2, 0.35
RANSAC_ITERATIONS, RANSAC_RESIDUAL, RANSAC_SEED = 400, 0.04, 12345
MAX_SCALE_DEVIATION, MAX_SHEAR, MIN_CORRESPONDENCES = 0.45, 0.35, 4
LABEL_BONUS, LABEL_EVIDENCE = 0.30, 3
LABEL_DISTANCE, LABEL_WIDTH = 0.09, 0.55
MIN_SOURCE_PIXELS = 500
SPARSE_FRACTION, SPARSE_BUTTONS = 0.20, 12
DENSITY_MAX, DENSITY_SIBLING, DENSITY_RATIO = 3.0, 1.0, 3.0
REVIEW_QUALITY, TRUSTED_QUALITY, TRUSTED_BUTTONS, HARD_QUALITY = 0.75, 0.80, 5, 0.55
RESHOOT_BUTTONS, RESHOOT_QUALITY = 8, 0.60
ORIENTATION_TRUST = 0.75
FINGERPRINT_VERSION, TOKEN_VERSION = 2, 1
CHROMATIC = ("red", "orange", "yellow", "green", "blue", "purple")
MODEL_PATTERN = r"\b[A-Z]{1,5}(?:[- ][A-Z]{1,5})?[- ]?\d{2,6}[A-Z]{0,3}(?:-\d{2,6}[A-Z]{0,3})?\b"
TITLE_STOP = "пульт|пyльт"
BUTTON_WORDS = (
    "HDMI HDMI1 HDMI2 HDMI3 HDMI4 VGA VGA1 VGA2 AV AV1 AV2 AV3 USB USB1 USB2 SCART YPBPR DVI RGB SVIDEO "
    "3D PIP SD HD UHD FHD CH VOL TV DVD VCR SAT AUX PS CLK OSD 169 43 MPEG DTV ATV CATV DTT EPG MTS SAP CC "
    "P1 P2 P3 F1 F2 F3 F4 A1 A2 B1 B2 MP3 MP4 AC3 PAL NTSC SECAM MODE1 MODE2 SET1 SET2 TV1 TV2 DVD1 STB1 STB2"
).split()
MODEL_MIN_LENGTH, MODEL_BOTTOM, ISOLATION, BUTTON_RADIUS, BUTTON_PENALTY, SEPARATOR = 5, 0.75, 0.12, 0.05, 0.6, 0.75
BRAND_LENGTH, BRAND_FUZZY_LENGTH, BRAND_RATIO, BRAND_TOP, BRAND_BOTTOM, BRAND_END = 3, 6, 85.0, 0.18, 0.86, 0.15
STAMP_LENGTH, STAMP_RATIO, STAMP_HEIGHT, STAMP_PHRASE_LENGTH, STAMP_PHRASE_RATIO = 2, 60.0, 1.3, 12, 70.0
TEXT_TOTAL, TEXT_MARGIN = 1.0, 0.25
BLACK_VALUE, GREY_SATURATION, WHITE_VALUE = 65, 85, 185
HUES = (
    ("red", 0, 8), ("red", 172, 180), ("orange", 9, 22), ("yellow", 23, 33), ("green", 34, 85), ("blue", 86, 130),
    ("purple", 131, 158),
)
# --- end of fixed values -------------------------------------------------------------------------


@dataclass(frozen=True)
class Audit:
    """Limits of the extraction audit."""

    min_buttons: int = 6
    max_buttons: int = 70
    min_area: float = 0.12
    min_aspect: float = 1.5
    max_aspect: float = 7.0
    low_orientation: float = 0.35
    low_quality: float = 0.5
