"""Fixed values of the paperwork: markers, position bands, tolerances, names and limits."""

from __future__ import annotations

from dataclasses import dataclass

# Markers on pages, without white space, in the order in which they decide.
TYPE_MARKERS = (
    ("DELIVERYCHALLAN", "delivery_challan"),
    ("ECRLN", "liquid_nitrogen"),
    ("LIQUIDTANKDECANT", "liquid_tank_decant"),
    ("D/A", "da_gas"),
    ("OPENINGBALANCE", "irrelevant:petty_cash_ledger"),
    ("DAILYSTOCKTAKINGREPORT", "irrelevant:stock_report"),
    ("REQUISITIONSLIP", "irrelevant:requisition_slip"),
    ("DAILYSUMMERYREPORTPLATEFORM", "irrelevant:daily_summary"),
    ("PAYMENTVOUCHER", "irrelevant:payment_voucher"),
    ("TOLLPLAZA", "irrelevant:toll_plaza_receipt"),
    ("CHALLANOFCASH", "irrelevant:bank_treasury_challan"),
)
REQUIRED_MARKERS, REQUIRED_TYPE, OTHER = ("MCL", "CP"), "gas_cylinder", "other"
ENGLISH_WORD, ENGLISH_WORDS = "[A-Za-z]{3,}", 2

# Folder of each type.
FOLDERS = {
    "gas_cylinder": "Gas Cylinder",
    "da_gas": "D-A Gas",
    "liquid_nitrogen": "Liquid Nitrogen",
    "liquid_tank_decant": "Liquid Tank Decant",
    "delivery_challan": "Delivery Challan",
}

# Limits of candidates, readings and models.
MIN_CONFIDENCE, MAX_DIGITS, MIN_DENSITY = 0.65, 6, 0.6
MIN_HEIGHT, MAX_HEIGHT = 0.020, 0.15
MIN_VOTES, MAX_ASPECT, RESCUE_CONFIDENCE = 2, 4.5, 0.98
PAD, CROP_SCALE, MIN_CROP = 0.3, 3.4, (40, 30)
ROTATIONS = (0, 90, 270, 180)
OUTLIER_LEAST, OUTLIER_MARGIN, DUPLICATES = 20, 0.5, 3
CALL_CAP, CALL_WINDOW = 8000, 86400


@dataclass(frozen=True)
class Band:
    """Where a type's number stands, as shares of the page, and how many digits it has."""

    type: str
    y_lo: float
    y_hi: float
    x_min: float
    x_max: float
    digits_lo: int = 1
    digits_hi: int = MAX_DIGITS


# Bands by type.
BANDS = (
    Band("gas_cylinder", 0.0, 0.11, 0.55, 1.0),
    Band("da_gas", 0.0, 0.11, 0.55, 1.0),
    Band("liquid_nitrogen", 0.10, 0.20, 0.10, 0.35),
    Band("liquid_nitrogen", 0.06, 0.21, 0.65, 0.92, 3, 4),
    Band("liquid_tank_decant", 0.08, 0.22, 0.65, 1.0),
)


@dataclass(frozen=True)
class Anchor:
    """A label on whose row a number stands."""

    marker: str
    tolerance: float
    x_min: float = 0.0
    x_max: float = 1.0
    right_of_label: bool = False


# Anchors of the delivery challan, the second if the first finds nothing.
GATE_PASS = Anchor("G/P#", 0.014, x_min=0.55)
CHALLAN = Anchor("DC#", 0.024, x_max=0.50, right_of_label=True)
ANCHORS = (("delivery_challan", GATE_PASS), ("delivery_challan", CHALLAN))

# Where a field column lies that may be blank, as shares of the page: from and to in height, its right edge.
FIELD_COLUMN = (0.02, 0.30, 0.45)
# Zooms at which a detected crop is read, and the margin around each.
ZOOMS, MARGIN = (0.8, 1.0, 1.2), 24
# Local contrast of crops, and the sizes that the page classifier and the digit reader take.
CONTRAST, CONTRAST_TILES = 2.0, 8
CLASS_SIDE, DIGIT_HEIGHT, DIGIT_WIDTH = 96, 32, 8
# Fixed value: the least share of a crop's height that a digit's stroke has.
GLYPH_HEIGHT = 0.3
