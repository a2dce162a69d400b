"""Weights, thresholds and word lists. All are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Spellings of units and their canonical form.
UNITS = {
    "mm": "mm", "MM": "mm", "cm": "cm", "CM": "cm", "m": "m", "µm": "µm", "um": "µm", "uM": "µm", "nm": "nm",
    "kg": "kg", "KG": "kg", "Kg": "kg", "g": "g", "G": "g", "L": "L", "l": "L", "ML": "mL", "ml": "mL", "mL": "mL",
    "Pa": "Pa", "KPA": "kPa", "kPa": "kPa", "MPA": "MPa", "MPa": "MPa", "bar": "bar", "°C": "°C", "C": "°C", "c": "°C", "°F": "°F",
    "V": "V", "v": "V", "kV": "kV", "A": "A", "mA": "mA", "W": "W", "kW": "kW", "Hz": "Hz", "kHz": "kHz", "MHz": "MHz",
    "N": "N", "kN": "kN", "%": "%", "ppm": "ppm", "Ω": "Ω", "ohm": "Ω", "Ohm": "Ω",
}
SPEC_UNITS = {"C": "°C", "c": "°C", "um": "µm", "ML": "mL", "L": "L", "l": "L"}
# Headings known by name.
HEADINGS = [
    "scope", "normative references", "references", "terms and definitions", "terms", "definitions", "symbols", "abbreviations",
    "principle", "reagents", "reagents and materials", "materials", "apparatus", "equipment", "samples and sampling", "sampling",
    "preparation of apparatus", "calibration and standardization", "calibration", "procedure", "proceure", "heater tube deposit rating",
    "precision", "test report", "report", "annex", "bibliography", "foreword", "requirements", "dimensions", "construction",
    "performance", "testing", "test methods", "inspection", "marking", "packaging", "labelling", "general", "designation",
    "manufacture", "workmanship", "supply",
]
# What a tender is searched for.
DIMENSION = r"(?i)(\d+(?:\.\d+)?)\s*(mm|cm|m|inch|in|kg|g|L|mL|°C|bar|kPa|MPa|V|A|kW|Hz)\b"
CAPACITY = r"(?i)(\d+(?:\.\d+)?)\s*(L|litre|liter|mL|KL|kL|capacity|tonne|tons?)\b"
MATERIAL = r"(?i)\b(stainless steel|SS\s*304|SS\s*316|mild steel|carbon steel|aluminium|aluminum|brass|copper|PVC|uPVC|HDPE|rubber|concrete|cement|bitumen|polyethylene)\b"
APPLICATION = r"(?i)\b(drinking water|municipal|potable|aviation|gas turbine|fuel|petroleum|construction|electrical|installation|storage tank|pressure vessel)\b"
PRODUCT = (
    r"(?i)(water\s*(?:storage\s*)?tank)|(pressure\s*tunnel)|(gas\s*turbine\s*fuel)|(thermal\s*oxidation\s*stability)|(heater\s*tube)"
    r"|(cement|concrete|steel|pipe|valve|pump|cable|transformer|explosive\s*atmosphere|electrical\s*installation)|(yoga|terminology)"
)
TENDER_REFERENCE = r"(?i)IS\s*[0-9]+(?:\s*\(?\s*Part\s*[0-9]+[^)]*\)?)?\s*[:-]?\s*[0-9]{4}"
HITS = {"product": PRODUCT, "material": MATERIAL, "application": APPLICATION, "capacity": CAPACITY, "dimension": DIMENSION, "reference": TENDER_REFERENCE}
QUERY_REFERENCE = TENDER_REFERENCE
TEST_WORDS = "test|testing|inspection|sampling|calibration|deposit rating|JFTOT"
SAFETY_WORDS = "safety|hazard|warning|explosive|protection"
STOPWORDS = "the and for with from that this shall will are has have been were which using test standard".split()
CRITICAL = ["capacity", "material", "application", "testing", "dimensions", "safety", "certification"]
IMPORTANT = ["temperature", "pressure", "voltage", "tolerance", "surface_finish", "coating", "marking", "delivery", "warranty"]
# Materials that a search may name.
RANK_MATERIAL = r"(?i)\b(steel|stainless|aluminium|aluminum|brass|copper|pvc|hdpe|rubber|concrete|cement|bitumen|petroleum|gas|turbine|fuel)\b"
CONFLICT_MATERIALS = ["steel", "aluminium", "copper", "brass", "poly"]


@dataclass(frozen=True)
class Config:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    semantic_weight: float = 0.5
    lexical_weight: float = 0.3
    metadata_weight: float = 0.2
    rank_semantic: float = 0.5
    rank_title: float = 0.2
    rank_scope: float = 0.15
    rank_material: float = 0.1
    rank_recency: float = 0.05
    single_source: float = 0.85
    abstain: float = 0.25
    medium: float = 0.40
    high: float = 0.65
    spec_confidence: float = 0.6
    chunk_tokens: int = 500
    long_paragraph: int = 700


DEFAULT = Config()
