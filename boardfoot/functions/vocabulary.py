"""Fixed values of the trade: spellings, word lists and patterns. Their order is part of their meaning."""

from __future__ import annotations

# Thickness spellings.
THICKNESS = {
    "3/4": "3/4", "4/4": "4/4", '1"': "4/4", "1 inch": "4/4", "5/4": "5/4", '1-1/4"': "5/4", "6/4": "6/4",
    '1-1/2"': "6/4", "7/4": "7/4", "8/4": "8/4", '2"': "8/4", "2 inch": "8/4", "9/4": "9/4", "10/4": "10/4",
    '2-1/2"': "10/4", "12/4": "12/4", '3"': "12/4", "13/16": "13/16", "15/16": "15/16", "5/8": "5/8",
}
# Grade spellings.
GRADES = {
    "fas": "FAS", "f.a.s.": "FAS", "fas/sel": "FAS/SEL", "s&b": "Select & Better", "s & b": "Select & Better",
    "sel & btr": "Select & Better", "sel&btr": "Select & Better", "sel & better": "Select & Better",
    "select & btr": "Select & Better", "select & btr.": "Select & Better", "select & better": "Select & Better",
    "s&btr": "Select & Better", "#1c": "#1 Common", "1c": "#1 Common", "#1 com": "#1 Common", "1 com": "#1 Common",
    "1 common": "#1 Common", "#1 common": "#1 Common", "1com": "#1 Common", "1com.": "#1 Common", "#2c": "#2 Common",
    "2c": "#2 Common", "2 com": "#2 Common", "2 common": "#2 Common", "#2 common": "#2 Common", "2com": "#2 Common",
    "2a": "#2A Common", "2a com": "#2A Common", "2a common": "#2A Common", "#2a": "#2A Common",
    "#2a common": "#2A Common", "2a/3a": "#2A/3A Common", "3 com": "#3 Common", "3 common": "#3 Common",
    "#3 common": "#3 Common", "3com": "#3 Common", "3a com": "#3A Common", "#1c&btr": "#1 Common & Better",
    "1c&btr": "#1 Common & Better", "#1 common & btr": "#1 Common & Better", "1 common & btr": "#1 Common & Better",
    "#1c 1&2 white": "#1C 1&2 White", "1/btr": "#1 & Better", "1&btr": "#1 & Better", "rustic": "Rustic",
    "prime": "Prime", "superprime": "Super Prime", "premium": "Premium", "fab": "FAB", "fab mineral": "FAB Mineral",
    "fab stained": "FAB Stained", "d&btr": "D & Better", "prem furniture": "Premium Furniture", "s1f&btr": "S1F & Better",
    "1c s1f&btr": "#1C S1F & Better", "red 1f&btr": "Red 1F & Better", "#2a/3a": "#2A/3A", "rgh": "Rough",
}
# Species spellings; the first that fits counts.
SPECIES = {
    "ash": "Ash", "white ash": "White Ash", "aspen": "Aspen", "basswood": "Basswood", "beech": "Beech", "birch": "Birch",
    "white birch": "White Birch", "yellow birch": "Yellow Birch", "catalpa": "Catalpa", "cedar": "Cedar",
    "aromatic cedar": "Aromatic Cedar", "aromatic red cedar": "Aromatic Red Cedar", "cedar aromatic": "Aromatic Cedar",
    "cedar, aromatic red": "Aromatic Red Cedar", "cherry": "Cherry", "coffeenut": "Coffeenut", "cottonwood": "Cottonwood",
    "cypress": "Cypress", "elm": "Elm", "grey elm": "Grey Elm", "red elm": "Red Elm", "hackberry": "Hackberry",
    "hard maple": "Hard Maple", "hemlock": "Hemlock", "hickory": "Hickory", "honey locust": "Honey Locust", "maple": "Maple",
    "soft maple": "Soft Maple", "soft maple red leaf": "Soft Maple", "soft maple - red leaf": "Soft Maple", "oak": "Oak",
    "red oak": "Red Oak", "white oak": "White Oak", "white oak rift & quarter": "White Oak Rift & Quarter",
    "white oak rifted & quartered": "White Oak Rift & Quarter", "white oak rift & quartered": "White Oak Rift & Quarter",
    "white oak plain sawn": "White Oak Plain Sawn", "red oak plain sawn": "Red Oak Plain Sawn",
    "red oak rift & quarter": "Red Oak Rift & Quarter", "pine": "Pine", "white pine": "White Pine",
    "syp": "Southern Yellow Pine", "southern yellow pine": "Southern Yellow Pine", "treated pine": "Treated Pine",
    "poplar": "Poplar", "sassafras": "Sassafras", "sap gum": "Sap Gum", "sycamore": "Sycamore", "walnut": "Walnut",
    "rq walnut": "RQ Walnut", "alder": "Alder", "black ash": "Black Ash",
}
# Words that name a species wherever they stand.
SPECIES_WORDS = (
    "ash", "aspen", "basswood", "beech", "birch", "cedar", "cherry", "coffeenut", "cottonwood", "cypress", "elm",
    "hackberry", "hemlock", "hickory", "locust", "maple", "oak", "pine", "poplar", "sassafras", "sycamore", "walnut",
    "alder", "gum",
)
# Names that head a section.
HEADER_NAMES = (
    "ASH", "ASPEN", "BASSWOOD", "BEECH", "BIRCH", "CEDAR", "CHERRY", "COFFEENUT", "COTTONWOOD", "CYPRESS", "ELM",
    "HACKBERRY", "HEMLOCK", "HICKORY", "HONEY LOCUST", "MAPLE", "OAK", "PINE", "POPLAR", "SASSAFRAS", "SYCAMORE",
    "WALNUT", "ALDER", "SAP GUM", "HARD MAPLE", "SOFT MAPLE", "RED OAK", "WHITE OAK", "RED ELM", "GREY ELM",
    "WHITE BIRCH", "YELLOW BIRCH", "WHITE PINE", "WHITE ASH", "BLACK ASH", "SOFT MAPLE - RED LEAF", "WALNUT - STEAMED",
    "RED OAK PLAIN SAWN", "RED OAK RIFT & QUARTER", "WHITE OAK PLAIN SAWN", "WHITE OAK RIFT & QUARTER",
    "WHITE OAK RIFTED & QUARTERED", "WHITE OAK - QUARTER AND RIFT", "RQ WALNUT",
)
HEADER_WORDS = tuple(w.upper() for w in SPECIES_WORDS if w != "cypress")

# Patterns that score a text.
FRACTION = r"\b(\d{1,2})/(\d)\b"
GRADE_MARK = r"(?i)\b(?:FAS|F1F|FAS/1F|FAS/SEL|S[&/]B|SEL|S&BTR|SELECT|#?[1-3][A-C]?\s*(?:COM|COMMON)?|1C|2C|2A|3A|PRIME|PREMIUM|RUSTIC|FAB|D\s*&\s*BTR|SEL\s*&\s*BTR|1\s*COM|2\s*COM)\b"
BOARD_FEET = r"""(?i)(?:[\d,]+)\s*['"]?\s*(?:BF|BD\s*FT|BOARD\s*F)|\b[\d,]{3,}['"]"""
TRUCKLOAD = r"(?i)\bT/?L\b"
LENGTH_MARK = r"""(?i)\b\d{1,2}['\-–]\d{0,2}['"]?"""
PRICE = r"\$\s*[\d,.]+|\b\d+\.\d{2}\b"
DIMENSION = r"""(?i)\b\d+["']?\s*(?:&\s*W|[xX×]\s*\d)"""
SPECIES_WORD = "(?i)" + "|".join(SPECIES_WORDS)
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
URL = r"(?i)(?:https?://|www\.)\S+|\w+\.(?:com|net|org|io)\b"
PHONE = r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}"
ADDRESS = r"(?i)^\d{1,5}\s+[A-Za-z]+.*(?:St|Street|Rd|Road|Ave|Avenue|Blvd|Dr|Drive|Hwy|Lane|Way)\b"
CITY_STATE_ZIP = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+[A-Z]{2}\s+\d{5}"
CONTACT = r"(?i)\b(?:contact|email|phone|fax|cell|office|visit|call\s+us)\b"
DISCLAIMER = r"(?i)\b(?:subject\s+to|without\s+notice|fsc|pefc|certified)\b"
BRANDING = r"(?i)\b(?:instagram|linkedin|facebook|twitter|youtube)\b"
# What each signal adds to a text's score, in order.
CANDIDATE_SIGNALS = (
    (0.30, (FRACTION,)), (0.25, (GRADE_MARK,)), (0.20, (BOARD_FEET, TRUCKLOAD)), (0.15, (SPECIES_WORD,)),
    (0.05, (LENGTH_MARK,)), (0.10, (PRICE,)), (0.05, (DIMENSION,)), (-0.60, (EMAIL,)), (-0.50, (URL,)), (-0.50, (PHONE,)),
    (-0.50, (ADDRESS,)), (-0.50, (CITY_STATE_ZIP,)), (-0.30, (CONTACT,)), (-0.30, (DISCLAIMER,)), (-0.40, (BRANDING,)),
)
ROW_PENALTIES = ((-0.50, EMAIL), (-0.40, URL), (-0.40, PHONE), (-0.40, ADDRESS), (-0.40, CITY_STATE_ZIP))
ACCEPT, REVIEW = 0.70, 0.40

# Lines that are never stock.
JUNK = (
    EMAIL, r"(?i)(?:https?://|www\.)\S+", r"(?i)\w+\.(com|net|org|io|biz)\b",
    r"(?i)(?:(?:ph|phone|fax|cell|office|tel)[:\s]*)?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}",
    r"(?i)^\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:St|Street|Rd|Road|Ave|Avenue|Blvd|Dr|Drive|Hwy|Highway|Lane|Ln|Way|Ct|Court)\b",
    r"(?i)^P\.?\s*O\.?\s*Box\s+\d", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+[A-Z]{2}\s+\d{5}",
    r"(?i)all\s+(?:quantities|lumber|inventory)\s+(?:subject|are\s+subject)",
    r"(?i)prices?\s+(?:subject|are\s+subject|may\s+change)",
    r"(?i)(?:fsc|pefc|sfi)[\s®]*(?:certified|cert|chain|coc|available)", r"(?i)certified\s+(?:chain|forest|wood)",
    r"(?i)(?:visit\s+us|check\s+(?:us|out)|follow\s+us)",
    r"(?i)(?:contact\s+us|reach\s+out|ask\s+about|please\s+(?:call|reach|contact))",
    r"(?i)(?:instagram|linkedin|facebook|twitter|youtube)[\s:@]", r"(?i)^(?:from|to|sent|cc|subject|date)\s*:",
    r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}$", r"(?i)^page\s+\d+\s*(of\s+\d+)?$", r"^[\s\-_=*#.,:;|]+$",
    r"(?i)^(?:services?\s+offered|we\s+are\s+interested|to\s+purchase)",
    r"(?i)^(?:stock\s+list|inventory\s+list|kiln\s+dried\s+(?:stock|inventory)|net\s+tally|kd\s+stock\s*(?:list)?|hardwood\s+(?:stock|inventory))\s*$",
    r"(?i)^\*+\s*specials?\s*\*+", r"(?i)^(?:county|state)\s+(?:highway|road|route)\s+",
)
# Fragments that are noise.
NOISE = (
    EMAIL, r"(?i)(?:https?://|www\.)\S+", r"(?i)^\w+\.(com|net|org)\b", PHONE,
    r"(?i)^\d{1,5}\s+[A-Z][a-z]+.*(?:St|Rd|Ave|Blvd|Dr|Hwy|Lane|Way)\b", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+[A-Z]{2}\s+\d{5}",
)
# What the head of a list tells of its mill.
DATE = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\w+\s+\d{1,2},?\s*\d{4})"
MILL_WORD = r"(?i)(?:lumber|sawmill|hardwood|wood\s*products|forest\s*products|timber|co\.|c0\.|company|inc\.|llc|corp|hardwoods)"
# Product line formats (quantity first, count of truckloads, truckload or call, thickness first) and parts.
LINE_A = r"""^([\d,]+)['"]?\s+(\d+/\d+)\s+(.*)"""
LINE_D = r"(?i)^(\d+)\s+T/?L\s+(\d+/\d+)\s+(.*)"
LINE_B = r"(?i)^(T/?L|Call)\s+(\d+/\d+)\s+(.*)"
LINE_C = r"^(\d+/\d+)\s+(.*)"
ANY_FRACTION = r"\b(\d+/\d)\b"
GRADE_WITH_NUMBER = r"(?i)\b(?:FAS|S[&/]B|#?\d[AC]?|SEL|PRIME|RUSTIC|FAB)\b"
LAST_NUMBER = r"""([\d,]+)['"]?\s*$"""
LENGTH_AT_END = r"""(?i)(\d+['\-–]\d*['"]?(?:\s*(?:&|and|-)\s*\d+['"]?)?(?:\s*only)?)\s*$"""
SURFACE = r"(?i)\b(RGH|Rough|S2S|S4S|15/16|13/16|1\s*3/16|1\s*5/16)\b"
COLOR = r"(?i)\b(White|Brown|Red|Natural|Sap|Heart(?:wood)?|Calico|Wheat|Northern|Unselected|Rocky\s*Mountain)\b"
CUT = r"(?i)\b(Rift\s*&?\s*Quarter(?:ed)?|Rift|Quarter(?:ed)?|Plain\s*Sawn|Flitch|Live\s*Sawn|Circle[\s-]Sawn)\b"
TREATMENT = r"(?i)\b(Steamed|Unsteamed|Stained|Spalted|Wormy|Ambrosia|Checked|Striped|WHND|Stick\s*Shadow|Mineral|CND)\b"
NOT_GRADE = (r"(?i)\b(RGH|Rough|S2S|S4S|15/16|13/16)\b", r"""(?i)\d+['\-–]\s*\d*['"]?(?:\s*only)?""", r"\b\d{2,6}\b")
