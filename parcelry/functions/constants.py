"""Fixed values of the domain: unit factors, vocabularies, label words and patterns."""

from __future__ import annotations

# Devanagari digits and what they stand for.
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"

# Square metres of one unit of area.
AREA_UNITS_SQM = {
    "ha": 10000.0, "hectare": 10000.0, "hect": 10000.0, "हेक्टेयर": 10000.0, "हे": 10000.0,
    "acre": 4046.86, "acres": 4046.86, "एकड़": 4046.86,
    "bigha": 2529.0, "बीघा": 2529.0,
    "biswa": 126.45, "बिस्वा": 126.45,
    "guntha": 101.17, "गुंठा": 101.17,
    "kanal": 505.857, "marla": 25.29, "cent": 40.47, "are": 100.0,
    "sqm": 1.0, "sq m": 1.0, "sq.m": 1.0, "वर्ग मीटर": 1.0,
    "sqft": 0.0929, "sq ft": 0.0929,
}

# Unit words in column headers, and the unit they name.
HEADER_UNITS = (
    ("हेक्टेयर", "ha"), ("हे", "ha"), ("hectare", "ha"), ("ha", "ha"),
    ("एकड़", "acre"), ("acre", "acre"),
    ("बीघा", "bigha"), ("bigha", "bigha"),
    ("बिस्वा", "biswa"), ("biswa", "biswa"),
    ("गुंठा", "guntha"), ("guntha", "guntha"),
    ("वर्ग मीटर", "sqm"), ("sqm", "sqm"),
)

# The document states, in order.
STATUSES = ("uploaded", "processing", "extracted", "auto_verified", "pending_review", "verified", "rejected", "failed")

# Keywords that tell a document's type, strongest first.
DOC_TYPES = (
    ("sale_deed", ("sale deed", "conveyance", "vendor", "vendee", "विक्रय", "बैनामा", "sale")),
    ("ror", ("khatauni", "खतौनी", "record of rights", "jamabandi", "जमाबंदी", "7/12", "satbara", "adhikar abhilekh", "अधिकार अभिलेख")),
    ("mutation", ("mutation", "नामांतरण", "दाखिल खारिज", "फेरफार")),
    ("khasra", ("khasra", "खसरा", "survey", "सर्वे")),
    ("map", ("map", "नक्शा", "cadastral", "scale")),
)

# Shapes that a field's value should have (after digits are ASCII).
SHAPES = {
    "survey_number": r"^[0-9]{1,5}(\s*/\s*[0-9A-Za-z]{1,4})*[A-Za-z]?$",
    "khasra_number": r"^[0-9]{1,5}(\s*/\s*[0-9]{1,4})*$",
    "khata_number": r"^[0-9]{1,6}$",
    "mutation_number": r"^[A-Za-z0-9/\-]{1,20}$",
    "registration_number": r"^[A-Za-z0-9/\-]{1,25}$",
    "record_year": r"^(19|20)[0-9]{2}(\s*[-/]\s*(19|20)?[0-9]{2})?$",
    "plot_area": r"(?i)^[0-9]+([.,][0-9]+)?\s*(ha|hectare|hect|acre|acres|bigha|biswa|guntha|sq\.?\s*m|sqm|sq\s*ft|sqft|kanal|marla|cent|are|हेक्टेयर|हे|एकड़|बीघा|बिस्वा|गुंठा|वर्ग\s*मीटर)?\.?$",
    "mutation_date": r"^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}$",
    "record_date": r"^[0-9]{1,2}\s*[-/.]\s*[0-9]{1,2}\s*[-/.]\s*[0-9]{2,4}$",
    "total_area": r"^[0-9]+([.,][0-9]+)?.*$",
    "irrigated_area": r"^[0-9]+([.,][0-9]+)?.*$",
    "unirrigated_area": r"^[0-9]+([.,][0-9]+)?.*$",
    "registration_date": r"^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}$",
}

# Fields that hold names, and fields that are useless without a digit.
NAME_FIELDS = ("village", "tehsil", "district", "state", "owner_name", "father_or_husband_name", "pargana")
NUMBER_FIELDS = ("survey_number", "khasra_number", "khata_number", "mutation_number", "registration_number")
NORMALISED_NAMES = ("owner_name", "father_or_husband_name", "village", "tehsil", "district", "state")
DATE_FIELDS = ("mutation_date", "registration_date")

# Fields whose reading must hold a digit.
DIGIT_ONLY = (
    "khata_number", "khasra_number", "survey_number", "record_year", "record_date", "mutation_date", "registration_date",
    "total_area", "irrigated_area", "unirrigated_area", "plot_area",
)

# The columns one of which a parcel table must have, the share of ink below which a cell is blank, and what a digit reading must gain.
IDENTIFYING = ("parcel_number", "owner_name")
BLANK_INK, REREAD_GAIN, REREAD_TOP = 0.015, 5.0, 99.0

# Closed vocabularies of two table columns.
VOCABULARIES = {
    "land_classification": (
        "कृषि", "बंजर", "आबादी", "गैर कृषि", "सिंचित", "असिंचित", "जिरायत", "बागायत", "चरागाह", "वन", "परती", "नवीन परती", "ऊसर", "पड़त",
        "तालाब", "रास्ता", "नदी", "आवासीय", "व्यावसायिक", "औद्योगिक", "बाग",
        "agricultural", "barren", "irrigated", "unirrigated", "residential", "commercial", "forest", "pasture", "fallow", "orchard", "waste",
    ),
    "crop": (
        "गेहूँ", "गेहूं", "धान", "अरहर", "चना", "मक्का", "बाजरा", "ज्वार", "सरसों", "गन्ना", "आलू", "मूंग", "उड़द", "तिल", "जौ", "मटर",
        "सोयाबीन", "कपास", "मूंगफली", "बरसीम", "प्याज", "लहसुन", "सब्जी", "दलहन", "तिलहन",
        "wheat", "paddy", "rice", "maize", "sugarcane", "mustard", "gram", "cotton",
    ),
}

# Words of the whole text that tell land class and ownership where no label does.
LAND_CLASSES = (
    "agricultural", "irrigated", "unirrigated", "residential", "commercial", "industrial", "barren", "forest", "pasture", "waste land", "orchard",
    "सिंचित", "असिंचित", "कृषि", "आवासीय", "व्यावसायिक", "बंजर", "वन", "बागायत", "जिरायत",
)
OWNERSHIP_TYPES = ("individual", "joint", "trust", "company", "bhumidhar", "sirdar", "asami", "एकल", "संयुक्त", "सरकारी", "भूमिधर", "सीरदार", "आसामी")

# Phrases of titles that end a value, and labels that end it at a word's beginning.
TITLE_NOISE = (
    "उत्तर प्रदेश शासन", "मध्य प्रदेश शासन", "राजस्थान सरकार", "महाराष्ट्र शासन", "बिहार सरकार", "हरियाणा सरकार", "पंजाब सरकार", "भारत सरकार",
    "राजस्व विभाग", "भूमि अभिलेख", "अधिकार अभिलेख", "खसरा", "खतौनी", "जमाबंदी", "नकल", "प्रपत्र", "फार्म", "लेखपाल", "कानूनगो", "तहसीलदार",
    "ग्राम पंचायत", "government of", "record of rights", "revenue department", "form no",
)
EMBEDDED_LABELS = (
    "फ़सल का विवरण", "फसल का विवरण", "भूमि स्वामी का नाम", "भूस्वामी का नाम", "कृषक का नाम", "क्षेत्रफल", "बीघा-बिस्वा", "खसरा नं", "खसरा संख्या",
    "खसरा क्रमांक", "खाता नं", "खाता संख्या", "तहसील", "जिला", "ग्राम", "पट्टा", "परगना", "वर्ष", "विवरण", "रबी", "खरीफ", "खररीप",
)

# Labels of the fields on forms.
LABELS = {
    "owner_name": ("owner name", "owner", "landowner", "name of owner", "khatedar", "bhumidhar", "malik", "khatedar ka naam", "भूमिधर", "खातेदार", "खातेदार का नाम", "मालिक", "स्वामी", "भूस्वामी", "नाम", "name"),
    "father_or_husband_name": ("father's name", "father name", "s/o", "d/o", "w/o", "pita ka naam", "husband name", "पिता", "पिता का नाम", "पति", "वडिलांचे नाव"),
    "survey_number": ("survey no", "survey number", "survey", "sy no", "s.no", "सर्वे नं", "सर्वे क्रमांक", "सर्वे", "गट नंबर", "gat no", "gat number", "hissa"),
    "khasra_number": ("khasra no", "khasra number", "khasra", "खसरा", "खसरा नं", "खसरा संख्या", "khasra sankhya"),
    "khata_number": ("khata no", "khata number", "khata", "khatauni", "account no", "खाता", "खाता संख्या", "खाता नं", "खतौनी", "खाता क्रमांक", "8-अ"),
    "plot_area": ("area", "plot area", "rakba", "kshetrafal", "रकबा", "क्षेत्रफल", "क्षेत्र"),
    "village": ("village", "gram", "gaon", "mauza", "ग्राम", "गांव", "मौजा", "गाव", "ग्राम का नाम", "गांव का नाम", "village name", "मौजा का नाम", "ग्राम नाम"),
    "tehsil": ("tehsil", "tahsil", "taluka", "taluk", "mandal", "तहसील", "तालुका", "मंडल"),
    "district": ("district", "zila", "jila", "जिला", "जिल्हा", "ज़िला"),
    "state": ("state", "rajya", "राज्य"),
    "land_classification": ("land type", "land classification", "classification", "kism", "bhumi prakar", "land class", "किस्म", "भूमि प्रकार", "भूमि का प्रकार", "जमिनीचा प्रकार", "class"),
    "ownership_type": ("ownership type", "ownership", "tenure", "swamitva", "स्वामित्व", "स्वामित्व प्रकार", "भूमि स्वामित्व"),
    "mutation_number": ("mutation no", "mutation number", "mutation", "namantaran", "dakhil kharij", "नामांतरण", "नामांतरण संख्या", "दाखिल खारिज", "फेरफार", "ferfar"),
    "mutation_date": ("mutation date", "date of mutation", "नामांतरण दिनांक", "फेरफार दिनांक"),
    "registration_number": ("registration no", "registration number", "regn no", "reg no", "document no", "deed no", "पंजीयन संख्या", "पंजीकरण संख्या", "रजिस्ट्री नं", "दस्तावेज क्रमांक"),
    "registration_date": ("registration date", "date of registration", "regn date", "पंजीयन दिनांक", "पंजीकरण दिनांक"),
    "record_year": ("year", "fasli", "record year", "वर्ष", "फसली", "सन", "वित्तीय वर्ष"),
    "pargana": ("pargana", "परगना", "पargana", "circle"),
    "total_area": ("कुल रकबा", "कुल क्षेत्रफल", "कुल रकबबा", "total area", "kul rakba", "योग रकबा", "एकूण क्षेत्र"),
    "irrigated_area": ("सिंचित", "सिंचित क्षेत्र", "irrigated", "sinchit", "बागायत क्षेत्र"),
    "unirrigated_area": ("असिंचित", "असिंचित क्षेत्र", "unirrigated", "asinchit", "जिरायत क्षेत्र"),
    "record_date": ("तारीख", "दिनांक", "date", "tarikh", "दिनाँक"),
    "encumbrance": ("भू-स्वामी / साहूकार", "साहूकार", "ऋण", "बंधक", "encumbrance", "mortgage", "भू-स्वामी साहूकार"),
}

# Column headings of parcel tables.
COLUMNS = {
    "parcel_number": ("खसरा संख्या", "खसरा सं", "खसरा नं", "खसरा क्रमांक", "khasra sankhya", "khasra no", "सर्वे नंबर", "सर्वे क्रमांक", "गट नंबर", "survey no", "survey number", "गट क्र", "भूखंड संख्या", "plot no", "खसरा"),
    "area": ("रकबा", "क्षेत्रफल", "क्षेत्र", "rakba", "area", "kshetrafal", "हे आ बीघा बिस्वा", "एकूण क्षेत्र", "क्षेत्रफळ"),
    "land_classification": ("भूमि का प्रकार", "भूमि प्रकार", "किस्म", "किस्म जमीन", "land type", "प्रकार", "कृषि बंजर आदि", "जमिनीचा प्रकार", "land class", "वर्गीकरण"),
    "crop": ("फसल", "फ़सल", "पीक", "crop", "फसल वर्तमान", "वर्तमान फसल", "पैदावार"),
    "owner_name": ("मालिक का नाम", "मालिक", "खातेदार का नाम", "खातेदार", "भूमिधर", "स्वामी", "owner", "owner name", "भूस्वामी", "मालकाचे नाव", "नाम खातेदार"),
    "possessor_name": ("कब्जेदार का नाम", "कब्जेदार", "काश्तकार", "occupant", "possessor", "कब्ज़ेदार", "कब्जाधारक", "वहिवाटदार"),
    "father_name": ("पिता का नाम", "पिता", "वलद", "father name", "पति का नाम"),
    "share": ("हिस्सा", "अंश", "share", "हिस्सेदारी"),
    "remarks": ("टिप्पणी", "रिमार्क", "remarks", "note", "शेरा", "अभ्युक्ति"),
    "map": ("खसरा मानचित्र", "मानचित्र", "नक्शा", "नक़्शा", "map", "sketch", "नकाशा", "आकृति"),
}

# Words after which no name goes on, roles that follow a name, words between a person and their father, units before a name.
NAME_STOPS = (
    "आत्मज", "आत्मज़", "वलद", "पुत्र", "पिता", "मालिक", "स्वामी", "काश्तकार", "कब्जेदार", "कब्ज़ेदार",
    "भूमि", "भूस्वामी", "कृषक", "खातेदार", "फ़सल", "फसल", "खसरा", "खाता", "क्षेत्रफल",
)
OWNER_ROLES = ("मालिक", "स्वामी", "malik", "swami")
CULTIVATOR_ROLES = ("काश्तकार", "कब्जेदार", "कब्ज़ेदार", "kashtkar", "kabjedar")
FATHER_MARKS = ("आत्मज", "आत्मज़", "वलद", "पुत्र", r"पिता\s*पुत्र")
LEADING_UNITS = ("बीघा", "बिस्वा", "बिंस्वा", "बिंस्वे", "हेक्टेयर", "हे", "एकड़", "एकड", "गुंठा", "ha", "hectare", "acre")

# State names in title bars, and how they are written in records.
STATE_MENTIONS = (
    ("HARYANA", "Haryana"), ("हरियाणा", "हरियाणा"), ("UTTAR PRADESH", "Uttar Pradesh"), ("उत्तर प्रदेश", "उत्तर प्रदेश"),
    ("MADHYA PRADESH", "Madhya Pradesh"), ("मध्य प्रदेश", "मध्य प्रदेश"), ("RAJASTHAN", "Rajasthan"), ("राजस्थान", "राजस्थान"),
    ("MAHARASHTRA", "Maharashtra"), ("महाराष्ट्र", "महाराष्ट्र"), ("BIHAR", "Bihar"), ("बिहार", "बिहार"),
    ("PUNJAB", "Punjab"), ("पंजाब", "पंजाब"), ("GUJARAT", "Gujarat"), ("गुजरात", "गुजरात"),
)

# What stands between label and value, and what ends or leaves a value: rules of dots, seals at the end, punctuation at the edges.
SEPARATOR = r"\s*[:;|：ः]\s*|\s+[-–—=]+\s*|\s{3,}"
FILL_IN = "[_.\\-–—~`'\"]{2,}"
SEALS = r"\s+[*×★•·`'" + '"' + r"“”‘’]+.*$"
EDGES = " .,;:_-–—|\"'()*×★•·“”‘’`"
LATIN_WORD = r"(?U)(?<!\S)[A-Za-z]+(?!\S)"

# Fields whose value is a figure with a unit, or a date; units after a figure; strokes that are a figure one read wrongly.
FIGURE_FIELDS = ("total_area", "irrigated_area", "unirrigated_area", "plot_area")
DATE_VALUES = ("record_date", "mutation_date", "registration_date")
FIGURE_UNIT = r"(?i)(हेक्टेयर|हे|एकड़|बीघा|बिस्वा|गुंठा|ha|acre|bigha|biswa)\.?"
STROKES = "|[]()!lI/\\।ा"

# Columns of the record export, the size limit of an upload, how many go up at once, and their kinds.
RECORD_COLUMNS = (
    "id", "document_id", "state", "district", "tehsil", "village", "survey_number", "khasra_number", "khata_number", "plot_area_value", "plot_area_unit", "plot_area_sqm",
    "land_classification", "owner_name", "father_or_husband_name", "ownership_type", "mutation_number", "mutation_date", "registration_number", "registration_date",
    "record_year", "is_verified", "verified_at",
)
MAX_BYTES, MAX_FILES = 25 * 1024 * 1024, 20
UPLOAD_KINDS = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "pdf")

# Fields of a record that come from readings, and those that only its extra map holds.
RECORD_FIELDS = (
    "state", "district", "tehsil", "village", "survey_number", "khasra_number", "khata_number", "land_classification", "owner_name", "father_or_husband_name",
    "ownership_type", "mutation_number", "mutation_date", "registration_number", "registration_date", "record_year",
)
EXTRA_FIELDS = ("pargana", "total_area", "irrigated_area", "unirrigated_area", "record_date", "encumbrance")

# Fields that values are suggested for.
SUGGESTED = ("state", "district", "tehsil", "village", "land_classification", "ownership_type", "owner_name", "father_or_husband_name", "khata_number", "record_year")

# Text columns of parcels that learned corrections apply to.
PARCEL_TEXTS = ("land_classification", "crop", "owner_name", "possessor_name", "father_name", "share", "remarks")

# Thresholds of confidence and similarity.
AUTO_ACCEPT, REVIEW, DUPLICATE_SIMILARITY, OWNER_SIMILARITY = 85.0, 60.0, 90.0, 85.0
