"""Word lists, patterns and constants of the labelling domain.

Everything in this module is a fixed value: results depend on these words,
patterns and numbers being exactly as stated.
"""

# --- fixed values: characters -------------------------------------------------
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
DEVANAGARI_DIGITS = "०१२३४५६७८९"
RUPEE = "₹"
DIGIT_CLASS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"

# --- fixed values: statuses ---------------------------------------------------
PASS, FAIL = "PASS", "FAIL"
MANUAL_REVIEW, NOT_APPLICABLE = "MANUAL_REVIEW", "NOT_APPLICABLE"
RULE_FAILURE = "Internal rule execution failure: "
COMPLIANT, NON_COMPLIANT, PARTIAL = "COMPLIANT", "NON_COMPLIANT", "PARTIAL"
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
EVIDENCE_SOURCES = ["STRUCTURED_INPUT", "OCR", "IMAGE_ANALYSIS", "USER_INPUT", "UNKNOWN"]

# --- fixed values: months -----------------------------------------------------
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]
MONTH_WORDS = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
    r"aug(?:us|ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)

# --- fixed values: quantity units ---------------------------------------------
QUANTITY_CATEGORIES = [
    ("AREA", r"(?iU)\b(sq m|sq cm|sq meter|square meter)\b"),
    ("WEIGHT", r"(?iU)\b(g|gram|grams|kg|kilogram|kilograms|mg|milligram)\b"),
    ("VOLUME", r"(?iU)\b(ml|milliliter|millilitres|l|liter|liters|litre|litres|cl)\b"),
    ("LENGTH", r"(?iU)\b(m|meter|meters|cm|centimeter|mm|millimeter)\b"),
    ("NUMBER_OR_UNIT", r"(?iU)\b(n|units|pcs|pieces|count|items|no|number)\b"),
]
UNITS = r"(?:g|kg|ml|l|gm|gms|gram|grams|ltr|liter|litres|liters)"
NET_WORDS = (
    r"(?:Net\s*(?:Qty|Quantity|Wt|Weight|Vol|Volume|Content|Contents)|"
    r"Nett\s*(?:Qty|Quantity|Wt|Weight))"
)
NET_LABEL = r"(?iU)\b" + NET_WORDS + r"\b"
NET_CONTEXT = (
    r"(?iU)\b(?:net\s*(?:qty|quantity|wt|weight|vol|volume|content|contents)|"
    r"nett\s*(?:qty|quantity|wt|weight)|net\s+content)\b"
)
BARE_QUANTITY = (
    r"(?iU)^\s*\d+(?:\.\d+)?\s*(?:g|kg|ml|l|gm|gms|gram|grams|ltr|liter|litres|liters|pcs|units|n)\s*$"
)
NET_LABELLED_VALUE = (
    r"(?iU)" + NET_WORDS + r"\s*[:\.-]?\s*"
    r"(\d+(?:\.\d+)?\s*(?:g|kg|ml|l|gm|gms|gram|grams|g\.?|kg\.?|ml\.?|l\.?|ltr|liter|litres|liters|pcs|units|n))\b"
)
NET_GENERIC_VALUE = (
    r"(?iU)\b(\d+(?:\.\d+)?\s*(?:g|kg|ml|l|gm|gms|gram|grams|kg\.?|ml\.?|ltr|liter|litres|liters))\b"
)
NET_PROMO_VALUE = (
    r"(?iUd)\d+(?:\.\d+)?\s*" + UNITS + r"\s*(?:\+|plus).*?[=:]\s*(\d+(?:\.\d+)?\s*" + UNITS + r")"
)
COUNT_LABEL = r"(?iU)\b(?:Number\s+of\s+Units?|Units?|Quantity)\b"
COUNT_VALUE = r"(?iU)\b(\d+\s*N|\d+\s+units?|\d+\s+pcs?)\b"
NET_SKIP_UNIT_PRICE = r"(?iU)\b(?:unit\s+sale\s+price|unit\s+price|sale\s+price\s+per)\b"
NET_EXCLUDE_UNIT_PRICE = (
    r"(?iU)\b(?:unit\s+sale\s+price|unit\s+price|sale\s+price\s+per\s+unit|price\s+per)\b"
)
NET_EXCLUDE_WORDS = ["mrp", "rs", "₹", "date", "batch", "lot"]

# --- fixed values: MRP --------------------------------------------------------
MRP_LABEL = (
    r"(?iU)(?:MRP|M\.?\s*R\.?\s*P\.?|Max(?:imum)?\s*Ret(?:ail)?\s*P[a-z]{0,4}e?|"
    r"Ret(?:ail)?\s*P[a-z]{0,4}e?)"
)
MRP_PRICE = r"(?U)(\d+(?:[\.,]\d{1,2}|\s+\d{2})?)"
MRP_PRICE_TWO_DIGITS = r"(?U)(?<!\d)(\d{2,}(?:[\.,]\d{1,2}|\s+\d{2})?)(?!\d|/\d)"
MRP_GLUED_PRICE = r"(?U)(?<!\d)(\d{2,}\.\d{2})(?=\d{2}/\d{2,4})"
MRP_INLINE_VALUE = (
    r"(?iU)^\s*[:\.-]?\s*(?:Rs\.?|₹|INR)?\s*\d+(?:[\.,]\d{1,2}|\s+\d{2})?"
    r"(?:\s*[\(\)]?\s*(?:incl|inclusive|nclusive)[^\n\r]{0,35}?(?:taxes?|tax)?\s*[\(\)]?)?"
)
MRP_SKIP_NEIGHBOUR = (
    r"(?iU)\b(?:phone|tel|date|batch|licen[cs]e|ean|upc)\b|\d{3,}[-\s]\d{3,}"
)
MRP_TAX_WORDS = r"(?iU)(?:\b|(?<=\d))(?:nclusive|inclusive|incl|tax|taxes)\b"
MRP_TAX_SUFFIX = " (inclusive of all taxes)"
MRP_MIN_CONFIDENCE = 0.35
TAX_CLAUSES = [
    "incl. of all taxes", "inclusive of all taxes", "incl of all taxes", "incl. taxes",
    "inclusive of taxes", "सब कर सहित", "सभी करों सहित", "कर सहित", "कर सहित मूल्य",
]

# --- fixed values: rule constants ---------------------------------------------
PINCODE = r"(?U)\b[1-9]\d{2}\s?\d{3}\b"
VALID_MONTHS = (
    [str(i) for i in range(1, 13)]
    + [f"{i:02d}" for i in range(1, 10)]
    + [m[:3] for m in MONTH_NAMES]
    + MONTH_NAMES
)
UNIT_PRICE_PATTERNS = [
    r"(?iU)(?:₹|rs\.?|inr)\s*\d+(?:\.\d+)?\s*(?:/|per)\s*"
    r"(?:g|gram|kg|kilogram|ml|l|liter|litre|m|cm|n|unit|piece)",
    r"(?iU)unit\s*(?:sale\s*)?price\s*:?\s*(?:₹|rs\.?|inr)?\s*\d+",
]
EXPIRY_PATTERNS = [
    r"(?iU)\bbest\s*before\s*:?\s*\d+\s*(?:months?|years?|days?)\b",
    r"(?iU)\bexp(?:iry)?\s*(?:date)?\s*:?\s*(?:0?[1-9]|1[0-2])[/\.-]\d{2,4}\b",
    r"(?iU)\buse\s*by\s*:?\s*(?:0?[1-9]|1[0-2])[/\.-]\d{2,4}\b",
    r"(?iU)\b(?:0?[1-9]|1[0-2])[/\.-](?:20\d{2}|\d{4})\b",
]
PERISHABLE_TYPES = [
    "food", "cosmetics", "pharma", "pharmaceuticals", "drug", "drugs", "beverage", "beverages",
]
PANEL_WORDS = ["PDP", "FRONT", "PRINCIPAL", "PRINCIPAL DISPLAY PANEL", "MAIN PANEL"]
MIN_FONT_MM = 1.0
CONTRAST_GOOD, CONTRAST_BAD = 4.5, 3.0

# --- fixed values: block and image thresholds ----------------------------------
MIN_BLOCK_CONFIDENCE = 0.10
SAME_ROW_OVERLAP = 0.5
MAX_DISTANCE = 180
MAX_DATE_DISTANCE = 150
NEARBY_GAP = 80
ANCHOR_GAP = 60
RIGHT_GAP = 60
MAX_IMAGE_BYTES = 10 * 1024 * 1024
MAX_IMAGES = 4

# --- fixed values: unit price ---------------------------------------------------
UNIT_PRICE_NUMBER = r"(?U)(\d+(?:[.,]\d{1,2})?)"
UNIT_PRICE_UNIT = r"(?iU)/\s*(100\s*g|100\s*ml|kg|g\b|l\b|ml\b|unit)"
UNIT_PRICE_LABEL = (
    r"(?iU)(?:Unit\s+Sale\s+Price|Unit\s+Price|Sale\s+Price\s+per\s+Unit|"
    r"Price\s+per\s+(?:unit|100\s*g|100\s*ml|kg|g\b|l\b|ml\b)|"
    r"Rs\.?/?(?:100\s*g|100\s*ml|kg|g\b|l\b|ml\b)|"
    r"₹/?(?:100\s*g|100\s*ml|kg|g\b|l\b|ml\b))\s*[:\.-]?\s*"
)
UNIT_PRICE_VALUE = (
    r"(?iU)^(?:Rs\.?|₹|INR)?\s*(\d+(?:[\.,]\d{1,2})?)"
    r"(?:\s*/\s*(?:100\s*g|100\s*ml|kg|g\b|l\b|ml\b|unit))?"
)
QUANTITY_ONLY = (
    r"(?iU)^\s*\d+(?:\.\d+)?\s*"
    r"(?:g|kg|ml|l|gm|gms|gram|grams|ltr|liter|litres|liters|pcs|units?|n)\s*$"
)

# --- fixed values: dates --------------------------------------------------------
DATE_TAIL = (
    r"(?:([0-3]?\d)[/\.\-\s]+)?(" + MONTH_WORDS + r"|[0-1]?\d)[/\.\-\s]+(20\d{2}|\d{2}(?!\d))"
)
DATE_VALUE = r"(?iU)\b" + DATE_TAIL + r"\b"
MADE_DATE = (
    r"(?iU)(?:(?:Month\s*(?:and|&)?\s*Year\s*of|Date\s*of|Month/Year\s*of)\s*)?"
    r"(?:Manu[a-z]+|Manuf[a-z]*|Mfg(?:\s+Date)?|Mfd(?:\s+Date)?|Pack[a-z]*|Pkd|DOM|DOP|Packing|Manufacture)"
    r"(?!\s*\.?\s*(?:no|use\s*before|usebefore|exp|expiry|best\s*before))\s*[:\.-]?\s*" + DATE_TAIL
)
MADE_LABEL = (
    r"(?iU)\b(?:Month\s*(?:and|&)?\s*Year\s*of\s*(?:Manui?a?cl?ure|Manufacture|Packing)|"
    r"Date\s*of\s*(?:Manufacture|Packing)|Mfg(?:\s+Date)?|Mfd(?:\s+Date)?|DOM|DOP|Pkd(?:\s+Date)?)\b"
)
EXPIRY_OR_BATCH = (
    r"(?iU)\b(?:exp|expiry|best\s+before|use\s+by|use\s+before|usebefore|batch|lot|b\.?\s*no)\b"
)
EXPIRY_INLINE = (
    r"(?iU)(?:Expir(?:y|ed)?(?:\s+Date)?|Exp(?:\.)?(?:\s+Date)?|Use\s+(?:Before|By)|"
    r"Best\s+Before(?:\s+End)?|BBE|BB)\s*[:\.-]?\s*" + DATE_TAIL
)
EXPIRY_CONTEXT = (
    r"(?iU)\b(?:exp(?:ir(?:y|ed))?(?:\s+date)?|use\s+(?:before|by)|best\s+before(?:\s+end)?|bbe|bb)\b"
)
MADE_ONLY_CONTEXT = r"(?iU)\b(?:mfg|mfd|manufacture(?:d|r)?|packing|packed|pkd|dom|dop)\b"
BATCH_ONLY_LINE = r"(?iU)^\s*(?:batch|lot|b\.?\s*no)[^\d]*[A-Z0-9]+\s*$"
LOOK_BACK = 30

# --- fixed values: batch --------------------------------------------------------
BATCH_LABEL = (
    r"(?iU)\b(?:for\s+batch(?:\s+no\.?|\s+number)?|batch(?:\s*/\s*lot)?(?:\s+no\.?|\s+number)?|"
    r"lot(?:\s*/\s*batch)?(?:\s+no\.?|\s+number)?|b\.?\s*no\.?)\s*[:.\-–—]*\s*"
)
BATCH_STOP = (
    r"(?iU)(?:\s+(?:mfg|mfd|manufactur[a-z]*|pkd|pack[a-z]*|exp(?:ir[a-z]*)?|best\s+before|"
    r"use\s+(?:by|before)|bbe|mrp|rs\.?|inr|₹|net\s*(?:qty|quantity|wt|weight|vol|volume|content)|"
    r"unit\s+sale|usp|fssai|lic\.?\s*no|licen[cs]e|date|dom|dop)\b"
    r"|\s+\d{1,2}[/\.-]\d{2,4}\b|\s+(?:see\b|refer\b|read\b|below\b|above\b))"
)
BATCH_TRIM = " :.,-–—#/\\"
BATCH_INSTRUCTION = (
    r"(?iU)^\s*(?:see\b|refer\b|read\b|printed\b|check\b|on\s+crimp|on\s+cap|on\s+neck|on\s+pack|"
    r"on\s+bottle|at\s+bottom|below\b|above\b|for\s+mfg|read\s+first\s+character)"
)
BATCH_DATE = r"(?U)^(?:[0-3]?\d[/\.-])?[0-1]?\d[/\.-](?:20\d{2}|\d{2})$"
BATCH_PRICE = r"(?iU)^(?:rs\.?|inr|₹)?\s*\d+(?:\.\d{1,2})?(?:/-)?$"
BATCH_QUANTITY = r"(?iU)^\d+(?:\.\d+)?\s*(?:g|gm|gms|kg|ml|l|ltr|n|u|piece|count)$"
BATCH_FUSED_WORD = r"(?iU)\b(?:mfg|mfd|exp|pkd|mrp|fssai)\b"
BATCH_FUSED_SPLIT = r"(?iU)[/,\s]+(?:mfg|mfd|exp|pkd|mrp|fssai)\b"

# --- fixed values: contact details -------------------------------------------------
TOLL_FREE = r"(?U)\b1800(?:[-\s]?\d{2,4}){2,4}\b"
MOBILE = r"(?U)\b(?:\+?91[-\s]?)?[6-9]\d{9}\b"
LANDLINE = r"(?U)\b(?:0\d{2,4}|\+?91[-\s]?\d{2,4})[-\s]\d{6,8}\b|\b\d{3,5}[-\s]\d{6,8}\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
WEBSITE = r"(?iU)\b(?:www\.[a-zA-Z0-9-]+\.[a-zA-Z]{2,}|[a-zA-Z0-9-]+\.(?:com|in|org|net))\b"
REGULATORY_CONTEXT = (
    r"(?iU)\b(?:lic|lic\.?\s*no|licence|license|fssai|fssat|ean|upc|barcode|pin|pincode|model|"
    r"batch|lot|date|mrp)\b"
)
CARE_PHONE_BLOCK = (
    r"(?iU)\b(?:telephone|phone|tel|customer\s*care|consumer\s*care|care\s*cell|helpline|call)\b"
    r"\s*[:.-]?\s*([+\d\s-]{7,15})"
)
CARE_PHONE_TEXT = r"(?iU)\b(?:telephone|phone|tel|helpline)\b\s*[:.-]?\s*([+\d\s-]{7,15})"
CARE_LABEL = (
    r"(?iU)\b(?:consumer\s*care|customer\s*care|care\s*cell|customer\s*complaints?|"
    r"consumer\s*complaints?|contact\s*us|feedback|telephone|phone|tel|helpline|toll\s*free|email|"
    r"e[- ]?mail|website|web\s*site|visit\s*us)\b"
)
CONTACT_REPAIRS = [
    (r"(?U)\s+([.@])\s+", "$1"),
    (r"(?iU)\s+at\s+", "@"),
    (r"(?iU)\b(?:ac|at)\s+(?=[a-z0-9._%+-]+\s*@)", ""),
    (r"(?U)\s+@", "@"),
    (r"(?iU)(?<=@)([A-Za-z0-9._%+-]+)\s+(com|in|org|net)\b", "$1.$2"),
]

# --- fixed values: companies and addresses ------------------------------------------
COMPANY_SUFFIX = (
    r"(?iUd)^(.*?Pvt\.?\s*Ltd\.?|.*?Private\s+Limited|.*?Ltd\.?|.*?Limited|.*?Inc\.?|.*?LLP|"
    r".*?Corp\.?|.*?Corporation|.*?Industries|.*?Solutions|.*?Enterprises|.*?Foods)\s*(.*)$"
)
COMPANY_WORDS = (
    r"(?iU)Pvt\.?\s*Ltd|Private\s+Limited|Ltd|Limited|Inc|LLP|Corp|Industries|Solutions|Enterprises|Foods"
)
ADDRESS_WORDS = [
    "road", "street", "ind", "area", "dist", "state", "pin", "pincode", "plot", "no", "nagar",
    "sector", "post", "bhavan", "building", "floor", "mouza", "city", "flat", "lane", "marg",
    "colony", "pradesh", "bengal", "maharashtra", "karnataka", "delhi", "haryana", "gujarat",
    "tamil nadu", "telangana", "kerala", "punjab", "nh-", "po", "tq", "distt", "howrah",
    "bangalore", "bengaluru", "mumbai", "chennai", "kolkata", "hyderabad",
]
# words of up to three characters count only as whole words
ADDRESS_PATTERN = "(?U)" + "|".join(
    rf"\b{w}\b" if len(w) <= 3 else w for w in ADDRESS_WORDS
)
TRADEMARK_WORDS = ["tm owners", "tm owner", "trademark owner", "trademark owners", "brand owner"]
ALLERGEN_WORDS = [
    "facility", "may process", "allergen", "equipment", "may contain", "processed in",
]
COMPANY_REJECT = (
    r"(?iU)\b(?:https?://|www\.)|\b[a-z0-9-]+\.(?:com|org|net|gov|edu|io|co|ai)\b|"
    r"\b(?:use|see|incl|price|batch|mfd|mrp|product|before|belore|net\s*qty|net\s*wt)\b"
)
COMPANY_REJECT_START = (
    r"(?iU)^(?:e[- ]?mail|telephone|phone|contact|customer\s+care|consumer\s+complaints|website)\b|"
    r"^(?:registered|regd|factory|plant|mfg|manufacturing)?\s*address\b"
)
ROLE_MAKER = [
    "manufactured by", "mfg by", "mfd by", "mfg. by", "mfd. by", "mfg/pack", "mfg / pack",
    "mfg/pkd", "mfg & pack", "made in", "made by", "produced by", "manufacturer",
    "factory address", "manufacturing unit",
]
ROLE_MARKETER = [
    "marketed by", "marketed for", "mkd by", "marketer", "packed by", "pkd by", "imported by",
    "packer",
]
ROLE_OFFICE = [
    "regd office", "regd. office", "registered address", "registered office",
    "manufactured for", "mfd for", "mfd. for",
]
MAKER_LINE = (
    r"(?iUd)(?:(?:Manufacturer|Packer|Manufactured|Marketed)\s*[:./-]+|"
    r"(?:Manufactured\s+(?:by|for|in)|Mfg[./\s]*(?:by|for|pack|packed|pkd)|"
    r"Mfd[./\s]*(?:by|for|pack|packed|pkd)|Made\s+(?:in\s+[A-Za-z]+\s+)?by|Packed\s+by|Pkd\s+by|"
    r"Marketed\s+(?:by|for)|Mkd\s+by|Manufacturer\s+Name)\s*[:./-]?)\s*(.+)"
)
ADDRESS_LINE = (
    r"(?iUd)(?:Registered\s+Address|Regd\.?\s+(?:Address|Office)|Factory\s+Address|Mfg\.\s+Address|"
    r"Plant\s+Address|Address|Corp\.?\s+Office)\s*[:\.-]?\s*(.+)"
)
SECTION_HEADER = (
    r"(?iU)(?:Registered\s+Address|Regd\.?\s*(?:Address|Office)|Factory\s+Address|"
    r"(?:Manufacturer|Packer|Manufactured|Marketed)\s*[:./-]+|"
    r"(?:Manufactured\s+(?:by|for|in)|Mfg[./\s]*(?:by|for|pack|packed|pkd)|"
    r"Mfd[./\s]*(?:by|for|pack|packed|pkd)|Packed\s+by|Pkd\s+by|Marketed\s+(?:by|for)|Mkd\s+by|"
    r"Made\s+in\s+[A-Za-z\s]+by|Manufacturer\s+Name)\s*[:./-]?)"
)
INLINE_LEFTOVER = (
    r"(?iU)^(?:[/:.-]|\b(?:regd|mfd|mfg|pack|pkd)[./\s]*"
    r"(?:office|address|by|for|pack|packed|pkd)[/:.-]?\s*)+"
)
MAKER_ANCHOR = (
    r"(?iU)\b(?:manufactured?\s+by|mfg[./\s]*(?:by|for|pack|packed|pkd)|mfd[./\s]*(?:by|for)|"
    r"packed\s+by|pkd\s+by|marketed\s+by|mkd\s+by|manufacturer|packer|"
    r"regd[./\s]*(?:office|ofce|offce)|ofce\b|registered\s+address|factory\s+address|"
    r"manufacturing\s+unit|in\s+[A-Za-z]{3,20}\s+by)\b"
)
LICENCE_LINE = r"(?iU)\b(?:fssai|fssat|lic|licence|license)\b"
LICENCE_OR_ARTICLE = r"(?iU)\b(?:fssai|fssat|lic|licence|license|art\.?\s*\d+)\b"
NAME_CONTINUATION_WORDS = [
    "international", "services", "india", "private", "limited", "technologies", "solutions",
]
STATUTORY_TARGETS = [
    ("manufactured", 4), ("manufacturer", 4), ("marketed", 3), ("marketer", 3),
    ("packed", 3), ("packer", 3), ("registered", 2),
]
CORRUPTED_LABEL = r"(?iU)\b([a-z]{4,15})\s*(?:by|bv|bi|for|[:.-])"
CORRUPTED_LABEL_TAIL = r"(?iU)^\s*(?:by|bv|bi|for)?\s*[:.-]?"
CORRUPTED_MIN_RATIO = 0.70

BOUNDARY_KEYWORDS = (
    r"(?iU)\s*(?:For\s+customer|Customer\s*Care|Care\s*Cell|Telephone|Phone|Tel|Email|Contact|"
    r"Net\s*Qty|Net\s*Wt|For\s+Batch|Batch|EAN|UPC|Model|Imported|Month\s*and\s*Year|Month|Date|"
    r"Storage|Store\s+in|Directions|Warning|Caution|Ingredients|Nutrition|Do\s+not\s+accept|USP|MRP|"
    r"FSSAI|Lic\.?\s*No|Licence|License|TM\s*Owner|Trademark\s*Owner|"
    r"For\s+(?:mfg|manufacturing)\s+unit|Read\s+first\s+character)\b"
)

# --- fixed values: label dictionary ---------------------------------------------------
CANONICAL_LABELS = {
    "PRODUCT_NAME": [
        "common generic name", "generic name", "name of commodity", "commodity name",
        "common genaric name", "common genenc name", "product name",
    ],
    "MANUFACTURER": [
        "manufactured by", "manufactured for", "manufactured in", "mfd by", "mfd for", "mfg by",
        "mfg for", "mfg/pack", "mfg / pack", "mfg/pkd", "mfg & pack", "made by", "produced by",
        "manufacturer", "mfg unit", "factory address",
    ],
    "MARKETED_BY": ["marketed by", "marketed for", "marketed in", "mkd by", "marketer"],
    "PACKER": ["packed by", "packed for", "packed in", "packed", "pkd by", "packer"],
    "IMPORTER": [
        "imported by", "imported in", "importer", "importer name", "import & marketed by",
        "imp by", "imported for",
    ],
    "REGISTERED_ADDRESS": [
        "registered address", "regd office", "regd address", "factory address",
        "manufacturing address", "plant address", "corp office", "corporate office",
        "manufacturing unit", "unit address",
    ],
    "NET_QUANTITY": [
        "net quantity", "net qty", "net weight", "net wt", "net volume", "net vol",
        "net content", "net contents", "number of units", "quantity",
    ],
    "MRP": [
        "mrp", "maximum retail price", "max retail price", "retail price",
        "mrp incl of all taxes", "mrp inclusive of all taxes",
    ],
    "UNIT_SALE_PRICE": ["unit sale price", "usp"],
    "MANUFACTURE_DATE": [
        "month and year of manufacture", "mfg date", "mfd date", "date of manufacture", "dom",
        "manufacture date", "manufactured date",
    ],
    "PACKING_DATE": [
        "month and year of packing", "packed on", "packing date", "pkd date", "dop",
    ],
    "EXPIRY_DATE": [
        "expiry date", "exp date", "date of expiry", "best before", "use by", "use before",
    ],
    "BATCH_NUMBER": ["for batch no", "batch no", "batch number", "batch", "lot no", "lot number"],
    "CONSUMER_CARE": [
        "consumer care", "customer care", "care cell", "consumer complaints",
        "customer complaints", "telephone", "phone", "email", "contact us", "feedback",
        "toll free", "helpline",
    ],
    "COUNTRY_OF_ORIGIN": [
        "country of origin", "country oi origin", "product of", "made in", "origin of",
    ],
    "MODEL_NUMBER": ["model number", "model no", "mocel number"],
    "REGULATORY_LICENSE": [
        "lic no", "licence no", "license no", "fssai lic", "fssai", "fssat lic", "fssat",
        "licence", "license",
    ],
    "STORAGE_INSTRUCTIONS": [
        "storage instructions", "storage conditions", "store in a cool", "storage instruction",
    ],
    "USAGE_DIRECTIONS": [
        "directions for use", "how to use", "stir well before use", "serving suggestion",
        "directions",
    ],
    "WARNINGS_ADVISORIES": [
        "allergen advice", "allergen information", "warning", "caution",
        "do not accept if seal is tampered",
    ],
    "INGREDIENTS_NUTRITION": [
        "ingredients", "nutritional information", "nutrition facts", "composition",
    ],
    "CODES_AND_BARCODES": ["ean", "upc", "barcode"],
    "TRADEMARK_OWNER": ["tm owner", "tm owners", "trademark owner", "brand owner"],
    "BATCH_INSTRUCTIONS": [
        "for manufacturing unit address read first character", "for mfg unit address read",
        "read first character",
    ],
}
LABEL_FUZZY_RATIO = 0.82
LABEL_FUZZY_LENGTH = 8
BOUNDARY_CONCEPTS = [
    "MODEL_NUMBER", "COUNTRY_OF_ORIGIN", "PRODUCT_NAME", "NET_QUANTITY", "MRP",
    "MANUFACTURE_DATE", "PACKING_DATE", "CONSUMER_CARE", "BATCH_NUMBER",
    "STORAGE_INSTRUCTIONS", "USAGE_DIRECTIONS", "WARNINGS_ADVISORIES",
    "INGREDIENTS_NUTRITION", "EXPIRY_DATE", "UNIT_SALE_PRICE", "CODES_AND_BARCODES",
    "REGULATORY_LICENSE", "TRADEMARK_OWNER", "BATCH_INSTRUCTIONS",
]
SECTION_BOUNDARY = (
    r"(?iU)^\s*(?:for\s+batch(?:\s+no\.?)?|batch(?:\s+no\.?|\s+number)?|lot(?:\s+no\.?|\s+number)?|"
    r"mrp\b|maximum\s+retail\s+price|max\.?\s*retail|retail\s+price|"
    r"month\s+(?:and|&)?\s*year|mfg\.?\s*(?:date)?|mfd\.?\s*(?:date)?|date\s+of|dom\b|dop\b|"
    r"expiry(?:\s+date)?|exp\.?\s*(?:date)?|best\s+before|use\s+by|use\s+before|"
    r"net\s*(?:qty|quantity|wt|weight|vol|volume|content|contents)|number\s+of\s+units?|"
    r"unit\s+sale\s+price|usp\b|"
    r"storage\s+instructions?|store\s+in\s+a\s+cool|storage\b|"
    r"directions\s+for\s+use|how\s+to\s+use|serving\s+suggestion|stir\s+well|directions\b|"
    r"allergen(?:\s+advice|\s+warning|\s+information)?|warning\b|caution\b|do\s+not\s+accept\s+if|"
    r"ingredients\b|nutritional\s+information|nutrition\s+facts|composition\b|"
    r"consumer\s*care|customer\s*care|care\s*cell|customer\s*complaints?|contact\s*us|feedback\b|"
    r"telephone\b|phone\b|email\b|toll\s*free|helpline\b|"
    r"country\s+(?:of|oi)\s+origin|product\s+of|made\s+in\b|"
    r"model\s+(?:number|no\.?)|mocel\s+(?:number|no\.?)|ean\b|upc\b|barcode\b|"
    r"common\s+(?:generic|genaric|genenc)\s+name|generic\s+name|commodity\s+name|name\s+of\s+commodity|"
    r"fssai\b|fssat\b|lic\.?\s*no\.?|licen[cs]e(?:\s+no\.?)?|"
    r"tm\s+owners?|trademark\s+owner|brand\s+owner|"
    r"for\s+(?:mfg|manufacturing)\s+unit(?:\s+address)?|read\s+first\s+character)\b"
)
FIELD_LABEL = (
    r"(?iU)^\s*(?:model(?:\s+number|\s+no\.?)?|mocel(?:\s+number|\s+no\.?)?|"
    r"country(?:\s+(?:of|oi)\s+origin)?|"
    r"common\s+(?:genaric|generic|genenc)\s+name|generic\s+name|commodity\s+name|name\s+of\s+commodity|"
    r"number\s+of\s+units?|month\s+(?:and|&)?\s*year|maximum\s+retail\s+price|max\.?\s*retail\s*price|mrp|"
    r"telephone|phone|email(?:\s+address)?|registered\s+address|regd\.?\s*office|"
    r"marketed\s+by|manufactured\s+by|mfg[./\s]*(?:by|for|pack|packed|pkd)?|mfd[./\s]*(?:by|for|pack|packed|pkd)?|"
    r"packed[.\s]*(?:by)?|pkd[.\s]*(?:by)?|imported\s+by|manufacturer|packer|"
    r"net\s+(?:quantity|weight|vol|volume|content|contents|qty|wt)|"
    r"for\s+batch(?:\s+no\.?)?|batch(?:\s+number|\s+no\.?)?|lot(?:\s+no\.?)?|"
    r"storage\s+instructions?|directions\s+for\s+use|allergen\s+advice|ingredients|best\s+before|expiry\s+date|"
    r"fssai(?:\s+lic)?|lic\.?\s*no\.?|licen[cs]e|tm\s+owners?|trademark\s+owner)\s*[:.-]?\s*$"
)

# --- fixed values: statutory declarations ------------------------------------------------
STATUTORY = (
    r"(?iU)\b(?:mrp|maximum\s+retail\s+price|max\s+retail\s+price|retail\s+price|"
    r"incl(?:usive)?\s+of\s+all\s+taxes|"
    r"net\s*(?:qty|quantity|wt|weight|vol|volume|content|contents)|"
    r"number\s+of\s+units\s*\(\s*quantity\s*\)|"
    r"manufactured\s+(?:by|for|in)|mfd[./\s]*(?:by|for|pack|pkd)|mfg[./\s]*(?:by|for|pack|pkd|unit)|"
    r"manufacturer(?:\s+name)?|made\s+in|produced\s+by|factory\s+address|"
    r"marketed\s+(?:by|for|in)|mkd[./\s]*by|marketer|"
    r"packed\s+(?:by|for|in)|pkd[./\s]*by|packer|"
    r"imported\s+(?:by|for|in)|importer(?:\s+name)?|imp[./\s]*by|"
    r"reg(?:istered|d)?\.?\s+(?:office|address)|corp(?:orate)?\.?\s+office|"
    r"(?:month\s+and\s+year\s+of\s+)?(?:manufacture|mfg|mfd)\b|"
    r"(?:month\s+and\s+year\s+of\s+)?(?:packing|pkd|packaging)\b|"
    r"packed\s+on|date\s+of\s+(?:manufacture|packing|packaging|expiry)|"
    r"expiry(?:\s+date)?|exp[./\s]*(?:date)?|use\s+(?:by|before)|best\s+before|"
    r"for\s+batch\s+no|batch(?:\s+no|\s+number)?|lot(?:\s+no|\s+number)?|b\.?\s*no\.?|"
    r"consumer\s+care|customer\s+care|care\s+cell|consumer\s+complaints|customer\s+complaints|"
    r"toll\s*free|helpline|contact\s+us|country\s+o[fi]\s+origin|unit\s+sale\s+price|usp\b)\b"
)
NON_STATUTORY = (
    r"(?iU)\b(?:product\s+name|generic\s+name|commodity\s+name|steps\s+for|how\s+to\s+use|"
    r"directions\s+for\s+use|warning|caution|paraben\s*free|dermatologically|hypoallergenic|"
    r"skin\s+compatibility)\b"
)

# --- fixed values: country of origin --------------------------------------------------------
COUNTRIES = [
    "india", "germany", "china", "japan", "korea", "nepal", "bhutan", "bangladesh", "pakistan",
    "thailand", "vietnam", "indonesia", "malaysia", "singapore", "usa", "canada", "australia",
    "france", "italy", "spain", "united kingdom", "united states",
]
COUNTRY_INVALID = ["international", "origin", "country", "common", "generic", "name", "by", "for"]
COUNTRY_SHAPE = r"^[A-Za-z]{3,30}(?:\s+[A-Za-z]{2,20}){0,2}$"
COUNTRY_TRIM = " .,:;-"
COUNTRY_RATIO = 0.65
COUNTRY_LABEL_LOOSE = r"\bcoun[a-z]*\s+(?:of|oi|o)?\s*ori[a-z]*\b"
COUNTRY_LABEL_INLINE = r"(?iUd)(?:country\s+(?:of|oi)\s+origin)\s*[:.-]?\s*(.*)$"
ORIGIN_TEXT = (
    r"(?iU)(?:Product\s+of|Country\s+(?:of|oi)\s+Origin|Made\s+in|Produced\s+in|Manufactured\s+in)"
    r"\s*[:\.-]?\s*([A-Za-z\s]{3,30})\b"
)
ORIGIN_INLINE = r"(?iU)\b(?:product\s+of|made\s+in|produced\s+in|manufactured\s+in)\b"
ORIGIN_FRAGMENT = (
    r"(?iU)\b(?:PRODUCT\s+OF|MADE\s+IN|PRODUCED\s+IN|MANUFACTURED\s+IN)\s*([A-Za-z]{3,30})\b"
)
ORIGIN_PREFIX = r"(?i)^(?:product|made|produced|manufactured)$"
ORIGIN_PREFIX_WORD = r"(?iU)\b(product|made|produced|manufactured)\b"
ORIGIN_GLUED = r"(?iU)\b(product|made|produced|manufactured)(of|in)(?=[a-z])"
ORIGIN_STANDALONE = r"(?iU)\b(?:PRODUCT\s+OF|MADE\s+IN|ORIGIN\s+OF)\s+([A-Za-z]{3,30})\b"
ORIGIN_IN = r"(?iU)^\s*In\s+([A-Za-z]{3,30})(?:\s+by\b|\s*$)"

# --- fixed values: importer ---------------------------------------------------------------------
IMPORTER_WORDS = (
    r"(?:Importer(?:\s+Name)?|Imported\s+(?:by|for|in)|Imp(?:\.)?\s*[Bb]y|"
    r"Import(?:er)?\s*&?\s*Marketed\s+[Bb]y)\s*[:\.-]?"
)
IMPORTER_INLINE = r"(?iUd)^" + IMPORTER_WORDS + r"\s*(.+)"
IMPORTER_LABEL = r"(?iU)^" + IMPORTER_WORDS
IMPORTER_REJECT = (
    r"(?iU)\b(?:manufactured|mfg|mfd|packed|pkd|marketed|marketer|batch|lot|fssai|fssat|lic|licence|"
    r"license|ean|upc|barcode|date|expiry|mrp|net\s*qty|net\s*wt|customer\s*care|consumer\s*care|"
    r"telephone|phone|email|website)\b|@|\b(?:https?://|www\.)\b"
)

# --- fixed values: product name ------------------------------------------------------------------
NAME_LABEL = r"(?iUd)^(?:Common\s*/?\s*Gen[a-z]*|Generic|Commodity|Product)\s+Name\s*[:.-]?\s*(.*)$"
NAME_ENTITY = (
    r"(?iU)\b(?:manufactured\s+by|mfg[./\s]*(?:by|for|pack|packed|pkd)|"
    r"mfd[./\s]*(?:by|for|pack|packed|pkd)|marketed\s+by|packed\s+by|imported\s+by|manufacturer|packer)\b"
)
NAME_QUESTION = (
    r"(?iU)^(?:what|why|how|when|where|who|whom|which|is|are|can|could|do|does|did|will|would|should)\b"
)
NAME_PROMO = (
    r"(?iU)\b(?:special|makes|delight|squeeze|rinse|massage|apply|lather|gently|feel|refreshing|"
    r"experience|boost|enjoy|pure|goodness|secret|enriched|love|everyday\s*protein|cleanse|"
    r"hydrat[a-z]*|protect[a-z]*|formula\s+with|contains?|may\s+contain|made\s+(?:with|from|of)|"
    r"(?:bottle|pack|container|tube|packaging)\s+made|recycled|excluding|over\s+time|appearance|"
    r"the\s+product)\b"
)
NAME_PRICE_WORDS = (
    r"(?iU)\b(?:sale|price|mrp|cost|rate|taxes?|tax|incl|inclusive|usp|unit\s+sale|rs|inr|off|"
    r"discount|save)\b"
)
PANEL_HINT = r"(?:see|refer|read)\s*(?:above|below|side|bottom|pkg|pack|panel)"
NAME_INSTRUCTION = (
    r"(?iU)\b(?:directions?|how\s+to|storage|store\s+in|warning|caution|tamper|fssai|fssat|lic|licence|"
    r"license|batch|lot|code|mfg|mfd|packed|pkd|expiry|exp|use\s+by|best\s+before|use\s+only|"
    r"external\s+use|for\s+external|usage|ingredients?|nutrition|nutritional|allergen|consumer|"
    r"customer|care|contact|feedback|telephone|phone|email|website|address|net\s+wt|net\s+qty|"
    r"quantity|units?|commodity|model|origin|country|flush|avoid|occurs?|safety|first\s+aid|"
    r"trademark|compatibility|dermatolog[a-z]*|clinical[a-z]*|tested|(?:" + PANEL_HINT + r"))\b"
)
STEPS_CORE = (
    r"\b(?:\d+\s+)?steps?\s+(?:for|to|towards|in|of|ahead)\b"
    r"|\b(?:follow|these|easy|simple)\s+(?:these\s+)?steps?\b"
    r"|\bstep\s*[:.-]?\s*\d+\b"
    r"|\bhow\s+to\s+(?:use|apply|wash|cleanse)\b"
    r"|\broutine\s+steps?\b"
)
NAME_STEPS = r"(?iU)(?:" + STEPS_CORE + r"|\binstructions?\b)"
NAME_DANGLING = r"(?iU)\b(?:for|withs?|ofs?|in|to|by|from|on|at|and|or|&)\s*(?:a|an|the)?\s*$"
NAME_LEADING = r"(?iU)^(?:and|or|&|with|of|in|for|by|from|to)\s+"
NAME_CLAIMS = (
    r"(?iU)(?:\bph\s*(?:skin|neutral|balanced?|level|\d+(?:\.\d+)?)\b"
    r"|\b(?:skin|body|scalp)\s*ph\b"
    r"|\b(?:paraben|soap|sulphate|sulfate|silicone|dye|microplastic|alcohol)[-\s]*free\b"
    r"|\b(?:microplastic|protecting|nourishing|cleansing)[-\s]*formula\b"
    r"|\bformula\s+with\b"
    r"|\b(?:skin|hair|scalp)\s+compatibility\b"
    r"|\bcompatibility\s+(?:tested|approved|dermatologically)\b"
    r"|\b(?:dermatolog[a-z]*|clinical[a-z]*|paediatric[a-z]*|pediatric[a-z]*|ophthalmolog[a-z]*)\s+"
    r"(?:tested|proven|approved|certified)\b"
    r"|\bhypoallergenic\b"
    r"|\b(?:gentle|mild|soft|safe)\s+on\s+(?:the\s+)?(?:skin|hair|scalp|hands|body)\b"
    r"|\b(?:protects?|nourish(?:es)?|sooth(?:es)?|hydrates?|moisturiz(?:es)?|moisturis(?:es)?)\s+"
    r"(?:your\s+|the\s+)?(?:skin|hair|scalp)\b"
    r"|\b(?:moisturiz(?:ed)?|moisturis(?:ed)?|hydrated)\s+skin\b"
    r"|\b(?:healthy|glowing|radiant|dry|oily|sensitive)\s+skin\s*$"
    r"|\b(?:suitable|ideal|formulated|crafted)\s+for\s+(?:all\s+)?(?:skin|hair|types?)\b"
    r"|\b(?:all|every)\s+(?:skin|hair)\s+types?\b"
    r"|\b(?:long|all-?day)\s+lasting\s+(?:freshness|fragrance|hydration|moisture|protection)\b"
    r"|\b(?:germ|bacterial|odour|odor)\s+protection\b)"
)
NAME_CARE_TEXT = (
    r"(?iU)(?:feedback|complaints?|queries|query|careline|toll\s*free|(?:" + PANEL_HINT + r"))"
)
NAME_HEADER_WORDS = [
    "marketed", "manufactured", "packed", "imported", "license", "licence", "fssai", "storage",
    "instruction", "instructions", "direction", "directions", "batch", "mrp", "retail", "expiry",
    "best before", "use by", "warning", "caution", "tamper", "allergen", "nutrition",
    "nutritional", "ingredient", "ingredients", "consumer", "customer", "complaint", "feedback",
    "telephone", "email", "website", "contact", "address", "net wt", "net qty", "quantity",
    "sale", "price",
]
NAME_HEADER_RATIO = 0.84
NAME_EXPLICIT_REJECT = (
    r"(?iU)@|https?://|\b(?:mrp|net\s+(?:wt|qty)|telephone|phone|email|customer\s+care|country\s+of)\b"
)
NAME_PLAIN_REJECT = (
    r"(?iU)@|https?://|www\.|\.[a-z]{2,}\b|\b(?:mrp|net\s+(?:wt|qty)|telephone|phone|email|"
    r"customer\s+care|country\s+of|trademark)\b|(?:feedback|complaints?|queries|query|careline|"
    r"toll\s*free|(?:" + PANEL_HINT + r"))"
)
NAME_STOP_EXPLICIT = r"(?i)^(?:product|information|details|label|select|of|in)$"
NAME_STOP_PLAIN = r"(?iU)^(?:product|information|details|label|select|of|in|everyday\s*protein)$"
NAME_PRICE_CODE = (
    r"(?iU)(?:\d+(?:[.,]\d+)?\s*/?[-]?\s*\d*(?:\.\d+)?\s*/\s*(?:ml|g|kg|l|gm|unit)"
    r"|\d+\s*/[-]|Rs\.?\s*\d+|\d+\s*/-|[A-Z]{1,4}\d{3,}|\d{3,}[A-Z]{1,4}|\d+\.\d+\s*/\s*[a-zA-Z]+)"
)
NAME_MIN_CONFIDENCE = 0.75
NAME_MIN_LETTERS = 0.40

# --- fixed values: evidence strength ---------------------------------------------------------------
CORE_FIELDS = ["mrp", "netQuantity", "manufacturerName", "monthOfPacking", "yearOfPacking"]
MERGE_FIELDS = [
    "productId", "productName", "productType", "isImported", "manufacturerName",
    "manufacturerAddress", "packerName", "importerName", "netQuantity", "mrp", "unitSalePrice",
    "monthOfPacking", "yearOfPacking", "expiryMonth", "expiryYear", "consumerCare",
    "countryOfOrigin", "fontHeightMm", "batchNumber",
]
EV_CORP = r"(?iU)\b(?:pvt\.?\s*ltd|ltd\.?|limited|private\s*limited|llp|inc\.?)\b"
EV_MRP_QTY = r"(?iU)\b\d+\s*(?:ml|g|kg|l|gm)\b"
EV_MRP_NOT_QTY = r"(?iU)\b(?:rs|inr|₹|mrp|/-)\b"
EV_MRP_LABEL_VALUE = r"(?iU)\b(?:mrp|maximum\s*retail\s*price|incl|taxes)\b"
EV_MRP_LABEL_TEXT = r"(?iU)\b(?:mrp|maximum\s*retail\s*price)\b"
EV_MRP_CURRENCY = r"(?iU)(?:rs\.?|inr|₹|/-)"
EV_MRP_TAX = r"(?iUd)incl.*tax"
EV_QTY_UNIT = r"(?iU)\b(?:ml|l|g|kg|gm|gms|n|u|piece|count)\b"
EV_QTY_LABEL = r"(?iU)\b(?:net\s*qty|net\s*wt|net\s*quantity|net\s*content|net\s*vol)\b"
EV_MAKER_LABEL = (
    r"(?iU)\b(?:manufactured\s*by|mfg\.?\s*by|mfd\.?\s*by|produced\s*by|packed\s*by|manufacturer:)\b"
)
EV_TWO_WORDS = r"(?s)[A-Za-z]{2,}[^A-Za-z].*[A-Za-z]{2,}"
EV_IMPORTER_LABEL = r"(?iU)\b(?:imported\s*by|importer\s*name|imp\.?\s*by|import\s*&\s*marketed)\b"
EV_UNIT_PRICE_VALUE = (
    r"(?iU)\b(?:unit\s*sale\s*price|unit\s*price|sale\s*price\s*per|rs\.?/\s*(?:kg|g|ml|100g|100ml))\b"
)
EV_UNIT_PRICE_TEXT = r"(?iU)\b(?:unit\s*sale\s*price|unit\s*price)\b"
EV_UNIT_PRICE_SHAPE = r"(?iUd)(?:rs\.?|₹).*/\s*(?:kg|g|ml|100g|100ml|unit)"
EV_MADE = r"(?iU)\b(?:mfd|mfg|pkd|packed|manufacturing)\b"
EV_EXPIRY = r"(?iU)\b(?:exp|expiry|use\s*before|best\s*before|bbe)\b"
EV_TOLL_FREE = r"(?U)\b1800\d{6,7}\b"
EV_CARE = r"(?iU)\b(?:care|helpline|consumer|customer|toll[\s-]free)\b"
EV_ORIGIN = r"(?iU)\b(?:country\s*of\s*origin|made\s*in|manufactured\s*in)\b"
EV_BATCH = (
    r"(?iU)\b(?:for\s+batch(?:\s+no\.?|\s+number)?|batch(?:\s*/\s*lot)?(?:\s+no\.?|\s+number)?|"
    r"lot(?:\s*/\s*batch)?(?:\s+no\.?|\s+number)?|b\.?\s*no)\b"
)
EV_NAME_INSTRUCTION = (
    r"(?iU)(?:" + STEPS_CORE +
    r"|\b(?:directions?|how\s+to|storage|warning|caution|tamper|external\s+use|flush|avoid|occurs?|"
    r"safety|first\s+aid|formula\s+with|contains?|may\s+contain|trademark|compatibility|"
    r"dermatolog[a-z]*|clinical[a-z]*|tested|made\s+(?:with|from|of)|"
    r"(?:bottle|pack|container|tube|packaging)\s+made|recycled|excluding|over\s+time|appearance|"
    r"the\s+product)\b)"
)
EV_NAME_WEB = r"(?iU)@|https?://|www\.|\.[a-z]{2,}\b"
EV_NAME_PROMO = (
    r"(?iU)\b(?:special|makes|delight|squeeze|rinse|massage|apply|lather|gently|feel|refreshing|"
    r"experience|boost|enjoy|goodness|enriched)\b"
)
EV_NAME_LABEL = r"(?iU)\b(?:product\s+name|generic\s+name|commodity\s+name|common\s+name)\b"

# --- fixed values: scan scores and images --------------------------------------------------------
SCORE_FULL = 100
SCORE_FAIL_STEP, SCORE_FAIL_FLOOR = 25, 10
SCORE_WARN_STEP, SCORE_WARN_FLOOR = 15, 30
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "webp"]
NO_PRODUCT = "Unidentified Product"
