"""Values that decide results and therefore must not drift.

Everything here is a fixed value: word lists whose order is part of the
meaning, lookup tables, text patterns, output labels and numeric limits.
In the patterns ``<W>`` stands for the Unicode white-space characters (to be
used inside a character class), ``<D>`` for one Unicode decimal digit.
"""

# --- fixed values: text classes --------------------------------------------
SPACE_CHARS = r"\p{IsWhite_Space}\x1c-\x1f"
DIGIT = r"\p{Nd}"

# --- fixed values: job categories, first list with a hit wins ---------------
CATEGORY_WORDS = [
    ("restaurant", ["restaurant", "cafe", "kitchen", "server", "waiter", "cook", "chef"]),
    ("retail", ["retail", "store", "shop", "sales", "cashier"]),
    ("hospitality", ["hotel", "hospitality", "front desk", "reception"]),
    ("warehouse", ["warehouse", "logistics", "forklift"]),
    ("construction", ["construction", "laborer", "carpenter"]),
    ("cleaning", ["cleaning", "cleaner", "janitor", "housekeeping"]),
]
CATEGORY_DEFAULT = "other"

# --- fixed values: category vocabulary shown to users -----------------------
CATEGORY_LABELS = [
    ("restaurant", "레스토랑/카페"),
    ("retail", "소매점"),
    ("hospitality", "호텔/관광"),
    ("warehouse", "창고/물류"),
    ("construction", "건설"),
    ("cleaning", "청소"),
    ("other", "기타"),
]

# --- fixed values: cities looked for in a post, first hit wins --------------
HINT_CITIES = [
    "Vancouver", "Victoria", "Toronto", "Whistler", "Burnaby",
    "Richmond", "Surrey", "North Vancouver", "West Vancouver",
    "Coquitlam", "New Westminster", "Langley", "Delta",
    "Kelowna", "Banff", "Canmore", "Calgary", "Edmonton",
    "Vernon", "Nelson", "Revelstoke", "Jasper", "Halifax",
    "Montreal", "Winnipeg", "Yellowknife",
]

# --- fixed values: cities that make an address complete ---------------------
ADDRESS_CITIES = [
    "Vancouver", "Victoria", "Toronto", "Burnaby", "Surrey", "Richmond",
    "Kelowna", "Banff", "Canmore", "Calgary", "Edmonton", "Vernon",
    "Nelson", "Revelstoke", "Jasper", "Halifax", "Montreal", "Winnipeg",
]

# --- fixed values: city centres, first hit wins -----------------------------
CITY_CENTERS = [
    ("Vancouver", 49.2827, -123.1207),
    ("Victoria", 48.4284, -123.3656),
    ("Toronto", 43.6532, -79.3832),
    ("Whistler", 50.1163, -122.9574),
    ("Burnaby", 49.2488, -122.9805),
    ("Surrey", 49.1913, -122.8490),
    ("Richmond", 49.1666, -123.1364),
    ("Kelowna", 49.8880, -119.4960),
    ("Banff", 51.1784, -115.5708),
    ("Canmore", 51.0888, -115.3581),
    ("Calgary", 51.0447, -114.0719),
    ("Edmonton", 53.5461, -113.4938),
    ("Vernon", 50.2670, -119.2724),
    ("Nelson", 49.4995, -117.2855),
    ("Revelstoke", 50.9971, -118.1953),
    ("Jasper", 52.8737, -118.0814),
    ("Halifax", 44.6488, -63.5752),
    ("Montreal", 45.5017, -73.5673),
    ("Winnipeg", 49.8951, -97.1384),
    ("Yellowknife", 62.4540, -114.3718),
]
CENTER_DEFAULT = "Vancouver"
CENTER_CONFIDENCE = 0.5
UNRESOLVED_CONFIDENCE = 0.3

# --- fixed values: province codes that make a place query complete ----------
PROVINCE_WORDS = [
    "BC", "AB", "ON", "QC", "MB", "SK", "NB", "NS", "PE", "NL", "YT", "NT", "NU", "Canada",
]

# --- fixed values: confidence by importance (strictly greater) --------------
CONFIDENCE_STEPS = [(0.7, 0.9), (0.5, 0.8), (0.3, 0.7)]
CONFIDENCE_FLOOR = 0.6

# --- fixed values: street and store words -----------------------------------
STREET_WORDS_LONG = "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Way|Lane|Ln"
STREET_WORDS = "Street|St|Avenue|Ave|Road|Rd"
PROVINCES = "BC|AB|ON|QC|MB|SK|NB|NS|PE|NL|YT|NT|NU"
POSTCODE = r"V<D>[A-Z][<W>]?<D>[A-Z]<D>"
STORE_WORDS = ["Restaurant", "Cafe", "Shop", "Store", "Bistro", "Kitchen", "Pizza", "Sushi", "Ramen"]
STORE_WORDS_ADDRESS = STORE_WORDS + ["Market", "Enterprises"]
AREA_ENDINGS = "town|land|park|hill|valley|beach|bay"
AREA_CITIES = "Vancouver|Burnaby|Surrey|Richmond|Victoria|Toronto|Kelowna|Calgary|Edmonton"
AREA_WORDS = "エリア|area"

# --- fixed values: labels in front of an address (rest of the line) ---------
ADDRESS_LABELS = [
    "勤務地[：:][<W>]*",
    "勤務場所[：:][<W>]*",
    "勤務先[：:][<W>]*",
    "所在地[：:][<W>]*",
    "住所[：:][<W>]*",
    "場所[：:][<W>]*",
    "【募集店舗】[<W>]*",
    "Address[：:][<W>]*",
    "Address[<W>]+",
    "Location[：:][<W>]*",
    "Location[<W>]+",
    "Work[<W>]+Location[：:][<W>]*",
    "Work[<W>]+Address[：:][<W>]*",
]
STORE_LABELS = ["店名[：:][<W>]*", "店舗名[：:][<W>]*"]

# --- fixed values: date patterns and their formats, in order ----------------
DATE_PATTERNS = [
    (r"<D>{4}-<D>{2}-<D>{2}", "yyyy-MM-dd"),
    (r"<D>{2}/<D>{2}/<D>{4}", "MM/dd/yyyy"),
    (r"<D>{2}-<D>{2}-<D>{4}", "MM-dd-yyyy"),
]

# --- fixed values: limits of a map request ----------------------------------
LIMIT_DEFAULT, LIMIT_MAX = 100, 500
RADIUS_MIN_KM, RADIUS_MAX_KM = 0.1, 50.0
ZOOM_MAX = 20
REVIEW_BELOW = 0.6
LOW_CONFIDENCE_BELOW = 0.7

# --- fixed values: reject codes ---------------------------------------------
CODE_BBOX = "INVALID_BBOX"
CODE_COORDINATES = "INVALID_COORDINATES"
CODE_GEOCODING = "GEOCODING_FAILED"
CODE_INTERNAL = "INTERNAL_ERROR"
CODE_PARSE = "PARSE_FAILED"
CODE_FETCH = "FETCH_FAILED"

# --- fixed values: labels shown with a posting ------------------------------
LABEL_NO_WAGE = "시급 미표시"
LABEL_NO_TITLE = "제목 없음"
LABEL_NO_DATE = "날짜 정보 없음"
LABEL_TODAY, LABEL_YESTERDAY = "오늘", "어제"
LABEL_DAYS, LABEL_WEEKS, LABEL_MONTHS = "일 전", "주 전", "개월 전"
CONFIDENCE_LABELS = [(0.9, "매우 높음"), (0.7, "높음"), (0.5, "보통")]
CONFIDENCE_LABEL_LOW = "낮음"
CONFIDENCE_COLORS = [(0.7, "green"), (0.5, "yellow")]
CONFIDENCE_COLOR_LOW = "red"

# --- fixed values: Earth ------------------------------------------------------
EARTH_A = 6378137.0
EARTH_F = 1 / 298.257223563
EARTH_MEAN = 6371008.7714

# --- fixed values: container elements searched for a body, in order ----------
BODY_CONTAINERS = [
    ("div", "class", "content|post|message|body"),
    ("div", "id", "content|post|message|body"),
    ("td", "class", "content|post|message"),
    ("article", None, None),
    ("main", None, None),
]
BODY_MIN_CHARS = 50
PART_MIN_CHARS = 5
SIBLING_MIN_CHARS = 10


def rx(pattern: str) -> str:
    """Expand ``<W>`` and ``<D>``."""
    return pattern.replace("<W>", SPACE_CHARS).replace("<D>", DIGIT)
