"""Fixed values that results depend on: word lists, codes, thresholds, formats."""

# Whitespace removed from both ends of a cell.
CELL_WHITESPACE = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Currency codes accepted as valid.
CURRENCIES = [
    "USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "CNY", "INR", "BRL",
    "MXN", "SGD", "HKD", "KRW", "SEK", "NOK", "DKK", "NZD", "ZAR", "RUB",
    "IDR", "MYR", "PHP", "THB", "VND", "AED", "SAR", "ILS", "TRY",
]

# The shorter code list used when profiling values and in direct extraction.
PROFILE_CURRENCIES = [
    "USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "CNY", "INR", "BRL", "MXN", "SGD", "HKD", "KRW",
]

# Source column name -> canonical field name.
COLUMN_ALIASES = {
    "asset_name": "asset_name", "name": "asset_name", "assetname": "asset_name",
    "asset_value": "asset_value", "value": "asset_value", "assetvalue": "asset_value",
    "currency": "currency",
    "asset_type": "asset_type", "type": "asset_type", "assettype": "asset_type",
    "location": "location", "address": "location",
    "jurisdiction": "jurisdiction", "country": "jurisdiction",
    "latitude": "latitude", "lat": "latitude",
    "longitude": "longitude", "lng": "longitude", "lon": "longitude",
    "description": "description", "notes": "description",
    "owner": "owner", "operator": "operator", "capacity": "capacity", "status": "status",
}

# Canonical fields parsed as a number.
COORDINATE_FIELDS = ["latitude", "lat", "longitude", "lng", "lon"]
AMOUNT_FIELDS = ["asset_value", "value", "capacity"]

# Slot -> keywords, in the order they are tried when roles are assigned by name.
ROLE_KEYWORDS = {
    "asset_name": ["asset", "name", "property", "building", "facility", "site", "location"],
    "value": ["value", "amount", "price", "valuation", "cost", "total", "market"],
    "currency": ["currency", "curr"],
    "jurisdiction": [
        "jurisdiction", "location", "country", "state", "province", "region", "city", "address",
    ],
    "latitude": ["lat", "latitude"],
    "longitude": ["lng", "lon", "longitude"],
    "asset_type": ["type", "category", "classification", "kind"],
}

# Slot -> keywords of the two-way containment match.
FUZZY_KEYWORDS = {
    "asset_name": ["asset", "name", "property", "facility", "building", "assetname"],
    "value": ["value", "amount", "price", "valuation", "cost", "total_value", "market_value"],
    "currency": ["currency", "curr"],
    "jurisdiction": ["location", "country", "state", "province", "region", "city", "address"],
    "latitude": ["lat", "latitude", "lat_deg"],
    "longitude": ["lng", "lon", "long", "longitude", "lng_deg"],
    "asset_type": ["type", "category", "classification", "property_type", "kind", "subtype"],
}

SLOTS = list(ROLE_KEYWORDS)

# Semantic role a keyword hit on a slot gives to the column.
SLOT_ROLE = {
    "asset_name": "asset_name", "value": "value", "currency": "currency",
    "jurisdiction": "jurisdiction", "latitude": "latitude", "longitude": "longitude",
    "asset_type": "metadata",
}

# Canonical column name per slot, preferred when slots are filled from roles.
SLOT_CANONICAL = {
    "asset_name": "asset_name", "value": "asset_value", "currency": "currency",
    "jurisdiction": "jurisdiction", "latitude": "latitude", "longitude": "longitude",
    "asset_type": "asset_type",
}

# Slots a usable schema is expected to map.
REQUIRED_SLOTS = ["asset_name", "value", "currency", "jurisdiction"]

# Keys that describe a row and are not row data.
META_KEYS = ["sheetName", "sourceSheetName", "sourceRowIndex", "overallConfidence", "rawAssetName"]

# Keys tried, in order, for the name of a row.
NAME_KEYS = ["asset_name", "name", "Asset Name", "asset"]

# Date layouts recognised in cells.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd",
]

# Admission rules for uploads.
FILE_TYPES = ["csv", "xls", "xlsx", "pdf"]
MIME_TYPES = [
    "text/csv", "application/csv", "application/vnd.ms-excel", "text/plain",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/octet-stream", "application/pdf",
]
MAX_FILE_BYTES = 25 * 1024 * 1024
MAX_BATCH_FILES = 10
MIME_BY_TYPE = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
}
DEFAULT_MIME = "application/octet-stream"

# Batch sizes and thresholds.
DETERMINISTIC_BATCH = 5000
AMBIGUOUS_BATCH = 50
MAX_PROVIDER_BATCH = 100
SAMPLE_ROWS = 20
PROFILE_ROWS = 10
TYPE_ROWS = 5
HEADER_SCAN_ROWS = 100
EMPTY_ROW_LIMIT = 100
NOTE_MIN_LENGTH = 25
REVIEW_THRESHOLD = 0.65
COORDINATE_DECIMALS = 6
AMOUNT_DECIMALS = 2
DEFAULT_CONFIDENCE = 0.8
BAND_HEIGHT = 12.0
CLUSTER_GAP = 25.0

# Example lookup of the built-in rule provider: country -> currency.
COUNTRY_CURRENCY = {
    "ALGERIA": "DZD", "BRAZIL": "BRL", "CANADA": "CAD", "CHINA": "CNY", "FRANCE": "EUR",
    "GERMANY": "EUR", "INDIA": "INR", "INDONESIA": "IDR", "JAPAN": "JPY", "RUSSIA": "RUB",
    "SAUDI ARABIA": "SAR", "UNITED KINGDOM": "GBP", "UNITED STATES": "USD", "US": "USD",
    "VIETNAM": "VND",
}
