"""Fixed values that decide results: patterns, word lists, thresholds and labels.

All of them are given values, stated as they are; nothing here is derived.
"""

# --- fixed values: whitespace removed by strip() and split() -----------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: patterns searched for in text -----------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
# Every character allowed after the scheme lies in "!", "$".."_" or "a".."z". One
# class instead of alternatives in a loop keeps the JVM regex engine off the stack.
URL = r"http[s]?://[!$-_a-z]+"
CURRENCY = (
    r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
    r"|\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|EUR|GBP)\b"
)

# --- fixed values: formats mixed within one column ---------------------------
DATE_FORMATS = {
    "yyyy-mm-dd": r"\d{4}-\d{2}-\d{2}",
    "mm/dd/yyyy": r"\d{2}/\d{2}/\d{4}",
    "mm-dd-yyyy": r"\d{2}-\d{2}-\d{4}",
    "mm.dd.yyyy": r"\d{2}\.\d{2}\.\d{4}",
}
COMMA_DECIMAL = r"\d+,\d+"
DOT_DECIMAL = r"\d+\.\d+"
CURRENCY_SYMBOL = r"[\$€£¥]"
NON_ASCII = r"[^\x00-\x7F]"
VALID_EMAIL = r"^[^@]+@[^@]+\.[^@]+$"
VALID_PHONE = r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}|\(\d{3}\)\s?\d{3}[-.\s]?\d{4}"
NUMERIC_LITERAL = r"^\s*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# --- fixed values: traces of a wrong decoding --------------------------------
MOJIBAKE = ["�", "Ã¢", "Ã¡", "Ã©", "â€™", "â€œ", "â€�"]
ASCII_ONLY_COLUMNS = ["id", "code", "number"]

# --- fixed values: sensitive text, replaced in this order, ignoring case ------
SENSITIVE = {
    "password": r'password["\s]*[:=]["\s]*[^"\s,}]+',
    "token": r'token["\s]*[:=]["\s]*[^"\s,}]+',
    "key": r'key["\s]*[:=]["\s]*[^"\s,}]+',
    "secret": r'secret["\s]*[:=]["\s]*[^"\s,}]+',
    "api_key": r'api_key["\s]*[:=]["\s]*[^"\s,}]+',
    "authorization": r'authorization["\s]*[:=]["\s]*[^"\s,}]+',
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
REDACTED = "[REDACTED]"

# --- fixed values: strings a CSV reader takes as missing ----------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: file kinds and the size limit of the inventory -------------
FILE_KINDS = {
    "csv": "csv", "xlsx": "excel", "xls": "excel", "json": "json", "txt": "text",
    "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image",
    "bmp": "image",
}

# --- fixed values: words known without a dictionary table ---------------------
BASIC_WORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on",
    "with", "he", "as", "you", "do", "at", "this", "but", "his", "by", "from", "they", "she",
    "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up",
    "out", "if", "about", "who", "get", "which", "go", "me", "when", "make", "can", "like",
    "time", "no", "just", "him", "know", "take", "people", "into", "year", "your", "good",
    "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come",
    "its", "over", "think", "also", "back", "after", "use", "two", "how", "our", "work",
    "first", "well", "way", "even", "new", "want", "because", "any", "these", "give", "day",
    "most", "us", "data", "value", "number", "text", "column", "row",
]

# --- fixed values: the order table read from word boxes -----------------------
ORDER_COLUMNS = [
    "Order ID", "Customer ID", "Category", "Item", "Price", "Quantity", "Order Total",
    "Order Date", "Payment Method",
]
ROLE_ORDER = [
    "Order ID", "Customer ID", "Order Date", "Payment Method", "Quantity", "Price",
    "Order Total", "Category", "Item",
]
ORDER_ID = r"\bORD[_-]?\d+\b"
CUSTOMER_ID = r"\bCUST[_-]?\d+\b"
FIRST_NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
PAYMENT_WORDS = ["credit", "cash", "wallet", "card"]
PAYMENT_NAMES = [
    ("wallet", "Digital Wallet"), ("credit", "Credit Card"), ("cash", "Cash"),
    ("card", "Credit Card"),
]
CATEGORY_WORDS = ["dishes", "dessert", "drink", "starter", "main", "side"]
STRAY_TOKENS = ["fry", "fy", "et", "a", "nan", "3)"]

# --- fixed values: delimiters in the order they are tried ---------------------
DELIMITERS = ["\t", ",", "|", ";"]
