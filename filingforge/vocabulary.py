"""Fixed term lists and patterns. Longer word lists are parameters of the operators that use them."""

# --- fixed values: month names ---
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# --- fixed values: a cell holding any of these marks its row as a date header ---
HEADER_DATE_PATTERNS = [
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    rf"\b(?:{MONTHS})\s*\d{{1,2}},?\s*\d{{4}}\b",
    rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{2,4}}\b",
    rf"For\s+the\s+.*?ended\s+(?:{MONTHS})\s*\d{{1,2}},?\s*\d{{4}}",
    rf"\b\d{{1,2}}\s+(?:{SHORT_MONTHS})\.?\s+\d{{2,4}}\b",
    rf"\b(?:{SHORT_MONTHS})\.?\s+\d{{1,2}},?\s+\d{{2,4}}\b",
]

# --- fixed values: dates that can be read out of a header ---
MONTH_DAY_YEAR = rf"({MONTHS})\s*(\d{{1,2}}),?\s*(\d{{4}})"
DAY_MONTH_YEAR = rf"\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{2,4}})\b"

# --- fixed values: dates listed for a whole document ---
DOCUMENT_DATE_PATTERNS = [
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b",
]

# --- fixed values: contexts that state a full reporting period or a balance date ---
PERIOD_CONTEXT_PATTERNS = [
    r"^[A-Za-z]+\s+\d{1,2},\s+\d{4}$",
    r"Years?\s+Ended?",
    r"Year?\s+Ended?",
    r"As\s+of",
]

# --- fixed values: amounts ---
AMOUNT_PATTERN = (
    r"\$\([0-9,]+(?:\.[0-9]+)?\)|\$[0-9,]+(?:\.[0-9]+)?"
    r"|^\([0-9,]+(?:\.[0-9]+)?\)$|^[0-9,]+(?:\.[0-9]+)?$"
)
MONEY_TOKEN = r"\$?[\(]?[\d,]+\.?\d*[\)]?[MmBbKk]?"
RATIO_TOKENS = [r"\b\d+\.\d+x\b", r"\b\d+\.\d+%\b", r"\b\d+\.\d{2,3}\b"]
PLAIN_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"
DASH_PLACEHOLDERS = ["$", "$—", "—"]
NULL_TOKENS = ["—", "-", "", "N/A", "n/a", "NULL"]
LABEL_PUNCTUATION = "[\",'’:;().·]"

# --- fixed values: null spellings of a table reader ---
READER_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: a table naming one of these is a finance table ---
FINANCE_TABLE_TERMS = [
    "Revenue", "Accounts Receivable", "Liabilities", "Assets", "Cash", "Common Stock",
    "Differed Tax", "Inventory", "Earnings", "Operating Loss", "Months Ended", "Year Ended",
    "Depreciation",
]

# --- fixed values: a line item must contain one of these ---
LINE_ITEM_TERMS = [
    "revenue", "accounts receivable", "earnings", "accounts payable", "liabilities", "assets",
    "expense", "interest", "cash", "debt", "inventory", "depreciation", "cost", "income",
    "inventories", "land", "machinery", "equipment", "profit", "operating", "other liabilities",
    "property", "sales", "loss", "deposits", "capital", "reserves", "interests", "deficit",
    "equity", "capitalization",
]

# --- fixed values: (filled metric, metric it is filled from) ---
LIKE_TERMS = [
    ("cash", "cash_and_cash_equivalents"),
    ("total_shareholders_equity", "total_stockholders_equity"),
]

# --- fixed values: terms counted in the text of every filing ---
TARGET_KEYWORDS = [
    "technology", "software", "ai", "machine learning", "cloud", "saas", "platform", "digital",
    "data", "analytics", "algorithm", "automation", "blockchain", "cryptocurrency",
    "cybersecurity", "subscription", "recurring", "e-commerce", "mobile", "app", "virtual",
    "healthcare", "biotech", "pharmaceutical", "medical", "clinical", "energy", "renewable",
    "solar", "electric", "battery", "real estate", "logistics", "transportation", "automotive",
]
# --- fixed values: two more terms counted in the frequency report ---
FREQUENCY_KEYWORDS = TARGET_KEYWORDS + ["fintech", "marketplace"]

# --- fixed values: underwriting banks ("bmO capital" never equals lowercased text) ---
UNDERWRITERS = [
    "morgan stanley", "goldman sachs", "jp morgan", "jpmorgan", "citigroup", "citi",
    "bank of america", "merrill lynch", "wells fargo", "barclays", "credit suisse",
    "deutsche bank", "ubs", "jefferies", "cowen", "piper sandler", "raymond james",
    "william blair", "stifel", "canaccord", "rbc capital", "bmO capital", "evercore", "lazard",
    "moelis", "centerview",
]
UNDERWRITING_TABLE_TERMS = ["underwriter", "book-running manager", "lead manager"]
UNDERWRITING_CONTEXT_TERMS = ["underwriter", "book-running", "lead manager", "offering"]

# --- fixed values: document types in order of preference, with the terms that score for them ---
DOCUMENT_TYPES = [
    ("spac", ["SPAC", "Special Purpose", "Trust Account", "Business Combination",
              "Acquisition Corp"]),
    ("insurance", ["Premium", "Claims", "Underwriting", "Policy", "Loss Ratio",
                   "Combined Ratio"]),
    ("banking", ["Deposits", "Loans", "Credit", "Interest Income", "Net Interest Margin"]),
    ("investment", ["Assets Under Management", "Investment", "Portfolio", "Fund"]),
    ("prospectus", ["Prospectus", "Offering", "Securities", "Registration"]),
    ("balance_sheet", ["Balance Sheet", "Assets", "Liabilities", "Equity"]),
    ("income_statement", ["Income Statement", "Revenue", "Net Income", "Operating Income"]),
    ("cash_flow", ["Cash Flow", "Operating Activities", "Investing Activities",
                   "Financing Activities"]),
]

# --- fixed values: company suffixes ---
COMPANY_MARKS = ["inc.", "corp.", "ltd.", "llc", "company"]

# --- fixed values: statement line items ---
STATEMENT_TERMS = {
    "balance_sheet": [
        "total assets", "current assets", "total liabilities", "current liabilities",
        "stockholders equity", "shareholders equity", "working capital", "cash and equivalents",
        "accounts receivable", "inventory", "accounts payable", "long-term debt",
        "retained earnings",
    ],
    "income_statement": [
        "total revenue", "net revenue", "gross revenue", "sales", "cost of goods sold",
        "gross profit", "operating expenses", "operating income", "net income",
        "earnings per share", "diluted eps", "basic eps",
    ],
    "cash_flow": [
        "operating activities", "investing activities", "financing activities",
        "net cash provided", "net cash used", "free cash flow", "capital expenditures",
        "depreciation",
    ],
    "key_metrics": [
        "debt to equity", "current ratio", "quick ratio", "return on equity", "return on assets",
        "profit margin", "gross margin", "operating margin", "price to earnings",
        "book value per share",
    ],
}

# --- fixed values: metrics per document type: (metric, groups of terms, what is taken) ---
# A row counts when every group has a term in its text; None means the metric is always null.
METRIC_RULES = {
    "spac": [
        ("trust_account_value", [["trust"]], "max_money"),
        ("shares_subject_to_redemption", None, None),
        ("working_capital", [["working capital"]], "first_money"),
        ("total_assets", [["total assets"]], "max_money"),
        ("stockholders_equity", [["stockholders equity", "shareholders equity"]], "first_money"),
    ],
    "insurance": [
        ("premiums_written", [["premiums written"]], "max_money"),
        ("premiums_earned", None, None),
        ("losses_incurred", None, None),
        ("combined_ratio", [["combined ratio"]], "first_ratio"),
        ("loss_ratio", None, None),
    ],
    "banking": [
        ("total_deposits", [["deposits"], ["total"]], "max_money"),
        ("total_loans", [["loans"], ["total"]], "max_money"),
        ("net_interest_income", None, None),
        ("provision_for_losses", None, None),
        ("tier_1_capital_ratio", None, None),
    ],
    "general": [
        ("total_revenue", [["revenue"]], "max_money"),
        ("net_income", [["net income"]], "first_money"),
        ("total_assets", [["total assets"]], "max_money"),
        ("total_liabilities", [["total liabilities"]], "max_money"),
        ("stockholders_equity", [["stockholders equity", "shareholders equity"]], "first_money"),
    ],
}
