"""Word lists, tables, constants and patterns that results depend on."""

# The legal category menu, primary -> detailed, in menu order.
MENU = {
    "INCOME": [
        "INCOME_DIVIDENDS",
        "INCOME_INTEREST_EARNED",
        "INCOME_RETIREMENT_PENSION",
        "INCOME_TAX_REFUND",
        "INCOME_UNEMPLOYMENT",
        "INCOME_WAGES",
        "INCOME_OTHER_INCOME",
    ],
    "TRANSFER_IN": [
        "TRANSFER_IN_CASH_ADVANCES_AND_LOANS",
        "TRANSFER_IN_DEPOSIT",
        "TRANSFER_IN_INVESTMENT_AND_RETIREMENT_FUNDS",
        "TRANSFER_IN_SAVINGS",
        "TRANSFER_IN_ACCOUNT_TRANSFER",
        "TRANSFER_IN_OTHER_TRANSFER_IN",
    ],
    "TRANSFER_OUT": [
        "TRANSFER_OUT_INVESTMENT_AND_RETIREMENT_FUNDS",
        "TRANSFER_OUT_SAVINGS",
        "TRANSFER_OUT_WITHDRAWAL",
        "TRANSFER_OUT_ACCOUNT_TRANSFER",
        "TRANSFER_OUT_OTHER_TRANSFER_OUT",
    ],
    "LOAN_PAYMENTS": [
        "LOAN_PAYMENTS_CAR_PAYMENT",
        "LOAN_PAYMENTS_CREDIT_CARD_PAYMENT",
        "LOAN_PAYMENTS_PERSONAL_LOAN_PAYMENT",
        "LOAN_PAYMENTS_MORTGAGE_PAYMENT",
        "LOAN_PAYMENTS_STUDENT_LOAN_PAYMENT",
        "LOAN_PAYMENTS_OTHER_PAYMENT",
    ],
    "BANK_FEES": [
        "BANK_FEES_ATM_FEES",
        "BANK_FEES_FOREIGN_TRANSACTION_FEES",
        "BANK_FEES_INSUFFICIENT_FUNDS",
        "BANK_FEES_INTEREST_CHARGE",
        "BANK_FEES_OVERDRAFT_FEES",
        "BANK_FEES_OTHER_BANK_FEES",
    ],
    "ENTERTAINMENT": [
        "ENTERTAINMENT_CASINOS_AND_GAMBLING",
        "ENTERTAINMENT_MUSIC_AND_AUDIO",
        "ENTERTAINMENT_SPORTING_EVENTS_AMUSEMENT_PARKS_AND_MUSEUMS",
        "ENTERTAINMENT_TV_AND_MOVIES",
        "ENTERTAINMENT_VIDEO_GAMES",
        "ENTERTAINMENT_OTHER_ENTERTAINMENT",
    ],
    "FOOD_AND_DRINK": [
        "FOOD_AND_DRINK_BEER_WINE_AND_LIQUOR",
        "FOOD_AND_DRINK_COFFEE",
        "FOOD_AND_DRINK_FAST_FOOD",
        "FOOD_AND_DRINK_GROCERIES",
        "FOOD_AND_DRINK_RESTAURANT",
        "FOOD_AND_DRINK_VENDING_MACHINES",
        "FOOD_AND_DRINK_OTHER_FOOD_AND_DRINK",
    ],
    "GENERAL_MERCHANDISE": [
        "GENERAL_MERCHANDISE_BOOKSTORES_AND_NEWSSTANDS",
        "GENERAL_MERCHANDISE_CLOTHING_AND_ACCESSORIES",
        "GENERAL_MERCHANDISE_CONVENIENCE_STORES",
        "GENERAL_MERCHANDISE_DEPARTMENT_STORES",
        "GENERAL_MERCHANDISE_DISCOUNT_STORES",
        "GENERAL_MERCHANDISE_ELECTRONICS",
        "GENERAL_MERCHANDISE_GIFTS_AND_NOVELTIES",
        "GENERAL_MERCHANDISE_OFFICE_SUPPLIES",
        "GENERAL_MERCHANDISE_ONLINE_MARKETPLACES",
        "GENERAL_MERCHANDISE_PET_SUPPLIES",
        "GENERAL_MERCHANDISE_SPORTING_GOODS",
        "GENERAL_MERCHANDISE_SUPERSTORES",
        "GENERAL_MERCHANDISE_TOBACCO_AND_VAPE",
        "GENERAL_MERCHANDISE_OTHER_GENERAL_MERCHANDISE",
    ],
    "HOME_IMPROVEMENT": [
        "HOME_IMPROVEMENT_FURNITURE",
        "HOME_IMPROVEMENT_HARDWARE",
        "HOME_IMPROVEMENT_REPAIR_AND_MAINTENANCE",
        "HOME_IMPROVEMENT_SECURITY",
        "HOME_IMPROVEMENT_OTHER_HOME_IMPROVEMENT",
    ],
    "MEDICAL": [
        "MEDICAL_DENTAL_CARE",
        "MEDICAL_EYE_CARE",
        "MEDICAL_NURSING_CARE",
        "MEDICAL_PHARMACIES_AND_SUPPLEMENTS",
        "MEDICAL_PRIMARY_CARE",
        "MEDICAL_VETERINARY_SERVICES",
        "MEDICAL_OTHER_MEDICAL",
    ],
    "PERSONAL_CARE": [
        "PERSONAL_CARE_GYMS_AND_FITNESS_CENTERS",
        "PERSONAL_CARE_HAIR_AND_BEAUTY",
        "PERSONAL_CARE_LAUNDRY_AND_DRY_CLEANING",
        "PERSONAL_CARE_OTHER_PERSONAL_CARE",
    ],
    "GENERAL_SERVICES": [
        "GENERAL_SERVICES_ACCOUNTING_AND_FINANCIAL_PLANNING",
        "GENERAL_SERVICES_AUTOMOTIVE",
        "GENERAL_SERVICES_CHILDCARE",
        "GENERAL_SERVICES_CONSULTING_AND_LEGAL",
        "GENERAL_SERVICES_EDUCATION",
        "GENERAL_SERVICES_INSURANCE",
        "GENERAL_SERVICES_POSTAGE_AND_SHIPPING",
        "GENERAL_SERVICES_STORAGE",
        "GENERAL_SERVICES_OTHER_GENERAL_SERVICES",
    ],
    "GOVERNMENT_AND_NON_PROFIT": [
        "GOVERNMENT_AND_NON_PROFIT_DONATIONS",
        "GOVERNMENT_AND_NON_PROFIT_GOVERNMENT_DEPARTMENTS_AND_AGENCIES",
        "GOVERNMENT_AND_NON_PROFIT_TAX_PAYMENT",
        "GOVERNMENT_AND_NON_PROFIT_OTHER_GOVERNMENT_AND_NON_PROFIT",
    ],
    "TRANSPORTATION": [
        "TRANSPORTATION_BIKES_AND_SCOOTERS",
        "TRANSPORTATION_GAS",
        "TRANSPORTATION_PARKING",
        "TRANSPORTATION_PUBLIC_TRANSIT",
        "TRANSPORTATION_TAXIS_AND_RIDE_SHARES",
        "TRANSPORTATION_TOLLS",
        "TRANSPORTATION_OTHER_TRANSPORTATION",
    ],
    "TRAVEL": [
        "TRAVEL_FLIGHTS",
        "TRAVEL_LODGING",
        "TRAVEL_RENTAL_CARS",
        "TRAVEL_OTHER_TRAVEL",
    ],
    "RENT_AND_UTILITIES": [
        "RENT_AND_UTILITIES_GAS_AND_ELECTRICITY",
        "RENT_AND_UTILITIES_INTERNET_AND_CABLE",
        "RENT_AND_UTILITIES_RENT",
        "RENT_AND_UTILITIES_SEWAGE_AND_WASTE_MANAGEMENT",
        "RENT_AND_UTILITIES_TELEPHONE",
        "RENT_AND_UTILITIES_WATER",
        "RENT_AND_UTILITIES_OTHER_UTILITIES",
    ],
}

# Leaves the taxonomy still maps although the menu has retired them.
RETIRED_ATOMS = [
    ("INCOME", "INCOME_SALARY"),
    ("INCOME", "INCOME_CONTRACTOR"),
    ("INCOME", "INCOME_OTHER"),
    ("TRANSFER_IN", "TRANSFER_IN_TRANSFER_IN_FROM_APPS"),
    ("TRANSFER_OUT", "TRANSFER_OUT_TRANSFER_OUT_FROM_APPS"),
    ("OTHER", "OTHER_OTHER"),
]

# Retired leaf -> (primary, detailed) of the current menu.
RETIRED_REMAP = [
    ("INCOME_SALARY", "INCOME", "INCOME_WAGES"),
    ("INCOME_CONTRACTOR", "INCOME", "INCOME_OTHER_INCOME"),
    ("INCOME_OTHER", "INCOME", "INCOME_OTHER_INCOME"),
    ("TRANSFER_IN_TRANSFER_IN_FROM_APPS", "TRANSFER_IN", "TRANSFER_IN_OTHER_TRANSFER_IN"),
    ("TRANSFER_OUT_TRANSFER_OUT_FROM_APPS", "TRANSFER_OUT", "TRANSFER_OUT_OTHER_TRANSFER_OUT"),
]

# Fixed values: (tier0, tier1) per primary.
PRIMARY_TIERS = {
    "INCOME": ("Income", "Income"),
    "TRANSFER_IN": ("Transfer", "Transfer In"),
    "TRANSFER_OUT": ("Transfer", "Transfer Out"),
    "LOAN_PAYMENTS": ("Necessary", "Loans"),
    "BANK_FEES": ("Necessary", "Fees"),
    "ENTERTAINMENT": ("Discretionary", "Entertainment"),
    "FOOD_AND_DRINK": ("Discretionary", "Dining Out"),
    "GENERAL_MERCHANDISE": ("Discretionary", "Merchandise"),
    "HOME_IMPROVEMENT": ("Discretionary", "House"),
    "MEDICAL": ("Necessary", "Healthcare"),
    "PERSONAL_CARE": ("Discretionary", "Personal Care"),
    "GENERAL_SERVICES": ("Necessary", "Services"),
    "GOVERNMENT_AND_NON_PROFIT": ("Necessary", "Government"),
    "TRANSPORTATION": ("Necessary", "Transportation"),
    "TRAVEL": ("Discretionary", "Travel"),
    "RENT_AND_UTILITIES": ("Necessary", "Utilities"),
    "OTHER": ("Discretionary", "Other"),
}

# Atoms that leave their primary's (tier0, tier1).
ATOM_TIERS = {
    "FOOD_AND_DRINK_GROCERIES": ("Necessary", "Groceries"),
    "LOAN_PAYMENTS_MORTGAGE_PAYMENT": ("Necessary", "Mortgage"),
    "LOAN_PAYMENTS_CAR_PAYMENT": ("Necessary", "Transportation"),
    "GENERAL_MERCHANDISE_GIFTS_AND_NOVELTIES": ("Discretionary", "Gifts/Charity"),
    "GOVERNMENT_AND_NON_PROFIT_DONATIONS": ("Discretionary", "Gifts/Charity"),
    "GOVERNMENT_AND_NON_PROFIT_TAX_PAYMENT": ("Necessary", "Taxes"),
    "RENT_AND_UTILITIES_RENT": ("Necessary", "Rent"),
}

# tier0 of an atom the taxonomy does not know, by primary; else Discretionary.
UNMAPPED_TIER0 = {"INCOME": "Income", "TRANSFER_IN": "Transfer", "TRANSFER_OUT": "Transfer"}

# Detailed globs left out of spend and income.
EXCLUDE_GLOBS = ["TRANSFER_IN_*", "TRANSFER_OUT_*", "LOAN_PAYMENTS_CREDIT_CARD_PAYMENT"]

# Fixed values: (regex, tier1, tier2), first match wins.
MERCHANT_OVERRIDES = [
    (r"(?i)uber\s*eats", "Dining Out", "Restaurant"),
    (r"(?i)doordash|grubhub", "Dining Out", "Restaurant"),
]

# Built-in rules (kind, pattern, (primary, detailed), trust), first match wins.
RULES = [
    ("pos_prefix", "COT*FLT", ("TRAVEL", "TRAVEL_FLIGHTS"), "auto"),
    ("pos_prefix", "COT*HTL", ("TRAVEL", "TRAVEL_LODGING"), "auto"),
    ("pos_prefix", "TST*", ("FOOD_AND_DRINK", "FOOD_AND_DRINK_RESTAURANT"), "flag"),
    ("website", "uber.com", ("TRANSPORTATION", "TRANSPORTATION_TAXIS_AND_RIDE_SHARES"), "flag"),
    ("website", "lyft.com", ("TRANSPORTATION", "TRANSPORTATION_TAXIS_AND_RIDE_SHARES"), "flag"),
    ("website", "doordash.com", ("FOOD_AND_DRINK", "FOOD_AND_DRINK_RESTAURANT"), "flag"),
    ("website", "grubhub.com", ("FOOD_AND_DRINK", "FOOD_AND_DRINK_RESTAURANT"), "flag"),
    ("website", "starbucks.com", ("FOOD_AND_DRINK", "FOOD_AND_DRINK_COFFEE"), "flag"),
    ("website", "netflix.com", ("ENTERTAINMENT", "ENTERTAINMENT_TV_AND_MOVIES"), "flag"),
    ("website", "spotify.com", ("ENTERTAINMENT", "ENTERTAINMENT_MUSIC_AND_AUDIO"), "flag"),
    ("website", "amazon.com", ("GENERAL_MERCHANDISE", "GENERAL_MERCHANDISE_ONLINE_MARKETPLACES"), "flag"),
    ("website", "walmart.com", ("GENERAL_MERCHANDISE", "GENERAL_MERCHANDISE_SUPERSTORES"), "flag"),
    ("website", "target.com", ("GENERAL_MERCHANDISE", "GENERAL_MERCHANDISE_SUPERSTORES"), "flag"),
    ("keyword", "uber", ("TRANSPORTATION", "TRANSPORTATION_TAXIS_AND_RIDE_SHARES"), "flag"),
    ("keyword", "lyft", ("TRANSPORTATION", "TRANSPORTATION_TAXIS_AND_RIDE_SHARES"), "flag"),
    ("keyword", "starbucks", ("FOOD_AND_DRINK", "FOOD_AND_DRINK_COFFEE"), "flag"),
    ("keyword", "netflix", ("ENTERTAINMENT", "ENTERTAINMENT_TV_AND_MOVIES"), "flag"),
    ("keyword", "spotify", ("ENTERTAINMENT", "ENTERTAINMENT_MUSIC_AND_AUDIO"), "flag"),
    ("keyword", "shell", ("TRANSPORTATION", "TRANSPORTATION_GAS"), "flag"),
    ("keyword", "chevron", ("TRANSPORTATION", "TRANSPORTATION_GAS"), "flag"),
]

# Fixed values: (text label, shown when) for the step that last set a category.
STEP_BADGES = {
    "mechanical": "🔧 rule",
    "llm": "🤖 LLM",
    "review": "👁 review",
    "manual": "✏️ manual",
}
PENDING_BADGE = "⏳ suggestion"

# The noise pattern of merchant-name normalisation.
MERCHANT_NOISE = (
    r"((?<![a-z])x{2,}|\d{2,}|#\w+|\*|\bna\b|\bllc\b|\binc\b|\bending in.*"
    r"|\bpay date.*|\breg shs.*|\bid:.*|\bref:.*)"
)

# Authority model.
CONFIDENCE_LEVELS = ["LOW", "MEDIUM", "HIGH", "VERY_HIGH", "UNKNOWN"]
TRUSTED_LEVELS = ["HIGH", "VERY_HIGH"]
INFLOW_PRIMARIES = ["INCOME", "TRANSFER_IN"]
CORRECTED = "CORRECTED"
HASH_PENDING_REVIEWER = "pending:llm-stage-skipped"
HASH_PENDING_REVOKED = "pending:manual-edit-revoked"

# Recurrence periods (days, tolerance), coefficient-of-variation limit.
RECURRENCE_PERIODS = [(7, 3), (14, 4), (30, 6), (90, 12)]
RECURRENCE_MAX_CV = 0.35

# Repair window, safety-net window, stale pending age, outlier count (days / rows).
BACKSTOP_DAYS = 7
EMPTY_BACKFILL_DAYS = 730
OVERFETCH_WINDOW_DAYS = 90
STALE_TAIL_DAYS = 3
STALE_PENDING_DAYS = 14
OUTLIER_ROWS = 10
ID_SAMPLE = 20

# Fields a correction may change, and the layer that owns each.
FIELD_LAYER = {
    "pfc_detailed": "upstream",
    "merchant_name": "upstream",
    "merchant_entity_id": "upstream",
    "tier0": "local",
    "tier1": "local",
    "tier2": "local",
}


def menu_pairs():
    """(primary, detailed) of the legal menu, in menu order."""
    return [(p, leaf) for p, leaves in MENU.items() for leaf in leaves]


def atom_pairs():
    """(primary, detailed) of every atom the taxonomy maps."""
    return menu_pairs() + RETIRED_ATOMS
