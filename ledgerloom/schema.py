"""Declared schemas: nested transaction record, provenance columns, cube columns."""

PFC = "struct<primary:string,detailed:string,confidence_level:string,version:string>"
LOCATION = ("struct<address:string,city:string,region:string,postal_code:string,country:string,"
            "lat:double,lon:double,store_number:string>")
PAYMENT = ("struct<reference_number:string,ppd_id:string,payee:string,by_order_of:string,"
           "payer:string,payment_method:string,payment_processor:string,reason:string>")
COUNTERPARTIES = ("array<struct<name:string,type:string,entity_id:string,"
                  "confidence_level:string>>")

TXN_FIELDS = [
    ("transaction_id", "string"), ("account_id", "string"), ("txn_owner", "string"),
    ("pending", "boolean"), ("pending_transaction_id", "string"), ("date", "string"),
    ("authorized_date", "string"), ("datetime", "string"), ("authorized_datetime", "string"),
    ("name", "string"), ("original_description", "string"), ("merchant_name", "string"),
    ("merchant_entity_id", "string"), ("website", "string"), ("logo_url", "string"),
    ("amount", "decimal(18,2)"), ("iso_currency_code", "string"),
    ("unofficial_currency_code", "string"), ("payment_channel", "string"),
    ("transaction_type", "string"), ("transaction_code", "string"), ("check_number", "string"),
    ("account_owner", "string"), ("personal_finance_category", PFC),
    ("personal_finance_category_icon_url", "string"), ("location", LOCATION),
    ("payment_meta", PAYMENT), ("counterparties", COUNTERPARTIES),
]
TXN_COLUMNS = [n for n, _ in TXN_FIELDS]
TXN_DDL = ", ".join(f"{n} {t}" for n, t in TXN_FIELDS)

ORIGINAL_COLUMNS = ["original_pf_category_primary", "original_pf_category_detailed",
                    "original_pf_category_confidence"]
UPDATE_COLUMNS = ["category_update_step", "category_update_reason", "category_update_confidence"]
REVIEW_COLUMNS = ["category_review_flag", "category_review_primary", "category_review_detailed",
                  "category_review_reason", "category_review_confidence",
                  "category_review_source"]
STAMP_COLUMNS = ["category_audited_at", "reviewer_audited_at"]
PROVENANCE_COLUMNS = ORIGINAL_COLUMNS + UPDATE_COLUMNS + REVIEW_COLUMNS + STAMP_COLUMNS
HASH_COLUMN = "source_content_hash"

# Ours, not the source's: left out of the content hash.
NON_SOURCE_COLUMNS = set(PROVENANCE_COLUMNS) | {HASH_COLUMN, "txn_owner"}

# Bookkeeping that is no audit content when two copies of a row are compared.
METADATA_COLUMNS = ["txn_owner", "category_audited_at", "reviewer_audited_at"]

CATEGORY_LEVELS = ["tier0", "tier1", "tier2", "atom", "merchant"]
GEO_LEVELS = ["geo_scope", "geo_country", "geo_city"]
TIME_LEVELS = ["year", "quarter", "month", "week", "dow"]
FACETS = ["person", "channel", "account_type", "recurrence", "necessity", "confidence"]

ACCOUNT_SCHEMA = ("account_id string, person string, name string, type string, subtype string, "
                  "institution string, include boolean")
BUDGET_SCHEMA = "category string, goal double"
RULE_SCHEMA = ("kind string, ord int, pattern string, primary string, detailed string, "
               "trust string, origin string")
MEMORY_SCHEMA = "key string, primary string, detailed string"
VERDICT_SCHEMA = ("seq long, transaction_id string, verdict string, primary string, "
                  "detailed string, reason string")
LEDGER_COLUMNS = ["Source", "Date", "Description", "Category", "Debit", "Credit",
                  "Debit Less Credit"]
