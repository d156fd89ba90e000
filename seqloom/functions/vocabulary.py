"""Fixed values of the event domain: types, statuses, codes, limits and patterns."""

# --- fixed values: event types and the order status each one leads to ---
STATUS_OF_EVENT = {
    "OrderCreated": "pending",
    "InventoryValidated": "inventory_validated",
    "PaymentProcessed": "payment_processed",
    "OrderShipped": "shipped",
    "OrderCompleted": "completed",
    "ABORT_PLAN": "aborted",
}
ABORT = "ABORT_PLAN"
EVENT_TYPES = list(STATUS_OF_EVENT)
SEQUENCED_TYPES = [t for t in EVENT_TYPES if t != ABORT]

# --- fixed values: statuses an order row may hold ---
ORDER_STATUSES = [
    "pending",
    "inventory_validated",
    "payment_processed",
    "shipped",
    "completed",
    "cancelled",
    "aborted",
]

# --- fixed values: abort reasons and their codes; anything else is manual ---
ABORT_CODE_OF_REASON = {
    "items_empty": "manual",
    "invalid_amount": "manual",
    "amount_exceeds_limit": "manual",
    "amount_mismatch": "manual",
    "inventory_failed": "inventory_failed",
    "payment_rejected": "payment_rejected",
}
DEFAULT_ABORT_CODE = "manual"
ABORT_REASON_PREFIX = "Validacao do plano falhou: "

# --- fixed values: verdicts of the sequence gate ---
OK = "OK"
DUPLICATE = "DUPLICATE"
OUT_OF_ORDER = "OUT_OF_ORDER"
ABORTED = "ABORTED"

# --- fixed values: dead-letter codes and reasons ---
PARSE_ERROR = "PARSE_ERROR"
MISSING_SEQ_ID = "MISSING_SEQ_ID"
DB_ERROR = "DB_ERROR"
BUFFER_TIMEOUT = "BUFFER_TIMEOUT"
REASON_PARSE = "failed to parse event JSON"
REASON_MISSING_SEQ = "missing seq_id for non-ABORT event"
REASON_DB_PREFIX = "db process error: "
REASON_TIMEOUT = "buffer timeout: consecutive event never arrived"

# --- fixed values: planner and storage ---
ORDER_MAX_AMOUNT = 100000
AMOUNT_TOLERANCE = 0.01
DEFAULT_CURRENCY = "BRL"
SCHEMA_VERSION = "1.0"
OUTBOX_TOPIC = "order-notifications"
FINAL_SEQ = 5

# --- fixed values: delivery ---
RETRY_MAX = 3
RETRY_DELAY_SECONDS = 5
OUTBOX_BATCH = 50
BREAKER_DEFAULTS = {
    "failure_threshold": 5,
    "success_threshold": 2,
    "timeout_seconds": 10,
    "open_duration_seconds": 30,
}

# --- fixed values: lifetimes ---
BUFFER_TTL_SECONDS = 3600
ABORT_TTL_SECONDS = 86400

# --- fixed values: patterns ---
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
PLAN_ID_PATTERN = "^plan_[a-zA-Z0-9_-]+$"
TRACEPARENT_PATTERN = "^00-([0-9a-f]{32})-([0-9a-f]{16})-01$"
DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATE_TIME_PATTERN = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?"
    "(Z|[+-][0-9]{2}:[0-9]{2})$"
)

# --- fixed values: limits of the order table's columns ---
MAX_STORED_STEP = 2**31 - 1
MAX_USER_ID = 50
MAX_PLAN_ID = 100
