"""Fixed values.

Word lists, lookup tables, patterns and formats that must be equal to the published behaviour for results to match.
They are data, kept in their natural order; order is the priority where a rule says "first match wins".
"""

from __future__ import annotations

# --- fixed values: tokens -------------------------------------------------------------------------------------------
TOKEN_OPEN = "⟦"
TOKEN_CLOSE = "⟧"
TOKEN_PATTERN = "⟦[A-Z0-9]{2}_[A-Z_]+_[A-Z0-9]{3,16}⟧"

# --- fixed values: organisation suffix words ------------------------------------------------------------------------
ORG_SUFFIX_WORDS = [
    "Inc", "LLC", "Ltd", "Limited", "Pvt", "Corp", "Corporation", "Co", "LLP", "GmbH",
    "Technologies", "Technology", "Tech", "Solutions", "Labs", "Systems", "Infotech",
    "Software", "Softwares", "Services", "Group", "Consulting", "Enterprises",
    "Industries", "Studio", "Studios", "Infosystems", "Networks", "Digital",
]
_ORG = "|".join(ORG_SUFFIX_WORDS)
ORG_VALUE_PATTERN = rf"(?i)\b(?:{_ORG})\b\.?$"
ORG_WORD_PATTERN = rf"(?i)\b(?:{_ORG})\b"
ORG_TEXT_PATTERN = rf"\b(?:[A-Z][\w&.-]*\s+){{0,4}}(?:{_ORG})\b\.?"

# --- fixed values: recognizers (type, pattern, score), in priority order --------------------------------------------
STREET_PATTERN = (
    r"\b\d+\s+[A-Za-z0-9\s,.-]+?(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Court|Ct|Way|Circle"
    r"|Cir|Pointe|Place|Pl|Terrace|Ter|Row)\b(?:,\s*[A-Za-z\s]+)?(?:,\s*[A-Z]{2}\s+\d{5})?"
)
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
SALARY_PATTERN = r"\$[\d,]+(?:\.\d+)?(?:[KMBkmb])?(?:/(?:year|yr|month|mo|hour|hr))?"
RECOGNIZERS = [
    ("US_SSN", SSN_PATTERN, 0.95),
    ("EMAIL_ADDRESS", EMAIL_PATTERN, 0.95),
    ("PHONE_NUMBER", PHONE_PATTERN, 0.88),
    ("SALARY", SALARY_PATTERN, 0.92),
    ("PROJECT_CODE", r"PRJ-\d{4}-[A-Z0-9]{4,}", 0.95),
    ("EMPLOYEE_ID", r"EMP-\d{5,}", 0.95),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", 0.95),
    ("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+(?:-[A-Za-z]+)?\b", 0.86),
    ("ORGANIZATION", ORG_TEXT_PATTERN, 0.90),
    ("LOCATION", STREET_PATTERN, 0.90),
]

PERSON_STOP_PHRASES = [
    "senior engineer", "junior engineer", "software engineer", "staff engineer",
    "vice president", "human resources", "compensation review", "project manager",
    "product manager", "team lead", "executive officer", "finance team", "engineering team",
    "chief executive", "chief technology", "chief financial", "security review",
    "social security", "security number", "security officer", "information security",
]

# --- fixed values: entity categories --------------------------------------------------------------------------------
ENTITY_CATEGORIES = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "IP_ADDRESS", "LOCATION",
    "ORGANIZATION", "SALARY", "PROJECT_CODE", "EMPLOYEE_ID",
]
CATEGORY_ALIASES = {"SSN": "US_SSN", "EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER"}
DEFAULT_MIN_CONFIDENCE = 0.85
CLASSIFICATIONS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]
REDACTION_POLICIES = ["TOKENIZE", "REDACT", "PASSTHROUGH"]

# --- fixed values: table headers, column typing, sentence templates -------------------------------------------------
PLAIN = "PLAIN"
HEADER_PREDICATES = {
    "ssn": "HAS_SSN",
    "social security": "HAS_SSN",
    "social security number": "HAS_SSN",
    "salary": "HAS_SALARY",
    "compensation": "HAS_SALARY",
    "pay": "HAS_SALARY",
    "wage": "HAS_SALARY",
    "annual salary": "HAS_SALARY",
    "base salary": "HAS_SALARY",
    "email": "HAS_EMAIL",
    "email address": "HAS_EMAIL",
    "phone": "HAS_PHONE",
    "phone number": "HAS_PHONE",
    "mobile": "HAS_PHONE",
    "contact": "HAS_CONTACT",
    "role": "HAS_ROLE",
    "title": "HAS_ROLE",
    "job title": "HAS_ROLE",
    "position": "HAS_ROLE",
    "department": "IN_DEPARTMENT",
    "dept": "IN_DEPARTMENT",
    "manager": "REPORTS_TO",
    "reports to": "REPORTS_TO",
    "supervisor": "REPORTS_TO",
    "reason": "HAS_REASON",
    "status": "HAS_STATUS",
    "address": "HAS_ADDRESS",
    "home address": "HAS_ADDRESS",
    "street address": "HAS_ADDRESS",
    "location": "LOCATED_IN",
    "hire date": "HIRED_ON",
    "start date": "STARTED_ON",
}
PREDICATE_ENTITY_TYPES = {
    "HAS_SSN": "US_SSN",
    "HAS_SALARY": "SALARY",
    "HAS_EMAIL": "EMAIL_ADDRESS",
    "HAS_PHONE": "PHONE_NUMBER",
    "HAS_ADDRESS": "LOCATION",
    "LOCATED_IN": "LOCATION",
    "REPORTS_TO": "PERSON",
}
ORG_HEADER_PATTERN = (
    r"\b(company|companies|organi[sz]ation|firm|employer|vendor|client|business|agency|supplier)\b"
)
PERSON_HEADER_PATTERN = r"^(name|full name|person|employee|employee name|contact person|candidate|student)$"
URL_HEADER_PATTERN = r"\b(website|url|link|maps|web)\b"
RATING_HEADER_PATTERN = r"\b(rating|ratings|score|stars?|reviews?)\b"
CATEGORY_HEADER_PATTERN = (
    r"\b(category|categories|industry|type|sector|service|services|status|domain)\b"
)
URL_VALUE_PATTERN = r"(?i)^(https?://|www\.)\S+$"
RATING_VALUE_PATTERN = r"^\d(\.\d)?\s*(\(\d+\))?$"
PERSON_VALUE_PATTERN = r"^[A-Za-z.'\-]+(?:\s+[A-Za-z.'\-]+){1,3}$"
SAMPLE_ROWS = 50
URL_FRACTION = RATING_FRACTION = 0.8
ORG_FRACTION = PERSON_FRACTION = 0.5
SENTENCE_TEMPLATES = {
    "HAS_SSN": "{subj} has SSN {val}.",
    "HAS_SALARY": "{subj} earns {val}.",
    "HAS_EMAIL": "{subj} has email {val}.",
    "HAS_PHONE": "{subj} has contact {val}.",
    "HAS_HOURS": "{subj} has operating hours {val}.",
    "HAS_ROLE": "{subj} is a {val}.",
    "HAS_CATEGORY": "{subj} is a {val}.",
    "IN_DEPARTMENT": "{subj} works in {val} department.",
    "REPORTS_TO": "{subj} reports to {val}.",
    "HAS_REASON": "{subj} has reason {val}.",
    "HAS_ADDRESS": "{subj} has address {val}.",
    "HIRED_ON": "{subj} was hired on {val}.",
    "HAS_RATING": "{subj} has rating {val}.",
    "HAS_LINK": "{subj} has google maps link {val}.",
    "HAS_WEBSITE": "{subj} has website {val}.",
}
# A separator row under a table header, and one separator cell.
TABLE_SEPARATOR_CELL = r"^:?-+:?$"

# --- fixed values: composite cells ----------------------------------------------------------------------------------
CELL_PHONE = (
    r"(?:\+?91[\s-]?)?0?[6-9]\d{4}[\s-]?\d{5}\b|\b0\d{2,4}[\s-]?\d{6,8}\b"
    r"|\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
    r"|\+\d{1,4}[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}\b"
)
CELL_EMAIL = EMAIL_PATTERN
CELL_HOURS = (
    r"(?i)(?:[A-Za-z]+[-–to]+[A-Za-z]+\s+)?\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\s*[-–to]+\s*\d{1,2}(?::\d{2})?\s*"
    r"(?:am|pm)\b"
    r"|(?:(?:Open|Closed|Closes)(?:\s+soon)?(?:\s*[·•|\-–]\s*)?)?(?:Closes|Opens|Open)?\s*"
    r"(?:\d{1,2}(?::\d{2})?\s*(?:am|pm)|24 hours)(?:\s+[A-Za-z]+)?"
    r"|\b(?:Open|Closed)\s+24\s+hours\b"
)
CELL_CURRENCY = r"[$€£₹]\s*[\d,]+(?:\.\d+)?(?:[KMBkmb])?(?:/(?:year|yr|month|mo|hour|hr))?"
CELL_RATING = r"\b([1-5](?:\.\d)?)\s*(?:/\s*5|\bstar[s]?\b|\(\d+\))\b|\b([1-5]\.\d)\b"
CELL_URL = r"(?i)https?://\S+|www\.\S+"
CELL_ADDRESS_WORDS = (
    r"(?i)\b(street|st|avenue|ave|road|rd|colony|lane|ln|drive|dr|boulevard|blvd|highway|expy|nagar|nivas|marg|bldg"
    r"|building|plaza|floor|suite|apt|room|po\s*box)\b"
)
CELL_CATEGORY_WORDS = (
    r"(?i)\b(company|agency|services|support|consultant|consultancy|solutions|systems|technologies|clinic|hospital"
    r"|store|center|firm|enterprise|laboratory|labs)\b"
)
CELL_NOISE = (
    r"(?i)^(?:website|directions|online appointments|share|save|no reviews|\?|[\x{E000}-\x{F8FF}\s·•|\-_])+$"
)
CELL_DELIMITER = r"\s*[|;·•\n]\s*"
CELL_KEY_VALUE = r"^\s*([A-Za-z0-9_\s]{2,30})\s*[:=]\s*(.+)$"
CELL_TRIM_CHARS = ".!?,|·• "
PAY_LABELS = ["HAS_BASE", "HAS_PAY", "HAS_WAGE", "HAS_COMPENSATION"]

# --- fixed values: verb phrases in priority order, and pronouns -----------------------------------------------------
VERB_PREDICATES = {
    "has google maps link": "HAS_LINK",
    "has google maps": "HAS_LINK",
    "has maps link": "HAS_LINK",
    "has website": "HAS_WEBSITE",
    "has rating": "HAS_RATING",
    "has reviews": "HAS_REVIEWS",
    "has details": "HAS_DETAILS",
    "has operating hours": "HAS_HOURS",
    "has hours": "HAS_HOURS",
    "has phone": "HAS_PHONE",
    "has notes": "HAS_DETAILS",
    "has category": "HAS_CATEGORY",
    "manages a budget of": "MANAGES_BUDGET",
    "reports to": "REPORTS_TO",
    "reporting to": "REPORTS_TO",
    "works for": "WORKS_FOR",
    "working for": "WORKS_FOR",
    "works in": "IN_DEPARTMENT",
    "working in": "IN_DEPARTMENT",
    "has home address": "HAS_ADDRESS",
    "has address": "HAS_ADDRESS",
    "lives at": "HAS_ADDRESS",
    "resides at": "HAS_ADDRESS",
    "was hired on": "HIRED_ON",
    "hired on": "HIRED_ON",
    "has ssn": "HAS_SSN",
    "has salary": "HAS_SALARY",
    "has compensation": "HAS_SALARY",
    "has email": "HAS_EMAIL",
    "has contact": "HAS_CONTACT",
    "has reason": "HAS_REASON",
    "has role": "HAS_ROLE",
    "has title": "HAS_ROLE",
    "offered a retention bonus equal to": "HAS_RETENTION_BONUS",
    "offered a retention package of": "HAS_RETENTION_BONUS",
    "retention bonus equal to": "HAS_RETENTION_BONUS",
    "retention package of": "HAS_RETENTION_BONUS",
    "promoted to": "PROMOTED_TO",
    "earns": "HAS_SALARY",
    "earning": "HAS_SALARY",
    "earned": "HAS_SALARY",
    "manages": "MANAGES",
    "manage": "MANAGES",
    "managing": "MANAGES",
    "leads": "LEADS",
    "leading": "LEADS",
    "oversees": "OVERSEES",
    "overseeing": "OVERSEES",
    "supervises": "SUPERVISES",
    "supervising": "SUPERVISES",
    "owns": "OWNS",
    "owning": "OWNS",
    "contacts": "HAS_CONTACT",
    "contact": "HAS_CONTACT",
    "is a": "HAS_ROLE",
    "is an": "HAS_ROLE",
    "is": "IS_A",
    "are": "IS_A",
    "was": "IS_A",
    "has": "HAS",
    "have": "HAS",
    "having": "HAS",
}
PRONOUNS = ["he", "she", "they", "it", "this", "the employee", "the individual", "the engineer", "the manager"]
CLAUSE_PATTERN = r"(?i)\b(?:and|but|while|also|furthermore)\b|;"
RETENTION_PATTERN = r"(?i)(?:retention\s+bonus\s+equal\s+to|retention\s+package\s+of)\s+([^,.]+)"
RETENTION_ROLES = [
    ("CEO", "chief executive"),
    ("CFO", "chief financial"),
    ("COO", "chief operating"),
]

# --- fixed values: graph --------------------------------------------------------------------------------------------
HUB_PREDICATES = ["IN_DEPARTMENT", "WORKS_FOR", "LOCATED_IN", "IS_A", "HAS_STATUS"]
EDGE_LIMIT = 100

# --- fixed values: retrieval ----------------------------------------------------------------------------------------
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "what", "who",
    "which", "how", "where", "when", "do", "does", "did", "can",
    "could", "would", "should", "will", "has", "have", "had",
    "this", "that", "these", "those", "of", "in", "on", "at",
    "to", "for", "with", "by", "from", "and", "or", "but", "not",
    "about", "me", "my", "tell", "show", "find", "get",
]
DEPARTMENTS = [
    "engineering", "sales", "operations", "marketing", "customer success", "legal", "finance", "executive",
]
HIERARCHY_WORDS = ["report", "hierarchy", "manager", "supervisor", "chain", "who does", "leads", "oversees"]
NO_MATCH_CONTEXT = "# Knowledge Graph Context\n\nNo matching entities found in the graph."
NO_RECORDS_ANSWER = "I could not find matching records in the knowledge base for this query."
NO_LIST_ANSWER = "No matching records found in the knowledge base."
LIST_HEADER = "Here are the matching records:"
PROMOTION_HEADER = "Here are the employees who received a salary increase specifically because of a promotion:"

# --- fixed values: answer wording -----------------------------------------------------------------------------------
INTENT_RULES = [
    ("HAS_RATING", ["rating", "score", "star"]),
    ("HAS_HOURS", ["hour", "timing", "schedule", "when does", "open", "close"]),
    ("HAS_LINK", ["map", "link", "website", "url"]),
    ("HAS_DETAILS", ["business", "type of", "service", "industry", "detail"]),
    ("HAS_REASON", ["reason", "why", "justification", "promotion"]),
    ("HAS_SSN", ["ssn", "social security"]),
    ("HAS_SALARY", ["salary", "compensation", "earn", "pay", "wage"]),
    ("HAS_EMAIL", ["email"]),
    ("HAS_PHONE", ["contact", "phone"]),
    ("HAS_ADDRESS", ["address", "location", "where", "live"]),
    ("HIRED_ON", ["hire date", "start date", "hired"]),
    ("HAS_ROLE", ["role", "title", "position", "job"]),
    ("IN_DEPARTMENT", ["department", "dept"]),
    ("REPORTS_TO", ["manager", "reports to", "supervisor", "who does"]),
]
LIST_PHRASES = [
    "list", "show all", "all employees", "which employees", "who are", "everyone", "table", "which companies",
    "companies with", "all companies",
]
READABLE_PREDICATES = {
    "HAS_SSN": "SSN",
    "HAS_SALARY": "salary",
    "HAS_REASON": "compensation reason",
    "HAS_EMAIL": "email",
    "HAS_CONTACT": "contact information",
    "HAS_PHONE": "phone number",
    "HAS_ROLE": "role",
    "IN_DEPARTMENT": "department",
    "REPORTS_TO": "manager",
    "MANAGES_BUDGET": "team budget",
    "MANAGES": "manages",
    "LEADS": "leads",
    "WORKS_FOR": "employer",
    "HAS_ADDRESS": "address",
    "HIRED_ON": "hire date",
    "HAS_RETENTION_BONUS": "retention bonus",
    "HAS_RATING": "rating",
    "HAS_LINK": "Google Maps link",
    "HAS_WEBSITE": "website",
    "HAS_DETAILS": "business details",
    "HAS_CATEGORY": "category",
    "HAS_REVIEWS": "reviews",
}
# Wording of a single-fact answer per predicate.
ANSWER_PHRASES = {
    "HAS_SSN": "{s}'s SSN is {v}.",
    "HAS_SALARY": "{s} earns {v}.",
    "HAS_REASON": "The reason on record for {s} is {v}.",
    "HAS_EMAIL": "{s}'s email is {v}.",
    "HAS_CONTACT": "{s} can be reached at {v}.",
    "HAS_PHONE": "{s} can be reached at {v}.",
    "HAS_ADDRESS": "{s}'s address is {v}.",
    "HAS_HOURS": "{s}'s operating hours are {v}.",
    "HIRED_ON": "{s} was hired on {v}.",
    "HAS_ROLE": "{s} is a {v}.",
    "IN_DEPARTMENT": "{s} works in the {v} department.",
    "REPORTS_TO": "{s} reports to {v}.",
    "HAS_RATING": "{s} has a rating of {v}.",
    "HAS_LINK": "The Google Maps link for {s} is {v}.",
    "HAS_DETAILS": "{s} details: {v}.",
}
SSN_LONG_PHRASE = "{s}'s Social Security Number is {v}."
# Facts named in an entity summary, in order.
SUMMARY_PHRASES = [
    ("HAS_ROLE", "is a "),
    ("IN_DEPARTMENT", "works in "),
    ("HAS_SALARY", "earns "),
    ("REPORTS_TO", "reports to "),
    ("MANAGES_BUDGET", "manages a budget of "),
    ("HAS_REASON", "has reason on record: "),
    ("HAS_SSN", "has SSN "),
    ("HAS_ADDRESS", "lives at "),
    ("HAS_CONTACT", "can be reached at "),
    ("HAS_RATING", "has a rating of "),
    ("HAS_DETAILS", "is described as "),
    ("HAS_LINK", "Google Maps link: "),
]
EXECUTIVE_ROLES = ["CEO", "CFO", "COO", "CTO", "CIO", "CHRO", "CMO"]
DEFAULT_RETENTION_TERMS = "100% of base salary upon deal close"

# --- fixed values: scans --------------------------------------------------------------------------------------------
INJECTION_PATTERNS = [
    (r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)", "Instruction override attempt"),
    (r"(?i)you\s+are\s+now\s+(?:a|an)\s+", "Role hijacking attempt"),
    (r"(?i)system\s*:\s*", "System prompt injection"),
    (r"(?i)<\|(?:im_start|system|assistant)\|>", "Chat template injection"),
    (
        r"(?i)(?:output|print|show|reveal|display)\s+(?:the\s+)?(?:system|original|real|hidden)\s+",
        "Data exfiltration attempt",
    ),
    (r"(?i)\b(?:fetch|curl|wget)\s+https?://|(?:fetch|curl|wget)://", "URL injection attempt"),
    (
        r"(?i)\b(?:vault\s+(?:contents?|passwords?|keys?|data|secrets?)|api[_\s\-]?keys?|master[_\s\-]?keys?"
        r"|private[_\s\-]?keys?|token[_\s\-]?vault|encryption[_\s\-]?keys?)\b"
        r"|\b(?:show|reveal|display|dump|extract|leak|expose|steal)\b(?:\s+\w+){0,4}\s+\b(?:vault|passwords?"
        r"|credentials?|api[_\s\-]?keys?|master[_\s\-]?keys?|private[_\s\-]?keys?|token[_\s\-]?vault)\b",
        "Vault probing attempt",
    ),
    (
        r"(?i)\b(?:decrypt\s+(?:all|the|tokens?|data)|decryption\s+key|master[_\s\-]?key|private[_\s\-]?key)\b",
        "Decryption probing attempt",
    ),
]
LEAK_PATTERNS = [
    (SSN_PATTERN, "SSN pattern detected"),
    (r"\b\d{16}\b", "Credit card number pattern detected"),
    (EMAIL_PATTERN, "Email pattern detected"),
]

# --- fixed values: audit --------------------------------------------------------------------------------------------
GENESIS = "GENESIS"
AUDIT_EVENTS = [
    "DOCUMENT_INGESTED", "DOCUMENT_DELETED", "ENTITY_DETECTED", "TOKEN_CREATED", "VAULT_ACCESSED", "QUERY_SENT",
    "QUERY_RECONSTRUCTED", "INJECTION_BLOCKED", "ACCESS_DENIED",
]
ROSTER_PATTERN = r"(?i)\b(?:\d+[a-z]?\.?\s+)?([A-Za-z\s&]+?)\s+Department\s+Roster\b"
ROSTER_PREFIX_PATTERN = r"(?i)^(?:section\s+)?(?:\d+[a-z]?\.?\s*[-:]?\s*)?"
