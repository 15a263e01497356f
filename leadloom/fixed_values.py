"""Everything in this module is data that results depend on.

Word lists, lookup tables, weights, cut-offs, selectors, column orders and message
texts are stated here once, as text, in natural order. No logic lives here.
"""

# The marker for a missing field, and texts that count as missing.
MISSING = "N/A"
MISSING_TEXTS = ["", "N/A", "None"]

# Source trust, matched on the lower-cased source tag.
SOURCE_TRUST = {
    "google_maps": 0.9,
    "justdial": 0.7,
    "indiamart": 0.6,
    "yellowpages": 0.75,
    "clutch": 0.9,
    "trustpilot": 0.85,
    "bbb": 0.85,
    "yelp": 0.80,
    "kompass": 0.75,
    "europages": 0.70,
    "thomasnet": 0.70,
    "manta": 0.65,
    "bark": 0.65,
    "hotfrog": 0.60,
    "cylex": 0.55,
    "expertise": 0.60,
}
DEFAULT_TRUST = 0.5

# Category relevance.
HIGH_VALUE_KEYWORDS = [
    "agency", "consulting", "solutions", "services", "technology",
    "software", "digital", "marketing", "finance", "legal",
    "enterprise", "pvt", "ltd", "llp", "inc", "group",
    "international", "global", "management", "partners",
]
LOW_VALUE_KEYWORDS = [
    "home", "personal", "freelance", "individual",
    "tutor", "student", "hobby",
]
CATEGORY_START = 0.5
CATEGORY_HIGH_STEP = 0.08
CATEGORY_LOW_STEP = 0.15

# Name limits, address parts and completeness shares.
NAME_LENGTH_LIMIT = 80
NAME_WORD_LIMIT = 8
RATING_SCALE = 5.0
ADDRESS_DIGIT = 0.4
ADDRESS_COMMA = 0.3
ADDRESS_LONG = 0.3
ADDRESS_LONG_ABOVE = 30
COMPLETENESS_SHARES = {
    "has_email": 0.35,
    "has_phone": 0.25,
    "has_website": 0.20,
    "has_address": 0.20,
}

# Rule weights (added in this order) and the label threshold.
RULE_WEIGHTS = {
    "has_email": 35,
    "has_phone": 20,
    "has_website": 15,
    "rating_score": 10,
    "source_score": 8,
    "category_score": 7,
    "address_completeness": 5,
}
GOOD_LEAD_ABOVE = 45

# Feature order of the model input.
FEATURE_COLUMNS = [
    "has_email", "has_phone", "has_website", "has_address", "rating_score",
    "source_score", "name_length", "name_word_count", "category_score",
    "address_completeness", "data_completeness",
]

# Grades by lowest score, and the outreach cut-off.
GRADE_FLOORS = {"A": 75, "B": 55, "C": 35}
LOWEST_GRADE = "D"
GRADE_ORDER = {"A": 0, "B": 1, "C": 2, "D": 3}
DEFAULT_MIN_GRADE = "B"
UNKNOWN_GRADE_RANK = 99
RECOMMEND_FROM = 50

# Boosted-tree settings and holdout rule.
TREES = 150
LEARNING_RATE = 0.05
TREE_DEPTH = 4
SEED = 42
HOLDOUT_SHARE = 0.2
HOLDOUT_FROM_ROWS = 20
CLASS_NAMES = {0: "Low Quality", 1: "Good Lead"}

# Run limits.
MAX_RESULTS = 20
DAILY_LIMIT = 30

# Column orders and labels of exports.
EXPORT_ORDER = [
    "source", "business_name", "email", "phone", "address", "website", "category", "rating",
]
EXPORT_LABELS = {
    "source": "Source", "business_name": "Business Name",
    "email": "Email", "phone": "Phone", "address": "Address",
    "website": "Website", "category": "Category", "rating": "Rating",
}
SCORED_ORDER = [
    "ml_grade", "ml_score", "ml_recommend", "business_name",
    "email", "phone", "address", "website", "category", "rating", "source",
]
SCORED_LABELS = {
    "ml_grade": "Grade", "ml_score": "Score",
    "business_name": "Business", "email": "Email",
    "phone": "Phone", "address": "Address",
    "website": "Website", "category": "Category",
    "rating": "Rating", "source": "Source",
    "ml_recommend": "Recommend?",
}
YES_TEXT = "✅ YES"
NO_TEXT = "❌ NO"
WIDTH_MIN = 12
WIDTH_MAX = 50
WIDE_COLUMNS = ["address", "website"]
EXPORT_WIDE_CAP = 45
SCORED_WIDE_CAP = 40

# Search addresses per source.
MAP_SEARCH_URL = "https://www.google.com/maps/search/"
LISTING_SEARCH_URL = "https://www.justdial.com/"
SUPPLIER_SEARCH_URL = "https://dir.indiamart.com/search.mp?ss="

# Selectors per source, in order of preference. "take" names what is
# read from the matched element: attributes first, then its text.
MAP_SITE = {
    "source": "google_maps",
    "links": ["a.hfpxzc", "div[role='feed'] a[href*='/maps/place/']"],
    "fields": {
        "names": ["h1.DUwDvf", "h1[class*='fontHeadlineLarge']", "h1"],
        "phones": [
            "button[data-item-id^='phone:tel']",
            "button[aria-label*='Phone']",
            "[data-tooltip*='+']",
            "span[aria-label*='phone' i]",
        ],
        "addresses": [
            "button[data-item-id='address']",
            "button[aria-label*='Address']",
            "[data-item-id*='address']",
        ],
        "websites": [
            "a[data-item-id='authority']",
            "a[aria-label*='website' i]",
            "a[href*='http'][aria-label]",
        ],
        "ratings": [
            "div.F7nice span[aria-hidden='true']",
            "span[aria-label*='stars' i]",
            "div.fontBodyMedium span[aria-hidden]",
        ],
        "categories": ["button.DkEaL", "span.YhemCb", "button[jsaction*='category']"],
    },
    "take": {
        "phones": ["aria-label", "data-item-id", "text"],
        "addresses": ["aria-label", "text"],
        "websites": ["href"],
    },
}
LISTING_SITE = {
    "source": "justdial",
    "cards": ["li.cntanr", "li[class*='store-cards']", "div.resultbox_info"],
    "fields": {
        "names": ["span.lng_cont_name", "a.store-name", "h2 a", ".resultbox_title_anchor"],
        "phones": ["p.contact-info", "span.contact_info", "div.telCntct", "[class*='contact']"],
        "addresses": ["span.cont_fl_addr", "p.jd_address", "[class*='address']"],
        "ratings": ["span.green-box", "[class*='rating']"],
    },
}
SUPPLIER_SITE = {
    "source": "indiamart",
    "cards": ["div.card", "div.prd-card", "div.company-listing", "div[class*='supplier']"],
    "fields": {
        "names": ["h2 a", ".company-name a", "a.companyname"],
        "phones": [".phone", "[class*='phone']", "[class*='contact']"],
        "addresses": [".company-address", "[class*='address']", "span.loc"],
    },
}

# Text removed from address labels, and characters kept in phones.
ADDRESS_LABEL = "Address: "
PHONE_NOISE = r"(?U)[^\d+\-\s()]"

# Log statuses and time format.
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
PREVIEW_LENGTH = 80

# Message texts.
UNKNOWN_CITY = "your area"
GENERATED_SUBJECT = "Quick question about {business_name}"
TEMPLATE_SUBJECT = "Quick idea for {business_name}"
TEMPLATE_BODY = (
    "Hi,\n\n"
    "I came across {business_name} and was genuinely impressed — "
    "businesses like yours in {city} are exactly who we love working with.\n\n"
    "At {company}, we help {service}. "
    "I think there's a real opportunity here worth a 10-minute conversation.\n\n"
    "Would you be open to a quick call this week?\n\n"
    "Best,\n{sender}"
)
HTML_MESSAGE = (
    "\n            <html><body style=\"font-family: Arial, sans-serif; font-size: 14px; \n"
    "                               color: #333; max-width: 600px;\">\n"
    "                {body}\n"
    "            </body></html>\n            "
)
# The first two lines end with a space.
PROMPT_TEXT = (
    "\nYou are an expert cold email copywriter. Write a short, highly personalized \n"
    "cold email for the following lead. \n"
    """
RULES:
- Subject line: max 8 words, curiosity-driven, no clickbait
- Email body: max 120 words
- Sound human, not robotic or salesy
- Reference something specific about their business
- ONE clear call to action at the end (reply, book call, or visit website)
- No "I hope this email finds you well"
- No generic openers
- Sign off naturally

LEAD INFO:
Business Name : {business_name}
Category      : {category}
Location      : {address}
Rating        : {rating}
Website       : {website}
ML Score      : {ml_score} / 100
ML Grade      : {ml_grade}

SENDER INFO:
Your Name     : {sender}
Your Company  : {company}
Your Service  : {service}
Your Website  : {site}

Respond ONLY as a JSON object with exactly these keys:
{{
  "subject": "...",
  "body": "..."
}}
"""
)
