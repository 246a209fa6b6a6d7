"""Lists, patterns and weights that results depend on word for word.

Nothing here is logic. Every operator takes these as defaults and accepts other
values from the caller.
"""

# --- Fixed values: mail labels, in id order -------------------------------------
LABELS = ["advertising", "marketing", "privacy", "newsletter", "notification"]
UNDECIDED_LABELS = ["unlabelled", "ambiguous"]

# --- Fixed values: phrases per label and strength -------------------------------
# "is livestreaming" and "uploaded a new video" are two phrases here.
KEYWORDS = {
    "advertising": {
        "strong": [
            "buy now", "shop now", "discount code", "promo code", "coupon", "voucher code",
            "limited time offer", "free shipping", "free delivery", "save %", "clearance",
            "flash sale", "exclusive offer", "exclusive deal", "offer ends", "last chance",
            "order now", "claim your",
        ],
        "weak": [
            "sale", "discount", "deal", "special price", "reduced price", "save money",
            "lowest price", "bundle offer", "gift card", "free trial",
        ],
    },
    "marketing": {
        "strong": [
            "introducing", "announcing", "launching", "new product", "new service",
            "new feature", "new features", "product update", "platform update", "upgrade",
            "upgrade now", "try our", "start your free", "free trial", "get started",
            "customer success", "customer story", "case study", "success story", "webinar",
            "whitepaper", "ebook", "request a demo", "book a demo", "schedule a demo",
            "see what's new",
        ],
        "weak": [
            "coming soon", "now available", "available now", "learn more", "discover",
            "explore", "announcement", "release", "campaign", "collection", "experience",
            "marketing preferences",
        ],
    },
    "privacy": {
        "strong": [
            "gdpr", "general data protection regulation", "data protection",
            "updated our privacy policy", "our privacy policy",
            "terms of service and privacy policy", "terms of use and privacy policy",
            "privacy notice", "privacy statement", "subject access request",
            "right to erasure", "right to access", "updated privacy policy",
            "changes to our privacy", "changes to data practices",
        ],
        "weak": [
            "data processing", "processing your personal data", "processing of your data",
            "legal basis", "data subject", "delete my data", "request my data",
        ],
    },
    "newsletter": {
        "strong": [
            "newsletter", "monthly newsletter", "weekly newsletter", "news letter", "edition",
            "daily digest", "weekly digest", "monthly digest", "roundup", "top stories",
            "latest stories", "more new posts", "switch to weekly", "switch to daily",
            "get the latest",
        ],
        "weak": [
            "digest", "monthly update", "weekly update", "daily update", "daily email",
            "latest news", "highlights", "what's new", "this month", "this week's",
            "from our blog", "community update",
        ],
    },
    "notification": {
        "strong": [
            "mentioned you", "tagged you", "commented on", "liked your", "reacted to",
            "new follower", "new friend request", "friend request", "verification code",
            "two-factor authentication", "2fa code", "one time code", "password reset",
            "new sign-in", "login attempt", "suspicious activity", "device signed in",
            "went live", "is now live", "is live now", "is live streaming",
            "is livestreaming", "uploaded a new video", "new subscriber",
        ],
        "weak": [
            "security alert", "new device", "people you may know", "someone shared",
            "new video", "channel update", "premiere", "notification", "alert", "reminder",
            "new posts",
        ],
    },
}
KEYWORD_POINTS = {"strong": 2, "weak": 1}

# --- Fixed values: sites named in username queries, in query order --------------
SOCIAL_SITES = [
    "facebook.com", "linkedin.com", "instagram.com", "x.com", "reddit.com", "tiktok.com",
    "threads.net", "youtube.com", "pinterest.com", "flickr.com",
]
DEV_SITES = [
    "github.com", "gitlab.com", "bitbucket.org", "stackoverflow.com", "npmjs.com",
    "pypi.org", "huggingface.co",
]
LEAK_SITES = ["pastebin.com", "controlc.com", "ghostbin.com", "paste.ee", "justpaste.it"]

# --- Fixed values: words added to exact queries ---------------------------------
EMAIL_QUERY_WORDS = ["leak", "breach", "password"]
PHONE_QUERY_WORDS = ["leak", "pastebin"]

# --- Fixed values: domains that make a page link a social link ------------------
SOCIAL_LINK_DOMAINS = [
    "facebook.com", "linkedin.com", "github.com", "gitlab.com", "reddit.com", "x.com",
    "instagram.com", "youtube.com",
]

# --- Fixed values: text patterns (Unicode classes switched on for the JVM) ------
EMAIL_PATTERN = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"(?U)(?:\+44\s?|\(?0\d{2,4}\)?[\s.-]?)\d{3,4}[\s.-]?\d{3,4}"
ANGLE_ADDRESS_PATTERN = r"(?U)<([\w.-]+@[\w.-]+\.\w+)>"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
ZERO_WIDTH_CHARS = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF]))

# --- Fixed values: elements whose content is not page text ----------------------
NON_TEXT_TAGS = ["script", "style", "noscript", "svg", "iframe"]
HIDDEN_TEXT_TAGS = ["template", "rt", "rp"]

# --- Fixed values: scores -------------------------------------------------------
RISK_POINTS = {"email": 25, "phone": 40}
TERM_CONFIDENCE = {"email": 1.0, "username": 1.0, "name": 1.0, "location": 0.8, "phone": 1.0}
QUERY_CONFIDENCE = {
    "email": 1.0, "phone": 1.0, "username": 0.9, "name_and_location": 0.6, "name": 0.2,
}

# --- Fixed values: review decisions ---------------------------------------------
REVIEW_CHOICES = {"v": "verified", "f": "false_positive", "i": "ignored", "r": "pending"}
DECIDED_STATUSES = ["verified", "false_positive", "ignored"]

# --- Fixed values: training settings --------------------------------------------
VOCABULARY_SIZE = 10_000
HELD_OUT_SHARE = (1, 5)
SPLIT_SEED = 42
SVM_PENALTY = 1.0
SVM_ITERATIONS = 1000
SVM_FITS_AT_ONCE = 5
SEQUENCE_LENGTH = 256
HITS_PER_QUERY = 10
INBOX_SIZE = 500
SEARCH_ENGINE = "duckduckgo"
PREVIEW_CHARS = 1000
