"""Fixed values that must equal the source application's for identical results.

Everything here is data (names, codes, thresholds, keyword lists), stated plainly and in the
source's natural order. Logic lives in ``cohortlab.operators``.
"""

# ---- FIXED VALUES: id and code conventions ------------------------------------------------
# Customer ids that denote a guest / anonymous buyer (compared lower-cased and trimmed).
GUEST_IDS = ["", "0", "none", "nan", "000000000000000000000000"]
# Second guest filter applied right before feature building (compared trimmed, case-sensitive).
GHOST_IDS = ["__unattributed__", "000000000000000000000000", "0", ""]
UNATTRIBUTED = "__unattributed__"

# Purchase status codes.
STATUS_PAID = [1]
STATUS_RETURNED = {3: "Returned", 4: "Canceled"}

# Payment method code -> channel (anything else: "Other"); source code -> source (else "Web").
CHANNEL_MAP = {0: "Cash", 1: "KNET", 2: "Credit Card", 3: "Online"}
SOURCE_MAP = {0: "Web", 1: "Mobile App"}

# Offer reduction type code -> label (anything else: "Unknown").
REDUCTION_TYPE_MAP = {0: "Percentage", 1: "Fixed", 2: "Free Shipping", 3: "Buy X Get Y"}

# Country names treated as junk in the country table.
JUNK_COUNTRY_NAMES = ["test", "vfds", "ar"]

# Defaults.
DEFAULT_REGION = "Kuwait"
DEFAULT_GENDER = "Unknown"
DEFAULT_ACQUISITION = "App/Web"
DEFAULT_CATEGORY = "Other"
DEFAULT_REASON = "Not specified"
AGE_REFERENCE_DATE = "2024-01-01"
MAX_ITEM_SLOTS = 36

# ---- FIXED VALUES: model ------------------------------------------------------------------
FEATURE_NAMES = [
    "total_spend", "order_count", "recency", "aov",
    "avg_discount", "active_months", "return_rate", "diversity",
    "spend_velocity", "clv_slope",
]
# Cluster ranking weights: mean spend_365, mean order count, inverted mean recency.
RANK_WEIGHTS = {"spend": 0.40, "orders": 0.30, "recency": 0.30}
K_MIN, K_MAX = 2, 7

# Segment templates by number of clusters (name, icon, color, colorBg, description).
SEGMENT_TEMPLATES = {
    2: [
        ("VIP", "👑", "#f59e0b", "rgba(245,158,11,.12)", "High spend, frequent buyers."),
        ("Lost", "💤", "#ef4444", "rgba(239,68,68,.12)", "Low spend, high recency, churn risk."),
    ],
    3: [
        ("VIP", "👑", "#f59e0b", "rgba(245,158,11,.12)", "High spend, frequent buyers, recent activity."),
        ("Loyal", "💚", "#10b981", "rgba(16,185,129,.12)", "Regular buyers with consistent engagement."),
        ("Lost", "💤", "#ef4444", "rgba(239,68,68,.12)", "Low spend, high recency, churn risk."),
    ],
    4: [
        ("VIP", "👑", "#f59e0b", "rgba(245,158,11,.12)", "High spend, frequent buyers, recent activity."),
        ("Loyal", "💚", "#10b981", "rgba(16,185,129,.12)", "Regular buyers with consistent engagement and solid LTV."),
        ("At Risk", "⚠️", "#8b5cf6", "rgba(139,92,246,.12)", "Previously active customers drifting away — re-engagement needed."),
        ("Lost", "💤", "#ef4444", "rgba(239,68,68,.12)", "Low spend, high recency, very infrequent. Churn risk."),
    ],
    5: [
        ("VIP", "👑", "#f59e0b", "rgba(245,158,11,.12)", "High spend, frequent buyers, recent activity."),
        ("Loyal", "💚", "#10b981", "rgba(16,185,129,.12)", "Regular buyers with consistent engagement and solid LTV."),
        ("Promising", "🌱", "#3b82f6", "rgba(59,130,246,.12)", "Growing customers with increasing spend and engagement."),
        ("At Risk", "⚠️", "#8b5cf6", "rgba(139,92,246,.12)", "Previously active customers drifting away — re-engagement needed."),
        ("Lost", "💤", "#ef4444", "rgba(239,68,68,.12)", "Low spend, high recency, very infrequent. Churn risk."),
    ],
    6: [
        ("Ultra VIP", "💎", "#ec4899", "rgba(236,72,153,.12)", "Top 1% by spend — extreme frequency, highest AOV."),
        ("VIP", "👑", "#f59e0b", "rgba(245,158,11,.12)", "High spend, frequent buyers, recent activity."),
        ("Loyal", "💚", "#10b981", "rgba(16,185,129,.12)", "Regular buyers with consistent engagement and solid LTV."),
        ("Promising", "🌱", "#3b82f6", "rgba(59,130,246,.12)", "Growing customers with increasing spend and engagement."),
        ("At Risk", "⚠️", "#8b5cf6", "rgba(139,92,246,.12)", "Previously active customers drifting away — re-engagement needed."),
        ("Lost", "💤", "#ef4444", "rgba(239,68,68,.12)", "Low spend, high recency, very infrequent. Churn risk."),
    ],
    7: [
        ("Ultra VIP", "💎", "#ec4899", "rgba(236,72,153,.12)", "Top 1% by spend — extreme frequency, highest AOV."),
        ("VIP", "👑", "#f59e0b", "rgba(245,158,11,.12)", "High spend, frequent buyers, recent activity."),
        ("Loyal", "💚", "#10b981", "rgba(16,185,129,.12)", "Regular buyers with consistent engagement and solid LTV."),
        ("Promising", "🌱", "#3b82f6", "rgba(59,130,246,.12)", "Growing customers with increasing spend and engagement."),
        ("At Risk", "⚠️", "#8b5cf6", "rgba(139,92,246,.12)", "Previously active customers drifting away — re-engagement needed."),
        ("Inactifs", "😴", "#f97316", "rgba(249,115,22,.12)", "Clients inactifs depuis longtemps — aucun achat récent."),
        ("Lost", "💤", "#ef4444", "rgba(239,68,68,.12)", "Low spend, high recency, very infrequent. Churn risk."),
    ],
}

# Recommended marketing actions by segment id.
SEGMENT_ACTIONS = {
    0: [
        "Offer VIP early-access to new honey collections",
        "Send personalised thank-you gift with next order",
        "Invite to exclusive loyalty tier with free delivery",
        "Feature in social proof / ambassador programme",
    ],
    1: [
        "Bundle deal: buy 2 get 10% off on top categories",
        "Monthly newsletter with new arrivals & recipes",
        "Birthday / anniversary discount coupon",
        "Cross-sell complementary products (bee products, accessories)",
    ],
    2: [
        "Win-back campaign: 15% discount limited 7 days",
        "Re-engagement WhatsApp message with personalised offer",
        "Highlight new products since last purchase",
        "Ask for feedback to understand drop-off reason",
    ],
    3: [
        "Last-chance offer: heavy discount (20%+) to reactivate",
        "Low-cost re-engagement SMS / WhatsApp nudge",
        "Survey to collect reason for churn",
        "Consider removing from active marketing to save cost",
    ],
}

# ---- FIXED VALUES: band thresholds --------------------------------------------------------
SPEND_BANDS = (100.0, 500.0)        # low < 100 <= mid < 500 <= high
VELOCITY_BANDS = (30.0, 100.0)      # low < 30 <= mid < 100 <= high
TOP_CATEGORIES_PER_SEGMENT = 6
TOP_PRODUCTS_PER_QUARTER = 3
SAMPLE_SIZE = 1000
SILHOUETTE_SAMPLE = 5000
ACTIVE_DAYS = 90

# ---- FIXED VALUES: chat intent rules (order matters: first match wins) -------------------
# (intent, keywords, excluded keywords) — substring matches on normalised text.
INTENT_RULES = [
    ("greeting",
     ["bonjour", "salut", "hello", "hi ", "hey ", "bonsoir", "salam", "coucou"],
     ["segment", "churn", "vip", "client", "alert", "loyal", "risk"]),
    ("help",
     ["aide", "help", "que peux-tu", "que sais-tu", "que peux tu", "what can you", "capabilities"],
     []),
    ("segment_overview",
     ["tous les segments", "all segments", "segment overview", "vue ensemble", "resume des segments",
      "overview of segments", "show segments", "combien de segments"],
     []),
    ("loyal_status",
     ["loyal", "who is loyal", "who's loyal", "loyal customers", "loyal clients", "clients loyaux",
      "segment loyal", "loyal segment"],
     ["vip", "convert", "convertir", "upgrade", "passer en vip", "to vip", "en vip", "campaign", "campagne"]),
    ("vip_status",
     ["vip", "meilleur client", "top client", "client premium", "best customers", "top customers",
      "premium customers", "who is vip", "who's vip", "vip customers", "clients vip"],
     ["convertir", "convert", "passer", "devenir", "strategie", "campagne", "campaign", "upgrade", "en vip",
      "to vip", "loyal"]),
    ("at_risk_status",
     ["at risk", "risque", "churn", "churning", "danger", "alerte churn", "losing customers", "clients risque"],
     ["campaign", "campagne", "email", "whatsapp", "plan", "action", "lancer"]),
    ("revenue_question",
     ["revenu", "revenue", "chiffre d affaire", "vente", "kwd", "argent", "sales", "income", "earnings",
      "financial", "combien rapporte", "revenue of", "revenue from", "revenu de"],
     []),
    ("campaign_request",
     ["campagne", "campaign", "lancer campagne", "creer campagne", "create campaign", "launch campaign"],
     ["at risk", "vip", "lost", "perdu", "loyal", "whatsapp"]),
    ("whatsapp_request",
     ["whatsapp", "envoyer whatsapp", "send whatsapp", "message whatsapp"],
     []),
    ("lost_customers",
     ["perdu", "inactif", "lost", "reactiver", "reactivation", "win back", "winback", "recuperer", "inactive",
      "reactivate", "lapsed"],
     []),
    ("compare_segments",
     ["comparer", "comparaison", "compare", "versus", " vs ", "comparison", "which segment", "best segment",
      "quel segment"],
     []),
    ("total_customers",
     ["combien de client", "nombre de client", "total client", "base client", "how many customers",
      "total customers", "customer count", "customer base"],
     []),
    ("convert_to_vip",
     ["convertir", "convert", "passer en vip", "devenir vip", "loyal en vip", "upgrade", "convert to vip",
      "become vip", "loyal to vip"],
     []),
    ("thanks",
     ["merci", "thanks", "thank you", "parfait", "super", "excellent", "bravo", "nickel", "great", "awesome",
      "perfect"],
     ["mais", "but", "however", "segment", "client", "customer"]),
]
