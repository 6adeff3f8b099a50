"""Word lists, lookup tables and thresholds of the data model.

Everything in this module is a value that results depend on (what counts as
null, which spelling means which industry, which lead source belongs to which
channel, ...).  They are defaults; each operator takes its own as a parameter.
"""

# Cells that mean "no value" in a raw export.
NULL_TOKENS = ["null", "NULL", "None", "-", ""]

# Texts that mean "no domain" after lower-casing.
EMPTY_DOMAINS = ["nan", "none", ""]

# Free-mail providers, which never identify a company.
FREE_MAIL_DOMAINS = [
    "gmail.com",
    "yahoo.com",
    "hotmail.com",
    "outlook.com",
    "aol.com",
    "icloud.com",
    "protonmail.com",
    "live.com",
]

# Text flags. Deals accept eight tokens, other tables four.
TRUE_TOKENS = ["True", "true", "1", "yes"]
FALSE_TOKENS = ["False", "false", "0", "no"]
TRUE_TOKENS_STRICT = ["True", "true"]
FALSE_TOKENS_STRICT = ["False", "false"]

# Country aliases (lower case) and their names.
COUNTRY_ALIASES = {
    "usa": "United States",
    "us": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "gb": "United Kingdom",
    "great britain": "United Kingdom",
}

# Industry spellings found in the exports -> industry name.
INDUSTRY_NAMES = {
    "COMPUTER_SOFTWARE": "Software",
    "Computer Software": "Software",
    "Enterprise Software": "Software",
    "Software Development & Design": "Software",
    "software development & design": "Software",
    "IT Services": "IT Services",
    "It Services": "IT Services",
    "INFORMATION_TECHNOLOGY_AND_SERVICES": "IT Services",
    "Information Technology & Services": "IT Services",
    "information technology & services": "IT Services",
    "Managed Services": "Managed Services",
    "MARKETING_AND_ADVERTISING": "Marketing & Advertising",
    "Marketing & Advertising": "Marketing & Advertising",
    "marketing and advertising": "Marketing & Advertising",
    "HUMAN_RESOURCES": "Human Resources",
    "Human Resources": "Human Resources",
    "professional training & coaching": "Professional Services",
    "Professional Training & Coaching": "Professional Services",
    "Professional Services": "Professional Services",
    "PROFESSIONAL_TRAINING_AND_COACHING": "Professional Services",
    "Financial Services": "Financial Services",
    "FINANCIAL_SERVICES": "Financial Services",
    "Private Equity": "Private Equity",
    "Hardware": "Hardware",
    "INTERNET": "Internet",
    "Internet": "Internet",
    "STAFFING_AND_RECRUITING": "Staffing & Recruiting",
    "Staffing & Recruiting": "Staffing & Recruiting",
    "staffing and recruiting": "Staffing & Recruiting",
    "Telecommunications": "Telecommunications",
    "TELECOMMUNICATIONS": "Telecommunications",
    "Retail": "Retail",
    "RETAIL": "Retail",
    "Healthcare": "Healthcare",
    "HOSPITAL_AND_HEALTH_CARE": "Healthcare",
    "Hospital & Health Care": "Healthcare",
    "Education": "Education",
    "HIGHER_EDUCATION": "Education",
    "E-Learning": "Education",
    "Media": "Media",
    "MEDIA_PRODUCTION": "Media",
    "Media Production": "Media",
    "Consumer Goods": "Consumer Goods",
    "CONSUMER_GOODS": "Consumer Goods",
    "Insurance": "Insurance",
    "INSURANCE": "Insurance",
    "Real Estate": "Real Estate",
    "REAL_ESTATE": "Real Estate",
    "Automotive": "Automotive",
    "AUTOMOTIVE": "Automotive",
    "Logistics & Supply Chain": "Logistics",
    "LOGISTICS_AND_SUPPLY_CHAIN": "Logistics",
}

# CRM lead source -> channel category.
LEAD_SOURCE_CHANNELS = {
    "Marketing: 6sense": "6sense_display",
    "Marketing: 6sense Breakthrough 2023": "6sense_event",
    "Marketing: 6sense Breakthrough 2024": "6sense_event",
    "Channel Referral: 6sense": "6sense_channel",
    "Marketing: Event - 6sense 2022": "6sense_event",
    "Marketing: Event - 6Sense 2021": "6sense_event",
    "Marketing: MQA": "email_mqa",
    "Marketing: Website Inbound": "web_inbound",
    "Marketing: Forrester/6sense B2B 2023": "event",
    "Marketing: Gartner 2024": "event",
    "Marketing: GoTo/Francisco Partners Webinar 2024": "webinar",
    "Marketing: Pavilion CMO Summit 2024": "event",
    "Marketing: B2BSMX Event 2023": "event",
    "Marketing: Webinars": "webinar",
    "LinkedIn InMail - Hiring Marketers": "linkedin",
    "MQL - Webinar MaaS": "webinar",
    "Marketing: Marketo": "email_mqa",
    "Marketing: Other": "other_marketing",
    "Marketing: Event - Forrester B2B 2022": "event",
    "Marketing: Pavilion GTM 2023 Event": "event",
    "Marketing: Mops-apalooza 2023": "event",
    "Existing Client": "existing_client",
    "Referral: Client": "referral",
    "Referral: Partner": "referral",
    "Sales Prospecting": "sales",
    "Cold Call": "sales",
    "Sales: Outbound": "sales",
    "Outbound": "sales",
    "Web Inbound": "web_inbound",
}

# The category of unlisted lead sources, and the marketing ones.
OTHER_CHANNEL = "other"
MARKETING_CHANNELS = [
    "6sense_display",
    "6sense_event",
    "6sense_channel",
    "email_mqa",
    "web_inbound",
    "event",
    "webinar",
    "linkedin",
    "other_marketing",
]

# Contact lifecycle stages.
LIFECYCLE_STAGES = {
    "salesqualifiedlead": "SQL",
    "marketingqualifiedlead": "MQL",
    "lead": "Lead",
    "customer": "Customer",
    "opportunity": "Opportunity",
    "subscriber": "Subscriber",
    "evangelist": "Evangelist",
    "other": "Other",
}

# Audience-segment keywords, first hit wins.
SEGMENT_KEYWORDS = [
    ("Why MAAS", ["why maas", "why_maas"]),
    ("Intent", ["intent"]),
    ("Awareness", ["awareness"]),
    ("Decision", ["decision"]),
    ("Named Accounts", ["named account"]),
    ("Priority", ["priority"]),
]

# Session source flags (exact) and touch rules (substring).
DISPLAY_SOURCES = ["6sense", "6si_filtered", "6si"]
EMAIL_SOURCES = ["hs_email", "email", "pardot"]
ORGANIC_SOURCES = ["organic", "(none)", "google"]
SOCIAL_MARK = "linkedin"
WEB_TOUCH_RULES = [
    (["6sense", "6si"], "6sense_display", "web_visit_6sense"),
    (["email", "hs_email", "pardot"], "email_mqa", "web_visit_email"),
    (["linkedin"], "linkedin", "web_visit_linkedin"),
]
WEB_TOUCH_ORGANIC = (["(none)", "organic", "google"], "web_inbound", "web_visit_organic")
WEB_TOUCH_OTHER = ("web_inbound", "web_visit_other")

# Touch channels and types of the two logged sources.
DISPLAY_CHANNEL = "6sense_display"
EMAIL_CHANNEL = "email_mqa"
DISPLAY_TOUCH = "ad_impression"
EMAIL_CLICK, EMAIL_REGISTER, EMAIL_OPEN = "email_click", "email_register", "email_open"

# Engagement texts of the email log.
ENGAGEMENT_CLICK, ENGAGEMENT_OPEN, ENGAGEMENT_REGISTER = "clicked", "opened", "register"

# Annual-revenue bands, highest first.
REVENUE_BANDS = [(500_000_000, "Enterprise"), (50_000_000, "Mid-Market"), (None, "Commercial")]

# Placeholders.
UNKNOWN = "Unknown"
UNASSIGNED_TIER = "Unassigned"
PENDING_TIER = "TBD"
OTHER_SEGMENT = "Other"
NULL_PERIOD = "NaT"

# Contact seniority levels that are counted per account.
SENIORITY_LEVELS = {
    "c_level_contacts": "c-level",
    "vp_contacts": "vp",
    "director_contacts": "director",
    "manager_contacts": "manager",
}

# Ad platform -> channel its spend belongs to.
PLATFORM_CHANNELS = {"6sense": "6sense_display", "LinkedIn": "linkedin"}

# Funnel stages in order.
FUNNEL_STAGES = [
    "Impressions",
    "Clicks",
    "Form Fills / Goal Completions",
    "Email Engagements",
    "Email Clicks",
    "All Opportunities",
    "Marketing-Sourced Opps",
    "Closed Won (All)",
    "Marketing-Sourced Won",
]
FUNNEL_SCOPE = "All Channels"

# Attribution.
SOURCED, INFLUENCED = "Marketing Sourced", "Marketing Influenced"
FIRST_TOUCH, LAST_TOUCH = "First-Touch", "Last-Touch"
LINEAR, TIME_DECAY = "Linear", "Time-Decay"
ATTRIBUTION_MODELS = [SOURCED, INFLUENCED, FIRST_TOUCH, LAST_TOUCH, LINEAR, TIME_DECAY]
ATTRIBUTION_WINDOW_DAYS = 365
HALF_LIFE_DAYS = 30

# Coverage tiers in display order.
COVERAGE_TIERS = ["Both Channels", "Email Only", "6sense Only", "Not Reached"]

# Words that mark a deal stage as closed.
CLOSED_STAGE_WORDS = ["closed", "won", "lost"]

# Deal-velocity range in days.
VELOCITY_DAYS = (1, 730)

# Creative attributes, in grouping order, and the reported ones.
CREATIVE_COLUMNS = [
    "ad_name",
    "platform",
    "size",
    "stage",
    "copy_messaging",
    "copy_asset_type",
    "copy_tone",
    "cta_softness",
    "design_color",
    "campaign_id",
]
CREATIVE_ATTRIBUTES = [
    "copy_messaging",
    "copy_asset_type",
    "copy_tone",
    "cta_softness",
    "design_color",
    "size",
]

# Budget scenarios.
BUDGET_UP, BUDGET_DOWN, BUDGET_GROWTH, BUDGET_CUT = 1.3, 0.8, 2.0, 0.5
BUDGET_RANKED = 2
GROWTH_CHANNELS = ["email_mqa", "6sense_display"]
SCENARIOS = ["Status Quo", "ROI-Optimized", "Growth Mode"]

# Return-on-spend bands and compact-money units.
ROI_GOOD, ROI_POOR = 5.0, 2.0

# Win model.
WIN_CATEGORICAL = ["channel_category", "segment", "industry", "tier", "profile_fit"]
WIN_BOOLEAN = ["is_qualified"]
WIN_NUMERIC = [
    "intent_score",
    "annual_revenue",
    "employees",
    "email_opens",
    "email_clicks",
    "campaign_impressions",
    "campaign_form_fills",
    "web_goal_completions",
    "c_level_contacts",
    "vp_contacts",
    "director_contacts",
    "amount",
]
WIN_TREES, WIN_DEPTH, WIN_MIN_LEAF, WIN_SEED, WIN_FOLDS = 200, 8, 5, 42, 5

# Reconciliation tolerance on money.
TOLERANCE = 0.01
