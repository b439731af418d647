"""Fixed values.

Everything in this file is a constant that decides results: word lists, lookup
lists, patterns, weights and bounds. They are parameters of :class:`Settings`
and only serve as its defaults.
"""

# --- employer typing: substring lists, tested against lower-cased names ------
CONSULTING_COMPANIES = (
    "tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant",
    "capgemini", "mindtree", "tech mahindra", "hcl", "lti", "larsen",
    "l&t infotech", "ltimindtree", "mphasis", "dxc", "hexaware",
    "ibm services", "deloitte", "kpmg", "pwc", "ey ", "ernst", "syntel",
    "birlasoft", "coforge", "zensar", "persistent systems", "nttdata",
    "ntt data", "atos",
)
CONSULTING_INDUSTRIES = ("it services", "consulting", "outsourcing", "bpo")
PRODUCT_INDUSTRIES = (
    "software", "fintech", "food delivery", "e-commerce", "ecommerce", "saas",
    "internet", "gaming", "healthtech", "edtech", "social media",
    "ride sharing", "logistics", "marketplace", "ad tech", "adtech",
    "streaming", "cloud", "cybersecurity", "data", "ai", "technology",
)
NONTECH_INDUSTRIES = (
    "manufacturing", "paper products", "conglomerate", "construction",
    "automotive", "oil", "mining", "agriculture", "textiles", "real estate",
    "hospitality", "retail", "fmcg", "pharmaceutical", "chemicals",
    "transportation", "utilities",
)

# --- domains that count as technical roles -----------------------------------
TECH_DOMAINS = ("ai_ml", "data_eng", "software", "frontend", "mobile", "devops", "qa")

# --- gazetteers for role descriptions ----------------------------------------
CITIES = (
    "pune", "noida", "bengaluru", "bangalore", "hyderabad", "mumbai", "delhi",
    "new delhi", "gurgaon", "gurugram", "ncr", "chennai", "kolkata",
    "ahmedabad", "jaipur", "indore", "kochi", "trivandrum",
    "thiruvananthapuram", "chandigarh", "coimbatore", "nagpur", "lucknow",
    "bhubaneswar", "vadodara", "surat",
)
COUNTRIES = (
    "india", "usa", "united states", "uk", "united kingdom", "canada",
    "australia", "germany", "uae", "singapore", "netherlands", "france",
    "ireland", "japan",
)

# --- exclusion section of a role description ---------------------------------
EXCLUSION_MARKERS = (
    "do not want", "don't want", "dont want", "not a fit", "not what we need",
    "do not move forward", "will not move forward", "won't move forward",
    "probably not move forward", "explicitly do not", "explicitly do not want",
    "we will not", "disqualif", "bad fit", "not move forward", "avoid",
    "we do not want", "not looking for",
)
SPECIALTIES = (
    "computer vision", "vision", "speech", "speech recognition", "robotics",
    "image processing", "langchain", "blockchain", "game development",
    "embedded", "hardware", "frontend", "mobile", "qa", "testing",
    "manual testing", "wordpress", "sales", "marketing", "academic",
    "research-only", "pure research",
)
EXCLUSION_WINDOW = 16          # the marker clause and the 15 clauses after it
CLAUSE_BREAK = r"[.\n;]"

# --- patterns of a role description (group 1.. carry the values) -------------
TITLE_LABEL = r"(?i)(?:job\s*description|role|position|title)\s*[:\-]\s*(.+)"
YEARS_RANGE = r"([0-9]{1,2})\s*(?:-|–|—|to)\s*([0-9]{1,2})\s*\+?\s*year"
YEARS_FLOOR = r"(?:minimum|at least|min|over|more than)\s*([0-9]{1,2})\s*\+?\s*year"
YEARS_PLUS = r"([0-9]{1,2})\s*\+\s*year"
YEARS_BARE = r"([0-9]{1,2})\s*year"
TITLE_LENGTH = 120
KEYWORD_CAP = 40

# --- scoring weights (sum to 1) and gate bounds ------------------------------
WEIGHTS = {
    "role_fit": 0.36,
    "semantic": 0.18,
    "evidence": 0.16,
    "experience": 0.10,
    "company_type": 0.10,
    "location": 0.10,
}
AVAILABILITY_MIN = 0.55
AVAILABILITY_MAX = 1.12
IMPOSSIBLE_MULTIPLIER = 0.02
STUFFING_MAX = 0.45
REFERENCE_DATE = "2026-06-20"
HOME_COUNTRY = "India"

# --- TF-IDF ------------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}_]{2,}"
MIN_DF = 2
MAX_FEATURES = 40000
SCALE_PERCENTILE = 99.0
SCALE_MIN_ROWS = 50            # below this the maximum is the scale

# --- output contract ---------------------------------------------------------
RANKED_COLUMNS = ("candidate_id", "rank", "score", "reasoning")
ID_PATTERN = "^CAND_[0-9]{7}$"
REQUIRED_ROWS = 100
