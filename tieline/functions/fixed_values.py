"""Word lists, lookup tables, patterns, constants and text formats.

Everything in this module is data that results depend on, kept as plain text in
natural order. No logic lives here.
"""

# --- placeholders and host names -------------------------------------------------
PLACEHOLDERS = ["n/a", "na", "null", "undefined", "-"]
NETWORK_HOST = r"(?i)(^|\.)linkedin\.com$"
PROFILE_PREFIX = "https://www.linkedin.com/in/"
COMPANY_PREFIX = "https://www.linkedin.com/company/"

# --- legal suffixes dropped from the end of a company name -------------------------
LEGAL_SUFFIXES = [
    "inc", "llc", "ltd", "limited", "plc", "gmbh", "ag", "sa", "bv", "nv", "pty", "pte", "co",
    "corp", "corporation", "company", "group", "holdings", "llp", "lp", "srl", "oy", "ab", "as",
    "aps", "kk", "sas", "sarl", "spa", "private", "pvt",
]

MONTH_NAMES = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9,
    "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# --- classifier labels ---------------------------------------------------------------
INDUSTRY_LABELS = {
    "ai": "AI / machine learning", "software": "Software", "cybersecurity": "Cybersecurity",
    "fintech": "Fintech", "finance": "Finance", "healthcare": "Healthcare",
    "biotech": "Biotech / life sciences", "consulting": "Consulting", "education": "Education",
    "government": "Government", "media": "Media", "manufacturing": "Manufacturing",
    "energy": "Energy", "retail": "Retail / consumer", "telecom": "Telecom", "legal": "Legal",
    "real_estate": "Real estate", "hardware": "Hardware / semiconductors",
    "recruiting": "Recruiting / HR", "nonprofit": "Nonprofit",
}
ROLE_LABELS = {
    "engineering": "Engineering", "data": "Data / ML", "product": "Product", "design": "Design",
    "sales": "Sales", "marketing": "Marketing", "operations": "Operations", "finance": "Finance",
    "legal": "Legal", "hr": "People / HR", "research": "Research", "customer": "Customer / support",
    "leadership": "General leadership", "founder": "Founder",
}
SENIORITY_LABELS = {
    "intern": "Intern", "junior": "Junior", "senior": "Senior", "staff": "Staff / principal",
    "manager": "Manager", "director": "Director", "vp": "VP / SVP", "c_level": "C-level",
    "founder": "Founder / owner",
}
SENIORITY_HIGH_CONFIDENCE = ["intern", "c_level", "founder"]

# --- classifier patterns; the first that matches wins -----------------------------------
COMPANY_INDUSTRY_RULES = [
    (r"\b(openai|anthropic|huggingface|hugging face|mistral ai|cohere|stability ai|midjourney|scale ai|perplexity)\b", "ai"),
    (r"\b(stripe|adyen|plaid|wise|revolut|chime|robinhood|coinbase|klarna|checkout\.com|paypal|square|block)\b", "fintech"),
    (r"\b(goldman|jpmorgan|jp morgan|morgan stanley|blackrock|bridgewater|citadel|two sigma|jane street)\b", "finance"),
    (r"\b(pfizer|moderna|genentech|roche|novartis|johnson & johnson|unitedhealth|kaiser|iqvia)\b", "healthcare"),
    (r"\b(mckinsey|bain|bcg|boston consulting|deloitte|accenture|pwc|ey\b|kpmg)\b", "consulting"),
    (r"\b(crowdstrike|palo alto networks|okta|cloudflare|zscaler|sentinelone|rapid7)\b", "cybersecurity"),
    (r"\b(nvidia|tsmc|intel|amd|qualcomm|arm holdings|broadcom|asml)\b", "hardware"),
    (r"\b(google|alphabet|microsoft|meta|facebook|amazon|apple|netflix|salesforce|oracle|ibm|adobe|uber|airbnb|linkedin)\b", "software"),
]
TITLE_INDUSTRY_RULES = [
    (r"\b(machine learning|ml engineer|ai engineer|llm|deep learning|generative ai|artificial intelligence|mlops)\b", "ai"),
    (r"\b(fintech|payments engineer|quant(itative)? (trader|researcher|developer))\b", "fintech"),
    (r"\b(physician|surgeon|nurse|pharmacist|clinical|healthcare|medical doctor)\b", "healthcare"),
    (r"\b(cybersecurity|security engineer|infosec|appsec|pentester)\b", "cybersecurity"),
]
ROLE_RULES = [
    (r"\b(founder|co-founder|cofounder)\b", "founder"),
    (r"\b(data scientist|data engineer|data analyst|machine learning|ml engineer|applied scientist|statistician)\b", "data"),
    (r"\b(product manager|product owner|\bpm\b|group product)\b", "product"),
    (r"\b(designer|ux|ui\/ux|user experience|product design)\b", "design"),
    (r"\b(account executive|sales|business development|\bbdr\b|\badr\b|account manager)\b", "sales"),
    (r"\b(marketing|growth marketing|brand|content strategist|seo)\b", "marketing"),
    (r"\b(recruiter|talent|people partner|human resources|\bhrbp\b)\b", "hr"),
    (r"\b(counsel|attorney|lawyer|legal)\b", "legal"),
    (r"\b(accountant|controller|cfo|financial analyst|investment banker)\b", "finance"),
    (r"\b(researcher|research scientist|scientist)\b", "research"),
    (r"\b(customer success|support|solutions architect)\b", "customer"),
    (r"\b(operations|coo|chief of staff|program manager|project manager)\b", "operations"),
    (r"\b(engineer|developer|sre|devops|software|swe|full[- ]?stack|backend|frontend|architect|programmer)\b", "engineering"),
    (r"\b(ceo|cto|cfo|coo|chief |president)\b", "leadership"),
]
SENIORITY_RULES = [
    (r"\b(intern|internship)\b", "intern"),
    (r"\b(founder|co-founder|cofounder|owner)\b", "founder"),
    (r"\b(chief |^c[teofm]o\b|\bceo\b|\bcto\b|\bcfo\b|\bcoo\b|\bcmo\b)", "c_level"),
    (r"\b(svp|evp|vice president|\bvp\b)\b", "vp"),
    (r"\b(director|head of)\b", "director"),
    (r"\b(engineering manager|manager|head)\b", "manager"),
    (r"\b(principal|staff|distinguished|fellow)\b", "staff"),
    (r"\b(senior|sr\.?)\b", "senior"),
    (r"\b(junior|jr\.?|associate|entry[- ]level)\b", "junior"),
]
# Observed industry names; the first rule splits into ai / software by a second pattern.
OBSERVED_TECH = r"\b(artificial intelligence|machine learning|computer software)\b|internet"
OBSERVED_AI = r"\bai\b|machine learning|artificial intelligence"
OBSERVED_INDUSTRY_RULES = [
    (r"\b(financial|banking|investment|venture|capital market)", "finance"),
    (r"\b(hospital|health|pharma|medical|wellness)", "healthcare"),
    (r"\bconsult", "consulting"),
    (r"\beducation|higher ed|e-learning", "education"),
    (r"\blaw|legal", "legal"),
    (r"\breal estate", "real_estate"),
    (r"\btelecom|wireless", "telecom"),
    (r"\bretail|consumer goods", "retail"),
    (r"\boil|energy|renewable", "energy"),
    (r"\bmanufactur|industrial", "manufacturing"),
    (r"\bnonprofit|non-profit|ngo", "nonprofit"),
    (r"\bsemiconductor|hardware|computer hardware", "hardware"),
    (r"\bsecurity|cyber", "cybersecurity"),
    (r"\bstaffing|recruit|human resources", "recruiting"),
    (r"\bmedia|publishing|entertainment", "media"),
    (r"\bgovernment|public policy", "government"),
]
COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States", "u.s.": "United States", "u.s.a.": "United States",
    "united states": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "united kingdom": "United Kingdom",
    "great britain": "United Kingdom", "england": "United Kingdom", "india": "India",
    "canada": "Canada", "germany": "Germany", "france": "France", "australia": "Australia",
    "singapore": "Singapore", "netherlands": "Netherlands", "ireland": "Ireland",
    "brazil": "Brazil", "japan": "Japan", "china": "China", "spain": "Spain", "italy": "Italy",
    "sweden": "Sweden", "switzerland": "Switzerland",
    "united arab emirates": "United Arab Emirates", "uae": "United Arab Emirates",
}

# --- thresholds ------------------------------------------------------------------------
RECENCY_BUCKETS = [
    ("3m", "< 3 months", 90.0), ("6m", "3–6 months", 180.0), ("12m", "6–12 months", 365.0),
    ("2y", "1–2 years", 730.0), ("5y", "2–5 years", 1825.0), ("5y_plus", "5+ years", float("inf")),
]
DIVERSITY_HIGH, DIVERSITY_MODERATE = 0.75, 0.45
CONCENTRATION_HIGH, CONCENTRATION_MODERATE = 0.25, 0.15
COMPLETED_STATUSES = ["completed", "partially_completed"]

# --- relationship signals: key, label, kind, rule ------------------------------------------
SIGNALS = [
    ("recent", "Recently connected", "calculated", "Connected within the last 90 days."),
    ("long_standing", "Long-standing", "calculated", "Connected more than 5 years ago."),
    ("dormant", "Older, no recent contact", "calculated",
     "Connected over 2 years ago, with no message or endorsement in the last year. This is not a measure of relationship strength."),
    ("engaged", "Engaged", "observed", "You have exchanged messages or endorsements."),
    ("changed_company", "Changed company", "observed", "A later import showed a different current employer."),
    ("shared_company", "Shared employer", "observed", "Worked at a company you have also worked at."),
    ("shared_school", "Shared school", "observed", "Attended a school you also attended."),
    ("no_company", "No employer recorded", "observed", "The export listed no company for this person."),
]
SUGGESTION_REASONS = [
    ("changed_company", "Changed company since your last import"),
    ("shared_company", "Worked at a company you also worked at"),
    ("shared_school", "Went to a school you also attended"),
    ("dormant", "Connected over 2 years ago with no recorded contact in the last year"),
    ("long_standing", "Connected more than 5 years ago"),
]
# Context score: key, label, points.
CONTEXT_SIGNALS = {
    "shared_company": ("Shared employer", 25),
    "shared_school": ("Shared school", 20),
    "common_industry": ("Common classified industry", 10),
    "common_country": ("Same country", 8),
    "connected_1_5y": ("Connected 1–5 years ago", 5),
    "career_change": ("Multiple employers on record", 15),
    "profile_completeness": ("Relatively complete record", 5),
}

# --- archive guards -------------------------------------------------------------------------
ARCHIVE_LIMITS = {
    "max_total_bytes": 1500 * 1024 * 1024,
    "max_entry_bytes": 256 * 1024 * 1024,
    "max_entries": 5000,
    "max_depth": 12,
    "max_path_length": 400,
}
NESTED_ARCHIVE_EXTENSIONS = [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"]
DATA_EXTENSIONS = [".csv", ".tsv", ".txt"]
DELIMITERS = [",", ";", "\t", "|"]

# --- dataset catalogue: key, label, category, file name patterns, header signatures ------------
DATASETS = [
    ("connections", "Connections", "network", [r"^connections\.csv$"],
     [["first name", "last name", "connected on"], ["first name", "last name", "url", "company"]]),
    ("profile", "Profile", "identity", [r"^profile\.csv$", r"^profile\s*summary\.csv$"],
     [["first name", "last name", "headline"], ["first name", "last name", "industry"]]),
    ("positions", "Positions", "identity", [r"^positions\.csv$"],
     [["company name", "title", "started on"], ["company name", "title", "finished on"]]),
    ("education", "Education", "identity", [r"^education\.csv$"],
     [["school name", "start date"], ["school name", "degree name"]]),
    ("skills", "Skills", "identity", [r"^skills\.csv$"], []),
    ("email_addresses", "Email Addresses", "identity", [r"^email\s*addresses\.csv$"], [["email address", "primary"]]),
    ("phone_numbers", "Phone Numbers", "identity", [r"^phone\s*numbers\.csv$"], [["number", "type"]]),
    ("certifications", "Certifications", "identity", [r"^certifications\.csv$"], [["name", "authority"]]),
    ("languages", "Languages", "identity", [r"^languages\.csv$"], [["name", "proficiency"]]),
    ("projects", "Projects", "identity", [r"^projects\.csv$"], [["title", "started on", "url"]]),
    ("honors", "Honors & Awards", "identity", [r"^honors\.csv$", r"^honors\s*(&|and)?\s*awards\.csv$"], [["title", "issued on"]]),
    ("courses", "Courses", "identity", [r"^courses\.csv$"], [["name", "number"]]),
    ("volunteering", "Volunteering", "identity", [r"^volunteering\.csv$", r"^volunteer\s*experience\.csv$"],
     [["company name", "role", "cause"]]),
    ("invitations", "Invitations", "network", [r"^invitations\.csv$"], [["from", "to", "sent at"]]),
    ("company_follows", "Company Follows", "network", [r"^company\s*follows\.csv$"], [["organization", "followed on"]]),
    ("endorsements_received", "Endorsements Received", "signals",
     [r"^endorsement_received_info\.csv$", r"^endorsements?\s*received.*\.csv$"], [["skill name", "endorser first name"]]),
    ("recommendations_received", "Recommendations Received", "signals",
     [r"^recommendations[_\s]*received\.csv$"], [["first name", "last name", "text", "creation date"]]),
    ("recommendations_given", "Recommendations Given", "signals", [r"^recommendations[_\s]*given\.csv$"], []),
    ("messages", "Messages", "communication", [r"^messages\.csv$"],
     [["conversation id", "from", "content"], ["from", "to", "date", "content"]]),
    ("comments", "Comments", "activity", [r"^comments\.csv$"], [["date", "link", "message"]]),
    ("reactions", "Reactions", "activity", [r"^reactions\.csv$", r"^votes\.csv$"], [["date", "type", "link"]]),
    ("shares", "Shares", "activity", [r"^shares\.csv$"], [["date", "sharelink"], ["date", "share link"]]),
    ("job_applications", "Job Applications", "career", [r"^job\s*applications\.csv$", r"^jobs?[_\s]*applied.*\.csv$"],
     [["application date", "company name", "job title"]]),
    ("saved_jobs", "Saved Jobs", "career", [r"^saved\s*jobs\.csv$"], [["saved date", "job title"]]),
]
# Merge order of the datasets: the profile first, because direction rules need the owner.
DATASET_ORDER = [
    "profile", "email_addresses", "phone_numbers", "positions", "education", "skills",
    "certifications", "languages", "projects", "honors", "courses", "volunteering", "connections",
    "invitations", "company_follows", "endorsements_received", "recommendations_received",
    "recommendations_given", "messages", "comments", "reactions", "shares", "job_applications",
    "saved_jobs",
]
IGNORED_FILES = [
    (r"^ad[_\s]*targeting\.csv$", "Advertising data — not imported by design"),
    (r"^ads?[_\s]*clicked\.csv$", "Advertising data — not imported by design"),
    (r"^registration\.csv$", "Account telemetry — not imported by design"),
    (r"^logins?\.csv$", "Account telemetry — not imported by design"),
    (r"^login[_\s]*history\.csv$", "Account telemetry — not imported by design"),
    (r"^security[_\s]*challenges\.csv$", "Security telemetry — not imported by design"),
    (r"^account[_\s]*status[_\s]*history\.csv$", "Account telemetry — not imported by design"),
    (r"^rich[_\s]*media\.csv$", "Media index — nothing to import"),
    (r"^searchqueries\.csv$", "Search history — not imported by design"),
    (r"^inferences.*\.csv$", "LinkedIn ad inferences — not imported by design"),
    (r"^device[_\s]*information\.csv$", "Device telemetry — not imported by design"),
    (r"^ip[_\s]*addresses.*\.csv$", "Security telemetry — not imported by design"),
]

# --- insight text formats; {names} are filled from metric columns -----------------------------------
INSIGHTS = {
    "top-company": {
        "title": "{count} connections associated with {label}",
        "description": "{share_of_network}% of the network currently lists {label} as employer ({count} of {total}).",
        "category": "composition", "trust": "derived",
        "why": "Shows where current employment is concentrated.",
        "evidence": "{count} people with current employer {label}.",
        "expression": "{count} / {total}",
        "assumptions": ["Grouped by normalised company key so “Acme Inc” and “Acme” count as one company."],
    },
    "company-concentration": {
        "title": {"low": "Company representation is concentrated", "high": "Company representation is spread out",
                  "moderate": "Company representation is moderately concentrated"},
        "description": "{explanation}",
        "category": "concentration", "trust": "derived",
        "why": "Concentration describes whether a few employers dominate the network.",
        "evidence": "HHI {hhi} on classified employers; coverage {coverage_percent}%.",
        "expression": "HHI = Σ (share_i)² over classified current employers",
        "assumptions": ["Unknown employers are excluded from HHI and reported as coverage."],
    },
    "top-industry": {
        "title": "{label} is the largest classified industry",
        "description": "{count} of {known} classified connections ({share_of_known}%). {unknown} could not be classified.",
        "category": "composition", "trust": "inferred",
        "why": "Industry mix is mostly inferred when LinkedIn did not export an industry field.",
        "evidence": "{method}",
        "expression": "{count} / {known} classified",
    },
    "gap-industry": {
        "title": "{label} is relatively small in this network",
        "description": "{count} of {known} classified connections ({share_of_known}%). This is below half the median category share. "
                       "That is a description of the data, not a recommendation to add connections.",
        "category": "gap", "trust": "inferred",
        "why": "Useful if you are checking coverage of a sector you care about.",
        "evidence": "{count} classified as {label}.",
        "expression": "{count} / {known}",
    },
    "growth-window": {
        "title": "{last_90_days} connections added in the last 90 days",
        "description": "{last_90_days} of {known} dated connections fall in the last 90 days. Growth is {acceleration}. "
                       "Earliest Connected On in the file: {earliest_day}.",
        "category": "growth", "trust": "derived",
        "why": "Shows recent network expansion using only rows that have a connection date.",
        "evidence": "Dated connections: {known} of {total} ({coverage_percent}% coverage).",
        "expression": "{last_90_days} dated connections with Connected On in the last 90 days",
        "assumptions": ["People without Connected On are excluded from growth, not counted as zero new connections."],
    },
    "career-moves": {
        "title": "{people} {people_have} more than one employer on record",
        "description": "{moves} company-to-company transitions were reconstructed from employment rows. "
                       "Most LinkedIn connection exports contain only a current employer, not a full résumé. "
                       "Moves then appear only across incremental imports.",
        "category": "career", "trust": "derived",
        "why": "Employment history (including incremental imports) is the only supported evidence of a job change.",
        "evidence": "{moves} transitions across {people} people.",
        "expression": "count of people with ≥2 distinct company keys in employment",
        "assumptions": [
            "Most LinkedIn connection exports contain only a current employer, not a full résumé. Moves then appear only across incremental imports.",
            "Title differences without a date are not treated as promotions.",
            "Sharing a company with someone is not evidence that the two people know each other.",
        ],
    },
    "location-coverage": {
        "title": "Location is almost never present for connections",
        "description": "{known} of {total} connections have a location ({percent}%). LinkedIn’s Connections.csv does not include a "
                       "location column, so geographic analytics cannot be computed from a typical export.",
        "category": "quality", "trust": "observed",
        "why": "Prevents treating missing geography as “everyone is in one place”.",
        "evidence": "location IS NULL on {unknown} people rows.",
        "expression": "{known} / {total}",
        "assumptions": [],
    },
    "new-since-import": {
        "title": "{new} connections first appeared in the latest Connections.csv import",
        "description": "Compared with the previous connections import. {gone} people from earlier imports were not in the latest Connections.csv.",
        "category": "change", "trust": "derived",
        "why": "This is the supported way to see what changed between exports.",
        "evidence": "first_import_id = {current_import}.",
        "expression": "count of people whose first_import_id is the latest connections import",
        "assumptions": [
            "People not present in the latest Connections.csv are listed as not seen in that import. That is not proof they were removed from LinkedIn.",
        ],
    },
}

# --- question intents: (intent, pattern); order matters -----------------------------------------------
QUESTION_KEYWORDS = [
    ("network_size", r"how (large|big)|how many (people|connections)|network size|total connections"),
    ("what_changed", r"what changed|since (my )?(last|previous) (import|export)"),
    ("underrepresented", r"underrepresented|missing industries|network gaps"),
    ("recent_movers", r"changed (jobs?|companies)|recently (moved|changed)"),
    ("top_companies", r"which companies|top companies|most people"),
]
FORMER_COMPANY_QUESTION = r"(?:previously|formerly|used to) work(?:ed)? at ([a-z0-9&.'\-\s]+)"
CURRENT_COMPANY_QUESTION = r"(?:work(?:s|ed)? at|connections at|who (?:at|in my network works at))\s+(.+?)\??$"
LOCATION_QUESTION = r"(?:in|from|based in)\s+([a-z\s]+)\??$"
LOCATION_WORDS = r"where|location|city|country"
INDUSTRY_QUESTION = r"(?:how many|who).*(fintech|healthcare|ai|software|consulting|finance)"
PATH_QUESTION = r"from\s+(.+?)\s+(?:to|→|->)\s+(.+?)\??$"
ANSWER_TEXT = {
    "network_size": "{total} connections in the imported network (excluding you).",
    "people_at_company": "{n} connection{s} currently list an employer matching “{needle}”.",
    "people_former_company": "{n} connection{s} have a former employment row matching “{needle}”.",
    "recent_movers": "{people} {people_have} more than one employer on record ({moves} transitions).",
    "industry_found": "{count} of {known} classified connections ({share_of_known}%) match {label}. {unknown} unclassified.",
    "industry_none": "No classified connections match “{needle}”. {unknown} unclassified of {total}.",
    "few_classified": "Only {known} connections could be classified, which is too few for a gap comparison.",
    "underrepresented": "Smaller classified industries: {bins}. This is not a recommendation to add connections.",
    "what_changed": "{new} first seen in the latest Connections.csv import; {gone} not seen in that import; {moves} company transitions on record.",
    "people_in_location": "{n} connection{s} have a location containing “{needle}”. {without} have no location.",
    "career_path": "{n} recorded transition{s} from an employer matching “{needle}” to one matching “{needle2}”.",
    "no_employer": "No current employer data in the import.",
    "unsupported": "That question could not be mapped to a structured query. Try asking who works at a company, which companies are largest, "
                   "who changed employers, what changed since the last import, or how large the network is.",
}

# --- reasons shown for archive entries and files that are not read --------------------------------------
ARCHIVE_REASONS = {
    "absolute": "Absolute paths are not allowed",
    "traversal": "Path traversal entry rejected",
    "long": "Path is too long",
    "deep": "Nested too deeply",
    "system": "System file ignored",
    "nested": "Nested archives are not extracted",
    "many": "Archive exceeds {n} entries",
    "large": "Entry exceeds {n}MB",
    "broken": "Could not decompress",
}
ARCHIVE_ERRORS = {
    "EMPTY_ARCHIVE": "The uploaded archive is empty (0 bytes).",
    "INVALID_ARCHIVE": "That file is not a ZIP archive.",
    "ARCHIVE_BOMB": "The archive decompresses to more than {n}MB.",
    "MALFORMED_ARCHIVE": "The archive is corrupted and could not be read.",
    "EMPTY_ARCHIVE_CONTENTS": "The archive contains no readable files.",
    "NO_FILES": "No readable files were found in the upload.",
    "NO_LINKEDIN_DATA": "None of the uploaded files look like a LinkedIn export.",
}
