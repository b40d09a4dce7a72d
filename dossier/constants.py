"""They have to equal the published ones for results to agree."""

# --- fixed values: text patterns -------------------------------------------------------------
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MOBILE = r"(?U)(\+91[-.\s]?)?([6-9]\d{9})\b"
# \n?\z is what an end anchor means where a final line feed is tolerated
EMAIL_SHAPE = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\n?\z"
# parts that cannot change what an unanchored search finds (scheme, host prefix) are left out of the next two
LINKEDIN_PROFILE = r"linkedin\.com/in/[a-zA-Z0-9-]+"
GITHUB_PROFILE = r"github\.com/[a-zA-Z0-9-]+/?\n?\z"
MAILTO = r"mailto:([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+)"
HREF = r"""(?i)(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
OBJECT_ID = r"^[0-9a-fA-F]{24}\z"
COUNTRY_CODE = "+91"

# --- fixed values: patterns of the JSON repair ---------------------------------------------------
TRAILING_COMMA = r"(?U),\s*([\]}])"
BARE_KEY = r"(?U)([{,]\s*)(\w+)\s*:"
OPENED = r"^[{\[]"

# --- fixed values: white space as a Unicode-aware split sees it -------------------------------
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WORD = r"(?U)[^\s\x1c-\x1f]+"

# --- fixed values: English stop words ---------------------------------------------------------
STOP_WORDS = """
a about above after again against ain all am an and any are aren aren't as at be because been before being below between
both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from
further had hadn hadn't has hasn hasn't have haven haven't having he he'd he'll her here hers herself he's him himself his
how i i'd if i'll i'm in into is isn isn't it it'd it'll it's its itself i've just ll m ma me mightn mightn't more most
mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours ourselves out over own re s
same shan shan't she she'd she'll she's should shouldn shouldn't should've so some such t than that that'll the their
theirs them themselves then there these they they'd they'll they're they've this those through to too under until up ve
very was wasn wasn't we we'd we'll we're were weren weren't we've what when where which while who whom why will with won
won't wouldn wouldn't y you you'd you'll your you're yours yourself yourselves you've
""".split()

# --- fixed values: statuses and error classes -------------------------------------------------
IN_PROGRESS, COMPLETED, FAILED = "in_progress", "completed", "failed"
EXTRACTION, PARSING, SAVING, NO_ERROR = "extraction", "parsing", "saving", "none"
MAX_RETRIES = 3
RETRY_SECONDS = (600, 1200, 1800)

# --- fixed values: retrieval parameters -------------------------------------------------------
COMPANY_SIZES = ("<50", "50-200", "200-500", "500-1000", ">1000")
COMPANY_SIZE_RELABEL = {">50": "<50", "1000<": ">1000"}
NAMED_INSTITUTES = ("iit", "nit", "iiit", "bits")
TIME_WINDOWS = {
    "one_hour": "INTERVAL 1 HOUR",
    "six_hour": "INTERVAL 6 HOURS",
    "tweleve_hour": "INTERVAL 12 HOURS",
    "one_day": "INTERVAL 1 DAY",
    "one_week": "INTERVAL 7 DAYS",
    "two_week": "INTERVAL 14 DAYS",
    "three_week": "INTERVAL 21 DAYS",
    "forty_five_days": "INTERVAL 45 DAYS",
    "one_month": "INTERVAL 1 MONTH",
    "two_month": "INTERVAL 2 MONTHS",
    "three_month": "INTERVAL 3 MONTHS",
}
PAGE_SIZE, MAX_PAGE_SIZE = 100, 1000
EXPORT_SLOTS = 5
