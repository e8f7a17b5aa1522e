"""Fixed values that results depend on: tables, word lists, limits and marks."""

# Chunks and contexts.
CHARS_PER_TOKEN = 4
CHUNK_CHARS = 8000
CONTEXT_TAIL = 600
TIMING_WINDOW = 20
SAMPLE_MIN_WORDS, SAMPLE_MAX_WORDS = 250, 5000
NAVIGATION_RATIO = 0.5
EVAL_MIN_WORDS = 120

# Metering.
CHARS_PER_CREDIT = 1000
QUOTE_VERSION = 1
#: tier, most source characters
TIERS = [(1, 150_000), (2, 300_000), (3, 500_000), (4, 800_000), (5, 1_200_000), (6, 3_000_000)]
CREDIT_PRODUCTS = [250, 600, 1200]

# US dollars a million tokens: model prefix, input, cached input, output.
PRICES = [
    ("gemini-3.6-flash", 1.50, 0.15, 7.50),
    ("gemini-3.5-flash", 1.50, 0.15, 9.00),
    ("gemini-3.5-flash-lite", 0.30, 0.03, 2.50),
    ("gemini-3.1-flash-lite", 0.25, 0.025, 1.50),
    ("gemini-2.5-flash", 0.30, 0.03, 2.50),
    ("gemini-2.5-flash-lite", 0.10, 0.01, 0.40),
    ("gemini-2.5-pro", 1.25, 0.125, 10.00),
]
DEFAULT_MODEL = "gemini-2.5-flash"

# Inline tags vanish, block tags hold the text that is translated as one piece.
INLINE_TAGS = ["a", "abbr", "b", "br", "cite", "code", "del", "em", "i", "img", "ins", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "wbr"]
BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "dd", "dt", "td", "th", "caption"]

# Marks of segments and blocks in a payload.
TOKEN_OPEN, TOKEN_CLOSE, BLOCK_OPEN, BLOCK_CLOSE = "⟦", "⟧", "【", "】"

# Terms.
PROPER_NOUN = r"((?:(?:Mr|Mrs|Ms|Dr|St|Fr|Prof)\.[ ])?[A-Z][a-z]+(?:[ ](?:[A-Z][a-z]+|[A-Z]\.))*)"
SENTENCE_END = ".!?…:;\"“”‘’«»—–"
TERM_MIN_COUNT, TERM_LIMIT, TERM_MIN_MIDDLE = 2, 200, 0.15

# Languages: function words and characters that only occur in the language.
STOPWORDS = {
    "en": ["the", "and", "was", "were", "that", "with", "have", "his", "her", "she", "you", "this", "from", "they", "what", "when", "there", "would", "could", "about", "your"],
    "hu": ["hogy", "nem", "egy", "volt", "csak", "meg", "már", "még", "mint", "ez", "az", "de", "is", "el", "ki", "fel", "van", "lehet", "akkor", "amikor"],
    "de": ["der", "die", "das", "und", "nicht", "mit", "sich", "auch", "aber", "noch", "schon", "wenn", "dann", "eine", "einen", "war", "haben", "wird", "über", "durch"],
    "es": ["que", "los", "las", "por", "para", "con", "una", "como", "pero", "más", "sus", "este", "esta", "todo", "cuando", "porque", "también", "muy", "hasta", "sobre"],
}
DISTINCTIVE = {"hu": "[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]", "de": "[äöüßÄÖÜ]", "es": "[áéíóúñ¿¡ÁÉÍÓÚÑ]"}
LANGUAGE_HITS, GUARD_MIN_TEXT = 3, 40

#: source, target, validated, balanced least and most, fidelity least and most
PAIRS = [
    ("en", "hu", True, 0.88, 1.45, 0.92, 1.25),
    ("en", "de", False, 0.95, 1.6, 1.0, 1.4),
    ("en", "es", False, 0.95, 1.65, 1.0, 1.45),
    ("de", "en", False, 0.85, 1.5, 0.9, 1.35),
    ("es", "en", False, 0.85, 1.5, 0.9, 1.35),
    ("hu", "en", False, 0.85, 1.5, 0.9, 1.35),
    ("de", "hu", False, 0.85, 1.5, 0.9, 1.35),
    ("es", "hu", False, 0.85, 1.5, 0.9, 1.35),
]
UNMEASURED = {"balanced": (0.85, 1.5), "fidelity": (0.9, 1.35)}
OMISSION_MIN_CHARS = 200

#: What a refusing model says, without the word boundary on either side.
REFUSAL = "(sorry,? i can'?t|i cannot translate|i can'?t generate|i'?m unable to|as an ai|i am an ai|cannot provide a translation|keep every token)"
CJK = "[\\u3040-\\u30ff\\u4e00-\\u9fff]"

# The offline provider.
FAKE_PREFIX, FAKE_REFINE = "tesztfordítás: ", "+ "

# Admission: bucket, requests, seconds.
RATE_BUCKETS = [("auth-hour", 20, 3600), ("upload-hour", 12, 3600), ("purchase-hour", 20, 3600), ("translation-day", 8, 86400), ("account-delete-day", 5, 86400), ("preview-reclaim-week", 3, 604800)]
RECLAIMS, RECLAIM_SECONDS = 3, 604800
DAY_CAP_CENTS, MONTH_CAP_CENTS, JOB_CAP_CENTS = 2000, 10000, 500
RATE_KEEP_DAYS, EVENT_KEEP_DAYS = 8, 30
MAX_ACTIVE_JOBS, RETRY_SECONDS, MAX_RETRIES = 4, 60, 10
MAX_CLOCK_SKEW_SECONDS = 300

# Display: seconds, minutes, hours beside minutes, hours alone; chunks a minute.
ETA_UNITS = ("mp", "perc", "ó", "óra")
SPEED_UNIT = "szakasz/perc"

# Archives.
CHAPTER_TITLE = "Fejezet"
MAX_ARCHIVE_BYTES, MAX_ENTRIES, MAX_UNCOMPRESSED = 32 * 1024 * 1024, 2000, 128 * 1024 * 1024
XHTML_TYPES = ["application/xhtml+xml", "text/html"]

# What names may look like; letters in either case but for users and jobs.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
LOCALE = "[a-z]{2,3}(?:-[a-z0-9]{2,8}){0,3}"
LANGUAGE = "[a-z]{2,3}(?:-[a-z0-9]{2,8})?"
SOURCE_HASH = "[a-f0-9]{64}"
USER_ID = "[A-Za-z0-9._:@-]{1,128}"
JOB_ID = "[A-Za-z0-9_-]{1,64}"
