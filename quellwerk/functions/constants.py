"""Word lists, ordered rules, patterns and weights that results depend on."""

STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can to of in
for on with at by from as into through during before after above below between and but or not no nor so yet both
either neither each this that these those it its he she they we you me him her us them my your his our their which
who whom what where when how if then than more most also very
""".split()

QUESTION_RULES = [
    (r"(?:^|[\s,])how (?:to|do|can|should|would)\b", "how_to"),
    (r"\bvs\.?\b|\bversus\b|\bcompare|difference between|better.+or\b", "comparison"),
    (r"(?:^|[\s,])what (?:are|is) the (?:main |best |top |different )?(?:types?|kinds?|categories|ways|methods|forms?|examples?)\b", "list"),
    (r"(?:^|[\s,])(?:list|name|give|provide|enumerate)\b.+(?:types?|examples?|ways|methods)", "list"),
    (r"(?:^|[\s,])which\b", "which"),
    (r"(?:^|[\s,])why\b", "why"),
    (r"(?:^|[\s,])what (?:is|are|does|do)\b|(?:^|[\s,])define\b", "what_is"),
    (r"(?:^|[\s,])(?:should|would|is it|do you)\b.+\?", "opinion"),
]

#: Substrings of a host, first match wins.
DOMAIN_RULES = [
    ("wikipedia", "encyclopedia"), (".edu", "academic"), (".ac.", "academic"), ("library", "academic"),
    ("libguide", "academic"), (".gov", "government"), ("nih.gov", "government_health"), (".org", "nonprofit"),
    ("pewresearch", "research"), ("research", "research"), ("bbc", "news_media"), ("cnn", "news_media"),
    ("nytimes", "news_media"), ("reuters", "news_media"), ("news", "news_media"), ("ibm.com", "tech_corporate"),
    ("microsoft.com", "tech_corporate"), ("google.com", "tech_corporate"), ("amazon.com", "tech_corporate"),
    ("apple.com", "tech_corporate"), ("zhuanlan.zhihu", "ugc_platform"), ("medium.com", "ugc_platform"),
    ("reddit.com", "ugc_platform"), ("quora.com", "ugc_platform"), ("stackoverflow", "ugc_platform"),
    ("runoob.com", "tutorial"), ("w3schools", "tutorial"), ("geeksforgeeks", "tutorial"),
    ("pressbooks", "academic_publishing"), ("springer", "academic_publishing"),
    ("sciencedirect", "academic_publishing"), ("nature.com", "academic_publishing"),
]

BLOCK_PAGE_SIGNS = [
    "just a moment", "checking your browser", "enable javascript", "cf-browser-verification", "challenge-platform",
    "ray id", "_cf_chl", "managed by cloudflare", "attention required", "access denied",
    "please verify you are a human",
]

#: Substrings of a lower-cased exception text, first match wins.
EXCEPTION_RULES = [
    (("timeout", "timed out"), "timeout"),
    (("connection", "refused", "unreachable"), "connection"),
    (("ssl", "certificate"), "ssl"),
    (("dns", "name or service", "getaddrinfo"), "dns"),
]

#: White space of any script, for use inside a character class, and a run of anything else.
GAP = r"\x09-\x0D\x1C-\x20" + "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{GAP}]"
INK = f"[^{GAP}]+"
TOKEN = r"[a-zA-Z一-鿿]{2,}"
WORD = r"[a-zA-Z一-鿿]+"
TERM = r"[\p{L}\p{N}_]{2,}"
HAS_NUMBERS = r"\d+[\.,]?\d*\s*%|\$\s*[\d,]+|\d{4,}"
HAS_DEFINITION = r"(?i)(?:is a |refers to |defined as |means )"
HAS_QA = r"(?im)\?\s*\n|^what |^how |^why |^when "
HAS_HOWTO = r"(?i)step \d|how to |first\b.*\bthen\b"
HAS_COMPARISON = r"(?i)\bvs\.?\b|compared to |versus |difference between "
TAGS = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"

NA_TOKENS = ["", "null", "NULL", "NaN", "nan", "NA", "N/A", "n/a", "None", "<NA>", "#N/A", "-nan", "-NaN"]
#: Weights of reference count, early position, paragraph coverage, TF-IDF cosine, n-gram overlap.
SCORE_WEIGHTS = (0.20, 0.15, 0.20, 0.25, 0.20)
SITE_TYPES = ["新闻", "blog", "行业垂类", "测评类", "官网", "电商", "其他"]
#: First parts of a path that name a category, and the layers of prompts.
CATEGORY_PART = "^[ABCD]_"
CATEGORIES = ["A_commerce", "A_technology", "A_local", "A_news", "A_healthcare", "A_finance"]
