"""Constants of the ranking rules.  All of them are fixed values: results depend on them exactly."""

from __future__ import annotations

#: All engines, in the order in which they are listed; fixed values.
ENGINES = ("ddg", "brave", "bing", "reddit", "wikipedia", "github", "google")
API_ENGINES = ("reddit", "github", "wikipedia")
INTENTS = ("docs", "code", "discussion", "factual", "general")

#: Engines of each intent, most useful first; fixed values.
ENGINE_ORDER = {
    "docs": "ddg google bing brave github wikipedia reddit".split(),
    "code": "github ddg google brave bing reddit wikipedia".split(),
    "discussion": "reddit ddg google bing brave github wikipedia".split(),
    "factual": "wikipedia ddg google bing brave github reddit".split(),
    "general": "ddg google bing brave reddit wikipedia github".split(),
}
UNRANKED = 99

#: When a search may be answered early: settled engines, useful engines with rows, which are useful, soft and hard limit in
#: ms, whether a confident row is needed; fixed values.
PROFILES = {
    "docs": (3, 1, ("ddg", "google", "bing"), 2200, 4500, True),
    "code": (3, 1, ("github", "ddg", "google", "bing", "brave"), 2200, 4500, True),
    "discussion": (2, 1, ("reddit", "ddg", "google", "bing"), 2000, 3200, False),
    "factual": (2, 1, ("wikipedia", "ddg", "google", "bing"), 2000, 3200, False),
    "general": (4, 2, ENGINES, 2000, 3000, False),
}

#: Domains and hosts that score as official; fixed values.
OFFICIAL_DOMAINS = (
    "github.com gitlab.com ollama.com openai.com anthropic.com langchain.com crewai.com sst.dev python.org nodejs.org "
    "rust-lang.org go.dev mozilla.org developer.mozilla.org npmjs.com pypi.org crates.io"
).split()
#: Domains that count as known official pages when results are adjusted to the intent; fixed values.
KNOWN_OFFICIAL = "anthropic.com openai.com ollama.com langchain.com nodejs.org rust-lang.org python.org mozilla.org go.dev npmjs.com pypi.org crates.io".split()
#: Hosts of package documentation; fixed values.
REGISTRY_HOSTS = "docs.rs pkg.go.dev pypi.org npmjs.com crates.io".split()
CODE_HOSTS = ("github.com", "gitlab.com")
DISCUSSION_HOSTS = ("reddit.com",)
FACTUAL_HOSTS = ("wikipedia.org",)

DOC_HOST = r"^(docs|developer|developers|api)\."
#: Paths that score, and paths that make a page official for an intent; fixed values.
SCORED_PATH = r"(?i)^/(docs|documentation|api|library|reference|providers?|integrations?|manual|guide|tutorials?)(/|$)"
OFFICIAL_PATH = r"(?i)^/(docs|documentation|api|reference|guide|guides|manual|tutorial|tutorials|library|integrations?|providers?)(/|$)"
#: Hosts with documentation of many projects, and hosts of little signal; fixed values.
HOSTED_DOCS = r"\.readthedocs\.io$|\.sst\.dev$|^docs\.rs$|^pkg\.go\.dev$"
LOW_SIGNAL = r"^dev\.to$|^medium\.com$|^towardsdatascience\.com$|^hackernoon\.com$|^hashnode\.|^blog\.|^substack\.com$"

#: Words of a query that tell nothing about its subject; fixed values.
STOP_WORDS = (
    "a an and any best can compare comparison current documentation docs find for from give how in into is just latest like "
    "me of official only or provider providers return short should site source sources than the then that this url use web "
    "what with your about also to get using via"
).split()
#: Query parameters that don't change a page; fixed values.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref".split()

#: Patterns of each intent over the lower-cased query, tried in this order; fixed values.
INTENT_WORDS = {
    "discussion": r"reddit|discussion|forum|thread|threads|opinion|opinions|community|communities|compare|vs\.?|versus",
    "code": r"github|gitlab|repo|repository|repositories|source code|implementation|implementations|example code|examples",
    "docs": r"docs?|documentation|documentations|api|sdk|reference|references|guide|guides|handbook|manual|tutorial|tutorials|library|libraries|integration|integrations",
}
FACTUAL_START = r"what is|who is|define|definition of|history of|list of"
FACTUAL_WORDS = r"wikipedia|meaning|definition|history"

#: What intents add for: an official-looking page, a known official domain, code, discussion and factual hosts; fixed values.
ADJUSTMENTS = {"docs": (8, 6, -8, -10, -4), "code": (3, 2, 10, -6, 0), "discussion": (0, 0, -4, 10, -2), "factual": (3, 2, -4, -4, 10), "general": (0, 0, 0, 0, 0)}

#: HTML parts that are no content; fixed values.
REMOVED_TAGS = "script style noscript iframe nav header footer aside".split()
REMOVED_CLASSES = "ads ad social-share newsletter".split()
REMOVED_CLASS_PARTS = "cookie banner popup modal sidebar navigation".split()
REMOVED_ID_PARTS = ("cookie",)
CONTENT_CLASSES = "content main-content post-content article-content".split()

MAX_PER_DOMAIN = 2
TITLE_LENGTH, SNIPPET_LENGTH, SELFTEXT_LENGTH, HARVEST = 120, 300, 200, 15
FETCH_SLACK = 5
#: Rows that a source asks for: how many more than the limit, and at most how many; fixed values.
REQUEST_SIZE = {"reddit": (5, 25), "github": (5, 30), "brave": (5, 20), "wikipedia": (3, 10)}
RATE_LIMIT, RATE_WINDOW_MS, COOLDOWN_MS, SLOTS = 10, 60_000, 30_000, 2
CACHE_TTL_MS, CACHE_ENTRIES = 600_000, 256
POLL_MS = 100
