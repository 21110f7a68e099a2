"""Word lists, patterns, tables and constants that results depend on."""

# These must be as they are for right results.

#: A word: a letter or digit, then letters, digits, marks and some inner punctuation.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}_'+#.\-]*"
#: A content token: a quoted phrase or a word.
CONTENT_TOKEN = r"\"[^\"]+\"|[\p{L}\p{N}][\p{L}\p{N}\p{M}_+#.'\-]*"
#: Characters of scripts written without spaces (Han and kana), as a character class body.
UNSPACED = "぀-ヿ㐀-䶿一-鿿豈-﫿"

#: Kana, as a character class body.
KANA = "぀-ヿ"
#: Function words at which runs of unspaced scripts are split, Chinese and then Japanese.
HAN_STOPS = (
    "是不是 有没有 有沒有 可不可以 能不能 什么样 什麼樣 怎么样 怎麼樣 怎么办 怎麼辦 为什么 為什麼 告诉我 告訴我 是什么 是什麼 有什么 有什麼 有哪些 "
    "什么 什麼 怎么 怎麼 怎样 怎樣 如何 为何 為何 哪些 哪个 哪個 哪里 哪裡 哪儿 哪兒 哪座 哪种 哪種 多少 几个 幾個 是否 能否 请问 請問 帮我 幫我 "
    "我想 我要 我们 我們 你们 你們 他们 他們 一下 介绍 介紹 解释 解釋 说明 說明 了解 关于 關於 以及 或者 还是 還是 并且 並且 但是 因为 因為 所以 "
    "如果 可以 应该 應該 需要 这个 這個 那个 那個 这些 這些 那些 很多 一些 一种 一種 意思 这本 這本 那本 什么时候 什麼時候 哪一年 哪年 何时 何時 "
    "有多长 有多長 有多少 有多高 有多大 有多远 有多遠 有多久 有多重 多长 多長 多高 多大 多远 多遠 多久 多重 是谁 是誰 谁写了 誰寫了 谁写 誰寫 写了 寫了 "
    "怎么用 怎麼用 的 是 吗 嗎 呢 吧 啊 么 麼 请 請 我 你 您 他 她 它 这 這 那 谁 誰"
).split()
KANA_STOPS = "について とは として による ため です ました した する この その あの の は が を に で と も へ か".split()
#: Single characters that are no subject when they are left over.
WEAK_SINGLE = (
    "在 中 有 了 和 与 與 及 就 都 也 很 用 做 等 各 每 该 該 从 從 到 对 對 比 把 被 给 給 让 讓 会 會 能 要 想 为 為 以 不 没 沒 上 下 里 裡 内 內 外 之 "
    "于 於 而 且 又 再 还 還 只 才 太 更 已 将 將 由 向 跟 同 个 個 些 位 名 种 種 块 塊 座 本 条 條 张 張 项 項 次 年 月 日 号 號 总 總 共 约 約 大约 "
    "得 地 着 著 过 過 吧 哦 呀 嘛"
).split()
#: Words that name the kind of thing wanted and not the thing.
GENERIC = (
    "stadt gemeinde city town ville ciudad cidade città info infos information informationen informacion información "
    "website webseite webseiten site seite page homepage official offiziell offizielle officiel officielle oficial "
    "meaning bedeutung definition erklärung erklarung explained overview übersicht ubersicht summary zusammenfassung "
    "tutorial guide example examples step steps vs 教程 指南 示例 例子 步骤 步驟"
).split()
#: Languages whose own function words are left out of a lexical query.
STOPWORD_LANGS = "en de fr es pt it nl sv ru".split()

STOP = (
    "a an the is are was were be been being am do does did doing have has had having will would shall should can could may might must "
    "i you he she it we they me my your his her its our their this that these those "
    "of in on at to for with from by about into over after before between under and or but if then than so as not no there here when where "
    "why how what which who whom whose any some get got use used using make made want need please help explain tell show give find look "
    "best good way ways much many very really just s t re ve ll d m "
    "work works working happen happens mean means called call know understand difference differences"
).split()
NOISE = "tutorial guide example examples step steps vs 教程 指南 示例 例子 步骤 步驟".split()

#: Function words by language, in the order in which ties are settled.
MARKERS = {
    "de": "der die das ist wie was wer wo warum ein eine und nicht mit von im den dem des auf fuer für über kann".split(),
    "fr": "le la les des est comment pourquoi qui quoi une un et dans pour avec sur ne pas plus quel quelle".split(),
    "es": "el la los las es como por que quien donde una un y en para con del cual cuales cuanto".split(),
    "pt": "o a os as é como porque quem onde uma um e em para com do da dos das qual quais quanto".split(),
    "it": "il lo la gli le è come perche perché chi dove una un e in per con del della quale quali quanto".split(),
    "nl": "de het een is hoe wat wie waar waarom en niet met van voor op naar welke kan".split(),
    "pl": "jak co kto gdzie dlaczego jest nie i w na z do czy który która które".split(),
    "tr": "nasıl nedir kim nerede neden ve bir bu ile için değil olan daha çok".split(),
    "sv": "hur vad vem var varför är och inte med av för till den det en ett".split(),
    "da": "hvordan hvad hvem hvor hvorfor er og ikke med af for til den det en et kan".split(),
    "no": "hvordan hva hvem hvor hvorfor er og ikke med av for til den det en et kan".split(),
    "fi": "miten mikä kuka missä miksi on ja ei kanssa varten että tai myös se tämä".split(),
    "cs": "jak co kdo kde proč je není a v na s pro do který která které".split(),
    "hu": "hogyan mi ki hol miért van nem és a az egy hogy vagy mint melyik".split(),
    "ro": "cum ce cine unde de ce este nu și în pe cu pentru la care sau un o".split(),
    "ru": "как что кто где почему это не и в на с для по от или какой какая какие".split(),
    "uk": "як що хто де чому це не і в на з для по від або який яка які".split(),
}
#: Letters that make a marker word.
MARKER_WORD = "[a-zà-öø-ÿğışçöü]+"
#: Scripts that name a language, as character class bodies, in order.
SCRIPTS = {
    "ru": "Ѐ-ӿ",
    "he": "֐-׿",
    "ar": "؀-ۿ",
    "hi": "ऀ-ॿ",
    "th": "฀-๿",
    "ko": "ᄀ-ᇿ가-힯",
    "ja": "぀-ヿ",
    "zh": "㐀-䶿一-鿿",
    "el": "Ͱ-Ͽ",
}

#: Intents, in the order in which their patterns are tried.
NAVIGATIONAL = r"^(go to |open )?[\w-]+(\.[\w-]+)+(/.*)?$|^\w+ (login|homepage|website|docs)$"
ACADEMIC = r"\b(paper|papers|arxiv|preprint|study|studies|meta-analysis|citation|cited|journal|doi|clinical trial|dataset benchmark|state of the art|sota|et al|proceedings|thesis)\b"
CODE = (
    r"\b(python|javascript|typescript|rust|golang|java|c\+\+|sql|regex|api|npm|pip|cargo|docker|kubernetes|git|bash|shell|error|exception|traceback|stacktrace|"
    r"compile|install|import|function|async|await|library|framework|package|segfault|nullpointer|undefined|syntax|debug|deprecated|typeerror|df\.|\.py|"
    r"\.js|\.ts|\.rs|\.go|npm i |pip install)\b|[{}();]|=>|::"
)
PRODUCT = r"\b(price|cheap|buy|review|vs|versus|best|compare|deal|specs?|alternative[s]?|pricing|cost)\b"
NEWS = r"\b(today|yesterday|latest|breaking|news|202[4-9]|announce[ds]?|launch(ed)?|election|earnings|acquired|acquisition|resigned|died|update|recall|this week|right now|current(ly)?|live)\b"
REFERENCE = r"^(what is|who is|who was|define|definition of|meaning of|when did|when was|where is|how many|how much|how tall|how old|capital of|population of)\b"
LOCAL = r"\b(near me|nearby|in [A-Z][a-z]+|restaurant|hotel|hours|open now|directions)\b"

RECENCY = "latest current now today newest recent recently upcoming ongoing live aktuell aktuelle aktuellen neueste heute derniere dernier actuel actual atual ultimo ultima ultimi attuale reciente".split()

TRACKING = "^(utm_|fbclid|gclid|msclkid|mc_|ref_?$|source$|_ga)"
REGISTRY_SLD = "co com org net edu ac gov mil int gv go gob gouv govt or ne lg ad priv sch nhs res asn nom web info biz".split()
MULTI_TENANT = (
    "github.io gitlab.io codeberg.page sourceforge.net readthedocs.io rtfd.io gitbook.io notion.site pages.dev workers.dev netlify.app vercel.app surge.sh "
    "herokuapp.com appspot.com azurewebsites.net onrender.com fly.dev glitch.me repl.co replit.app blogspot.com wordpress.com tumblr.com weebly.com "
    "wixsite.com neocities.org bearblog.dev itch.io substack.com medium.com notion.so obsidian.md"
).split()
#: Bonus of a host and all below it.
AUTHORITY = {
    "wikipedia.org": 0.16, "docs.python.org": 0.16, "developer.mozilla.org": 0.16, "stackoverflow.com": 0.13, "github.com": 0.10,
    "arxiv.org": 0.12, "nih.gov": 0.12, "who.int": 0.12, "nature.com": 0.10, "science.org": 0.10,
    "ieee.org": 0.08, "acm.org": 0.08, "semanticscholar.org": 0.08, "britannica.com": 0.10, "reuters.com": 0.10,
    "apnews.com": 0.10, "bbc.com": 0.09, "nytimes.com": 0.08, "theguardian.com": 0.07, "wsj.com": 0.07,
    "ft.com": 0.07, "bloomberg.com": 0.07, "python.org": 0.10, "rust-lang.org": 0.10, "go.dev": 0.10,
    "kubernetes.io": 0.09, "postgresql.org": 0.10, "redis.io": 0.08, "cloudflare.com": 0.07, "aws.amazon.com": 0.08,
    "cloud.google.com": 0.08, "learn.microsoft.com": 0.08, "docs.oracle.com": 0.07, "npmjs.com": 0.06, "pypi.org": 0.07,
    "crates.io": 0.07, "readthedocs.io": 0.06, "news.ycombinator.com": 0.05, "reddit.com": 0.03, "medium.com": -0.02,
    "pinterest.com": -0.15, "quora.com": -0.05, "facebook.com": -0.10, "w3schools.com": -0.03, "geeksforgeeks.org": -0.02,
}
#: Registry suffixes of public bodies (0.10) and universities (0.07).
PUBLIC = (
    "europa.eu int gov mil gov.uk gov.au govt.nz gc.ca gv.at bund.de admin.ch gouv.fr fgov.be overheid.nl gob.es gob.mx gob.ar gob.cl gob.pe gov.br gov.pt "
    "gov.it gov.pl gov.gr gov.ie gov.za gov.in gov.sg go.jp go.kr go.id go.th"
).split()
ACADEMY = "edu ac.uk edu.au ac.nz ac.at ac.jp ac.kr ac.in ac.za ac.il edu.cn edu.sg edu.hk edu.tw edu.br edu.mx edu.pl".split()
PATH_STOP = "html htm php asp aspx jsp cgi shtml index www en docs doc page id amp".split()
SPAM = r"(coupon|casino|escort|\bporn|viagra|crypto-?giveaway|free-?download|torrent|crack|keygen|essay-?writing)"

#: Fusion weights, then what an intent changes, then what a script changes.
WEIGHTS = {"ce": 1.0, "lex": 0.42, "emb": 0.38, "title": 0.30, "url": 0.18, "host": 0.24, "covered": 0.18, "aspect": 0.28, "rare": 0.50, "prior": 0.34, "authority": 1.0, "consensus": 0.14, "fresh": 0.0, "thin": 0.22, "dead": 0.30, "root": 0.10, "orphan": 0.35, "date": 0.45}
INTENT_WEIGHTS = {
    "news": {"fresh": 0.45, "authority": 0.8, "ce": 0.9},
    "academic": {"prior": 0.45, "authority": 1.1},
    "code": {"lex": 0.52, "url": 0.24, "authority": 0.55},
    "navigational": {"url": 0.5, "title": 0.45, "ce": 0.7, "prior": 0.5, "host": 0.85},
    "reference": {"authority": 1.2},
    "product": {"authority": 0.45, "prior": 0.28, "fresh": 0.20, "ce": 1.15},
}
SCRIPT_WEIGHTS = {"ce": 0.35, "emb": 0.85, "lex": 0.70, "title": 0.40, "url": 0.24}
NON_LATIN = "zh ja ko ar he fa ur ru uk bg sr mk el hi bn ta te kn ml th lo km my ka hy am yi".split()
RECENT_FRESH = 0.28
INTENTS = ("navigational", "informational", "code", "academic", "news", "product", "local", "reference")

PASSAGE_CHARS, PASSAGE_OVERLAP, PASSAGES = 620, 140, 6
SCAN_CHARS, TARGETED = 12_000, 3
ORPHAN_FIT, ASPECT_HEAD, ASPECT_HIT = 0.02, 800, 0.55
SOFT, COMPOUND = 0.8, 0.85
MIN_RELEVANCE, MIN_RESULTS, RERANK_DEPTH = 0.18, 3, 20
MIN_WINDOW, LOOKBACK, LOOKAHEAD, LEDE_BONUS = 250, 80, 60, 0.5
WINDOW_JOIN = " [...] "
LISTY = r"↑|\bRetrieved\b|\bArchived\b|\[edit\]|\s\|\s|»|\^\s"
#: A name inside: punctuation between letters or digits, or a digit; not so a bare number or a period.
IDENTIFIER = r"[a-z0-9][_./:\-][a-z0-9]|\d"
BARE_NUMBER = r"^\d{1,4}$"
PERIOD = r"(?i)^(q[1-4]|h[12]|fy\d{2,4}|[12]?\d(st|nd|rd|th)?)$"

#: Address checks of recalled plans.
URL_OK = r"(?i)^https?://[a-z0-9.-]+\.[a-z]{2,24}(/|$|\?|#)"
SEARCH_ENGINE = r"(?i)^https?://([a-z0-9-]+\.)*(google|bing|duckduckgo|yandex|baidu|ecosia|startpage|brave|searx)\.[a-z.]+/"
MAX_URL, MAX_LINE, MAX_QUERY = 400, 2000, 2000

#: Site routes: intents that fire them before a plan is there.
ROUTES = {
    "wikipedia": ("informational", "reference", "navigational", "academic", "news"),
    "hn": ("code", "news"),
    "stackoverflow": ("code",),
    "github": ("code",),
    "arxiv": ("academic",),
    "semanticscholar": (),
    "pubmed": (),
    "mdn": (),
    "npm": (),
    "pypi": (),
    "crates": (),
    "openlibrary": (),
    "reddit": ("product",),
    "youtube": (),
}
#: Words of a query that each route takes (0: all).
ROUTE_TERMS = {"wikipedia": 3, "hn": 3, "stackoverflow": 6, "github": 3, "arxiv": 5, "semanticscholar": 6, "pubmed": 5, "mdn": 4, "npm": 3, "pypi": 0, "crates": 3, "openlibrary": 4, "reddit": 5, "youtube": 5}
ROUTES_OFF = ("semanticscholar",)
ROUTE_DISTRUST = 0.62
#: Editions of the encyclopedia that a route may ask; any other language asks en.
WIKI_LANGS = (
    "ar az be bg bn bs ca ceb cs cy da de el en eo es et eu fa fi fr ga gl he hi hr hu hy id is it ja ka kk ko la lt lv mk ml mr ms my nl nn no "
    "pl pt ro ru sh simple sk sl sq sr sv sw ta te th tl tr uk ur uz vi war zh"
).split()
#: Words that are no package's name.
PACKAGE_STOP = "python pypi package library module install how to the in for with use using a an of and docs".split()
#: What a plan writes where a route does not apply.
NO_ROUTE = "none n/a na - -- — null nil keine kein nothing skip".split()
ROUTE_TITLE_FIT, ROUTE_KEPT, SITE_SEARCH_HOSTS, HOST_GATE, GATE = 0.03, 4, 3, 6, 96
HUBS, SITEMAP_ROOT_EXTRA, SITEMAP_PRIOR, REFINE_FETCH = 4, 3, 0.45, 12
FRESH_DAYS = {"day": 1, "week": 7, "month": 31, "year": 366}
#: Seconds that a plan's first address may take on top of a tier's window, and that stragglers get after the first wave.
PLAN_GRACE = {"fast": 1.0, "standard": 4.5, "deep": 6.0}
TAIL_WINDOW = {"fast": 0.9, "standard": 1.6, "deep": 4.0}
PAGE_EXTRA_BUDGET, MAX_PAGE = 10.0, 10
#: What an answering model reads: opening, characters of the first pages and of later ones, how many are first, pages.
LEAD_CHARS, TOP_PAGE_CHARS, PAGE_CHARS, TOP_PAGES, ANSWER_PAGES = 1400, 3200, 1400, 4, 8
#: Link following.
HUB_FIT, HUB_SECTION_FIT, HUB_SECTION_LINKS, HUB_LINKS, SITE_SEARCH_LINKS = 0.22, 0.06, 5, 5, 6
DEEP_FIT, DEEP_MARGIN, DEEP_LINKS, DEEP_PER_PAGE = 0.34, 0.05, 4, 2
SITEMAP_HOSTS, SITEMAP_LINKS, SITEMAP_FIT, THIN_TEXT = 8, 3, 0.06, 400
#: Depth tiers: pages fetched at most, addresses taken of a plan (None: all), pages that suffice, seconds.
TIERS = {"fast": (28, 6, 16, 2.5), "standard": (44, 10, 26, 6.0), "deep": (72, None, 48, 24.0)}
PLAN_TTL_DAYS, ATLAS_TTL_DAYS, SITEMAP_TTL_DAYS, SITEMAP_MISS_HOURS = 30, 30, 3, 6
