"""Thresholds, patterns and word lists the results depend on.

Every operator takes them as keyword parameters; these are the defaults.
"""

# --- Fixed values: scripts -------------------------------------------------------------------
HANGUL = "가-힣"
HANGUL_AND_JAMO = "\uac00-\ud7af\u1100-\u11ff\u3130-\u318f"
JAMO = "\u1100-\u11ff\u3130-\u318f"
HAN = "\u4e00-\u9fff"
OTHER_SCRIPTS = "\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\u0370-\u03ff\u0400-\u04ff"

# --- Fixed values: stock phrases a speech model invents --------------------------------------
SPEECH_STOCK_PHRASES = [
    r"국감장", r"조정식", r"홍\s*사장", r"용재진", r"국토교[통토]위원", r"기관\s*증인", r"발언에\s*국감",
    r"술렁이자", r"시청해\s*주셔서", r"구독과\s*좋아요", r"영상\s*편집", r"자막\s*제공", r"광고\s*를?\s*포함",
    r"다음\s*(?:화|편|영상|시간)\s*에\s*(?:서)?\s*(?:만나|뵙|봐|봬)",
    r"\bthank\s*you\b", r"\bthanks?\s*for\s*watching\b", r"\bsee\s*you\s*(?:next|in|soon|later)?\b",
    r"\bsubscribe\b", r"\blike\s*and\s*subscribe\b",
    r"MBC\s*뉴스", r"SBS\s*뉴스", r"KBS\s*뉴스", r"특파원\s*입니다", r"기자입니다",
]
COURTESY = (
    r"^\s*(?:감사합니다|고맙습니다|감사해요|수고하셨습니다|수고하세요|안녕하세요|안녕히\s*가세요|안녕히\s*계세요"
    r"|구독\s*(?:부탁|해)|좋아요\s*(?:부탁|눌러)|다음\s*(?:시간|영상)에서?\s*(?:만나|봬|봐)"
    r"|이상입니다|이상\s*\S+\s*이었습니다)[\s\.\!\?]*$"
)
LONE_THANKS = r"^\s*감사합니다[\s\.\!\?…]*$"
TRAILING_BOILERPLATE = (
    r"(?i)\s*(?:시청해\s*주(?:셔서|시는).*$|구독과?\s*좋아요.*$"
    r"|다음\s*(?:시간|영상)에서?\s*(?:만나(?:요)?|봬요|봐요|뵐게요).*$|감사합니다[\s\.\!\?]*$)"
)

# --- Fixed values: stock phrases a translation model invents ---------------------------------
MT_STOCK_PHRASES = [
    r"(?i)한[국글]\s*(?:어\s*)?자막\s*(?:by|제작|번역|제공|:)",
    r"(?i)자막\s*(?:제작|번역)\s*[:by]",
    r"(?i)(?:번역|자막)\s*by\s+\S+",
    r"(?i)\b(?:subtitles?|translation|transcribed)\s+by\b",
    r"(?i)\b(?:amara\.org|otter\.ai|castingwords)\b",
    r"시청해\s*주(?:셔서|시는)",
    r"구독과?\s*좋아요",
    r"(?i)\bthanks?\s+(?:for|to)\s+watching\b",
    r"(?i)\bplease\s+subscribe\b",
    r"(?i)\blike\s+and\s+subscribe\b",
    r"(?i)^\s*thank\s*you\s*[\.!\?…]?\s*$",
    r"^\s*WEBVTT\b",
    r"^\s*\d{2}:\d{2}:\d{2}[,\.]?\d*",
    r"(?i)^\s*[\(\[]\s*(?:음악|박수|웃음|효과음|BGM|MUSIC|APPLAUSE|LAUGHTER)\s*[\)\]]\s*$",
    r"www\.\w+\.(?:org|com|co\.kr)\b",
]

# --- Fixed values: placeholder translations, render faults, instruction leaks ----------------
PLACEHOLDERS = [r"^\[.*\]$", r"^untranslat", r"^unknown$", r"^n/?a$", r"^\?+$", r"^\.+$"]
RENDER_FAULTS = [
    r"\?{2,}",
    r"[A-Za-z가-힣]\?+[A-Za-z가-힣]",
    r"[\x00-\x1f\x7f-\x9f]",
    r"\bp\d+_b\d+\b",
    r"[가-힣]+\?+[가-힣]+",
    r"\?{3,}",
]
INSTRUCTION_PHRASES = [
    "output exactly", "format: ", "1. translation", "translate:", "rules:", "terminology:",
    "page context:", "[translate]", "[terminology]", "[rules]",
]

# --- Fixed values: page text ------------------------------------------------------------------
CODE_PATTERNS = [
    r"#include\s*<", r"using\s+namespace", r"\bint\s+main\s*\(", r"\bcout\s*<<", r"\bcin\s*>>",
    r"\bprintf\s*\(", r"\bscanf\s*\(", r"\breturn\s+\d+;", r"%[dfsclx]", r"\\n[\"']", r"<<\s*endl",
    r"\bSystem\.out\.print", r"\bconsole\.log\s*\(", r"\bpublic\s+static\s+void\s+main",
]
CONNECTORS = [
    "⇒", "→", "➡", "↔", "←", "⟹", "⟸", "⇔", "·", "•", "■", "□", "▶", "▷", "◆", "◇", "○", "●", "★", "☆",
    ">", "<", "->", "<-", "=>", "<=",
]
ARROWS = ["⇒", "→", "➡", "↔", "←", "⟹", "⟸", "⇔", "⇨", "⇦", "➔", "➜", "➝", "➞"]
SPAN_BULLETS = [
    "•", "·", "■", "□", "▶", "▷", "◆", "◇", "○", "●", "★", "☆", "→", "⇒", "✓", "✔", "◀", "▼", "▲",
]
SYMBOL_FONTS = ["wingdings", "symbol", "webdings", "zapfdingbats"]
PREFIX_SYMBOLS = "▶►›>•◦○●·ㆍ☐☑□■※★☆"  # any of these, or a hyphen followed by a space
PRESERVED_PREFIXES = [
    "☑", "☐", "□", "■", "✓", "✔", "✗", "✘", "📦", "📌", "🔹", "🔸", "✅", "⚠️", "💡", "📍",
    "🔴", "🟢", "🔵", "⭐", "🎯", "📝", "📋", "🚀", "⚡", "🔥",
]
RENDERED_PREFIXES = ["-", ">", "›", "•", "◦", "○", "●", "·", "ㆍ", "▶", "►", "※", "★", "☆"]
CONTINUATION_STARTS = ["고", "며", "면", "니", "라", "를", "을", "는", "은", "이", "가", "에", "로", "와", "과"]
CONTINUATION_ENDINGS = r"(?:지에|과|와|야)$"
CONTINUATION_WORDS = r"^(?:관한\s|관련된\s|관하여\s|대한\s|하는가\??$|할까\??$|한다\.$|있다\.$)"
PRINCIPLE_TITLE = r"^(?:기본원리|원리|원칙)\s*\d+|^[Bb]asic\s+[Pp]rinciple\s*\d+|^[Pp]rinciple\s*\d+"
OPTION_PREFIX = r"^(?:[a-dA-D][\.\)]|[1-9]\)|\(?[가나다라마바사아][\.\)])"
SECTION_WORDS = r"관련된|관한|관하여"
FINISHED_ENDINGS = r"(?:다|요|죠|음|함|임|됨|니다|세요|습니다|입니다)$"
# One character to one character, then one to several.
ONE_TO_ONE = (
    "“”‘’「」『』«»–—−\u00a0\u2003\u2002＝：；，．",
    "\"\"''\"\"\"\"\"\"---   =:;,.",
)
ONE_TO_MANY = [
    ("…", "..."), ("⇒", "->"), ("⇨", "->"), ("⟹", "->"), ("→", "->"), ("➡", "->"), ("➔", "->"),
    ("←", "<-"), ("⇐", "<-"), ("↔", "<->"), ("⇔", "<->"),
]
MIN_FONT_SIZE = {
    "title": 10.0, "heading": 8.0, "body": 6.0, "bullet": 6.0, "caption": 5.0, "footer": 5.0,
    "source": 5.0, "default": 5.0,
}
EXPAND_RATIO = {
    "title": (0.5, 0.3), "heading": (0.6, 0.4), "body": (0.8, 0.8), "bullet": (0.8, 0.6),
    "caption": (1.0, 0.8), "default": (0.7, 0.5),
}

# --- Fixed values: glossary, hints, library --------------------------------------------------
DEFAULT_CATEGORY = "일반"
MAX_HINT_TERMS, MAX_HINT_CHARS, MAX_HINT_TERM_LEN = 32, 280, 40
FORBIDDEN_NAME_CHARS = r'\/:*?"<>|'
STAGE_BASELINES = {"ocr": 15.0, "translate": 50.0}
OTHER_STAGE_BASELINE = 30.0
BUNDLING_SECONDS = 3.0
STAGE_SANITY = {"ocr": (2.0, 60.0), "translate": (10.0, 180.0)}
OTHER_STAGE_SANITY = (0.0, 600.0)

# Merging neighbouring regions: fixed values.
REGION_OPENERS = r"^(?:[•●▶☐◦○■□※★☆◆◇→⇒✓✔▼▲\-]|\d+[\.\)]\s+|[QA]\d+|\d{2}\s+[가-힣A-Z])"
SENTENCE_CLOSERS = r"[.?!。)）\]】]$"
ACRONYM_END = r"[A-Z]{2,}(\s*\([^)]+\))?\s*$"
QUESTION_START = r"^[QA]\d+"
LABEL_START = r"^\d+[\.\)]\s*"
LABEL_CHARS = 15
