"""Parameters of the operators with their defaults in production."""

from __future__ import annotations

# Quality rules (5). Ratios are whole thousandths of a word count; lengths are hundredths of a code point.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SKETCH_MIN_DOCS = 30
FENCE = 4  # widths from the median
LENGTH_WIDTH = 60
SYMBOL_WIDTH = 50
DUP_LINE_WIDTH = 15
REPEAT_WIDTH = 100

# MinHash near duplicates (3).
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
HALVES = 16  # hash collections per side; a pair at 0.75 is missed with a chance of 4e-6
HALF_ROWS = 2  # minima joined in one half key
PIVOTS = 3  # links tried first; the prefix search settles what they leave open
BROADCAST_IDS = 1_000_000

# Benchmark decontamination (7).
TEMPLATE_WINDOW = 8  # words in a template window
MIN_ITEM_WORDS = 5  # shorter items are no templates; they are met as plain word runs
LEAK_WORDS = 13  # covered words that make a leak; shorter items must be covered whole
MIN_LITERALS = 0.5  # share of a window's words that must not be placeholders
# Units of measure, fixed values.
UNITS = (
    "kg", "g", "mg", "kilogram", "kilograms", "gram", "grams", "milligrams", "tons", "tonnes", "lb", "lbs", "pound", "pounds",
    "oz", "ounce", "ounces", "km", "m", "cm", "mm", "kilometer", "kilometers", "kilometre", "kilometres", "meter", "meters",
    "metre", "metres", "centimeters", "centimetres", "millimeters", "millimetres", "mile", "miles", "yard", "yards", "ft",
    "foot", "feet", "inch", "inches", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second",
    "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "mph", "kmh", "hz", "kw", "watts", "degrees",
)

# Mixing (6).
MIX_WEIGHTS = (5, 2, 1)  # of the sources in order of their names, repeating
MIX_SHARE = 1.5  # words of the mix for each word of the input
MIX_MOST = 2  # times its own words that a source can give
MIX_SEED = "mix-0"

# Tokenizer of the token operators (1, 2), a file of the public tokenizers.
TOKENIZER = "byte_bpe_50k.json"

# Token files (1).
END_ID = 0  # appended to every document
BLOCK_TOKENS = 1 << 19  # a block is closed at this many tokens; a longer document is a block of its own
CHECKPOINT_STEPS = 256  # steps of all lanes between two checkpoints
MOST_LANES = 1024
FREQUENCY_BITS = 20  # frequencies of the shared table add up to 2 ** 20

# Token counts (2).
TOKEN_LIMIT = 1024
FREQUENT_CUTS = 32_768  # entries of the table sent to every task
MERGED_AT_ONCE = 32  # summaries of frequent cuts that one task merges

# Quality classifier (9) and toxicity (10). Bounds of the samples that models are fitted on.
TRAIN_DOCS = 4096
TRAIN_CHARS = 30_000  # longer texts are scored like all others, but not trained on
PASSAGE_WORDS = 64
TOXIC_POSITIVES = 2048
TOXIC_UNLABELLED = 4096
TOXIC_FEATURES = 512

# Ranked lexical search (11).
SEARCH_MOST = 20
SEARCH_FIRST = 100  # documents rescored first for each query; their scores give its threshold
SEARCH_ITEMS = 4096  # queries looked up together, and the bytes of their texts
SEARCH_BYTES = 4 << 20

# URL filters (12): host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
URL_DEFAULT = "allow"  # a page that no rule fits

# Prefix trie (13).
TRIE_COLUMNS = 8  # turns in a block of columns
TRIE_GROUP = 5  # conversations that share heads in the query's corpus, and the bound of a head's turns
TRIE_HEADS = 9
