"""Fixed values of the task: label set, lookups, keyword lists, bin edges.

Results are only right with exactly these values, so they stand here as plain
text, in natural order.  Everything else in the package derives from them.
"""

from __future__ import annotations

# Class number -> emoji.  Several entries carry U+FE0F, the flag
# is two code points; never normalise them.
EMOJI_BY_LABEL = {
    0: "❤️", 1: "😍", 2: "😂", 3: "💕", 4: "🔥",
    5: "😊", 6: "😎", 7: "✨", 8: "💙", 9: "😘",
    10: "📷", 11: "🇺🇸", 12: "☀️", 13: "💜", 14: "😉",
    15: "💯", 16: "😁", 17: "🎄", 18: "📸", 19: "😜",
}

# The listed emoji without a positive polarity.
NOT_POSITIVE = ("😂", "📷", "🇺🇸", "📸")

# Second choice for each emoji, and the one for all others.
ALTERNATIVE = {
    "❤️": "💕", "😍": "😊", "😂": "😜", "💕": "❤️", "🔥": "💯",
    "😊": "😁", "😎": "😊", "✨": "☀️", "💙": "💜", "😘": "❤️",
    "📷": "📸", "🇺🇸": "☀️", "☀️": "✨", "💜": "💙", "😉": "😂",
    "💯": "🔥", "😁": "😍", "🎄": "✨", "📸": "📷", "😜": "😉",
}
DEFAULT_ALTERNATIVE = "😊"

# Graded similarity of two different emoji in hundredths.  It is
# symmetric; a pair not given here scores 0, an emoji with itself 100.
SIMILARITY = {
    ("❤️", "💕"): 91, ("❤️", "💙"): 72, ("❤️", "💜"): 73, ("💕", "💙"): 70,
    ("💙", "💜"): 85, ("😊", "😁"): 88, ("😊", "😍"): 75, ("😁", "😍"): 72,
    ("😂", "😜"): 68, ("😜", "😉"): 74, ("😂", "😉"): 60, ("📷", "📸"): 93,
    ("🔥", "💯"): 76, ("🔥", "✨"): 58, ("✨", "☀️"): 65, ("😘", "❤️"): 78,
    ("😘", "💕"): 80, ("😎", "😊"): 55,
}

# Left-closed similarity bins in hundredths, last edge exclusive.
SIMILARITY_EDGES = (0, 1, 50, 70, 85, 101)

# Sub-strings (of the lower-cased text) behind the irony rule.
IRONY_WORDS = (
    "great", "wonderful", "love", "perfect", "amazing",
    "just what i needed", "totally", "absolutely",
)
NEGATIVE_WORDS = (
    "cancel", "fail", "late", "stuck", "broke", "lost",
    "miss", "bad", "terrible", "worst", "monday",
)

# Sample types, and those that count as ironic.
SAMPLE_TYPES = ("irony", "sarcasm", "dark_humor", "slang", "bittersweet")
IRONIC_TYPES = ("irony", "sarcasm", "dark_humor", "slang")

# Text length bounds, encoded length, vocabulary size, marker.
MIN_CHARS, MAX_CHARS = 10, 280
MAX_TOKENS = 256
MAX_FEATURES = 50_000
NO_ANSWER = "❓"
UNKNOWN = "unknown"
UNKNOWN_LABEL = -1
POSITIVE, NOT_POSITIVE_NAME = "positive", "neutral_or_negative"

EMOJI = tuple(EMOJI_BY_LABEL.values())
POSITIVE_EMOJI = tuple(e for e in EMOJI if e not in NOT_POSITIVE)
