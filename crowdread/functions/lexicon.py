"""Term lists and label tables.

All values below are fixed values: results only agree with other scorers of the same
comments when the lists are exactly these. Terms match as plain substrings of the
lower-cased text, so "tha" is found in "that" and "ai" in "trail".
"""

from __future__ import annotations

INTENT_QUESTION = (
    "?", "how", "why", "what", "when", "where", "who", "which", "can you", "could you",
)

INTENT_SUGGESTION = (
    "should", "please", "add", "make", "improve", "fix", "need", "want", "would be better",
    "consider", "suggest",
)

INTENT_PRAISE = (
    "love", "amazing", "great", "awesome", "best", "perfect", "fantastic", "excellent",
    "brilliant", "goat", "🔥", "❤", "👏", "💯",
)

INTENT_COMPLAINT = (
    "hate", "worst", "bad", "boring", "waste", "dislike", "trash", "terrible", "useless",
    "disappointed", "clickbait",
)

PRAISE_NEGATION = (
    "cannot explain", "can't explain", "could not explain", "no one explains",
    "no one has explained", "nobody explains", "no one can", "nobody can", "none of them",
    "hats off", "hat's off", "hats off to", "even phd", "even professor", "even teachers",
    "better than any", "better than all", "never seen", "never found", "never heard",
    "not found anywhere", "nowhere else", "jaisa lag", "jaisa nahi", "se better", "se acha",
    "jitna acha", "utna nahi", "itna acha", "god level", "god bless", "bless you",
    "truly amazing", "truly great", "truly the best", "lives his teachings", "truly lives",
    "completely different", "unique explanation", "mind blowing", "mind blown",
)

GENUINE_ANGER = (
    "hate this", "this is terrible", "this is worst", "waste of time", "so boring",
    "just for views", "clickbait", "watch hours", "not worth",
)

RULE_THANKS = (
    "thank", "thanks", "grateful", "appreciate", "helped", "got placed", "got job",
    "got selected", "got offer", "because of you", "❤", "🙏", "😍",
)

RULE_DELIGHT = (
    "amazing", "awesome", "incredible", "best ever", "love this", "brilliant", "outstanding",
)

RULE_SURPRISE = (
    "wow", "didn't know", "never knew", "mind blown", "surprised", "omg", "wait what",
)

RULE_FEAR = (
    "scared", "worried", "nervous", "afraid", "anxious",
)

RULE_SADNESS = (
    "sad", "miss", "lost", "gone", "rip", "crying", "😢", "😭",
)

RULE_ANGER = (
    "angry", "hate", "worst", "useless", "waste", "pathetic", "disgusting", "terrible",
)

PRAISE_WORDS = (
    "hats off", "amazing", "brilliant", "fantastic", "superb", "excellent", "well done",
    "best teacher", "best video", "great explanation", "love this", "appreciate", "thank",
    "god bless", "salute", "keep it up", "bless", "🙏", "❤", "👏", "bawaal", "badhiya",
    "zabardast", "kamaal", "shandaar",
)

JOY_WORDS = (
    "thank", "thanks", "grateful", "appreciate", "love", "amazing", "awesome", "excellent",
    "brilliant", "best", "great", "wonderful", "fantastic", "outstanding", "perfect",
    "helpful", "good teaching", "very good", "nice", "beautiful", "enjoyed", "loved",
    "keep it up", "well done", "superb", "impressive", "got placed", "got job",
    "got selected", "bawaal", "badhiya", "mast", "ekdum", "zabardast", "kamaal", "shandaar",
    "jai hind", "❤", "🙏", "😍", "🥰", "👏", "🔥", "💪", "🎉", "🙌",
)

ANGER_WORDS = (
    "hate", "worst", "terrible", "horrible", "awful", "pathetic", "useless", "waste",
    "garbage", "trash", "disgusting", "shameful", "corrupt", "liar", "fake", "propaganda",
    "fraud", "scam", "embarrassing", "unacceptable", "disgrace",
)

SADNESS_WORDS = (
    "sad", "miss", "missed", "gone", "lost", "rip", "crying", "disappointed", "unfortunate",
    "heartbreaking", "tragic", "unable to", "can't find", "😢", "😭", "💔",
)

SURPRISE_WORDS = (
    "wow", "omg", "unbelievable", "incredible", "mind blown", "didn't know", "never knew",
    "shocked", "unexpected", "wait what", "no way", "😮", "🤯", "😲",
)

FEAR_WORDS = (
    "scared", "worried", "nervous", "afraid", "anxious", "terrified", "panic", "danger",
    "threat", "😨", "😰", "😱",
)

DISGUST_WORDS = (
    "gross", "disgusting", "revolting", "repulsive", "vile", "nasty", "sick", "🤢", "🤮",
)

SINCERE_MARKERS = (
    "thank", "thanks", "grateful", "appreciate", "appreciated", "bless", "god bless",
    "hats off", "hat's off", "salute", "well done", "keep it up", "keep going", "great work",
    "good work", "nice work", "nice explanation", "great explanation", "i appreciate",
    "i love", "i learned", "i have learned", "best teacher", "best explanation",
    "best video", "best channel", "no one explains", "no one has explained", "better than",
    "lives his teachings", "truly lives", "bhaiya", "sir aap", "nitish sir", "iss se best",
    "sabse best", "bohot acha", "bahut acha", "bhot acha", "maza aa gaya", "maza aaya",
    "maja aa gaya", "🙏", "❤", "😍", "🥰", "🎉", "🎊", "💯", "👏", "🌟", "⭐",
)

SARCASM_SIGNALS = (
    "yeah right", "oh sure", "totally not", "clearly the best", "wow so helpful",
    "very helpful indeed", "great job as always", "as if", "oh wow amazing",
    "what a surprise", "shocking", "/s",
)

HINGLISH_MARKERS = (
    "nahi", "hai", "bhai", "yaar", "kya", "aur", "tha", "hoga", "bahut", "accha", "theek",
    "bilkul", "matlab", "lekin", "phir", "agar", "toh", "mujhe", "tumhe", "unhe", "apna",
    "mera", "tera", "dekho", "suno", "bata", "kar", "karo", "kiya", "kyun", "kyunki",
)

STOP_WORDS = (
    "you", "the", "this", "to", "and", "of", "in", "is", "it", "for", "that", "a", "are",
    "was", "be", "have", "with", "on", "at", "by", "from", "as", "an", "or", "but", "not",
    "so", "if", "we", "he", "she", "they", "i", "my", "your", "his", "her", "our", "their",
    "me", "him", "us", "them", "what", "which", "who", "how", "when", "where", "why", "can",
    "will", "do", "does", "did", "has", "had", "been", "being", "would", "could", "should",
    "may", "might", "must", "just", "also", "more", "very", "much", "about", "up", "out",
    "no", "one", "all", "there", "than", "then", "now", "its", "sir", "bhai", "hai", "ka",
    "ki", "ke", "ko", "se", "ne", "ye", "yeh", "kya", "aur", "nahi", "hain", "tha", "thi",
    "ho", "hoga", "mera", "tera", "apna", "please", "thank", "thanks", "video", "watch",
    "watching", "watched", "see", "like", "love", "great", "good", "amazing", "best",
    "awesome", "nice", "well", "really", "actually", "definitely", "absolutely", "totally",
    "literally", "basically", "http", "https", "www", "com", "youtube", "channel",
    "subscribe",
)

HINGLISH_POSITIVE = (
    "bawaal", "bawal", "mast", "ekdum", "badhiya", "badiya", "zabardast", "jhakaas", "ekdam",
    "dhamaal", "kamaal", "shandaar", "bindaas", "sahi hai", "bilkul sahi", "jai hind",
    "jai ho", "bharat mata", "vande mataram", "best kisine", "isse best", "sabse best",
    "itna acha", "bohot acha", "bahut acha", "bhot acha", "bhot badiya", "maja aa",
    "maza aa", "maza aaya", "maja aaya", "hats off", "hat off", "salute", "kya baat",
    "kya bat", "wah wah", "waah", "superb sir", "amazing sir", "great sir", "best sir",
    "bhaiya best", "sir best", "nitish sir", "campusx", "god level", "mind blowing",
    "mind blown",
)

HELP_REQUESTS = (
    "not working", "giving error", "getting error", "error in", "how to fix", "how do i fix",
    "can you help", "please help", "help me", "i am stuck", "i'm stuck", "stuck on",
    "not able to", "unable to", "facing issue", "facing error", "installation error",
    "import error", "module not found", "any solution", "any fix", "solved?", "how to solve",
)

PRAISE_WITH_QUESTION_WORD = (
    "appreciate how", "appreciate what", "love how", "love what", "like how", "like what",
    "amazing how", "incredible how", "great how", "best how", "understand how",
    "learned how", "shows how", "explains how", "taught how", "teaching how",
    "broke down how", "broken down how", "no one explains", "no one has explained",
    "better than", "the best way",
)

CURIOUS_MARKERS = (
    "can you explain", "could you explain", "could you please", "is it possible",
    "i want to know", "can someone tell", "does anyone know", "please explain",
    "please tell", "what about", "how does this", "why does this", "what is the difference",
    "how can i", "when will", "where can i", "which one is", "who can",
)

QUESTION_OPENERS = (
    "why ", "how ", "what ", "when ", "where ", "which ", "who ", "is it ", "are there ",
    "can i ", "will this ", "does this ", "should i ", "do i need ", "what if ",
)

CRITICISM_MARKERS = (
    "shameful", "disgusting", "pathetic", "worst", "useless", "waste", "corrupt",
    "corruption", "failure", "failed", "incompetent", "disappointed", "misleading", "fake",
    "propaganda", "liar", "lies", "should resign", "step down", "embarrassing",
    "unacceptable", "shame", "terrible", "horrible", "awful", "disgrace", "clickbait",
    "waste of time", "dislike", "thumbs down", "not worth", "mislead", "copy paste",
    "plagiar", "talking too much", "unnecessary talks", "watch hours only",
    "less on content", "not gripping",
)

REQUEST_WORDS = (
    "please", "kindly", "request",
)

COMPLIMENT_WORDS = (
    "best", "great", "amazing", "no one", "better than", "love", "thank", "outstanding",
    "excellent",
)

POSITIVE_EMOJI = (
    "🙏", "❤", "😍", "🔥", "💪", "👏", "🥰", "😊", "✅", "🎉", "🙌",
)

TITLE_EDUCATION = (
    "learn", "tutorial", "course", "lecture", "teach", "explain", "class", "study",
)

TITLE_NEWS = (
    "news", "politics", "government", "minister", "election", "modi", "india", "crisis",
)

TITLE_TRAVEL = (
    "travel", "vlog", "trip", "visit", "tour", "explore", "adventure",
)

TITLE_ENTERTAINMENT = (
    "funny", "comedy", "prank", "meme", "entertainment", "react",
)

TITLE_HEALTH = (
    "fitness", "gym", "workout", "diet", "health", "yoga",
)

TITLE_TECHNOLOGY = (
    "tech", "ai", "ml", "code", "program", "python", "llm", "gpt", "data",
)

EVAL_JOY = (
    "thank", "great", "amazing", "awesome", "love", "best", "excellent", "brilliant",
    "helped", "got placed", "got job", "bawaal", "badhiya", "mast", "ekdum", "zabardast",
    "kamaal", "shandaar", "❤", "🙏", "😍", "🥰",
)

EVAL_ANGER = (
    "hate", "worst", "terrible", "pathetic", "useless", "waste", "shameful", "corrupt",
    "liar", "fake", "disgusting", "wrong", "misleading",
)

EVAL_SADNESS = (
    "sad", "miss", "disappointed", "unable", "can't find", "😢", "😭",
)

EVAL_SURPRISE = (
    "wow", "omg", "unbelievable", "mind blown", "never knew", "no way", "😮",
)

EVAL_FEAR = (
    "scared", "worried", "nervous", "afraid", "anxious",
)

EVAL_DISGUST = (
    "gross", "revolting", "vile", "nasty", "🤢",
)

# Keyword vote: lists are tried in this order.
KEYWORD_EMOTIONS = {
    "joy": "JOY_WORDS",
    "anger": "ANGER_WORDS",
    "sadness": "SADNESS_WORDS",
    "surprise": "SURPRISE_WORDS",
    "fear": "FEAR_WORDS",
    "disgust": "DISGUST_WORDS",
}

# Evaluation form of the keyword vote, same order, shorter lists.
EVAL_EMOTIONS = {
    "joy": "EVAL_JOY",
    "anger": "EVAL_ANGER",
    "sadness": "EVAL_SADNESS",
    "surprise": "EVAL_SURPRISE",
    "fear": "EVAL_FEAR",
    "disgust": "EVAL_DISGUST",
}

# Title categories, tried in this order.
TITLE_CATEGORIES = {
    "Educational": "TITLE_EDUCATION",
    "News/Politics": "TITLE_NEWS",
    "Travel/Vlog": "TITLE_TRAVEL",
    "Entertainment": "TITLE_ENTERTAINMENT",
    "Health/Fitness": "TITLE_HEALTH",
    "Technology/AI": "TITLE_TECHNOLOGY",
}

# 28 fine emotion labels, by display emotion. Other labels count as neutral.
FINE_EMOTIONS = {
    "joy": (
        "admiration", "amusement", "approval", "excitement", "gratitude", "joy", "love",
        "optimism", "pride", "relief",
    ),
    "surprise": ("surprise", "realization"),
    "anger": ("anger", "annoyance", "disapproval"),
    "sadness": ("sadness", "disappointment", "grief", "remorse"),
    "fear": ("fear", "nervousness"),
    "disgust": ("disgust", "embarrassment"),
    "neutral": ("neutral", "curiosity", "confusion", "caring", "desire"),
}

# Words counted by the default sentiment scorer.
POSITIVE_TERMS = tuple(dict.fromkeys(JOY_WORDS + HINGLISH_POSITIVE))
NEGATIVE_TERMS = tuple(
    dict.fromkeys(
        ANGER_WORDS + SADNESS_WORDS + FEAR_WORDS + DISGUST_WORDS + CRITICISM_MARKERS
    )
)

# Function words counted by the language detector, one list per language.
LANGUAGE_WORDS = {
    "en": (
        "the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "as", "this",
        "by", "are", "was", "you", "not", "be", "have", "from",
    ),
    "fr": (
        "le", "la", "les", "et", "des", "est", "une", "dans", "qui", "que", "pour", "pas",
        "sur", "avec", "du", "ce", "il", "je", "nous", "vous",
    ),
    "de": (
        "der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "den", "von", "zu",
        "auf", "sich", "dem", "ich", "für", "auch", "wir", "aber",
    ),
    "es": (
        "el", "los", "las", "y", "una", "por", "con", "para", "como", "pero", "más", "muy",
        "del", "está", "este", "todo", "porque", "cuando", "hay", "ser",
    ),
}

# Emoji names (Unicode CLDR short names, blanks as underscores).
EMOJI_NAMES = {
    "❤": "red_heart", "🔥": "fire", "👏": "clapping_hands", "💯": "hundred_points",
    "🙏": "folded_hands", "😍": "smiling_face_with_heart-eyes",
    "🥰": "smiling_face_with_hearts", "💪": "flexed_biceps", "🎉": "party_popper",
    "🙌": "raising_hands", "😊": "smiling_face_with_smiling_eyes",
    "✅": "check_mark_button", "😢": "crying_face", "😭": "loudly_crying_face",
    "💔": "broken_heart", "😮": "face_with_open_mouth", "🤯": "exploding_head",
    "😲": "astonished_face", "😨": "fearful_face", "😰": "anxious_face_with_sweat",
    "😱": "face_screaming_in_fear", "🤢": "nauseated_face", "🤮": "face_vomiting",
    "🎊": "confetti_ball", "🌟": "glowing_star", "⭐": "star", "😂": "face_with_tears_of_joy",
    "🤣": "rolling_on_the_floor_laughing", "👍": "thumbs_up", "👎": "thumbs_down",
    "😁": "beaming_face_with_smiling_eyes", "😀": "grinning_face",
    "😃": "grinning_face_with_big_eyes", "😄": "grinning_face_with_smiling_eyes",
    "😅": "grinning_face_with_sweat", "😆": "grinning_squinting_face",
    "😉": "winking_face", "😎": "smiling_face_with_sunglasses", "😘": "face_blowing_a_kiss",
    "😔": "pensive_face", "😞": "disappointed_face", "😡": "enraged_face",
    "😠": "angry_face", "🤔": "thinking_face", "🙄": "face_with_rolling_eyes",
    "😴": "sleeping_face", "😇": "smiling_face_with_halo", "🤩": "star-struck",
    "🥳": "partying_face", "🥺": "pleading_face", "😳": "flushed_face", "🤗": "smiling_face_with_open_hands",
    "🙂": "slightly_smiling_face", "🙃": "upside-down_face", "💀": "skull",
    "💙": "blue_heart", "💚": "green_heart", "💛": "yellow_heart", "💜": "purple_heart",
    "🖤": "black_heart", "🧡": "orange_heart", "💖": "sparkling_heart", "💕": "two_hearts",
    "✨": "sparkles", "🚀": "rocket", "💡": "light_bulb", "🏆": "trophy", "🎯": "bullseye",
    "👌": "OK_hand", "🤝": "handshake", "✌": "victory_hand", "🤞": "crossed_fingers",
    "👋": "waving_hand", "👀": "eyes", "🌹": "rose", "🎂": "birthday_cake",
    "🎵": "musical_note", "🎶": "musical_notes", "⚡": "high_voltage", "❌": "cross_mark",
    "❓": "red_question_mark", "❗": "red_exclamation_mark", "👉": "backhand_index_pointing_right",
    "👇": "backhand_index_pointing_down", "📚": "books", "📌": "pushpin",
}
SKIN_TONES = {
    "🏻": "light_skin_tone", "🏼": "medium-light_skin_tone", "🏽": "medium_skin_tone",
    "🏾": "medium-dark_skin_tone", "🏿": "dark_skin_tone",
}


def terms(name: str) -> tuple[str, ...]:
    """The term list of that name."""
    return globals()[name]
