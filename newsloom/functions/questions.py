"""Column expressions over question text."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import letter_class, strip

# The question types, the fallback type and the phrases that set a time window.
QUESTION_TYPES = ("sports_news", "sports_wiki", "off_topic")
DEFAULT_TYPE = "sports_news"
MONTH_PHRASES, MONTH_HOURS = "tháng này|trong tháng", 720
WEEK_PHRASES, WEEK_HOURS = "tuần này|trong tuần|7 ngày", 168
DAY_PHRASES, DAY_HOURS = "hôm nay|trong ngày", 24
DEFAULT_HOURS = 12
# More hours than any date lies back: what a number beyond int stands for.
ALL_HOURS = 2**31 - 1

# Letters that mark a text as Vietnamese.
VIETNAMESE_LETTERS = (
    "àáảãạăắằẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"
)

# The refusal shown for off-topic questions.
DECLINE_VI = (
    "Xin lỗi, tôi là trợ lý tin tức thể thao và chỉ có thể hỗ trợ các câu hỏi "
    "liên quan đến thể thao. Vui lòng hỏi về tin tức thể thao, cầu thủ, đội bóng, "
    "hoặc các giải đấu!"
)
DECLINE_EN = (
    "Sorry, I'm a sports news assistant and can only help with sports-related "
    "questions. Please ask about sports news, players, teams, or tournaments!"
)


def time_preference(question: Column) -> Column:
    """Hours the question wants to look back; the first matching phrase decides. A
    number that does not fit an int asks for everything."""
    q = F.lower(question)

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))

    asked = F.coalesce(number(r"(?U)trong\s*([0-9]+)\s*giờ"), number(r"(?U)([0-9]+)\s*h\b"))
    hours = F.coalesce(
        asked.try_cast("int"), F.when(asked.isNotNull(), ALL_HOURS), F.lit(DEFAULT_HOURS))
    return (
        F.when(q.rlike(MONTH_PHRASES), MONTH_HOURS)
        .when(q.rlike(WEEK_PHRASES), WEEK_HOURS)
        .when(q.rlike(DAY_PHRASES), DAY_HOURS)
        .otherwise(hours)
    )


def extract_feed_url(question: Column) -> Column:
    """The first ``.rss`` address in the question, else NULL."""
    return F.nullif(F.regexp_extract(question, r"(?iU)https?://\S+\.rss\b", 0), F.lit(""))


def detect_language(
    text: Column,
    letters: dict[str, str] | None = None,
    default: str = "en",
) -> Column:
    """The first language in ``letters`` (language -> its marking letters) with a letter in the
    text, any case; else ``default``."""
    letters = letters or {"vi": VIETNAMESE_LETTERS}
    found = F.lit(None).cast("string")
    for lang, marks in reversed(letters.items()):
        found = F.when(text.rlike(letter_class(marks)), F.lit(lang)).otherwise(found)
    return F.coalesce(found, F.lit(default))


def language_candidates(lang: Column, default: str = "en") -> Column:
    """Languages to try in order: the detected one, then the default."""
    return F.array_distinct(F.array(lang, F.lit(default)))


def validate_label(label: Column) -> Column:
    """A model's label, stripped and lower-cased; anything outside the domain is the default."""
    clean = F.lower(strip(label))
    return F.when(clean.isin(*QUESTION_TYPES), clean).otherwise(F.lit(DEFAULT_TYPE))


def classify_rules(
    question: Column, rules: Sequence[tuple[str, str]], default: str = DEFAULT_TYPE
) -> Column:
    """Label of the first (label, regular expression) rule that matches the question."""
    found = F.lit(default)
    for label, pattern in reversed(rules):
        found = F.when(question.rlike(pattern), F.lit(label)).otherwise(found)
    return validate_label(found)


def decline_text(question: Column) -> Column:
    return F.when(detect_language(question) == "vi", F.lit(DECLINE_VI)).otherwise(F.lit(DECLINE_EN))
