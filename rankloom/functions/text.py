"""Text functions."""

from pyspark.sql import functions as F

# Fixed value: the characters that Python's ``str.split()`` takes as space, which
# are Unicode's white space and four control characters.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def tokenize(text):
    """Whitespace tokens, case kept, none of them empty; null text gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def result_line(rank, title, body):
    """``"{rank}. {title}\\n{body}"``; a null prints as an empty string."""
    empty = F.lit("")
    return F.format_string("%d. %s\n%s", rank, F.coalesce(title, empty), F.coalesce(body, empty))


def fixed_point(value, places):
    """Fixed-point text such as ``0.12345``."""
    return F.format_string(f"%.{places}f", value)
