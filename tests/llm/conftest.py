import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, taken string, "
          "spans string, key long, id long, label string, size string, score string")


def prose(seed: int, n: int) -> str:
    """Words that hardly recur: a text of its own for each seed."""
    out, state = [], seed * 2654435761 % 2**32 + 1
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("abcdefghijklmnopqrstuvwxyz"[state % 26] + format(state >> 5, "x").translate(
            str.maketrans("0123456789", "ghijklmnop")))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs everywhere, empty, blank and very long texts, repeated rows, and columns
    named like those the operators add."""
    extra = ("no", "no", "no", 1, 2, "no", "no", "no")
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n", "xx", "b", 3),
        (4, prose(4, 60), "en", "a", 9), (4, prose(4, 60), "en", "a", 9), (5, prose(5, 30_000), "fr", None, 1),
        (None, prose(6, 40), "de", "b", 1), (7, prose(4, 60), "en", "b", 1), (8, "\x00 é 😀 İ", "es", "", 5),
        (9, None, None, None, None),
    ]
    return spark.createDataFrame([r + extra for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
