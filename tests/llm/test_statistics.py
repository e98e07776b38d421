"""The statistics of the quality classifier against plain counting, value by value."""

import math
from collections import Counter
from statistics import fmean, pstdev

import pytest

from entiloom.llm.quality_kernel import STATS, statistics

TEXTS = [
    "", " \n\t", "One two Three. FOUR five!\nOne two Three. FOUR five!\n\n a|b {x}; 3rd #tag# é ü 漢字\r\n", "x", "A" * 3000 + " 9",
    "the cat sat on the mat the cat sat on the rug\n" * 50, "$$$ *** <b> | & % ~ ^ @\x0b\x0c\x00", "no break. At all? None! " * 7,
]


def plain(text: str) -> dict[str, float]:
    raw, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, types, bytes_ = len(words), Counter(text.split()), Counter(raw)
    sizes, long = [len(w) for w in words] or [0], [len(x) for x in lines] or [0]
    of = lambda test: sum(1 for b in raw if test(b)) / max(1, len(raw))
    kinds = {
        "upper": of(lambda b: chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": of(lambda b: chr(b) in "abcdefghijklmnopqrstuvwxyz"), "digit": of(lambda b: chr(b) in "0123456789"),
        "symbol": of(lambda b: chr(b) in "#*$%&|<>"), "mark": of(lambda b: chr(b) in ".,;:!?'\"-()"), "beyond_ascii": of(lambda b: b > 127), "blank": of(lambda b: chr(b) in " \t\r\v\f"), "breaks": of(lambda b: b == 10),
    }
    rate = lambda chars: sum(bytes_[ord(c)] for c in chars) / max(1, n)
    among = lambda test: sum(1 for w in types if test(w)) / max(1, len(types))
    return kinds | {
        "other_ascii": 1 - sum(kinds.values()) if raw else 0.0, "chars": math.log1p(len(text)), "words": math.log1p(n), "word_mean": fmean(sizes), "word_sd": pstdev(sizes), "word_longest": math.log1p(max(sizes)),
        "kinds": len(types) / max(1, n), "top_word": max(types.values(), default=0) / max(1, n), "new_triples": len({tuple(words[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2),
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "line_mean": math.log1p(fmean(long)), "line_sd": math.log1p(pstdev(long)),
        "capital_words": among(lambda w: w[0].isupper()), "shouted_words": among(lambda w: len(w) > 1 and w.isupper()), "symbol_words": among(lambda w: w[-1] in "#*$%&|<>!"), "digit_words": among(lambda w: w[0].isdigit()),
        "entropy": -sum(c / len(raw) * math.log2(c / len(raw)) for c in bytes_.values()), "sentence_ends": rate(".!?"), "bangs": rate("!"), "pipes": rate("|"), "braces": rate("{};"),
    }


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_equal_plain_counts(text):
    want, got = plain(text), statistics(text)
    assert len(got) == len(STATS) and set(want) == set(STATS)
    for name, x in zip(STATS, got, strict=True):
        assert x == pytest.approx(want[name], abs=1e-9), name
