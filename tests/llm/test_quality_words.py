import math

from forgeline.llm import quality


def test_share_of_the_most_frequent_word_counts_all_words():
    for n in (8, 112, 230):
        text = " ".join("|" if i % 2 else f"w{i}" for i in range(n))
        assert quality.statistics(text)[quality.STATISTICS.index("one_word_share")] == math.log(1e-3 + 0.5)
