"""Questions with other numbers, names and units are found; texts that only look alike are not."""

import random
import re

import pyarrow.parquet as pq

from entiloom.llm import decontamination
from tests.llm.fixtures import words

ITEMS = [
    "Tom has 3 apples. Tom buys 4 more apples at the market and gives 2 of them to his sister. How many apples does Tom have in the end?",
    "Alice walked 5 km to the market. Bob walked 7 km to the same place by another road. How many km did Bob walk more than Alice?",
    "In the shop a lamp weighs 3.5 kg and a chair weighs 12 kg. Maria carries two lamps and one chair. How many kg does Maria carry?",
]


def found(spark, docs, items):
    rows = decontamination.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_names_that_open_sentences_and_units_anywhere(spark):
    docs = [
        ITEMS[0].replace("Tom", "Ann").replace("3", "8").replace("4", "9"),
        ITEMS[1].replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "15").replace("7", "17"),
        ITEMS[1].replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "15").replace("7", "17").replace("km", "miles"),
        words(30, 1) + ". " + ITEMS[2].replace("kg", "pounds").replace("Maria", "Ines").replace("two", "seven") + " " + words(30, 2),
        ITEMS[0].replace("apples at the market and gives", "pears in a shop, then hands").replace("How many apples does", "Say how many pears"),
        ITEMS[1].replace("Alice walked 5 km", "Carol walked 15 km").replace("than Alice", "than Eve").replace("did Bob", "did Dan"),  # two names for one, twice
        "Tom has 3 apples.",
    ]
    assert found(spark, docs, ITEMS) == {(0, 0), (1, 1), (2, 1), (3, 2)}


def other_words(text, plain, seed):
    """text with each name, number and unit replaced, equal ones alike."""
    r, new, number = random.Random(seed), {}, re.compile(r"\d+(?:[.,]\d+)*")

    def swap(m):
        w, low = m.group(), m.group().lower()
        if number.fullmatch(w) or low in decontamination.NUMBERS:
            return new.setdefault(low, str(r.randrange(100, 100_000)))
        if low in decontamination.UNITS:
            return new.setdefault(low, r.choice(decontamination.UNITS))
        if w[0].isupper() and len(w) > 1 and low not in plain:
            return new.setdefault(low, "".join(r.choice("aeioulnrst") for _ in range(7)).capitalize())
        return w

    return re.sub(r"\d+(?:[.,]\d+)*|[^\W\d_]+", swap, text)


def test_recall_on_rephrased_items(spark):
    items = [r["text"] for r in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()] + ITEMS
    plain = set(decontamination.both_ways(spark.createDataFrame([(t,) for t in items], "text string")))
    docs = [words(40, i) + ". " + other_words(t, plain, i) + " " + words(40, i + 999) for i, t in enumerate(items)]
    told = [len(re.findall(r"\w+", t)) >= decontamination.WIDTH for t in items]
    hits = found(spark, docs, items)
    share = sum((i, i) in hits for i, long in enumerate(told) if long) / sum(told)
    assert share >= 0.9 and len(hits) <= len(items) * 1.05, share
