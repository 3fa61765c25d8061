import re

from costlens.llm import decontamination as D

ITEM = "Yesterday Anna bought 3 boxes and Anna sold 3 bags for 12 dollars each at the old market near the river"
ITEMS = [(1, ITEM), (2, "short item of five words"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10")]


def found(spark, *texts, items=ITEMS, exact=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r["_id"], r["item_id"], r["verbatim"]) for r in D.leaks(docs, bench, exact=exact).collect())


def test_verbatim_and_other_values(spark):
    assert found(
        spark,
        f"some words before. {ITEM} and behind",
        ITEM.replace("Anna", "Olga").replace("3 b", "7 b").replace("dollars", "euros"),
        ITEM.upper().replace(" ", "!! "),
        ITEM.replace("3 boxes", "7 boxes").replace("3 bags", "9 bags"),  # one value, two values
        "A short item, of five words.",
        "1 2 3 4 5 6 7 8 9 10",
        "nothing of the kind is written here at all, only other words that nobody asks about",
        None,
        "",
    ) == [(0, 1, True), (1, 1, False), (2, 1, True), (4, 2, True)]


def test_half_an_item_is_enough_and_less_is_not(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    items = [(1, " ".join(words))]
    assert found(spark, " ".join(words[:10]), " ".join(words[:9]), " ".join([*words[:9], "x", *words[11:]]), items=items) == [
        (0, 1, True),
        (2, 1, True),
    ]


def test_documents_against_brute_force(table, texts):
    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    truth = set()
    for r in table("benchmark").collect():
        own = " ".join(words(r.text))
        truth |= {(i, r.item_id) for i, t in texts.items() if own in " ".join(words(t))}
    leaks = D.leaks(table("documents"), table("benchmark")).collect()
    assert {(r["_id"], r["item_id"]) for r in leaks} == truth and len(leaks) == len(truth) > 10


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(odd, bench).count() == 0 and D.leaks(none, bench).count() == 0
    assert D.leaks(odd, bench.limit(0)).count() == 0
    both = D.leaks(odd, spark.createDataFrame([(1, "two words"), (1, "one")], "item_id long, text string"))
    assert both.count() == 0  # items of fewer tokens than are searched
    repeated = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM)], "doc_id long, text string")
    assert sorted(r["_id"] for r in D.leaks(repeated, bench).collect()) == [7, 2**63 - 1]


def test_exact_copies_of_any_item(spark):
    items = [(1, "1 2 3 4 5 6 7 8 9 10"), (2, "Anna Berta Clara"), (3, "x 3 km 4 km 5 km"), (4, "12"), (5, "..."), (6, None)]
    texts = ["so 1 2 3 4 5 6 7 8 9 10 it is", "with Anna Berta Clara", "x 3 km 4 km 5 km", "12", "1 2 3 4 5 6 7 9", "...", None]
    assert found(spark, *texts, items=items, exact=True) == [(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, True)]


def test_case_and_context_do_not_matter_word_for_word(spark):
    names = "Anna und Berta Huber mit Clara und Dora Maier nach Wien oder Emma Weber aus Graz"
    items = [(1, names), (2, "What is the capital of France?")]
    texts = [names.lower(), names.upper(), "well, What is the capital of France?", "What is the capital of Spain?"]
    assert {(d, i) for d, i, _ in found(spark, *texts, items=items, exact=True)} >= {(0, 1), (1, 1), (2, 2)}


def test_one_changed_value_of_two_equal_ones(spark):
    words = [f"{a}{b}{a}" for a in "bcdf" for b in "aeiouklmnprstvw"]
    item = " ".join([*words[:10], "3 boxes", *words[10:40], "3 bags", *words[40:]])
    assert found(spark, item.replace("3 bags", "4 bags"), items=[(1, item)], exact=True) == [(0, 1, True)]
    assert found(spark, item.replace("3 b", "4 b"), items=[(1, item)], exact=True) == [(0, 1, False)]
