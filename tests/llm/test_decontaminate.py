"""Benchmark items that are dense in placeholders, shifted, or set in another case or place."""

import numpy as np

from activity_timeline.llm import decontaminate


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(3, 8))) for _ in range(n))


def found(spark, docs, bench):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"], r["kind"])
            for r in decontaminate.contaminated(d, b).collect()}


def test_items_of_few_plain_words(spark):
    rng = np.random.default_rng(11)
    # eight windows or more with few plain words, two with enough
    numbers = " ".join(f"{prose(rng, 1)} {i} {i + 1}/7 kg" for i in range(11, 23))
    long = f"{prose(rng, 5)} {numbers}"
    bench = ["What is 12 plus 30?", "Compute 12 + 7 * 3 - 5", long]
    docs = [f"{prose(rng, 20)}. {x} {prose(rng, 20)}" for x in bench]
    docs += [f"{prose(rng, 20)}. What is 12 plus 31? {prose(rng, 20)}",
             f"{prose(rng, 9)} {long.replace('14 15/7', '14 16/7')}"[:90]]
    assert found(spark, docs, bench) == {(0, 0, "verbatim"), (1, 1, "verbatim"),
                                         (2, 2, "verbatim")}


def test_items_of_too_few_words(spark):
    rng = np.random.default_rng(14)
    bench = ["yes", "Paris", "The", None, "", "one two three four", "one two three four five"]
    docs = ["The answer is yes, says Paris.", "one two three four " + prose(rng, 9),
            prose(rng, 9) + " one two three four five " + prose(rng, 9), None]
    assert found(spark, docs, bench) == {(2, 6, "verbatim")}
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    short = {r["item_id"]: r["n_tokens"] for r in decontaminate.short_items(b).collect()}
    assert short == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 4}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == {0, 1, 3}


def test_changes_of_length(spark):
    rng = np.random.default_rng(12)
    a, b = prose(rng, 9), prose(rng, 10)
    item = f"{a} Mary {b}"
    words = prose(rng, 60).split()
    often = list(words)
    for at in range(50, 0, -10):
        often.insert(at, "inserted")
    values = f"{prose(rng, 7)} 1000 {prose(rng, 7)} 5 kg {prose(rng, 6)}"
    docs = [f"{prose(rng, 20)} {item.replace('Mary', 'Mary Ann')} {prose(rng, 20)}",
            f"{prose(rng, 20)} {' '.join(often)} {prose(rng, 20)}",
            values.replace("5 kg", "5kg"), values.replace("1000", "1 000")]
    assert found(spark, docs, [item, " ".join(words), values]) == {
        (0, 0, "reparameterised"), (1, 1, "verbatim"), (2, 2, "verbatim"),
        (3, 2, "reparameterised")}
    # values that contradict each other on near diagonals are no match
    twice = f"{prose(rng, 3)} 12 {prose(rng, 3)} 12 {prose(rng, 3)} 12 {prose(rng, 3)}"
    first, second, third, last = twice.split(" 12 ")
    assert found(spark, [f"{first} 40 {second} put 41 {third} 42 {last}"], [twice]) == set()


def test_names_by_place_and_case(spark):
    rng = np.random.default_rng(13)
    short = "Bcdef ag bed cab face dab"
    names = " ".join(f"{prose(rng, 1)} Anna {prose(rng, 1)} Robert" for _ in range(8))
    other = names.replace("Anna", "Berta").replace("Robert", "Carl")
    wrapped = f"{prose(rng, 4)} Mary has 12 {prose(rng, 5)}"
    docs = [f"a heading without a stop\n{short}\n{prose(rng, 20)}", f"{prose(rng, 20)} {short}",
            names.lower(), names.upper(), f"{prose(rng, 20)} {other}",
            wrapped.replace("Mary has 12", "\nJoan has 40")]
    assert found(spark, docs, [short, names, wrapped]) == {
        (0, 0, "verbatim"), (1, 0, "verbatim"), (2, 1, "verbatim"), (3, 1, "verbatim"),
        (4, 1, "reparameterised"), (5, 2, "reparameterised")}
