import random

import pytest

from priceboard.llm import decontamination as dc

ITEM = "A train leaves for Paris at 40 km and then goes on for 40 km until it meets Anna who waits with 7 apples near the old stone bridge"
OTHER = "short one with six words"


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, ITEM)], "item_id long, text string")


def found(spark, make, rows):
    got = dc.contamination(make(rows), bench(spark)).collect()
    return {(r["id"], r["item"]): r for r in got}


def test_copies_and_new_values(spark, make, prose):
    rng = random.Random(6)
    pad = prose(rng, 60)
    other = ITEM.replace("Paris", "Berlin").replace("40", "55").replace("Anna", "Clara").replace("7", "9")
    mixed = ITEM.replace("40 km and", "55 km and")  # one value in two ways
    rows = [(1, f"{pad} {ITEM} {pad}"), (2, f"{pad}\n{other}"), (3, mixed.replace("Paris", "Rome").replace("7 apples", "8 apples").replace("Anna", "Dora")), (4, pad), (5, None), (6, ""), (7, f"x\n{OTHER}\ny"), (1, f"{pad} {ITEM} {pad}")]
    got = found(spark, make, rows)
    assert got[1, 1]["verbatim"] and got[1, 5]["verbatim"] and got[2, 1]["changed"] == 5 and not got[2, 1]["verbatim"]
    assert (3, 1) not in got and (7, 2) in got
    assert {k[0] for k in got} == {1, 2, 7}
    kept = dc.decontaminate(make(rows), bench(spark))
    assert kept.columns == make([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]


def test_empty_tables(spark, make):
    assert found(spark, make, []) == {}
    none = bench(spark).filter("false")
    assert dc.contamination(make([(1, ITEM)]), none).collect() == []


def test_a_full_bitmap_loses_nothing(spark, make, monkeypatch):
    monkeypatch.setattr(dc, "BITS", 8)
    assert (1, 1) in found(spark, make, [(1, ITEM)])


def test_copies_rich_in_numbers_and_names(spark, make):
    items = ["List primes: 2, 3, 5, 7, 11, 13, 17, 19", "What is 12 + 35?", "They met Anna Bob Clara Dora Emil in the old town"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(10 + i, f"so then {x}\nand on") for i, x in enumerate(items)] + [(20, "List primes: 2, 3, 5, 7, 11, 13, 17, 23"), (21, "What is 12 + 36?")]
    got = {(r["id"], r["item"]): r for r in dc.contamination(make(rows), table).collect()}
    assert set(got) == {(10, 0), (11, 1), (12, 2)} and all(r["verbatim"] for r in got.values())


def words(text):
    return [w.strip(".,;:!?\"'()[]{}<>").lower() or w for w in text.split()]


def test_copies_against_brute_force(spark, make, prose):
    """Every item of any length that stands in a document word for word is found, and no pair without a long common run."""
    rng = random.Random(12)
    items = ["Is 3 kg plus 5 kg equal 8 kg", "What is 3 plus 5", "Why ask Anna Bob Clara", "Paris", "12 13 14", "Name two", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    items += [prose(rng, n) for n in (1, 3, 4, 5, 7, 8, 9, 12, 13, 20, 60)]
    docs = []
    for i, x in enumerate(items):
        docs.append((2 * i, f"{prose(rng, rng.randint(0, 40))}\n{x}\n{prose(rng, rng.randint(0, 40))}"))
        docs.append((2 * i + 1, prose(rng, 50)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["id"], r["item"]) for r in dc.contamination(make(docs), table).collect()}
    assert {(2 * i, i) for i in range(len(items))} <= got
    for d, i in got:
        doc, item = words(docs[d][1]), words(items[i])
        n = min(len(item), 8)
        runs = {tuple(doc[k : k + n]) for k in range(len(doc) - n + 1)}
        assert runs & {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}, (d, i)


def test_short_items_only_as_lines(spark, make):
    table = spark.createDataFrame([(1, "Name two")], "item_id long, text string")
    got = dc.contamination(make([(1, "x\nname two\ny"), (2, "please name two of them"), (3, "Name two")]), table).collect()
    assert sorted(r["id"] for r in got) == [1, 3]


def test_names_of_other_lengths_and_units(spark, make, prose):
    """Asked again with a name of two words, a first word that is a name, and a unit written apart."""
    a = "Anna walks 5km to the market in Leeds and then buys some apples that she carries back to her house"
    b = "Clara walks 7 km to the market in New York and then buys some apples that she carries back to her house"
    c = "Clara walks 7 km to the market in Clara and then buys some apples that she carries back to her house"
    rows = [(1, prose(random.Random(3), 30) + "\n" + b), (2, c)]
    table = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = {r["id"]: r for r in dc.contamination(make(rows), table).collect()}
    assert got[1]["changed"] == 3 and not got[1]["verbatim"] and got[1]["covered"] == got[1]["item_words"]
    # two names of the item became one: only what is beside the slots may count
    assert 2 not in got or got[2]["covered"] < got[1]["covered"]


def test_long_text_ties_and_clashing_columns(spark, prose):
    rng = random.Random(4)
    pad = prose(rng, 60_000)
    docs = spark.createDataFrame([(1, f"{pad}\n{ITEM}\n{ITEM}", 1, "a", 2)], "doc_id long, text string, h int, item string, __key int")
    got = dc.contamination(docs, bench(spark)).collect()
    assert sorted(r["item"] for r in got) == [1, 5] and all(r["verbatim"] for r in got)
    assert dc.decontaminate(docs, bench(spark)).columns == docs.columns and dc.decontaminate(docs, bench(spark)).collect() == []


ASKED = [
    "{W} many apples does {A} have after buying {n} bags of {m} apples each today",
    "{W} {A} has {n} cows and {m} sheep and then buys {k} more animals at the market how many are there",
    "{W} train leaves {A} station at {n} km per hour and meets {B} after {m} hours on the line",
    "{W} boxes hold {n} red balls and {m} blue balls so what is the chance that {A} draws {k} red ones",
    "{W} old is {A} if {B} is {n} years older and both together are {m} years of age",
]
NAMES = ["Anna", "Maria", "Peter", "Olga", "Tom", "Ivan", "Lucia", "Karl"]
FIRST = ["how", "why", "when", "what", "tell"]
COUNTS = ["two", "three", "five", "seven", "12", "30", "7", "4", "19", "eleven"]


def _asked(rng, layout, first, capital, topic, distinct=False):
    a, b = rng.sample(NAMES, 2)
    n, m, k = rng.sample(COUNTS, 3) if distinct else rng.choices(COUNTS, k=3)
    w = first.capitalize() if capital else first
    return layout.format(W=w, A=a, B=b, n=n, m=m, k=k) + f" {topic}"


def test_two_hundred_questions_asked_again(spark, make, prose):
    """With other names and numbers (digits or words, equal by chance too), and with the first word inside a sentence or at its beginning."""
    rng = random.Random(8)
    items, docs, want = [], [], set()
    for i in range(200):
        layout, first = ASKED[i % 5], FIRST[i // 5 % 5]
        topic = "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) + f" {'xyz'[i % 3]}q{chr(97 + i % 26)}{chr(97 + i // 26)} end"
        items.append((f"i{i}", _asked(rng, layout, first, rng.random() < 0.5, topic, True)))
        again = _asked(rng, layout, first, rng.random() < 0.5, topic)
        docs.append((i, f"{prose(rng, 30)} so then {again} and {prose(rng, 30)}" if again[0].islower() else f"{prose(rng, 30)}. {again}. {prose(rng, 30)}"))
        want.add((i, f"i{i}"))
    docs += [(1000 + i, prose(rng, 80)) for i in range(50)]
    got = {(r["id"], r["item"]) for r in dc.contamination(make(docs), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(got & want) >= 190 and not {d for d, _ in got if d >= 1000}
    # another item of the same layout shares all but its last words; none of a different layout may be found
    assert all(int(x[1:]) % 5 == d % 5 for d, x in got)


@pytest.mark.parametrize("item, doc", [
    ("How many apples does Anna have after buying 3 bags today", "how many apples does Maria have after buying 7 bags today"),
    ("how many apples does Anna have after buying 3 bags today", "How many apples does Maria have after buying 7 bags today"),
    ("There are 3 cows and 5 sheep on the farm and the man buys 4 more of them", "There are 6 cows and 6 sheep on the farm and the man buys 2 more of them"),
    ("A box has three red balls and it also has five blue balls and no green one", "a box has nine red balls and it also has 4 blue balls and no green one"),
])
def test_reported_losses(spark, make, item, doc):
    got = dc.contamination(make([(1, f"we ask {doc} now"), (2, doc), (3, "nothing of it is here at all")]), spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert {r["id"] for r in got.collect()} == {1, 2}


def test_values_must_not_part(spark, make):
    """One value of the item may not become two in the document."""
    item = "Anna gives 5 pears to Peter and then Anna takes 5 more pears from the old box of wood"
    docs = [(1, "Olga gives 7 pears to Karl and then Olga takes 7 more pears from the old box of wood"), (2, "Olga gives 7 pears to Karl and then Ivan takes 9 more pears from the old box of wood")]
    got = dc.contamination(make(docs), spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert {r["id"] for r in got.collect()} == {1}
