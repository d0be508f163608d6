"""References of more languages than one block of them."""

import random

from plumbline.llm import quality


def test_every_language_has_a_reference(spark):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(120))
    rows = [(f"l{k:02}", text("abcdefghijklmnop")) for k in range(70) for _ in range(6)]
    rows += [("zz", text("абвгдежзийклмноп")) for _ in range(5)]  # the language with the fewest documents, in its own script
    rows += [("no", text("აბგდევზთიკლმნოპ")) for _ in range(4)]  # too few for a reference
    got = quality.judge_quality(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert {r.kept for r in got if r.lang == "zz"} == {True}
    assert {r.kept for r in got if r.lang.startswith("l")} == {True}
    assert {r.kept for r in got if r.lang == "no"} == {False}
