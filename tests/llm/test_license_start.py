"""Licenses named by the first words of a text."""

from plumbline.llm import licenses


def test_texts_that_open_with_the_name(spark):
    names = {"gpl-3.0": "GNU General Public License version 3", "apache-2.0": "Apache License Version 2.0"}
    rows = [(label, name + " and so on") for label, name in names.items()] + [(label, f"some words before the {name}") for label, name in names.items()]
    rows += [("", "License version 2.0"), ("", "public license version 3")]  # key phrase not whole
    filler = [("", "a page licensed under the terms of its river")] * 40
    found = licenses.scan_licenses(spark.createDataFrame(rows + filler, "want string, text string")).collect()
    for r in found:
        own = [m for m in r.license_matches if not m.base]
        assert [m.label for m in own] == ([r.want] if r.want else []), r.text
        if own and not r.text.startswith("some"):
            assert own[0].start == 0 and own[0].share < 1
