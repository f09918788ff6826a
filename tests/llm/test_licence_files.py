"""Whole licence texts are licence files, and wrapped notices are found."""

from importlib import resources

from strikelab.llm import licenses

HEADER = """# Copyright 2020 Somebody
#
# Licensed under the Apache
# License, Version 2.0 (the "License");
# you may not use this file
# except in compliance
# with the License.

"""


def test_whole_texts(spark):
    at = resources.files(licenses.__package__).joinpath("licence_texts")
    texts = {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in at.iterdir()}
    rows = []
    for i, (name, text) in enumerate(sorted(texts.items())):
        rows += [(i, f"{name}/LICENSE", "Copyright (c) 2021 Jane Doe and others\n\n" + text), (100 + i, f"{name}/src/a.py", "print(1)\nno notice here")]
    rows += [(200, "b.py", HEADER + "import os\n" * 20 + "\n".join(f"value{i} = function{i}(a{i}, b{i})" for i in range(40))), (201, "c.md", "The MIT licence and the GNU General Public License are well known\n" * 3)]
    got = {r["doc_id"]: r for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(sorted(texts)):
        assert (got[i]["own_licence"], got[i]["is_licence_file"]) == (name, True)
        assert (got[100 + i]["licence"], got[100 + i]["licence_from"]) == (name, name)
    assert (got[200]["own_licence"], got[200]["is_licence_file"]) == ("Apache-2.0", False)
    assert not got[201]["is_licence_file"]


def test_wrapped_notice_alone_is_a_file(spark):
    rows = [(1, "x/COPYING", HEADER), (2, "x/y/a.py", "nothing")]
    got = {r["doc_id"]: r for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1]["is_licence_file"] and got[2]["licence"] == "Apache-2.0"
