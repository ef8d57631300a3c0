import re

from memlake.llm import licenses

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
CASES = {
    "Released under the MIT License.": "MIT",
    "words before.\nReleased%%% under*** the### MIT License.&&& more": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.": "Apache-2.0,CC-BY-NC-4.0",
    "A license to be dull. The MIT License was released under rain": "",
    "redistributions in binary form": "",
    "": "",
    None: "",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    MIT: "MIT",
    "x " * 60000 + "\nReleased under the MIT License.": "MIT",
}


def test_cases(spark):
    rows = [(i, t, "c") for i, t in enumerate(CASES)] + [(None, "Released under the MIT License.", "c"), (0, "Released under the MIT License.", "c")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, licenses string")).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: r.licenses for r in out}
    for i, (text, want) in enumerate(CASES.items()):
        assert found[i] == want, text


def test_order_matters(spark):
    first, second = "you may not use this file except in compliance with the license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."
    df = spark.createDataFrame([(0, f"{first}\n{second}"), (1, f"{second}\n{first}")], "doc_id bigint, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()} == {0: "Apache-2.0", 1: ""}


def test_every_known_sentence_has_a_cue_and_every_rule_known_sentences():
    cue = re.compile(licenses.CUE.replace("(?i)", ""), re.I)
    assert all(cue.search(s) and re.fullmatch("[a-z0-9 ]+", s) for _, s in licenses.SENTENCES)
    names = {n for n, _ in licenses.SENTENCES}
    assert all(set(ids) <= names for _, ids in licenses.RULES)


def test_bsd_hides_the_weaker_reading(spark):
    four = ". ".join(s for n, s in licenses.SENTENCES if n in ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"))
    df = spark.createDataFrame([(0, four)], "doc_id bigint, text string")
    assert licenses.scan_licenses(df).first().licenses == "BSD-3-Clause"


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
