from __future__ import annotations

import json
import textwrap

import pytest
import zstandard

from alphaspark.llm.license_scan import TEMPLATES, Scanner, scan_licenses, words_of

from .helpers import docs_of, rows_of

MIT = TEMPLATES["MIT"].split("\n")[1]


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), (MIT, "MIT"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ],
)
def test_the_right_template_wins(line, name):
    found = Scanner(TEMPLATES, 0.8).best(line)
    assert found and found[0] == name and found[2] < found[1] and found[6:] == ([], [])


@pytest.mark.parametrize("line", ["My driving license expired and I walked home in the rain.", "All copyright questions go to the big library downtown", "licen"])
def test_other_uses_of_the_words_dont(line):
    assert Scanner(TEMPLATES, 0.8).best(line) is None


def test_blocks_and_differences(spark):
    texts = [f"prose here\n\n{MIT.replace('free of charge', 'without charge')}\nmore prose about other things", "Plain words.\nReleased under the MIT License.\nPlain words again.", "nothing", f"{TEMPLATES['Apache-2.0']}"]
    got = {r["doc_id"]: r for r in scan_licenses(docs_of(spark, texts)).collect()}
    assert set(got) == {0, 1, 3}
    assert (got[0]["license"], got[0]["exact"], got[0]["first_line"], got[0]["last_line"]) == ("MIT", False, 2, 2)
    assert json.loads(got[0]["differences"]) == {"missing": ["free", "of"], "added": ["without"]}
    assert (got[1]["exact"], got[1]["first_line"], got[1]["block"]) == (True, 1, "Released under the MIT License.")
    assert (got[3]["license"], got[3]["first_line"], got[3]["last_line"]) == ("Apache-2.0", 0, 2)


def test_odd_rows(spark):
    line = "Released under the MIT License."
    df = docs_of(spark, [line, line, None, "", line, "x\n" * 100_000 + line], ids=[1, 1, 2, 3, None, 5]).withColumnRenamed("lang", "license")
    assert rows_of(scan_licenses(df), "doc_id", "license") == sorted([(1, "MIT"), (1, "MIT"), (None, "MIT"), (5, "MIT")], key=repr)
    assert scan_licenses(docs_of(spark, [])).count() == 0
    assert rows_of(scan_licenses(df, {"Mine": "Released under the MIT License."}), "license") == [("Mine",)] * 4


def test_all_license_lines_of_the_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    lines = ("Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.")
    want = sorted((r["doc_id"], i) for r in docs.collect() for i, x in enumerate(r["text"].split("\n")) if x in lines)
    assert sorted((r["doc_id"], r["first_line"]) for r in scan_licenses(docs).collect()) == want and want


def found(text):
    scanner = Scanner(TEMPLATES, 0.8)
    return [(h[2], text[a:b][h[0] : h[1]]) for a, b in scanner.blocks(text) for h in scanner.stretches(text[a:b])]


def test_a_part_of_a_block_is_enough():
    prose = "We went home early and talked about many other things that evening. "
    assert found("Copyright (c) 2024 Jane Doe\nLicensed under the MIT License.") == [("MIT", "Licensed under the MIT License.")]
    assert found("// SPDX-License-Identifier: MIT\n// Copyright 2020 Foo") == [("MIT", "SPDX-License-Identifier: MIT")]
    assert found(prose * 3 + "It is licensed under the Apache License, Version 2.0. " + prose * 3)[0][0] == "Apache-2.0"
    assert [n for n, _ in found("word " * 3000 + "licensed under the MIT license " + "word " * 3000)] == ["MIT"]
    assert [n for n, _ in found("Licensed under CC BY 4.0.\nReleased under the MIT License.")] == ["CC-BY-4.0", "MIT"]
    assert [n for n, _ in found("Copyright 2021 X\n" + MIT + "\n\n" + prose)] == ["MIT"]
    assert found("The MIT library was copyright deposit for years.") == []


GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (GNU.format("General", "2"), ["GPL-2.0"]), (GNU.format("General", "3"), ["GPL-3.0"]), (GNU.format("Affero General", "3"), ["AGPL-3.0"]), (GNU.format("Lesser General", "2.1"), ["LGPL-2.1"]), (GNU.format("Lesser General", "3"), ["LGPL-3.0"]),
        (TEMPLATES["BSD-2-Clause"].split("\n", 1)[1], ["BSD-2-Clause"]), (TEMPLATES["BSD-3-Clause"].split("\n", 1)[1], ["BSD-3-Clause"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY 5.0.", []), ("Licensed under the GNU General Public License, version 4.", []),
        (TEMPLATES["ISC"].split("\n", 1)[1], ["ISC"]), (TEMPLATES["Unlicense"].split("\n", 1)[1], ["Unlicense"]), ("SPDX-License-Identifier: EPL-2.0", ["EPL-2.0"]), ("SPDX-License-Identifier: LGPL-2.1+", ["LGPL-2.1"]),
        ("Licensed under the Simplified BSD License.", ["BSD-2-Clause"]),
    ],
)
def test_distinguishing_words_decide(text, names):
    assert [n for n, _ in found(text)] == names


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_notice_is_its_own(name):
    assert {n for n, _ in found(TEMPLATES[name])} == {name}


def paragraphs(name: str, width: int) -> str:
    return "\n\n".join(textwrap.fill(p, width) for p in ["Copyright (c) 2024 Jane Doe", *TEMPLATES[name].split("\n")[1:]])


@pytest.mark.parametrize("name", ["MIT", "ISC", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", "EPL-2.0", "Zlib", "Apache-2.0"])
@pytest.mark.parametrize("width", [10**6, 78, 60])
def test_whole_texts_however_they_are_wrapped(name, width):
    """One stretch over blank lines and line ends, with all or nearly all words of the text."""
    text = paragraphs(name, width)
    for shown in (text, text.replace("\n\n", "\n"), text.replace("\n\n", " ")):
        hits = found(f"Plain prose before it all.\n\n{shown}\n\nPlain prose behind it all, about walks and weather.")
        assert [n for n, _ in hits] == [name] and len(words_of(hits[0][1])) >= 0.85 * len(words_of("\n".join(TEMPLATES[name].split("\n")[1:])))


def test_both_licenses_of_an_expression():
    assert [n for n, _ in found("SPDX-License-Identifier: MIT OR Apache-2.0")] == ["MIT", "Apache-2.0"]


def test_the_ranking_against_every_template(spark, sf_small):
    """Sizes of each stretch found in the corpus, compressed with every template by calls of one's own."""
    docs = spark.read.parquet(f"{sf_small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    own = docs_of(spark, [paragraphs(n, 78) for n in sorted(TEMPLATES)], ids=list(range(-len(TEMPLATES), 0)))
    hits = scan_licenses(docs.select("doc_id", "text").union(own.select("doc_id", "text"))).collect()
    sizes: dict[str, dict[str, int]] = {}
    for r in hits:
        text = r["block"]
        if text not in sizes:
            plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False).compress(text.encode())
            dictionary = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[text] = {n: len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, dict_data=dictionary(t)).compress(text.encode())) for n, t in TEMPLATES.items()} | {"": len(plain)}
        every = sizes[text]
        others = {n: s for n, s in every.items() if n not in ("", r["license"])}
        assert (r["plain_size"], r["primed_size"], r["runner_up_size"]) == (every[""], every[r["license"]], min(others.values()))
        assert every[r["license"]] <= min(others.values()) + 4 and r["primed_size"] < r["plain_size"]
    assert len(sizes) > 20
