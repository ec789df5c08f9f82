import pytest

from gradewright.llm import licences as lic


def brute(text):
    import re
    if text is None:
        return None, 0.0, 0, ""
    cuts = ["\n", "\n[ \t\r]*\n", "[.!?][ \t\r\n]+", "[.!?,;:]+[ \t\r\n]+|\n"]
    blocks = {" ".join(lic.words_of(b)) for b in [text, *(b for c in cuts for b in re.split(c, text))]}
    hits, matched = [], set()
    for b in blocks:
        g = lic.bigrams_of(b)
        for name, _, t in lic.TEMPLATES:
            other = lic.bigrams_of(t)
            if g and (d := 2 * len(set(g) & set(other)) / (len(g) + len(other))) >= lic.THRESHOLD:
                hits.append((-d, name))
                matched.add(b)
    best = min(hits, default=(0.0, None))
    return best[1], -best[0] or 0.0, len(matched), ",".join(sorted({n for _, n in hits}))


TEXTS = ["Some words.\nReleased under the MIT License.\nmore", "released UNDER the mit licence!", "All rights reserved.",
         "Licensed under the Apache License, Version 2.0.\n\nLicensed under CC BY-NC 4.0.", None, "", "license", "a license b",
         "This work is licensed under the GNU General Public License, version 3 .\nThis work is licensed under the GNU General Public License, version 3 .",
         "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files\n\nx",
         "\n".join(t for _, _, t in lic.TEMPLATES), "word " * 50_000 + "\nAll rights  reserved", "all rights reserved to us and all others"]
TEXTS += [t.replace("the", "a") for _, _, t in lic.TEMPLATES] + [t[:len(t) * 5 // 6] for _, _, t in lic.TEMPLATES]


def test_matches_brute_force_without_pruning(rows):
    got = lic.scan(rows(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for r in got:
        want = brute(r.text)
        assert (r.licence, r.n_blocks, r.licences) == (want[0], want[2], want[3]), r.text
        assert abs(r.dice - want[1]) < 1e-12


@pytest.mark.parametrize("text, licence", [
    ("Copyright 2024 Example Ltd. All rights reserved.", "Proprietary"),
    ("Source code here. Released under the MIT License.", "MIT"),
    ("This is free software. Released under the MIT License. See the file for more.", "MIT"),
    ("Text by Jane, licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Notes: Licensed under the Apache\nLicense, Version 2.0. Have fun!", "Apache-2.0"),
    ("We held all rights reserved by the town, and the licence was under review.", None)])
def test_notices_beside_other_words(rows, text, licence):
    long = "Some prose here, and more of it. " * 400
    docs = rows([(1, text), (2, long + text + " " + long)], "doc_id long, text string")
    assert [r.licence for r in lic.scan(docs).collect()] == [licence] * 2


def test_anchors_are_needed():
    for _, _, t in lic.TEMPLATES:
        grams, words = lic.bigrams_of(t), lic.anchors(t)
        left = [g for g in grams if not set(g.split()) & words]
        assert words and len(left) < lic.needed(len(grams))


def test_edges(rows):
    assert lic.scan(rows([], "doc_id long, text string")).count() == 0
    got = lic.scan(rows([(1, "All rights reserved.", 3, "q"), (1, "All rights reserved.", 3, "q")],
                        "doc_id long, text string, dice int, words string")).collect()
    assert [(r.licence, r.licence_kind, r.dice, r.words) for r in got] == [("Proprietary", "reserved", 1.0, "q")] * 2


def test_no_python_on_the_path(rows):
    plan = lic.scan(rows([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
