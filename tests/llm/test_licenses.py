from evidlake.llm import licenses

FILES = "id long, path string, text string, score string"


def _scan(spark, rows):
    df = spark.createDataFrame(rows, FILES)
    return {r.id: r for r in licenses.scan(df, id_col="id").collect()}


def test_every_template_has_a_cue_and_finds_itself():
    m = licenses.Matcher()
    assert all(any(w in licenses.CUES for w in ws) for _, ws in m.templates)
    for i, (name, ws) in enumerate(m.templates):
        assert abs(m.cosine(ws, i) - 1) < 1e-12
        assert m.find("prose before, " + " ".join(ws) + " and prose after")[0] == (name, 1.0)


def test_a_notice_is_found_anywhere_and_over_comment_lines():
    m = licenses.Matcher()
    far = "word " * 50_000 + "\n# Licensed under the\n# Apache License,\n# Version 2.0.\n" + "word " * 10
    assert m.find(far) == [("Apache-2.0", 1.0)]
    assert m.find("licensed under cc by-nc 4.0") == [("CC-BY-NC-4.0", 1.0)]
    assert m.find("The licensed driver asked for permission to park.") == []
    assert [n for n, _ in m.find("Released under the MIT License. More. Licensed under CC BY 4.0.")] == ["MIT", "CC-BY-4.0"]


def test_cosine_against_a_dense_recomputation():
    import math

    m = licenses.Matcher()
    words = "licensed under the apache license version 3 today".split()
    vocab = sorted({w for _, ws in m.templates for w in ws} | set(words))
    n = len(m.templates)
    idf = [math.log((1 + n) / (1 + sum(w in ws for _, ws in m.templates))) + 1 if any(w in ws for _, ws in m.templates) else math.log(1 + n) + 1 for w in vocab]
    for i, (_, ws) in enumerate(m.templates):
        a, b = [words.count(w) * x for w, x in zip(vocab, idf, strict=True)], [ws.count(w) * x for w, x in zip(vocab, idf, strict=True)]
        dense = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        assert abs(m.cosine(words, i) - dense) < 1e-12


def test_nearest_folder_gives_the_licence(spark):
    got = _scan(
        spark,
        [
            (1, "a/LICENSE", "Released under the MIT License. " + "Some more words. " * 30, "x"),
            (2, "a/b/c/x.py", "print()", None),
            (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.", None),
            (4, "a/y.py", "", None),
            (5, "z/y.py", None, None),
            (6, "a/b/z.py", "# Licensed under CC BY 4.0.\ncode", None),
            (7, None, "print()", None),
            (8, "a/y.py", "", None),
            (9, "top.py", "x", None),
        ],
    )
    assert (got[1].license, got[1].origin) == ("MIT", "file")
    assert (got[2].license, got[2].origin, got[2].from_folder) == ("Apache-2.0", "inherited", "a/b")
    assert got[4].license == got[8].license == "MIT" and got[4].from_folder == "a"
    assert (got[5].license, got[5].origin) == (None, "none")
    assert (got[6].license, got[6].origin, got[6].score) == ("CC-BY-4.0", "header", 1.0)
    assert got[7].origin == got[9].origin == "none"


def test_a_licence_at_the_top_reaches_every_file(spark):
    got = _scan(spark, [(1, "COPYING", "This work is licensed under the GNU General Public License, version 3.", None), (2, "x/y/z", "q", None), (3, "w", "q", None)])
    assert {got[2].license, got[3].license} == {"GPL-3.0"} and got[2].from_folder == ""


def test_an_empty_table(spark):
    assert _scan(spark, []) == {}


def test_a_notice_that_reserves_all_rights_is_found_and_inherits_nothing(spark):
    m, name = licenses.Matcher(), licenses.RESERVED
    assert m.find("Copyright 2020 X. All rights reserved.") == [(name, 1.0)] and m.find("All rights of way are reserved here.") == []
    assert [n for n, _ in m.find("All rights reserved. Licensed under CC BY 4.0.")] == ["CC-BY-4.0", name]
    got = _scan(
        spark,
        [
            (1, "a/LICENSE", "Released under the MIT License.", None),
            (2, "a/x.py", "# (c) X. All rights reserved.\ncode", None),
            (3, "a/y.py", "code", None),
            (4, "a/b/LICENSE", "Copyright X. All rights reserved.", None),
            (5, "a/b/z.py", "code", None),
            (6, "a/only.txt", "All rights reserved.", None),
        ],
    )
    assert (got[2].license, got[2].origin, got[2].from_folder) == (name, "header", None)
    assert (got[3].license, got[3].origin) == ("MIT", "inherited")
    assert (got[4].license, got[4].origin) == (name, "file") and (got[5].license, got[5].from_folder) == (name, "a/b")
    assert (got[6].license, got[6].origin) == (name, "header")  # speaks for itself, not for its folder


def test_british_spelling_and_damaged_cues(spark):
    texts = {
        "MIT": "Released under the MIT Licence.",
        "CC-BY-4.0": "Licenced under CC BY 4.0.",
        "GPL-3.0": "This work is lisensed under the GNU General Public Licence, version 3.",
        "BSD-3-Clause": "Redistributoin and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Unlicense": "This is free and unencumberd software released into the public domain.",
    }
    got = _scan(spark, [(i, f"{i}/x", "prose " * 9 + t + " prose" * 9, None) for i, t in enumerate(texts.values())])
    assert [got[i].license for i in range(len(texts))] == list(texts)


def test_words_without_an_anchor_cannot_reach_the_threshold():
    m = licenses.Matcher()
    for i, (_, ws) in enumerate(m.templates):
        anchors = m.anchors(i)
        assert len(anchors) > 1 and anchors <= set(m.at)
        # the best of all texts without an anchor has the template's other words in their own proportion
        assert sum(x * x for w, x in m.vectors[i].items() if w not in anchors) ** 0.5 < licenses.THRESHOLD


def test_the_registered_query_over_the_whole_table(spark):
    import duckdb

    from evidlake.llm import queries

    sf = "/root/testdata/sf0.001"
    planted = {
        "GPL-3.0": "this work is licensed under the gnu general public license version 3",
        "CC-BY-NC-4.0": "licensed under cc by nc 4 0",
        "MIT": "released under the mit license",
        "Apache-2.0": "licensed under the apache license version 2 0",
        licenses.RESERVED: "all rights reserved",
    }
    docs = duckdb.sql(f"SELECT doc_id, source, lang, text FROM '{sf}/documents.parquet'").fetchall()
    own, given, paths = {}, {}, {}
    for i, source, lang, text in docs:
        plain = " " + "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").lower()) + " "
        plain = " ".join(plain.split())
        at = sorted((name == licenses.RESERVED, plain.find(words), name) for name, words in planted.items() if f" {words} " in f" {plain} ")
        own[i], paths[i] = [name for _, _, name in at], f"{source or 'unknown'}/{lang or 'unknown'}/{i}.txt"
        if at and plain == planted[at[0][2]] and not at[0][0]:
            given.setdefault(paths[i].rsplit("/", 1)[0], []).append((f"{i}.txt", at[0][2]))
    want = {}
    for i, path in paths.items():
        folder, found = path, (None, None)
        while not own[i] and found[0] is None and "/" in folder:
            folder = folder.rsplit("/", 1)[0]
            found = (min(given[folder])[1], folder) if folder in given else found
        want[i] = (own[i][0] if own[i] else found[0], ",".join(own[i]), found[1])
    got = {r.doc_id: (r.license, r.licenses, r.from_folder) for r in queries.op8_license_scan(spark, sf).collect()}
    assert got == want
    counts = {name: sum(name in r[1].split(",") for r in got.values()) for name in planted}
    lines = {name: sum(name in names for names in own.values()) for name in planted}
    assert counts == lines and counts[licenses.RESERVED] == 3 and sum(counts.values()) == 6  # this small table has no GPL notice
