import re

import pytest
from tests_sql import duck_rows

from sediment.llm import licenses
from sediment.llm.licenses import Automaton, fold, license_scan

TEXTS = [
    None, "", "---", "Released under the MIT License.", "released UNDER the\n terms, of the mit-license", "under the mit license under the MIT License",
    "Licensed under the Apache License, Version 2.0.", "apache license version 22", "Licensed under CC BY-NC 4.0.", "cc by nc", "cc by-nc-sa",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License as published by the Free Software Foundation, either version 2 or later",
    "licensed under the GNU General Public License, version 4", licenses.TEMPLATES["bsd-text"], "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "word " * 20000 + "under the MIT license " + "word " * 10, "under the mít license", "sublicensed under the mit license x",
]


def test_matches_sql(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, labels string")
    got = license_scan(spark, df)
    want = sorted(map(str, duck_rows(licenses.OP6_SQL, documents=(["doc_id", "text"], rows))))
    assert sorted(str(tuple(r[c] for c in sorted(got.columns))) for r in got.collect()) == want
    assert license_scan(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_automata_accept_what_their_pattern_does(name):
    a = Automaton(licenses.TEMPLATES[name])
    pattern = re.compile(" " + licenses._regex(licenses.parse(licenses.TEMPLATES[name])))
    full = [w for t in TEXTS if t for w in fold(t)][:60] + fold(licenses._MARK.sub(" ", licenses.TEMPLATES[name]))
    for words in [*(fold(t or "") for t in TEXTS[:-3]), full, full[3:], full[:-1], full[::-1]]:
        assert a.occurs(words) == bool(pattern.search(" " + "".join(w + " " for w in words)))


def test_markup():
    a = Automaton('all <<beginOptional>>of <<beginOptional>>the <<endOptional>><<endOptional>>rights <<var;name="x";min="0";max="2";match="[a-z]+">> reserved')
    for text, ok in [("all rights reserved", True), ("all of rights a b reserved", True), ("all of the rights reserved", True), ("all the rights reserved", False), ("all rights a b c reserved", False), ("all rights 1 reserved", False), ("all rights", False)]:
        assert a.occurs(text.split()) == ok, text
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<what>>a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            Automaton(bad)


def filled(name, **values):
    """A template as a text: every optional region in, replaceable ones by the given words."""
    text = re.sub("<<(begin|end)Optional>>", "", licenses.TEMPLATES[name])
    return re.sub('<<var;name="(.*?)".*?>>', lambda m: values[m[1]], text)


def test_whole_licenses_match_as_a_whole_or_not_at_all(spark):
    holders = dict(who="the authors or copyright holders", who2="the copyright holders and contributors", who3="the regents")
    rows, want = [], {}
    for name in ("mit-license", "isc-license", "bsd-license", "zlib-license"):
        words = filled(name, **holders).split()
        assert len(words) > 100
        for k, text in enumerate([words, words[:-1], words[:20] + ["not"] + words[20:], words[:20] + words[21:]]):
            rows.append((len(rows), f"Copyright (c) 2024 Someone\n\n{' '.join(text)}.\n\nint main"))
            want[len(rows) - 1] = name if k == 0 else None
    got = {r.doc_id: r.labels.split(",") for r in license_scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in want.items():
        assert [x for x in got[i] if x.endswith("-license")] == ([name] if name else [])
    sql = duck_rows(licenses.OP6_SQL, documents=(["doc_id", "text"], rows))
    assert [r[3].split(",") for r in sorted(sql, key=lambda r: r[1])] == [got[i] for i in sorted(got)]
