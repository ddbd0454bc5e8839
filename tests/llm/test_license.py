import re

from quarry.llm.license_scan import PHRASES, Automaton, license_scan

from . import frames


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_automaton():
    a = Automaton("grant <<opt>> of <<opt>> any <</opt>> use <</opt>> to <<var:2>> you")
    run = lambda t: a.run(t.encode().split(), 0)
    assert run("grant to you") == 3 and run("grant of use to you") == 5 and run("grant of any use to all of you") == 8
    assert run("grant to all of these you") == -1 and run("grant of to you") == -1 and run("grant to") == -1


def test_places_by_brute_force(spark):
    more = spark.createDataFrame([(50, "CC-BY-NC cc by nc. Apache License, Version 2.0; x Cc By Nc"),
                                  (51, "under the mit license under the mit license"), (52, "under the mit-licenses"),
                                  (53, "é cc by né cc by nc")], "doc_id long, text string")
    docs = frames.awkward(spark).select("doc_id", "text").unionByName(more)
    rows = docs.collect()
    got = license_scan(frames.awkward(spark)).unionByName(license_scan(more)).collect()
    frames.same([r[:6] for r in got], [(r.doc_id, *base(r.text)) for r in rows])
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan(frames.empty(spark)).count() == 0


def test_templates_need_all_mandatory_words(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction")
    docs = spark.createDataFrame([(1, mit), (2, mit.replace("(the \"Software\"), ", "")), (3, mit.replace("hereby", "now")),
                                  (4, "Copyright (c) 2020 Some Body. All rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan(docs).collect()}
    assert got == {1: "mit", 2: "mit", 3: "", 4: "all-rights"}
