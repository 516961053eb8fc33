import textwrap

from wavecairn.llm import common, licenses
from wavecairn.llm.queries import op3_licenses


def test_each_wording_is_told_apart():
    s = licenses.Scanner()
    for name, wordings in licenses.TEMPLATES.items():
        for w in wordings:
            assert licenses.scan_text(s, f"before it\n{w}\nafter it")[1] == [(name, 10, 10 + len(w))], w
    assert licenses.scan_text(s, "  LICENSED under the apache license,   version 2.0")[1][0][0] == "Apache-2.0"
    for no in ("Licensed under CC BY-NC 3.0.", "Not licensed under the GNU General Public License, version 4.", "A driving license is needed.", "Licensed under the Apache License, Version 1.1."):
        assert licenses.scan_text(s, no)[1] == [], no


def test_planted_lines_are_found_exactly(spark):
    d = "/root/testdata/sf0.01"
    known = {w: n for n, ws in licenses.TEMPLATES.items() for w in ws}
    found = {r.doc_id: r.spans for r in op3_licenses(spark, d).collect()}
    some = 0
    for r in common.documents(spark, d).collect():
        at, want = 0, []
        for line in (r.text or "").split("\n"):
            if line in known:
                want.append(f"{known[line]}:{at}:{at + len(line)}")
            at += len(line) + 1
        some += len(want)
        assert set(want) <= set(found[r.doc_id].split(",")) | {""}
    assert some > 10


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "All rights reserved.", 2), (3, "license " * 50_000, 3), (None, "All rights reserved.", 2)], "doc_id long, text string, n_blocks int")
    got = sorted((str(r.doc_id), r.n_blocks, r.licenses) for r in licenses.scan(docs).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 1, ""), ("None", 1, "Proprietary"), ("None", 1, "Proprietary")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_wordings_at_any_length():
    s = licenses.Scanner()
    for name, wordings in licenses.TEMPLATES.items():
        for w in wordings:
            for width in (20, 75):
                for mark in ("", " * ", "# "):
                    text = "\n".join(mark + x for x in ["first line", *textwrap.wrap(w, width), "last line"])
                    ((got, at, end),) = licenses.scan_text(s, text)[1]
                    assert got == name and licenses._words(text[at:end]) == licenses._words(w), text
    mit = licenses.TEMPLATES["MIT"][2]
    long = "A copyright line.\n" * 400 + mit + "\nNo permission here." * 400
    assert licenses.scan_text(s, long)[1] == [("MIT", 18 * 400, 18 * 400 + len(mit))]


def test_result_does_not_depend_on_the_line():
    s = licenses.Scanner()
    notice = "Released under the MIT License."
    for n in range(0, 400, 7):
        text = ("some ordinary prose that runs on and on, " * 10)[:n] + " " + notice + " More prose."
        assert licenses.scan_text(s, text)[1] == [("MIT", n + 1, n + 1 + len(notice))]
    both = "Licensed under the MIT License. Licensed under the ISC License. Licensed under CC BY 4.0."
    assert [x[0] for x in licenses.scan_text(s, both)[1]] == ["MIT", "ISC", "CC-BY-4.0"]
    mpl = licenses.TEMPLATES["MPL-2.0"][0]
    assert licenses.scan_text(s, "Prose goes before it. " * 12 + mpl)[1] == [("MPL-2.0", 22 * 12, 22 * 12 + len(mpl))]
    far = "Permission came late. " + "Nobody knew why the river rose so early that year and left. " * 12 + mpl + licenses.TEMPLATES["ISC"][1].replace("Permission", " Permision")
    assert [x[0] for x in licenses.scan_text(s, far)[1]] == ["MPL-2.0", "ISC"]


def plain(scanner, text):
    """All templates at all places of the whole text, without candidate blocks or look-ups."""
    spots = [(m.start(), m.end(), m[0].lower()) for m in licenses._WORD.finditer(text)]
    names = set()
    for template, compressor in scanner.given:
        t, n = template.words, len(template.words)
        for s in range(len(spots)):
            if spots[s][2] not in t[: template.spare + 1]:
                continue
            states = {(a, s + 1, a) for a in range(template.spare + 1) if t[a] == spots[s][2] and not any(template.telling[:a])}
            states = {(a + 1, end, miss) for a, end, miss in states}
            while states:
                states_next = set()
                for a, end, miss in states:
                    if a == n:
                        if scanner.saved(text[spots[s][0] : spots[end - 1][1]], compressor) >= licenses.SAVED:
                            names.add(template.name)
                        continue
                    if miss < template.spare and not template.telling[a]:
                        states_next.add((a + 1, end, miss + 1))
                    for k in range(end, min(len(spots), s + licenses.SPREAD * n)):
                        if spots[k][2] == t[a]:
                            states_next.add((a + 1, k + 1, miss))
                            break
                        if licenses._telling(spots[k][2]):
                            break
                states = states_next
    return names


def test_names_against_all_templates_at_all_places(spark, sf_dir):
    s, some = licenses.Scanner(), 0
    found = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in op3_licenses(spark, sf_dir).collect()}
    for r in common.documents(spark, sf_dir).collect():
        want = plain(s, r.text or "")
        some += len(want)
        assert found[r.doc_id] == want, (r.doc_id, want, found[r.doc_id])
    assert some > 3


def test_every_window_is_ranked_by_all_templates():
    s = licenses.Scanner()
    for name, wordings in licenses.TEMPLATES.items():
        for w in wordings:
            own = w.rstrip(".")
            want = sorted(((s.saved(own, c), -k) for k, (_, c) in enumerate(s.given)), reverse=True)
            assert s.ranked(own) == [(x, -k) for x, k in want]
            ((got, _, _, saved, rank, missing, added),) = licenses.findings(s, f"before it\n{w}\nafter it")[1]
            assert (got, rank, missing, added) == (name, 1, 0, 0) and saved >= licenses.SAVED


def test_confirmed_in_the_order_of_the_ranking(monkeypatch):
    s, tried, plain_ = licenses.Scanner(), [], licenses.Template.aligned
    monkeypatch.setattr(licenses.Template, "aligned", lambda self, *a: (tried.append(self), plain_(self, *a))[1])
    text = "This work is licensed under the GNU Lesser General Public License, version 3"
    assert [f.name for f in licenses.findings(s, text)[1]] == ["LGPL-3.0"]
    assert tried[: len(s.given)] == [s.given[k][0] for _, k in s.ranked(text)] and tried[0].name == "LGPL-3.0"


def test_evidence_tells_ranks_and_exact_differences(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = ["Released under the MIT License.", mit.replace("hereby granted", "hereby most gladly granted"), mit.replace("free of charge", "free charge"), "No license.", None]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].licenses for k in range(5)] == ["MIT", "MIT", "MIT", "", ""]
    assert [got[k].evidence.split(":")[1:] for k in range(3)] == [["1", "0", "0"], ["1", "0", "2"], ["1", "1", "0"]]
    assert all(int(got[k].evidence.split(":")[0]) >= 100 * licenses.SAVED for k in range(3)) and got[3].evidence == got[4].evidence == ""
