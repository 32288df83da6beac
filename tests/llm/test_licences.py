import llm_paths  # noqa: F401
from texts import SCHEMA, frame, odd, rows

from broadsheet.llm import licences as L

MIT = dict(L.KNOWN[:1])["MIT"]


def test_rewritten_licences_are_found(spark):
    changed = "Copyright (c) 2020 Somebody\nAll rights reserved.\n" + MIT.upper().replace(",", " ,").replace("\n\n", "\r\n")
    spelled = MIT.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    texts = [MIT, changed, spelled, MIT + " And more.", "text\nReleased under the MIT Licence!\n(C) 2001 A\nSPDX-License-Identifier: Apache-2.0", "nothing"]
    got = {r.doc_id: (r.licence, r.notices) for r in L.licensed(frame(spark, rows(*texts))).collect()}
    assert [got[i][0] for i in range(6)] == ["MIT", "MIT", "MIT", None, None, None]
    assert got[4][1] == ["Apache-2.0", "MIT"] and got[5][1] == []
    same = {r.digest for r in L.licensed(frame(spark, rows(*texts[:3]))).collect()}
    assert len(same) == 1


def test_known_texts_name_one_licence(spark):
    found = L.known_digests(spark).collect()
    assert len({r.digest for r in found}) == len(found) > 500
    named = {}
    for licence, text in L.KNOWN:
        named.setdefault(text, set()).add(licence)
    assert all(len(v) == 1 for v in named.values())


def test_usual_forms_are_found(spark):
    isc, bsd = (dict(L.KNOWN[:5])[n] for n in ("ISC", "BSD-3-Clause"))
    body = MIT.split("\n\n", 1)[1]
    cases = [
        ("The MIT License (MIT)\n\n" + body, "MIT"),
        (body, "MIT"),
        ("MIT License\n\nCopyright Jane Doe\n\n" + body, "MIT"),
        ("Copyright <YEAR> <HOLDER>\n\n" + body, "MIT"),
        ("ISC License\n\nCopyright (c) 2020, Jane\n\n" + isc, "ISC"),
        ("BSD 3-Clause License\n\n" + bsd.replace("the disclaimer", "the\ndisclaimer"), "BSD-3-Clause"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licenced under the Apache Licence, Version 2.0", "Apache-2.0"),
        ("MIT License text is not here\n\n" + body, None),
        (bsd.replace("the following conditions", "\ncopyright conditions"), None),
    ]
    got = {r.doc_id: r.licence for r in L.licensed(frame(spark, rows(*(t for t, _ in cases)))).collect()}
    assert got == {i: name for i, (_, name) in enumerate(cases)}


def test_odd_rows(spark):
    docs = odd(spark)
    got = L.licensed(docs.withColumnRenamed("lang", "digest")).collect()
    assert len(got) == docs.count() and not any(r.licence or r.notices for r in got)
    assert {r.digest for r in got if r.doc_id in (0, 1, 2, 3)} == {None}
    assert L.licensed(frame(spark, [], SCHEMA)).count() == 0


def test_plan_has_no_python(spark, capsys):
    from conftest import SMALL

    L.query(spark, SMALL).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Arrow", "Pandas"))
