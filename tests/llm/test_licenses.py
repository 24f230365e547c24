import textwrap

import pytest

from cashtide.llm.common import table
from cashtide.llm.licenses import TEMPLATES, _drawn, _level, fit, license_scan, notices

LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "reserved",
}


@pytest.fixture(scope="module")
def model(spark, sample):
    return fit(table(spark, sample, "documents"))


def test_awkward_rows(awkward, model):
    rows = [(1, None), (2, ""), (3, "Text.\n\nReleased under the MIT License.\r\n \r\nLicensed under CC BY-NC 4.0."), (4, "All rights reserved."), (4, "All rights reserved.")]
    rows += [(None, "Licensed under the Apache License, Version 2.0."), (5, "word " * 30_000 + "\n" + "x\n" * 2000), (6, "He lost his driving license in the reserved area.")]
    rows += [(7, "Text.\nReleased under the MIT License.\r\nLicensed under CC BY-NC 4.0."), (8, "Text.\r\rReleased under the MIT License.\r\rText.")]
    found = {r.doc_id: (r.families, r.n_confirmed) for r in license_scan(awkward(rows), classifier=model).collect()}
    assert found == {1: ("", 0), 2: ("", 0), 3: ("cc-by-nc,mit", 2), 4: ("reserved", 1), None: ("apache", 1), 5: ("", 0), 6: ("", 0), 7: ("cc-by-nc,mit", 1), 8: ("mit", 1)}
    assert license_scan(awkward([]), classifier=model).count() == 0


def test_training_without_documents(awkward):
    assert license_scan(awkward([])).count() == 0


def test_longer_notices(awkward, model):
    text = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."
    found = notices(awkward([(1, text)]), model).collect()
    assert [(r.family, r.confirmed) for r in found] == [("gpl", True)]


def test_several_notices_in_one_line(awkward, model):
    """All families of a line count, whether its notices stand far apart or within one window."""
    notice = {f: x for x, f in LINES.items()}
    gap = " The river ran on past the old mill. " * 200
    lgpl, mpl = "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the Mozilla Public License, Version 2.0."
    texts = {
        notice["mit"] + gap + notice["gpl"]: "gpl,mit",
        notice["mit"] + gap + notice["apache"] + gap + "All rights reserved.": "apache,mit,reserved",
        notice["apache"] + " " + notice["mit"]: "apache,mit",
        "Licensed under the Apache License, Version 2.0 or the MIT License.": "apache,mit",
        notice["gpl"] + " Part of it: " + lgpl: "gpl,lgpl",
        notice["apache"] + " " + mpl: "apache,mpl",
        "Licensed under CC BY 4.0. The pictures: " + notice["cc-by-nc"]: "cc-by,cc-by-nc",
        " ".join(notice.values()): ",".join(sorted(notice)),
        # Words that notices share make no second family.
        notice["apache"]: "apache", notice["gpl"]: "gpl", lgpl: "lgpl", mpl: "mpl",
    }
    found = {r.doc_id: (r.families, r.n_confirmed) for r in license_scan(awkward(list(enumerate(texts))), classifier=model).collect()}
    assert found == {i: (families, 1) for i, families in enumerate(texts.values())}


MIT = next(notice for family, notice in TEMPLATES if family == "mit" and notice.startswith("Permission"))
GPL = next(notice for family, notice in TEMPLATES if family == "gpl" and notice.startswith("This program"))


def test_wrapped_notices(awkward, model):
    """The width at which a notice is wrapped, marks of comments, and text around it change nothing."""
    rows, expected = [], {}
    for family, notice in (("mit", MIT), ("gpl", GPL)):
        for width in (30, 40, 60, 72, 1000):
            lines = textwrap.wrap(notice, width)
            prose = "The river ran on past the old mill and the road followed it for a while. "
            for shape in ("\n".join(lines), "\r\n".join(lines), "# " + "\n# ".join(lines), prose * 3 + "\n" + "\n".join(lines) + "\n" + prose * 7):
                expected[len(rows)] = family
                rows.append((len(rows), shape))
    assert {r.doc_id: r.families for r in license_scan(awkward(rows), classifier=model).collect()} == expected


def test_other_licences_are_unknown(awkward, model):
    texts = [
        "This work is licensed under the Eclipse Public License, version 2.0.",
        "Licensed under the Common Development and Distribution License, version 1.1.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files and any associated documentation (the Data Files) or Unicode software and any associated documentation (the Software) to deal in the Data Files or Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, and/or sell copies of the Data Files or Software",
        "Entry is free of charge.",
    ]
    assert {r.families for r in license_scan(awkward(list(enumerate(texts))), classifier=model).collect()} == {""}


def test_sample_is_of_ids(spark):
    """At most as many documents as asked for, one row an id, whatever one id's share of the rows."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "concat('word ', id) AS text").repartition(16)
    drawn = _drawn(docs, "doc_id", "text", 100, 20_000).collect()
    assert 40 <= len(drawn) <= 100 and len({r.doc_id for r in drawn}) == len(drawn)
    assert _drawn(docs.limit(0), "doc_id", "text", 100, 20_000).count() == 0


def test_given_tables(spark, sample, model):
    docs = table(spark, sample, "documents")
    expected = {r.doc_id: ",".join(sorted({LINES[x.strip()] for x in r.text.split("\n") if x.strip() in LINES})) for r in docs.collect()}
    found = {r.doc_id: r.families for r in license_scan(docs, classifier=model).collect()}
    wrong = [i for i in expected if expected[i] != found[i]]
    assert not wrong


def test_plan_has_no_python(spark, sample, model):
    plan = license_scan(table(spark, sample, "documents"), classifier=model)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_every_document_counts_in_training(spark, awkward):
    """A word of the notices that most paragraphs hold is no feature, however few documents of a sample hold it."""
    # Nine of ten texts are longer than any that a sample drew, or are on ids it would not have drawn.
    rows = [(i, ("The driver saw a sublicense there. " * 800) if i % 10 else "The river ran on past the old mill.") for i in range(600)]
    docs = awkward(rows)
    model = fit(docs)
    assert "sublicense" not in model.words and "mozilla" in model.words
    assert "sublicense" in fit(docs, sample=300).words


def test_level_is_of_all_windows(spark):
    scored = spark.createDataFrame([(0.1, 900), (0.2, 98), (0.5, 1), (0.9, 1)], "noticed double, n long")
    assert _level(scored, 0.999) == 0.5 and _level(scored, 0.99) == 0.2 and _level(scored.limit(0), 0.999) is None
