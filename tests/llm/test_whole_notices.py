"""Licence notices over several lines, and notices without a word that speaks of licences."""

import textwrap

from hearthspark.llm import license_scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def test_wrapped_notices_and_notices_without_an_anchor(spark):
    wrap = lambda t, w: "\n".join(textwrap.wrap(t, w))
    texts = [wrap(MIT, 70), "Copyright (c) someone\n\n" + wrap(BSD, 60) + "\n\nmore", "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0.", BSD.replace("Redistribution ", ""), "This Source Code Form is subject to the terms of the Mozilla Public", "plain lines\nof no interest\nat all"]
    model = license_scan.fit([])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(df, model).collect()}
    assert got == {0: "mit", 1: "bsd", 2: "mpl", 3: "bsd", 4: "mpl"}
    rows = license_scan.paragraphs(df, model).filter("confirmed").collect()
    assert len(rows) == 5


def test_no_confirmed_line_is_filtered_out():
    model = license_scan.fit([])
    for share in (0.5, 0.6, 0.9):
        implied = set(license_scan.implied_words(model, share))
        for sets in model.distinctive.values():
            for s in sets:
                left = sum(not implied & set(g.split()) for g in s)
                assert not s or left < share * len(s)


def test_background_lines_come_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(license_scan, "fit", lambda lines: seen.extend(lines))
    license_scan.train(spark.createDataFrame([("x" * 3000 + "\nzebra line",)], "text string"))
    assert "zebra line" in seen
