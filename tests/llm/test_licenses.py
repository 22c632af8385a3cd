import pytest

from slotforge.llm import licenses
from slotforge.llm.queries import op9_license_scan

FILES = [
    (1, "repo/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (2, "repo/src/a.py", "print(1)"), (3, "repo/src/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "repo/src/vendor/deep/er/b.py", None),
    (5, "repo/src/c.py", "# Licensed under the Apache License, Version 2.0.\ncode goes here\n" + "x = 1\n" * 50), (6, "repo/src/d.py", ""), (7, "other/e.py", "no words about it"), (8, None, "text"),
    (9, "LICENSE.txt", "Licensed under CC BY-NC 4.0."), (10, "repo/src/vendor/x.py", "y"), (2, "repo/src/a.py", "print(1)"), (None, "repo/z.py", "z"),
]


def brute(files, threshold=0.6):
    known = licenses.Templates(licenses.TEMPLATES)
    own, speaks = {}, {}
    for k, (i, path, text) in enumerate(files):
        found = [(known.best(b), n) for b, n in licenses._blocks((text or "").encode())]
        good = [(s, n) for s, n in found if s[0] >= threshold]
        own[k] = licenses.chosen([s for s, _ in good]) if good else None
        name = (path or "").rsplit("/", 1)[-1]
        if own[k] and path is not None and (licenses.LICENCE_FILE.search(name) or 2 * max(n for _, n in good) >= len((text or "").encode().split())):
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            speaks.setdefault(folder, []).append((own[k][0], -(2**62 if i is None else i), own[k][1]))
    out = []
    for k, (i, path, _) in enumerate(files):
        licence, where = own[k][1] if own[k] else None, None
        if not licence and path is not None:
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            while True:
                if folder in speaks:
                    licence, where = max(speaks[folder])[2], folder
                    break
                if not folder:
                    break
                folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
        out.append((i, path, licence, where))
    return sorted(out, key=str)


def test_inheritance(spark):
    df = spark.createDataFrame([(*f, "x", "y") for f in FILES], "doc_id long, path string, text string, dir string, own string")
    rows = licenses.scan(df).collect()
    assert sorted(((r["id"], r["path"], r["licence"], r["from_dir"]) for r in rows), key=str) == brute(FILES)
    by = {r["id"]: r for r in rows}
    assert by[1]["licence"] == "MIT" and by[2]["licence"] == "MIT" and by[4]["licence"] == "GPL-3.0" and by[5]["licence"] == "Apache-2.0"
    assert by[7]["licence"] == "CC-BY-NC-4.0" and by[7]["from_dir"] == "" and by[8]["licence"] is None and by[10]["from_dir"] == "repo/src/vendor"
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("name,text", licenses.TEMPLATES)
def test_templates_name_themselves(name, text):
    score, found = licenses.Templates(licenses.TEMPLATES).best(text)
    assert found == name and score > 0.99


def test_ordinary_text_states_nothing():
    known = licenses.Templates(licenses.TEMPLATES)
    for text in ("The driver showed a license at the border and drove on.", "copyright law is a subject of study", "with permission of the author we print this"):
        assert known.best(text)[0] < 0.6


@pytest.mark.parametrize("text,name", [
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("// SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("# SPDX-License-Identifier: BSL-1.0", "BSL-1.0"), ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("GNU General Public License v2.0", "GPL-2.0"), ("Licensed under the GPLv3", "GPL-3.0"), ("Licensed under the GPL v3.0", "GPL-3.0"), ("Distributed under the BSD license", "BSD-3-Clause"),
    ("All rights reserved. Licensed under the MIT license.", "MIT"), ("All rights reserved.", "Proprietary"), ("This project is not licensed under the MIT license.", None), ("SPDX-License-Identifier: Unheard-Of-9", None),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Keep the notice.", "BSD-2-Clause"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.", "BSD-3-Clause"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n", "AGPL-3.0"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n", "LGPL-2.1"),
    ("This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3.0"),
])
def test_headers_of_families(text, name):
    known = licenses.Templates(licenses.TEMPLATES)
    found = [known.best(b) for b, _ in licenses._blocks(text.encode())]
    assert licenses.chosen([f for f in found if f[0] >= 0.6])[1] == name


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in op9_license_scan(spark, sf).collect()}
    files = [(r["doc_id"], f"{r['source']}/d{r['doc_id'] // 100}/{r['doc_id']}.txt", r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((i, r["path"], r["licence"], r["from_dir"]) for i, r in rows.items()), key=str) == brute(files)
