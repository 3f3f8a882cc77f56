"""License wordings, one text each, and what every rule must have."""

import re

import pytest

from docquarry.llm import licenses

TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "bsl-1.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived": "bsd-3-clause",
    "The software is provided \"as is\", without warranty of any kind": "warranty-disclaimer",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2-or-later",
    "GPL-3.0-only": "gpl-3-only",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl,gpl-3-or-later",
    "the GNU Lesser General Public License as published, either version 2.1 of the License, or any later version.": "lgpl-2.1-or-later",
    "You may not use this file except in compliance with the License.": "apache-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Ada has waived all copyright": "",
    "To the extent possible under law, Ada has waived all copyright": "cc0",
    "a plain text about permission and warranty": "",
    None: "",
    "": "",
}


def test_wordings(spark):
    rows = list(TEXTS)
    found = licenses.scan_licenses(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()
    assert {rows[r["doc_id"]]: r["labels"] for r in found} == TEXTS


@pytest.mark.parametrize("rule", licenses.rules(), ids=lambda r: str(r[0]))
def test_keywords_gate_their_rules(rule):
    _, _, key, pattern, priority, _ = rule
    assert 0 <= priority < licenses.PRIORITIES and re.search(licenses.GATE, key)
    assert key.startswith(" ") and key.endswith(" ") and re.compile(pattern)
