"""Official license headers in their own layout, as plain paragraphs and as comments."""

from stopwise.llm import licenses

OFFICIAL = {
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was"
    " not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    " the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this"
    "\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above"
    " copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other"
    " materials provided with the distribution.",
    "apache": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
    "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\n"
    'distributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either'
    " express or implied.",
}


def test_official_headers(spark):
    rows = [(f"{label} {mark}", "\n".join(mark + x for x in text.split("\n")), label) for label, text in OFFICIAL.items() for mark in ("", "# ", " * ")]
    frame = spark.createDataFrame(rows, "name string, text string, label string")
    assert [(r.name, r.labels) for r in licenses.scan(frame).collect() if r.labels != r.label] == []


WRAPPED = {
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    "mit": "Released under the\nMIT License",
    "apache": "Licensed under the Apache\nLicense, Version 2.0",
    "bsd": "Use of this source code is governed\nby a BSD-style license",
    "cc0": "To the extent possible under law, the author has waived all\ncopyright and related rights to this work",
}


def test_short_notices_wrapped_over_two_lines(spark):
    rows = [
        (f"{label} {mark}", "Before it.\n" + "\n".join(mark + x for x in text.split("\n")) + "\nAfter it.", label)
        for label, text in WRAPPED.items()
        for mark in ("", "# ", " * ")
    ]
    # Words that stand three lines apart are no notice, nor do paragraphs meet.
    rows += [("apart", "Released under the\nname of its author,\nthe MIT License", "")]
    rows += [("blank", "Released under the\n\nMIT License", ""), ("Kelvin", "Licen\u017fed under the MIT Licen\u017fe", "")]
    frame = spark.createDataFrame(rows, "name string, text string, label string")
    assert [(r.name, r.labels) for r in licenses.scan(frame).collect() if r.labels != r.label] == []
