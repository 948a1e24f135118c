import pytest
from llm_cases import empty, frame, rows
from tieline.llm import licences

NOTICES = {
    500: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
    501: ("This work is licensed under the GNU General Public License, version 3.", ["GPL"]),
    502: ("licensed under the  APACHE License, version 2.0", ["Apache-2.0"]),
    503: ("Released under the MIT License.\nsome words\nAll rights reserved.", ["MIT", "proprietary"]),
    504: ("This software is licensed under the terms of the MIT license.", ["MIT"]),
    505: ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA"]),
    506: ("She lost her driving licence and paid a fine.", []),
    507: ("The general public may visit the library; version 3 of the map is free.", []),
    508: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["MIT"]),
    509: ("w1 w2 w3 " * 20_000, []),
}


@pytest.fixture(scope="module")
def answers(spark):
    data = rows() + [(d, "w5 w6 w7\n" + t if t else t, "en", "s", 1) for d, (t, _) in NOTICES.items()]
    return licences.licences(frame(spark, data)).collect()


def test_families(answers):
    got = {r.doc_id: r for r in answers}
    assert {d: got[d].families for d in NOTICES} == {d: want for d, (_, want) in NOTICES.items()}
    assert got[503].n_notices == 2 and got[503].n_paragraphs == 4


def test_other_documents_have_none(answers):
    assert len(answers) == len(rows()) + len(NOTICES)
    assert all(r.families == [] and r.n_notices == 0 for r in answers if r.doc_id is None or r.doc_id < 500)
    got = {r.doc_id: r for r in answers}
    assert got[120].n_paragraphs == got[121].n_paragraphs == got[122].n_paragraphs == 0


def test_empty_table(spark):
    assert licences.licences(empty(spark)).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
PROSE = "\n".join(" ".join("w%d" % (i * 7 + j) for j in range(11)) for i in range(30))
WRAPPED = {
    600: (f"Title\n\n{MIT}\n\nw1 w2", ["MIT"]),
    601: ("/*\n" + "".join(f" * {x}\n" for x in BSD.split("\n")) + " */", ["BSD"]),
    602: ("\r\n".join(["# " + x for x in GPL.split("\n")]), ["GPL"]),
    603: (LGPL, ["LGPL"]),
    604: (f"{PROSE}\n{MIT}\n{PROSE}", ["MIT"]),
    605: (f"{GPL}\n \t\n{PROSE}\n\n\n\n{BSD}", ["BSD", "GPL"]),
    606: (f"{PROSE}\n\n{PROSE}", []),
}


def test_wrapped_notices(spark):
    data = rows() + [(d, t, "en", "s", 1) for d, (t, _) in WRAPPED.items()]
    got = {r.doc_id: r for r in licences.licences(frame(spark, data)).collect()}
    assert {d: got[d].families for d in WRAPPED} == {d: want for d, (_, want) in WRAPPED.items()}
    assert got[600].n_notices == 1 and got[605].n_notices == 2 and got[600].n_paragraphs == 8
