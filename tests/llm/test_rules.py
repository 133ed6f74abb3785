"""Licenses and url rules against plain Python, and the SQL of all that have one."""

import random
import re
from collections import Counter

import pytest

from regmodel.llm import licenses, queries, url_rules

from ..compare import database, rows

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""


@pytest.mark.parametrize("text,label,later", [
    (MIT, "text-mit", "EVENT"), (BSD.format(""), "text-bsd-2", "DISCLAIMED"), (BSD.format(THIRD), "text-bsd-3", "endorse"), (APACHE, "header-apache", "governing"), (GPL, "header-gpl", "MERCHANTABILITY"),
])
def test_whole_wordings(text, label, later):
    """Only the whole wording is accepted: a changed later word is not."""
    import pyarrow as pa

    scanner = licenses.Scanner()
    labels = lambda x: [y for y in next(scanner.scan(pa.array([x])))[5].split(",") if y.startswith(("text", "header"))]
    assert labels("Copyright 2020.\n" + text) == [label]
    assert labels(text.replace(later, "other")) == [] and labels(text[: len(text) // 2]) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(database(data).sql(queries.ORACLES[name]).df())


CASES = [
    (1, "Released under the MIT License.", 1, 3, 3, "mit", "mit,notice-mit", 1.0),
    (2, MIT, 0, None, None, "", "text-mit", 1.0),
    (3, MIT.replace("merge", "fold"), 0, None, None, "", "", 0.0),
    (4, "cc by CC-BY", 2, 0, 2, "cc-by", "cc-by", 0.5),
    (5, None, 0, None, None, "", "", 0.0),
    (6, "", 0, None, None, "", "", 0.0),
    (7, "This work is licensed under the terms of the GNU General Public License, version 3", 1, 9, 9, "gpl", "gpl,notice-gpl", 1.0),
    (8, "Licensed under a CC BY-NC 4.0", 1, 3, 3, "cc-by", "cc-by,notice-cc-by-nc", 1.0),
    (9, "mit licenseé mit", 0, None, None, "", "", 0.0),
]


def test_licenses(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t, *_ in CASES] * 2 + [(None, "x " * 100_000 + "apache license", 0)], "doc_id long, text string, labels int")
    got = Counter((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect())
    want = Counter((i, *rest) for i, _, *rest in CASES * 2) + Counter([(None, 1, 100_000, 100_000, "apache", "apache", 0.5)])
    assert got == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_automaton_against_pattern():
    a = licenses.Automaton("go <<optional>> to <<end>> <<any:2>> stop")
    pattern = re.compile(r"^go( to)?( \w+){0,2} stop( |$)")
    rng = random.Random(4)
    for _ in range(400):
        text = ["go", *(rng.choice(["to", "a", "stop"]) for _ in range(rng.randrange(6)))]
        assert (a.match(text, 0) is not None) == bool(pattern.match(" ".join(text)))


def test_nested_optional_parts():
    a = licenses.Automaton("go <<optional>> to <<optional>> the <<end>> end <<end>> stop")
    accepted = [x for x in ("go stop", "go to end stop", "go to the end stop", "go to stop", "go the end stop", "go end stop", "go to the stop") if a.match(x.split(), 0) is not None]
    assert accepted == ["go stop", "go to end stop", "go to the end stop"]


def brute(url, rules, default):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), h, p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else default


def test_url_rules(spark):
    rng = random.Random(9)
    labels = ["a", "b", "ab", "example", "org", "com"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    path = lambda: "".join(rng.choice(["/", "x", "xy", "/de/", ""]) for _ in range(4))
    rules = [*url_rules.RULES, *((rng.choice(["allow", "block"]), host(rng.randrange(1, 4)), "/" + path()) for _ in range(60)), ("block", "", "/")]
    urls = [None, "", "no scheme/x", "http://", "HTTP://Example.ORG/es/a?b#c", "x://a.example.org/en/12", "a://b://c/d", *(f"http://{host(rng.randrange(1, 5))}{rng.choice(['', '?q', '#f', '/' + path()])}" for _ in range(600)), *["http://www.a.com/de/1"] * 300]
    pages = spark.createDataFrame([(i if i % 50 else None, u, 0) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.apply_rules(pages, table).collect())
    assert got == Counter((i if i % 50 else None, *brute(u, rules, "allow")) for i, u in enumerate(urls))
    assert url_rules.apply_rules(pages.limit(0), table).count() == 0
    assert url_rules.apply_rules(pages, table.limit(0)).where("verdict <> 'allow'").count() == 0


def test_url_rules_of_many_paths_and_other_letters(spark):
    """Equally long rules of nested hosts go by host; only A-Z are lower-cased; a host of many rules is one look a length."""
    rules = [("block", "\u00c9x.org", "/"), ("block", "z.org", "/ab"), ("allow", "org", "/abcd"), ("block", "a.org", "/ab"), *(("block", "big.net", f"/p{i}") for i in range(30_000))]
    urls = ["http://\u00c9X.org/a", "http://\u00e9x.org/a", "http://z.org/abcde", "http://a.org/abcde", "http://big.net/p29999/x", "http://big.net/p2999x", "http://big.net/q"] + [f"http://big.net/p{i}" for i in range(3000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame([(*r, 1, "x") for r in rules], "verdict string, host string, path string, page_id int, url string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_rules.apply_rules(pages, table, "none").collect()}
    assert got[0] == ("\u00c9x.org", "\u00c9x.org/", "block") and got[1][1:] == (None, "none")
    assert got[2][1:] == ("org/abcd", "allow") and got[3][1:] == ("a.org/ab", "block")
    assert got[4][1] == "big.net/p29999" and got[5][1] == "big.net/p2999" and got[6][1] is None and all(got[7 + i][1] == f"big.net/p{i}" for i in range(3000))
