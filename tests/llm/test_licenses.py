import re

import pytest

from chunkloom.llm import licenses as li

from .conftest import words


def brute(text):
    """(first word, identifier): every known sentence at every word, by plain comparison of words."""
    known = {tuple(words(s)): n for n, ss in li.SENTENCES.items() for s in ss}
    low = text.lower()
    spans = [m.span() for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", low)]
    w = [low[a:b] for a, b in spans]

    def edge(i):  # between word i - 1 and word i
        if i in (0, len(w)):
            return True
        gap = low[spans[i - 1][1] : spans[i][0]]
        return bool(re.search(r"[\n\r]|[!.:;?](?=[\t\n\x0b\f\r ]|$)", gap))

    found, free = [], 0
    for i in range(len(w)):
        if i < free or not edge(i):
            continue
        for n in sorted({len(k) for k in known}, reverse=True):
            k = tuple(w[i : i + n])
            if len(k) == n and k in known and edge(i + n):
                found.append((i, known[k]))
                free = i + n
                break
    return found


def scan(table, rows):
    return sorted(((r.doc_id, r.license, r.first_word, tuple(r.sentences)) for r in li.licences(table(rows)).collect()), key=str)


APACHE = "\n".join(li.SENTENCES[k][0] for k in ("apache2-full", "apache2-copy", "apache2-asis", "apache2-see"))


def test_rules(table):
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n   ", APACHE)
    rows = [(1, "Code.\n" + APACHE), (2, wrapped), (3, "x\nReleased under the MIT License."), (4, "# licensed under CC BY-NC 4.0.\nmore"), (5, "it is Released under the MIT License. maybe"), (6, li.SENTENCES["apache2-see"][0])]
    got = scan(table, rows)
    assert [(d, lic, n) for d, lic, n, _ in got] == [(1, "Apache-2.0", 1), (2, "Apache-2.0", 0), (3, "MIT", 1), (4, "CC-BY-NC-4.0", 0), (6, "unmatched", 0)]
    assert got[0][3] == ("apache2-full", "apache2-copy", "apache2-asis", "apache2-see")


def test_order_counts(table):
    two, three = (li.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source"))
    binary, endorse = (li.SENTENCES[k][0] for k in ("bsd-binary", "bsd-endorse"))
    assert [x[1] for x in scan(table, [(1, "\n".join((two, three, binary, endorse)))])] == ["BSD-3-Clause"]
    assert [x[1] for x in scan(table, [(1, "\n".join((two, three, binary)))])] == ["BSD-2-Clause"]
    assert [x[1] for x in scan(table, [(1, "\n".join((three, two, binary)))])] == ["unmatched"] * 3
    assert [x[1] for x in scan(table, [(1, "\n".join(("Released under the MIT License.",) * 2))])] == ["MIT", "MIT"]


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.first_word, n) for r in li.licences(docs).collect() for n in r.sentences)
    assert got == sorted((d.doc_id, i, n) for d in docs.collect() for i, n in brute(d.text)) and len(got) > 40


def test_every_planted_line_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = ("Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.")
    want = {d.doc_id for d in docs.collect() if any(x in lines for x in d.text.split("\n"))}
    assert want <= {r.doc_id for r in li.licences(docs).collect()} and want


def test_odd_and_empty(odd, empty, table):
    assert li.licences(odd).collect() == [] and li.licences(empty).collect() == []
    far = "word " * 60_000 + "\nReleased under the MIT License."
    assert scan(table, [(None, far), (1, "All rights reserved."), (1, "All rights reserved.")]) == [(1, "all-rights-reserved", 0, ("rights",)), (1, "all-rights-reserved", 0, ("rights",)), (None, "MIT", 60_000, ("mit-short",))]


def test_rules_from_a_file(table, tmp_path):
    import json

    (tmp_path / "r.json").write_text(json.dumps({"sentences": {"a": "Free for all.", "b": ["Ask us first.", "Ask us."]}, "rules": [["Mine", ["a", "b"]], ["Short", ["a"]]]}))
    sentences, rules = li.load(str(tmp_path / "r.json"))
    got = li.licences(table([(1, "Free for all. Ask us."), (2, "free for ALL"), (3, "ask us first")]), sentences, rules).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "Mine"), (2, "Short"), (3, "unmatched")]
    (tmp_path / "r.json").write_text(json.dumps({"sentences": {"a": "x"}, "rules": [["Mine", ["c"]]]}))
    with pytest.raises(ValueError, match="names c"):
        li.load(str(tmp_path / "r.json"))


def test_every_sentence_is_in_a_rule():
    used = {n for _, ids in li.RULES for n in ids}
    assert used == li.SENTENCES.keys()
