"""Canonical licence digests: brute force of digest and licence, whole licence texts
in other case, wrapping, years and spellings."""

import hashlib
import os
import textwrap

import pytest
import regex

from equipoise.llm import licences
from equipoise.llm.licence_texts import KNOWN, KNOWN_DIGESTS
from equipoise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SHARED = "/usr/share/common-licenses"


def line_form(line: str) -> str:
    if regex.search(licences._HOLDER, line):
        return ""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ").split(" ")
    return " ".join(licences.EQUIVALENT.get(w, w) for w in words)


def forms(text: str | None) -> tuple[str, list[str]]:
    lines = [line_form(x) for x in (text or "").split("\n")]
    return " ".join(x for x in lines if x), lines


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def known() -> dict[str, str]:
    out = {d: k for k, _, d in KNOWN_DIGESTS}
    out.update({sha(forms(t)[0]): k for k, t in KNOWN})
    return out


def want(text, table):
    whole, lines = forms(text)
    hits = [table[sha(x)] for x in lines if x and sha(x) in table]
    return sha(whole), table.get(sha(whole)), sorted(set(hits)), len(hits)


def scan(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["digest"], r["license"], r["line_licenses"], r["n_notices"])
                   for r in licences.scan_licences(spark, df, **kw).collect()), key=str)


def test_all_documents(spark):
    table = known()
    got = {r["doc_id"]: r for r in QUERIES["op6_licence_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        d, name, lines, n = want(text, table)
        assert tuple(got[i][c] for c in ("digest", "license", "line_licenses", "n_notices")) == (d, name, ",".join(lines), n)


def _variants(text: str) -> list[str]:
    body = text.strip("\n")
    paragraphs = [" ".join(p.split()) for p in body.split("\n\n")]
    return [body, body.upper(), "Copyright (c) 2024 A. Person\nAll rights reserved.\n\n" + body,
            "\n\n".join("\n".join(textwrap.wrap(p, 50)) for p in paragraphs),
            "© 1999 Somebody\n" + body.replace("\n", "\r\n"), "Copyright The Authors\n" + body.replace("license", "licence"),
            body.replace('"', "*").replace(",", " ,")]


def test_whole_texts_in_other_forms(spark):
    rows, names = [], []
    for name, text in KNOWN:
        if "\n" in text:
            for v in _variants(text):
                rows.append((len(rows), v))
                names.append(name)
    got = scan(spark, rows)
    assert {r[0]: r[2] for r in got} == dict(enumerate(names))
    cut = scan(spark, [(i, t[:-40]) for i, t in rows])
    assert not any(r[2] for r in cut)


@pytest.mark.skipif(not os.path.isdir(SHARED), reason="no licence texts on this machine")
@pytest.mark.parametrize("name, file", [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"),
                                        ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"),
                                        ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")])
def test_long_licences(spark, name, file):
    with open(f"{SHARED}/{file}", encoding="utf-8") as f:
        text = f.read()
    end = text.find("END OF TERMS AND CONDITIONS")
    rows = [text, text.lower(), "Copyright 2031 X\n\n" + text, text.replace("License", "Licence").replace("\n", "  \n"),
            text[:end] if end > 0 else text]
    got = scan(spark, list(enumerate(rows)))
    assert [r[2] for r in got] == [name] * len(rows)
    assert scan(spark, [(0, text.replace("the", "teh", 1))])[0][2] is None


def test_edges(spark):
    table = known()
    notice = "Released under the MIT License."
    rows = [(1, None), (1, ""), (2, notice), (2, notice), (None, f"x\n{notice}\n{notice.upper()}"), (3, "\n" * 5),
            (4, (notice + "\nword\n") * 20_000), (5, notice + " "), (6, "Copyright holders may\nlose")]
    expect = sorted(((i, *want(t, table)) for i, t in rows), key=str)
    assert scan(spark, rows) == expect
    own = licences.known_digests(spark)
    assert scan(spark, rows, known=own.drop("length")) == expect  # every line gets a digest
    assert scan(spark, rows, known=own.union(own)) == expect  # repeated digests
    assert scan(spark, [], known=own) == []
    none = scan(spark, rows, known=own.filter("false"))
    assert [r[2:] for r in none] == [(None, [], 0)] * len(rows)
